"""What a job needs of its cluster: the shared folder, and the sources on the workers."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows up to which a narrow table goes to every executor.
BROADCAST_ROWS = 200_000
_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the library to the Python workers, unless they find it where the driver does.

    Workers look in ``PYTHONPATH`` and in the folder that the driver was started
    in; elsewhere an archive of the sources goes along with the application.
    """
    root = Path(__file__).resolve().parent.parent
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or root in [*paths, Path.cwd()]:
        return
    _SHIPPED.add(app)
    folder = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/tessera_sources.zip", "w") as out:
        for path in [*sorted(root.glob("tessera/**/*.py")), *root.glob("corpus_pipeline.py")]:
            out.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(f"{folder}/tessera_sources.zip")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A temporary folder stands in only where the setting is missing and the
    master is a single process, as in tests; elsewhere a missing setting is an
    error, since other machines could not read a local folder.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not conf.get("spark.master", "").startswith("local") or conf.get("spark.master").startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        holder = tempfile.TemporaryDirectory(prefix="tessera-", ignore_cleanup_errors=True)
        atexit.register(holder.cleanup)
        _LOCAL[app] = f"file://{holder.name}"
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder with the file system that Spark uses for it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Later plans then start from files that every executor can read, so a lost
    executor costs its running tasks only.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, counted: DataFrame | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has ``most`` rows at most, else as it is.

    ``counted`` is the table to count, which should be written already.
    """
    return F.broadcast(df) if (df if counted is None else counted).count() <= most else df


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Yields a ``materialize`` whose tables are deleted at the end of the block."""
    made: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = new_path(spark, name)
        made.append(path)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        for path in made:
            with contextlib.suppress(Exception):
                delete_path(spark, path)
