"""A sample of each project's files for the detection of people and projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tessera.operators.chunk import first_bytes

#: Endings of prose and of code, and the prose files below which code counts, too.
PROSE, CODE, FEW = ("md", "txt", "rst"), ("rs", "py", "ts", "js", "go"), 5


def detection_sample(files: DataFrame, most: int = 10, file_bytes: int = 5_000, all_bytes: int = 40_000) -> DataFrame:
    """(project, path, place, content): of each project up to ``most`` files, prose before code, by path.

    ``files`` has project, path and content.  Code is taken only where a project
    has fewer than FEW prose files.  A content is cut to ``file_bytes`` whole
    characters' worth of bytes, and a project's files end where those before have
    reached ``all_bytes``.  Every run takes the same files; null contents are
    empty, other endings and null paths play no part, and equal paths of a
    project are taken by their content.  Projects are sampled apart, each from
    its first files alone, so a large one isn't gathered.
    """
    ending = F.element_at(F.split("path", r"\."), -1)
    kinds = F.when(ending.isin(*PROSE), 0).when(ending.isin(*CODE), 1)
    rows = files.select("project", "path", F.coalesce("content", F.lit("")).alias("content"), kinds.alias("kind")).filter("path is not null and kind is not null")
    prose = rows.groupBy("project").agg(F.count_if(F.col("kind") == 0).alias("prose")).filter(F.col("prose") >= FEW).select(F.col("project").alias("rich"))
    left = rows.join(prose, (F.col("kind") == 1) & F.col("project").eqNullSafe(F.col("rich")), "left_anti")
    order = W.partitionBy("project").orderBy("kind", "path", F.sha2(F.col("content").cast("binary"), 256))
    first = left.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    cut = first.withColumn("content", first_bytes(F.col("content"), file_bytes))
    before = F.coalesce(F.sum(F.octet_length("content")).over(W.partitionBy("project").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("before", before).filter(F.col("before") < all_bytes).select("project", "path", "place", "content")
