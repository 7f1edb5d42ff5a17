"""Small helpers for functions over Arrow batches."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text that one step of a batch function holds at a time.
STEP_BYTES = 4 << 20
#: Rows of an Arrow batch, where the session has Spark's default of 10,000.
BATCH_ROWS = 1000
#: Bytes of text after which a worker gives freed memory back.
RELEASE_BYTES = 16 << 20
_SINCE = 0
_LIBC = None
_OWNER: str | None = None
_CLEAR: dict[str, Callable[[], object]] = {}


def small_batches(spark: SparkSession) -> None:
    """Let batches of texts have ``BATCH_ROWS`` rows in this session, unless it says otherwise.

    A batch is held by the executor and by its worker at once, so its size
    counts twice for each core.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def claim(owner: str, clear: Callable[[], object]) -> None:
    """Say that a worker's tables are now those of ``owner``; the last owner's go."""
    global _OWNER
    _CLEAR[owner] = clear
    if _OWNER not in (None, owner):
        _CLEAR[_OWNER]()
        release()
    _OWNER = owner


def slices(texts: pa.Array, most_bytes: int = STEP_BYTES, most_rows: int = 2000) -> Iterator[tuple[int, int]]:
    """Cuts the rows of a batch into runs of bounded text; a longer row stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    first = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and (total + n > most_bytes or i - first >= most_rows):
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)
    global _SINCE
    _SINCE += int(sizes.sum())
    if _SINCE >= RELEASE_BYTES:
        _SINCE = 0
        release()


def release() -> None:
    """Give freed memory back to the machine, which workers of a job share."""
    global _LIBC
    pa.default_memory_pool().release_unused()
    if _LIBC is None:
        _LIBC = ctypes.CDLL(ctypes.util.find_library("c") or "libc.so.6")
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def binaries(values: np.ndarray, lens: np.ndarray) -> pa.Array:
    """One binary per row from the bytes of ``values``, ``lens`` items each."""
    ends = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64) * values.itemsize
    values = np.ascontiguousarray(values)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())
