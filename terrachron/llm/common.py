"""Shared plumbing of the corpus operators: inputs, written tables, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_OWN_DIR: list[tempfile.TemporaryDirectory] = []


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, as (doc_id long, text string); a null text is empty.

    Every other column, whatever its name, is pruned before the scan.
    """
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def crc_fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds`` (null ids: null)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(folds)


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the session's checkpoint folder.

    The cluster names the folder in ``spark.checkpoint.dir``; only where that is unset and
    all executors are in this process (tests, local mode) a temporary folder of this machine
    is used. A cluster without a shared folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN_DIR:
            _OWN_DIR.append(tempfile.TemporaryDirectory(prefix="shared-"))
            atexit.register(_OWN_DIR[0].cleanup)
        base = "file://" + _OWN_DIR[0].name
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, keep: list | None = None) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder and read it back.

    The table survives the loss of executors. ``keep``, if given, gets its path, so
    that the caller can drop it with :func:`drop_path` once it is not needed.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    if keep is not None:
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`written` made."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _give_back() -> None:
    """Return memory that this process has freed, but still holds, to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_arrow(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` whose tasks give their freed memory back.

    Python workers live on from stage to stage: what each stage leaves in them would add up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


def by_bytes(batches: Iterator[pa.RecordBatch], most: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches, each of at most ``most`` bytes of text (or one row)."""
    import numpy as np

    for b in batches:
        if not b.num_rows:
            continue
        size = pa.compute.binary_length(b.column(b.schema.get_field_index(text))).fill_null(0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size.astype(np.int64))
        at = 0
        while at < b.num_rows:
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
            yield b.slice(at, end - at)
            at = end


def flat_bytes(col: pa.Array):
    """The bytes of a string column and the row boundaries in them (a null row is empty)."""
    import numpy as np

    if col.null_count:
        col = pa.compute.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None or not len(col):
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def sampled(df: DataFrame, key: str, most: int) -> DataFrame:
    """All rows if there are at most ``most`` of them, else about ``most``, chosen by a hash of ``key``.

    Only ``key`` is read to count the rows. The choice does not depend on their order.
    """
    n = df.select(key).count()
    if n <= most:
        return df
    share = int(most / n * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(20_483)), F.lit(1 << 30)) < share)
