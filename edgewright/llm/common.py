"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own where that is unset in a local session,
    whose driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rewritten(df: DataFrame, path: str) -> DataFrame:
    """The same at a path of the shared folder, in place of a table there that nothing reads any more."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query are deleted when the query ends, not when memory runs out."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def id_and_text(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The two columns that operators on texts read, whatever else ``docs`` holds."""
    return docs.select(F.col("doc_id"), (F.col("text") if text is None else text).alias("text"))


def held_out(modulus: int, remainder: int) -> Column:
    """Whether the CRC-32 of ``doc_id`` written as text leaves ``remainder``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def rows_of(batches: Iterable[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[list, ...]]:
    """Each Arrow batch, or each ``most`` rows of it, as a tuple of Python lists, one per column."""
    for batch in batches:
        for a in range(0, len(batch) or 1, most or max(1, len(batch))):
            yield tuple(column.to_pylist() for column in batch.slice(a, most).columns)


def packed(x: np.ndarray, level: int = 1) -> bytes:
    """An array as compressed bytes, all first bytes of its numbers before all second ones."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + (pa.Codec("zstd", compression_level=level).compress(planes, asbytes=True) if len(x) else b"")


def unpacked(data: bytes, dtype: str) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(data[8:], n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).ravel()
