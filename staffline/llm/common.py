"""Helpers shared by the corpus operators: shared folders, tables, text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that a Python worker handles at once.
GROUP_BYTES = 4 << 20
#: ASCII capitals and their small letters, for ``translate``.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BYTES_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors can reach.

    It lies below the folder named by ``spark.checkpoint.dir``. Where that is unset, a local
    session gets a temporary one; on a cluster it is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return f"{sc.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write to a shared folder and read again: short lineage, computed once, safe from lost executors."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder, partitionBy=list(partition_by) or None)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def open_folder(uri: str):
    """(file system, path) of a folder's URI, usable on executors."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_field(df: DataFrame, column: str) -> T.StructField:
    return T.StructField(column, df.schema[column].dataType)


def ascii_lower(text: Column) -> Column:
    """A-Z made small, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def groups(batch: pa.RecordBatch, column: str, limit: int = GROUP_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive rows with about ``limit`` bytes; null texts are empty."""
    texts = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield a, pc.fill_null(texts.slice(a, b - a), "").to_pylist()


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``starts[i] .. starts[i] + lengths[i]``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)

