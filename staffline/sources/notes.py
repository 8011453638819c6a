"""Note-event tables as input: typed scans, quarantine, partitioned output."""

from __future__ import annotations

import io
import re
from urllib.parse import unquote

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTE_SCHEMA = (
    "song_id STRING, track_idx INT, program INT, is_drum BOOLEAN, pitch INT, "
    "start_tick BIGINT, duration_ticks BIGINT, velocity INT, note_ord BIGINT, ticks_per_quarter INT"
)
CORRUPT = "_corrupt_record"
#: Files without rows that are looked into at once; more point to a wrong path, which is an error.
MAX_UNREAD = 10_000
# File patterns of the known collections.
COLLECTIONS = {"lakh": "*.mid", "pop909": "*.mid", "maestro": "*.midi"}


def read_notes(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: str = NOTE_SCHEMA,
    pattern: str | None = None,
    recursive: bool = True,
) -> DataFrame:
    """Scan note events, adding ``source_path``.

    Text formats keep unreadable lines in ``_corrupt_record``; unreadable Parquet
    files are skipped, and :func:`unread_files` lists them. One bad file never fails the job.
    """
    reader = spark.read.format(fmt).option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if fmt in ("csv", "json"):
        schema = f"{schema}, {CORRUPT} STRING"
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        if fmt == "csv":
            reader = reader.option("header", "true")
    else:
        reader = reader.option("ignoreCorruptFiles", "true")
    return reader.schema(schema).load(path).withColumn("source_path", F.col("_metadata.file_path"))


def split_corrupt(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine) of a text scan."""
    bad = F.col(CORRUPT).isNotNull()
    return raw.filter(~bad).drop(CORRUPT), raw.filter(bad).select("source_path", CORRUPT)


def _fault(content: bytes) -> str | None:
    """What is wrong with a Parquet file that gave no rows; None if it has none."""
    try:
        rows = pq.read_metadata(io.BytesIO(content)).num_rows
    except Exception as e:  # whatever the reader makes of broken bytes is the reason
        return f"{type(e).__name__}: {str(e)[:200]}"
    return f"{rows} rows promised, none read" if rows else None


def unread_files(raw: DataFrame, path: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """(source_path, length, reason): Parquet files below ``path`` from which the scan ``raw`` has no row.

    ``raw`` comes from :func:`read_notes` of the same path. All files are listed by name and length; only those without rows are
    opened, on executors, to tell a broken file from an empty one, which is not listed. Paths are read by
    Spark's own readers, wherever they lie.
    """
    spark = raw.sparkSession

    def listing() -> DataFrame:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)

    files = listing().select(F.col("_metadata.file_path").alias("source_path"), "length")
    silent = files.join(raw.select("source_path").distinct(), "source_path", "left_anti")
    names = [r["source_path"] for r in silent.select("source_path").limit(MAX_UNREAD + 1).collect()]
    if len(names) > MAX_UNREAD:
        raise ValueError(f"more than {MAX_UNREAD} files without rows")
    if not names:
        return silent.select("source_path", "length", F.lit(None).cast("string").alias("reason"))
    reason = F.udf(_fault, "string")
    opened = spark.read.format("binaryFile").load([re.sub(r"([\\\[\]{}*?,])", r"\\\1", unquote(n)) for n in names])
    found = opened.select(F.col("_metadata.file_path").alias("source_path"), "length", reason("content").alias("reason"))
    return found.where(F.col("reason").isNotNull())


def collection_files(sources: DataFrame, collection: str, union: bool = False) -> DataFrame:
    """File rows of a known collection.

    ``maestro`` takes ``.midi`` files and falls back to ``.mid`` only when there is
    none; with ``union`` both are taken.
    """
    if collection not in COLLECTIONS:
        raise ValueError(f"unknown collection {collection!r}; choose from {sorted(COLLECTIONS)}")
    is_mid, is_midi = F.col("path").endswith(".mid"), F.col("path").endswith(".midi")
    if collection != "maestro":
        return sources.filter(is_mid)
    if union:
        return sources.filter(is_mid | is_midi)
    found = sources.agg(F.coalesce(F.bool_or(is_midi), F.lit(False)).alias("_midi"))  # one row
    return (
        sources.join(F.broadcast(found), F.when(F.col("_midi"), is_midi).otherwise(is_mid)).drop("_midi")
    )


def write_cells(cells: DataFrame, path: str) -> None:
    """Cell table partitioned by instrument, gzip-compressed."""
    cells.write.mode("errorifexists").partitionBy("instrument").option("compression", "gzip").parquet(path)
