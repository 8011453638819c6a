"""Records of experiments: JSON and Parquet readers and sinks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANK_SCHEMA = (
    "rank INT, conditions ARRAY<STRING>, condition_indices ARRAY<INT>, elapsed_seconds DOUBLE, "
    "metrics_summary MAP<STRING, MAP<STRING, DOUBLE>>, _corrupt_record STRING"
)
BENCH_SCHEMA = (
    "timestamp STRING, results ARRAY<STRUCT<stage: STRING, mean_s: DOUBLE, std_s: DOUBLE, "
    "files_per_sec: DOUBLE, bars_per_sec: DOUBLE, pairs_per_sec: DOUBLE>>"
)
RANK_PATTERN = "sweep_summary_rank*.json"


def read_rank_summaries(spark: SparkSession, folder: str, nested: bool = False, pattern: str = RANK_PATTERN) -> DataFrame:
    """One row per summary file with ``path``; unreadable files have a ``_corrupt_record``.

    ``nested`` also looks into ``rank_*`` sub-folders.
    """
    paths = f"{folder}/rank_*" if nested else folder
    return (
        spark.read.schema(RANK_SCHEMA)
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", pattern)
        .json(paths)
        .withColumn("path", F.col("_metadata.file_path"))
    )


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """(stage, mean_s, ...) of one benchmark file."""
    raw = spark.read.schema(BENCH_SCHEMA).option("multiLine", "true").json(path)
    return raw.select("timestamp", F.inline("results"))


def write_records(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Append rows as JSON lines or Parquet; commits are atomic per job."""
    df.write.mode("append").format(fmt).save(path)


def read_records(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def write_summary(means: DataFrame, path: str) -> None:
    """One JSON object per condition, a map of its metrics, from (condition, metric, value); NaN and infinity are kept."""
    text = F.when(F.isnan("value"), "NaN").when(F.col("value") == float("inf"), "Infinity").when(F.col("value") == float("-inf"), "-Infinity")
    entry = F.struct("metric", F.coalesce(text, F.col("value").cast("string")).alias("value"))
    per = means.where(F.col("value").isNotNull()).groupBy("condition").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("metrics"))
    write_records(per, path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """(condition, metric, value) of what :func:`write_summary` wrote."""
    rows = read_records(spark, path, "condition STRING, metrics MAP<STRING, STRING>")
    return rows.select("condition", F.explode("metrics").alias("metric", "value")).withColumn("value", F.col("value").cast("double"))


def write_arrays(df: DataFrame, keys: Sequence[str], column: str, shape: Sequence[int], path: str) -> None:
    """Arrays of one shape, flattened in row-major order, as (keys, values, shape); an array of another length is an error."""
    size = math.prod(shape)
    fits = F.assert_true(F.size(column) == size, F.lit(f"arrays must have {size} values"))
    rows = df.select(*keys, F.col(column).alias("values"), F.array(*map(F.lit, shape)).alias("shape"), fits.alias("_fits"))
    rows.where(F.col("_fits").isNull()).drop("_fits").write.mode("errorifexists").parquet(path)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(keys, values, shape) of what :func:`write_arrays` wrote."""
    return spark.read.parquet(path)


def array_slice(values: Column, shape: Sequence[int], at: int) -> Column:
    """The part of a flat array below position ``at`` of its first dimension."""
    size = math.prod(shape[1:])
    return F.slice(values, at * size + 1, size)


def write_ordered(df: DataFrame, order: Sequence[str], path: str) -> DataFrame:
    """Files that are sorted by ``order`` one after the other, and the manifest that gives their order.

    Rows are dealt by range and sorted inside, so no task sees the whole. The manifest (file, rows, first) has a row
    per file and lies in ``path``/manifest; :func:`read_ordered` reads by it.
    """
    keys = [F.col(c) for c in order]
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("errorifexists").parquet(f"{path}/files")
    written = df.sparkSession.read.schema(df.schema).parquet(f"{path}/files")
    manifest = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.struct(*keys)).alias("first"), F.max(F.struct(*keys)).alias("last")
    )
    manifest.write.mode("errorifexists").parquet(f"{path}/manifest")
    return df.sparkSession.read.parquet(f"{path}/manifest")


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """Rows with ``_file``, the place of their file in the order, and ``_row``, their place in the file."""
    manifest = spark.read.parquet(f"{path}/manifest")
    place = manifest.select("file", (F.row_number().over(Window.orderBy("first", "last")) - 1).alias("_file"))  # a row per file
    rows = spark.read.parquet(f"{path}/files")
    return rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("_row")).join(F.broadcast(place), "file").drop("file")
