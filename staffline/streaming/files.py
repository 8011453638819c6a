"""File streams: bounded ingest batches, running metric means, relayed results, transitions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from staffline.keys import STEPS, TRACK
from staffline.operators.ingest import bar_pieces, merge_pieces, pieces_to_segments
from staffline.operators.numbering import durable, sequence_next

FILES_PER_BATCH = 100
RELAY_SCHEMA = "condition_label STRING, rank INT, metrics_summary MAP<STRING, STRING>, _corrupt_record STRING"


def read_files(
    spark: SparkSession, path: str, schema: str, fmt: str = "parquet", pattern: str | None = None,
    max_files: int = FILES_PER_BATCH,
) -> DataFrame:
    """Stream of files as they arrive, each read once, at most ``max_files`` per batch."""
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def run_available(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Process what is there in bounded batches and stop; a restart continues after the last batch."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(sink).start()
    )
    query.awaitTermination()
    return query


def batch_folder_sink(path: str, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """Write each batch to its own folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").format(fmt).save(f"{path}/batch={batch_id}")

    return write


def pieces_sink(
    path: str, to_notes: Callable[[DataFrame], DataFrame], steps: int = STEPS, n_bars: int | None = None
) -> Callable[[DataFrame, int], None]:
    """Land the bar pieces of each batch of notes; :func:`landed_segments` resolves overlaps over all of them."""
    write = batch_folder_sink(path)
    return lambda batch, batch_id: write(bar_pieces(to_notes(batch), steps, n_bars), batch_id)


def landed_segments(spark: SparkSession, path: str, steps: int = STEPS, whole: bool = False) -> DataFrame:
    """Segments of everything landed so far, the same however notes were dealt to batches.

    With ``whole`` a track's last bar goes if its notes end before the bar does, as in :func:`notes_to_segments`.
    """
    pieces = merge_pieces(spark.read.parquet(path))
    segments = pieces_to_segments(pieces)
    if not whole:
        return segments
    last = pieces.groupBy(*TRACK).agg(F.max(F.struct("bar_index", "off")).alias("_last"))
    cut = last.where(F.col("_last.off") < steps - 1).select(*TRACK, F.col("_last.bar_index").alias("bar_index"))
    return segments.join(cut, [*TRACK, "bar_index"], "left_anti")


def latest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the highest batch written by :func:`batch_folder_sink`, for streams in complete mode."""
    rows = spark.read.parquet(path)
    last = rows.agg(F.max("batch").alias("b")).first()["b"]
    return rows.filter(F.col("batch") == last).drop("batch")


def running_means(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean of each metric over all rows so far; NaN poisons, absent rows do not count."""
    return metrics.groupBy(*by).agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def relay(
    spark: SparkSession, folder: str, max_files: int = FILES_PER_BATCH, pattern: str = "cond_*.json", once: bool = False
) -> DataFrame:
    """Stream of result files, flattened to (key, value, rank), with ``path`` and ``bad``.

    Keys are ``condition/codec/metric``, or ``condition/name`` for a plain number. A file
    that cannot be parsed gives one row with the error text in ``bad`` and is not retried. With ``once`` a result that
    arrives again, in whatever file, is passed on once: its digest is kept as streaming state, a row per result.
    """
    raw = (
        spark.readStream.schema(RELAY_SCHEMA).option("multiLine", "true").option("mode", "PERMISSIVE")
        .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).json(folder)
    ).withColumn("path", F.col("_metadata.file_path"))
    if once:
        entries = F.to_json(F.array_sort(F.map_entries("metrics_summary")))
        digest = F.sha2(F.to_json(F.struct("condition_label", "rank", entries.alias("m"), F.col("_corrupt_record").alias("b"))), 256)
        raw = raw.withColumn("_digest", digest).dropDuplicates(["_digest"]).drop("_digest")
    label = F.coalesce("condition_label", F.lit("unknown"))
    rank = F.coalesce("rank", F.lit(-1))
    bad = F.col("_corrupt_record").isNotNull()
    groups = raw.select(
        label.alias("label"), rank.alias("rank"), F.col("_corrupt_record").alias("bad"), "path",
        F.explode(F.when(bad, F.create_map(F.lit(""), F.lit(""))).otherwise(F.col("metrics_summary"))).alias("name", "body"),
    )
    nested = F.from_json("body", "MAP<STRING, DOUBLE>")
    entries = F.when(F.col("body").startswith("{"), nested).otherwise(
        F.create_map(F.lit(""), F.expr("try_cast(body AS DOUBLE)"))
    )
    flat = groups.select("label", "rank", "bad", "path", "name", F.explode(entries).alias("metric", "value"))
    parts = F.filter(F.array("label", "name", "metric"), lambda p: p != "")
    return flat.select(
        F.when(F.col("bad").isNull(), F.array_join(parts, "/")).alias("key"), "value", "rank", "bad", "path"
    )


def ledger_sink(out: str, ledger: str) -> Callable[[DataFrame, int], None]:
    """Sink of :func:`relay`: good rows to ``out``, a row per unreadable file to ``ledger``; repeated batches replace themselves."""
    results, faults = batch_folder_sink(out), batch_folder_sink(ledger)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = durable(batch)
        results(rows.where("bad IS NULL").select("key", "value", "rank"), batch_id)
        faults(rows.where("bad IS NOT NULL").select("path", F.substring("bad", 1, 200).alias("text")).distinct(), batch_id)

    return write


def transition_sink(folder: str, key: str = "sequence_id") -> Callable[[DataFrame, int], None]:
    """Sink of (sequence, bar_index, pc) batches that keeps transitions as signed deltas; :func:`transitions` adds them up.

    A bar that comes after all earlier ones of its sequence adds one move. A late bar takes back the move it breaks (-1) and adds the two
    that it makes, so whatever the order of arrival the sum is that of the whole sequence; bars of one place follow each
    other by ``pc``. The last bar of each sequence is carried from batch to batch (a small row per sequence). Sequences
    with late bars, and only these, are read again from the landed bars. Folders are named by batch and read up to the batch
    before, so a repeated batch writes the same rows again.
    """
    part = lambda name, batch_id: f"{folder}/{name}/batch={batch_id}"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = durable(batch.select(key, "bar_index", "pc"))
        new.write.mode("overwrite").parquet(part("bars", batch_id))
        before = new.limit(0)
        if batch_id > 0:
            last = spark.read.parquet(part("last", batch_id - 1))
            first = new.groupBy(key).agg(F.min("bar_index").alias("_first"))
            late = durable(first.join(last, key).where(F.col("_first") <= F.col("bar_index")).select(key))
            landed = spark.read.parquet(f"{folder}/bars").where(F.col("batch") < batch_id).select(key, "bar_index", "pc")
            before = last.join(late, key, "left_anti").unionByName(landed.join(late, key, "left_semi"))
        old = sequence_next(before, [key], "bar_index", ["pc"], ties=["pc"], prefix="old_").withColumn("new", F.lit(False))
        fresh = new.withColumn("old_pc", F.lit(None).cast(dict(new.dtypes)["pc"])).withColumn("new", F.lit(True))
        # Of bars of one place and class the old come first, so that a new one changes no more than it must.
        both = sequence_next(old.unionByName(fresh), [key], "bar_index", ["pc", "new"], ties=["pc", "new"])
        touched = both.where(F.col("new") | F.col("next_new"))
        made = touched.where(F.col("next_pc").isNotNull()).select(key, "pc", "next_pc", F.lit(1).alias("delta"))
        broken = touched.where(~F.col("new") & F.col("old_pc").isNotNull()).select(key, "pc", F.col("old_pc").alias("next_pc"), F.lit(-1).alias("delta"))
        sums = made.unionByName(broken).groupBy(key, "pc", "next_pc").agg(F.sum("delta").alias("delta")).where("delta <> 0")
        sums.write.mode("overwrite").parquet(part("deltas", batch_id))
        ends = new if batch_id == 0 else new.unionByName(last)
        ends.groupBy(key).agg(F.max_by("pc", F.struct("bar_index", "pc")).alias("pc"), F.max("bar_index").alias("bar_index")).write.mode(
            "overwrite"
        ).parquet(part("last", batch_id))

    return write


def transitions(spark: SparkSession, folder: str, key: str = "sequence_id") -> DataFrame:
    """(sequence, pc, next_pc, n): the moves of everything landed so far by :func:`transition_sink`."""
    sums = spark.read.parquet(f"{folder}/deltas").groupBy(key, "pc", "next_pc").agg(F.sum("delta").alias("n"))
    return sums.where("n <> 0")
