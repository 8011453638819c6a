"""Sinks and sources by way of files that the query itself writes from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.keys import BAR
from staffline.operators import linear, numbering, render
from staffline.plans import derived
from staffline.plans import experiment as X
from staffline.plans.catalog import query, rounded, stable
from staffline.plans.catalog.ingest import INSTRUMENT_SQL, instrument_name
from staffline.plans.derived import with_tables
from staffline.sources import notes as note_sources
from staffline.sources import records
from staffline.streaming import files as streams


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that executors share."""
    return f"{numbering.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "quarantined_files",
    """SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, CAST(9 AS BIGINT) AS read_files, CAST(1 AS BIGINT) AS broken_files, true AS has_reason FROM lineitem""",
)
def quarantined_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten files, one of them broken: the rows of nine and one row of quarantine."""
    at = folder(spark, "broken")
    items = derived.table(spark, sf_dir, "lineitem").select("l_linenumber", "l_returnflag")
    items.repartition(9).write.parquet(at)
    derived.table(spark, sf_dir, "region").selectExpr("r_name").coalesce(1).write.mode("append").text(at)
    raw = note_sources.read_notes(spark, at, schema="l_linenumber INT, l_returnflag STRING", pattern="part-*")
    bad = note_sources.unread_files(raw, at, "part-*").agg(F.count(F.lit(1)).alias("broken_files"), F.bool_and(F.length("reason") > 0).alias("has_reason"))
    good = raw.agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"), F.count_distinct("source_path").alias("read_files"))
    return good.join(bad)  # one row each


@query(
    "relayed_results",
    """SELECT concat(o_orderpriority, '/', o_orderstatus, '/', m) AS key, round(CASE m WHEN 'price' THEN avg(o_totalprice) ELSE count(*) END + 1e-10, 3) AS value, count(*) // count(*) AS n
       FROM orders, (VALUES ('price'), ('orders')) v(m) GROUP BY o_orderpriority, o_orderstatus, m
       UNION ALL SELECT 'unreadable files', 1.0, 1""",
)
def relayed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result file per condition, every one sent twice, and a broken one, through the relay with state and a ledger."""
    at = folder(spark, "relay")
    per = derived.table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("price"), F.count(F.lit(1)).cast("double").alias("orders"))
    metrics = F.create_map(F.lit("price"), F.col("price"), F.lit("orders"), F.col("orders"))
    results = per.groupBy(F.col("o_orderpriority").alias("condition_label")).agg(
        F.lit(0).alias("rank"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("o_orderstatus", F.to_json(metrics).alias("m"))))).alias("m")
    ).select("condition_label", "rank", F.transform_values("m", lambda k, v: F.from_json(v, "MAP<STRING, DOUBLE>")).alias("metrics_summary"))
    results = numbering.durable(results)  # summed once: a second sum in another order of rows would be another result
    for _ in range(2):
        results.write.mode("append").option("maxRecordsPerFile", 1).json(f"{at}/in")
    derived.table(spark, sf_dir, "region").selectExpr("concat('{', r_name)").coalesce(1).write.mode("append").text(f"{at}/in")
    stream = streams.relay(spark, f"{at}/in", max_files=4, pattern="part-*", once=True)
    streams.run_available(stream, streams.ledger_sink(f"{at}/out", f"{at}/ledger"), f"{at}/state")
    faults = spark.read.parquet(f"{at}/ledger").agg(F.lit("unreadable files").alias("key"), F.count(F.lit(1)).cast("double").alias("value"), F.lit(1).cast("long").alias("n"))
    found = spark.read.parquet(f"{at}/out").groupBy("key").agg(stable(F.avg("value"), 3).alias("value"), F.count(F.lit(1)).alias("n"))
    return found.unionByName(faults)


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(condition, metric, value) means over events: the user's class is the condition."""
    e = derived.table(spark, sf_dir, "events")
    rows = e.select(F.concat(F.lit("codec"), (F.col("user_id") % 7).cast("string")).alias("condition"), F.col("event_type").alias("metric"), "value", (F.col("event_id") % 4).cast("int").alias("rank"))
    return rows.groupBy("rank", "condition", "metric").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))


_MEANS = """means AS (SELECT CAST(event_id % 4 AS INT) AS rank, concat('codec', user_id % 7) AS condition, event_type AS metric, avg(value) AS value, count(*) AS n FROM events GROUP BY ALL)"""


@query(
    "summary_files",
    f"""WITH {_MEANS} SELECT concat(condition, '-', rank) AS condition, metric, round(value + 1e-10, 6) + 0.0 AS value FROM means""",
)
def summary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary per condition as JSON, read back."""
    at = folder(spark, "summary")
    means = event_scores(spark, sf_dir).select(F.concat_ws("-", "condition", "rank").alias("condition"), "metric", "value")
    records.write_summary(means, at)
    return rounded(records.read_summary(spark, at), ["condition", "metric"])


@query(
    "rank_summary_files",
    f"""WITH {_MEANS}, w AS (SELECT condition, max(rank) AS rank FROM means GROUP BY 1)
    SELECT condition, metric, round(value + 1e-10, 6) + 0.0 AS value, (SELECT count(DISTINCT rank) FROM means) AS num_ranks,
           (SELECT count(DISTINCT (rank, condition)) FROM means) AS num_conditions, round((SELECT sum(n) * 0.01::DOUBLE FROM means), 2) AS total_elapsed_seconds
    FROM means JOIN w USING (condition, rank)""",
)
def rank_summary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rank writes its summary into a folder of its own; all are scanned, the later rank wins a condition."""
    at = folder(spark, "ranks")
    per = event_scores(spark, sf_dir).groupBy("rank", "condition").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"), F.sum("n").alias("n"))
    ranks = per.groupBy("rank").agg(
        F.sort_array(F.collect_list("condition")).alias("conditions"), F.collect_list(F.substring("condition", 6, 1).cast("int")).alias("condition_indices"),
        (F.sum("n") * 0.01).alias("elapsed_seconds"), F.map_from_entries(F.collect_list(F.struct("condition", "m"))).alias("metrics_summary"),
    )
    ranks.withColumn("folder", F.col("rank")).repartition("folder").write.partitionBy("folder").json(at)
    found = records.read_rank_summaries(spark, at, pattern="part-*.json")
    totals = X.merge_rank_totals(found).select("num_ranks", "num_conditions", "total_elapsed_seconds")
    return rounded(X.merge_rank_metrics(found, order="rank").join(F.broadcast(totals)), ["condition", "metric", "total_elapsed_seconds"])


@query(
    "benchmark_file",
    """SELECT l_returnflag AS stage, round(avg(l_quantity) + 1e-10, 6) AS mean_s, round(stddev_samp(l_quantity) + 1e-10, 6) AS std_s FROM lineitem GROUP BY 1""",
)
def benchmark_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timings per stage as one benchmark record, written and read."""
    at = folder(spark, "bench")
    stages = derived.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("stage")).agg(
        F.avg("l_quantity").cast("double").alias("mean_s"), F.stddev_samp("l_quantity").cast("double").alias("std_s")
    )
    records.write_records(stages.agg(F.lit("now").alias("timestamp"), F.collect_list(F.struct("stage", "mean_s", "std_s")).alias("results")).coalesce(1), at)
    return rounded(records.read_benchmark(spark, at).select("stage", "mean_s", "std_s"), ["stage"])


@query(
    "array_store",
    """SELECT vec_id, round(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE)) + 1e-10, 6) + 0.0 AS first_channel,
              round(list_sum(list_transform(embedding[49:64], lambda x: x::DOUBLE)) + 1e-10, 6) + 0.0 AS last_channel, '4x4x4' AS shape FROM embeddings""",
)
def array_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of one shape, written and read, sliced by their first dimension."""
    at, shape = folder(spark, "arrays"), (4, 4, 4)
    records.write_arrays(derived.table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", shape, at)
    total = lambda i: F.aggregate(records.array_slice(F.col("values"), shape, i), F.lit(0.0), lambda a, x: a + x.cast("double"))
    back = records.read_arrays(spark, at)
    return back.select("vec_id", stable(total(0)).alias("first_channel"), stable(total(3)).alias("last_channel"), F.array_join("shape", "x").alias("shape"))


@query(
    "cells_by_instrument_files",
    with_tables(f"""SELECT {INSTRUMENT_SQL} AS instrument, count(*) AS n_cells, CAST(sum(velocity * (step + 1)) AS BIGINT) AS checksum FROM cells GROUP BY 1"""),
)
def cells_by_instrument_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells in a folder per instrument, compressed, read back."""
    at = folder(spark, "cells")
    note_sources.write_cells(derived.cells(spark, sf_dir).withColumn("instrument", instrument_name()), at)
    return spark.read.parquet(at).groupBy("instrument").agg(F.count(F.lit(1)).alias("n_cells"), F.sum(F.col("velocity") * (F.col("step") + 1)).alias("checksum"))


@query(
    "ordered_notes",
    with_tables("""SELECT song_id, track_idx, bar_index, onset_step, pitch, note_ord, CAST(row_number() OVER (ORDER BY song_id, track_idx, bar_index, onset_step, pitch, note_ord, velocity) - 1 AS BIGINT) AS place FROM notes"""),
)
def ordered_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes in files that follow each other by (song, track, bar, onset, pitch); the place of a row comes from the manifest."""
    at = folder(spark, "ordered")
    order = ["song_id", "track_idx", "bar_index", "onset_step", "pitch", "note_ord", "velocity"]
    manifest = records.write_ordered(derived.notes(spark, sf_dir).select(*order), order, at)
    rows = records.read_ordered(spark, at)
    sizes = [r["rows"] for r in manifest.orderBy("first", "last").collect()]  # a row per file
    starts = F.array(*[F.lit(sum(sizes[:i])).cast("long") for i in range(len(sizes))])
    return rows.select(*order[:-1], (F.get(starts, F.col("_file")) + F.col("_row")).alias("place"))


@query(
    "linear_codec_on_images",
    with_tables("""
    WITH s AS (SELECT pitch, step, sum(velocity / 127.0::DOUBLE) AS s FROM cells GROUP BY ALL),
    n AS (SELECT count(*) AS n FROM (SELECT DISTINCT song_id, track_idx, bar_index FROM cells))
    SELECT n, round((SELECT sum(velocity / 127.0::DOUBLE * velocity / 127.0::DOUBLE) FROM cells) - (SELECT sum(s * s) FROM s) / n, 3) AS variance,
           true AS falling, true AS shares, true AS error_is_the_rest FROM n"""),
)
def linear_codec_on_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six components of all velocity planes of 12,288 positions; images come back with the error that the components leave."""
    segments = derived.segments(spark, sf_dir).persist()
    pixels = linear.flat(render.strips(segments, "velocity_only"))
    bars = segments.select(*BAR).distinct()
    codec = linear.fit(pixels, 6, n_bars=bars.count(), steps=3)
    # Unclamped images, background included, so that the error is the variance that is left.
    error = codec.squared_error(pixels, codec.encode(pixels, bars)).first()["error"]
    segments.unpersist()
    rest = codec.variance * (1 - codec.explained.sum())
    return spark.range(1).select(
        F.lit(codec.rows).cast("long").alias("n"), F.round(F.lit(codec.variance), 3).alias("variance"),
        F.lit(bool((codec.explained[1:] <= codec.explained[:-1] + 1e-12).all())).alias("falling"),
        F.lit(bool(0 < codec.explained.sum() <= 1)).alias("shares"), F.lit(bool(abs(error - rest) < 1e-6 * codec.variance)).alias("error_is_the_rest"),
    )
