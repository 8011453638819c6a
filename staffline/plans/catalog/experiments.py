"""Experiment queries: evaluation, grids, summaries, rankings, merges, streams, the whole job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.keys import BAR
from staffline.operators import note_metrics, numbering
from staffline.plans import derived, job
from staffline.plans import experiment as X
from staffline.plans.catalog import ORACLES, query, rounded, stable
from staffline.plans.catalog.ingest import INSTRUMENT_SQL, instrument_name
from staffline.plans.catalog.notes import _ONSETS, BOTH, _pearson, sides
from staffline.plans.derived import with_tables
from staffline.plans.evaluate import Tables, evaluate, match_report
from staffline.streaming import files as streams

FLAGSHIP = ("onset_f1", "note_density_pearson", "pitch_class_histogram_correlation", "velocity_mse")


@query(
    "flagship",
    with_tables(f"""
    WITH RECURSIVE {BOTH}, {_ONSETS},
    walk(song_id, track_idx, bar_index, free, p, n, hits) AS (
      SELECT song_id, track_idx, bar_index, t, p, len(t), 0 FROM ons
      UNION ALL
      SELECT song_id, track_idx, bar_index, CASE WHEN g IS NULL THEN free ELSE list_filter(free, lambda x: x <> g) END, p[2:], n,
             hits + CASE WHEN g IS NULL THEN 0 ELSE 1 END
      FROM (SELECT *, CASE WHEN list_contains(free, p[1]) THEN p[1] WHEN list_contains(free, p[1] - 1) THEN p[1] - 1
                           WHEN list_contains(free, p[1] + 1) THEN p[1] + 1 END AS g FROM walk WHERE len(p) > 0)),
    f1 AS (SELECT w.song_id, w.track_idx, w.bar_index, 2.0::DOUBLE * hits / (n + len(o.p)) AS onset_f1
           FROM walk w JOIN ons o USING (song_id, track_idx, bar_index) WHERE len(w.p) = 0),
    t AS (SELECT song_id, track_idx, bar_index, step, count(*) AS tn, avg(velocity) AS tv FROM cells GROUP BY ALL),
    p AS (SELECT song_id, track_idx, bar_index, step, count(*) AS pn, avg(velocity) AS pv FROM (
            SELECT *, unnest(range(greatest(0, onset), least(96, "offset"))) AS step FROM rec_notes) GROUP BY ALL),
    g AS (SELECT song_id, track_idx, bar_index, coalesce(tn, 0) AS tn, coalesce(pn, 0) AS pn, coalesce(tv, 0) AS tv, coalesce(pv, 0) AS pv
          FROM grid LEFT JOIN t USING (song_id, track_idx, bar_index, step) LEFT JOIN p USING (song_id, track_idx, bar_index, step)),
    sp AS (SELECT song_id, track_idx, bar_index, {_pearson('96', 'tn', 'pn').replace('round(', '(').replace(' + 1e-10, 6)', ')')} AS density,
                  avg((tv - pv) * (tv - pv)) AS vmse FROM g GROUP BY 1, 2, 3),
    tc AS (SELECT song_id, track_idx, bar_index, pitch % 12 AS pc, count(*) AS n FROM cells GROUP BY ALL),
    pcn AS (SELECT song_id, track_idx, bar_index, pitch % 12 AS pc, count(*) AS n FROM rec_notes GROUP BY ALL),
    h AS (SELECT song_id, track_idx, bar_index, coalesce(tc.n, 0) AS a, coalesce(pcn.n, 0) AS b FROM both_bars CROSS JOIN range(12) r(pc)
          LEFT JOIN tc USING (song_id, track_idx, bar_index, pc) LEFT JOIN pcn USING (song_id, track_idx, bar_index, pc)),
    pr AS (SELECT song_id, track_idx, bar_index, {_pearson('12', 'a', 'b').replace('round(', '(').replace(' + 1e-10, 6)', ')')} AS pc FROM h GROUP BY 1, 2, 3)
    SELECT {INSTRUMENT_SQL} AS instrument, count(*) AS bars, round(avg(onset_f1) + 1e-10, 6) AS onset_f1,
           round(avg(density) + 1e-10, 6) AS note_density_pearson, round(avg(pc) + 1e-10, 6) AS pitch_class_histogram_correlation,
           round(avg(vmse) + 1e-10, 6) AS velocity_mse
    FROM f1 JOIN sp USING (song_id, track_idx, bar_index) JOIN pr USING (song_id, track_idx, bar_index) GROUP BY 1"""),
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean onset F1, density and pitch-class correlation and velocity error per instrument."""
    true, pred = sides(spark, sf_dir)
    bars = note_metrics.bar_scores(true, pred, ["onsets", "steps", "classes"]).where("onset_f1 IS NOT NULL")
    bars = bars.withColumn("instrument", instrument_name())
    return bars.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("bars"), *[F.avg(m).alias(m) for m in FLAGSHIP]
    ).transform(rounded)


@query(
    "match_report",
    with_tables("""
    WITH r AS (SELECT DISTINCT song_id, track_idx, bar_index + note_ord % 2 AS bar_index FROM rec_notes),
    c AS (SELECT DISTINCT song_id, track_idx, bar_index, true AS hit FROM cells)
    SELECT count(*) AS reconstructed, count(hit) AS matched, count(*) - count(hit) AS unmatched
    FROM r LEFT JOIN c USING (song_id, track_idx, bar_index)"""),
)
def match_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = derived.rec_notes(spark, sf_dir).withColumn("bar_index", F.col("bar_index") + F.col("note_ord") % 2)
    return match_report(derived.segments(spark, sf_dir), shifted)


_EVALUATED = {
    "onset_scores": ("onset_precision", "onset_recall", "onset_f1"),
    "step_profiles": ("note_density_pearson", "velocity_mse", "velocity_correlation"),
    "pitch_class_scores": ("pitch_class_histogram_correlation",),
}


@query(
    "evaluate_harmony",
    "SELECT track_idx, metric, round(avg(value) + 1e-10, 4) AS value, count(value) AS n FROM ("
    + " UNION ALL ".join(
        f"SELECT track_idx, '{m}' AS metric, {m} AS value FROM ({ORACLES[q]}) {q}_{i}"
        for q, names in _EVALUATED.items() for i, m in enumerate(names)
    )
    + ") WHERE value IS NOT NULL GROUP BY 1, 2",
)
def evaluate_harmony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric names to long rows to means per track."""
    true, pred = sides(spark, sf_dir)
    long = evaluate(Tables(true, pred), ["harmony", "dynamics", "-interval_histogram_correlation"])
    return rounded(X.summarise(long, ["track_idx"]), digits=4)


# --- metric tables: order lines as scores of conditions ---------------------------------------

_SCORES = """all_scores AS (
  SELECT 'codec' || l_suppkey % 6 AS codec, CASE l_linenumber % 3 WHEN 0 THEN 'velocity_only' WHEN 1 THEN 'vo_split' ELSE 'vos' END AS strategy,
         l_returnflag AS detector, l_orderkey AS bar,
         CASE l_partkey % 4 WHEN 0 THEN 'onset_f1' WHEN 1 THEN 'psnr' WHEN 2 THEN 'pixel_mse' ELSE 'velocity_mse' END AS metric,
         CASE WHEN NOT (l_suppkey % 6 = 5 AND l_partkey % 4 = 3) THEN l_quantity + l_discount END AS value,
         l_orderkey * 8 + l_linenumber AS ord FROM lineitem
), scores AS (SELECT * FROM all_scores WHERE value IS NOT NULL)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as a score; one condition has no value for one metric, as absent data arrives."""
    return derived.table(spark, sf_dir, "lineitem").selectExpr(
        "'codec' || l_suppkey % 6 AS codec",
        "CASE l_linenumber % 3 WHEN 0 THEN 'velocity_only' WHEN 1 THEN 'vo_split' ELSE 'vos' END AS strategy",
        "l_returnflag AS detector", "l_orderkey AS bar",
        "CASE l_partkey % 4 WHEN 0 THEN 'onset_f1' WHEN 1 THEN 'psnr' WHEN 2 THEN 'pixel_mse' ELSE 'velocity_mse' END AS metric",
        "CASE WHEN NOT (l_suppkey % 6 = 5 AND l_partkey % 4 = 3) THEN l_quantity + l_discount END AS value", "l_orderkey * 8 + l_linenumber AS ord",
    ).withColumn("condition", X.condition_label("codec", "strategy", "detector"))


METRIC_NAMES = ("onset_f1", "pixel_mse", "psnr", "velocity_mse")


@query(
    "condition_grid",
    f"""WITH {_SCORES}, c AS (SELECT DISTINCT codec FROM all_scores)
    SELECT codec, strategy, detector, codec || '__' || strategy || '__' || detector AS condition
    FROM c, (VALUES ('velocity_only'), ('vo_split'), ('vos')) s(strategy), (VALUES ('global_threshold'), ('hysteresis'), ('gmm')) d(detector)""",
)
def condition_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    codecs = scores(spark, sf_dir).select("codec").distinct()
    return X.condition_grid(codecs, ["velocity_only", "vo_split", "vos"], ["global_threshold", "hysteresis", "gmm"])


@query(
    "metric_summary",
    f"""WITH {_SCORES} SELECT codec || '__' || strategy || '__' || detector AS condition, codec || '/' || metric AS key,
    round(avg(value) + 1e-10, 6) AS value FROM scores GROUP BY ALL""",
)
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = X.summarise(scores(spark, sf_dir), ["condition", "codec"])
    return rounded(X.flatten_summary(summary))


@query(
    "last_codec_wins",
    f"""WITH {_SCORES}, m AS (SELECT strategy AS condition, codec, metric, avg(value) AS v FROM scores GROUP BY ALL)
    SELECT condition, metric, round(arg_max(v, codec) + 1e-10, 6) AS value FROM m GROUP BY 1, 2""",
)
def last_codec_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = X.summarise(scores(spark, sf_dir).withColumn("condition", F.col("strategy")), ["condition", "codec"])
    return rounded(X.last_codec_wins(summary, "codec"))


@query(
    "metric_pivot",
    f"""WITH {_SCORES}, m AS (SELECT codec AS condition, metric, avg(value) AS v FROM scores GROUP BY ALL)
    SELECT condition, {", ".join(f"round(max(CASE WHEN metric = '{m}' THEN v END) + 1e-10, 6) AS {m}" for m in METRIC_NAMES)},
           count(*) AS n_present FROM m GROUP BY 1""",
)
def metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One condition lacks one metric: NaN in the table, counted and shown as NULL here."""
    summary = X.summarise(scores(spark, sf_dir).withColumn("condition", F.col("codec")), ["condition"])
    wide = X.pivot_metrics(summary, METRIC_NAMES)
    present = sum((F.when(F.isnan(m), 0).otherwise(1) for m in METRIC_NAMES), F.lit(0))
    return wide.select(
        "condition", *[F.when(~F.isnan(m), stable(F.col(m))).alias(m) for m in METRIC_NAMES],
        present.cast("bigint").alias("n_present"),
    )


@query(
    "leaderboard",
    f"""WITH {_SCORES}, m AS (SELECT codec || '__' || strategy || '__' || detector AS condition, avg(value) AS v FROM scores WHERE metric = 'psnr' GROUP BY 1)
    SELECT condition, round(v + 1e-10, 6) AS value, CAST(row_number() OVER (ORDER BY v DESC, condition) AS INT) AS rank,
           row_number() OVER (ORDER BY v DESC, condition) = 1 AS is_best FROM m""",
)
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.leaderboard(X.summarise(scores(spark, sf_dir), ["condition"]), "psnr"))


_NORM = """b AS (SELECT metric, min(value) AS lo, max(value) AS hi FROM m GROUP BY 1)"""


@query(
    "normalised_heatmap",
    f"""WITH {_SCORES}, m AS (SELECT codec AS condition, metric, avg(value) AS value FROM scores GROUP BY ALL), {_NORM}
    SELECT condition, metric, round((value - lo) / (hi - lo) + 1e-10, 6) AS value FROM m JOIN b USING (metric)""",
)
def normalised_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = X.summarise(scores(spark, sf_dir).withColumn("condition", F.col("codec")), ["condition"])
    return rounded(X.normalise_metrics(summary).select("condition", "metric", "value"))


@query(
    "normalised_radar",
    f"""WITH {_SCORES}, raw AS (SELECT codec AS condition, metric, avg(value) AS value FROM scores GROUP BY ALL),
    m AS (SELECT condition, metric, coalesce(value, 0) AS value FROM (SELECT DISTINCT condition FROM raw) CROSS JOIN
          (VALUES ('onset_f1'), ('pixel_mse'), ('psnr'), ('velocity_mse'), ('unseen')) v(metric) LEFT JOIN raw USING (condition, metric)), {_NORM}
    SELECT condition, metric, CASE WHEN hi > lo THEN round((value - lo) / (hi - lo) + 1e-10, 6) ELSE 0.5::DOUBLE END AS value FROM m JOIN b USING (metric)""",
)
def normalised_radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absent metrics count as 0, a metric without spread maps to 0.5."""
    summary = X.summarise(scores(spark, sf_dir).withColumn("condition", F.col("codec")), ["condition"])
    full = X.complete_grid(summary, [*METRIC_NAMES, "unseen"])
    return rounded(X.normalise_metrics(full, "radar").select("condition", "metric", "value"))


@query(
    "missing_conditions",
    f"""WITH {_SCORES}, c AS (SELECT DISTINCT codec FROM all_scores),
    g AS (SELECT codec || '__' || s || '__' || d AS condition FROM c, (VALUES ('velocity_only'), ('vos'), ('other')) s(s), (VALUES ('A'), ('N'), ('X')) d(d)),
    a AS (SELECT DISTINCT codec || '__' || strategy || '__' || detector AS condition FROM all_scores)
    SELECT condition FROM g WHERE condition NOT IN (SELECT condition FROM a)""",
)
def missing_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir)
    grid = X.condition_grid(s.select("codec").distinct(), ["velocity_only", "vos", "other"], ["A", "N", "X"])
    return X.missing_conditions(grid.select("condition"), s)


@query(
    "example_bars",
    f"""WITH {_SCORES}, d AS (SELECT DISTINCT codec, bar FROM all_scores)
    SELECT codec, bar FROM d QUALIFY row_number() OVER (PARTITION BY codec ORDER BY bar) <= 4""",
)
def example_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First four bars of each codec."""
    from staffline.operators.numbering import first_k

    bars = scores(spark, sf_dir).groupBy("codec", "bar").agg(F.count(F.lit(1)).alias("n"))
    return first_k(bars.select("codec", "bar"), ["codec"], ["bar"], 4)


def _rank_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank summaries built from the scores: one row per order-key class, as if read from its file."""
    s = scores(spark, sf_dir)
    ranked = s.withColumn("rank", (F.col("bar") % 5).cast("int")).withColumn("condition", F.col("codec"))
    kept = X.summarise(ranked, ["rank", "condition"])
    per_condition = kept.groupBy("rank", "condition").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"), F.sum("n").alias("n")
    )
    return per_condition.groupBy("rank").agg(
        F.sort_array(F.collect_list("condition")).alias("conditions"),
        F.collect_list(F.substring("condition", 6, 1).cast("int")).alias("condition_indices"),
        (F.sum("n") * 0.01).alias("elapsed_seconds"),
        F.map_from_entries(F.collect_list(F.struct("condition", "m"))).alias("metrics_summary"),
        F.lit(None).cast("string").alias("_corrupt_record"),
    ).withColumn("path", F.concat(F.lit("sweep_summary_rank"), F.col("rank").cast("string"), F.lit(".json")))


_RANKS = f"""{_SCORES}, means AS (SELECT CAST(bar % 5 AS INT) AS rank, codec AS condition, metric, avg(value) AS value, count(*) AS n FROM scores GROUP BY ALL),
  kept AS (SELECT * FROM means)"""


@query(
    "merged_rank_metrics",
    f"""WITH {_RANKS}, w AS (SELECT condition, max(rank) AS rank FROM kept GROUP BY 1)
    SELECT condition, metric, round(value + 1e-10, 6) AS value FROM kept JOIN w USING (condition, rank)""",
)
def merged_rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.merge_rank_metrics(_rank_files(spark, sf_dir)))


@query(
    "merged_rank_totals",
    f"""WITH {_RANKS}, pc AS (SELECT rank, condition, sum(n) AS n FROM kept GROUP BY 1, 2)
    SELECT count(DISTINCT rank) AS num_ranks, round(CAST(sum(n) AS DOUBLE) * 0.01::DOUBLE, 2) AS total_elapsed_seconds, count(*) AS num_conditions,
           array_to_string(list_sort(list(CAST(substr(condition, 6, 1) AS INT))), ',') AS condition_indices FROM pc""",
)
def merged_rank_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.merge_rank_totals(_rank_files(spark, sf_dir))
    return t.withColumn("condition_indices", F.array_join(F.transform("condition_indices", lambda v: v.cast("string")), ","))


@query(
    "benchmark_diff",
    """WITH t AS (SELECT CASE l_linenumber % 5 WHEN 0 THEN 'ingest' WHEN 1 THEN 'render' WHEN 2 THEN 'detect' WHEN 3 THEN 'evaluate' ELSE 'encode' END AS stage,
                 l_returnflag AS run, CASE WHEN l_returnflag = 'A' AND l_linenumber % 5 = 4 THEN NULL ELSE l_quantity END AS seconds, l_extendedprice AS items FROM lineitem),
    r AS (SELECT stage, run, avg(seconds) AS mean_s, coalesce(stddev_samp(seconds), 0) AS std_s, avg(items) / avg(seconds) AS per_sec FROM t GROUP BY 1, 2),
    j AS (SELECT coalesce(b.stage, o.stage) AS stage, b.mean_s AS base_s, b.per_sec AS base_per_sec, o.mean_s AS opt_s, o.per_sec AS opt_per_sec, b.mean_s / o.mean_s AS speedup
          FROM (SELECT * FROM r WHERE run = 'A') b FULL JOIN (SELECT * FROM r WHERE run = 'R') o ON b.stage = o.stage)
    SELECT stage, round(base_s + 1e-10, 6) AS base_s, round(base_per_sec + 1e-10, 6) AS base_per_sec, round(opt_s + 1e-10, 6) AS opt_s,
           round(opt_per_sec + 1e-10, 6) AS opt_per_sec, round(speedup + 1e-10, 6) AS speedup,
           CASE stage WHEN 'ingest' THEN 'files/s' WHEN 'evaluate' THEN 'pairs/s' ELSE 'bars/s' END AS unit,
           coalesce(speedup = max(speedup) OVER (), false) AS is_best FROM j""",
)
def benchmark_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived.table(spark, sf_dir, "lineitem").selectExpr(
        "CASE l_linenumber % 5 WHEN 0 THEN 'ingest' WHEN 1 THEN 'render' WHEN 2 THEN 'detect' WHEN 3 THEN 'evaluate' ELSE 'encode' END AS stage",
        "l_returnflag AS run", "CASE WHEN l_returnflag = 'A' AND l_linenumber % 5 = 4 THEN NULL ELSE l_quantity END AS seconds", "l_extendedprice AS items",
    )
    r = X.repeats(t, ["stage", "run"])
    return rounded(X.compare_benchmarks(r.filter("run = 'A'"), r.filter("run = 'R'")))


@query(
    "job_records",
    """WITH l AS (SELECT user_id AS job_id, event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'failed' END AS status,
                  CAST(event_id AS DOUBLE) * 0.5::DOUBLE AS "at", CASE WHEN event_id % 4 = 3 THEN event_type ELSE '' END AS error FROM events),
    j AS (SELECT job_id, arg_max(status, seq) AS status, min("at") FILTER (WHERE status = 'running') AS started,
                 max("at") FILTER (WHERE status IN ('completed', 'failed')) AS ended, arg_max(error, seq) AS error FROM l GROUP BY 1)
    SELECT *, ended - started AS elapsed FROM j""",
)
def job_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = derived.table(spark, sf_dir, "events").selectExpr(
        "user_id AS job_id", "event_id AS seq",
        "CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'failed' END AS status",
        "CAST(event_id AS DOUBLE) * CAST(0.5 AS DOUBLE) AS at", "CASE WHEN event_id % 4 = 3 THEN event_type ELSE '' END AS error",
    )
    return X.latest_jobs(log)


# --- the whole job and streams ---------------------------------------------------------------


@query("whole_experiment")
def whole_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes to cells, valid bars, pooling codec, detection, metrics, means per instrument."""
    out = job.run(derived.notes(spark, sf_dir))
    return rounded(out, digits=5)


def _work_folder(spark: SparkSession) -> str:
    return f"{numbering.shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query(
    "stream_running_means",
    """SELECT event_type AS metric, round(avg(value) + 1e-10, 6) AS value, count(*) AS n FROM events GROUP BY 1""",
)
def stream_running_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows arriving as files; the running mean after the last file."""
    folder = _work_folder(spark)
    raw = streams.read_files(spark, sf_dir, "event_type STRING, value DOUBLE", pattern="events.parquet")
    means = streams.running_means(raw.withColumnRenamed("event_type", "metric"), ["metric"])
    streams.run_available(means, streams.batch_folder_sink(f"{folder}/out"), f"{folder}/state", mode="complete")
    return rounded(streams.latest(spark, f"{folder}/out"))


@query(
    "stream_transitions",
    """WITH e AS (SELECT event_type, user_id % 12 AS pc, lead(user_id % 12) OVER (PARTITION BY event_type ORDER BY event_id) AS next_pc FROM events)
    SELECT event_type AS sequence_id, CAST(pc AS INT) AS pc, CAST(next_pc AS INT) AS next_pc, count(*) AS n FROM e WHERE next_pc IS NOT NULL GROUP BY ALL""",
)
def stream_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive classes per sequence from files that arrive out of order: late bars take back moves and add others."""
    folder = _work_folder(spark)
    bars = derived.table(spark, sf_dir, "events").selectExpr("event_type AS sequence_id", "event_id AS bar_index", "CAST(user_id % 12 AS INT) AS pc")
    late = F.pmod(F.xxhash64("bar_index"), F.lit(3))
    for i in range(3):  # three files, each with every third bar or so of all sequences
        bars.where(late == i).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    raw = streams.read_files(spark, f"{folder}/in", "sequence_id STRING, bar_index BIGINT, pc INT", max_files=1)
    streams.run_available(raw, streams.transition_sink(f"{folder}/moves"), f"{folder}/state")
    return streams.transitions(spark, f"{folder}/moves")


@query(
    "stream_bounded_ingest",
    with_tables("""SELECT song_id, track_idx, count(*) AS n_cells FROM cells GROUP BY ALL"""),
)
def stream_bounded_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded file batches through ingest: pieces land once per batch, overlaps are resolved over all."""
    folder = _work_folder(spark)
    schema = derived.table(spark, sf_dir, "lineitem").schema.simpleString()[len("struct<"):-1].replace(":", " ")
    raw = streams.read_files(spark, sf_dir, schema.replace(",", ", "), pattern="lineitem.parquet")
    sink = streams.pieces_sink(f"{folder}/pieces", derived.notes_of)
    streams.run_available(raw, sink, f"{folder}/state")
    segments = streams.landed_segments(spark, f"{folder}/pieces", whole=True)
    return segments.groupBy("song_id", "track_idx").agg(F.sum(F.col("off") - F.col("on")).alias("n_cells"))
