"""Experiment tables: condition grid, summaries, merges, rankings, benchmark diffs.

Metric rows are long: (condition..., metric, value). An absent metric has no row, NaN
and infinity are values; a mean skips the absent, is poisoned by NaN and follows infinity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAN = float("nan")


def condition_label(*parts: str) -> Column:
    return F.concat_ws("__", *parts)


def condition_grid(codecs: DataFrame, strategies: Sequence[str], detectors: Sequence[str]) -> DataFrame:
    """Every codec with every channel strategy (or render variant) and detector, labelled."""
    fixed = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    grid = codecs.select("codec", fixed(strategies).alias("strategy")).select(
        "codec", "strategy", fixed(detectors).alias("detector")
    )
    return grid.withColumn("condition", condition_label("codec", "strategy", "detector"))


def to_long(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str] | None = None) -> DataFrame:
    """(keys, metric, value) from a column per metric; NULL means absent."""
    names = list(metrics) if metrics is not None else [c for c in wide.columns if c not in keys]
    doubles = wide.select(*keys, *[F.col(n).cast("double").alias(n) for n in names])
    return doubles.unpivot(list(keys), names, "metric", "value").filter(F.col("value").isNotNull())


def summarise(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, metric, value, n): mean of each metric over the rows that have it; NULL is absent, NaN is a value."""
    return metrics.filter(F.col("value").isNotNull()).groupBy(*by, "metric").agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def flatten_summary(summary: DataFrame) -> DataFrame:
    """(condition, key, value) with key ``codec/metric``."""
    return summary.select("condition", F.concat_ws("/", "codec", "metric").alias("key"), "value")


def last_codec_wins(summary: DataFrame, order: str) -> DataFrame:
    """(condition, metric, value): one value per metric, of the codec with the highest order."""
    return summary.groupBy("condition", "metric").agg(F.max_by("value", order).alias("value"))


def pivot_metrics(summary: DataFrame, metrics: Sequence[str], key: str = "condition") -> DataFrame:
    """Condition x metric table; a missing metric is NaN. The metric list avoids an extra job."""
    wide = summary.groupBy(key).pivot("metric", list(metrics)).agg(F.first("value"))
    return wide.select(key, *[F.coalesce(F.col(f"`{m}`"), F.lit(NAN)).alias(m) for m in metrics])


def leaderboard(summary: DataFrame, metric: str, descending: bool = True) -> DataFrame:
    """(condition, value, rank, is_best), best first.

    NaN ranks last in both directions; an ascending reference ranking would put it first.
    """
    rows = summary.filter(F.col("metric") == metric).select("condition", "value")
    known = F.when(~F.isnan("value"), F.col("value"))
    order = known.desc_nulls_last() if descending else known.asc_nulls_last()
    # One row per condition: the grid is small next to the data behind it.
    w = Window.partitionBy(F.lit(metric)).orderBy(order, "condition")
    ranked = rows.withColumn("rank", F.row_number().over(w))
    return ranked.withColumn("is_best", (F.col("rank") == 1) & known.isNotNull())


def normalise_metrics(summary: DataFrame, mode: str = "heatmap") -> DataFrame:
    """Min-max per metric. ``heatmap`` leaves constant metrics raw and NaN alone;
    ``radar`` maps constant metrics to 0.5."""
    if mode not in ("heatmap", "radar"):
        raise ValueError("mode is heatmap or radar")
    known = F.when(~F.isnan("value"), F.col("value"))
    bounds = summary.groupBy("metric").agg(F.min(known).alias("lo"), F.max(known).alias("hi"))
    scaled = F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo"))
    flat = F.col("value") if mode == "heatmap" else F.lit(0.5)
    value = F.when(F.col("hi") > F.col("lo"), scaled).otherwise(flat)
    return summary.join(bounds, "metric").withColumn("value", value).drop("lo", "hi")


def complete_grid(summary: DataFrame, metrics: Sequence[str], missing: float = 0.0) -> DataFrame:
    """Every condition with every metric; absent ones get ``missing`` (the radar rule)."""
    names = F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric")
    return (
        summary.select("condition").distinct().select("condition", names)
        .join(summary.select("condition", "metric", "value"), ["condition", "metric"], "left")
        .withColumn("value", F.coalesce("value", F.lit(missing)))
    )


def merge_rank_metrics(ranks: DataFrame, order: str = "path") -> DataFrame:
    """(condition, metric, value): the file latest in order wins a condition as a whole."""
    entries = ranks.filter("_corrupt_record IS NULL").select(
        F.col(order).alias("_o"), F.explode("metrics_summary").alias("condition", "m")
    )
    winner = entries.groupBy("condition").agg(F.max_by(F.to_json("m"), "_o").alias("j"))
    kept = winner.select("condition", F.from_json("j", "MAP<STRING, DOUBLE>").alias("m"))
    return kept.select("condition", F.explode("m").alias("metric", "value"))


def merge_rank_totals(ranks: DataFrame) -> DataFrame:
    """One row: readable files, conditions, sorted indices and summed elapsed time."""
    good = ranks.filter("_corrupt_record IS NULL")
    none = F.array().cast("array<int>")
    return good.agg(
        F.count(F.lit(1)).alias("num_ranks"),
        F.round(F.sum(F.coalesce("elapsed_seconds", F.lit(0.0))), 2).alias("total_elapsed_seconds"),
        F.sum(F.size(F.coalesce("conditions", F.array().cast("array<string>")))).alias("num_conditions"),
        # As many entries as there are conditions in the grid.
        F.sort_array(F.flatten(F.collect_list(F.coalesce("condition_indices", none)))).alias("condition_indices"),
    )


def throughput_unit(stage: Column) -> Column:
    return F.when(stage == "ingest", "files/s").when(stage == "evaluate", "pairs/s").otherwise("bars/s")


def repeats(timings: DataFrame, by: Sequence[str] = ("stage",)) -> DataFrame:
    """(by, mean_s, std_s, per_sec) from (seconds, items) per repeat; one repeat has std 0."""
    return timings.groupBy(*by).agg(
        F.avg("seconds").alias("mean_s"),
        F.coalesce(F.stddev_samp("seconds"), F.lit(0.0)).alias("std_s"),
        F.try_divide(F.avg("items"), F.avg("seconds")).alias("per_sec"),
    )


def compare_benchmarks(baseline: DataFrame, optimised: DataFrame) -> DataFrame:
    """Stages of both runs side by side with the ratio of means; the best stage is flagged.

    A stage missing on one side, or with a non-positive mean, has no ratio.
    """
    b = baseline.select("stage", F.col("mean_s").alias("base_s"), F.col("per_sec").alias("base_per_sec"))
    o = optimised.select("stage", F.col("mean_s").alias("opt_s"), F.col("per_sec").alias("opt_per_sec"))
    both = b.join(o, "stage", "full_outer")
    ratio = F.when((F.col("base_s") > 0) & (F.col("opt_s") > 0), F.try_divide("base_s", "opt_s"))
    both = both.withColumn("speedup", ratio).withColumn("unit", throughput_unit(F.col("stage")))
    best = F.max_by("stage", "speedup").over(Window.partitionBy(F.lit(0)))  # a row per stage
    return both.withColumn("is_best", F.coalesce((F.col("stage") == best) & F.col("speedup").isNotNull(), F.lit(False)))


def latest_jobs(log: DataFrame) -> DataFrame:
    """(job_id, status, started, ended, elapsed, error) from an append-only run log.

    ``log`` has (job_id, seq, status, at, error); a job starts at its first 'running'
    row and ends at its last 'completed' or 'failed' one.
    """
    ended = F.col("status").isin("completed", "failed")
    jobs = log.groupBy("job_id").agg(
        F.max_by("status", "seq").alias("status"),
        F.min(F.when(F.col("status") == "running", F.col("at"))).alias("started"),
        F.max(F.when(ended, F.col("at"))).alias("ended"),
        F.max_by("error", "seq").alias("error"),
    )
    return jobs.withColumn("elapsed", F.when(F.col("started").isNotNull() & F.col("ended").isNotNull(), F.col("ended") - F.col("started")))


def missing_conditions(grid: DataFrame, arrived: DataFrame) -> DataFrame:
    """Expected conditions without a result."""
    return grid.join(arrived.select("condition").distinct(), "condition", "left_anti")
