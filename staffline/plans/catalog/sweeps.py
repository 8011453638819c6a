"""The whole sweep as one query: notes to a table of conditions and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.plans import derived, sweep
from staffline.plans.catalog import query, rounded
from staffline.plans.derived import with_tables

METRICS = (
    "note_density_pearson", "velocity_mse", "velocity_correlation", "pitch_class_histogram_correlation", "conditioning_pitch_alignment",
    "onset_precision", "onset_recall", "onset_f1",
)


def ripple(pixels: DataFrame) -> DataFrame:
    """A codec that dims every pixel by its place, in all channels alike."""
    dim = lambda col: 0.7 + 0.3 * ((F.col("row") * 7 + col * 13) % 10) / 9
    return pixels.withColumn("levels", F.transform("levels", lambda v, i: v * dim(F.col("col") + i)))


CODECS = {"plain": lambda pixels: pixels, "ripple": ripple}
STRATEGIES = ("velocity_only", "vo_split")


def _pearson(x: str, y: str) -> str:
    return f"CASE WHEN stddev_pop({x}) < 1e-8 OR stddev_pop({y}) < 1e-8 THEN 0.0::DOUBLE ELSE covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


_KEY = "condition, song_id, track_idx, bar_index"


@query(
    "sweep_summary",
    with_tables(f"""
    WITH RECURSIVE conds AS (SELECT concat(codec, '__', strategy, '__', name) AS condition, * FROM (VALUES ('plain'), ('ripple')) c(codec), (VALUES ('velocity_only'), ('vo_split')) s(strategy),
              (VALUES ('half', 0.5::DOUBLE, 0.5::DOUBLE, 0.0::DOUBLE, 1), ('two', 0.5, 0.25, 0, 2), ('aware', 0.4, 0.4, 2, 1)) d(name, upper, lower, boost, shortest)),
    lit AS (SELECT *, velocity / 127.0::DOUBLE AS v, CASE WHEN is_onset THEN 1.0::DOUBLE ELSE 0.0 END AS o,
                   0.7::DOUBLE + 0.3::DOUBLE * ((pitch*7 + step*13) % 10) / 9.0::DOUBLE AS f FROM onset_cells),
    px AS (SELECT condition, song_id, track_idx, bar_index, pitch, step, upper, lower, boost, shortest,
                  v * CASE WHEN codec = 'ripple' THEN f ELSE 1 END AS value,
                  CASE WHEN strategy = 'vo_split' THEN o * CASE WHEN codec = 'ripple' THEN f ELSE 1 END END AS onset FROM lit, conds),
    sc AS (SELECT *, CASE WHEN boost > 0 AND onset IS NOT NULL THEN (value + boost * onset) / (1 + boost) ELSE value END AS score FROM px),
    isl AS (SELECT *, step - row_number() OVER (PARTITION BY {_KEY}, pitch ORDER BY step) AS island FROM sc WHERE score >= lower),
    beg AS (SELECT *, min(CASE WHEN score >= upper THEN step END) OVER (PARTITION BY {_KEY}, pitch, island) AS first FROM isl),
    runs AS (SELECT {_KEY}, pitch, min(step) AS onset, max(step) + 1 AS offs, avg(value) AS mean, any_value(shortest) AS shortest FROM beg WHERE step >= first GROUP BY {_KEY}, pitch, island),
    found AS (SELECT {_KEY}, pitch, onset, offs, greatest(1, least(127, round_even(round(mean * 127, 9), 0))) AS velocity FROM runs WHERE offs - onset >= shortest),
    pb AS (SELECT DISTINCT {_KEY} FROM found),
    grid AS (SELECT * FROM pb, range(96) r(step)),
    tp AS (SELECT song_id, track_idx, bar_index, step, count(*) AS tn, avg(velocity) AS tv FROM cells GROUP BY ALL),
    pp AS (SELECT {_KEY}, step, count(*) AS pn, avg(velocity) AS pv FROM (SELECT *, unnest(range(onset, offs)) AS step FROM found) GROUP BY ALL),
    g AS (SELECT {_KEY}, coalesce(tn, 0) AS tn, coalesce(pn, 0) AS pn, coalesce(tv, 0) AS tv, coalesce(pv, 0) AS pv
          FROM grid LEFT JOIN tp USING (song_id, track_idx, bar_index, step) LEFT JOIN pp USING ({_KEY}, step)),
    prof AS (SELECT condition, {_pearson('tn', 'pn')} AS a, avg((tv - pv) * (tv - pv)) AS b, {_pearson('tv', 'pv')} AS c FROM g GROUP BY {_KEY}),
    tc AS (SELECT song_id, track_idx, bar_index, pitch % 12 AS pc, count(*) AS t FROM cells GROUP BY ALL),
    pc AS (SELECT {_KEY}, pitch % 12 AS pc, count(*) AS p FROM found GROUP BY ALL),
    raw AS (SELECT condition, song_id, track_idx, bar_index, pc, coalesce(t, 0) AS t, coalesce(p, 0) AS p
            FROM (SELECT DISTINCT song_id, track_idx, bar_index FROM cells) b CROSS JOIN (SELECT condition FROM conds) CROSS JOIN range(12) r(pc)
            LEFT JOIN tc USING (song_id, track_idx, bar_index, pc) LEFT JOIN pc USING ({_KEY}, pc)),
    h AS (SELECT {_KEY}, t / sum(t) OVER w AS t, CASE WHEN sum(p) OVER w = 0 THEN 0 ELSE p / sum(p) OVER w END AS p FROM raw WINDOW w AS (PARTITION BY {_KEY})),
    cls AS (SELECT condition, CASE WHEN sum(p) > 0 THEN {_pearson('t', 'p')} END AS r, CASE WHEN sum(p) > 0 THEN sum(t*p) / sqrt(sum(t*t) * sum(p*p)) ELSE 0 END AS c FROM h GROUP BY {_KEY}),
    ton AS (SELECT song_id, track_idx, bar_index, list_sort(list(DISTINCT step)) AS t FROM onset_cells WHERE is_onset GROUP BY ALL),
    pon AS (SELECT {_KEY}, list_sort(list(DISTINCT onset)) AS p FROM found GROUP BY ALL),
    walk(condition, song_id, track_idx, bar_index, free, p, nt, np, hits) AS (
      SELECT {_KEY}, t, p, len(t), len(p), 0 FROM ton JOIN pon USING (song_id, track_idx, bar_index)
      UNION ALL
      SELECT {_KEY}, CASE WHEN g IS NULL THEN free ELSE list_filter(free, lambda x: x <> g) END, p[2:], nt, np, hits + CASE WHEN g IS NULL THEN 0 ELSE 1 END
      FROM (SELECT *, CASE WHEN list_contains(free, p[1]) THEN p[1] WHEN list_contains(free, p[1] - 1) THEN p[1] - 1 WHEN list_contains(free, p[1] + 1) THEN p[1] + 1 END AS g
            FROM walk WHERE len(p) > 0)),
    ons AS (SELECT condition, hits / np AS a, hits / nt AS b, CASE WHEN hits = 0 THEN 0 ELSE 2.0 * hits / (nt + np) END AS c FROM walk WHERE len(p) = 0),
    m1 AS (SELECT condition, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM prof GROUP BY 1), m2 AS (SELECT condition, avg(r) AS r, avg(c) AS c FROM cls GROUP BY 1),
    m3 AS (SELECT condition, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM ons GROUP BY 1)
    SELECT condition, round(m1.a + 1e-10, 6) AS note_density_pearson, round(m1.b + 1e-10, 6) AS velocity_mse, round(m1.c + 1e-10, 6) AS velocity_correlation,
           round(m2.r + 1e-10, 6) AS pitch_class_histogram_correlation, round(m2.c + 1e-10, 6) AS conditioning_pitch_alignment,
           round(m3.a + 1e-10, 6) AS onset_precision, round(m3.b + 1e-10, 6) AS onset_recall, round(m3.c + 1e-10, 6) AS onset_f1
    FROM conds LEFT JOIN m1 USING (condition) LEFT JOIN m2 USING (condition) LEFT JOIN m3 USING (condition)"""),
)
def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two codecs, two strategies, three detectors: every bar under all twelve conditions in one job."""
    grid = sweep.conditions(spark, list(CODECS), STRATEGIES, {
        "half": sweep.detector("global", threshold=0.5), "two": sweep.detector("hysteresis", tau_on=0.5, tau_off=0.25, min_duration=2),
        "aware": sweep.detector("velocity_aware", threshold=0.4, onset_boost=2.0),
    })
    true = derived.segments(spark, sf_dir)
    means = sweep.sweep(true, CODECS, grid)
    return rounded(sweep.summary_table(means, METRICS), ["condition"])
