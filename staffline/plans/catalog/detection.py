"""Detector queries over the derived reconstruction plane; a checksum row per bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.keys import BAR
from staffline.operators import detect
from staffline.operators.ingest import with_masks
from staffline.plans import derived
from staffline.plans.catalog import ORACLES, query, rounded, stable
from staffline.plans.derived import with_tables


def digest(notes: DataFrame) -> DataFrame:
    check = F.sum(F.col("pitch") * (F.col("onset") + 1) + F.col("offset") * F.col("velocity"))
    return notes.groupBy(*BAR).agg(F.count(F.lit(1)).alias("n_notes"), check.cast("bigint").alias("checksum"))


def _digest_sql(ctes: str, source: str = "notes_out") -> str:
    return with_tables(f"""{ctes}
    SELECT song_id, track_idx, bar_index, count(*) AS n_notes,
           CAST(sum(pitch * (onset + 1) + "offset" * velocity) AS BIGINT) AS checksum
    FROM {source} GROUP BY ALL""")


def _runs_sql(active: str, name: str = "notes_out", low: str = "") -> str:
    """Runs of the rows of ``active`` as notes."""
    return f"""
    isl AS (SELECT *, step - row_number() OVER (PARTITION BY song_id, track_idx, bar_index, "row" ORDER BY step) AS g FROM {active}),
    {name} AS (SELECT song_id, track_idx, bar_index, "row" AS pitch, min(step) AS onset, max(step) + 1 AS "offset",
                      CAST(greatest(1, least(127, round_even(round(avg(value) * 127, 9), 0))) AS INT) AS velocity
               FROM isl GROUP BY song_id, track_idx, bar_index, "row", g)"""


@query("detect_global", _digest_sql(f"""WITH act AS (SELECT * FROM recon_plane WHERE value >= 0.5), {_runs_sql('act')}"""))
def detect_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(detect.global_threshold(derived.recon_strips(spark, sf_dir)))


@query(
    "detect_global_long_notes",
    _digest_sql(f"""WITH act AS (SELECT * FROM recon_plane WHERE value >= 0.35), {_runs_sql('act', 'all_notes')}""",
                """(SELECT * FROM all_notes WHERE "offset" - onset >= 4)"""),
)
def detect_global_long_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(detect.global_threshold(derived.recon_strips(spark, sf_dir), 0.35, min_duration=4))


_HYST = f"""WITH low AS (SELECT *, step - row_number() OVER (PARTITION BY song_id, track_idx, bar_index, "row" ORDER BY step) AS isl
                    FROM recon_plane WHERE value >= 0.3),
    st AS (SELECT *, min(step) FILTER (WHERE value >= 0.6) OVER (PARTITION BY song_id, track_idx, bar_index, "row", isl) AS first FROM low),
    act AS (SELECT song_id, track_idx, bar_index, "row", step, value FROM st WHERE step >= first), {_runs_sql('act')}"""


@query("detect_hysteresis", _digest_sql(_HYST))
def detect_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(detect.hysteresis(derived.recon_strips(spark, sf_dir)))


@query(
    "detect_per_pitch",
    _digest_sql(f"""WITH nb AS (SELECT count(DISTINCT (song_id, track_idx, bar_index)) * 96 AS n FROM recon_plane),
    thr AS (SELECT r AS "row", greatest(0, least(1, coalesce(s, 0) / n + sqrt(greatest(0, coalesce(q, 0) / n - (coalesce(s, 0) / n) * (coalesce(s, 0) / n))))) AS tau
            FROM range(128) g(r) CROSS JOIN nb LEFT JOIN (SELECT "row", sum(value) AS s, sum(value*value) AS q FROM recon_plane GROUP BY 1) z ON z."row" = r),
    act AS (SELECT p.* FROM recon_plane p JOIN thr USING ("row") WHERE tau > 0 AND value >= tau), {_runs_sql('act', 'found')},
    notes_out AS (SELECT * FROM found UNION ALL
      SELECT song_id, track_idx, bar_index, thr."row", 0, 96, 1 FROM (SELECT DISTINCT song_id, track_idx, bar_index FROM recon_plane) b CROSS JOIN thr WHERE tau <= 0)"""),
)
def detect_per_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on all bars, then detect; rows that never sound get a zero threshold and pass it."""
    plane, strips = derived.recon_plane(spark, sf_dir), derived.recon_strips(spark, sf_dir)
    return digest(detect.by_row_threshold(strips, detect.fit_adaptive(plane, bars=strips)))


_ONSET_PLANE = """ro AS (SELECT *, coalesce(step - lag(step) OVER (PARTITION BY song_id, track_idx, bar_index, "row" ORDER BY step), 0) <> 1 AS is_onset
                FROM recon_plane)"""


@query(
    "detect_velocity_aware",
    _digest_sql(f"""WITH {_ONSET_PLANE},
    act AS (SELECT song_id, track_idx, bar_index, "row", step, value FROM ro
            WHERE (value + 2.0 * CASE WHEN is_onset THEN value ELSE 0 END) / 3.0 >= 0.25), {_runs_sql('act')}"""),
)
def detect_velocity_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    plane = derived.recon_plane(spark, sf_dir)
    onset = with_masks(plane.withColumnRenamed("row", "pitch")).filter("is_onset").withColumnRenamed("pitch", "row")
    return digest(detect.velocity_aware(plane, onset, threshold=0.25))


def _morph_sql(erosion: int, dilation: int) -> str:
    """Set-based erosion and dilation, step by step rather than on runs."""
    el, eh = erosion // 2, erosion - 1 - erosion // 2
    dl, dh = dilation // 2, dilation - 1 - dilation // 2
    return f"""WITH bin AS (SELECT song_id, track_idx, bar_index, "row", step FROM recon_plane WHERE value >= 0.5),
    ero AS (SELECT song_id, track_idx, bar_index, "row", t AS step FROM (
              SELECT song_id, track_idx, bar_index, "row", unnest(range(step - {eh}, step + {el} + 1)) AS t FROM bin)
            WHERE t BETWEEN 0 AND 95 GROUP BY ALL HAVING count(*) = {erosion}),
    dila AS (SELECT DISTINCT song_id, track_idx, bar_index, "row", t AS step FROM (
              SELECT song_id, track_idx, bar_index, "row", unnest(range(step - {dl}, step + {dh} + 1)) AS t FROM ero)
            WHERE t BETWEEN 0 AND 95),
    act AS (SELECT d.*, coalesce(p.value, 0) AS value FROM dila d LEFT JOIN recon_plane p USING (song_id, track_idx, bar_index, "row", step)),
    {_runs_sql('act')}"""


@query("detect_morphological", _digest_sql(_morph_sql(2, 2)))
def detect_morphological(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(detect.morphological(derived.recon_strips(spark, sf_dir)))


@query("detect_morphological_closing", _digest_sql(_morph_sql(2, 5)))
def detect_morphological_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(detect.morphological(derived.recon_strips(spark, sf_dir), erosion=2, dilation=5))


@query("detect_mixture")
def detect_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EM over every row of all bars; no SQL twin for the iteration."""
    plane = derived.recon_plane(spark, sf_dir)
    thresholds = detect.fit_mixture(plane, bars=plane).thresholds()
    return digest(detect.by_row_threshold(plane, thresholds))


# Viterbi with the default parameters; the survivor paths of both states are kept as bit strings.
_HMM = f"""WITH RECURSIVE act_rows AS (SELECT song_id, track_idx, bar_index, "row", map_from_entries(list((step, value))) AS m FROM recon_plane GROUP BY ALL),
    v(song_id, track_idx, bar_index, "row", m, t, f, n, pf, pn) AS (
      SELECT song_id, track_idx, bar_index, "row", m, 0,
             ln(0.7::DOUBLE) - 0.5 * pow((coalesce(m[0], 0) - 0.15::DOUBLE) / 0.1::DOUBLE, 2), ln(0.3::DOUBLE) - 0.5 * pow((coalesce(m[0], 0) - 0.75::DOUBLE) / 0.1::DOUBLE, 2),
             0::HUGEINT, 1::HUGEINT FROM act_rows
      UNION ALL
      SELECT song_id, track_idx, bar_index, "row", m, t + 1,
             greatest(f + ln(0.9::DOUBLE), n + ln(0.2::DOUBLE)) - 0.5 * pow((coalesce(m[t + 1], 0) - 0.15::DOUBLE) / 0.1::DOUBLE, 2),
             greatest(f + ln(0.1::DOUBLE), n + ln(0.8::DOUBLE)) - 0.5 * pow((coalesce(m[t + 1], 0) - 0.75::DOUBLE) / 0.1::DOUBLE, 2),
             CASE WHEN n + ln(0.2::DOUBLE) > f + ln(0.9::DOUBLE) THEN pn ELSE pf END * 2,
             CASE WHEN n + ln(0.8::DOUBLE) > f + ln(0.1::DOUBLE) THEN pn ELSE pf END * 2 + 1
      FROM v WHERE t < 95),
    fin AS (SELECT song_id, track_idx, bar_index, "row", m, CASE WHEN n > f THEN pn ELSE pf END AS p FROM v WHERE t = 95),
    act AS (SELECT song_id, track_idx, bar_index, "row", CAST(s AS INT) AS step, coalesce(m[CAST(s AS INT)], 0) AS value FROM fin, range(96) r(s)
            WHERE ((p >> CAST(95 - s AS INT)) & 1::HUGEINT) = 1), {_runs_sql('act')}"""


@query("detect_hmm", _digest_sql(_HMM))
def detect_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Viterbi with default parameters."""
    return digest(detect.hmm_tracker(derived.recon_plane(spark, sf_dir)))


@query(
    "hmm_fit",
    with_tables("""
    WITH c AS (SELECT song_id, track_idx, bar_index, pitch AS "row", step FROM cells),
    j AS (SELECT song_id, track_idx, bar_index, "row", step, sum(v) AS v, max(t) AS t FROM (
            SELECT song_id, track_idx, bar_index, "row", step, value AS v, 0 AS t FROM recon_plane
            UNION ALL SELECT song_id, track_idx, bar_index, "row", step, 0, 1 FROM c) GROUP BY ALL),
    nb AS (SELECT count(DISTINCT (song_id, track_idx, bar_index)) AS n FROM j),
    e AS (SELECT avg(v) FILTER (WHERE t = 1) AS mu_on, stddev_pop(v) FILTER (WHERE t = 1) AS sd_on,
                 sum(v) FILTER (WHERE t = 0) AS s0, sum(v*v) FILTER (WHERE t = 0) AS q0, count(*) FILTER (WHERE t = 1) AS n1 FROM j),
    nx AS (SELECT step, lead(step) OVER (PARTITION BY song_id, track_idx, bar_index, "row" ORDER BY step) AS nxt,
                  lag(step) OVER (PARTITION BY song_id, track_idx, bar_index, "row" ORDER BY step) AS prv FROM c),
    tr AS (SELECT count(*) FILTER (WHERE nxt = step + 1) AS stay, count(*) FILTER (WHERE step < 95 AND (nxt IS NULL OR nxt > step + 1)) AS on_off,
                  count(*) FILTER (WHERE step > 0 AND (prv IS NULL OR prv < step - 1)) AS off_on FROM nx),
    f AS (SELECT *, n * 128 * 96 - n1 AS n0, n * 128 * 95 - stay - on_off - off_on AS off_stay FROM e, tr, nb)
    SELECT round(mu_on + 1e-10, 6) AS mu_on, round(greatest(sd_on, 0.05) + 1e-10, 6) AS sigma_on, round(s0 / n0 + 1e-10, 6) AS mu_off,
           round(greatest(sqrt(q0 / n0 - (s0/n0)*(s0/n0)), 0.05) + 1e-10, 6) AS sigma_off,
           round((off_on + 1e-6) / (off_stay + off_on + 2e-6) + 1e-10, 6) AS p_onset,
           round((on_off + 1e-6) / (stay + on_off + 2e-6) + 1e-10, 6) AS p_offset FROM f"""),
)
def hmm_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = detect.fit_hmm(derived.recon_strips(spark, sf_dir), derived.segments(spark, sf_dir))
    names = ("mu_on", "sigma_on", "mu_off", "sigma_off", "p_onset", "p_offset")
    return spark.range(1).select(*[stable(F.lit(getattr(p, n))).alias(n) for n in names])


@query(
    "fit_with_silent_bars",
    with_tables("""WITH nb AS (SELECT count(DISTINCT (song_id, track_idx, bar_index)) * 96 AS n FROM recon_plane),
    loud AS (SELECT "row", CASE WHEN (song_id + bar_index) % 2 = 0 THEN value ELSE 0 END AS value FROM recon_plane)
    SELECT CAST(r AS INT) AS "row", round(greatest(0, least(1, coalesce(s, 0) / n + sqrt(greatest(0, coalesce(q, 0) / n - (coalesce(s, 0) / n) * (coalesce(s, 0) / n))))) + 1e-10, 6) + 0.0 AS threshold
    FROM range(128) g(r) CROSS JOIN nb LEFT JOIN (SELECT "row", sum(value) AS s, sum(value*value) AS q FROM loud GROUP BY 1) z ON z."row" = r"""),
)
def fit_with_silent_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second bar is silent: its pixels count as zeros."""
    plane = derived.recon_plane(spark, sf_dir)
    found = detect.fit_adaptive(plane.withColumn("value", F.expr("CASE WHEN (song_id + bar_index) % 2 = 0 THEN value ELSE 0 END")), bars=plane.select(*BAR))
    rows = F.posexplode(F.array(*[F.lit(float(t)) for t in found])).alias("row", "threshold")
    return rounded(spark.range(1).select(rows))


@query("detect_along_width", ORACLES["detect_global"])
def detect_along_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes with pitches along columns give the same notes once they are turned."""
    turned = derived.recon_plane(spark, sf_dir).withColumns({"row": F.col("step"), "step": F.col("row")})
    return digest(detect.global_threshold(detect.upright(turned, "width")))
