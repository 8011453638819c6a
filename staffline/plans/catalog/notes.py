"""Note-metric queries: one row per bar or sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.keys import BAR, TRACK
from staffline.operators import note_metrics as M
from staffline.plans import derived
from staffline.plans.catalog import query, rounded, stable
from staffline.plans.derived import with_tables


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return derived.segments(spark, sf_dir), M.compact_notes(derived.rec_notes(spark, sf_dir))


BOTH = """
both_bars AS (SELECT DISTINCT song_id, track_idx, bar_index FROM cells
              INTERSECT SELECT DISTINCT song_id, track_idx, bar_index FROM rec_notes),
grid AS (SELECT * FROM both_bars, range(96) r(step))"""


def _pearson(n: str, x: str, y: str) -> str:
    """SQL text of a guarded Pearson r over groups that hold all ``n`` positions."""
    return (
        f"CASE WHEN stddev_pop({x}) < 1e-8 OR stddev_pop({y}) < 1e-8 THEN 0.0::DOUBLE "
        f"ELSE round(covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) + 1e-10, 6) + 0.0 END"
    )


@query(
    "step_profiles",
    with_tables(f"""
    WITH {BOTH},
    t AS (SELECT song_id, track_idx, bar_index, step, count(*) AS tn, avg(velocity) AS tv FROM cells GROUP BY ALL),
    p AS (SELECT song_id, track_idx, bar_index, step, count(*) AS pn, avg(velocity) AS pv FROM (
            SELECT *, unnest(range(greatest(0, onset), least(96, "offset"))) AS step FROM rec_notes) GROUP BY ALL),
    g AS (SELECT song_id, track_idx, bar_index, coalesce(tn, 0) AS tn, coalesce(pn, 0) AS pn,
                 coalesce(tv, 0) AS tv, coalesce(pv, 0) AS pv
          FROM grid LEFT JOIN t USING (song_id, track_idx, bar_index, step)
                    LEFT JOIN p USING (song_id, track_idx, bar_index, step))
    SELECT song_id, track_idx, bar_index, {_pearson('96', 'tn', 'pn')} AS note_density_pearson,
           round(avg((tv - pv) * (tv - pv)) + 1e-10, 6) AS velocity_mse, {_pearson('96', 'tv', 'pv')} AS velocity_correlation
    FROM g GROUP BY 1, 2, 3"""),
)
def step_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.step_profiles(*sides(spark, sf_dir)), BAR)


@query(
    "pitch_class_scores",
    with_tables(f"""
    WITH allbars AS (SELECT DISTINCT song_id, track_idx, bar_index FROM cells),
    t AS (SELECT song_id, track_idx, bar_index, pitch % 12 AS pc, count(*) AS t FROM cells GROUP BY ALL),
    p AS (SELECT song_id, track_idx, bar_index, pitch % 12 AS pc, count(*) AS p FROM rec_notes GROUP BY ALL),
    raw AS (SELECT song_id, track_idx, bar_index, pc, coalesce(t, 0) AS t, coalesce(p, 0) AS p
          FROM allbars CROSS JOIN range(12) r(pc) LEFT JOIN t USING (song_id, track_idx, bar_index, pc)
          LEFT JOIN p USING (song_id, track_idx, bar_index, pc)),
    h AS (SELECT *, t / sum(t) OVER w AS th, CASE WHEN sum(p) OVER w = 0 THEN 0 ELSE p / sum(p) OVER w END AS ph,
                 CASE WHEN sum(p) OVER w = 0 THEN 1/12.0::DOUBLE ELSE p / sum(p) OVER w END AS pu
          FROM raw WINDOW w AS (PARTITION BY song_id, track_idx, bar_index)),
    e AS (SELECT *, greatest(th, 1e-12) / sum(greatest(th, 1e-12)) OVER w AS te,
                    greatest(pu, 1e-12) / sum(greatest(pu, 1e-12)) OVER w AS pe
          FROM h WINDOW w AS (PARTITION BY song_id, track_idx, bar_index))
    SELECT song_id, track_idx, bar_index,
           CASE WHEN sum(p) = 0 THEN NULL ELSE {_pearson('12', 'th', 'ph')} END AS pitch_class_histogram_correlation,
           CASE WHEN sum(p) = 0 THEN 0.0 ELSE round(sum(th*ph) / (sqrt(sum(th*th)) * sqrt(sum(ph*ph))) + 1e-10, 6) END
             AS conditioning_pitch_alignment,
           round(-sum(te*ln(te)) + 1e-10, 6) + 0.0 AS seq_coherence_gt_entropy,
           round(-sum(pe*ln(pe)) + 1e-10, 6) + 0.0 AS seq_coherence_gen_entropy,
           round(-sum(te*ln(te)) + sum(pe*ln(pe)) + 1e-10, 6) + 0.0 AS seq_coherence_entropy_diff
    FROM e GROUP BY 1, 2, 3"""),
)
def pitch_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.pitch_class_scores(*sides(spark, sf_dir)), BAR)


@query(
    "interval_scores",
    with_tables(f"""
    WITH {BOTH},
    ps AS (SELECT DISTINCT song_id, track_idx, bar_index, pitch, step FROM (
             SELECT *, unnest(range(onset, "offset")) AS step FROM rec_notes)),
    t AS (SELECT a.song_id, a.track_idx, a.bar_index, least(b.pitch - a.pitch, 24) AS d, count(*) AS t
          FROM cells a JOIN cells b ON a.song_id = b.song_id AND a.track_idx = b.track_idx
               AND a.bar_index = b.bar_index AND a.step = b.step AND a.pitch < b.pitch GROUP BY ALL),
    p AS (SELECT a.song_id, a.track_idx, a.bar_index, least(b.pitch - a.pitch, 24) AS d, count(*) AS p
          FROM ps a JOIN ps b ON a.song_id = b.song_id AND a.track_idx = b.track_idx
               AND a.bar_index = b.bar_index AND a.step = b.step AND a.pitch < b.pitch GROUP BY ALL),
    raw AS (SELECT song_id, track_idx, bar_index, coalesce(t, 0) AS t, coalesce(p, 0) AS p
            FROM both_bars CROSS JOIN range(25) r(d) LEFT JOIN t USING (song_id, track_idx, bar_index, d)
            LEFT JOIN p USING (song_id, track_idx, bar_index, d)),
    h AS (SELECT *, t / greatest(1, sum(t) OVER w) AS th, p / greatest(1, sum(p) OVER w) AS ph
          FROM raw WINDOW w AS (PARTITION BY song_id, track_idx, bar_index))
    SELECT song_id, track_idx, bar_index, {_pearson('25', 'th', 'ph')} AS interval_histogram_correlation
    FROM h GROUP BY 1, 2, 3"""),
)
def interval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.interval_scores(*sides(spark, sf_dir)), BAR)


@query(
    "velocity_histogram_kl",
    with_tables(f"""
    WITH {BOTH},
    t AS (SELECT song_id, track_idx, bar_index, velocity // 4 AS b, count(*) AS t FROM cells GROUP BY ALL),
    p AS (SELECT song_id, track_idx, bar_index, velocity // 4 AS b, count(*) AS p FROM rec_notes GROUP BY ALL),
    raw AS (SELECT song_id, track_idx, bar_index, coalesce(t, 0) AS t, coalesce(p, 0) AS p
            FROM both_bars CROSS JOIN range(32) r(b) LEFT JOIN t USING (song_id, track_idx, bar_index, b)
            LEFT JOIN p USING (song_id, track_idx, bar_index, b)),
    h AS (SELECT song_id, track_idx, bar_index, greatest(t / sum(t) OVER w, 1e-10) AS tc, greatest(p / sum(p) OVER w, 1e-10) AS pc
          FROM raw WINDOW w AS (PARTITION BY song_id, track_idx, bar_index)),
    s AS (SELECT song_id, track_idx, bar_index, tc / sum(tc) OVER w AS ts, pc / sum(pc) OVER w AS ps
          FROM h WINDOW w AS (PARTITION BY song_id, track_idx, bar_index))
    SELECT song_id, track_idx, bar_index, round(sum(ts * ln(ts / ps)) + 1e-10, 6) + 0.0 AS velocity_histogram_kl
    FROM s GROUP BY 1, 2, 3"""),
)
def velocity_histogram_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.velocity_histogram_kl(*sides(spark, sf_dir)), BAR)


_ONSETS = """
ton AS (SELECT song_id, track_idx, bar_index, list_sort(list(DISTINCT step)) AS t
        FROM onset_cells WHERE is_onset GROUP BY ALL),
pon AS (SELECT song_id, track_idx, bar_index, list_sort(list(DISTINCT onset)) AS p FROM rec_notes GROUP BY ALL),
ons AS (SELECT * FROM ton JOIN pon USING (song_id, track_idx, bar_index))"""


@query(
    "onset_scores",
    with_tables(f"""
    WITH RECURSIVE {_ONSETS},
    walk(song_id, track_idx, bar_index, free, p, n, hits) AS (
      SELECT song_id, track_idx, bar_index, t, p, len(t), 0 FROM ons
      UNION ALL
      SELECT song_id, track_idx, bar_index,
             CASE WHEN g IS NULL THEN free ELSE list_filter(free, lambda x: x <> g) END, p[2:], n,
             hits + CASE WHEN g IS NULL THEN 0 ELSE 1 END
      FROM (SELECT *, CASE WHEN list_contains(free, p[1]) THEN p[1] WHEN list_contains(free, p[1] - 1) THEN p[1] - 1
                           WHEN list_contains(free, p[1] + 1) THEN p[1] + 1 END AS g
            FROM walk WHERE len(p) > 0)),
    done AS (SELECT w.song_id, w.track_idx, w.bar_index, hits, n AS nt, len(o.p) AS np
             FROM walk w JOIN ons o USING (song_id, track_idx, bar_index) WHERE len(w.p) = 0)
    SELECT song_id, track_idx, bar_index, round(hits / np + 1e-10, 6) AS onset_precision, round(hits / nt + 1e-10, 6) AS onset_recall,
           CASE WHEN hits = 0 THEN 0.0 ELSE round(2.0 * hits / (nt + np) + 1e-10, 6) END AS onset_f1 FROM done"""),
)
def onset_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.bar_scores(*sides(spark, sf_dir), ["onsets"]).where("onset_f1 IS NOT NULL"), BAR)


@query(
    "ioi_kl",
    with_tables(f"""
    WITH {_ONSETS},
    gaps AS (SELECT song_id, track_idx, bar_index, list_transform(range(1, len(t)), lambda i: t[i+1] - t[i]) AS tg,
                    list_transform(range(1, len(p)), lambda i: p[i+1] - p[i]) AS pg FROM ons),
    top AS (SELECT *, list_max(list_concat(tg, pg)) AS m FROM gaps),
    bins AS (SELECT song_id, track_idx, bar_index, b,
                    len(list_filter(tg, lambda x: (x-1)*32 // m = b)) AS t, len(list_filter(pg, lambda x: (x-1)*32 // m = b)) AS p
             FROM top CROSS JOIN range(32) r(b)),
    h AS (SELECT *, greatest(CASE WHEN sum(t) OVER w = 0 THEN 0 ELSE t / sum(t) OVER w END, 1e-10) AS tc,
                    greatest(CASE WHEN sum(p) OVER w = 0 THEN 0 ELSE p / sum(p) OVER w END, 1e-10) AS pc
          FROM bins WINDOW w AS (PARTITION BY song_id, track_idx, bar_index)),
    s AS (SELECT *, tc / sum(tc) OVER w AS ts, pc / sum(pc) OVER w AS ps FROM h
          WINDOW w AS (PARTITION BY song_id, track_idx, bar_index)),
    kl AS (SELECT song_id, track_idx, bar_index, sum(t) AS nt, sum(p) AS np, sum(ts * ln(ts/ps)) AS v FROM s GROUP BY 1, 2, 3)
    SELECT song_id, track_idx, bar_index,
           CASE WHEN nt = 0 THEN 'no true gaps' WHEN np = 0 THEN 'infinite' ELSE 'finite' END AS status,
           CASE WHEN nt = 0 THEN 0.0 WHEN np = 0 THEN NULL ELSE round(v + 1e-10, 6) + 0.0 END AS ioi_distribution_kl
    FROM kl"""),
)
def ioi_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = M.bar_scores(*sides(spark, sf_dir), ["ioi", "counts"]).where("true_onsets IS NOT NULL")
    v = F.col("ioi_distribution_kl")
    infinite = v == float("inf")
    return scored.select(
        *BAR,
        F.when(F.col("true_onsets") < 2, "no true gaps").when(infinite, "infinite").otherwise("finite").alias("status"),
        F.when(~infinite, stable(v)).alias("ioi_distribution_kl"),
    )


@query(
    "groove_scores",
    with_tables(f"""
    WITH {_ONSETS},
    acf AS (SELECT song_id, track_idx, bar_index, k,
                   list_sum(list_transform(range(0, 96 - k), lambda i:
                     ((CASE WHEN list_contains(t, i) THEN 1 ELSE 0 END) - len(t)/96)
                     * ((CASE WHEN list_contains(t, i + k) THEN 1 ELSE 0 END) - len(t)/96))) / (len(t) * (1 - len(t)/96)) AS a,
                   list_sum(list_transform(range(0, 96 - k), lambda i:
                     ((CASE WHEN list_contains(p, i) THEN 1 ELSE 0 END) - len(p)/96)
                     * ((CASE WHEN list_contains(p, i + k) THEN 1 ELSE 0 END) - len(p)/96))) / (len(p) * (1 - len(p)/96)) AS b
            FROM ons CROSS JOIN range(1, 48) r(k))
    SELECT song_id, track_idx, bar_index, {_pearson('47', 'a', 'b')} AS groove_consistency FROM acf GROUP BY 1, 2, 3"""),
)
def groove_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.bar_scores(*sides(spark, sf_dir), ["groove"]).where("groove_consistency IS NOT NULL"), BAR)


@query(
    "dominant_pitch_class",
    with_tables("""
    WITH t AS (SELECT song_id, track_idx, bar_index, pitch % 12 AS pc, count(*) AS n FROM cells GROUP BY ALL),
    p AS (SELECT song_id, track_idx, bar_index, pitch % 12 AS pc, count(*) AS n FROM rec_notes GROUP BY ALL),
    tm AS (SELECT song_id, track_idx, bar_index, arg_min(pc, -n*16 + pc) AS tpc FROM t GROUP BY ALL),
    pm AS (SELECT song_id, track_idx, bar_index, arg_min(pc, -n*16 + pc) AS ppc FROM p GROUP BY ALL)
    SELECT song_id, track_idx, bar_index, CAST(coalesce(ppc, tpc) AS INT) AS pc
    FROM tm LEFT JOIN pm USING (song_id, track_idx, bar_index)"""),
)
def dominant_pitch_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.dominant_pitch_class(*sides(spark, sf_dir))


@query(
    "transition_entropy",
    with_tables("""
    WITH t AS (SELECT song_id, track_idx, bar_index, pitch % 12 AS pc, count(*) AS n FROM cells GROUP BY ALL),
    p AS (SELECT song_id, track_idx, bar_index, pitch % 12 AS pc, count(*) AS n FROM rec_notes GROUP BY ALL),
    tm AS (SELECT song_id, track_idx, bar_index, arg_min(pc, -n*16 + pc) AS tpc FROM t GROUP BY ALL),
    pm AS (SELECT song_id, track_idx, bar_index, arg_min(pc, -n*16 + pc) AS ppc FROM p GROUP BY ALL),
    d AS (SELECT song_id, track_idx, bar_index, coalesce(ppc, tpc) AS pc FROM tm LEFT JOIN pm USING (song_id, track_idx, bar_index)),
    l AS (SELECT song_id, track_idx, pc, lead(pc) OVER (PARTITION BY song_id, track_idx ORDER BY bar_index) AS npc FROM d),
    c AS (SELECT song_id, track_idx, pc, npc, count(*) AS n FROM l WHERE npc IS NOT NULL GROUP BY ALL),
    pr AS (SELECT *, n / sum(n) OVER (PARTITION BY song_id, track_idx) AS q FROM c)
    SELECT song_id, track_idx, round(-sum(q * ln(q)) + 1e-10, 6) + 0.0 AS transition_entropy,
           CAST(sum(n) AS BIGINT) AS transition_entropy_n_transitions FROM pr GROUP BY ALL"""),
)
def transition_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.transition_entropy(M.dominant_pitch_class(*sides(spark, sf_dir))), TRACK)


@query(
    "sequence_groove",
    with_tables(f"""
    WITH {_ONSETS.replace('JOIN pon', 'LEFT JOIN pon')},
    v AS (SELECT song_id, track_idx, bar_index, coalesce(p, t) AS o FROM ons)
    SELECT a.song_id, a.track_idx,
           round(avg(len(list_intersect(a.o, b.o)) / sqrt(len(a.o) * len(b.o))) + 1e-10, 6) AS seq_groove_consistency,
           CAST((1 + sqrt(1 + 8 * count(*))) / 2 AS BIGINT) AS seq_groove_consistency_n_bars
    FROM v a JOIN v b ON a.song_id = b.song_id AND a.track_idx = b.track_idx AND a.bar_index < b.bar_index
    GROUP BY 1, 2"""),
)
def sequence_groove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.sequence_groove(M.onset_arrays(*sides(spark, sf_dir), how="left")), TRACK)


@query(
    "pitch_class_kl",
    with_tables("""
    WITH t AS (SELECT song_id, track_idx, bar_index, pitch % 12 AS pc, count(*) AS n FROM cells GROUP BY ALL),
    p AS (SELECT r.song_id, r.track_idx, r.bar_index, pitch % 12 AS pc, count(*) AS n FROM rec_notes r
          WHERE (song_id, track_idx, bar_index) IN (SELECT song_id, track_idx, bar_index FROM cells) GROUP BY ALL),
    tn AS (SELECT song_id, track_idx, pc, n / sum(n) OVER (PARTITION BY song_id, track_idx, bar_index) AS v FROM t),
    pn AS (SELECT song_id, track_idx, pc, n / sum(n) OVER (PARTITION BY song_id, track_idx, bar_index) AS v FROM p),
    g AS (SELECT * FROM (SELECT DISTINCT song_id, track_idx FROM cells) CROSS JOIN range(12) r(pc)),
    h AS (SELECT song_id, track_idx, pc, coalesce((SELECT sum(v) FROM tn WHERE tn.song_id = g.song_id AND tn.track_idx = g.track_idx AND tn.pc = g.pc), 0) AS t,
                 coalesce((SELECT sum(v) FROM pn WHERE pn.song_id = g.song_id AND pn.track_idx = g.track_idx AND pn.pc = g.pc), 0) AS p FROM g),
    n AS (SELECT song_id, track_idx, greatest(t / sum(t) OVER w, 1e-10) AS t, greatest(p / sum(p) OVER w, 1e-10) AS p
          FROM h WINDOW w AS (PARTITION BY song_id, track_idx)),
    s AS (SELECT song_id, track_idx, t / sum(t) OVER w AS t, p / sum(p) OVER w AS p FROM n
          WINDOW w AS (PARTITION BY song_id, track_idx))
    SELECT song_id, track_idx, round(greatest(0, sum(t * ln(t / p))) + 1e-10, 6) + 0.0 AS pitch_class_histogram_kl FROM s GROUP BY 1, 2"""),
)
def pitch_class_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.pitch_class_kl(*sides(spark, sf_dir)), TRACK)
