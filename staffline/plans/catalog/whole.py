"""Evaluation of whole groups of metrics, those of sequences and tables included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.keys import BAR, STEPS
from staffline.operators import note_metrics, render
from staffline.operators.layout import by_bar
from staffline.operators.numbering import durable
from staffline.plans import derived
from staffline.plans.catalog import ORACLES, query, stable
from staffline.plans.derived import with_tables
from staffline.plans.evaluate import METRICS, Tables, evaluate, register_metric, register_sums, register_whole

CHANNELS, AREA = 4, 16


def tables(spark: SparkSession, sf_dir: str, once: Sequence[str] = ()) -> Tables:
    """Bars with notes and planes; the latent of a bar is the embedding that its key picks.

    Frames in ``once`` (true, pred, plane, latents) are written down, since several metrics read them: of the plane its segments, of the latents
    only which vector a bar has.
    """
    held = lambda name, frame: durable(frame) if name in once else frame
    true = held("true", derived.segments(spark, sf_dir))
    z = derived.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("z"), F.col("label").cast("string").alias("condition_label")
    )
    n = z.count()
    at = F.pmod(F.col("song_id") * 40 + F.col("track_idx") * 8 + F.col("bar_index"), F.lit(n))
    latents = held("latents", by_bar(true.select(*BAR).distinct().withColumn("vec_id", at))).join(z, "vec_id").drop("vec_id")
    pred = held("pred", note_metrics.compact_notes(derived.rec_notes(spark, sf_dir)))
    return Tables(
        true, pred, derived.plane_of(held("plane", derived.rec_segments(spark, sf_dir))), latents=latents, latent_shape=(CHANNELS, 4, 4), steps=STEPS,
    )


_LATENTS = """
bars AS (SELECT DISTINCT song_id, track_idx, bar_index FROM cells),
lat AS (SELECT b.*, list_transform(embedding, lambda x: x::DOUBLE) AS z FROM bars b
        JOIN embeddings e ON e.vec_id = (song_id * 40 + track_idx * 8 + bar_index) % (SELECT count(*) FROM embeddings))"""

_PAIRS = """
d AS (SELECT a.song_id, a.track_idx, a.bar_index, b.track_idx AS other, list_distance(a.z, b.z) AS d FROM lat a JOIN lat b
      ON (a.song_id, a.track_idx, a.bar_index) <> (b.song_id, b.track_idx, b.bar_index)),
m AS (SELECT song_id, track_idx, bar_index, other, sum(d) AS t, count(*) AS n FROM d GROUP BY ALL)"""
_SHARES = """
tt AS (SELECT song_id, track_idx, bar_index, pitch % 12 AS pc, count(*) AS t FROM cells GROUP BY ALL),
nn AS (SELECT song_id, track_idx, bar_index, pitch % 12 AS pc, count(*) AS n FROM rec_notes GROUP BY ALL),
ss AS (SELECT song_id, track_idx, bar_index, "row" % 12 AS pc, sum(value) AS s FROM recon_plane GROUP BY ALL),
raw AS (SELECT b.song_id, b.track_idx, b.bar_index, r.pc, coalesce(t, 0) AS t, coalesce(n, 0) AS n, coalesce(s, 0) AS s
        FROM bars b CROSS JOIN range(12) r(pc) LEFT JOIN tt USING (song_id, track_idx, bar_index, pc)
        LEFT JOIN nn USING (song_id, track_idx, bar_index, pc) LEFT JOIN ss USING (song_id, track_idx, bar_index, pc)),
sh AS (SELECT song_id, track_idx, bar_index, pc, t / sum(t) OVER w AS t,
              CASE WHEN sum(n) OVER w > 0 THEN n / sum(n) OVER w WHEN sum(s) OVER w > 0 THEN s / sum(s) OVER w ELSE 0 END AS p
       FROM raw WINDOW w AS (PARTITION BY song_id, track_idx, bar_index))"""


def _rows(scope: int, source: str, **columns: str) -> str:
    """Twin of long rows: the metrics of ``source`` under the part of the bar key that ``scope`` names."""
    keys = ", ".join(k if i < scope else f"NULL AS {k}" for i, k in enumerate(BAR))
    return " UNION ALL ".join(
        f"SELECT {keys}, '{name}' AS metric, round(CAST({value} AS DOUBLE) + 1e-10, 6) + 0.0 AS value FROM ({source})" for name, value in columns.items()
    )


def _of(name: str, scope: int, *columns: str) -> str:
    """Long rows of a registered query's twin."""
    return _rows(scope, f"SELECT * FROM ({ORACLES[name]}) WHERE {' OR '.join(f'{c} IS NOT NULL' for c in columns)}", **{c: c for c in columns})


def _group(spark: SparkSession, sf_dir: str, name: str, once: Sequence[str]) -> DataFrame:
    """Long rows of one group; the accuracy of a probe depends on the optimiser, so only its range is compared."""
    value = F.when(F.col("metric").rlike("accuracy|fidelity"), F.col("value").between(0, 1).cast("double")).otherwise(stable(F.col("value")))
    return evaluate(tables(spark, sf_dir, once), [name]).withColumn("value", value)


_PROBED = {"linear_probe_pitch_accuracy": "1", "linear_probe_instrument_accuracy": "1"}


@query(
    "metrics_latent_space",
    with_tables(f"""
    WITH {_LATENTS}, {_PAIRS},
    ch AS (SELECT song_id, track_idx, bar_index, c, i, z[c*16+i] AS v FROM lat, range(4) r(c), range(1, 17) p(i)),
    va AS (SELECT song_id, track_idx, bar_index, c, var_samp(v) AS x FROM ch GROUP BY ALL),
    co AS (SELECT a.song_id, a.track_idx, a.bar_index, abs(corr(a.v, b.v)) AS x FROM ch a JOIN ch b ON a.song_id = b.song_id AND a.track_idx = b.track_idx
           AND a.bar_index = b.bar_index AND a.i = b.i AND a.c < b.c GROUP BY ALL, a.c, b.c),
    ab AS (SELECT song_id, track_idx, bar_index, max(CASE WHEN track_idx = other THEN t / n END) AS a, min(CASE WHEN track_idx <> other THEN t / n END) AS b FROM m GROUP BY ALL)
    {_rows(3, "SELECT song_id, track_idx, bar_index, avg(x) AS a, min(x) AS b, max(x) AS c FROM va GROUP BY 1, 2, 3",
           latent_variance_mean="a", latent_variance_min="b", latent_variance_max="c")}
    UNION ALL {_rows(3, "SELECT song_id, track_idx, bar_index, avg(x) AS a, max(x) AS c FROM co GROUP BY 1, 2, 3",
                     latent_channel_correlation_mean="a", latent_channel_correlation_max="c")}
    UNION ALL {_rows(0, "SELECT avg((b - a) / greatest(a, b)) AS s FROM ab", silhouette_score="s")}
    UNION ALL {_rows(0, "SELECT 1", **_PROBED)}""").replace("GROUP BY ALL, a.c, b.c", "GROUP BY a.song_id, a.track_idx, a.bar_index, a.c, b.c"),
)
def metrics_latent_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group(spark, sf_dir, "latent_space", ["true", "latents"])


@query(
    "metrics_conditioning",
    with_tables(f"""
    WITH {_LATENTS}, {_PAIRS}, {_SHARES},
    l AS (SELECT song_id, track_idx, z, lead(z) OVER w AS z1, lead(z, 2) OVER w AS z2 FROM lat WINDOW w AS (PARTITION BY song_id, track_idx ORDER BY bar_index)),
    st AS (SELECT song_id, track_idx, list_distance(z, z1) AS s1, sqrt(list_sum(list_transform(range(1, 65), lambda i: (z2[i] - 2*z1[i] + z[i]) * (z2[i] - 2*z1[i] + z[i])))) AS s2 FROM l),
    x AS (SELECT sum(CASE WHEN track_idx = other THEN t END) / sum(CASE WHEN track_idx = other THEN n END) AS intra,
                 sum(CASE WHEN track_idx <> other THEN t END) / sum(CASE WHEN track_idx <> other THEN n END) AS inter FROM m)
    {_rows(2, "SELECT song_id, track_idx, coalesce(avg(s2), 'nan'::DOUBLE) AS a, coalesce(avg(s1), 'nan'::DOUBLE) AS b, count(*) AS n FROM st GROUP BY 1, 2",
           interpolation_smoothness="a", interpolation_step_size="b", interpolation_n_steps="n")}
    UNION ALL {_rows(3, "SELECT song_id, track_idx, bar_index, CASE WHEN sum(p*p) < 1e-20 THEN 0 ELSE sum(t*p) / sqrt(sum(t*t) * sum(p*p)) END AS v FROM sh GROUP BY 1, 2, 3",
                     conditioning_pitch_alignment="v")}
    UNION ALL {_rows(0, "SELECT * FROM x", disentanglement_score="(inter - intra) / inter", intra_class_distance="intra", inter_class_distance="inter")}
    UNION ALL {_rows(0, "SELECT 1", conditioning_fidelity="1", conditioning_attribute_accuracy="1")}"""),
)
def metrics_conditioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group(spark, sf_dir, "conditioning", ["true", "latents"])


@query(
    "metrics_generative",
    with_tables(f"""
    WITH {_LATENTS}, {_SHARES},
    pr AS (SELECT a.song_id, a.track_idx, list_cosine_similarity(a.z, b.z) AS s FROM lat a JOIN lat b ON a.song_id = b.song_id AND a.track_idx = b.track_idx AND a.bar_index < b.bar_index),
    cnt AS (SELECT song_id, track_idx, count(*) AS n FROM lat GROUP BY ALL),
    sim AS (SELECT cnt.song_id, cnt.track_idx, coalesce(avg(s), 'nan'::DOUBLE) AS a, coalesce(stddev_pop(s), 'nan'::DOUBLE) AS b, any_value(n) AS n
            FROM cnt LEFT JOIN pr ON pr.song_id = cnt.song_id AND pr.track_idx = cnt.track_idx GROUP BY 1, 2),
    hs AS (SELECT song_id, track_idx, pc, sum(t) AS t, sum(p) AS p FROM sh GROUP BY ALL),
    hn AS (SELECT song_id, track_idx, greatest(t / sum(t) OVER w, 1e-10) AS t, greatest(p / sum(p) OVER w, 1e-10) AS p FROM hs WINDOW w AS (PARTITION BY song_id, track_idx)),
    hk AS (SELECT song_id, track_idx, t / sum(t) OVER w AS t, p / sum(p) OVER w AS p FROM hn WINDOW w AS (PARTITION BY song_id, track_idx))
    {_rows(2, "SELECT * FROM sim", self_similarity_mean="a", self_similarity_std="b", self_similarity_n_bars="n")}
    UNION ALL {_rows(2, "SELECT song_id, track_idx, greatest(0, sum(t * ln(t / p))) AS v FROM hk GROUP BY 1, 2", pitch_class_histogram_kl="v")}
    UNION ALL {_of("transition_entropy", 2, "transition_entropy", "transition_entropy_n_transitions")}
    UNION ALL {_of("sequence_groove", 2, "seq_groove_consistency", "seq_groove_consistency_n_bars")}
    UNION ALL {_of("bar_nll", 3, "bar_level_nll")}
    UNION ALL {_of("pitch_class_scores", 3, "seq_coherence_gt_entropy", "seq_coherence_gen_entropy", "seq_coherence_entropy_diff")}"""),
)
def metrics_generative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group(spark, sf_dir, "generative", ["true", "pred", "plane", "latents"])


def _extremes(t: Tables) -> DataFrame:
    return t.true.groupBy(*BAR).agg(F.min("pitch").cast("double").alias("lowest"), F.max("pitch").cast("double").alias("highest"), F.sum(F.col("off") - F.col("on")).alias("cells"))


@query(
    "own_metrics",
    with_tables(f"""
    WITH b AS (SELECT song_id, track_idx, bar_index, min(pitch) AS lo, max(pitch) AS hi, count(*) AS n FROM cells GROUP BY 1, 2, 3)
    {_rows(3, "SELECT * FROM b", lowest="lo", highest="hi")}
    UNION ALL {_rows(2, "SELECT song_id, track_idx, max(hi) - min(lo) AS s, sum(n) / count(*) AS m FROM b GROUP BY 1, 2", compass="s", mean_cells="m")}
    UNION ALL {_rows(0, "SELECT max(hi) - min(lo) AS s FROM b", whole_compass="s")}"""),
)
def own_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's metrics: per bar, per sequence from merged states, and one job over the table."""
    state = lambda: {"lo": F.min("lowest"), "hi": F.max("highest"), "n": F.sum("cells"), "bars": F.count(F.lit(1))}
    register_metric("own/extremes", _extremes, ["lowest", "highest"])
    register_sums("own/compass", _extremes, state, lambda: {"compass": F.col("hi") - F.col("lo"), "mean_cells": F.col("n") / F.col("bars")})
    register_whole("own/whole", lambda t: _extremes(t).agg((F.max("highest") - F.min("lowest")).alias("whole_compass")), ["whole_compass"])
    names = ("own/extremes", "own/compass", "own/whole")
    try:
        return evaluate(Tables(derived.segments(spark, sf_dir)), names).withColumn("value", stable(F.col("value")))
    finally:
        for name in names:
            METRICS.pop(name)
