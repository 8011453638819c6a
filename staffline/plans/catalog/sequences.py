"""Sequence-preparation queries over the embedding table and the derived bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.operators import sequences as S
from staffline.operators.numbering import split_fraction
from staffline.plans import derived
from staffline.plans.catalog import query, rounded, stable
from staffline.plans.catalog.vectors import latents
from staffline.plans.derived import with_tables

# A song of 37 vectors is longer than a window and leaves a tail.
_SONG = 37


def _songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latents(spark, sf_dir).select(
        F.floor(F.col("vec_id") / _SONG).alias("song_id"), (F.col("vec_id") % _SONG).alias("bar_index"), "z"
    )


_SONGS = f"songs AS (SELECT vec_id // {_SONG} AS song_id, vec_id % {_SONG} AS bar_index, list_transform(embedding, lambda x: x::DOUBLE) AS z FROM embeddings)"


@query(
    "sequence_windows",
    f"""WITH {_SONGS}, s AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY bar_index) - 1 AS pos, count(*) OVER (PARTITION BY song_id) AS t FROM songs),
    w AS (SELECT song_id, pos // 16 AS win, any_value(t) AS t, count(*) AS n, sum(z[1] * (pos % 16 + 1)) AS chk FROM s GROUP BY 1, 2)
    SELECT song_id, win AS "window", n, round(chk + 1e-10, 6) + 0.0 AS checksum, CAST(16 AS INT) AS padded FROM w
    WHERE t >= 2 AND (n = 16 OR t <= 16)""",
)
def sequence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    win = S.pad_windows(S.windows(_songs(spark, sf_dir), ["song_id"], "bar_index"), 16, 64)
    check = F.aggregate(
        F.transform("vectors", lambda v, i: v[0] * (i + 1)), F.lit(0.0), lambda a, x: a + x
    )
    return win.select("song_id", "window", "n", stable(check).alias("checksum"), F.size("vectors").alias("padded"))


@query(
    "teacher_pairs",
    f"""WITH {_SONGS}, l AS (SELECT song_id, z, lead(z) OVER (PARTITION BY song_id ORDER BY bar_index) AS t FROM songs)
    SELECT round(avg(list_sum(list_transform(range(1, 65), lambda i: (z[i] - t[i]) * (z[i] - t[i]))) / 64) + 1e-10, 6) AS mse,
           count(*) AS n FROM l WHERE t IS NOT NULL""",
)
def teacher_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persistence baseline: predict each vector by its predecessor."""
    return rounded(S.prediction_mse(S.teacher_pairs(_songs(spark, sf_dir), ["song_id"], "bar_index")))


@query(
    "train_val_split",
    """WITH r AS (SELECT vec_id, label, row_number() OVER (ORDER BY md5(concat('42:', vec_id)), vec_id) AS rn, count(*) OVER () AS n FROM embeddings)
    SELECT vec_id, CASE WHEN rn <= greatest(1, floor(n * 0.1::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM r""",
)
def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_fraction(latents(spark, sf_dir).select("vec_id"), 0.1, ["vec_id"])


@query(
    "condition_features",
    """WITH f AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'drums' WHEN 'O' THEN 'strings' ELSE 'kazoo' END AS instrument,
                  CAST(o_orderkey % 300 AS DOUBLE) AS tempo, 2 + o_orderkey % 7 AS num, CASE WHEN o_orderkey % 2 = 0 THEN 4 ELSE 8 END AS den FROM orders)
    SELECT CAST(CASE instrument WHEN 'drums' THEN 0 WHEN 'strings' THEN 4 ELSE 5 END AS INT) AS instrument_index,
           CAST(CASE (num, den) WHEN (2,4) THEN 0 WHEN (3,4) THEN 1 WHEN (4,4) THEN 2 WHEN (6,8) THEN 3 WHEN (3,8) THEN 4 WHEN (5,4) THEN 5 WHEN (7,8) THEN 6 ELSE 0 END AS INT) AS slot,
           count(*) AS n, round(sum(least(1.0::DOUBLE, tempo / 240)) + 1e-10, 6) AS tempo_sum FROM f GROUP BY 1, 2""",
)
def condition_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs = derived.table(spark, sf_dir, "orders").selectExpr(
        "CASE o_orderstatus WHEN 'F' THEN 'drums' WHEN 'O' THEN 'strings' ELSE 'kazoo' END AS instrument",
        "CAST(o_orderkey % 300 AS DOUBLE) AS tempo", "2 + o_orderkey % 7 AS num",
        "CASE WHEN o_orderkey % 2 = 0 THEN 4 ELSE 8 END AS den",
    )
    f = songs.select(*S.condition_features(F.col("instrument"), F.col("tempo"), F.col("num"), F.col("den")))
    slot = (F.array_position("signature", F.lit(1.0)) - 1).cast("int")
    return f.groupBy("instrument_index", slot.alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), stable(F.sum("tempo_share")).alias("tempo_sum")
    )


@query(
    "song_of_bar_id",
    with_tables("""
    SELECT concat('a_', song_id % 17) AS song, count(*) AS n FROM notes GROUP BY 1"""),
)
def song_of_bar_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The song of a display id whose song part itself holds an underscore."""
    shown = F.format_string("a_%d_%s_%04d", F.col("song_id") % 17, F.col("instrument"), F.col("bar_index"))
    return (
        derived.notes(spark, sf_dir).groupBy(S.song_of(shown).alias("song")).agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "causal_running_mean",
    """SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id) + 1e-10, 4) AS running_mean FROM events""",
)
def causal_running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that see only the past: blocks of 256 events to exercise the offsets."""
    e = derived.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    out = S.causal_mean(e, ["event_type"], "event_id", "value")
    return out.select("event_id", stable(F.col("running_mean"), 4).alias("running_mean"))
