"""Song sequences for sequence models: windows, padding, teacher-forcing pairs, features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffline.functions import vectors as V
from staffline.keys import INSTRUMENTS
from staffline.operators.numbering import running, sequence_next, sequence_position

MAX_TEMPO = 240.0
# The signatures of the one-hot feature, in order.
SIGNATURES = ((2, 4), (3, 4), (4, 4), (6, 8), (3, 8), (5, 4), (7, 8))


def song_of(bar_id: Column) -> Column:
    """Song part of a display id: all but the last two ``_`` tokens."""
    tokens = F.split(bar_id, "_")
    return F.array_join(F.slice(tokens, 1, F.greatest(F.size(tokens) - 2, F.lit(1))), "_")


def windows(
    df: DataFrame, by: Sequence[str], order: str, z: str = "z", length: int = 16, min_length: int = 2
) -> DataFrame:
    """(by, window, vectors, n): non-overlapping windows of each song.

    Songs under ``min_length`` are dropped, songs up to ``length`` stay whole, longer
    ones give full windows and lose the tail. Rows are numbered block-wise and only a
    window's rows meet, so a very long song is spread over tasks.
    """
    rows = sequence_position(df.select(*by, order, z), by, order)
    rows = rows.withColumn("window", F.floor(F.col("pos") / length))
    packed = rows.groupBy(*by, "window").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", z))), lambda s: s[z]).alias("vectors"),
        F.count(F.lit(1)).alias("n"),
    )
    full = F.col("n") == length
    short_song = (F.col("window") == 0) & (F.col("n") >= min_length)
    return packed.filter(full & (F.lit(length) >= min_length) | short_song)


def pad_windows(win: DataFrame, length: int, dims: int) -> DataFrame:
    """Pad each window with zero vectors to ``length``; ``n`` keeps the true length."""
    blank = F.array_repeat(F.array_repeat(F.lit(0.0), dims), length)
    full = F.slice(
        F.concat(F.transform("vectors", lambda v: F.transform(v, lambda x: x.cast("double"))), blank), 1, length
    )
    return win.withColumn("vectors", full)


def teacher_pairs(df: DataFrame, by: Sequence[str], order: str, z: str = "z") -> DataFrame:
    """(by, order, current, target): each row with its successor."""
    nxt = sequence_next(df.select(*by, order, z), by, order, [z])
    return nxt.filter(F.col(f"next_{z}").isNotNull()).select(
        *by, order, F.col(z).alias("current"), F.col(f"next_{z}").alias("target")
    )


def prediction_mse(pairs: DataFrame, predicted: str = "current", target: str = "target") -> DataFrame:
    """Mean squared error of a prediction column; ``current`` is the persistence baseline."""
    gap = V.let(V.difference(F.col(predicted), F.col(target)), lambda e: V.dot(e, e) / F.size(e))
    return pairs.select(gap.alias("e")).agg(F.avg("e").alias("mse"), F.count(F.lit(1)).alias("n"))


def condition_features(instrument: Column, tempo: Column, num: Column, den: Column) -> list[Column]:
    """Instrument index (last slot for unknown), tempo share in [0, 1], one-hot signature."""
    known = F.array(*[F.lit(i) for i in INSTRUMENTS])
    at = F.array_position(known, instrument)
    index = F.when(at > 0, at - 1).otherwise(len(INSTRUMENTS)).cast("int")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), tempo / MAX_TEMPO))
    slot = F.lit(0)
    for i, (n, d) in enumerate(SIGNATURES):
        slot = F.when((num == n) & (den == d), i).otherwise(slot)
    one_hot = F.transform(
        F.sequence(F.lit(0), F.lit(len(SIGNATURES) - 1)), lambda i: F.when(i == slot, 1.0).otherwise(0.0)
    )
    return [index.alias("instrument_index"), share.alias("tempo_share"), one_hot.alias("signature")]


def causal_mean(df: DataFrame, by: Sequence[str], order: str, value: str, name: str = "running_mean") -> DataFrame:
    """Mean of ``value`` over rows up to and including the current one, by a scan over range blocks."""
    rows = running(df, by, [order], {"_sum": ("sum", F.col(value)), "_count": ("count", F.col(value))})
    return rows.withColumn(name, F.try_divide("_sum", "_count")).drop("_sum", "_count")
