"""All conditions of an experiment in one plan: codecs x channel strategies x detectors.

Conditions are a table of parameters. Bars are read and rendered once per strategy, and each codec adds its planes. A bar's planes
are one row of strips, and an Arrow function takes a batch of bars through every condition, so a further
condition costs a pass over a batch, not rows or a further plan. Everything lies by bar from the planes on: detection and scores add no shuffle.

A detector here is a score per pixel and two thresholds. A note starts where the score reaches ``upper`` and lasts while it
stays at ``lower`` or above: one threshold for ``global`` and ``velocity_aware``, two for ``hysteresis``. The score is the pixel's
value, with an onset channel and ``velocity_aware`` the weighted mean of value and onset.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffline.keys import BAR, PITCHES, STEPS, VELOCITY_MAX
from staffline.operators import note_arrays, note_metrics, render
from staffline.plans.experiment import pivot_metrics, summarise, to_long

Codec = Callable[[DataFrame], DataFrame]

#: Conditions travel to every task; a longer table is an error.
MAX_CONDITIONS = 2000
#: Steps that a row can have in the numbers of positions.
WIDE = 1 << 12
#: Bars whose planes are held at once.
BLOCK = 1 << 10
#: Channel strategies whose second channel holds onsets.
WITH_ONSETS = ("vo_split", "vos")
CONDITION = T.StructType([
    T.StructField("condition", T.StringType()), T.StructField("codec", T.StringType()), T.StructField("strategy", T.StringType()),
    T.StructField("method", T.StringType()), T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType()),
    T.StructField("onset_boost", T.DoubleType()), T.StructField("min_duration", T.IntegerType()),
])


def detector(method: str, **parameters: float) -> Row:
    """Parameters of ``global`` (threshold), ``hysteresis`` (tau_on, tau_off) or ``velocity_aware`` (threshold, onset_boost)."""
    shortest = int(parameters.pop("min_duration", 1))
    if method == "hysteresis":
        upper, lower = parameters.pop("tau_on", 0.6), parameters.pop("tau_off", 0.3)
    elif method in ("global", "velocity_aware"):
        upper = lower = parameters.pop("threshold", 0.5)
    else:
        raise ValueError(f"unknown method {method!r}")
    boost = parameters.pop("onset_boost", 2.0) if method == "velocity_aware" else 0.0
    if parameters or not 0 < lower <= upper:
        raise ValueError(f"bad parameters of {method}: {parameters or (upper, lower)}")
    return Row(method=method, upper=float(upper), lower=float(lower), onset_boost=float(boost), min_duration=shortest)


def conditions(spark, codecs: Sequence[str], strategies: Sequence[str], detectors: Mapping[str, Row]) -> DataFrame:
    """The grid as a table, labelled ``codec__strategy__detector``."""
    rows = [
        Row(condition="__".join((c, s, name)), codec=c, strategy=s, **d.asDict()) for c in codecs for s in strategies for name, d in detectors.items()
    ]
    return spark.createDataFrame([tuple(r[f.name] for f in CONDITION) for r in rows], CONDITION)


def packed_planes(true: DataFrame, pixels: Mapping[str, DataFrame], codecs: Mapping[str, Codec]) -> DataFrame:
    """(bar, t, p): a row per bar with its true segments and the strips of all its planes, without a shuffle where all frames lie by bar.

    A strip is (plane, channel, i, v), planes are numbered strategy by strategy in the order of ``pixels``, codec by codec. ``pixels`` may come as strips.
    """
    segment = F.struct(*[F.col(c).cast("int").alias(c) for c in ("pitch", "on", "off")], F.col("velocity").cast("double").alias("velocity"), "starts")
    sides = []
    for strategy, frame in pixels.items():
        for codec in codecs.values():
            out = codec(frame)
            out = out.where(F.col("channel").isin(0, 1) if strategy in WITH_ONSETS else F.col("channel") == 0)
            levels = (F.col("levels") if "levels" in out.columns else F.array("level")).cast("array<double>")
            at = (F.col("row") * WIDE + F.col("col")).cast("int")
            strip = F.struct(F.lit(len(sides)).alias("plane"), F.col("channel").cast("int").alias("channel"), at.alias("i"), levels.alias("v"))
            sides.append(out.select(*BAR, F.lit(None).cast(true.select(segment.alias("t")).schema[0].dataType).alias("t"), strip.alias("p")))
    kind = sides[0].schema["p"].dataType
    rows = reduce(DataFrame.unionByName, sides, true.select(*BAR, segment.alias("t"), F.lit(None).cast(kind).alias("p")))
    return rows.groupBy(*BAR).agg(F.collect_list("t").alias("t"), F.collect_list("p").alias("p"))


def _positions(p: pa.ListArray) -> tuple[np.ndarray, ...]:
    """(plane, bar, position, value, onset) of every position that a plane of the batch has, in this order."""
    flat = p.flatten()
    bar = np.repeat(np.arange(len(p)), pc.list_value_length(p).to_numpy(zero_copy_only=False)).astype(np.int64)
    plane, channel, i = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("plane", "channel", "i"))
    n = pc.list_value_length(flat.field("v")).to_numpy(zero_copy_only=False).astype(np.int64)
    level = np.clip(flat.field("v").flatten().to_numpy(zero_copy_only=False), 0.0, 1.0)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = np.repeat(i, n) + inside
    area, bars = int(place.max(initial=0)) // WIDE * WIDE + WIDE, max(len(p), 1)
    key, at = np.unique((np.repeat(plane * bars + bar, n)) * area + place, return_inverse=True)
    second = np.repeat(channel, n) == 1
    value, onset = (np.bincount(at, np.where(second == which, level, 0.0), len(key)) for which in (False, True))
    return key // area // bars, key // area % bars, key % area, value, onset


def found_notes(positions: tuple[np.ndarray, ...], plane: int, aware: bool, row: Row, height: int, num_pitches: int) -> tuple[np.ndarray, dict]:
    """Notes of one condition in one plane: (bar, columns).

    A run of scores from ``lower`` on becomes a note from its first score of ``upper`` on.
    """
    planes, bar, place, value, onset = positions
    own = slice(*np.searchsorted(planes, [plane, plane + 1]))
    bar, place, value, onset = bar[own], place[own], value[own], onset[own]
    score = (value + row["onset_boost"] * onset) / (1.0 + row["onset_boost"]) if aware else value
    lit = score >= row["lower"]
    bar, place, value, strong = bar[lit], place[lit], value[lit], np.flatnonzero(score[lit] >= row["upper"])
    new = np.ones(len(bar), bool)
    new[1:] = (bar[1:] != bar[:-1]) | (place[1:] != place[:-1] + 1) | (place[1:] % WIDE == 0)
    edge = np.flatnonzero(new)
    end = np.append(edge[1:], len(bar))[:len(edge)]
    first = np.append(strong, len(bar))[np.searchsorted(strong, edge)]
    first, end = first[first < end], end[first < end]
    spans = np.stack([first, end], 1).ravel()
    total = np.add.reduceat(np.append(value, 0.0), spans)[::2] if len(spans) else np.zeros(0)
    # The inner rounding keeps the last bits of a sum from deciding an exact half.
    loud = np.clip(np.rint(np.round(total / (end - first) * VELOCITY_MAX, 9)), 1, 127)
    line = place[first] // WIDE
    pitch = np.rint(line * (num_pitches - 1) / (height - 1)).astype(np.int64) if height > 1 else np.zeros(len(line), np.int64)
    begin = place[first] % WIDE
    kept = (end - first >= row["min_duration"]) & (pitch >= 0) & (pitch <= 127)
    columns = {"pitch": pitch, "onset": begin, "offset": begin + end - first, "velocity": loud, "n": np.ones(len(pitch))}
    return bar[first][kept], {name: c[kept] for name, c in columns.items()}


def score(packed: DataFrame, rows: Sequence[Row], numbers: Mapping[tuple[str, str], int], steps: int = STEPS, height: int = PITCHES, num_pitches: int = PITCHES) -> DataFrame:
    """(condition, bar, scores) under every condition; ``numbers`` are those of the planes by codec and strategy.

    Planes, notes and profiles exist only for ``BLOCK`` bars of a task, and the notes of one condition at a time.
    """
    families = ("steps", "classes", "onsets")
    names = [name for f in families for name in note_metrics.FAMILIES[f]]
    kinds = ", ".join(f"{name}:double" for name in names)

    def block(t: pa.Array, p: pa.Array) -> pa.Array:
        n, true, positions = len(t), note_arrays.side(t, ("pitch", "on", "off", "velocity", "starts")), _positions(p)
        profile = note_arrays.profiles(true, "on", "off", n, steps)
        found = []
        for row in rows:
            aware = row["onset_boost"] > 0 and row["strategy"] in WITH_ONSETS
            notes = found_notes(positions, numbers[row["codec"], row["strategy"]], aware, row, height, num_pitches)
            found.append(note_metrics.score_arrays(true, notes, n, families, steps, profile=profile))
        columns = [np.stack([f[name] for f in found], 1).ravel() for name in names]
        parts = [pa.array(np.tile(np.arange(len(rows)), n), pa.int32()), *[pa.array(c, mask=np.isnan(c)) for c in columns]]
        ends = pa.array(np.arange(n + 1, dtype=np.int32) * len(rows))
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, names=["condition", *names]))

    def run(t: pa.Array, p: pa.Array) -> pa.Array:
        return pa.concat_arrays([block(t[a:a + BLOCK], p[a:a + BLOCK]) for a in range(0, max(len(t), 1), BLOCK)])

    scores = F.arrow_udf(run, f"array<struct<condition:int, {kinds}>>")
    label = F.element_at(F.array(*[F.lit(r["condition"]) for r in rows]), F.col("c.condition") + 1)
    each = packed.select(*BAR, F.explode(scores("t", "p")).alias("c"))
    return each.select(label.alias("condition"), *BAR, *[F.col(f"c.{name}").alias(name) for name in names])


def sweep(true: DataFrame, codecs: Mapping[str, Codec], table: DataFrame, steps: int = STEPS, cells: DataFrame | None = None) -> DataFrame:
    """(condition, metric, value, n): means over bars for every row of ``table``, from the segments of the true bars.

    Codecs read the pixels of :func:`render.strips`; with ``cells`` they read those of :func:`render.render`.
    """
    rows = table.limit(MAX_CONDITIONS + 1).collect()
    if len(rows) > MAX_CONDITIONS:
        raise ValueError(f"more than {MAX_CONDITIONS} conditions")
    strategies = sorted({r["strategy"] for r in rows})
    pixels = {s: render.strips(true, s) if cells is None else render.render(cells, s) for s in strategies}
    numbers = {(c, s): i for i, (s, c) in enumerate((s, c) for s in strategies for c in codecs)}
    scores = score(packed_planes(true, pixels, codecs), rows, numbers, steps)
    names = [n for n in scores.columns if n not in ("condition", *BAR)]
    return summarise(to_long(scores, ("condition", *BAR), names), ["condition"])


def summary_table(means: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """A row per condition, a column per metric; NaN where a condition has none."""
    return pivot_metrics(means, metrics)
