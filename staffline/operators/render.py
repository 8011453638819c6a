"""Bars as images, kept as sparse pixels.

``pixels`` is (bar, channel, copies, row, col, level). A level of 0 is the image
background and has no row; a pixel value is ``level * (high - low) + low``. Every
transform here is linear in the level with weights that sum to one, so it is
applied to the stored pixels alone. ``copies`` says how many channels share the
plane: ``velocity_only`` repeats one plane three times and stores it once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffline.functions import taps
from staffline.keys import BAR, PITCHES, STEPS, VELOCITY_MAX
from staffline.operators import packed
from staffline.operators.ingest import with_masks

CHANNELS = 3
STRATEGIES = ("velocity_only", "vo_split", "vos")


def scale_velocity(velocity: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return velocity / VELOCITY_MAX * (high - low) + low


def scale_mask(mask: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.when(mask, high).otherwise(low)


def to_range(level: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return level * (high - low) + low


def to_level(value: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """Inverse of :func:`to_range`, clamped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


def velocity_plane(cells: DataFrame) -> DataFrame:
    """(bar, row, step, value): the true velocity plane in [0, 1]."""
    return cells.select(*BAR, F.col("pitch").alias("row"), "step", (F.col("velocity") / VELOCITY_MAX).alias("value"))


def velocity_strips(segments: DataFrame) -> DataFrame:
    """:func:`velocity_plane` as strips (see ``packed``), (bar, row, step, values): a row per segment."""
    values = F.array_repeat(F.col("velocity") / VELOCITY_MAX, (F.col("off") - F.col("on")).cast("int"))
    return segments.select(*BAR, F.col("pitch").alias("row"), F.col("on").alias("step"), values.alias("values"))


def plane_pixels(plane: DataFrame, channel: int = 0, copies: int = CHANNELS) -> DataFrame:
    """A velocity plane as the pixels of an image; strips stay strips."""
    level = F.col("values").alias("levels") if "values" in plane.columns else F.col("value").alias("level")
    return plane.select(*BAR, F.lit(channel).alias("channel"), F.lit(copies).alias("copies"), "row", F.col("step").alias("col"), level)


def render(cells: DataFrame, strategy: str = "velocity_only", pitch_axis: str = "height") -> DataFrame:
    """Pixels of each bar under a channel strategy.

    ``velocity_only`` is (v, v, v), ``vo_split`` (v, onset, background), ``vos``
    (v, onset, sustain). With ``pitch_axis='width'`` pitches run along columns.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; choose from {STRATEGIES}")
    velocity = F.col("velocity") / VELOCITY_MAX
    one = F.lit(1.0)
    if strategy == "velocity_only":
        planes = cells.withColumn("p", F.struct(F.lit(0).alias("channel"), velocity.alias("level")))
        copies = CHANNELS
    else:
        masked = cells if "is_onset" in cells.columns else with_masks(cells)
        second = [F.struct(F.lit(1).alias("channel"), F.when(F.col("is_onset"), one).alias("level"))]
        if strategy == "vos":
            second.append(F.struct(F.lit(2).alias("channel"), F.when(F.col("is_sustain"), one).alias("level")))
        planes = masked.withColumn(
            "p", F.explode(F.array(F.struct(F.lit(0).alias("channel"), velocity.alias("level")), *second))
        ).filter(F.col("p.level").isNotNull())
        copies = 1
    row, col = ("pitch", "step") if pitch_axis == "height" else ("step", "pitch")
    return planes.select(
        *BAR, F.col("p.channel").alias("channel"), F.lit(copies).alias("copies"),
        F.col(row).alias("row"), F.col(col).alias("col"), F.col("p.level").alias("level"),
    )


def strips(segments: DataFrame, strategy: str = "velocity_only") -> DataFrame:
    """The pixels of :func:`render` as strips (see ``packed``): (bar, channel, copies, row, col, levels), a row per segment and mask."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; choose from {STRATEGIES}")
    length = F.col("off") - F.col("on")
    strip = lambda channel, level, at, n: F.struct(
        F.lit(channel).alias("channel"), at.alias("col"), F.array_repeat(level, n.cast("int")).alias("levels")
    )
    parts = [strip(0, F.col("velocity") / VELOCITY_MAX, F.col("on"), length)]
    if strategy != "velocity_only":
        parts.append(F.when(F.col("starts"), strip(1, F.lit(1.0), F.col("on"), F.lit(1))))
    if strategy == "vos":
        first = F.when(F.col("starts"), 1).otherwise(0)
        parts.append(F.when(length > first, strip(2, F.lit(1.0), F.col("on") + first, length - first)))
    copies = CHANNELS if strategy == "velocity_only" else 1
    rows = segments.select(*BAR, F.lit(copies).alias("copies"), F.col("pitch").alias("row"), F.explode(F.array(*parts)).alias("p")).where("p IS NOT NULL")
    return rows.select(*BAR, "p.channel", "copies", "row", "p.col", "p.levels")


def flip_rows(pixels: DataFrame, height: int = PITCHES) -> DataFrame:
    """Turn the pitch axis upside down."""
    return pixels.withColumn("row", F.lit(height - 1) - F.col("row"))


def resize(
    pixels: DataFrame, source: tuple[int, int], target: tuple[int, int], method: str = "bilinear"
) -> DataFrame:
    """Resample to ``target`` (height, width): bilinear, nearest, bicubic or area.

    Along an axis that shrinks a stored pixel is spread over the target pixels that read it (the weight tables
    are constants of the plan), then summed per target. Along one that grows the targets read from arrays, see ``_enlarge``.
    The frame stays by bar. Strips (see ``packed``) are resampled as the lines of a bar and come back as strips.
    """
    taps.taps(1, 1, method)
    if min(*source, *target) <= 0:
        raise ValueError("sizes must be positive")
    if "levels" in pixels.columns:
        return pixels if source == target else _resize_strips(pixels, source, target, method)
    out, sizes, blocks = pixels, {"row": source[0], "col": source[1]}, False
    for axis, n_in, n_out in (("row", source[0], target[0]), ("col", source[1], target[1])):
        if n_in >= n_out:
            sizes[axis] = n_out
        if n_in <= n_out:
            continue
        other = "col" if axis == "row" else "row"
        if method == "area" and n_in % n_out == 0:  # a pixel has one target: nothing is spread, and both axes are summed at once
            size = n_in // n_out
            inside = F.col(axis).between(0, n_in - 1)
            out = out.where(inside).withColumns({axis: F.floor(F.col(axis) / size).cast("int"), "level": F.col("level") / size})
            blocks = True
            continue
        out = (
            out.select(
                *BAR, "channel", "copies", other, "level",
                F.explode(taps.scatter(F.col(axis), n_in, n_out, method)).alias("t"),
            )
            .groupBy(*BAR, "channel", "copies", other, F.col("t.to").alias(axis))
            .agg(F.sum(F.col("level") * F.col("t.w")).alias("level"))
        )
        blocks = False
    if blocks:
        out = out.groupBy(*BAR, "channel", "copies", "row", "col").agg(F.sum("level").alias("level"))
    if (sizes["row"], sizes["col"]) != target:
        out = _enlarge(out, (sizes["row"], sizes["col"]), target, method)
    return out.select(*BAR, "channel", "copies", "row", "col", "level")


def _resize_strips(strips: DataFrame, source: tuple[int, int], target: tuple[int, int], method: str, most: int = 1024) -> DataFrame:
    """The strips of a resized image: only lines with stored pixels are resampled, in an Arrow function over ``most`` bars at once.

    A line is a row of a matrix, so its columns are one product with the weights; then each target row adds up the lines that it reads. A target is
    stored if any stored pixel reaches it, and each run of such targets in a row is a strip.
    """
    (height, width), (tall, wide) = source, target
    down, across = taps.matrix(height, tall, method), taps.matrix(width, wide, method)
    reached = (across != 0).astype(float)
    to, read = np.nonzero(down)
    order = np.argsort(read, kind="stable")
    to, weight, fan = to[order], down[to, read][order], np.bincount(read, minlength=height)
    begin = np.cumsum(fan) - fan

    def score(batch: pa.RecordBatch) -> list:
        at, i, v = packed.spread(batch.column("p"))
        lines, line = np.unique((at * CHANNELS * height) + i // width, return_inverse=True)
        dense = lambda x: np.bincount(line * width + i % width, x, len(lines) * width).reshape(-1, width)
        level, stored = dense(v) @ across.T, dense(np.ones(len(v))) @ reached.T > 0
        plane, row = lines // height, lines % height
        k = fan[row]
        own = np.repeat(np.arange(len(lines)), k)
        tap = np.repeat(begin[row] - np.cumsum(k) + k, k) + np.arange(k.sum())
        code = plane[own] * tall + to[tap]
        order = np.argsort(code, kind="stable")
        own, tap, code = own[order], tap[order], code[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        if len(first):
            level = np.add.reduceat(level[own] * weight[tap][:, None], first)
            stored = np.logical_or.reduceat(stored[own], first)
        else:
            level, stored = np.zeros((0, wide)), np.zeros((0, wide), bool)
        edge = np.diff(np.pad(stored, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (found, col), end = np.nonzero(edge == 1), np.nonzero(edge == -1)[1]
        image, out = np.divmod(code[first][found], tall)
        ends = pa.array(np.concatenate([[0], np.cumsum(end - col)]).astype(np.int32))
        columns = {
            "channel": pa.array(image % CHANNELS, pa.int32()), "row": pa.array(out, pa.int32()), "col": pa.array(col, pa.int32()),
            "levels": pa.ListArray.from_arrays(ends, pa.array(level[stored])),
        }
        return [batch.column("copies").cast(pa.int32()), packed.listed(image // CHANNELS, columns, len(batch))]

    bars = packed.pack({"p": packed.pixel_side(strips, height, width)})
    kinds = {"copies": "int", "strips": "array<struct<channel:int,row:int,col:int,levels:array<double>>>"}
    return packed.per_bar(bars, kinds, score, most).select(*BAR, "copies", F.inline("strips")).select(*BAR, "channel", "copies", "row", "col", "levels")


def _weighted(values: Sequence[Column], weights: Sequence[Column | float]) -> Column:
    """The weighted sum of the values that are there; null if none is."""
    terms = [F.coalesce(v, F.lit(0.0)) * w for v, w in zip(values, weights)]
    return F.when(F.coalesce(*values).isNotNull(), reduce(lambda a, b: a + b, terms))


def _enlarge(pixels: DataFrame, source: tuple[int, int], target: tuple[int, int], method: str) -> DataFrame:
    """Resample where no axis shrinks, without grouping the many target pixels.

    Stored pixels become lines with a null where there is none, lines are resampled as arrays, and each target line reads its
    few source lines side by side. A target has a row if any stored pixel reaches it.
    """
    image = [*BAR, "channel", "copies"]
    inside = F.col("row").between(0, source[0] - 1) & F.col("col").between(0, source[1] - 1)
    stored = pixels.where(inside).groupBy(*image, "row", "col").agg(F.sum("level").alias("level"))
    lines = stored.groupBy(*image, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "level"))).alias("m"))
    lines = lines.select(*image, "row", F.transform(F.sequence(F.lit(0), F.lit(source[1] - 1)), lambda c: F.try_element_at("m", c)).alias("v"))
    if source[1] != target[1]:
        read = [_weighted([F.get("v", F.lit(j)) for j in w], list(w.values())) for w in taps.taps(source[1], target[1], method)]
        lines = lines.select(*image, "row", F.array(*read).alias("v"))
    images = lines.groupBy(*image).agg(F.map_from_entries(F.collect_list(F.struct("row", "v"))).alias("m"))
    images = images.select(*image, F.transform(F.sequence(F.lit(0), F.lit(source[0] - 1)), lambda r: F.try_element_at("m", r)).alias("lines"))
    rows = [{i: 1.0} for i in range(target[0])] if source[0] == target[0] else taps.taps(source[0], target[0], method)
    most = max(map(len, rows))
    blank = F.array().cast("array<double>")
    reads = []
    for i, weights in enumerate(rows):
        pairs = [(F.coalesce(F.get("lines", F.lit(j)), blank), F.lit(w)) for j, w in weights.items()]
        pairs += [(blank, F.lit(0.0))] * (most - len(pairs))
        parts = [c.alias(f"{n}{k}") for k, pair in enumerate(pairs) for n, c in zip("vw", pair)]
        reads.append(F.struct(F.lit(i).alias("row"), *parts))
    wide = images.select(*image, F.inline(F.array(*reads)))
    zipped = wide.select(
        *image, "row", *[f"w{k}" for k in range(most)], F.posexplode(F.arrays_zip(*[f"v{k}" for k in range(most)])).alias("col", "z")
    )
    level = _weighted([F.col(f"z.v{k}") for k in range(most)], [F.col(f"w{k}") for k in range(most)])
    return zipped.select(*image, "row", "col", level.alias("level")).where("level IS NOT NULL")


def pad(pixels: DataFrame, source: tuple[int, int], size: int) -> DataFrame:
    """Centre on a size x size background; an odd remainder goes right and to the bottom."""
    height, width = source
    if height > size or width > size:
        raise ValueError(f"{height}x{width} exceeds {size}; resize first")
    return pixels.withColumns(
        {"row": F.col("row") + (size - height) // 2, "col": F.col("col") + (size - width) // 2}
    )


def remap(value: Column, dst: tuple[float, float], src: tuple[float, float] = (-1.0, 1.0)) -> Column:
    """Affine map of a pixel value from one range to another."""
    if dst[0] >= dst[1] or src[0] >= src[1]:
        raise ValueError("a range needs low < high")
    return (value - src[0]) / (src[1] - src[0]) * (dst[1] - dst[0]) + dst[0]


def compose(steps: Sequence[Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run


def image_rows(
    pixels: DataFrame, width: int = STEPS, low: float = -1.0, high: float = 1.0
) -> DataFrame:
    """(bar, channel, row, values): dense rows in pixel values; all-background rows are omitted. Pixels may come as strips."""
    tall = 1 << 20  # rows have no bound here; positions need a number per channel and row
    entry = F.struct(F.col("channel"), F.col("row"), F.col("col"), (F.col("levels") if "levels" in pixels.columns else F.array("level")).cast("array<double>").alias("v"))
    bars = pixels.groupBy(*BAR, "copies").agg(F.collect_list(entry).alias("p"))

    def lines(batch: pa.RecordBatch) -> list:
        flat = batch.column("p").flatten()
        bar = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column("p")).to_numpy(zero_copy_only=False))
        channel, row, col = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("channel", "row", "col"))
        n = pc.list_value_length(flat.field("v")).to_numpy(zero_copy_only=False).astype(np.int64)
        level = flat.field("v").flatten().to_numpy(zero_copy_only=False)
        code, line = np.unique((bar * CHANNELS + channel) * tall + row, return_inverse=True)
        at = np.repeat(col, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        line, kept = np.repeat(line, n), (at >= 0) & (at < width)
        values = np.zeros(len(code) * width)
        values[line[kept] * width + at[kept]] = level[kept]
        ends = pa.array(np.arange(len(code) + 1, dtype=np.int32) * width)
        columns = {
            "channel": pa.array(code // tall % CHANNELS, pa.int32()), "row": pa.array(code % tall, pa.int32()),
            "values": pa.ListArray.from_arrays(ends, pa.array(values * (high - low) + low)),
        }
        return [batch.column("copies"), packed.listed(code // tall // CHANNELS, columns, len(batch))]

    found = packed.per_bar(bars, {"copies": dict(bars.dtypes)["copies"], "lines": "array<struct<channel:int,row:int,values:array<double>>>"}, lines)
    found = found.select(*BAR, "copies", F.inline("lines"))
    channel = F.when(F.col("copies") == 1, F.array("channel")).otherwise(F.sequence(F.lit(0), F.col("copies") - 1))
    return found.select(*BAR, F.explode(channel).alias("channel"), F.col("row").cast(dict(pixels.dtypes)["row"]).alias("row"), "values")


def rows_to_plane(rows: DataFrame, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Channel 0 of dense rows back to the sparse velocity plane in [0, 1]."""
    return (
        rows.filter("channel = 0")
        .select(*BAR, "row", F.posexplode("values").alias("step", "v"))
        .select(*BAR, "row", "step", to_level(F.col("v"), low, high).alias("value"))
        .filter("value > 0")
    )
