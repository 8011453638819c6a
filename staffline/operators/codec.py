"""Image codecs as table jobs: pooling, reparameterised samples, noise.

Latents from any external encoder are accepted as a table (key, z_mu, z_sigma);
the linear codec is the PCA of ``vectors``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffline.functions import taps
from staffline.keys import BAR, PITCHES, STEPS
from staffline.operators import packed
from staffline.operators.render import resize, to_range

POOL = (16, 16)
LATENT_CHANNELS = 4
POOL_SIGMA = 0.1


def pool_encode(pixels: DataFrame, size: tuple[int, int] = (PITCHES, STEPS)) -> DataFrame:
    """Latent pixels: the average of each block of a 16 x 16 grid (an area resize)."""
    return resize(pixels, size, POOL, "area")


def pool_decode(latent: DataFrame, size: tuple[int, int] = (PITCHES, STEPS)) -> DataFrame:
    """Image pixels: bilinear enlargement of the latent pixels."""
    return resize(latent, POOL, size, "bilinear")


Found = tuple[np.ndarray, ...]


def decoded_arrays(
    t: Found, z: Found, n: int, threshold: float, active: float, size: tuple[int, int] = (PITCHES, STEPS), stack: int = 64
) -> tuple[np.ndarray, Found, Found]:
    """What scores and notes need of the decoded planes of ``n`` bars, ``stack`` of them at once.

    ``t`` and ``z`` are (bar, position, level) of the true plane and of the latent one, bars ascending. Gives the summed squared differences of levels, (bar,
    row, sum, number of levels from ``active`` on) of lines with a level, and (bar, row, onset, offset, mean) of the runs of levels from ``threshold`` on.
    """
    height, width = size
    down, across = (taps.matrix(a, b) for a, b in zip(POOL, size))
    error, rows, runs = np.zeros(n), [], []
    for start in range(0, n, stack):
        stop = min(start + stack, n)
        dense = []
        for side, area in ((t, height * width), (z, POOL[0] * POOL[1])):
            own = slice(*np.searchsorted(side[0], [start, stop]))
            dense.append(np.bincount((side[0][own] - start) * area + side[1][own], side[2][own], (stop - start) * area))
        plane = np.clip(down @ dense[1].reshape(-1, *POOL) @ across.T, 0.0, 1.0)
        gap = dense[0].reshape(plane.shape) - plane
        error[start:stop] = np.einsum("nij,nij->n", gap, gap)
        sums = plane.sum(axis=2)
        bar, row = np.nonzero(sums)
        rows.append((bar + start, row, sums[bar, row], (plane >= active).sum(axis=2)[bar, row]))
        on = np.zeros((*plane.shape[:2], width + 2), np.int8)
        on[:, :, 1:-1] = plane >= threshold
        edge = np.diff(on, axis=2)
        (bar, row, onset), offset = np.nonzero(edge == 1), np.nonzero(edge == -1)[2]
        so_far = np.concatenate([np.zeros((*plane.shape[:2], 1)), np.cumsum(plane, axis=2)], axis=2)
        runs.append((bar + start, row, onset, offset, (so_far[bar, row, offset] - so_far[bar, row, onset]) / (offset - onset)))
    return error, tuple(map(np.concatenate, zip(*rows))), tuple(map(np.concatenate, zip(*runs)))


def decoded_bars(
    true: DataFrame, latent: DataFrame, threshold: float, active: float, size: tuple[int, int] = (PITCHES, STEPS), stack: int = 64
) -> DataFrame:
    """(bar, ss, has_t, rows, runs): what scores and notes need of each bar's decoded plane, which exists only inside a task.

    ``true`` and ``latent`` are pixels whose first channel is read. ``ss`` sums the squared differences of pixel values, ``rows`` has (row, p, a), the sum
    and the number of levels from ``active`` on, ``runs`` (row, onset, offset, mean) of the levels from ``threshold`` (above 0) on.
    """
    inside = F.col("row").between(0, POOL[0] - 1) & F.col("col").between(0, POOL[1] - 1)
    sides = {"t": packed.pixel_side(true.where("channel = 0"), *size), "z": packed.pixel_side(latent.where("channel = 0").where(inside), *POOL)}

    def score(batch: pa.RecordBatch) -> list:
        n = len(batch)
        t, z = (packed.spread(batch.column(c)) for c in "tz")
        error, rows, runs = decoded_arrays(t, z, n, threshold, active, size, stack)
        join = lambda found, *names: packed.listed(
            found[0], {k: pa.array(found[j], pa.float64() if k in ("mean", "p") else pa.int32()) for j, k in enumerate(names, 1)}, n
        )
        has = np.bincount(t[0][t[2] != 0], minlength=n) > 0
        ss = 4.0 * error * batch.column("copies").to_numpy(zero_copy_only=False)
        return [pa.array(ss), pa.array(has), join(rows, "row", "p", "a"), join(runs, "row", "onset", "offset", "mean")]

    kinds = {
        "ss": "double", "has_t": "boolean", "rows": "array<struct<row:int,p:double,a:int>>",
        "runs": "array<struct<row:int,onset:int,offset:int,mean:double>>",
    }
    return packed.per_bar(packed.pack(sides), kinds, score)


def pool_latents(latent: DataFrame) -> DataFrame:
    """(bar, z_mu, z_sigma): flattened 4 x 16 x 16 means, the fourth channel zero."""
    area = POOL[0] * POOL[1]
    at = F.explode(
        F.when(F.col("copies") == 1, F.array("channel")).otherwise(F.sequence(F.lit(0), F.col("copies") - 1))
    )
    entries = latent.select(*BAR, at.alias("c"), "row", "col", "level").select(
        *BAR, (F.col("c") * area + F.col("row") * POOL[1] + F.col("col")).alias("i"), "level"
    )
    # Assembled line by line: a short map per latent row, then the rows of a bar.
    width, lines = POOL[1], LATENT_CHANNELS * POOL[0]
    blank = to_range(F.lit(0.0))
    line = entries.groupBy(*BAR, F.floor(F.col("i") / width).cast("int").alias("line")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("i") % width).alias("c"), "level"))).alias("m")
    )
    line = line.select(*BAR, "line", F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda c: to_range(F.coalesce(F.try_element_at("m", c), F.lit(0.0))),
    ).alias("values"))
    packed = line.groupBy(*BAR).agg(F.map_from_entries(F.collect_list(F.struct("line", "values"))).alias("m"))
    mu = F.flatten(F.transform(
        F.sequence(F.lit(0), F.lit(lines - 1)),
        lambda i: F.coalesce(
            F.try_element_at("m", i),
            F.array_repeat(F.when(i >= 3 * POOL[0], 0.0).otherwise(blank), width),
        ),
    ))
    return packed.select(
        *BAR, mu.alias("z_mu"), F.array_repeat(F.lit(POOL_SIGMA), lines * width).alias("z_sigma")
    )


def pool_vectors(pixels: DataFrame, size: tuple[int, int] = (PITCHES, STEPS)) -> DataFrame:
    """(bar, z_mu, z_sigma): :func:`pool_latents` of :func:`pool_encode`; pixels may come as strips.

    Blocks are summed in the Arrow function that reads a batch of bars, positions and latent pixels are no rows. Sizes that the grid does not divide
    take the two steps.
    """
    (height, width), (low, narrow) = size, POOL
    if height % low or width % narrow:
        return pool_latents(pool_encode(pixels, size))
    area, own = low * narrow, LATENT_CHANNELS - 1
    inside = pixels if "levels" in pixels.columns else pixels.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))

    def score(batch: pa.RecordBatch) -> list:
        at, i, v = packed.spread(batch.column("p"))
        n, i = len(batch), i.astype(np.int64)
        block = i // width // (height // low) * narrow + i % width // (width // narrow)  # channels lie above each other
        sums = np.bincount(at * own * area + block, v / (height // low * (width // narrow)), n * own * area)
        ends = pa.array(np.arange(n + 1, dtype=np.int32) * own * area)
        return [pa.ListArray.from_arrays(ends, pa.array(sums * 2.0 - 1.0)), batch.column("copies").cast(pa.int32())]

    bars = packed.per_bar(packed.pack({"p": packed.pixel_side(inside, height, width)}), {"v": "array<double>", "copies": "int"}, score)
    first = F.slice("v", 1, area)
    mu = F.when(F.col("copies") == 1, F.col("v")).otherwise(F.flatten(F.concat(F.array_repeat(first, F.least("copies", F.lit(own))), F.array_repeat(F.array_repeat(to_range(F.lit(0.0)), area), F.greatest(F.lit(own) - F.col("copies"), F.lit(0))))))
    blank = F.array_repeat(F.lit(0.0), area)
    return bars.select(*BAR, F.concat(mu, blank).alias("z_mu"), F.array_repeat(F.lit(POOL_SIGMA), LATENT_CHANNELS * area).alias("z_sigma"))


def hashed_uniform(*parts: Column) -> Column:
    """Uniform number in (0, 1) that depends on its arguments only."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 11)
    return (bits + F.lit(0.5)) / F.lit(float(1 << 53))


def hashed_normal(seed: int, *parts: Column) -> Column:
    """Standard normal number from two hashed uniforms; stable under repartitioning."""
    u = hashed_uniform(F.lit(seed), F.lit(1), *parts)
    v = hashed_uniform(F.lit(seed), F.lit(2), *parts)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * v)


def sample_latents(latents: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Add z_sample = z_mu + eps * z_sigma."""
    key = [F.col(k) for k in keys]
    pairs = F.arrays_zip("z_mu", "z_sigma")
    drawn = F.transform(
        pairs, lambda s, i: s["z_mu"] + hashed_normal(seed, *key, i) * s["z_sigma"]
    )
    return latents.withColumn("z_sample", drawn)


def decode_input(latents: DataFrame) -> Column:
    """The sample when there is one, else the mean."""
    return F.coalesce(F.col("z_sample"), F.col("z_mu")) if "z_sample" in latents.columns else F.col("z_mu")


def _hash_int(state: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of columns whose hash is ``state`` and of one more INT column."""
    one, two, three, five = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (state + (five + np.uint64(4))) ^ ((value.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF)) * one)
    h = (h << np.uint64(23)) | (h >> np.uint64(41))
    h *= two
    h += three
    h ^= h >> np.uint64(33)
    h *= two
    h ^= h >> np.uint64(29)
    h *= three
    h ^= h >> np.uint64(32)
    return h


#: Bars whose noise is made at once: their positions stay in a processor's cache.
_NOISY_BARS = 8


def _noisy(plane: DataFrame, columns: dict[str, str], result: Callable[[np.ndarray], list], scale: float, seed: int, height: int, width: int) -> DataFrame:
    """(bar, columns) of each bar's plane with noise, of which ``result`` gets a stack of (bars, height, width).

    The noise is ``hashed_normal(seed, *BAR, row, step)``: Spark hashes what a bar has in common, the Arrow function goes on with row and step.
    """
    side = packed.plane_side(plane, width)
    if "values" not in plane.columns:  # positions beyond the image have no number, but their bars have noise
        inside = F.col("row").between(0, height - 1) & F.col("step").between(0, width - 1)
        side = packed.plane_side(plane.withColumns({"row": F.when(inside, F.col("row")).otherwise(-1), "step": F.when(inside, F.col("step")).otherwise(0)}), width)
    bars = packed.pack({"p": side}).withColumns({f"h{k}": F.xxhash64(F.lit(seed), F.lit(k), *[F.col(c) for c in BAR]) for k in (1, 2)})
    rows, steps = np.arange(height)[:, None], np.arange(width)

    def uniform(state: pa.Array) -> np.ndarray:
        bar = state.to_numpy(zero_copy_only=False).view(np.uint64)[:, None, None]
        return ((_hash_int(_hash_int(bar, rows), steps) >> np.uint64(11)).view(np.int64) + 0.5) / float(1 << 53)

    def image(batch: pa.RecordBatch) -> list:
        at, i, v = packed.spread(batch.column("p"))
        kept = i >= 0
        level = np.bincount(at[kept] * (height * width) + i[kept], v[kept], len(batch) * height * width).reshape(-1, height, width)
        noise = np.sqrt(-2.0 * np.log(uniform(batch.column("h1")))) * np.cos(2.0 * math.pi * uniform(batch.column("h2"))) * (scale / 2.0)
        return result(np.clip(level + noise, 0.0, 1.0))

    return packed.per_bar(bars, columns, image, _NOISY_BARS)


def noisy_plane(
    plane: DataFrame, scale: float = 0.1, seed: int = 42, height: int = PITCHES, width: int = STEPS
) -> DataFrame:
    """Every pixel of a plane plus hashed Gaussian noise, clamped to the value range; the plane may come as strips (see ``packed``).

    ``scale`` is in pixel values of [-1, 1]. Noise reaches the background too, so the
    result is dense: height * width positions per bar, read off the bar's lines.
    """

    def lines(levels: np.ndarray) -> list:
        listed = lambda values, n: pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, n, dtype=np.int32)), values)
        return [listed(listed(pa.array(levels.reshape(-1)), width), height)]

    full = _noisy(plane, {"lines": "array<array<double>>"}, lines, scale, seed, height, width)
    full = full.select(*BAR, F.posexplode("lines").alias("row", "values")).select(*BAR, "row", F.posexplode("values").alias("step", "value"))
    return full.filter("value > 0")


def noisy_sums(
    plane: DataFrame, scale: float = 0.1, seed: int = 42, height: int = PITCHES, width: int = STEPS
) -> DataFrame:
    """(bar, n, total, top): number, sum and largest of the values that :func:`noisy_plane` gives; they never leave the task."""

    def sums(levels: np.ndarray) -> list:
        flat = levels.reshape(len(levels), -1)
        return [pa.array((flat > 0).sum(axis=1)), pa.array(flat.sum(axis=1)), pa.array(flat.max(axis=1))]

    return _noisy(plane, {"n": "bigint", "total": "double", "top": "double"}, sums, scale, seed, height, width)
