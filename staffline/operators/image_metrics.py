"""Per-bar scores of a reconstructed image, from sparse levels (see ``render``).

Dense totals (height * width) are constants; only non-background pixels are read.
The two sides are stacked by bar as in the note metrics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffline.functions import taps
from staffline.functions import vectors as V
from staffline.keys import BAR, PITCHES, STEPS, VELOCITY_MAX
from staffline.operators import packed
from staffline.operators.render import CHANNELS, resize

SPARSITY_LEVEL = 0.05
MIN_SIGMA = 0.1


def _clog(c: Column) -> Column:
    return F.when(c > 0, c * F.log(c)).otherwise(0.0)


def pixel_scores(
    true: DataFrame, recon: DataFrame, height: int = PITCHES, width: int = STEPS, recon_size: tuple[int, int] | None = None,
    method: str = "bilinear",
) -> DataFrame:
    """Mean squared error over 3 * height * width values in [-1, 1], and PSNR.

    Pixels may come as strips (see ``packed``). A reconstruction of another size, ``recon_size``, is brought to the true one; where
    no axis shrinks the enlarged image exists only as a stack of matrices in the task that compares it.
    """
    size = recon_size or (height, width)
    if size[0] > height or size[1] > width:
        recon, size = resize(recon, size, (height, width), method), (height, width)
    if size != (height, width):
        recon = recon.where(F.col("row").between(0, size[0] - 1) & F.col("col").between(0, size[1] - 1))
    sides = {"t": packed.pixel_side(true, height, width), "p": packed.pixel_side(recon, *size)}
    rows, cols = (None, None) if size == (height, width) else (taps.matrix(a, b, method) for a, b in zip(size, (height, width)))

    def score(batch: pa.RecordBatch) -> list:
        t, p = (packed.spread(batch.column(c)) for c in "tp")
        has = np.bincount(t[0][t[2] != 0], minlength=len(batch)) > 0
        if rows is None:
            area = int(max([0, *(s[1].max() + 1 for s in (t, p) if len(s[1])) ]))
            code, at = np.unique(np.concatenate([s[0] * area + s[1] for s in (t, p)]), return_inverse=True)
            gap = np.bincount(at, np.concatenate([t[2], -p[2]]), len(code))
            error = np.bincount(code // max(area, 1), gap * gap, len(batch))
        else:
            error = _enlarged_errors(t, p, len(batch), rows, cols)
        return [pa.array(4.0 * error * batch.column("copies").to_numpy(zero_copy_only=False)), pa.array(has)]

    return scores_of_errors(packed.per_bar(packed.pack(sides), {"ss": "double", "has_t": "boolean"}, score), height, width)


def scores_of_errors(bars: DataFrame, height: int = PITCHES, width: int = STEPS, keep: Sequence[str] = ()) -> DataFrame:
    """MSE and PSNR from (bar, ss, has_t): the summed squared differences of the pixel values of three channels. ``keep`` are columns that stay."""
    bar = bars.filter("has_t")
    mse = F.col("ss") / (CHANNELS * height * width)
    psnr = F.when(mse > 0, 10.0 * F.log10(F.try_divide(F.lit(4.0), mse))).otherwise(float("inf"))
    return bar.select(*BAR, mse.alias("pixel_mse"), psnr.alias("psnr"), *keep)


def _enlarged_errors(t: tuple, p: tuple, n: int, rows: np.ndarray, cols: np.ndarray, stack: int = 64) -> np.ndarray:
    """Summed squared differences of ``n`` bars between pixels and smaller pixels enlarged by two matrices."""
    (height, low), (width, narrow) = rows.shape, cols.shape
    size, small = height * width, low * narrow
    first, second = t[0] * CHANNELS + t[1] // size, p[0] * CHANNELS + p[1] // small
    planes = np.unique(np.concatenate([first, second]))
    out = np.zeros(n)
    sides = [(side, np.searchsorted(planes, of), area) for side, of, area in ((t, first, size), (p, second, small))]
    sorts = [np.argsort(k, kind="stable") for _, k, _ in sides]
    for start in range(0, len(planes), stack):
        part = planes[start:start + stack]
        dense = []
        for (side, k, area), o in zip(sides, sorts):
            own = o[slice(*np.searchsorted(k, [start, start + len(part)], sorter=o))]
            dense.append(np.bincount((k[own] - start) * area + side[1][own] % area, side[2][own], len(part) * area))
        image = rows @ dense[1].reshape(-1, low, narrow) @ cols.T
        gap = dense[0].reshape(-1, height, width) - image
        out += np.bincount(part // CHANNELS, np.einsum("nij,nij->n", gap, gap), n)
    return out


def row_scores(
    true: DataFrame, plane: DataFrame, height: int = PITCHES, width: int = STEPS, steps: int = STEPS
) -> DataFrame:
    """Pitch entropies, KL of pitch distributions and activation sparsity.

    The true distribution counts active cells, the reconstructed one sums levels;
    silence has the entropy of a uniform distribution. KL is 0 for a silent truth
    (such bars have no cells) and infinite for a silent reconstruction.
    The plane may come as strips (see ``packed``), or summed already: (bar, row, p, a), the sum of levels and the number of active ones.
    """
    zero, none = F.lit(0.0), F.lit(0)
    length = (F.col("off") - F.col("on")).cast("double")
    t = true.select(*BAR, F.col("pitch").alias("row"), length.alias("t"), zero.alias("p"), none.alias("a"))
    if "a" in plane.columns:
        level, active = F.col("p"), F.col("a")
    elif "values" in plane.columns:
        level = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
        active = F.size(F.filter("values", lambda v: v >= SPARSITY_LEVEL))
    else:
        level, active = F.col("value"), F.when(F.col("value") < SPARSITY_LEVEL, 0).otherwise(1)
    p = plane.select(*BAR, "row", zero.alias("t"), level.alias("p"), active.alias("a"))
    same = height == PITCHES
    stacked = t.unionByName(p) if same else t
    by_row = stacked.groupBy(*BAR, "row").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("a").alias("a"))
    sums = lambda v, n: [
        F.sum(v).alias(n), F.sum(_clog(F.col(v))).alias(f"{n}l"), F.count_if(F.col(v) > 0).alias(f"{n}n")
    ]
    pairs = F.collect_list(F.struct(F.col("t").alias("p"), F.col("p").alias("q")))
    bar = by_row.groupBy(*BAR).agg(*sums("t", "x"), *sums("p", "y"), F.sum("a").alias("a"), pairs.alias("pairs"))
    if not same:
        raw = p.groupBy(*BAR, "row").agg(F.sum("p").alias("p"), F.sum("a").alias("a"))
        own = raw.groupBy(*BAR).agg(*sums("p", "y"), F.sum("a").alias("a"))
        moved = raw.select(*BAR, "p", F.explode(taps.scatter(F.col("row"), height, PITCHES, "bilinear")).alias("k")).select(
            *BAR, F.col("k.to").alias("row"), zero.alias("t"), (F.col("p") * F.col("k.w")).alias("p"), none.alias("a")
        )
        both = t.unionByName(moved).groupBy(*BAR, "row").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
        both = both.groupBy(*BAR).agg(*sums("t", "x"), F.sum("p").alias("q"), pairs.alias("pairs"))
        bar = both.join(own, list(BAR), "left").withColumns(
            {c: F.coalesce(F.col(c), F.lit(0)) for c in ("y", "yl", "yn", "a")}
        )
    else:
        bar = bar.withColumn("q", F.col("y"))
    orig = V.entropy_from_sums(F.col("x"), F.col("xl"), F.col("xn"), PITCHES)
    rec = V.entropy_from_sums(F.col("y"), F.col("yl"), F.col("yn"), height)
    kl = F.greatest(F.lit(0.0), V.sparse_kl(F.col("pairs"), F.col("x"), F.col("q"), PITCHES))
    sparse = lambda n, size: (F.lit(float(size)) - n) / size
    s_rec, s_gt = sparse(F.col("a"), height * width), sparse(F.col("x"), PITCHES * steps)
    return bar.filter("x > 0").select(
        *BAR,
        (orig - rec).alias("note_entropy_diff"),
        orig.alias("note_entropy_orig"),
        rec.alias("note_entropy_recon"),
        F.when(F.col("q") > 1e-10, kl).otherwise(float("inf")).alias("kl_pitch_dist"),
        s_rec.alias("activation_sparsity_recon"),
        s_gt.alias("activation_sparsity_gt"),
        (s_rec - s_gt).alias("activation_sparsity_diff"),
    )


def _binned(index: Column, size: int, bins: int) -> Column:
    return F.floor(index / max(1, size // bins)).cast("int")


def _segment_bins(true: DataFrame, steps: int, bins: int) -> DataFrame:
    """(bar, pitch, bin, n): steps of each segment inside each time bin it touches."""
    size = max(1, steps // bins)
    spread = true.select(
        *BAR, "pitch", "on", "off",
        F.explode(F.sequence(
            F.floor(F.col("on") / size).cast("int"), F.floor((F.col("off") - 1) / size).cast("int")
        )).alias("bin"),
    )
    n = F.least(F.col("off"), (F.col("bin") + 1) * size) - F.greatest(F.col("on"), F.col("bin") * size)
    return spread.select(*BAR, "pitch", "bin", n.cast("bigint").alias("n"))


def mutual_information(
    true: DataFrame, plane: DataFrame, pitch_bins: int = 16, time_bins: int = 16,
    height: int = PITCHES, width: int = STEPS, steps: int = STEPS,
) -> DataFrame:
    """Mutual information of binned pitch and time, of the truth and of the reconstruction.

    N * MI = sum c log c over the joint minus the same over both marginals, plus
    N log N, so one more pass over the binned cells replaces dense matrices. Cells
    beyond the last whole bin are left out.
    """
    zero = F.lit(0.0)
    t = _segment_bins(true, steps, time_bins).select(
        *BAR, _binned(F.col("pitch"), PITCHES, pitch_bins).alias("pb"), F.col("bin").alias("tb"),
        F.col("n").cast("double").alias("t"), zero.alias("p"),
    )
    p = plane.select(
        *BAR, _binned(F.col("row"), height, pitch_bins).alias("pb"), _binned(F.col("step"), width, time_bins).alias("tb"),
        zero.alias("t"), F.col("value").alias("p"),
    )
    joint = (
        t.unionByName(p).filter((F.col("pb") < pitch_bins) & (F.col("tb") < time_bins))
        .groupBy(*BAR, "pb", "tb").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    )
    views = F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), (F.col("pb") * time_bins + F.col("tb")).alias("bin")),
        F.struct(F.lit(1).alias("kind"), F.col("pb").alias("bin")),
        F.struct(F.lit(2).alias("kind"), F.col("tb").alias("bin")),
    ))
    parts = joint.select(*BAR, "t", "p", views.alias("v")).groupBy(*BAR, "v").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    sign = F.when(F.col("v.kind") == 0, 1.0).otherwise(-1.0)
    whole = lambda c: F.sum(F.when(F.col("v.kind") == 0, F.col(c)).otherwise(0.0))
    bar = parts.groupBy(*BAR).agg(
        F.sum(sign * _clog(F.col("t"))).alias("ts"), whole("t").alias("tn"),
        F.sum(sign * _clog(F.col("p"))).alias("ps"), whole("p").alias("pn"),
    )
    mi = lambda s, n: F.when(
        F.col(n) > 1e-12, F.greatest(F.lit(0.0), F.col(s) / F.col(n) + F.log(n))
    ).otherwise(0.0)
    return bar.filter("tn > 0").select(
        *BAR, mi("ts", "tn").alias("mi_pitch_time_orig"), mi("ps", "pn").alias("mi_pitch_time_recon"),
        (mi("ts", "tn") - mi("ps", "pn")).alias("mi_pitch_time_diff"),
    )


def binned_marginal(true: DataFrame, axis: str = "pitch", bins: int = 32, steps: int = STEPS) -> DataFrame:
    """(bar, bin, share): coarse distribution of active cells over pitch or time."""
    if axis == "pitch":
        binned = true.select(
            *BAR, _binned(F.col("pitch"), PITCHES, bins).alias("bin"), (F.col("off") - F.col("on")).cast("bigint").alias("n")
        )
    else:
        binned = _segment_bins(true, steps, bins)
    counts = binned.filter(F.col("bin") < bins).groupBy(*BAR, "bin").agg(F.sum("n").alias("n"))
    # At most `bins` rows per bar meet here.
    packed = counts.groupBy(*BAR).agg(F.sum("n").alias("all"), F.collect_list(F.struct("bin", "n")).alias("b"))
    return packed.select(*BAR, "all", F.inline("b")).select(*BAR, "bin", (F.col("n") / F.col("all")).alias("share"))


def bar_nll(true: DataFrame, recon: DataFrame, height: int = PITCHES, width: int = STEPS, min_sigma: float = MIN_SIGMA) -> DataFrame:
    """Gaussian negative log-likelihood of the reconstructed plane under the true plane's mean and spread."""
    zero, n = F.lit(0.0), float(height * width)
    level, length = F.col("velocity") / VELOCITY_MAX, F.col("off") - F.col("on")
    value = F.col("value")
    stacked = true.select(
        *BAR, (level * length).alias("t"), (level * level * length).alias("tt"), zero.alias("p"), zero.alias("pp")
    ).unionByName(recon.select(*BAR, zero.alias("t"), zero.alias("tt"), value.alias("p"), (value * value).alias("pp")))
    bar = stacked.groupBy(*BAR).agg(
        F.sum("t").alias("t"), F.sum("tt").alias("tt"), F.sum("p").alias("p"), F.sum("pp").alias("pp")
    ).filter("t > 0")
    mu = F.col("t") / n
    sigma = F.greatest(F.sqrt(F.greatest(F.lit(0.0), (F.col("tt") - n * mu * mu) / (n - 1))), F.lit(min_sigma))
    dev = F.col("pp") / n - 2 * mu * F.col("p") / n + mu * mu
    nll = 0.5 * F.log(2 * math.pi * sigma * sigma) + 0.5 * dev / (sigma * sigma)
    return bar.select(*BAR, nll.alias("bar_level_nll"))


def _gaussian(size: int, sigma: float) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2.0
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def _band(kernel: np.ndarray, n: int) -> np.ndarray:
    """Matrix of a one-dimensional convolution with zeros outside the border."""
    r = len(kernel) // 2
    return sum(w * np.eye(n, k=i - r) for i, w in enumerate(kernel))


def _ssim_sums(x: np.ndarray, y: np.ndarray, rows: np.ndarray, cols: np.ndarray, c1: float, c2: float) -> np.ndarray:
    """Sum of the SSIM map of each pair of a stack; the separable window is two matrix products."""
    blur = lambda z: rows @ z @ cols
    mx, my = blur(x), blur(y)
    mxx, myy, mxy = mx * mx, my * my, mx * my
    sx = np.maximum(blur(x * x) - mxx, 0.0)
    sy = np.maximum(blur(y * y) - myy, 0.0)
    sxy = blur(x * y) - mxy
    return ((2 * mxy + c1) * (2 * sxy + c2) / ((mxx + myy + c1) * (sx + sy + c2) + 1e-10)).sum(axis=(1, 2))


def _plane_scores(sides: list, height: int, width: int, kernel: np.ndarray, stack: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(plane numbers, mean SSIM) of all planes with a pixel on either side.

    ``sides`` holds (plane, row, col, level) arrays of the truth and of the reconstruction. Only the rows that a
    pixel's window reaches are blurred; every other place is background on both sides and scores a constant.
    """
    r, c1, c2 = len(kernel) // 2, 0.01**2, 0.03**2
    background = c1 * c2 / (c1 * c2 + 1e-10)
    cols = _band(kernel, width)
    planes, at = np.unique(np.concatenate([s[0] for s in sides]), return_inverse=True)
    row = np.concatenate([s[1] for s in sides])
    low, high = np.full(len(planes), height), np.zeros(len(planes), dtype=np.int64)
    np.minimum.at(low, at, row)
    np.maximum.at(high, at, row)
    low, high = np.maximum(low - r, 0), np.minimum(high + r + 1, height)
    span = np.minimum(-(-(high - low) // 8) * 8, height)
    low = np.minimum(low, height - span)
    order = np.argsort(span, kind="stable")
    place = np.empty(len(planes), dtype=np.int64)
    place[order] = np.arange(len(planes))
    rank = np.split(place[at], [len(sides[0][0])])
    sorts = [np.argsort(k, kind="stable") for k in rank]
    ranked = [k[o] for k, o in zip(rank, sorts)]
    values = np.empty(len(planes))
    tall, first = np.unique(span[order], return_index=True)
    for h, begin, end in zip(tall, first, [*first[1:], len(planes)]):
        rows = _band(kernel, h)
        for start in range(begin, end, stack):
            stop = min(start + stack, end)
            pair = np.zeros((2, stop - start, h, width))
            for image, side, o, k in zip(pair, sides, sorts, ranked):
                own = o[slice(*np.searchsorted(k, [start, stop]))]
                spot = place[np.searchsorted(planes, side[0][own])]
                image[spot - start, side[1][own] - low[order[spot]], side[2][own]] = side[3][own]
            inside = _ssim_sums(pair[0], pair[1], rows, cols, c1, c2)
            values[order[start:stop]] = (inside + (height - h) * width * background) / (height * width)
    return planes, values


def ssim(
    true: DataFrame, recon: DataFrame, height: int = PITCHES, width: int = STEPS,
    window: int = 11, sigma: float = 1.5,
) -> DataFrame:
    """Structural similarity on [0, 1], Gaussian window, averaged over three channels.

    A bar's pixels (at most 3 * height * width per side), which may come as strips, are packed into arrays by
    a bar aggregate; an Arrow function scatters a batch of bars at once and blurs stacks of planes.
    """
    bars = packed.pack({"t": packed.pixel_side(true, height, width), "p": packed.pixel_side(recon, height, width)}).filter(F.size("t") > 0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel, area = _gaussian(window, sigma), height * width
        background = 0.01**2 * 0.03**2
        background /= background + 1e-10
        for batch in batches:
            sides = []
            for name in ("t", "p"):
                bar, at, level = packed.spread(batch.column(name))
                sides.append((bar * CHANNELS + at // area, at % area // width, at % width, level))
            planes, values = _plane_scores(sides, height, width, kernel)
            bar, n = planes // CHANNELS, len(batch)
            copies = batch.column("copies").to_numpy(zero_copy_only=False)
            seen = copies * np.bincount(bar, minlength=n)
            # A channel that is background on both sides is a constant image pair.
            total = copies * np.bincount(bar, weights=values, minlength=n) + (CHANNELS - seen) * background
            kept = [batch.column(c) for c in BAR]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(total / CHANNELS)], names=[*BAR, "ssim"])

    return bars.mapInArrow(score, bars.select(*BAR).schema.add("ssim", "double"))
