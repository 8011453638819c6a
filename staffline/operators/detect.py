"""Continuous velocity planes to note intervals.

``plane`` is (bar, row, step, value) with value in (0, 1]; zeros have no row and the
frame is partitioned by bar. Every detector returns (bar, pitch, onset, offset,
velocity). A row of a bar holds at most ``steps`` positions, so windows stay small
however many bars there are.

Fitted parameters are plain numbers per row (at most the image height) that travel
inside the plan; unfitted detectors use their defaults.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staffline.keys import BAR, PITCHES, STEPS, VELOCITY_MAX
from staffline.operators import packed

DEFAULT_THRESHOLD = 0.5


PITCH_AXES = ("height", "width")


def upright(plane: DataFrame, pitch_axis: str = "height") -> DataFrame:
    """A plane with pitches along rows, as every detector reads it; ``width`` names one with pitches along columns.

    Both axes lie inside a bar, so nothing is moved. Heights and steps of detectors are those of the turned plane.
    """
    if pitch_axis not in PITCH_AXES:
        raise ValueError(f"unknown pitch axis {pitch_axis!r}; choose from {PITCH_AXES}")
    if pitch_axis == "height":
        return plane
    return plane.withColumns({"row": F.col("step"), "step": F.col("row")})


def row_pitch(row: Column, height: int = PITCHES, num_pitches: int = PITCHES, offset: int = 0) -> Column:
    """Pitch of an image row, rounding half to even."""
    if height == 1:
        return F.lit(offset)
    return (F.lit(offset) + F.bround(row * (num_pitches - 1) / (height - 1))).cast("int")


def _to_notes(
    runs: DataFrame, min_duration: int, height: int, num_pitches: int, pitch_offset: int
) -> DataFrame:
    # The inner rounding keeps the last bits of a sum from deciding an exact half.
    velocity = F.greatest(F.lit(1), F.least(F.lit(127), F.bround(F.round(F.col("mean") * VELOCITY_MAX, 9))))
    return (
        runs.filter(F.col("offset") - F.col("onset") >= min_duration)
        .select(
            *BAR, row_pitch(F.col("row"), height, num_pitches, pitch_offset).alias("pitch"),
            "onset", "offset", velocity.cast("int").alias("velocity"),
        )
        .filter(F.col("pitch").between(0, 127))
    )


def notes_of_runs(
    runs: DataFrame, min_duration: int = 1, height: int = PITCHES, num_pitches: int = PITCHES, pitch_offset: int = 0
) -> DataFrame:
    """Notes from (bar, row, onset, offset, mean), however the runs were found."""
    return _to_notes(runs, min_duration, height, num_pitches, pitch_offset)


def runs(active: DataFrame) -> DataFrame:
    """(bar, row, onset, offset, mean): maximal runs of consecutive steps of each row."""
    w = Window.partitionBy(*BAR, "row").orderBy("step")
    return (
        active.withColumn("_island", F.col("step") - F.row_number().over(w))
        .groupBy(*BAR, "row", "_island")
        .agg(
            F.min("step").cast("int").alias("onset"),
            (F.max("step") + 1).cast("int").alias("offset"),
            F.avg("value").alias("mean"),
        )
        .drop("_island")
    )


#: Steps that a row can have in the numbers of positions below.
_WIDE = 1 << 12


def found_runs(plane: DataFrame, upper: float | Sequence[float], lower: float | None = None, reshape: Callable | None = None, steps: int = STEPS) -> DataFrame:
    """(bar, row, onset, offset, mean): runs of values from ``lower`` on, each from its first value of ``upper`` (one, or one per row) on.

    The plane may come as strips. A bar's values are one row, and an Arrow function sorts those of a batch of bars; positions are not sorted
    or grouped as rows. A row's limit at or below zero is passed by silence too: such rows are one run over ``steps`` in every bar. ``reshape(keys, start, end)`` may change the runs of a batch, whose keys are (row of a bar) * _WIDE + step.
    """
    limits = None if isinstance(upper, (int, float)) else np.array(upper, float)
    always = np.zeros(0, np.int64) if limits is None else np.flatnonzero(limits <= 0)

    def score(batch: pa.RecordBatch) -> list:
        at, i, v = packed.spread(batch.column("p"))
        tall = int(i.max() // _WIDE) + 1 if len(i) else 1
        key = at * tall * _WIDE + i
        order = np.argsort(key, kind="stable")
        key, v = key[order], v[order]
        row = key // _WIDE % tall
        if limits is None:
            high, inside = upper, np.ones(len(v), bool)
        else:
            high, inside = limits[np.minimum(row, len(limits) - 1)], row < len(limits)
            inside &= high > 0
        lit, starts = inside & (v >= (high if lower is None else lower)), v >= high
        at_key, strong = key[lit], starts[lit]
        edge = np.flatnonzero(np.diff(at_key, prepend=-2) != 1) if len(at_key) else np.zeros(0, np.int64)
        edge = np.union1d(edge, np.flatnonzero(at_key % _WIDE == 0))
        end = np.append(edge[1:], len(at_key))[: len(edge)]
        ranked = np.flatnonzero(strong)
        first = np.append(ranked, len(at_key))[np.searchsorted(ranked, edge)]
        edge, end = first[first < end], end[first < end]
        start, stop = at_key[edge], at_key[end - 1] + 1
        if reshape is not None:
            start, stop = reshape(start, stop)
        spans = np.searchsorted(key, np.stack([start, stop], 1).ravel())
        total = np.add.reduceat(np.append(v, 0.0), spans)[::2] if len(spans) else np.zeros(0)
        total = np.where(spans[::2] < spans[1::2], total, 0.0)
        line = start // _WIDE
        onset = start - line * _WIDE
        bar, found = line // tall, [line % tall, onset, onset + stop - start, total / (stop - start)]
        if len(always):
            n, kept = len(batch), row < len(limits)
            sums = np.bincount((key // _WIDE // tall * len(limits) + row)[kept], v[kept], n * len(limits)).reshape(n, -1)[:, always]
            whole = [np.tile(always, n), np.zeros(sums.size, np.int64), np.full(sums.size, steps), sums.ravel() / steps]
            bar = np.concatenate([bar, np.repeat(np.arange(n), len(always))])
            order = np.argsort(bar, kind="stable")
            bar, found = bar[order], [np.concatenate(c)[order] for c in zip(found, whole)]
        kinds = {"row": pa.int32(), "onset": pa.int32(), "offset": pa.int32(), "mean": pa.float64()}
        return [packed.listed(bar, {name: pa.array(c, kind) for (name, kind), c in zip(kinds.items(), found)}, len(batch))]

    side = packed.pack({"p": packed.plane_side(plane, _WIDE)})
    found = packed.per_bar(side, {"runs": "array<struct<row:int,onset:int,offset:int,mean:double>>"}, score)
    return found.select(*BAR, F.inline("runs"))


def by_row_threshold(
    plane: DataFrame, thresholds: Sequence[float] | None, height: int = PITCHES, steps: int = STEPS,
    fallback: float = DEFAULT_THRESHOLD, min_duration: int = 1, num_pitches: int = PITCHES, pitch_offset: int = 0,
) -> DataFrame:
    """Detect with one threshold per row; unfitted or misfitting thresholds mean ``fallback``."""
    if thresholds is None or len(thresholds) != height:
        thresholds = [fallback] * height
    found = found_runs(plane, thresholds, steps=steps)
    return _to_notes(found, min_duration, height, num_pitches, pitch_offset)


def global_threshold(plane: DataFrame, threshold: float = DEFAULT_THRESHOLD, min_duration: int = 1, **image) -> DataFrame:
    if threshold <= 0:
        height = image.get("height", PITCHES)
        return by_row_threshold(plane, [threshold] * height, min_duration=min_duration, **image)
    found = found_runs(plane, threshold)
    return _to_notes(
        found, min_duration, image.get("height", PITCHES), image.get("num_pitches", PITCHES), image.get("pitch_offset", 0)
    )


def _bar_count(n_bars: int | None, bars: DataFrame | None) -> int:
    if n_bars is None and bars is None:
        raise ValueError("a plane has no rows for silent bars: give n_bars or bars")
    return n_bars if n_bars is not None else bars.select(*BAR).distinct().count()


def fit_adaptive(
    plane: DataFrame, k_sigma: float = 1.0, n_bars: int | None = None, height: int = PITCHES, steps: int = STEPS,
    bars: DataFrame | None = None,
) -> list[float]:
    """Per-row threshold clip(mean + k * population std, 0, 1) over all pixels, zeros included.

    A plane has no rows for silent bars, so their number comes from ``n_bars`` or from ``bars``, the table of
    reconstructed bars; one of the two is needed.

    One aggregate with a row per image row comes back to the driver.
    """
    count = _bar_count(n_bars, bars)
    stats = {
        r["row"]: (r["s"], r["ss"])
        for r in plane.groupBy("row").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss")).collect()
    }
    out = []
    for row in range(height):
        n = count * steps
        if n == 0:
            out.append(DEFAULT_THRESHOLD)
            continue
        s, ss = stats.get(row, (0.0, 0.0))
        mean = s / n
        std = math.sqrt(max(ss / n - mean * mean, 0.0))
        out.append(min(max(mean + k_sigma * std, 0.0), 1.0))
    return out


def hysteresis(
    plane: DataFrame, tau_on: float = 0.6, tau_off: float = 0.3, min_duration: int = 1,
    height: int = PITCHES, steps: int = STEPS, num_pitches: int = PITCHES, pitch_offset: int = 0,
) -> DataFrame:
    """A note starts at a value >= tau_on and lasts until a value < tau_off.

    Inside a run of values >= tau_off the note begins at the first value >= tau_on and
    ends with the run, which needs no state machine.
    """
    if tau_off > tau_on:
        raise ValueError("tau_off must not exceed tau_on")
    if tau_on <= 0:
        return by_row_threshold(plane, [tau_on] * height, height, steps, min_duration=min_duration,
                                num_pitches=num_pitches, pitch_offset=pitch_offset)
    starts = F.min(F.when(F.col("value") >= tau_on, F.col("step")))
    if tau_off <= 0:
        # Nothing switches such a note off: it lasts to the end of the bar.
        first = starts.over(Window.partitionBy(*BAR, "row"))
        found = (
            plane.withColumn("_first", first).filter(F.col("step") >= F.col("_first"))
            .groupBy(*BAR, "row", "_first").agg(F.sum("value").alias("s"))
            .select(*BAR, "row", F.col("_first").alias("onset"), F.lit(steps).alias("offset"),
                    (F.col("s") / (steps - F.col("_first"))).alias("mean"))
        )
    else:
        found = found_runs(plane, tau_on, tau_off)
    return _to_notes(found, min_duration, height, num_pitches, pitch_offset)


def velocity_aware(
    plane: DataFrame, onset_plane: DataFrame | None, threshold: float = DEFAULT_THRESHOLD, onset_boost: float = 2.0,
    min_duration: int = 1, height: int = PITCHES, steps: int = STEPS, num_pitches: int = PITCHES, pitch_offset: int = 0,
) -> DataFrame:
    """Threshold (v + b * onset) / (1 + b); the velocity is read from v alone.

    Without an onset channel this is the global threshold.
    """
    if onset_plane is None:
        return global_threshold(plane, threshold, min_duration, height=height, steps=steps,
                                num_pitches=num_pitches, pitch_offset=pitch_offset)
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    zero = F.lit(0.0)
    both = plane.select(*BAR, "row", "step", F.col("value"), zero.alias("onset")).unionByName(
        onset_plane.select(*BAR, "row", "step", zero.alias("value"), F.col("value").alias("onset"))
    ).groupBy(*BAR, "row", "step").agg(F.sum("value").alias("value"), F.sum("onset").alias("onset"))
    score = (F.col("value") + onset_boost * F.col("onset")) / (1.0 + onset_boost)
    found = runs(both.filter(score >= threshold).drop("onset"))
    return _to_notes(found, min_duration, height, num_pitches, pitch_offset)


def morphological(
    plane: DataFrame, threshold: float = DEFAULT_THRESHOLD, erosion: int = 2, dilation: int = 2,
    min_duration: int = 1, height: int = PITCHES, steps: int = STEPS, num_pitches: int = PITCHES, pitch_offset: int = 0,
) -> DataFrame:
    """Threshold, erode, dilate along time, then read the runs.

    On runs the two operations are interval arithmetic: eroding by n moves the start
    up by n//2 and the end down by n-1-n//2 (outside the bar counts as off); dilating
    moves them back out, and runs that meet are merged.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    er, dil = max(erosion, 1), max(dilation, 1)

    def reshape(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        line = start // _WIDE * _WIDE
        a, b = start + er // 2, stop - (er - 1 - er // 2)
        kept = b > a
        line, a, b = line[kept], a[kept], b[kept]
        a, b = np.maximum(line, a - dil // 2), np.minimum(line + steps, b + (dil - 1 - dil // 2))
        new = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (a[1:] > b[:-1]))[: len(a)])
        return a[new], b[np.append(new[1:], len(b))[: len(new)] - 1]

    found = found_runs(plane, threshold, reshape=reshape)
    return _to_notes(found, min_duration, height, num_pitches, pitch_offset)


# --- Gaussian mixture ---------------------------------------------------------------------


def mixture_threshold(means: Sequence[float], stds: Sequence[float]) -> float:
    """Decision point of a fitted row: the std-weighted midpoint of two components, or
    two standard deviations under the highest of more."""
    order = np.argsort(means, kind="stable")
    if len(means) == 2:
        lo, hi = order
        spread = stds[lo] + stds[hi]
        if spread > 1e-10:
            t = (means[lo] * stds[hi] + means[hi] * stds[lo]) / spread
        else:
            t = (means[lo] + means[hi]) / 2.0
    else:
        hi = int(np.argmax(means))
        t = means[hi] - 2.0 * stds[hi]
    return float(min(max(t, 0.0), 1.0))


@dataclass(frozen=True)
class Mixture:
    """Per-row mixture parameters: row -> (weights, means, variances)."""

    rows: dict[int, tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]]]
    iterations: int

    def thresholds(self, height: int = PITCHES, fallback: float = DEFAULT_THRESHOLD) -> list[float]:
        out = [fallback] * height
        for row, (_, means, variances) in self.rows.items():
            if 0 <= row < height:
                out[row] = mixture_threshold(means, [math.sqrt(max(v, 1e-12)) for v in variances])
        return out


def fit_mixture(
    plane: DataFrame, n_components: int = 2, n_bars: int | None = None, height: int = PITCHES, steps: int = STEPS,
    max_iter: int = 100, tol: float = 1e-3, floor: float = 1e-6, hard_steps: int = 8, bars: DataFrame | None = None,
) -> Mixture:
    """EM for the one-dimensional mixtures of all rows at once.

    Each iteration is one aggregate by row over the distinct (row, value) counts, zeros
    included; parameters (height * components numbers) are literals of the next one.
    A few hard-assignment steps from equally spaced means come first. A row stops by itself, when its mean log
    likelihood gains less than ``tol``, and no row depends on another. Rows with fewer
    than 2 * components values are left unfitted. One of ``n_bars`` and ``bars`` is needed, as in :func:`fit_adaptive`.
    """
    count = _bar_count(n_bars, bars)
    counts = plane.groupBy("row", "value").agg(F.count(F.lit(1)).cast("double").alias("n")).persist()
    try:
        filled = {r["row"]: r for r in counts.groupBy("row").agg(
            F.sum("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()}
        zeros = {row: count * steps - (filled[row]["n"] if row in filled else 0.0) for row in range(height)}
        fitted = [r for r in range(height) if count * steps >= 2 * n_components]
        params: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for r in fitted:
            hi = filled[r]["hi"] if r in filled else 0.0
            lo = 0.0 if zeros[r] > 0 or r not in filled else filled[r]["lo"]
            means = lo + (np.arange(n_components) + 0.5) / n_components * (hi - lo)
            params[r] = (np.full(n_components, 1.0 / n_components), means, np.full(n_components, max((hi - lo) ** 2 / 4, floor)))
        active = [r for r in fitted if r in filled]

        def densities(w, m, v, x):
            return w / np.sqrt(2 * np.pi * v) * np.exp(-0.5 * (x - m) ** 2 / v)

        previous, done = {}, 0
        for it in range(max_iter + hard_steps):
            if not active:
                break
            hard = it < hard_steps
            table = [params.get(r, (np.zeros(n_components),) * 3) for r in range(height)]
            lit = lambda k, c: F.get(F.array(*[F.lit(float(t[k][c])) for t in table]), F.col("row"))
            x = F.col("value")
            if hard:
                dist = [F.abs(x - lit(1, c)) for c in range(n_components)]
                best = F.least(*dist) if n_components > 1 else dist[0]
                picked = F.lit(False)
                resp = []
                for d in dist:
                    resp.append(F.when((d == best) & ~picked, 1.0).otherwise(0.0))
                    picked = picked | (d == best)
                total = F.lit(1.0)
            else:
                resp = [
                    lit(0, c) / F.sqrt(2 * math.pi * F.greatest(lit(2, c), F.lit(floor)))
                    * F.exp(-0.5 * (x - lit(1, c)) * (x - lit(1, c)) / F.greatest(lit(2, c), F.lit(floor)))
                    for c in range(n_components)
                ]
                total = resp[0]
                for p in resp[1:]:
                    total = total + p
                total = F.greatest(total, F.lit(1e-300))
            parts = [F.sum(F.col("n") * F.log(total)).alias("ll")]
            for c, p in enumerate(resp):
                g = F.col("n") * p / total
                parts += [F.sum(g).alias(f"g{c}"), F.sum(g * x).alias(f"s{c}"), F.sum(g * x * x).alias(f"q{c}")]
            sums = {r["row"]: r for r in counts.where(F.col("row").isin(active)).groupBy("row").agg(*parts).collect()}
            for r in list(active):
                w, m, v = params[r]
                row = sums[r]
                if hard:
                    z = np.zeros(n_components)
                    z[int(np.argmin(np.abs(0.0 - m)))] = zeros[r]
                else:
                    d = densities(w, m, v, 0.0)
                    t = max(d.sum(), 1e-300)
                    z = zeros[r] * d / t
                    likelihood = (row["ll"] + zeros[r] * math.log(t)) / max(1.0, count * steps)
                    if abs(likelihood - previous.get(r, math.inf)) < tol:
                        active.remove(r)
                    previous[r] = likelihood
                g = np.array([row[f"g{c}"] for c in range(n_components)]) + z
                s = np.array([row[f"s{c}"] for c in range(n_components)])
                q = np.array([row[f"q{c}"] for c in range(n_components)])
                keep = g > 1e-12
                safe = np.where(keep, g, 1.0)
                means = np.where(keep, s / safe, m)
                variances = np.where(keep, np.maximum(q / safe - means**2, 0.0) + floor, v)
                params[r] = (g / g.sum(), means, variances)
            done = it + 1
    finally:
        counts.unpersist()
    for r in fitted:
        if r not in filled:
            params[r] = (np.full(n_components, 1.0 / n_components), np.zeros(n_components), np.full(n_components, floor))
    return Mixture({r: tuple(tuple(map(float, a)) for a in params[r]) for r in fitted}, done)


# --- hidden Markov model ------------------------------------------------------------------


@dataclass(frozen=True)
class HmmParams:
    """Two states, Gaussian emissions. The defaults apply without fitting."""

    p_onset: float = 0.1
    p_offset: float = 0.2
    mu_on: float = 0.75
    mu_off: float = 0.15
    sigma_on: float = 0.1
    sigma_off: float = 0.1
    prior_on: float = 0.3


def fit_hmm(
    plane: DataFrame, true: DataFrame, n_bars: int | None = None, height: int = PITCHES, width: int = STEPS, steps: int = STEPS,
    bars: DataFrame | None = None,
) -> HmmParams:
    """Emission and transition parameters from planes labelled by the true segments.

    With ``bars``, the table of reconstructed bars, only these take part, silent ones included.

    Totals of the silent majority follow from the image size; transitions follow from the
    segments' ends. A handful of sums comes back to the driver.
    """
    span = min(width, steps)
    if bars is not None:
        plane, true = (df.join(bars.select(*BAR).distinct(), list(BAR), "left_semi") for df in (plane, true))
    pitch_rows: list[list[int]] = [[] for _ in range(PITCHES)]
    for r in range(height):
        p = 0 if height == 1 else int(np.round(r * (PITCHES - 1) / (height - 1)))
        pitch_rows[p].append(r)
    table = F.array(*[F.array(*[F.lit(r) for r in rows]).cast("array<int>") for rows in pitch_rows])
    labelled = true.filter(F.col("on") < span).withColumn("off", F.least(F.col("off"), F.lit(span)))
    row = F.col("pitch") if height == PITCHES else F.explode(F.get(table, F.col("pitch")))
    labelled = labelled.withColumn("row", row)
    # Bars beyond ``span`` count as well, so nothing is cut before the bars are packed.
    length = F.greatest(F.least(F.col("off"), F.lit(span)) - F.col("on"), F.lit(0)).cast("int")
    label = F.get(table, F.col("pitch")) if height != PITCHES else F.array("pitch")
    lit = true.select(*BAR, F.explode(label).alias("row"), F.col("on").alias("step"), F.array_repeat(F.lit(1.0), length).alias("values"))
    sides = {"p": packed.plane_side(plane, _WIDE), "t": packed.plane_side(lit, _WIDE)}
    names = ("n1", "s1", "q1", "s0", "q0")

    def sums(batch: pa.RecordBatch) -> list:
        (pb, pi, pv), (tb, ti, _) = (packed.spread(batch.column(c)) for c in "pt")
        kept = pi % _WIDE < span
        pb, pi, pv = pb[kept], pi[kept], pv[kept]
        area = int(max(pi.max(initial=0), ti.max(initial=0))) + 1
        key, at = np.unique(np.concatenate([pb * area + pi, tb * area + ti]), return_inverse=True)
        v = np.bincount(at, np.concatenate([pv, np.zeros(len(ti))]), len(key))
        on = np.bincount(at[len(pi):], minlength=len(key)) > 0
        bar = key // area
        add = lambda w: np.bincount(bar, w, len(batch)).astype(float)
        return [pa.array(add(w)) for w in (on, on * v, on * v * v, ~on * v, ~on * v * v)]

    found = packed.per_bar(packed.pack(sides), {n: "double" for n in names}, sums)
    s = found.agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names], F.count(F.lit(1)).alias("bars")).first()
    if n_bars is None and bars is None and height == PITCHES:
        count = s["bars"]
    else:  # at another height a pitch may have no row, and its bar counts all the same
        count = _bar_count(n_bars, plane.select(*BAR).unionByName(true.select(*BAR)) if bars is None else bars)
    length = F.col("off") - F.col("on")
    tr = labelled.agg(
        F.sum(length).alias("on"), F.count_if("starts").alias("onsets"),
        F.count_if(F.col("off") == span).alias("last"), F.count_if(F.col("starts") & (F.col("on") == 0)).alias("first"),
    ).first()
    p = HmmParams()
    n1, n0 = s["n1"] or 0, count * height * span - (s["n1"] or 0)
    stay = (tr["on"] or 0) - tr["onsets"]  # every step of a run but its first
    on_off = tr["onsets"] - tr["last"]
    off_on = tr["onsets"] - tr["first"]
    off_stay = count * height * (span - 1) - stay - on_off - off_on
    eps = 1e-6
    spread = lambda q, m, n: max(math.sqrt(max(q / n - m * m, 0.0)), 0.05)
    mu_on = s["s1"] / n1 if n1 else p.mu_on
    mu_off = s["s0"] / n0 if n0 else p.mu_off
    return HmmParams(
        p_onset=(off_on + eps) / (off_stay + off_on + 2 * eps) if off_stay + off_on else p.p_onset,
        p_offset=(on_off + eps) / (stay + on_off + 2 * eps) if stay + on_off else p.p_offset,
        mu_on=mu_on,
        mu_off=mu_off,
        sigma_on=spread(s["q1"], mu_on, n1) if n1 else p.sigma_on,
        sigma_off=spread(s["q0"], mu_off, n0) if n0 else p.sigma_off,
        prior_on=p.prior_on,
    )


def best_path(obs: np.ndarray, p: HmmParams) -> np.ndarray:
    """Most likely on/off states of many rows at once, shape (rows, steps); ties go to off."""
    clip = lambda q: float(min(max(q, 1e-6), 1 - 1e-6))
    p_on, p_off, prior = clip(p.p_onset), clip(p.p_offset), clip(p.prior_on)
    gauss = lambda m, s: -0.5 * ((obs - m) / max(s, 1e-6)) ** 2 - math.log(max(s, 1e-6) * math.sqrt(2 * math.pi))
    e_off, e_on = gauss(p.mu_off, p.sigma_off), gauss(p.mu_on, p.sigma_on)
    n, t = obs.shape
    stay_on, stay_off = np.zeros((n, t), bool), np.zeros((n, t), bool)
    off, on = math.log(1 - prior) + e_off[:, 0], math.log(prior) + e_on[:, 0]
    for i in range(1, t):
        from_off, from_on = off + math.log(p_on), on + math.log(1 - p_off)
        to_off_a, to_off_b = off + math.log(1 - p_on), on + math.log(p_off)
        stay_on[:, i] = from_on > from_off  # the on state was reached from on
        stay_off[:, i] = to_off_b > to_off_a  # the off state was reached from on
        on = np.where(stay_on[:, i], from_on, from_off) + e_on[:, i]
        off = np.where(stay_off[:, i], to_off_b, to_off_a) + e_off[:, i]
    state = on > off
    states = np.zeros((n, t), bool)
    for i in range(t - 1, -1, -1):
        states[:, i] = state
        state = np.where(state, stay_on[:, i], stay_off[:, i])
    return states


def _segments(states: np.ndarray, obs: np.ndarray) -> list[list[dict]]:
    padded = np.zeros((states.shape[0], states.shape[1] + 2), np.int8)
    padded[:, 1:-1] = states
    edge = np.diff(padded, axis=1)
    out: list[list[dict]] = [[] for _ in range(len(states))]
    starts, ends = np.argwhere(edge == 1), np.argwhere(edge == -1)
    for (r, a), (_, b) in zip(starts, ends):
        out[r].append({"onset": int(a), "offset": int(b), "mean": float(obs[r, a:b].mean())})
    return out


def hmm_tracker(
    plane: DataFrame, params: HmmParams | None = None, min_duration: int = 1,
    height: int = PITCHES, steps: int = STEPS, num_pitches: int = PITCHES, pitch_offset: int = 0,
) -> DataFrame:
    """Viterbi decoding of each row.

    A row of a bar becomes one pair of arrays (at most ``steps`` values); an Arrow
    function decodes a batch of rows together.
    """
    p = params or HmmParams()
    kind = "array<struct<onset:int,offset:int,mean:double>>"

    @F.pandas_udf(kind)
    def decode(at: pd.Series, values: pd.Series) -> pd.Series:
        obs = np.zeros((len(at), steps))
        lengths = at.map(len).to_numpy()
        if len(at):
            obs[np.repeat(np.arange(len(at)), lengths), np.concatenate(at.to_numpy())] = np.concatenate(values.to_numpy())
            return pd.Series(_segments(best_path(obs, p), obs))
        return pd.Series([], dtype=object)

    rows = plane.groupBy(*BAR, "row").agg(F.collect_list(F.struct("step", "value")).alias("v"))
    found = rows.select(*BAR, "row", F.inline(decode(F.col("v.step"), F.col("v.value"))))
    silent = _segments(best_path(np.zeros((1, steps)), p), np.zeros((1, steps)))[0]
    if silent:
        # Degenerate parameters that call silence a note: rows without pixels get it too.
        every = plane.select(*BAR).distinct().select(*BAR, F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("row"))
        empty = every.join(plane.select(*BAR, "row").distinct(), [*BAR, "row"], "left_anti")
        fixed = F.array(*[F.struct(F.lit(s["onset"]).alias("onset"), F.lit(s["offset"]).alias("offset"), F.lit(0.0).alias("mean")) for s in silent])
        found = found.unionByName(empty.select(*BAR, "row", F.inline(fixed)))
    return _to_notes(found, min_duration, height, num_pitches, pitch_offset)


def with_strategy(bars: DataFrame, strategies: DataFrame, default: str = "velocity_only") -> DataFrame:
    """Attach each bar's channel strategy, ``default`` where none is recorded."""
    return bars.join(strategies.select(*BAR, "strategy"), list(BAR), "left").withColumn(
        "strategy", F.coalesce("strategy", F.lit(default))
    )
