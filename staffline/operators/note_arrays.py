"""Scores of the notes of a batch of bars, as arrays: the Arrow functions behind ``note_metrics``.

A side is (bar of the batch, column arrays); profiles and onset patterns are matrices with a row per bar.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from staffline.functions.vectors import ENTROPY_FLOOR, FLAT_STD, KL_FLOOR

#: Pitch classes as Spark's remainder gives them (-11 to 11), and one for notes without a pitch.
CLASSES = 24
Side = tuple[np.ndarray, dict[str, np.ndarray]]


def side(notes: pa.ListArray, names: Sequence[str]) -> Side:
    """(bar, columns) of a column of lists of structs; numbers that are missing become NaN."""
    flat = notes.flatten()
    bar = np.repeat(np.arange(len(notes)), pc.list_value_length(notes).to_numpy(zero_copy_only=False))
    return bar, {name: flat.field(name).to_numpy(zero_copy_only=False) for name in names}


def pearson(x: np.ndarray, y: np.ndarray, x_scale: np.ndarray | float = 1.0, y_scale: np.ndarray | float = 1.0) -> np.ndarray:
    """Pearson r of each pair of lines, 0 where either is flat."""
    x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    sx, sy = np.sqrt((x * x).mean(axis=1)), np.sqrt((y * y).mean(axis=1))
    flat = (sx < x_scale * FLAT_STD) | (sy < y_scale * FLAT_STD)
    return np.where(flat, 0.0, (x * y).mean(axis=1) / np.where(flat, 1.0, sx * sy))


def profiles(notes: Side, begin: str, end: str, n: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(notes that sound, their mean velocity) on each step of each bar."""
    bar, c = notes
    on, off = np.fmax(c[begin], 0), np.fmin(c[end], steps)
    kept = off > on
    bar, on, off = bar[kept], on[kept].astype(np.int64), off[kept].astype(np.int64)
    times = c["n"][kept] if "n" in c else np.ones(len(bar))
    loud = np.trunc(np.nan_to_num(c["velocity"][kept]).astype(float)) * times
    place = np.concatenate([bar * (steps + 1) + on, bar * (steps + 1) + off])
    add = lambda v: np.cumsum(np.bincount(place, np.concatenate([v, -v]), n * (steps + 1)).reshape(n, -1), axis=1)[:, :steps]
    count = add(times.astype(float))
    return count, np.where(count > 0, add(loud) / np.where(count > 0, count, 1.0), 0.0)


def step_scores(true: tuple[np.ndarray, np.ndarray], pred: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    (tn, tv), (pn, pv) = true, pred
    return {
        "note_density_pearson": pearson(tn, pn), "velocity_mse": ((tv - pv) ** 2).mean(axis=1), "velocity_correlation": pearson(tv, pv),
    }


def classes(notes: Side, weight: np.ndarray, n: int) -> np.ndarray:
    """Summed weights per bar and pitch class."""
    bar, c = notes
    pitch = c["pitch"].astype(float)
    known = ~np.isnan(pitch)
    at = np.where(known, np.fmod(np.where(known, pitch, 0), 12) + 11, CLASSES - 1).astype(np.int64)
    return np.bincount(bar * CLASSES + at, weight, n * CLASSES).reshape(n, -1)


def entropy(counts: np.ndarray, bins: int = 12) -> np.ndarray:
    """As ``vectors.entropy_from_sums``."""
    mass = counts.sum(axis=1)
    some = np.where(mass > 0, mass, 1.0)
    positive = np.where(counts > 0, counts, 1.0)
    zeros = bins - (counts > 0).sum(axis=1)
    z = 1.0 + zeros * ENTROPY_FLOOR
    s = (positive * np.log(positive)).sum(axis=1) / some - np.log(some) + zeros * ENTROPY_FLOOR * math.log(ENTROPY_FLOOR)
    return np.where(mass > 0, np.log(z) - s / z, math.log(bins))


def class_scores(t: np.ndarray, p: np.ndarray) -> dict[str, np.ndarray]:
    """Correlation (NaN without predicted notes), cosine and entropies of two tables of pitch classes; twelve bins are compared."""
    x, y = t.sum(axis=1), p.sum(axis=1)
    vx, vy = (np.maximum(12 * (c * c).sum(axis=1) - s * s, 0.0) for c, s in ((t, x), (p, y)))
    both = (t * p).sum(axis=1)
    flat = (np.sqrt(vx) / 12 < x * FLAT_STD) | (np.sqrt(vy) / 12 < y * FLAT_STD)
    spread = np.sqrt(vx) * np.sqrt(vy)
    r = np.where(flat | (spread == 0), 0.0, (12 * both - x * y) / np.where(spread == 0, 1.0, spread))
    norm = np.sqrt((t * t).sum(axis=1) * (p * p).sum(axis=1))
    gt, gen = entropy(t), entropy(p)
    return {
        "pitch_class_histogram_correlation": np.where(y > 0, r, np.nan),
        "conditioning_pitch_alignment": np.where(y > 0, both / np.where(norm > 0, norm, 1.0), 0.0),
        "seq_coherence_gt_entropy": gt, "seq_coherence_gen_entropy": gen, "seq_coherence_entropy_diff": gt - gen,
    }


def onsets(bar: np.ndarray, step: np.ndarray, n: int, steps: int) -> np.ndarray:
    """A line per bar that is true on its onset steps; others are ignored."""
    kept = (step >= 0) & (step < steps)
    out = np.zeros((n, steps), bool)
    out[bar[kept], step[kept].astype(np.int64)] = True
    return out


def matches(true: np.ndarray, pred: np.ndarray, tolerance: int) -> np.ndarray:
    """Number of one-to-one matches of each bar: predictions ascending, each takes the nearest free true onset, the earlier one on a tie."""
    free, steps = true.copy(), true.shape[1]
    hits = np.zeros(len(true), np.int64)
    near = [0, *[d for k in range(1, min(tolerance, steps) + 1) for d in (-k, k)]]
    for at in range(steps):
        waiting = pred[:, at].copy()
        for d in near:
            if 0 <= at + d < steps:
                taken = waiting & free[:, at + d]
                free[:, at + d] &= ~taken
                waiting &= ~taken
                hits += taken
    return hits


def onset_scores(true: np.ndarray, pred: np.ndarray, tolerance: int) -> dict[str, np.ndarray]:
    """Precision, recall and F1; nothing on either side scores 1, 1, 1, no truth 0, 1, 0, no prediction 1, 0, 0."""
    nt, n_p, hits = true.sum(axis=1), pred.sum(axis=1), matches(true, pred, tolerance)
    precision = np.where(n_p == 0, 1.0, hits / np.maximum(n_p, 1))
    recall = np.where(nt == 0, 1.0, hits / np.maximum(nt, 1))
    both = precision + recall
    f1 = np.where(both > 0, 2.0 * precision * recall / np.where(both > 0, both, 1.0), 0.0)
    f1 = np.where((nt == 0) & (n_p == 0), 1.0, np.where((nt == 0) | (n_p == 0), 0.0, f1))
    return {"onset_precision": precision, "onset_recall": recall, "onset_f1": f1}


def groove(true: np.ndarray, pred: np.ndarray) -> np.ndarray:
    """Pearson r of the autocorrelations of the centred onset patterns, lag 0 left out."""
    steps = true.shape[1]
    lags = range(1, max(steps // 2, 1))
    curves, spreads = [], []
    for side_ in (true, pred):
        n = side_.sum(axis=1)
        x = side_ - (n / steps)[:, None]
        curves.append(np.stack([(x[:, :steps - k] * x[:, k:]).sum(axis=1) for k in lags], axis=1) if lags else np.zeros((len(n), 1)))
        spreads.append(n * (1 - n / steps))
    a, b = spreads
    r = pearson(*curves, np.maximum(a, 1e-10), np.maximum(b, 1e-10))
    return np.where((a < 1e-10) | (b < 1e-10), 0.0, r)


def gap_kl(sides: Sequence[tuple[np.ndarray, np.ndarray]], n: int, bins: int) -> np.ndarray:
    """KL of the histograms of gaps between a bar's onsets, (bar, step) per side, over a range that both sides share."""
    gaps, top = [], np.zeros(n)
    for bar, step in sides:
        order = np.lexsort((step, bar))
        bar, step = bar[order], step[order]
        gap = np.diff(step)
        kept = (np.diff(bar) == 0) & (gap > 0)
        gaps.append((bar[1:][kept], gap[kept]))
        np.maximum.at(top, *gaps[-1])
    hist, seen = [], []
    for bar, gap in gaps:
        at = np.floor((gap - 1) * bins / top[bar]).astype(np.int64)
        counts = np.bincount(bar * bins + at, minlength=n * bins).reshape(n, bins)
        seen.append(counts.sum(axis=1))
        hist.append(np.maximum(counts / np.maximum(seen[-1], 1)[:, None], KL_FLOOR))
    p, q = hist
    zp, zq = p.sum(axis=1), q.sum(axis=1)
    kl = (p * np.log(p / q)).sum(axis=1) / zp + np.log(zq / zp)
    return np.where(seen[0] == 0, 0.0, np.where(seen[1] == 0, np.inf, kl + 0.0))
