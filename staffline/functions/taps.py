"""One-dimensional resampling weights.

Every supported method is linear with weights that sum to one, so an image whose
background is constant can be resampled from its non-background pixels alone.
The tables depend only on the two sizes and are embedded in the plan.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METHODS = ("bilinear", "nearest", "bicubic", "area")


def _cubic(x: float, a: float = -0.75) -> float:
    x = abs(x)
    if x <= 1:
        return (a + 2) * x**3 - (a + 3) * x**2 + 1
    if x < 2:
        return a * (x**3 - 5 * x**2 + 8 * x - 4)
    return 0.0


def taps(n_in: int, n_out: int, method: str = "bilinear") -> list[dict[int, float]]:
    """For each target index, the source indices it reads and their weights."""
    if method not in METHODS:
        raise ValueError(f"unsupported resize method {method!r}; choose from {sorted(METHODS)}")
    if n_in <= 0 or n_out <= 0:
        raise ValueError("sizes must be positive")
    scale = n_in / n_out
    rows: list[dict[int, float]] = []
    for i in range(n_out):
        weights: dict[int, float] = {}

        def put(j: int, w: float) -> None:
            j = min(max(j, 0), n_in - 1)
            if w:
                weights[j] = weights.get(j, 0.0) + w

        if method == "nearest":
            put(math.floor(i * scale), 1.0)
        elif method == "area":
            first, last = i * n_in // n_out, -(-(i + 1) * n_in // n_out)
            for j in range(first, last):
                put(j, 1.0 / (last - first))
        elif method == "bilinear":
            centre = max((i + 0.5) * scale - 0.5, 0.0)
            base = math.floor(centre)
            put(base, 1.0 - (centre - base))
            put(base + 1, centre - base)
        else:
            centre = (i + 0.5) * scale - 0.5
            base = math.floor(centre)
            for k in range(-1, 3):
                put(base + k, _cubic(centre - base - k))
        rows.append(weights)
    return rows


def matrix(n_in: int, n_out: int, method: str = "bilinear") -> np.ndarray:
    """The weights as a matrix with a row per target."""
    out = np.zeros((n_out, n_in))
    rows = [{i: 1.0} for i in range(n_out)] if n_in == n_out else taps(n_in, n_out, method)
    for i, weights in enumerate(rows):
        out[i, list(weights)] = list(weights.values())
    return out


def scatter(index: Column, n_in: int, n_out: int, method: str) -> Column:
    """array<struct<to, w>> of the targets a source index contributes to."""
    targets: list[list[tuple[int, float]]] = [[] for _ in range(n_in)]
    for i, weights in enumerate(taps(n_in, n_out, method)):
        for j, w in weights.items():
            targets[j].append((i, w))
    kind = "array<array<struct<to:int,w:double>>>"
    table = F.from_json(
        F.lit("[" + ",".join(
            "[" + ",".join(f'{{"to":{i},"w":{w!r}}}' for i, w in t) + "]" for t in targets
        ) + "]"),
        kind,
    )
    return F.get(table, index)


def resample(values: Column, n_in: int, n_out: int, method: str = "bilinear") -> Column:
    """Resample a dense array of ``n_in`` values to ``n_out``."""
    if n_in == n_out:
        return values
    parts = []
    for weights in taps(n_in, n_out, method):
        acc = None
        for j, w in weights.items():
            term = F.get(values, F.lit(j)) * F.lit(w)
            acc = term if acc is None else acc + term
        parts.append(acc)
    return F.array(*parts)
