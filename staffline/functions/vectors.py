"""Column functions over histograms and vectors held as arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The guards below which a spread or a norm counts as zero, and
# the floor put under probabilities before a logarithm.
FLAT_STD = 1e-8
ZERO_NORM = 1e-10
KL_FLOOR = 1e-10
ENTROPY_FLOOR = 1e-12


def plus_zero(x: Column) -> Column:
    """Turn a negative zero into zero."""
    return x + F.lit(0.0)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    )


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def distance(a: Column, b: Column) -> Column:
    return norm(difference(a, b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 when either side is a zero vector."""
    na, nb = norm(a), norm(b)
    return F.when((na < ZERO_NORM) | (nb < ZERO_NORM), 0.0).otherwise(
        F.try_divide(dot(a, b), na * nb)
    )


def unit(a: Column) -> Column:
    """Scale to length 1; a zero vector gives zeros."""
    return let(
        norm(a),
        lambda n: F.transform(
            a, lambda v: F.when(n < ZERO_NORM, 0.0).otherwise(F.try_divide(v.cast("double"), n))
        ),
    )


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it inside ``body``, also within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalise(values: Column) -> Column:
    """Scale to sum 1; an all-zero array stays as it is."""
    return let(
        total(values),
        lambda s: F.transform(values, lambda v: F.when(s > 0, v / s).otherwise(v.cast("double"))),
    )


def entropy(values: Column, floor: float = ENTROPY_FLOOR, silent: float | None = None) -> Column:
    """Shannon entropy in nats of a distribution, zeros lifted to ``floor``.

    Two conventions exist for an all-zero input: with ``silent=None`` the floor
    makes it uniform (log n); otherwise the given value is returned.
    """
    s = total(values)
    lifted = let(
        s,
        lambda t: F.transform(
            values,
            lambda v: F.greatest(F.when(t > 0, v / t).otherwise(v.cast("double")), F.lit(floor)),
        ),
    )
    h = let(
        lifted,
        lambda p: F.log(total(p))
        - F.aggregate(p, F.lit(0.0), lambda a, v: a + v * F.log(v)) / total(p),
    )
    return h if silent is None else F.when(s < floor, F.lit(silent)).otherwise(h)


def entropy_from_sums(
    mass: Column, mass_log: Column, filled: Column, bins: int, floor: float = ENTROPY_FLOOR
) -> Column:
    """Entropy of a histogram from sum(c), sum(c*log c) and its number of filled bins.

    Equal to :func:`entropy` on the dense histogram; empty bins enter in closed form.
    """
    zeros = F.lit(bins) - filled
    z = 1.0 + zeros * floor
    s = F.try_divide(mass_log, mass) - F.log(mass) + zeros * floor * math.log(floor)
    return F.when(mass > 0, F.log(z) - s / z).otherwise(math.log(bins))


def kl_divergence(p: Column, q: Column, floor: float = KL_FLOOR) -> Column:
    """KL(p || q) after lifting zeros to ``floor`` and renormalising."""
    lift = lambda v: F.greatest(v.cast("double"), F.lit(floor))
    zp = F.aggregate(p, F.lit(0.0), lambda a, v: a + lift(v))
    zq = F.aggregate(q, F.lit(0.0), lambda a, v: a + lift(v))
    body = F.aggregate(
        F.zip_with(p, q, lambda x, y: lift(x) * F.log(lift(x) / lift(y))),
        F.lit(0.0),
        lambda a, v: a + v,
    )
    return body / zp + F.log(zq / zp)


def sparse_kl(pairs: Column, p_sum: Column, q_sum: Column, bins: int, floor: float = KL_FLOOR) -> Column:
    """KL of two histograms given as array<struct<p, q>> of the bins either side fills.

    Bins filled by neither side only add the floor to both normalisers, so
    nothing dense is built.
    """
    lift = lambda v, s: F.greatest(F.coalesce(F.try_divide(v, s), F.lit(0.0)), F.lit(floor))
    absent = (F.lit(bins) - F.size(pairs)) * floor
    zp = F.aggregate(pairs, F.lit(0.0), lambda a, e: a + lift(e["p"], p_sum)) + absent
    zq = F.aggregate(pairs, F.lit(0.0), lambda a, e: a + lift(e["q"], q_sum)) + absent
    body = F.aggregate(
        pairs,
        F.lit(0.0),
        lambda a, e: a
        + lift(e["p"], p_sum) * F.log(lift(e["p"], p_sum) / lift(e["q"], q_sum)),
    )
    return body / zp + F.log(zq / zp)


def pearson(
    n: Column | int | float,
    sx: Column,
    sy: Column,
    sxx: Column,
    syy: Column,
    sxy: Column,
    x_scale: Column | float = 1.0,
    y_scale: Column | float = 1.0,
) -> Column:
    """Pearson r from sums over ``n`` positions, absent positions counting as zero.

    0 when either side is flat. The spread guard applies to the values divided
    by ``x_scale`` and ``y_scale`` (histograms normalise before correlating).
    ``corr`` is not used: under ANSI it raises on a constant column.
    """
    n = F.lit(float(n)) if isinstance(n, (int, float)) else n.cast("double")
    sx, sy, sxx, syy, sxy = (c.cast("double") for c in (sx, sy, sxx, syy, sxy))
    vx = F.greatest(n * sxx - sx * sx, F.lit(0.0))
    vy = F.greatest(n * syy - sy * sy, F.lit(0.0))
    as_col = lambda s: F.lit(s) if isinstance(s, float) else s.cast("double")
    flat = (F.sqrt(vx) / n < as_col(x_scale) * FLAT_STD) | (F.sqrt(vy) / n < as_col(y_scale) * FLAT_STD)
    r = F.try_divide(n * sxy - sx * sy, F.sqrt(vx) * F.sqrt(vy))
    return F.when(flat, 0.0).otherwise(F.coalesce(r, F.lit(0.0)))


def slice_of(values: Column, index: Column, size: int) -> Column:
    """The ``index``-th run of ``size`` elements of a flattened array."""
    return F.slice(values, index * size + 1, size)


def centred(values: Column) -> Column:
    return let(
        total(values) / F.size(values),
        lambda m: F.transform(values, lambda v: v.cast("double") - m),
    )


def sample_variance(values: Column) -> Column:
    """Variance over n - 1; NULL for a single value."""
    return let(centred(values), lambda d: F.try_divide(dot(d, d), F.size(d) - 1))


def array_pearson(a: Column, b: Column) -> Column:
    """Pearson r of two arrays; NULL when either is constant."""
    return let(
        F.struct(centred(a).alias("a"), centred(b).alias("b")),
        lambda s: F.when(
            (norm(s["a"]) > 0) & (norm(s["b"]) > 0),
            F.try_divide(dot(s["a"], s["b"]), norm(s["a"]) * norm(s["b"])),
        ),
    )
