"""Vector tables: PCA, linear probes, silhouette, latent statistics, distances.

A vector table has key columns and ``z`` (array of numbers of one length D). D is a
model constant; nothing here grows with the number of rows outside the executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staffline.functions import vectors as V
from staffline.operators.numbering import durable, exact_fraction, exact_sample, sample_key, sequence_ahead

PROBE_TRAIN = 0.8
#: Most rows and most numbers of a tile of vectors, and the tiles that give enough tasks.
TILE_ROWS, TILE_NUMBERS, MIN_TILES = 1 << 16, 1 << 23, 8


def doubles(column: str) -> Column:
    return F.transform(F.col(column), lambda v: v.cast("double"))


# --- per-row latent statistics --------------------------------------------------------------


def channel_variance(latents: DataFrame, keys: Sequence[str], channels: int, area: int, z: str = "z") -> DataFrame:
    """Mean, minimum and maximum over channels of the sample variance over positions."""
    per = F.transform(
        F.sequence(F.lit(0), F.lit(channels - 1)),
        lambda c: V.sample_variance(F.slice(F.col(z), c * area + 1, area)),
    )
    out = latents.select(*keys, per.alias("_v"))
    return out.select(
        *keys, (V.total(F.col("_v")) / channels).alias("latent_variance_mean"),
        F.array_min("_v").alias("latent_variance_min"), F.array_max("_v").alias("latent_variance_max"),
    )


def channel_correlation(latents: DataFrame, keys: Sequence[str], channels: int, area: int, z: str = "z") -> DataFrame:
    """Mean and maximum absolute Pearson r over channel pairs; constant channels are skipped."""
    pairs = list(combinations(range(channels), 2))
    if not pairs:
        zero = F.lit(0.0)
        return latents.select(*keys, zero.alias("latent_channel_correlation_mean"), zero.alias("latent_channel_correlation_max"))
    fixed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    part = lambda i: F.slice(F.col(z), i * area + 1, area)
    rs = F.filter(
        F.transform(fixed, lambda p: F.abs(V.array_pearson(part(p["a"]), part(p["b"])))), lambda r: r.isNotNull()
    )
    out = latents.select(*keys, rs.alias("_r"))
    return out.select(
        *keys,
        F.coalesce(F.try_divide(V.total(F.col("_r")), F.size("_r")), F.lit(0.0)).alias("latent_channel_correlation_mean"),
        F.coalesce(F.array_max("_r"), F.lit(0.0)).alias("latent_channel_correlation_max"),
    )


def channel_means(latents: DataFrame, channels: int, area: int, mu: str = "z_mu", sigma: str = "z_sigma") -> DataFrame:
    """(channel, mu_mean, sigma_mean) over all rows and positions."""
    c = F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("channel")
    part = lambda col: V.total(F.slice(F.col(col), F.col("channel") * area + 1, area)) / area
    rows = latents.select(mu, sigma, c)
    return rows.groupBy("channel").agg(F.avg(part(mu)).alias("mu_mean"), F.avg(part(sigma)).alias("sigma_mean"))


# --- PCA --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Pca:
    """A fitted linear model: mean (D), components (k x D) and explained variance ratios (k)."""

    mean: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]
    explained: tuple[float, ...]

    def _table(self) -> Column:
        return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in self.components])

    def encode(self, z: Column) -> Column:
        """Coordinates of the centred vector on each component."""
        mean = F.array(*[F.lit(float(v)) for v in self.mean])
        return V.let(V.difference(z, mean), lambda d: F.transform(self._table(), lambda row: V.dot(row, d)))

    def decode(self, s: Column) -> Column:
        mean = F.array(*[F.lit(float(v)) for v in self.mean])
        columns = F.array(*[F.array(*[F.lit(float(r[i])) for r in self.components]) for i in range(len(self.mean))])
        return F.zip_with(F.transform(columns, lambda col: V.dot(col, s)), mean, lambda a, b: a + b)


def gram(df: DataFrame, keys: Sequence[str], z: str, block: Sequence[str] = ()) -> DataFrame:
    """(keys, i, v): sums of the upper-triangle products z_a * z_b, flattened, by group.

    Each task multiplies the rows it holds (one matrix product per group and batch) and
    emits D * D sums, which a plain aggregate adds up. ``block`` columns split a hot
    group over tasks.
    """
    by = [*keys, *block]
    rows = df.select(*by, doubles(z).alias("z"))
    if by:
        rows = rows.repartition(*by).sortWithinPartitions(*by)
    fields = {f.name: f.dataType for f in rows.schema.fields}
    schema = ", ".join([f"{k} {fields[k].simpleString()}" for k in keys] + ["i int", "v double"])

    def partial(batches):
        for pdf in batches:
            groups = pdf.groupby(list(keys), sort=False) if keys else [((), pdf)]
            for key, g in groups:
                x = np.stack(g["z"].to_numpy())
                flat = (x.T @ x).reshape(-1)
                out = pd.DataFrame({"i": np.arange(len(flat), dtype=np.int32), "v": flat})
                for name, value in zip(keys, key if isinstance(key, tuple) else (key,)):
                    out[name] = value
                yield out[[*keys, "i", "v"]]

    return rows.mapInPandas(partial, schema).groupBy(*keys, "i").agg(F.sum("v").alias("v"))


def fit_pca(df: DataFrame, k: int, z: str = "z") -> Pca:
    """Centre and keep the top ``min(k, N, D)`` components.

    Spark sums the D x D products; the driver only decomposes that fixed-size matrix.
    Signs are fixed by making the largest loading of a component positive.
    """
    stats = df.select(array_to_vector(doubles(z)).alias("v")).agg(
        Summarizer.metrics("count", "mean").summary(F.col("v")).alias("s")
    ).select("s.count", "s.mean").first()
    n, mean = int(stats["count"]), np.asarray(stats["mean"].toArray())
    if n == 0:
        raise ValueError("cannot fit on an empty table")
    d = len(mean)
    shifted = df.select(V.difference(F.col(z), F.array(*[F.lit(float(m)) for m in mean])).alias("z"))
    entries = gram(shifted, (), "z").toPandas()
    cov = np.zeros(d * d)
    cov[entries["i"].to_numpy()] = entries["v"].to_numpy()
    values, axes = np.linalg.eigh(cov.reshape(d, d))
    order = np.argsort(values)[::-1][: min(k, n, d)]
    comps = axes[:, order].T
    signs = np.sign(comps[np.arange(len(comps)), np.abs(comps).argmax(axis=1)])
    comps = comps * np.where(signs == 0, 1.0, signs)[:, None]
    values = np.clip(values, 0.0, None)
    total = values.sum()
    ratio = values[order] / total if total > 0 else np.zeros(len(order))
    return Pca(tuple(mean), tuple(map(tuple, comps)), tuple(ratio))


def reconstruction_loss(df: DataFrame, model: Pca, z: str = "z") -> DataFrame:
    """Mean squared error of decode(encode(z)), averaged over rows."""
    gap = V.let(V.difference(F.col(z), model.decode(model.encode(doubles(z)))), lambda e: V.dot(e, e) / F.size(e))
    return df.select(gap.alias("mse")).agg(F.avg("mse").alias("mse"), F.count(F.lit(1)).alias("n"))


# --- supervised and geometric scores -----------------------------------------------------


def probe_accuracy(
    df: DataFrame, keys: Sequence[str], label: str, z: str = "z", seed: int = 42, max_iter: int = 200, c: float = 1.0
) -> float:
    """Held-out accuracy of a multinomial logistic regression, 80/20 seeded split.

    NaN with fewer than four rows, a single class or an empty test side. ``df`` is read several times: write it down where it is costly.
    """
    rows = df.select(*keys, F.col(label).cast("string").alias("_label"), array_to_vector(doubles(z)).alias("features"))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_label").alias("k")).first()
    if sizes["n"] < 4 or sizes["k"] < 2:
        return float("nan")
    # Class names become consecutive numbers; there is one small row per class.
    names = rows.groupBy("_label").count().select("_label").orderBy("_label")
    codes = names.withColumn("label", (F.row_number().over(Window.orderBy("_label")) - 1).cast("double"))
    rows = rows.join(F.broadcast(codes), "_label")
    n = max(1, int(PROBE_TRAIN * sizes["n"]))
    if n >= sizes["n"]:
        return float("nan")
    # The sample is all rows up to the last one in the order of a seeded hash, so only keys are dealt for it and vectors stay where they are.
    place = F.struct(sample_key(seed, *keys).alias("_h"), *keys)
    last = exact_fraction(rows.select(*keys), PROBE_TRAIN, keys, seed=seed).agg(F.max(place).alias("p")).first()["p"]
    kinds = {f.name: f.dataType for f in rows.select(*keys).schema.fields}
    cut = F.struct(F.lit(last["_h"]).alias("_h"), *[F.lit(last[k]).cast(kinds[k]).alias(k) for k in keys])
    model = LogisticRegression(
        family="multinomial", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter
    ).fit(rows.where(place <= cut).select("features", "label"))
    hit = model.transform(rows.where(place > cut)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a")).first()
    return float("nan") if hit["a"] is None else float(hit["a"])


def dominant_pitch_label(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, label): pitch class of the most active pitch, the lowest pitch on a tie."""
    counts = segments.groupBy(*keys, "pitch").agg(F.sum(F.col("off") - F.col("on")).alias("n"))
    best = counts.groupBy(*keys).agg(F.max(F.col("n") * 128 + (127 - F.col("pitch"))).alias("c"))
    return best.select(*keys, ((127 - F.col("c") % 128) % 12).cast("int").alias("label"))


def class_distances(df: DataFrame, keys: Sequence[str], label: str, z: str = "z", tile: int = TILE_ROWS) -> DataFrame:
    """(uid, own, w, other, n, s): number and sum of Euclidean distances from a row of class ``own`` to all other rows of each class.

    Rows of one vector and class have equal distances, so they are one row here, ``w`` says how many. Exact and over all pairs of distinct
    vectors, which is quadratic work, done in tiles: vectors are dealt to at least ``MIN_TILES`` tiles (one per 2,048 where there are fewer) of at most
    ``tile`` rows and ``TILE_NUMBERS`` numbers, every two tiles meet once in a task of their own as two matrices, and only sums per vector and
    class leave it. A vector is copied once per tile, no pair is ever a row, and nothing is broadcast.
    """
    rows = df.select(F.col(label).cast("string").alias("label"), doubles(z).alias("z")).where(F.col("z").isNotNull() & F.col("label").isNotNull())
    counts = rows.groupBy("z", "label").agg(F.count(F.lit(1)).alias("w"))
    members = F.sort_array(F.collect_list(F.struct("label", "w")))
    own = counts.groupBy("z").agg(members.alias("m")).select(
        "z", F.transform("m", lambda m: m["label"]).alias("labels"), F.transform("m", lambda m: m["w"]).alias("ws")
    )
    own = durable(own.withColumn("uid", F.monotonically_increasing_id()))
    size = own.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("z")).alias("d")).first()
    most = max(1, min(tile, TILE_NUMBERS // max(1, size["d"] or 1)))
    tiles = max(1, -(-size["n"] // most), min(MIN_TILES, -(-size["n"] // 2048)))
    placed = own.withColumn("t", F.pmod(F.xxhash64("uid"), F.lit(tiles)).cast("int"))
    part = ["uid", "labels", "ws", "z"]
    left = placed.select(F.col("t").alias("a"), F.explode(F.sequence("t", F.lit(tiles - 1))).alias("b"), *part).groupBy("a", "b")
    right = placed.where("t > 0").select(F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("a"), F.col("t").alias("b"), *part).groupBy("a", "b")

    def member(y: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Classes, and how many rows of each a vector stands for."""
        names, codes = np.unique(np.concatenate(y["labels"].to_numpy()).astype(str), return_inverse=True)
        out = np.zeros((len(y), len(names)))
        out[np.repeat(np.arange(len(y)), y["labels"].map(len)), codes] = np.concatenate(y["ws"].to_numpy())
        return names, out

    def table(*sides: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> pd.DataFrame:
        """Rows of (vectors, classes, rows of each class, sums)."""
        flat = lambda kind, parts: np.concatenate([np.empty(0, kind), *parts]).astype(kind)
        return pd.DataFrame({
            "uid": flat(np.int64, [np.repeat(uid, len(names)) for uid, names, _, _ in sides]), "other": pd.Series(flat(object, [np.tile(names.astype(object), len(uid)) for uid, names, _, _ in sides]), dtype=object),
            "n": flat(np.int64, [np.tile(there.sum(0), len(uid)) for uid, _, there, _ in sides]), "s": flat(float, [sums.reshape(-1) for _, _, _, sums in sides]),
        })

    def meet(key, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        same = key[0] == key[1]
        y = x if same else y
        if x.empty or y.empty:
            return table()
        here, there = np.stack(x["z"].to_numpy()), np.stack(y["z"].to_numpy())
        (names, count), (x_names, x_count) = member(y), member(x)
        square, sums, back = (there**2).sum(1), np.empty((len(x), len(names))), np.zeros((len(y), len(x_names)))
        for start in range(0, len(x), 128):
            some = slice(start, start + 128)
            gap = np.matmul(here[some], there.T)
            gap *= -2
            gap += square
            gap += (here[some] ** 2).sum(1)[:, None]
            np.sqrt(np.maximum(gap, 0.0, out=gap), out=gap)
            if same:
                gap[np.arange(len(gap)), np.arange(start, start + len(gap))] = 0.0
            sums[some] = gap @ count
            if not same:
                back += gap.T @ x_count[some]
        forth = (x["uid"].to_numpy(), names, count, sums)
        return table(forth) if same else table(forth, (y["uid"].to_numpy(), x_names, x_count, back))

    sums = left.cogroup(right).applyInPandas(meet, "uid bigint, other string, n bigint, s double")
    sums = sums.groupBy("uid", "other").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    classes = own.select("uid", F.explode(F.arrays_zip("labels", "ws")).alias("m")).select("uid", F.col("m.labels").alias("own"), F.col("m.ws").alias("w"))
    return classes.join(sums, "uid").select("uid", "own", "w", "other", (F.col("n") - (F.col("own") == F.col("other")).cast("bigint")).alias("n"), "s")


def silhouette(
    df: DataFrame, keys: Sequence[str], label: str, z: str = "z", *, rows: int | None = None, seed: int = 42, tile: int = TILE_ROWS
) -> DataFrame:
    """Euclidean silhouette of all rows, or of a seeded sample of at most ``rows``, from exact distances.

    A class of one row scores 0. NaN with fewer than four rows or one class.
    """
    chosen = df if rows is None else exact_sample(df.select(*keys, label, z), rows, keys, seed=seed)
    own = F.col("own") == F.col("other")
    each = class_distances(chosen, keys, label, z, tile).groupBy("uid", "own").agg(
        F.max("w").alias("w"), F.max(F.when(own & (F.col("n") > 0), F.col("s") / F.col("n"))).alias("inner"), F.min(F.when(~own, F.col("s") / F.col("n"))).alias("outer")
    )
    top = F.greatest("inner", "outer")
    score = F.when(F.col("inner").isNull() | (top <= 0), 0.0).otherwise((F.col("outer") - F.col("inner")) / top)
    out = each.agg((F.sum(score * F.col("w")) / F.sum("w")).alias("v"), F.sum("w").alias("n"), F.count_distinct("own").alias("k"))
    return out.select(F.when((F.col("n") >= 4) & (F.col("k") >= 2), F.col("v")).otherwise(float("nan")).alias("silhouette_score"))


def silhouette_squared(df: DataFrame, keys: Sequence[str], label: str, z: str = "z", max_labels: int = 10_000) -> DataFrame:
    """Silhouette with squared distances over every row, exact and linear in the rows.

    The mean squared distance from a row to a class follows from the class's size, vector sum and sum of
    squares, so these (at most ``max_labels`` classes of D numbers, else an error) are all that is shared. A class of
    one row scores 0. NaN with fewer than four rows or one class.
    """
    rows = df.select(*keys, F.col(label).cast("string").alias("label"), doubles(z).alias("z"))
    sums = rows.select("label", F.posexplode("z").alias("i", "v")).groupBy("label", "i").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")
    )
    packed = sums.groupBy("label").agg(
        F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("s"), F.sum("q").alias("q")
    ).orderBy("label").limit(max_labels + 1).toPandas()
    if len(packed) > max_labels:
        raise ValueError(f"more than {max_labels} classes")
    if len(packed) < 2 or packed["n"].sum() < 4:
        return df.sparkSession.range(1).select(F.lit(float("nan")).alias("silhouette_score"))
    names, size = packed["label"].to_numpy(dtype=str), packed["n"].to_numpy(dtype=float)
    total, square = np.stack(packed["s"].to_numpy()), packed["q"].to_numpy(dtype=float)

    def score(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            y = np.stack(pdf["z"].to_numpy())
            far = np.maximum(size * (y**2).sum(1)[:, None] + square - 2 * y @ total.T, 0.0)
            own, at = np.searchsorted(names, pdf["label"].to_numpy(dtype=str)), np.arange(len(y))
            inner = far[at, own] / np.maximum(size[own] - 1, 1)
            means = far / size
            means[at, own] = np.inf
            outer = means.min(axis=1)
            top = np.maximum(inner, outer)
            yield pd.DataFrame({"s": np.where((size[own] <= 1) | (top <= 0), 0.0, (outer - inner) / np.where(top > 0, top, 1.0))})

    return rows.select("label", "z").mapInPandas(score, "s double").agg(F.avg("s").alias("silhouette_score"))


def smoothness(df: DataFrame, by: Sequence[str], order: str, z: str = "z") -> DataFrame:
    """Mean length of first and second differences along an ordered sequence.

    Fewer than two rows give NaN for both, two rows NaN for the second difference.
    """
    rows = df.select(*by, order, doubles(z).alias("z"))
    two = sequence_ahead(rows, by, order, ["z"], {"n1_": 1, "n2_": 2})
    first = V.distance(F.col("n1_z"), F.col("z"))
    bend = V.norm(F.zip_with(V.difference(F.col("n2_z"), F.col("n1_z")), V.difference(F.col("n1_z"), F.col("z")), lambda a, b: a - b))
    nan = F.lit(float("nan"))
    return two.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(F.col("n2_z").isNotNull(), bend)), nan).alias("interpolation_smoothness"),
        F.coalesce(F.avg(F.when(F.col("n1_z").isNotNull(), first)), nan).alias("interpolation_step_size"),
        F.count(F.lit(1)).alias("interpolation_n_steps"),
    )


def self_similarity(df: DataFrame, by: Sequence[str], z: str = "z") -> DataFrame:
    """Mean and spread of the cosine over all pairs of a sequence, without pairs.

    With unit vectors u and G = sum u u': the sum of cosines over ordered pairs is
    |sum u|^2 - n', the sum of their squares is |G|^2 - n', n' counting the non-zero
    vectors. Linear in the rows. Where a batch has more than D vectors of one sequence they travel as the D rows of
    their QR factor, which have the same G, so a hot sequence sends D rows per batch; a short one sends its
    own vectors, and |G| is taken from the smaller of the two Gram matrices. G itself never leaves a task.
    """
    rows = df.select(*by, V.unit(doubles(z)).alias("u")).where("u IS NOT NULL")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields)
    keys = list(by)

    def pack(batches):
        for pdf in batches:
            live = pdf["u"].map(lambda u: float(u @ u) > 0.25).astype("int64")
            out = pdf.assign(s=None, n=1, nz=live)  # a vector that stands for itself is sent once
            width = len(pdf["u"].iloc[0]) if len(pdf) else 0
            many = out.groupby(keys, sort=False, dropna=False)["n"].transform("size") > width
            yield out[~many]
            for _, g in out[many].groupby(keys, sort=False, dropna=False):
                x = np.stack(g["u"].to_numpy())
                few = g.iloc[:width].copy()
                few["u"] = list(np.linalg.qr(x, mode="r"))
                few["s"] = pd.Series([x.sum(0)] + [np.zeros(width)] * (width - 1), few.index)
                few["n"] = [len(g)] + [0] * (width - 1)
                few["nz"] = [int(g["nz"].sum())] + [0] * (width - 1)
                yield few

    def whole(pdf):
        u, total = np.stack(pdf["u"].to_numpy()), np.stack(pdf["s"].where(pdf["s"].notna(), pdf["u"]).to_numpy()).sum(0)
        square = u @ u.T if len(u) <= u.shape[1] else u.T @ u
        out = pdf.iloc[:1][keys].copy()
        return out.assign(n=pdf["n"].sum(), nz=pdf["nz"].sum(), ss=float(total @ total), gg=float((square**2).sum()))

    packed = rows.mapInPandas(pack, f"{kinds}, u array<double>, s array<double>, n bigint, nz bigint")
    joined = packed.groupBy(*by).applyInPandas(whole, f"{kinds}, n bigint, nz bigint, ss double, gg double")
    pairs = F.col("n") * (F.col("n") - 1)
    mean = F.try_divide(F.col("ss") - F.col("nz"), pairs)
    second = F.try_divide(F.col("gg") - F.col("nz"), pairs)
    nan = F.lit(float("nan"))
    return joined.select(
        *by,
        F.coalesce(mean, nan).alias("self_similarity_mean"),
        F.coalesce(F.sqrt(F.greatest(F.lit(0.0), second - mean * mean)), nan).alias("self_similarity_std"),
        F.col("n").alias("self_similarity_n_bars"),
    )


def disentanglement(df: DataFrame, keys: Sequence[str], label: str, z: str = "z", tile: int = TILE_ROWS) -> DataFrame:
    """(inter - intra) / inter, the mean distances over all pairs of one label and of two labels.

    NaN with fewer than four rows, one class, no pair of one class, or no inter-class distance.
    """
    own = F.col("own") == F.col("other")
    part = lambda c, which: F.sum(F.when(which, F.col(c) * F.col("w")))
    sums = class_distances(df, keys, label, z, tile).agg(
        F.try_divide(part("s", own), part("n", own)).alias("intra"), F.try_divide(part("s", ~own), part("n", ~own)).alias("inter"),
        F.sum(F.when(own, F.col("w"))).alias("rows"),
    )
    ok = (F.col("rows") >= 4) & F.col("intra").isNotNull() & (F.col("inter") >= 1e-10)
    nan = F.lit(float("nan"))
    return sums.select(
        F.when(ok, F.try_divide(F.col("inter") - F.col("intra"), F.col("inter"))).otherwise(nan).alias("disentanglement_score"),
        F.when(ok, F.col("intra")).otherwise(nan).alias("intra_class_distance"),
        F.when(ok, F.col("inter")).otherwise(nan).alias("inter_class_distance"),
    )
