import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from staffline.functions import taps, vectors as V, words


def test_kl_entropy_cosine_match_numpy(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(20):
        p, q = rng.random(12) * (rng.random(12) > 0.4), rng.random(12) * (rng.random(12) > 0.4)
        rows.append((p.tolist(), q.tolist()))
    df = spark.createDataFrame(rows, "p ARRAY<DOUBLE>, q ARRAY<DOUBLE>")
    p, q = V.normalise(F.col("p")), V.normalise(F.col("q"))
    got = df.select(V.kl_divergence(p, q).alias("kl"), V.entropy(p).alias("h"), V.cosine(p, q).alias("c")).collect()
    for (a, b), r in zip(rows, got):
        a, b = np.array(a) / max(sum(a), 1e-300), np.array(b) / max(sum(b), 1e-300)
        x, y = np.clip(a, 1e-10, None), np.clip(b, 1e-10, None)
        x, y = x / x.sum(), y / y.sum()
        assert r["kl"] == pytest.approx(np.sum(x * np.log(x / y)), abs=1e-9)
        e = np.clip(a, 1e-12, None)
        e = e / e.sum()
        assert r["h"] == pytest.approx(-np.sum(e * np.log(e)), abs=1e-9)
        assert r["c"] == pytest.approx(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), abs=1e-9)


def test_silence_conventions(spark):
    z = F.array(*[F.lit(0.0)] * 128)
    r = spark.range(1).select(
        V.entropy(z).alias("uniform"), V.entropy(z, silent=0.0).alias("zero"), V.cosine(z, z).alias("c")
    ).first()
    assert r["uniform"] == pytest.approx(math.log(128)) and r["zero"] == 0.0 and r["c"] == 0.0


def test_pearson_guard_and_value(spark):
    x, y = np.array([1.0, 4, 2, 8, 0]), np.array([2.0, 3, 9, 1, 1])
    lit = lambda v: F.lit(float(v))
    sums = lambda a, b: [lit(a.sum()), lit(b.sum()), lit(a @ a), lit(b @ b), lit(a @ b)]
    flat = np.full(5, 3.0)
    r = spark.range(1).select(V.pearson(5, *sums(x, y)).alias("r"), V.pearson(5, *sums(flat, y)).alias("f")).first()
    assert r["r"] == pytest.approx(np.corrcoef(x, y)[0, 1]) and r["f"] == 0.0


def test_words_behave_like_sets(spark):
    values = [0, 5, 31, 32, 33, 63, 64, 95]
    df = spark.createDataFrame([(v,) for v in values + [-1, 96, 200]], "v INT")
    w = df.agg(*words.named(words.collect_words(F.col("v"), 96), "w"))
    cols = words.columns("w", 96)
    r = w.select(
        words.members(cols, 96).alias("m"), words.count(cols).alias("n"),
        words.members(words.shift_up(cols, 1), 96).alias("s1"), words.members(words.shift_up(cols, 40), 96).alias("s40"),
        words.members(words.minus(cols, words.shift_up(cols, 1)), 96).alias("d"),
    ).first()
    assert r["m"] == values and r["n"] == len(values)
    assert r["s1"] == [v + 1 for v in values if v + 1 < 96]
    assert r["s40"] == [v + 40 for v in values if v + 40 < 96]
    assert r["d"] == [v for v in values if v - 1 not in values]


@pytest.mark.parametrize("method", taps.METHODS)
@pytest.mark.parametrize("sizes", [(96, 128), (128, 96), (7, 3), (5, 5)])
def test_weights_sum_to_one(method, sizes):
    for w in taps.taps(*sizes, method):
        assert sum(w.values()) == pytest.approx(1.0)


def test_bilinear_matches_interp(spark):
    x = np.array([1.0, 5, 2, 7, 3, 0, 4])
    centre = np.clip((np.arange(11) + 0.5) * 7 / 11 - 0.5, 0, None)
    want = np.interp(centre, np.arange(7), x)
    got = spark.range(1).select(taps.resample(F.array(*[F.lit(v) for v in x]), 7, 11).alias("v")).first()["v"]
    assert np.allclose(got, want)


def test_bad_resize_arguments():
    with pytest.raises(ValueError):
        taps.taps(4, 4, "lanczos")
    with pytest.raises(ValueError):
        taps.taps(4, 0)
