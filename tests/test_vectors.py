import math
from itertools import combinations

import numpy as np
import pytest
from helpers import one
from pyspark.sql import functions as F

from staffline.operators import codec
from staffline.operators import sequences as S
from staffline.operators import vectors as M


def table(spark, x, label=None, song=None):
    n = len(x)
    label = label if label is not None else [0] * n
    song = song if song is not None else [0] * n
    rows = [(i, int(song[i]), str(label[i]), [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "id BIGINT, song BIGINT, label STRING, z ARRAY<DOUBLE>").repartition(5)


def test_pca_matches_svd(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 32)) + rng.normal(size=32) + 0.01 * rng.normal(size=(200, 32))
    df = table(spark, x)
    m = M.fit_pca(df, 8)
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(m.explained, (s**2 / (s**2).sum())[:8], atol=1e-9)
    for a, b in zip(m.components[:4], vt):
        assert abs(np.dot(a, b)) == pytest.approx(1.0, abs=1e-6)
    code = df.select("id", m.encode(F.col("z")).alias("s")).orderBy("id").collect()
    assert np.allclose([r["s"] for r in code], c @ np.array(m.components).T, atol=1e-8)
    assert one(M.reconstruction_loss(df, m))["mse"] < 0.1
    assert len(M.fit_pca(table(spark, x[:3]), 8).components) == 3


def pairs(x):
    unit = [v / np.linalg.norm(v) if np.linalg.norm(v) > 1e-10 else np.zeros_like(v) for v in x]
    return np.array([a @ b for a, b in combinations(unit, 2)])


def test_self_similarity_equals_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    x[3] = 0  # a zero vector
    song = [0] * 50 + [1] * 9 + [2]
    df = table(spark, x, song=song)
    got = {r["song"]: r for r in M.self_similarity(df, ["song"]).collect()}
    for s in (0, 1):
        sims = pairs(x[np.array(song) == s])
        assert got[s]["self_similarity_mean"] == pytest.approx(sims.mean(), abs=1e-9)
        assert got[s]["self_similarity_std"] == pytest.approx(sims.std(), abs=1e-9)
    assert math.isnan(got[2]["self_similarity_mean"]) and got[2]["self_similarity_n_bars"] == 1


def test_smoothness(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(14, 3))
    song = [0] * 11 + [1] * 2 + [2]
    got = {r["song"]: r for r in M.smoothness(table(spark, x, song=song), ["song"], "id").collect()}
    d = np.diff(x[:11], axis=0)
    assert got[0]["interpolation_step_size"] == pytest.approx(np.linalg.norm(d, axis=1).mean())
    assert got[0]["interpolation_smoothness"] == pytest.approx(np.linalg.norm(np.diff(d, axis=0), axis=1).mean())
    assert math.isnan(got[1]["interpolation_smoothness"]) and not math.isnan(got[1]["interpolation_step_size"])
    assert math.isnan(got[2]["interpolation_step_size"])


def test_silhouette_and_its_limits(spark):
    rng = np.random.default_rng(3)
    label = rng.integers(0, 3, 40)
    label[0] = 7  # a class of one
    x = rng.normal(size=(40, 4)) + label[:, None]
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    s = []
    for i in range(40):
        own = label == label[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][label == k].mean() for k in set(label.tolist()) if k != label[i])
        s.append((b - a) / max(a, b))
    df = table(spark, x, label)
    assert one(M.silhouette(df, ["id"], "label", tile=7))["silhouette_score"] == pytest.approx(np.mean(s), abs=1e-6)
    assert not math.isnan(one(M.silhouette(df, ["id"], "label", rows=20))["silhouette_score"])
    assert math.isnan(one(M.silhouette(df.filter("label = '1'"), ["id"], "label", rows=1000))["silhouette_score"])


def test_squared_silhouette_reads_every_row(spark):
    rng = np.random.default_rng(5)
    label = rng.integers(0, 3, 60)
    label[0] = 7
    x = rng.normal(size=(60, 4)) + label[:, None]
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    s = []
    for i in range(60):
        own = label == label[i]
        a = d[i][own].sum() / max(own.sum() - 1, 1)
        b = min(d[i][label == k].mean() for k in set(label.tolist()) if k != label[i])
        s.append((b - a) / max(a, b) if own.sum() > 1 else 0.0)
    df = table(spark, x, label)
    assert one(M.silhouette_squared(df, ["id"], "label"))["silhouette_score"] == pytest.approx(np.mean(s))
    assert math.isnan(one(M.silhouette_squared(df.filter("label = '1'"), ["id"], "label"))["silhouette_score"])


def test_probe(spark):
    rng = np.random.default_rng(4)
    label = rng.integers(0, 3, 150)
    df = table(spark, np.eye(3)[label] * 5 + 0.1 * rng.normal(size=(150, 3)), label)
    assert M.probe_accuracy(df, ["id"], "label") == 1.0
    assert math.isnan(M.probe_accuracy(df.filter("label = '0'"), ["id"], "label"))
    assert math.isnan(M.probe_accuracy(df.limit(3), ["id"], "label"))


def test_disentanglement(spark):
    rng = np.random.default_rng(5)
    label = np.arange(200) % 4
    x = rng.normal(size=(200, 6)) * 0.1 + 10 * np.eye(6)[label]
    r = one(M.disentanglement(table(spark, x, label), ["id"], "label", tile=33))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    same = (label[:, None] == label[None]) & ~np.eye(200, dtype=bool)
    assert r["intra_class_distance"] == pytest.approx(d[same].mean())
    assert r["inter_class_distance"] == pytest.approx(d[label[:, None] != label[None]].mean())
    assert r["disentanglement_score"] == pytest.approx(1 - r["intra_class_distance"] / r["inter_class_distance"])
    assert math.isnan(one(M.disentanglement(table(spark, x, [0] * 200), ["id"], "label"))["disentanglement_score"])


def test_channel_statistics(spark):
    rng = np.random.default_rng(6)
    z = rng.normal(size=(3, 4, 9))
    z[0, 2] = 1.0  # a constant channel
    df = table(spark, z.reshape(3, -1))
    var = z[0].var(axis=1, ddof=1)
    r = M.channel_variance(df, ["id"], 4, 9).filter("id = 0").first()
    assert (r["latent_variance_mean"], r["latent_variance_min"], r["latent_variance_max"]) == pytest.approx((var.mean(), var.min(), var.max()))
    r = M.channel_correlation(df, ["id"], 4, 9).filter("id = 0").first()
    cs = [abs(np.corrcoef(z[0, a], z[0, b])[0, 1]) for a, b in combinations([0, 1, 3], 2)]
    assert r["latent_channel_correlation_mean"] == pytest.approx(np.mean(cs)) and r["latent_channel_correlation_max"] == pytest.approx(max(cs))
    assert M.channel_correlation(df, ["id"], 1, 36).first()["latent_channel_correlation_mean"] == 0.0


def test_hashed_noise_is_standard_and_stable(spark):
    df = spark.range(20000)
    e = df.select(codec.hashed_normal(1, F.col("id")).alias("e"))
    s = e.agg(F.avg("e").alias("m"), F.stddev("e").alias("s")).first()
    assert abs(s["m"]) < 0.03 and abs(s["s"] - 1) < 0.03
    again = df.repartition(7).select(codec.hashed_normal(1, F.col("id")).alias("e"))
    assert e.exceptAll(again).count() == 0


def test_windows_pad_pairs(spark):
    song = [0] * 37 + [1] * 5 + [2]
    x = np.arange(len(song) * 2).reshape(-1, 2)
    df = table(spark, x, song=song)
    win = S.windows(df, ["song"], "id")
    got = sorted((r["song"], r["window"], r["n"]) for r in win.collect())
    assert got == [(0, 0, 16), (0, 1, 16), (1, 0, 5)]
    w = S.pad_windows(win, 16, 2).filter("song = 1").first()
    assert len(w["vectors"]) == 16 and w["vectors"][5] == [0.0, 0.0] and w["vectors"][0] == [74.0, 75.0]
    tp = S.teacher_pairs(df, ["song"], "id")
    assert tp.count() == 36 + 4 and S.prediction_mse(tp).first()["mse"] == pytest.approx(4.0)
    run = S.causal_mean(df.withColumn("v", F.col("z")[0]), ["song"], "id", "v").orderBy("id").collect()
    assert run[36]["running_mean"] == pytest.approx(x[:37, 0].mean())


def test_conditions_and_ids(spark):
    df = spark.createDataFrame([("bass", 500.0, 6, 8), ("harp", 60.0, 9, 9)], "i STRING, t DOUBLE, n INT, d INT")
    a, b = df.select(*S.condition_features(F.col("i"), F.col("t"), F.col("n"), F.col("d"))).collect()
    assert (a["instrument_index"], a["tempo_share"], a["signature"].index(1.0)) == (3, 1.0, 3)
    assert (b["instrument_index"], b["tempo_share"], b["signature"].index(1.0)) == (5, 0.25, 0)
    assert spark.range(1).select(S.song_of(F.lit("my_song_piano_0003"))).first()[0] == "my_song"
