"""Steps whose work must not grow faster than their input."""

import os
import random

import numpy as np
import pytest
from helpers import plane as make_plane
from pyspark.sql import functions as F

from staffline.functions import taps
from staffline.keys import BAR
from staffline.operators import codec as C
from staffline.operators import image_metrics, linear
from staffline.operators import render as R
from staffline.operators import vectors as V
from staffline.plans import derived
from staffline.plans.catalog import QUERIES, load

load()
SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def weights(n_in, n_out, method):
    out = np.zeros((n_out, n_in))
    for i, row in enumerate(taps.taps(n_in, n_out, method)):
        for j, w in row.items():
            out[i, j] = w
    return out


@pytest.mark.parametrize("method", taps.METHODS)
@pytest.mark.parametrize("target", [(16, 12), (16, 6), (4, 12), (8, 12), (16, 3), (4, 3)])
def test_resize_of_every_kind_of_axis(spark, method, target):
    """Also F1: target pixels of an axis that grows are not grouped one by one."""
    x = np.zeros((8, 6))
    x[1, 2], x[7, 0], x[3, 5], x[4, 5] = 0.25, 1.0, 0.5, 0.125
    pixels = R.plane_pixels(make_plane(spark, {r: list(x[r]) for r in range(8)}))
    rows, cols = weights(8, target[0], method), weights(6, target[1], method)
    want, seen = rows @ x @ cols.T, (rows != 0) @ (x != 0) @ (cols != 0).T
    out = R.resize(pixels, (8, 6), target, method)
    got = {(r["row"], r["col"]): r["level"] for r in out.collect()}
    assert set(got) == set(zip(*map(list, np.nonzero(seen))))
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in got)
    if target == (16, 12):
        assert plan(out).split("Aggregate")[0].count("Generate") >= 1  # pixels come after the last grouping


@pytest.mark.parametrize("method", taps.METHODS)
@pytest.mark.parametrize("target", [(16, 12), (8, 12), (4, 12), (8, 3), (16, 4), (4, 3), (8, 6)])
def test_resized_strips_are_the_resized_positions(spark, method, target):
    """F2, F4 of round 4: lines are resampled, positions are no rows; gaps inside a row stay gaps, also of several planes."""
    strips = spark.createDataFrame(
        [(1, 0, 0, 0, 1, 1, 2, [0.25]), (1, 0, 0, 0, 1, 7, 0, [1.0, 0.5]), (1, 0, 0, 0, 1, 7, 5, [0.125]), (1, 0, 0, 2, 1, 7, 5, [1.0]), (2, 1, 3, 0, 1, 0, 0, [0.5] * 6)],
        "song_id BIGINT, track_idx INT, bar_index INT, channel INT, copies INT, row INT, col INT, levels ARRAY<DOUBLE>",
    )
    positions = lambda df: df.select(*BAR, "channel", "copies", "row", F.col("col").alias("first"), F.posexplode("levels").alias("i", "level")).withColumn("col", F.col("first") + F.col("i"))
    rows = lambda df: {tuple(r[k] for k in (*BAR, "channel", "copies", "row", "col")): r["level"] for r in df.collect()}
    out = R.resize(strips, (8, 6), target, method)
    got, want = rows(positions(out)), rows(R.resize(positions(strips).drop("first", "i"), (8, 6), target, method))
    assert got == pytest.approx(want, abs=1e-12) and sum(map(len, (r["levels"] for r in out.collect()))) == len(want)
    assert "Generate explode" not in plan(out)


def test_noise_reaches_every_pixel_and_groups_only_stored_ones(spark):
    """the dense positions come after the last grouping."""
    one = make_plane(spark, {0: [0.5, 0.0, 1.0], 2: [0.0, 0.25, 0.0]})
    both = one.unionByName(make_plane(spark, {3: [0.0, 0.0, 0.75]}, bar=1))
    key = [*BAR, "row", "step"]
    bars = both.select(*BAR).distinct()
    grid = bars.withColumn("row", F.explode(F.lit(list(range(5))))).withColumn("step", F.explode(F.lit(list(range(3)))))
    noise = C.hashed_normal(42, *map(F.col, key)) * 0.05
    want = grid.join(both, key, "left").withColumn("value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("value", F.lit(0.0)) + noise))).where("value > 0")
    out = C.noisy_plane(both, 0.1, 42, 5, 3)
    rows = lambda df: {tuple(r[k] for k in key): r["value"] for r in df.collect()}
    assert rows(out) == pytest.approx(rows(want))
    assert plan(out).split("Aggregate")[0].count("Generate") == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_results_sent_twice_are_the_same_results(spark, monkeypatch):
    """a mean that is summed again may differ in its last bits, and then the relay would pass it on twice."""
    shaken = F.udf(lambda x: x + random.random() * 1e-6, "double").asNondeterministic()
    table = derived.table
    monkeypatch.setattr(derived, "table", lambda s, d, n: table(s, d, n).withColumn("o_totalprice", shaken("o_totalprice")) if n == "orders" else table(s, d, n))
    assert {r["n"] for r in QUERIES["relayed_results"](spark, SF).collect()} == {1}


def test_distances_are_taken_once_per_vector(spark):
    """copies of a vector are a weight, tiles meet once, and the sums are those of all rows."""
    rng = np.random.default_rng(5)
    base, label = rng.normal(size=(9, 3)), list("aabbbccca")
    pick = [0, 0, 0, 1, 2, 3, 4, 4, 5, 6, 7, 8, 8]
    rows = [(i, base[p].tolist(), label[p]) for i, p in enumerate(pick)] + [(99, base[0].tolist(), "b")]
    df = spark.createDataFrame(rows, "id INT, z ARRAY<DOUBLE>, label STRING")
    x, own = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = sorted((a, b, int((own == b).sum() - (a == b)), round(float(gap[i][own == b].sum()), 6)) for i, a in enumerate(own) for b in "abc")
    for tile in (2, 1000):
        got = V.class_distances(df, ["id"], "label", tile=tile).collect()
        assert len(got) == 30 and sum(r["w"] for r in got) == 14 * 3  # 9 vectors, one of them in two classes
        assert sorted((r["own"], r["other"], r["n"], round(r["s"], 6)) for r in got for _ in range(r["w"])) == want


def test_similarity_of_hot_and_short_sequences(spark):
    """no sequence sends its D x D products; one with more rows than D sends the rows of a factor."""
    rng = np.random.default_rng(6)
    rows = [(s, rng.normal(size=4).tolist()) for s, n in ((1, 50), (2, 3), (3, 1)) for _ in range(n)] + [(2, [0.0] * 4)]
    out = V.self_similarity(spark.createDataFrame(rows, "song INT, z ARRAY<DOUBLE>").repartition(3), ["song"])
    for r in out.collect():
        u = np.array([z for s, z in rows if s == r["song"]])
        u = u / np.maximum(np.linalg.norm(u, axis=1), 1e-300)[:, None]
        sims = (u @ u.T)[np.triu_indices(len(u), 1)]
        assert r["self_similarity_n_bars"] == len(u)
        if len(u) > 1:
            assert (r["self_similarity_mean"], r["self_similarity_std"]) == pytest.approx((sims.mean(), sims.std()))
    assert plan(out).count("Aggregate") == 0  # nothing is summed product by product


def test_error_of_decoded_images_where_they_are_made(spark):
    """equal to the error of all decoded positions, which are no rows of the plan."""
    rng = np.random.default_rng(8)
    rows = [(1, 0, b, int(i), float(rng.random())) for b in range(6) for i in rng.choice(20, 5, replace=False)]
    pixels = spark.createDataFrame(rows, "song_id BIGINT, track_idx INT, bar_index INT, idx INT, level DOUBLE")
    model = linear.fit(pixels, 2, 20, n_bars=7, steps=4)
    bars = spark.createDataFrame([(1, 0, b) for b in range(1, 7)], "song_id BIGINT, track_idx INT, bar_index INT")
    z = model.encode(pixels, bars)  # bar 0 has no code, bar 6 no pixels
    for floor in (float("-inf"), 0.05):
        want = linear.squared_error(pixels, model.decode(z, floor=floor)).first()["error"]
        assert model.squared_error(pixels, z, floor=floor).first()["error"] == pytest.approx(want)


def test_codec_of_strips_is_that_of_their_pixels(spark):
    """F8 of round 4: strips stay strips in all steps, and pixels of one position count as one."""
    rng = np.random.default_rng(18)
    rows = [(1, 0, b, int(i), rng.random(3).tolist()) for b in range(6) for i in rng.choice(17, 4, replace=False)]  # some overlap
    strips = spark.createDataFrame(rows, "song_id BIGINT, track_idx INT, bar_index INT, idx INT, levels ARRAY<DOUBLE>")
    pixels = strips.select(*BAR, F.col("idx").alias("first"), F.posexplode("levels").alias("i", "level")).select(*BAR, (F.col("first") + F.col("i")).alias("idx"), "level")
    one, other = (linear.fit(p, 2, 20, n_bars=7, steps=4) for p in (strips, pixels))
    x = np.zeros((7, 20))
    for r in pixels.collect():
        x[r["bar_index"], r["idx"]] += r["level"]
    assert one.variance == pytest.approx(((x - x.mean(axis=0)) ** 2).sum())
    assert one.components == pytest.approx(other.components) and one.explained == pytest.approx(other.explained)
    bars = spark.createDataFrame([(1, 0, b) for b in range(1, 7)], "song_id BIGINT, track_idx INT, bar_index INT")
    z = one.encode(strips, bars)  # bar 0 has no code, bar 6 no pixels
    codes = {r["bar_index"]: r["z"] for r in z.collect()}
    assert all(codes[b] == pytest.approx(one.components @ (x[b] - one.mean)) for b in range(1, 7)) and len(codes) == 6
    want = linear.squared_error(pixels, one.decode(z, floor=0.05)).first()["error"]
    assert one.squared_error(strips, z, floor=0.05).first()["error"] == pytest.approx(want)
    assert plan(z).count("Generate") == 0


def test_enlarged_reconstruction_is_compared_where_it_is_made(spark):
    """equal to the scores of the enlarged pixels, which are no rows of the plan; strips stand for their pixels."""
    rng = np.random.default_rng(9)
    true = make_plane(spark, {r: list(rng.random(6)) for r in (0, 3, 7)}).unionByName(make_plane(spark, {2: [0.5] * 6}, bar=1))
    half = R.resize(R.plane_pixels(make_plane(spark, {r: list(rng.random(6)) for r in (1, 3, 6)})), (8, 6), (4, 3), "area")
    pixels = R.plane_pixels(true)
    strips = pixels.groupBy(*BAR, "channel", "copies", "row").agg(F.array_sort(F.collect_list(F.struct("col", "level"))).alias("s"))
    strips = strips.select(*BAR, "channel", "copies", "row", F.lit(0).alias("col"), F.col("s.level").alias("levels"))
    rows = lambda df: {r["bar_index"]: r["pixel_mse"] for r in df.collect()}
    want = rows(image_metrics.pixel_scores(pixels, R.resize(half, (4, 3), (8, 6)), 8, 6))
    dense = R.resize(half, (4, 3), (8, 6)).collect()
    gap = {(r["row"], r["step"]): r["value"] for r in true.where("bar_index = 0").collect()}
    for r in dense:
        gap[r["row"], r["col"]] = gap.get((r["row"], r["col"]), 0.0) - r["level"]
    assert want[0] == pytest.approx(sum(4 * g * g for g in gap.values()) / 48)
    for side in (pixels, strips):
        out = image_metrics.pixel_scores(side, half, 8, 6, recon_size=(4, 3))
        assert rows(out) == pytest.approx(want)
        assert plan(out).split("Aggregate")[0].count("Generate") == 0


def test_decoded_bars_are_those_of_the_decoded_plane(spark):
    """F8: errors, sums of rows and notes equal those of the enlarged pixels, which are no rows of the plan."""
    from staffline.operators import detect, ingest

    rng = np.random.default_rng(11)
    rows = [(1, 0, int(rng.integers(0, 128)), int(a), int(a + n), int(v), i) for i, (a, n, v) in enumerate(zip(rng.integers(0, 280, 40), rng.integers(1, 30, 40), rng.integers(1, 128, 40)))]
    notes = spark.createDataFrame(rows, "song_id BIGINT, track_idx INT, pitch INT, onset_step INT, offset_step INT, velocity INT, note_ord BIGINT")
    true = ingest.notes_to_segments(notes)
    pixels = R.render(ingest.segments_to_cells(true))
    latent = C.pool_encode(pixels)
    plane = C.pool_decode(latent).where("level > 0").select(*BAR, "row", F.col("col").alias("step"), F.least(F.lit(1.0), "level").alias("value"))
    bars = C.decoded_bars(R.strips(true), latent, 0.05, image_metrics.SPARSITY_LEVEL)
    got = image_metrics.scores_of_errors(bars.select(*BAR, "ss", "has_t"))
    want = image_metrics.pixel_scores(pixels, R.plane_pixels(plane))
    table = lambda df, n: {tuple(r)[:n]: tuple(r)[n:] for r in df.collect()}
    same = lambda a, b: a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
    assert same(table(got, 3), table(want, 3))
    assert same(table(image_metrics.row_scores(true, bars.select(*BAR, F.inline("rows"))), 3), table(image_metrics.row_scores(true, plane), 3))
    found, whole = detect.notes_of_runs(bars.select(*BAR, F.inline("runs"))), detect.global_threshold(plane, 0.05)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect())) and found.count() > 40
    assert plan(got).split("Aggregate")[0].count("Generate") == 0


def test_scores_of_decoded_bars_are_those_of_the_plan_that_writes_planes(spark, monkeypatch):
    """F6 of round 4: one Arrow function gives what the codec's pixels, the detector and four scores give; nothing is written down."""
    from staffline.operators import detect, numbering
    from staffline.plans import job

    rng = np.random.default_rng(17)
    rows = [(int(i % 3), int(i % 2), int(rng.integers(0, 128)), int(a), int(a + n), int(v), i) for i, (a, n, v) in enumerate(zip(rng.integers(0, 280, 60), rng.integers(1, 30, 60), rng.integers(1, 128, 60)))]
    notes = spark.createDataFrame(rows, "song_id BIGINT, track_idx INT, pitch INT, onset_step INT, offset_step INT, velocity INT, note_ord BIGINT")
    monkeypatch.setattr(numbering, "durable", None)
    whole = job.run(notes)
    want = job.run(notes, lambda p: detect.global_threshold(p, 0.05))
    table = lambda df: {r["instrument"]: tuple(r)[1:] for r in df.collect()}
    got, of_plan = table(whole), table(want)
    assert got.keys() == of_plan.keys() and all(got[k] == pytest.approx(of_plan[k], abs=1e-9) for k in got)
    assert plan(whole).count("MapInArrow") == 1


def test_image_rows_of_strips(spark):
    """strips give the rows of their pixels, and no row is looked up position by position in a map."""
    rows = [(1, 0, 0, 60, 0, 4, 100, True), (1, 0, 0, 60, 4, 6, 50, False), (1, 0, 1, 7, 2, 3, 127, True)]
    segments = spark.createDataFrame(rows, "song_id BIGINT, track_idx INT, bar_index INT, pitch INT, `on` INT, off INT, velocity INT, starts BOOLEAN")
    from staffline.operators.ingest import segments_to_cells
    for strategy in R.STRATEGIES:
        strips = R.image_rows(R.strips(segments, strategy), 6, 0.0, 1.0)
        assert sorted(map(tuple, strips.collect())) == sorted(map(tuple, R.image_rows(R.render(segments_to_cells(segments), strategy), 6, 0.0, 1.0).collect()))
        assert "element_at" not in plan(strips)
    got = {(r["bar_index"], r["channel"], r["row"]): r["values"] for r in R.image_rows(R.strips(segments, "vos"), 6, 0.0, 1.0).collect()}
    v = [100 / 127] * 4 + [50 / 127] * 2
    assert got == {(0, 0, 60): v, (0, 1, 60): [1.0, 0, 0, 0, 0, 0], (0, 2, 60): [0.0, 1, 1, 1, 1, 1], (1, 0, 7): [0, 0, 1.0, 0, 0, 0], (1, 1, 7): [0, 0, 1.0, 0, 0, 0]}


def test_runs_are_found_without_rows_for_positions(spark):
    """F14, F16, F22: strips and positions give the same notes; no position is sorted, grouped or joined as a row."""
    from staffline.operators import detect

    rng = np.random.default_rng(14)
    at = [(1, 0, b, r, int(s), rng.random(int(n)).tolist()) for b in range(3) for r in (3, 4, 90) for s, n in ((0, 20), (25, 9), (34, 5), (90, 6))]
    strips = spark.createDataFrame(at, "song_id BIGINT, track_idx INT, bar_index INT, row INT, step INT, values ARRAY<DOUBLE>")
    single = strips.select(*BAR, "row", F.col("step").alias("a"), F.posexplode("values").alias("n", "value")).select(*BAR, "row", (F.col("a") + F.col("n")).alias("step"), "value")
    limits = [0.5] * 128
    limits[4], limits[5] = 0.3, 0.0
    for found in (lambda p: detect.morphological(p, erosion=2, dilation=5), lambda p: detect.by_row_threshold(p, limits), lambda p: detect.hysteresis(p)):
        got = found(strips)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, found(single).collect()))
        assert plan(got).count("Window") == plan(got).count("Join") == 0
    want = detect.notes_of_runs(detect.runs(single.where("value >= 0.5 AND row <> 4 OR value >= 0.3 AND row = 4")))
    whole = [(1, 0, b, 5, 0, 96, 1) for b in range(3)]
    assert sorted(map(tuple, detect.by_row_threshold(strips, limits).collect())) == sorted([*map(tuple, want.collect()), *whole])


def test_pooled_vectors_and_hmm_sums_read_strips_as_they_read_positions(spark):
    from staffline.operators import codec, detect, ingest, render
    from staffline.plans import derived

    sf = "/root/testdata/sf0.001"
    true = derived.segments(spark, sf).where("song_id < 5")
    for strategy in ("velocity_only", "vos"):
        got = codec.pool_vectors(render.strips(true, strategy))
        want = codec.pool_latents(codec.pool_encode(render.render(ingest.segments_to_cells(true), strategy)))
        assert "explode(sequence(on" not in got._jdf.queryExecution().optimizedPlan().toString()
        a, b = ({tuple(r[:3]): (r["z_mu"], r["z_sigma"]) for r in df.collect()} for df in (got, want))
        assert a.keys() == b.keys() and a
        for k in a:
            assert a[k][0] == pytest.approx(b[k][0], abs=1e-12) and a[k][1] == b[k][1]
    strips, plane = (df.where("song_id < 5") for df in (derived.recon_strips(spark, sf), derived.recon_plane(spark, sf)))
    a, b = (detect.fit_hmm(p, true) for p in (strips, plane))
    assert [getattr(a, n) for n in ("mu_on", "sigma_on", "mu_off", "sigma_off", "p_onset", "p_offset")] == pytest.approx(
        [getattr(b, n) for n in ("mu_on", "sigma_on", "mu_off", "sigma_off", "p_onset", "p_offset")], rel=1e-9)


def test_noise_of_strips_is_summed_where_it_is_made(spark):
    """F1 of round 4: the numbers are Spark's own hashes, and no dense position is a row before the sums."""
    segments = spark.createDataFrame([(1, 0, 0, 2, 0, 2, 100), (1, 0, 0, 2, 2, 3, 50), (7, 3, 1, 4, 1, 2, 127)], "song_id BIGINT, track_idx INT, bar_index INT, pitch INT, on INT, off INT, velocity INT")
    strips = R.velocity_strips(segments)
    positions = strips.select(*BAR, "row", F.posexplode("values").alias("i", "value"), F.col("step").alias("first")).select(*BAR, "row", (F.col("first") + F.col("i")).alias("step"), "value")
    beyond = spark.createDataFrame([(8, 0, 0, 9, 0, 1.0)], "song_id BIGINT, track_idx INT, bar_index INT, row INT, step INT, value DOUBLE")
    rows = lambda df, key: {tuple(r[k] for k in key): r["value"] for r in df.collect()}
    key = [*BAR, "row", "step"]
    dense = rows(C.noisy_plane(positions, 0.4, 5, 6, 3), key)
    assert rows(C.noisy_plane(strips, 0.4, 5, 6, 3), key) == dense
    out = C.noisy_sums(positions.unionByName(beyond), 0.4, 5, 6, 3)
    want = C.noisy_plane(positions.unionByName(beyond), 0.4, 5, 6, 3).groupBy(*BAR).agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.max("value").alias("top"))
    sums = lambda df: {tuple(r[k] for k in BAR): (r["n"], pytest.approx(r["total"]), r["top"]) for r in df.collect()}
    assert sums(out) == sums(want) and len(sums(out)) == 3
    assert "Generate" not in plan(C.noisy_sums(strips))
    noise = C.hashed_normal(5, *map(F.col, key)) * 0.2
    blank = spark.createDataFrame([(8, 0, 0, r, t) for r in range(6) for t in range(3)], "song_id BIGINT, track_idx INT, bar_index INT, row INT, step INT")
    spark_side = rows(blank.withColumn("value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), noise))).where("value > 0"), key)
    assert rows(C.noisy_plane(beyond, 0.4, 5, 6, 3), key) == pytest.approx(spark_side)


def test_probes_and_sequences_deal_vectors_once(spark, monkeypatch):
    """F3, F5 of round 4: a probe's sample is drawn from keys alone, both differences of a sequence come from one dealing of its rows."""
    from staffline.operators import numbering

    rng = np.random.default_rng(19)
    df = spark.createDataFrame([(i, i % 3, (rng.normal(size=3) + i % 3).tolist()) for i in range(50)], "id BIGINT, label INT, z ARRAY<DOUBLE>")
    drawn, kept = [], []
    monkeypatch.setattr(V, "exact_fraction", lambda rows, *a, f=V.exact_fraction, **b: drawn.append((rows, f(rows, *a, **b))) or drawn[-1][1])
    monkeypatch.setattr(V.LogisticRegression, "fit", lambda self, rows, f=V.LogisticRegression.fit: kept.append(rows.count()) or f(self, rows))
    assert 0 <= V.probe_accuracy(df, ["id"], "label") <= 1
    assert [rows.columns for rows, _ in drawn] == [["id"]] and kept == [drawn[0][1].count()] == [40]
    dealt = []
    monkeypatch.setattr(numbering, "sequence_blocks", lambda *a, f=numbering.sequence_blocks: dealt.append(1) or f(*a))
    assert V.smoothness(df.withColumn("song", F.col("id") % 2), ["song"], "id").count() == 2 and len(dealt) == 1


def test_successors_at_several_distances(spark):
    """F3 of round 4: as those taken one by one."""
    from staffline.operators import numbering

    df = spark.createDataFrame([(i % 3, i, i * i) for i in range(200)], "g INT, o INT, v INT").repartition(7)
    both = numbering.sequence_ahead(df, ["g"], "o", ["v"], {"a_": 1, "b_": 2, "c_": 5})
    for r in both.collect():
        assert [r["a_v"], r["b_v"], r["c_v"]] == [(r["o"] + 3 * k) ** 2 if r["o"] + 3 * k < 200 else None for k in (1, 2, 5)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", ["metrics_latent_space", "metrics_conditioning", "metrics_generative"])
def test_groups_make_the_segments_once(spark, name):
    """F3, F5, F7 of round 4: metrics of a group read the segments that were written down, they are not made anew for each."""
    scans = lambda df: plan(df).count("l_returnflag")
    reconstructed = scans(derived.rec_segments(spark, SF)) + scans(derived.rec_notes(spark, SF))  # conditioning reads them in one metric
    assert scans(QUERIES[name](spark, SF)) == (reconstructed if name == "metrics_conditioning" else 0)
