import math

import numpy as np
import pytest
from helpers import ANCHOR, notes, one, plane, pred

from staffline.operators import image_metrics as I
from staffline.operators import ingest
from staffline.operators import note_metrics as M
from staffline.operators import render as R
from staffline.plans.evaluate import Tables, evaluate, register_metric, select_metrics

T = 96


def sides(spark, truth, guess):
    return ingest.notes_to_segments(notes(spark, truth), T, 1), M.compact_notes(pred(spark, guess))


def roll(rows):
    m = np.zeros((128, T))
    for p, a, b, v in rows:
        m[p, a:b] = v
    return m


def r(x, y):
    x, y = np.asarray(x, float), np.asarray(y, float)
    return 0.0 if x.std() < 1e-8 or y.std() < 1e-8 else float(np.corrcoef(x, y)[0, 1])


def kl(p, q, eps=1e-10):
    p, q = np.clip(p, eps, None), np.clip(q, eps, None)
    p, q = p / p.sum(), q / q.sum()
    return float((p * np.log(p / q)).sum())


def brute(truth, guess):
    m = roll(truth)
    onset = (m > 0) & ~np.pad(m > 0, ((0, 0), (1, 0)))[:, :-1]
    dens, vsum, n = np.zeros(T), np.zeros(T), np.zeros(T)
    ints = np.zeros(25)
    cover = {}
    for p, a, b, v in guess:
        for t in range(a, b):
            cover.setdefault(t, set()).add(p)
            if t < T:
                dens[t] += 1
                vsum[t] += v
    for ps in cover.values():
        for i in ps:
            for j in ps:
                if i < j:
                    ints[min(j - i, 24)] += 1
    gt_int = np.zeros(25)
    for t in range(T):
        ps = np.where(m[:, t] > 0)[0]
        for i in ps:
            for j in ps:
                if i < j:
                    gt_int[min(j - i, 24)] += 1
    norm = lambda h: h / h.sum() if h.sum() else h
    count = (m > 0).sum(0)
    a = np.where(count > 0, m.sum(0) / np.maximum(count, 1), 0)
    b = np.where(dens > 0, vsum / np.maximum(dens, 1), 0)
    pc_t, pc_p = np.zeros(12), np.zeros(12)
    for p in range(128):
        pc_t[p % 12] += (m[p] > 0).sum()
    for p, *_ in guess:
        pc_p[p % 12] += 1
    vh_t = np.histogram(m[m > 0], 32, (0, 128))[0].astype(float)
    vh_p = np.histogram([g[3] for g in guess], 32, (0, 128))[0].astype(float)
    t_on = np.where(onset.any(0))[0]
    p_all = np.unique([g[1] for g in guess])
    gt, gp = np.diff(t_on), np.diff(p_all)
    if len(gt) == 0:
        ioi = 0.0
    elif len(gp) == 0:
        ioi = math.inf
    else:
        top = max(gt.max(), gp.max())
        h = lambda g: norm(np.histogram(g, 32, (1, top + 1))[0].astype(float))
        ioi = kl(h(gt), h(gp))

    def acf(on):
        x = np.zeros(T)
        x[on] = 1
        x -= x.mean()
        return np.array([x[: T - k] @ x[k:] for k in range(1, T // 2)]) / max(x @ x, 1e-12)

    p_on = p_all[p_all < T]
    free, tp = list(t_on), 0
    for s in p_on:
        near = [g for g in free if abs(g - s) <= 1]
        if near:
            free.remove(min(near, key=lambda g: (abs(g - s), g)))
            tp += 1
    return {
        "note_density_pearson": r(count, dens), "velocity_mse": float(((a - b) ** 2).mean()), "velocity_correlation": r(a, b),
        "pitch_class_histogram_correlation": r(norm(pc_t), norm(pc_p)), "interval_histogram_correlation": r(norm(gt_int), norm(ints)),
        "velocity_histogram_kl": kl(norm(vh_t), norm(vh_p)), "ioi_distribution_kl": ioi, "groove_consistency": r(acf(t_on), acf(p_on)),
        "onset_precision": tp / len(p_on), "onset_recall": tp / len(t_on),
        "conditioning_pitch_alignment": float(pc_t @ pc_p / np.linalg.norm(pc_t) / np.linalg.norm(pc_p)),
    }


@pytest.mark.parametrize("seed", range(5))
def test_note_metrics_match_dense_brute_force(spark, seed):
    rng = np.random.default_rng(seed)

    def some(n, top):
        out = []
        for _ in range(n):
            a = int(rng.integers(0, 95))
            out.append((int(rng.integers(50, 80)), a, int(min(a + rng.integers(1, 30), top)), int(rng.integers(1, 128))))
        return out

    truth, guess = some(25, 96), some(20, 130)  # predictions may pass the bar line and overlap
    true, p = sides(spark, truth, guess)
    got = {row["metric"]: row["value"] for row in evaluate(
        Tables(true, p), ["harmony", "rhythm", "dynamics", "velocity_histogram_kl", "conditioning/pitch_alignment"]
    ).collect()}
    for name, want in brute(truth, guess).items():
        assert got[name] == pytest.approx(want, abs=1e-9), name


def test_perfect_and_disjoint(spark):
    true, p = sides(spark, ANCHOR, ANCHOR)
    s = one(M.onset_scores(M.onset_arrays(true, p)))
    assert (s["onset_precision"], s["onset_recall"], s["onset_f1"]) == (1.0, 1.0, 1.0)
    prof = one(M.step_profiles(true, p))
    assert prof["velocity_mse"] == 0.0 and prof["velocity_correlation"] == pytest.approx(1.0)
    assert one(M.velocity_histogram_kl(true, M.compact_notes(pred(spark, ANCHOR))))["velocity_histogram_kl"] == pytest.approx(0.0, abs=1e-9)
    true, p = sides(spark, ANCHOR, [(10, 10, 12, 50), (20, 35, 37, 50)])
    assert one(M.onset_scores(M.onset_arrays(true, p)))["onset_f1"] == 0.0


def test_onset_edge_rules(spark):
    schema = "song_id INT, track_idx INT, bar_index INT, t_on ARRAY<INT>, p_on ARRAY<INT>"
    cases = [([], []), ([], [3]), ([3], []), ([5], [4, 6]), ([4, 6], [5]), ([4, 5], [5, 5, 6]), ([1, 3], [2, 2])]
    df = spark.createDataFrame([(i, 0, 0, t, p) for i, (t, p) in enumerate(cases)], schema)
    got = {r["song_id"]: (r["onset_precision"], r["onset_recall"], r["onset_f1"]) for r in M.onset_scores(df).collect()}
    assert got[0] == (1.0, 1.0, 1.0) and got[1] == (0.0, 1.0, 0.0) and got[2] == (1.0, 0.0, 0.0)
    assert got[3] == pytest.approx((0.5, 1.0, 2 / 3)) and got[4] == pytest.approx((1.0, 0.5, 2 / 3))


def test_bars_without_predictions(spark):
    true = ingest.notes_to_segments(notes(spark, ANCHOR), T, 1)
    none = M.compact_notes(pred(spark, [(60, 0, 5, 9)], bar=7))
    assert M.step_profiles(true, none).count() == 0 and M.interval_scores(true, none).count() == 0
    s = one(M.pitch_class_scores(true, none))
    assert s["pitch_class_histogram_correlation"] is None and s["seq_coherence_gen_entropy"] == pytest.approx(math.log(12))


def test_hot_bar_predictions_keep_multiplicity(spark):
    guess = [(60, 0, 24, 100)] * 500 + [(64, 24, 48, 80)]
    true, p = sides(spark, ANCHOR, guess)
    assert p.count() == 2
    assert one(M.step_profiles(true, p))["note_density_pearson"] == pytest.approx(brute(ANCHOR, guess)["note_density_pearson"])


def test_sequence_scores(spark):
    frames = []
    for bar, pc in enumerate([60, 60, 62, 60]):
        frames.append((1, 0, pc, bar * T, bar * T + 10, 80, bar))
    from helpers import NOTE

    true = ingest.notes_to_segments(spark.createDataFrame(frames, NOTE), T, 4)
    none = M.compact_notes(pred(spark, [(60, 0, 5, 9)], song=99))
    dom = M.dominant_pitch_class(true, none)
    assert [r["pc"] for r in dom.orderBy("bar_index").collect()] == [0, 0, 2, 0]
    t = one(M.transition_entropy(dom))
    assert t["transition_entropy"] == pytest.approx(math.log(3)) and t["transition_entropy_n_transitions"] == 3
    g = one(M.sequence_groove(M.onset_arrays(true, none, how="left")))
    assert g["seq_groove_consistency"] == pytest.approx(1.0) and g["seq_groove_consistency_n_bars"] == 4
    alone = dom.filter("bar_index = 0")
    assert one(M.transition_entropy(alone))["transition_entropy"] == 0.0


def test_pixel_scores(spark):
    true = R.plane_pixels(plane(spark, {60: [0.5, 1.0]}))
    same = one(I.pixel_scores(true, true))
    assert same["pixel_mse"] == 0.0 and same["psnr"] == math.inf
    other = R.plane_pixels(plane(spark, {60: [0.5], 3: [0, 0.25]}))
    s = one(I.pixel_scores(true, other))
    mse = 4 * (1.0 + 0.0625) / (128 * 96)
    assert s["pixel_mse"] == pytest.approx(mse) and s["psnr"] == pytest.approx(10 * math.log10(4 / mse))


def test_ssim_matches_direct_convolution(spark):
    rng = np.random.default_rng(5)
    h, w = 20, 24
    x, y = (rng.random((h, w)) * (rng.random((h, w)) > 0.6) for _ in range(2))
    k = np.exp(-0.5 * ((np.arange(11) - 5) / 1.5) ** 2)
    k = np.outer(k, k) / k.sum() ** 2

    def conv(z):
        pad = np.pad(z, 5)
        return np.array([[(pad[i : i + 11, j : j + 11] * k).sum() for j in range(w)] for i in range(h)])

    mx, my = conv(x), conv(y)
    sx, sy, sxy = conv(x * x) - mx**2, conv(y * y) - my**2, conv(x * y) - mx * my
    sx, sy = sx.clip(0), sy.clip(0)
    want = ((2 * mx * my + 1e-4) * (2 * sxy + 9e-4) / ((mx**2 + my**2 + 1e-4) * (sx + sy + 9e-4) + 1e-10)).mean()
    frame = lambda z, c: R.plane_pixels(plane(spark, {i: z[i] for i in range(h)}), 0, c)
    assert one(I.ssim(frame(x, 3), frame(y, 3), h, w))["ssim"] == pytest.approx(want, abs=1e-9)
    # one real channel and two blank ones; the small term in the denominator keeps those under 1
    blank = 9e-8 / (9e-8 + 1e-10)
    got = one(I.ssim(frame(x, 1), frame(y, 1), h, w))["ssim"]
    assert got == pytest.approx((want + 2 * blank) / 3, abs=1e-9)


def test_row_scores_with_other_height(spark):
    true = ingest.notes_to_segments(notes(spark, ANCHOR), T, 1)
    rec = {10: [0.5] * 20, 40: [0.2] * 96, 63: [0.04] * 10}
    s = one(I.row_scores(true, plane(spark, rec), height=64))
    q = np.zeros(64)
    for i, v in rec.items():
        q[i] = sum(v)
    q /= q.sum()
    centre = np.clip((np.arange(128) + 0.5) / 2 - 0.5, 0, None)
    q128 = np.interp(centre, np.arange(64), q)
    p = (roll(ANCHOR) > 0).sum(1) / 96
    assert s["kl_pitch_dist"] == pytest.approx(kl(p, q128 / q128.sum()), abs=1e-6)
    e = np.clip(q, 1e-12, None)
    assert s["note_entropy_recon"] == pytest.approx(-(e / e.sum() * np.log(e / e.sum())).sum(), abs=1e-6)
    assert s["activation_sparsity_recon"] == pytest.approx(1 - 116 / (64 * 96))


def test_render_resize_pad(spark):
    cells = ingest.notes_to_cells(notes(spark, [(60, 0, 2, 127), (60, 3, 4, 127)]), T, 1)
    vos = {(r["channel"], r["row"], r["col"]): r["level"] for r in R.render(cells, "vos").collect()}
    assert set(vos) == {(0, 60, 0), (0, 60, 1), (0, 60, 3), (1, 60, 0), (1, 60, 3), (2, 60, 1)}
    px = R.render(cells, "velocity_only", "width")
    assert {(r["row"], r["col"]) for r in px.collect()} == {(0, 60), (1, 60), (3, 60)}
    padded = R.pad(R.render(cells), (128, 96), 131)
    assert {(r["row"], r["col"]) for r in padded.collect()} == {(61, 17), (61, 18), (61, 20)}
    rows = R.image_rows(R.render(cells, "vo_split"))
    assert {r["channel"] for r in rows.collect()} == {0, 1}
    back = R.rows_to_plane(rows)
    assert {(r["row"], r["step"], r["value"]) for r in back.collect()} == {(60, 0, 1.0), (60, 1, 1.0), (60, 3, 1.0)}
    for bad in (lambda: R.render(cells, "rgb"), lambda: R.pad(cells, (128, 96), 100), lambda: R.resize(cells, (1, 1), (0, 1)),
                lambda: R.resize(cells, (1, 1), (1, 1), "lanczos"), lambda: R.remap(None, (1.0, 0.0))):
        with pytest.raises(ValueError):
            bad()


def test_metric_names(spark):
    assert select_metrics(["harmony", "-onset_f1", "ssim", "ssim"]) == [
        "note_density_pearson", "pitch_class_histogram_correlation", "interval_histogram_correlation", "ssim",
    ]
    assert "ssim" in select_metrics(["all"]) and select_metrics(["dynamics"], exclude=["velocity_mse"]) == ["velocity_correlation"]
    true, p = sides(spark, ANCHOR, ANCHOR)
    register_metric("note_total", lambda t: t.true.groupBy("song_id", "track_idx", "bar_index").agg({"*": "count"}).withColumnRenamed("count(1)", "note_total"), ["note_total"])
    got = {r["metric"]: r["value"] for r in evaluate(Tables(true, p), ["note_total", "psnr", "unknown"]).collect()}
    assert got == {"note_total": 4.0}
    with pytest.raises(ValueError):
        evaluate(Tables(true, p), ["psnr"])


def test_ssim_of_cropped_planes_equals_whole_planes():
    """Pixels at the borders, one-sided planes, planes of all heights and none at all."""
    h, w, rng = 37, 20, np.random.default_rng(5)
    kernel = I._gaussian(11, 1.5)
    x, y = np.zeros((2, 9, h, w))
    x[0, 0, 0], x[1, h - 1, w - 1], y[2, 3, 4], x[3, 18, 2], y[3, 20, 3] = 1.0, 0.4, 0.7, 0.2, 0.9
    x[5], y[5] = rng.random((2, h, w))
    y[7, 5:9], x[8, 30:, 1] = 0.5, 0.3
    sparse = lambda z: (np.nonzero(z)[0] * 3 + 1, *np.nonzero(z)[1:], z[np.nonzero(z)])
    planes, got = I._plane_scores([sparse(x), sparse(y)], h, w, kernel, stack=2)
    whole = I._ssim_sums(x, y, I._band(kernel, h), I._band(kernel, w), 0.01**2, 0.03**2) / (h * w)
    assert planes.tolist() == [1, 4, 7, 10, 16, 22, 25]
    np.testing.assert_allclose(got, whole[(planes - 1) // 3], atol=1e-12)
    nothing = sparse(np.zeros((1, h, w)))
    assert [len(a) for a in I._plane_scores([nothing, nothing], h, w, kernel)] == [0, 0]


def test_scores_of_notes_are_taken_in_one_pass(spark):
    """Several families cost one Python function and no sort, join or shuffle more; each is as it is alone."""
    true = ingest.notes_to_segments(notes(spark, ANCHOR), T, 1)
    p = M.compact_notes(pred(spark, [(60, 1, 30, 90), (64, 24, 40, 70), (66, 47, 60, 90), (40, 95, 99, 20)]))
    families = [f for f in M.FAMILIES if f != "counts"]
    together = M.bar_scores(true, p, families)
    plan = together._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("+- == Initial Plan ==")[-1]
    assert "Window" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") <= 2
    got = one(together).asDict()
    arrays = M.onset_arrays(true, p)
    alone = [M.step_profiles(true, p), M.pitch_class_scores(true, p), M.onset_scores(arrays), M.ioi_kl(arrays), M.groove_scores(arrays)]
    for df in alone:
        for name, value in one(df).asDict().items():
            assert got[name] == pytest.approx(value, abs=1e-12), name
    long = evaluate(Tables(true, p), ["harmony", "rhythm", "dynamics", "-interval_histogram_correlation"])
    assert long._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") <= 3
    found = {r["metric"]: r["value"] for r in long.collect()}
    assert found["onset_f1"] == got["onset_f1"] and found["groove_consistency"] == got["groove_consistency"]


def test_images_come_as_strips(spark):
    """Strips score as their positions do, and the registered image scores spread none into rows."""
    import __spark_entry__ as entry
    from staffline.plans import derived
    from staffline.plans.catalog.images import two_channel_recon

    true = ingest.notes_to_segments(notes(spark, ANCHOR), T, 1)
    plane_strips = true.selectExpr("song_id", "track_idx", "bar_index", "pitch + 1 AS row", "on AS step", "transform(sequence(on, off - 1), t -> (t % 7) / 10D) AS values", "starts")
    recon = two_channel_recon(plane_strips)
    positions = recon.selectExpr("song_id", "track_idx", "bar_index", "channel", "copies", "row", "col AS c", "posexplode(levels) AS (k, level)").selectExpr("*", "CAST(c + k AS INT) AS col")
    cells = R.render(ingest.segments_to_cells(true), "vo_split")
    for score in (I.pixel_scores, I.ssim):
        got, want = one(score(R.strips(true, "vo_split"), recon)), one(score(cells, positions))
        assert tuple(got) == pytest.approx(tuple(want), abs=1e-12)
    assert derived.recon_strips(spark, "/root/testdata/sf0.001").where("starts").count() > 0
    for name in ("pixel_scores", "pixel_scores_vo_split", "ssim", "scores_of_matched_bars", "row_scores"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(sequence(on" not in plan and "Window" not in plan, name
