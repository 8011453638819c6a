import itertools

import numpy as np
import pytest
from helpers import found, notes, plane

from staffline.operators import detect as D
from staffline.operators import ingest


def runs(mask):
    out, start = [], None
    for t, m in enumerate(list(mask) + [False]):
        if m and start is None:
            start = t
        if not m and start is not None:
            out.append((start, t))
            start = None
    return out


def expected(rows, decide, min_len=1):
    out = []
    for r, v in rows.items():
        v = np.array(v, float)
        for a, b in runs(decide(v)):
            if b - a >= min_len:
                out.append((r, a, b, max(1, min(127, round(round(v[a:b].mean() * 127, 9))))))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    return {r: np.round(rng.random(24) * (rng.random(24) > 0.25), 2).tolist() for r in range(30, 50)}


def test_global(spark, rows):
    p = plane(spark, rows)
    assert found(D.global_threshold(p)) == expected(rows, lambda v: v >= 0.5)
    assert found(D.global_threshold(p, 0.3, min_duration=3)) == expected(rows, lambda v: v >= 0.3, 3)


def test_velocity_rounds_half_to_even(spark):
    v = 0.5 / 127 + 64 / 127  # 64.5 -> 64
    assert found(D.global_threshold(plane(spark, {60: [v]}))) == [(60, 0, 1, 64)]


def test_zero_threshold_accepts_silence(spark):
    got = found(D.global_threshold(plane(spark, {3: [0.5, 0.5]}), 0.0, height=128, steps=4))
    assert len(got) == 128 and (3, 0, 4, 32) in got and (0, 0, 4, 1) in got


def loop(v, on, off):
    active, out = False, []
    for x in v:
        if not active and x >= on:
            active = True
        elif active and x < off:
            active = False
        out.append(active)
    return out


@pytest.mark.parametrize("taus", [(0.6, 0.3), (0.9, 0.1), (0.5, 0.5), (0.7, 0.0)])
def test_hysteresis_equals_the_state_machine(spark, rows, taus):
    got = found(D.hysteresis(plane(spark, rows), *taus, steps=24))
    assert got == expected(rows, lambda v: loop(v, *taus))


def test_hysteresis_rejects_crossed_levels(spark, rows):
    with pytest.raises(ValueError):
        D.hysteresis(plane(spark, rows), 0.3, 0.6)


def morph(mask, er, dil):
    n = len(mask)
    at = lambda m, t: 0 <= t < n and m[t]
    e = [all(at(mask, t + o) for o in range(-(er // 2), er - er // 2)) for t in range(n)]
    return [any(at(e, t - o) for o in range(-(dil // 2), dil - dil // 2)) for t in range(n)]


@pytest.mark.parametrize("sizes", [(2, 2), (3, 3), (1, 4), (4, 1), (2, 5)])
def test_morphology(spark, rows, sizes):
    got = found(D.morphological(plane(spark, rows), 0.4, *sizes, steps=24))
    assert got == expected(rows, lambda v: morph(v >= 0.4, *sizes))


def test_default_opening_removes_single_steps(spark):
    got = found(D.morphological(plane(spark, {60: [0.9, 0, 0.9, 0.9, 0, 0.9]}), steps=6))
    assert [g[:3] for g in got] == [(60, 2, 4)]


def test_velocity_aware(spark):
    v, o = plane(spark, {60: [0.3, 0.3, 0.9]}), plane(spark, {60: [1.0, 0, 0]})
    # (0.3 + 2) / 3 passes, 0.1 does not, 0.3 does not
    assert found(D.velocity_aware(v, o)) == [(60, 0, 1, 38)]
    assert found(D.velocity_aware(v, None)) == [(60, 2, 3, 114)]


def test_adaptive_thresholds(spark, rows):
    p = plane(spark, rows)
    got = D.fit_adaptive(p, 1.0, n_bars=1, steps=24)
    for r, v in rows.items():
        assert got[r] == pytest.approx(np.clip(np.mean(v) + np.std(v), 0, 1))
    assert got[0] == 0.0
    limits = [1.0] * 128
    for r in rows:
        limits[r] = got[r]
    want = sorted(n for r, v in rows.items() for n in expected({r: v}, lambda x, r=r: x >= got[r]))
    assert found(D.by_row_threshold(p, limits, steps=24)) == want
    # misfitting parameters fall back to 0.5
    assert found(D.by_row_threshold(p, [0.1, 0.2], steps=24)) == expected(rows, lambda v: v >= 0.5)


def test_row_to_pitch(spark):
    from pyspark.sql import functions as F

    df = spark.range(64).select(D.row_pitch(F.col("id"), 64).alias("p"))
    assert [r["p"] for r in df.collect()] == [int(np.round(r * 127 / 63)) for r in range(64)]
    assert spark.range(1).select(D.row_pitch(F.lit(0), 1, offset=7).alias("p")).first()["p"] == 7


def test_mixture_separates_two_levels(spark):
    rng = np.random.default_rng(2)
    v = np.where(rng.random(400) < 0.3, rng.normal(0.8, 0.03, 400), rng.normal(0.2, 0.03, 400)).clip(0.01, 1)
    m = D.fit_mixture(plane(spark, {60: v.tolist()}), steps=400, n_bars=1)
    w, means, var = m.rows[60]
    assert sorted(means) == pytest.approx([0.2, 0.8], abs=0.02)
    t = m.thresholds()
    assert 0.4 < t[60] < 0.6 and t[5] == 0.0  # an all-silent row ends at zero
    assert D.mixture_threshold([0.2, 0.8], [0.1, 0.3]) == pytest.approx((0.2 * 0.3 + 0.8 * 0.1) / 0.4)
    assert D.mixture_threshold([0.1, 0.5, 0.9], [0.1, 0.1, 0.1]) == pytest.approx(0.7)
    assert D.fit_mixture(plane(spark, {60: [0.5]}), steps=3, n_bars=1).thresholds()[60] == 0.5  # too few values


def viterbi(obs, p):
    n = len(obs)
    g = lambda x, m, s: -0.5 * ((x - m) / s) ** 2 - np.log(s * np.sqrt(2 * np.pi))
    best, path = -np.inf, None
    for states in itertools.product([0, 1], repeat=n):
        s = np.log(p.prior_on if states[0] else 1 - p.prior_on)
        for t in range(n):
            if t:
                s += np.log({(0, 0): 1 - p.p_onset, (0, 1): p.p_onset, (1, 0): p.p_offset, (1, 1): 1 - p.p_offset}[states[t - 1], states[t]])
            s += g(obs[t], p.mu_on, p.sigma_on) if states[t] else g(obs[t], p.mu_off, p.sigma_off)
        if s > best + 1e-12:
            best, path = s, states
    return path


def test_best_path_is_optimal():
    rng = np.random.default_rng(3)
    p = D.HmmParams(sigma_on=0.3, sigma_off=0.25)
    obs = rng.random((40, 8))
    got = D.best_path(obs, p)
    for o, s in zip(obs, got):
        assert tuple(int(x) for x in s) == viterbi(o, p)


def test_hmm_detects_rows(spark, rows):
    p = D.HmmParams(sigma_on=0.3, sigma_off=0.25)
    want = expected(rows, lambda v: D.best_path(v[None], p)[0])
    assert found(D.hmm_tracker(plane(spark, rows), p, steps=24)) == want
    # parameters that call silence a note reach the rows without pixels
    odd = D.HmmParams(mu_on=0.0, mu_off=1.0)
    assert len(found(D.hmm_tracker(plane(spark, {3: [0.1]}), odd, steps=4))) == 128


def test_hmm_fit_counts(spark):
    true = ingest.notes_to_segments(notes(spark, [(60, 0, 3, 90), (60, 6, 8, 90), (64, 2, 4, 90)]), 8, 1)
    p = D.fit_hmm(plane(spark, {60: [0.9, 0.8, 0.7, 0.1, 0, 0, 0.6, 0.6], 64: [0, 0, 0.5, 0.7]}), true, steps=8, width=8)
    on = np.array([0.9, 0.8, 0.7, 0.6, 0.6, 0.5, 0.7])
    assert p.mu_on == pytest.approx(on.mean()) and p.sigma_on == pytest.approx(on.std())
    assert p.mu_off == pytest.approx(0.1 / (128 * 8 - 7)) and p.sigma_off == 0.05
    assert p.p_offset == pytest.approx(2 / 6, abs=1e-5)  # stays: 2 + 1 + 1, ends: 2, the last run meets the border
    assert p.p_onset == pytest.approx(2 / (128 * 7 - 6), abs=1e-6)


def test_strategy_lookup(spark):
    bars = spark.createDataFrame([(1, 0, 0), (1, 0, 1)], "song_id BIGINT, track_idx INT, bar_index INT")
    known = spark.createDataFrame([(1, 0, 1, "vos")], "song_id BIGINT, track_idx INT, bar_index INT, strategy STRING")
    assert [r["strategy"] for r in D.with_strategy(bars, known).orderBy("bar_index").collect()] == ["velocity_only", "vos"]


def test_a_row_of_the_mixture_depends_on_no_other(spark):
    rng = np.random.default_rng(3)
    rows = {r: np.clip(rng.normal(0.2 + 0.01 * r, 0.05, 200), 0.01, 1).tolist()[:100] + np.clip(rng.normal(0.8, 0.02 * r + 0.01, 100), 0.01, 1).tolist() for r in (1, 2, 9)}
    both = D.fit_mixture(plane(spark, rows), steps=200, n_bars=1)
    for r in rows:
        alone = D.fit_mixture(plane(spark, {r: rows[r]}), steps=200, n_bars=1)
        assert np.array(alone.rows[r]) == pytest.approx(np.array(both.rows[r]))
