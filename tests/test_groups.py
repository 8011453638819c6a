"""Metrics of sequences and of whole tables in the evaluation, and what is used where notes or latents are missing."""

import math

import pytest
from helpers import ANCHOR, notes, plane, pred
from pyspark.sql import functions as F

from staffline.keys import BAR, TRACK
from staffline.operators import ingest, note_metrics, render
from staffline.plans import evaluate as E


def values(long):
    return {(r["song_id"], r["track_idx"], r["bar_index"], r["metric"]): r["value"] for r in long.collect()}


def bars(spark, n_songs=3, tracks=(0, 1)):
    """A true bar per song, track and position, moved by the song."""
    frames = [notes(spark, [(p + s, a + 96 * b, o + 96 * b, v) for b in range(3) for p, a, o, v in ANCHOR], s, t) for s in range(n_songs) for t in tracks]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return ingest.notes_to_segments(out, 96)


def detected(true):
    return true.select(*BAR, "pitch", F.col("on").alias("onset"), F.col("off").alias("offset"), F.col("velocity").cast("int").alias("velocity"), F.lit(1).alias("n"))


def test_groups_yield_all_their_names(spark):
    true = bars(spark)
    latents = true.select(*BAR).distinct().withColumn("z", F.array(*[F.sin(F.col("song_id") * 7 + F.col("track_idx") * 3 + F.col("bar_index") + i) for i in range(8)]))
    t = E.Tables(true, detected(true), latents=latents, latent_shape=(2, 2, 2), recon_pixels=None, plane=plane(spark, {60: [0.5] * 96}))
    found = values(E.evaluate(t, ["latent_space", "conditioning", "generative"]))
    names = {m for *_, m in found}
    want = {c for n in E.select_metrics(["latent_space", "conditioning", "generative"]) for c in getattr(E.METRICS[n], "columns", ("pitch_class_histogram_kl",))}
    assert names == want and len(E.select_metrics(["all"])) == 34
    assert {k[:3] for k in found if k[3] == "silhouette_score"} == {(None, None, None)}
    assert {k[2] for k in found if k[3] == "transition_entropy"} == {None} and len([k for k in found if k[3] == "transition_entropy"]) == 6
    assert found[(0, 0, None, "pitch_class_histogram_kl")] == pytest.approx(0, abs=1e-9)


def test_a_registered_state_is_summed_with_others_and_finalised(spark):
    calls = []

    def lengths(t):
        calls.append(1)
        return t.true.groupBy(*BAR).agg(F.sum(F.col("off") - F.col("on")).alias("cells"))

    state = lambda: {"c": F.sum("cells"), "n": F.count(F.lit(1))}
    try:
        E.register_sums("own/mean", lengths, state, lambda: {"mean_cells": F.col("c") / F.col("n")})
        E.register_sums("own/bars", lengths, lambda: {"n": F.count(F.lit(1))}, lambda: {"bars": F.col("n")})
        E.register_sums("own/all", lengths, state, lambda: {"all_cells": F.col("c")}, scope=())
        found = values(E.evaluate(E.Tables(bars(spark)), ["own/mean", "own/bars", "own/all"]))
    finally:
        for name in ("own/mean", "own/bars", "own/all"):
            E.METRICS.pop(name, None)
    assert len(calls) == 2  # one pass per scope
    assert found[(1, 0, None, "mean_cells")] == 96 and found[(1, 0, None, "bars")] == 3
    assert found[(None, None, None, "all_cells")] == 3 * 2 * 3 * 96


def test_bars_without_notes_score_by_their_image(spark):
    true = ingest.notes_to_segments(notes(spark, ANCHOR), 96)
    none = pred(spark, []).withColumn("n", F.lit(1))
    image = plane(spark, {60: [0.5] * 96, 64: [0.25] * 96})
    share = {0: 48, 4: 24, 7: 24}
    recon = {0: 48, 4: 24}
    dot = sum(share[k] * recon.get(k, 0) for k in share)
    want = dot / math.sqrt(sum(v * v for v in share.values()) * sum(v * v for v in recon.values()))
    got = note_metrics.pitch_alignment(true, none, image).first()["conditioning_pitch_alignment"]
    assert got == pytest.approx(want)
    assert note_metrics.pitch_alignment(true, none).first()["conditioning_pitch_alignment"] == 0.0
    assert note_metrics.pitch_class_kl(true, none).first()["pitch_class_histogram_kl"] == float("inf")
    assert 0 < note_metrics.pitch_class_kl(true, none, TRACK, image).first()["pitch_class_histogram_kl"] < 20
    half = plane(spark, {1: [1.0] * 96})  # row 1 of 2 is pitch 127, class 7
    assert note_metrics.pitch_class_shares(true, none, half, 2).first()["p7"] == 1.0


def test_features_without_latents_are_channel_means(spark):
    true = bars(spark, 2, (0,))
    pixels = render.plane_pixels(plane(spark, {3: [1.0] * 96}, song=1, bar=2))
    rows = {tuple(r[k] for k in BAR): r["z"] for r in E.features(E.Tables(true, recon_pixels=pixels)).collect()}
    assert len(rows) == 6 and rows[(0, 0, 0)] == [-1.0] * 3
    assert rows[(1, 0, 2)] == pytest.approx([2 / 128 - 1] * 3)
