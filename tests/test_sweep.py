"""The sweep over conditions against detection and scores of one condition at a time."""

import pytest
from helpers import notes
from pyspark.sql import functions as F

from staffline.keys import BAR
from staffline.operators import detect, ingest, note_metrics, render
from staffline.plans import experiment, sweep

ROWS = [(60, 0, 24, 100), (60, 24, 30, 20), (64, 24, 48, 80), (67, 40, 43, 30), (72, 96, 130, 110), (61, 100, 101, 127)]


def dim(pixels):
    return pixels.withColumn("levels", F.transform("levels", lambda v, i: v * (1 - 0.01 * ((F.col("col") + i) % 50))))


def test_every_condition_is_as_it_is_alone_and_no_position_is_a_row(spark):
    frames = [notes(spark, [(p, a + s, b + s, v) for p, a, b, v in ROWS], s, 0) for s in range(4)]
    true = ingest.notes_to_segments(frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3]), n_bars=2).cache()
    table = sweep.conditions(spark, ["plain", "dim"], ["velocity_only", "vo_split"], {
        "half": sweep.detector("global", threshold=0.5), "two": sweep.detector("hysteresis", tau_on=0.5, tau_off=0.15, min_duration=2),
        "aware": sweep.detector("velocity_aware", threshold=0.4, onset_boost=2.0),
    })
    means = sweep.sweep(true, {"plain": lambda p: p, "dim": dim}, table)
    plan = means._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    got = {(r["condition"], r["metric"]): r["value"] for r in means.collect()}
    assert len({c for c, _ in got}) == 12
    for codec, change in (("plain", lambda p: p), ("dim", dim)):
        for strategy in ("velocity_only", "vo_split"):
            positions = change(render.strips(true, strategy)).selectExpr(*BAR, "channel", "row", "col", "posexplode(levels) AS (k, value)")
            positions = positions.selectExpr(*BAR, "channel", "row", "CAST(col + k AS INT) AS step", "value")
            plane, onset = (positions.where(F.col("channel") == c).drop("channel") for c in (0, 1))
            for name, found in (
                ("half", detect.global_threshold(plane, 0.5)), ("two", detect.hysteresis(plane, 0.5, 0.15, 2)),
                ("aware", detect.velocity_aware(plane, onset if strategy == "vo_split" else None, 0.4, 2.0)),
            ):
                scores = note_metrics.bar_scores(true, found.withColumn("n", F.lit(1)), ["steps", "classes", "onsets"])
                for r in experiment.summarise(experiment.to_long(scores, BAR), []).collect():
                    assert got["__".join((codec, strategy, name)), r["metric"]] == pytest.approx(r["value"], abs=1e-9)
