import random

import pytest
from helpers import ANCHOR, NOTE, notes, one
from pyspark.sql import functions as F

from staffline.keys import BAR
from staffline.operators import ingest


def cells_of(df):
    return {(r["bar_index"], r["pitch"], r["step"]): r["velocity"] for r in df.collect()}


def brute(rows, steps, n_bars):
    roll = {}
    for p, a, b, v in rows:
        for t in range(a, b):
            roll[p, t] = v
    return {(t // steps, p, t % steps): v for (p, t), v in roll.items() if v > 0 and t < steps * n_bars}


def test_anchor_bar(spark):
    seg = ingest.notes_to_segments(notes(spark, ANCHOR), 96, 1)
    assert one(ingest.bar_note_counts(seg))["note_count"] == 4
    cells = ingest.segments_to_cells(seg)
    assert cells.count() == 96
    assert sorted(r["step"] for r in cells.filter("is_onset").collect()) == [0, 24, 48, 72]


@pytest.mark.parametrize("seed", range(4))
def test_cells_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(120):
        a = rng.randrange(0, 90)
        rows.append((rng.choice([40, 41, 42]), a, a + rng.randrange(0, 20), rng.choice([0, 10, 50, 127])))
    n = notes(spark, rows)
    want = brute(rows, 24, 4)
    seg = ingest.notes_to_segments(n, 24, 4)
    assert cells_of(ingest.segments_to_cells(seg)) == want
    # masks from segments, from cells, and from the definition agree
    onset = {k for k in want if (k[0], k[1], k[2] - 1) not in want or k[2] == 0}
    for masked in (ingest.segments_to_cells(seg), ingest.with_masks(ingest.segments_to_cells(seg).drop("is_onset", "is_sustain"))):
        assert {(r["bar_index"], r["pitch"], r["step"]) for r in masked.filter("is_onset").collect()} == onset
        assert masked.filter("is_onset = is_sustain").count() == 0
    back = ingest.cells_to_segments(ingest.segments_to_cells(seg))
    assert cells_of(ingest.segments_to_cells(back)) == want


def test_back_to_back_notes_are_one_onset(spark):
    seg = ingest.notes_to_segments(notes(spark, [(60, 0, 10, 80), (60, 10, 20, 90)]), 96, 1)
    assert one(ingest.bar_note_counts(seg))["note_count"] == 1
    assert cells_of(ingest.segments_to_cells(seg))[0, 60, 10] == 90


def test_incomplete_last_bar_is_dropped(spark):
    seg = ingest.notes_to_segments(notes(spark, [(60, 0, 24, 80), (60, 30, 47, 80)]), 24)
    assert {r["bar_index"] for r in seg.collect()} == {0, 1}  # 47 + 1 steps make two bars
    seg = ingest.notes_to_segments(notes(spark, [(60, 0, 24, 80), (60, 30, 46, 80)]), 24)
    assert {r["bar_index"] for r in seg.collect()} == {0}


def test_min_notes_and_silent_tracks(spark):
    n = notes(spark, [(60, 0, 10, 80), (62, 30, 40, 80), (60, 100, 110, 80)]).unionByName(notes(spark, [(60, 0, 50, 0)], track=1))
    kept = ingest.keep_valid(ingest.notes_to_segments(n, 96, 2), 2)
    assert {(r["track_idx"], r["bar_index"]) for r in kept.collect()} == {(0, 0)}


def test_hot_bar_with_many_copies(spark):
    """One bar with most of the rows gives the same segments as its distinct notes."""
    hot = notes(spark, [(60, 0, 24, 100)] * 3000 + ANCHOR)
    cool = notes(spark, ANCHOR)
    seg = lambda n: cells_of(ingest.notes_to_cells(n.repartition(7), 96, 1))
    assert seg(hot) == seg(cool)
    assert ingest.bar_pieces(hot, 96, 1).count() == 4


def test_programs_and_names(spark):
    df = spark.createDataFrame([(p, False) for p in (0, 8, 24, 31, 32, 39, 40, 55, 56, 100)] + [(5, True)], "p INT, d BOOLEAN")
    got = [r[0] for r in df.select(ingest.program_instrument(F.col("p"), F.col("d"))).collect()]
    assert got == ["piano", "piano", "guitar", "guitar", "bass", "bass", "strings", "strings", "piano", "piano", "drums"]
    named = spark.createDataFrame([(0, "X Y"), (4, None), (5, "My Lead"), (6, None)], "i INT, n STRING")
    assert [r[0] for r in named.select(ingest.track_name(F.col("i"), F.col("n"))).collect()] == [
        "drums", "strings", "my_lead", "instrument_6",
    ]


def test_ticks(spark):
    raw = spark.createDataFrame([(481, 478, 480, 130), (5, 5, 0, -3)], "start_tick BIGINT, duration_ticks BIGINT, ticks_per_quarter INT, pitch INT")
    r = ingest.ticks_to_steps(raw).orderBy("start_tick").collect()
    assert [(x["onset_step"], x["offset_step"], x["pitch"]) for x in r] == [(0, 0, 0), (24, 47, 127)]


def test_rejections(spark):
    bad = spark.createDataFrame([(128, 5, 0, 1), (5, 200, 0, 1), (5, 5, 3, 3), (5, 5, 0, 1)], "pitch INT, velocity INT, onset_step INT, offset_step INT")
    assert ingest.valid_notes(bad).count() == 1
    assert {r["reason"] for r in ingest.rejected_notes(bad).collect()} == {"pitch out of range", "velocity out of range", "empty interval"}


def test_signatures_and_tempo(spark):
    songs = spark.createDataFrame([(i,) for i in range(5)], "song_id BIGINT")
    ev = spark.createDataFrame(
        [(0, 0, 3, 4), (0, 1, 4, 4), (1, 0, 5, 4), (1, 1, 6, 8), (2, 0, 7, 8)], "song_id BIGINT, ord INT, num INT, den INT"
    )
    got = {r["song_id"]: (r["num"], r["den"]) for r in ingest.song_signatures(songs, ev).collect()}
    assert got == {0: (3, 4), 1: (6, 8), 3: (4, 4), 4: (4, 4)}  # song 2 has no supported one
    tempo = spark.createDataFrame([(0, 10, 90.0), (0, 0, 100.0)], "song_id BIGINT, tick INT, qpm DOUBLE")
    got = {r["song_id"]: r["tempo"] for r in ingest.song_tempo(songs, tempo).collect()}
    assert got[0] == 100.0 and got[1] == 120.0


def test_cap_is_exact_and_stable(spark):
    bars = spark.range(200).selectExpr("id % 2 AS song_id", "0 AS track_idx", "CAST(id AS INT) AS bar_index")
    a = ingest.cap_bars(bars, 7)
    b = ingest.cap_bars(bars.repartition(13), 7)
    assert a.groupBy("song_id").count().filter("count <> 7").count() == 0
    assert a.select(*BAR).exceptAll(b.select(*BAR)).count() == 0


def test_overlaps_are_resolved_inside_bars_without_sorting_notes(spark):
    """Against painting position by position, notes of several bars, silent ones and one without a pitch included."""
    rng = random.Random(3)
    rows = [(s, 0, rng.choice([None, 60, 61, 127]), a := rng.randrange(0, 60), a + rng.randrange(1, 30), rng.randrange(0, 128), i)
            for i, s in enumerate([1, 2] * 60)]
    found = ingest.notes_to_segments(spark.createDataFrame(rows, NOTE), 24, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 3
    cells = {}
    for s, _, p, a, b, v, i in rows:
        for t in range(a, min(b, 96)):
            cells[s, p, t] = max(cells.get((s, p, t), (-1, 0)), (i, v))
    cells = {k: c for k, c in cells.items() if c[1] > 0}
    got = {}
    for r in found.collect():
        for t in range(r["on"], r["off"]):
            key = r["song_id"], r["pitch"], r["bar_index"] * 24 + t
            assert key not in got
            got[key] = r["velocity"], r["starts"] and t == r["on"]
    before = lambda k: (k[0], k[1], k[2] - 1) in cells and k[2] % 24 > 0
    assert got == {k: (v, not before(k)) for k, (_, v) in cells.items()}
