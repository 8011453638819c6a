"""Only reconstructed bars are scored and counted, silent ones among them."""

import pytest
from helpers import notes, plane

from staffline.operators import detect, render
from staffline.operators.ingest import notes_to_segments, segments_to_cells
from staffline.plans.evaluate import Tables, evaluate, matched

ROWS = [(60, 0, 24, 100), (60, 96, 120, 80), (62, 192, 220, 90)]


def tables(spark, reconstructed):
    true = notes_to_segments(notes(spark, ROWS), n_bars=3)
    recon = plane(spark, {60: [0.5] * 24 + [0.0] * 72}, bar=0)
    bars = spark.createDataFrame([(1, 0, b) for b in reconstructed], "song_id BIGINT, track_idx INT, bar_index INT")
    return Tables(true, None, recon, render.render(segments_to_cells(true)), render.plane_pixels(recon), bars=bars)


@pytest.mark.parametrize("reconstructed", [[0], [0, 2], [0, 1, 2, 7]])
def test_unmatched_bars_are_skipped_and_silent_ones_stay(spark, reconstructed):
    found = evaluate(tables(spark, reconstructed), ["pixel_mse", "note_entropy_diff", "generative/bar_level_nll", "mutual_information_pitch_time"])
    for metric in ("pixel_mse", "bar_level_nll", "note_entropy_diff"):
        assert sorted(r.bar_index for r in found.where(f"metric = '{metric}'").collect()) == [b for b in reconstructed if b < 3]


def test_without_a_bar_table_every_true_bar_counts(spark):
    t = tables(spark, [0])
    all_bars = Tables(t.true, None, t.plane, t.true_pixels, t.recon_pixels)
    assert matched(all_bars) is all_bars
    assert evaluate(all_bars, ["pixel_mse"]).count() == 3


def test_fits_count_silent_bars(spark):
    t = tables(spark, [0, 1])
    loud = detect.fit_adaptive(t.plane, bars=t.bars.where("bar_index = 0"))
    half = detect.fit_adaptive(t.plane, bars=t.bars)
    assert half == detect.fit_adaptive(t.plane, n_bars=2) and half[60] < loud[60]
    with pytest.raises(ValueError):
        detect.fit_adaptive(t.plane)
    hmm = detect.fit_hmm(t.plane, t.true, bars=t.bars)
    only = matched(t)
    assert hmm == detect.fit_hmm(only.plane, only.true, n_bars=2)
