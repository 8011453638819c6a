"""The whole experiment as one lazy plan: ingest, render, codec, detect, evaluate, summarise."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffline.keys import BAR, PITCHES, STEPS, VELOCITY_MAX
from staffline.operators import codec, detect, image_metrics, note_arrays, note_metrics, packed, render
from staffline.operators.ingest import (
    cells_to_segments,
    common_grid,
    keep_valid,
    notes_to_segments,
    segments_to_cells,
    track_name,
    with_bar_steps,
)

Detector = Callable[[DataFrame], DataFrame]


def ingest(
    notes: DataFrame, steps: int = STEPS, n_bars: int | None = None, min_notes: int = 0, signatures: DataFrame | None = None
) -> DataFrame:
    """Segments of the bars that pass the note-count threshold, on a grid of ``steps``.

    With ``signatures`` (song, num, den) each song is cut by its own bar length and stretched to the grid; songs without a supported
    signature go. Velocities that the stretching makes fractional stay so.
    """
    if signatures is None:
        segments = notes_to_segments(notes, steps, n_bars)
    else:
        own = notes_to_segments(with_bar_steps(notes, signatures), n_bars=n_bars)
        segments = cells_to_segments(common_grid(segments_to_cells(own), steps))
    return keep_valid(segments, min_notes) if min_notes > 0 else segments


def reconstruct(cells: DataFrame, size: tuple[int, int] = (PITCHES, STEPS)) -> DataFrame:
    """Velocity plane after the pooling codec."""
    pixels = render.render(cells, "velocity_only")
    out = codec.pool_decode(codec.pool_encode(pixels, size), size)
    return out.filter("channel = 0 AND level > 0").select(
        *BAR, "row", F.col("col").alias("step"), F.least(F.lit(1.0), F.col("level")).alias("value")
    )


#: Scores of a bar's decoded plane and of the notes in it, beside those of its pixels.
_ROWS, _NOTES = ("note_entropy_diff", "activation_sparsity_recon"), ("steps", "onsets")


def _decoded(true: DataFrame, threshold: float, most: int = 1024) -> DataFrame:
    """(bar, scores) of the pooling codec's planes: encoded, decoded, searched for notes and scored in one Arrow function over ``most`` bars at once.

    Planes and notes exist only inside a task, so nothing of theirs is written down or shuffled.
    """
    note = F.struct("pitch", "on", "off", F.col("velocity").cast("double").alias("velocity"), "starts")
    bars = true.groupBy(*BAR).agg(F.collect_list(note).alias("t"))
    names = [*_ROWS, *[name for family in _NOTES for name in note_metrics.FAMILIES[family]]]
    (low, narrow), size = codec.POOL, PITCHES * STEPS
    high, wide = PITCHES // low, STEPS // narrow

    def score(batch: pa.RecordBatch) -> list:
        n = len(batch)
        notes = note_arrays.side(batch.column("t"), ("pitch", "on", "off", "velocity", "starts"))
        bar, c = notes
        length = c["off"] - c["on"]
        at, pitch, level = (np.repeat(v, length) for v in (bar, c["pitch"], c["velocity"] / VELOCITY_MAX))
        step = np.repeat(c["on"] - np.cumsum(length) + length, length) + np.arange(length.sum())
        latent = at, pitch // high * narrow + step // wide, level / (high * wide)
        error, rows, runs = codec.decoded_arrays((at, pitch * STEPS + step, level), latent, n, threshold, image_metrics.SPARSITY_LEVEL)
        planes = [np.bincount(b * PITCHES + r, v, n * PITCHES).reshape(n, -1) for b, r, v in ((bar, c["pitch"], length), rows[:3])]
        truth, found = (note_arrays.entropy(p, PITCHES) for p in planes)
        sparse = (size - np.bincount(rows[0], rows[3], n)) / size
        velocity = np.clip(np.rint(np.round(runs[4] * VELOCITY_MAX, 9)), 1, VELOCITY_MAX)
        pred = runs[0], {"pitch": runs[1], "onset": runs[2], "offset": runs[3], "velocity": velocity, "n": np.ones(len(velocity), np.int64)}
        scores = dict(zip(_ROWS, (truth - found, sparse))) | note_metrics.score_arrays(notes, pred, n, _NOTES)
        has = np.bincount(bar[c["velocity"] != 0], minlength=n) > 0
        return [pa.array(4.0 * render.CHANNELS * error), pa.array(has), *[pa.array(scores[k], mask=np.isnan(scores[k])) for k in names]]

    scored = packed.per_bar(bars, {"ss": "double", "has_t": "boolean"} | dict.fromkeys(names, "double"), score, most)
    return image_metrics.scores_of_errors(scored, keep=names)


def run(
    notes: DataFrame, detector: Detector | None = None, n_bars: int | None = None, min_notes: int = 2, threshold: float = 0.05,
    signatures: DataFrame | None = None,
) -> DataFrame:
    """Means of the main scores per instrument for one condition.

    Without a ``detector`` a global ``threshold`` is used, below the detector's own default because the pooling codec
    spreads a note's level over its neighbours.
    """
    true = ingest(notes, STEPS, n_bars, min_notes, signatures)
    if detector is None and threshold > 0:
        bars = _decoded(true, threshold)
    else:
        cells = segments_to_cells(true)
        plane = reconstruct(cells)
        found = (detector or (lambda p: detect.global_threshold(p, threshold)))(plane)
        pixels = image_metrics.pixel_scores(render.strips(true), render.plane_pixels(plane))
        pred = found.withColumn("n", F.lit(1))  # detectors emit each note once, already by bar
        rows = image_metrics.row_scores(true, plane)
        steps = note_metrics.step_profiles(true, pred)
        onset = note_metrics.onset_scores(note_metrics.onset_arrays(true, pred))
        keys = list(BAR)
        bars = pixels.join(rows, keys, "left").join(steps, keys, "left").join(onset, keys, "left")
    names = (
        "pixel_mse", "psnr", "note_entropy_diff", "activation_sparsity_recon", "note_density_pearson",
        "velocity_mse", "velocity_correlation", "onset_precision", "onset_recall", "onset_f1",
    )
    instrument = track_name(F.col("track_idx"), F.lit(None).cast("string"))
    return bars.groupBy(instrument.alias("instrument")).agg(
        F.count(F.lit(1)).alias("bars"), *[F.avg(n).alias(n) for n in names]
    )
