"""Note events to piano-roll segments, cells, masks and bars.

A piano roll is kept as ``segments``: (bar, pitch, on, off, velocity, starts), the
intervals of constant note with velocity > 0, disjoint on each pitch and
hash-partitioned by bar so that per-bar operators run without another shuffle.
``starts`` is false when the pitch already sounds on the step before. One row stands
for tens of cells, and most scores need sums over intervals only; ``cells``, with a
row per (pitch, step), are made from segments where single positions matter.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staffline.functions import taps
from staffline.keys import BAR, INSTRUMENTS, PITCHES, STEPS, STEPS_PER_BEAT, TRACK
from staffline.operators.layout import by_bar
from staffline.operators.numbering import exact_sample
from staffline.operators.packed import listed

DEFAULT_TICKS = 480
DEFAULT_TEMPO = 120.0
# Accepted time signatures.
SUPPORTED_SIGNATURES = ((2, 4), (3, 4), (4, 4), (6, 8))


def program_instrument(program: Column, is_drum: Column) -> Column:
    """Instrument family of a MIDI program; everything unlisted is piano."""
    return (
        F.when(is_drum, "drums")
        .when(program.between(32, 39), "bass")
        .when(program.between(24, 31), "guitar")
        .when(program.between(0, 7), "piano")
        .when(program.between(40, 55), "strings")
        .otherwise("piano")
    )


def track_name(position: Column, name: Column) -> Column:
    """Name by position within the five-track layout; later tracks use their own cleaned name."""
    layout = F.array(*[F.lit(i) for i in INSTRUMENTS])
    own = F.regexp_replace(F.lower(name), " ", "_")
    return F.coalesce(F.get(layout, position), own, F.concat(F.lit("instrument_"), position.cast("string")))


def instrument_position(instrument: Column) -> Column:
    """Index of an instrument in the five-track layout."""
    layout = F.array(*[F.lit(i) for i in INSTRUMENTS])
    return (F.array_position(layout, instrument) - 1).cast("int")


def ticks_to_steps(notes: DataFrame, beat: int = STEPS_PER_BEAT) -> DataFrame:
    """Add onset_step and offset_step from start_tick, duration_ticks and ticks_per_quarter."""
    tpq = F.when(F.col("ticks_per_quarter") > 0, F.col("ticks_per_quarter")).otherwise(DEFAULT_TICKS)
    scale = F.lit(float(beat)) / tpq
    return (
        notes.withColumn("onset_step", F.floor(F.col("start_tick") * scale).cast("int"))
        .withColumn(
            "offset_step",
            F.floor((F.col("start_tick") + F.col("duration_ticks")) * scale).cast("int"),
        )
        .withColumn("pitch", F.greatest(F.lit(0), F.least(F.lit(PITCHES - 1), F.col("pitch"))))
    )


def rejection_reason() -> Column:
    """Why a note violates the data model; NULL for a valid note."""
    return (
        F.when(~F.col("pitch").between(0, 127), "pitch out of range")
        .when(~F.col("velocity").between(0, 127), "velocity out of range")
        .when(F.col("offset_step") <= F.col("onset_step"), "empty interval")
    )


def valid_notes(notes: DataFrame) -> DataFrame:
    return notes.filter(F.coalesce(rejection_reason(), F.lit("")) == "")


def rejected_notes(notes: DataFrame) -> DataFrame:
    """Quarantine table: the violating notes with the reason."""
    return notes.withColumn("reason", rejection_reason()).filter(F.col("reason").isNotNull())


def keep_instruments(notes: DataFrame, instruments: Sequence[str]) -> DataFrame:
    return notes.filter(F.col("instrument").isin(*instruments))


def song_signatures(songs: DataFrame, events: DataFrame, key: str = "song_id") -> DataFrame:
    """(song, num, den): first supported signature event; 4/4 without events; else dropped.

    ``events`` has (song, ord, num, den); an event without numbers is none. The aggregate keeps one struct per song,
    so any number of events per song combines before the shuffle.
    """
    supported = F.lit(False)
    for num, den in SUPPORTED_SIGNATURES:
        supported = supported | ((F.col("num") == num) & (F.col("den") == den))
    code = F.col("ord").cast("bigint") * 4096 + F.col("num") * 64 + F.col("den")
    first = events.groupBy(key).agg(F.min(F.when(supported, code)).alias("_c"), F.bool_or(F.col("num").isNotNull() & F.col("den").isNotNull()).alias("_any"))
    out = songs.select(key).join(first, key, "left").filter(~F.coalesce("_any", F.lit(False)) | F.col("_c").isNotNull())
    return out.select(
        key,
        F.coalesce((F.floor(F.col("_c") / 64) % 64).cast("int"), F.lit(4)).alias("num"),
        F.coalesce((F.col("_c") % 64).cast("int"), F.lit(4)).alias("den"),
    )


def song_tempo(songs: DataFrame, events: DataFrame, key: str = "song_id") -> DataFrame:
    """(song, tempo): first tempo event, 120 without one. ``events`` has (song, tick, qpm) and perhaps ``ord``.

    Events without a tempo are none. Events of one tick are taken in their order ``ord``, or by tempo where there is none.
    """
    order = F.struct("tick", "ord" if "ord" in events.columns else "qpm")
    first = events.groupBy(key).agg(F.min_by("qpm", F.when(F.col("qpm").isNotNull(), order)).alias("_q"))
    return songs.select(key).join(first, key, "left").select(
        key, F.coalesce(F.col("_q").cast("double"), F.lit(DEFAULT_TEMPO)).alias("tempo")
    )


def steps_per_bar(num: Column, den: Column, use_denominator: bool = False) -> Column:
    """24 per numerator beat; the denominator counts only for roll-archive inputs."""
    if use_denominator:
        return F.floor(F.lit(STEPS_PER_BEAT * 4) * num / den).cast("int")
    return (F.lit(STEPS_PER_BEAT) * num).cast("int")


#: Name of the column with a song's own steps per bar, in notes, pieces, segments and cells.
BAR_STEPS = "bar_steps"


def with_bar_steps(notes: DataFrame, signatures: DataFrame, use_denominator: bool = False) -> DataFrame:
    """Notes with the steps per bar of their song's signature (see ``song_signatures``); songs without a supported one go."""
    lengths = signatures.select("song_id", steps_per_bar(F.col("num"), F.col("den"), use_denominator).alias(BAR_STEPS))
    return notes.join(lengths, "song_id")


def _length(notes: DataFrame, steps: int) -> Column:
    return F.col(BAR_STEPS) if BAR_STEPS in notes.columns else F.lit(steps)


def _own(frame: DataFrame) -> list[str]:
    """The column of own lengths where there is one; it follows from the bar, so it may join any grouping by bar."""
    return [c for c in (BAR_STEPS,) if c in frame.columns]


def bar_pieces(notes: DataFrame, steps: int = STEPS, n_bars: int | None = None) -> DataFrame:
    """Cut notes at bar lines: (bar, pitch, on, off, stamp), hash-partitioned by bar.

    Notes with a column ``bar_steps`` are cut by the length of their own song's bars and keep the column.

    ``stamp`` packs the note's order above its velocity, so "the later note wins"
    is a plain ``max`` of a BIGINT. Notes that agree in bar, pitch and interval are
    combined before the bar shuffle: however many notes one bar receives, at most
    128 * steps * (steps + 1) / 2 of them reach its task.
    """
    n = notes.filter(F.col("offset_step") > F.col("onset_step"))
    length, own = _length(notes, steps), _own(notes)
    first = F.floor(F.col("onset_step") / length).cast("int")
    last = F.floor((F.col("offset_step") - 1) / length).cast("int")
    pieces = n.select(
        *TRACK,
        *own,
        "pitch",
        "onset_step",
        "offset_step",
        (F.col("note_ord") * 128 + F.col("velocity")).cast("bigint").alias("stamp"),
        F.explode(F.sequence(first, last)).alias("bar_index"),
    )
    if n_bars is not None:
        pieces = pieces.filter(F.col("bar_index") < n_bars)
    start = F.col("bar_index") * length
    combined = (
        pieces.select(
            *BAR,
            *own,
            F.col("pitch").cast("int").alias("pitch"),
            F.greatest(F.col("onset_step") - start, F.lit(0)).cast("int").alias("on"),
            F.least(F.col("offset_step") - start, length).cast("int").alias("off"),
            "stamp",
        )
        .groupBy(*BAR, *own, "pitch", "on", "off")
        .agg(F.max("stamp").alias("stamp"))
    )
    return by_bar(combined)


def notes_to_segments(notes: DataFrame, steps: int = STEPS, n_bars: int | None = None) -> DataFrame:
    """Sparse piano roll as disjoint intervals, partitioned by bar.

    On one (pitch, step) the note with the highest ``note_ord`` wins. A piece that
    shares its pitch with no other piece passes as it is; others are
    painted on their steps in the order of the notes, and equal neighbours are joined
    again. Without ``n_bars`` a track keeps floor((last offset + 1) / steps) bars: an
    incomplete last bar is dropped. ``steps`` is for notes without a column ``bar_steps``.
    """
    pieces = bar_pieces(notes, steps, n_bars)
    if n_bars is not None:
        return pieces_to_segments(pieces)
    # Only a track's last bar can be incomplete, so the join names that bar.
    incomplete = notes.groupBy(*TRACK).agg(
        F.floor((F.max("offset_step") + 1) / F.max(_length(notes, steps))).cast("int").alias("bar_index")
    )
    return pieces_to_segments(pieces, incomplete)


def merge_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces from several batches as those of one: equal intervals combined, partitioned by bar."""
    return by_bar(pieces.groupBy(*BAR, *_own(pieces), "pitch", "on", "off").agg(F.max("stamp").alias("stamp")))


def pieces_to_segments(pieces: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """Resolve overlaps between all pieces of a bar; ``pieces`` are partitioned by bar, and so is the result.

    A bar's pieces become one row, and an Arrow function resolves those of a batch of bars; pieces are not sorted as rows. Bars
    of ``without`` are left out.
    """
    bar = [*BAR, *_own(pieces)]
    piece = F.struct("pitch", "on", "off", "stamp")
    bars = pieces.where("stamp IS NOT NULL").groupBy(*bar).agg(F.collect_list(piece).alias("p"))
    if without is not None:
        bars = bars.join(without, list(BAR), "left_anti")
    kind = dict(pieces.dtypes)["pitch"]
    resolve = F.arrow_udf(_resolved, f"array<struct<pitch:{kind},on:int,off:int,velocity:int,starts:boolean>>")
    # Spark does not know the partitioning beyond a Python function, so the segments are laid by bar once for all their readers.
    return by_bar(bars.select(*bar, F.inline(resolve("p"))))


#: Positions that are painted at once, of one row at least.
_CELLS = 1 << 21


def _resolved(pieces: pa.Array) -> pa.Array:
    """The segments of each bar of a batch: on every position the highest stamp wins, equal neighbours are joined.

    A row (bar, pitch) with one piece passes as it is; others are painted in ascending order of their stamps.
    """
    flat = pieces.flatten()
    n = pc.list_value_length(pieces).to_numpy(zero_copy_only=False)
    known = flat.field("pitch").cast(pa.int64())
    low, high = (v.as_py() or 0 for v in pc.min_max(known).values())
    hole, span = low - 1, high - low + 2  # notes without a pitch share a row of their own
    pitch = known.fill_null(hole).to_numpy(zero_copy_only=False)
    on, off, stamp = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("on", "off", "stamp"))
    row = np.repeat(np.arange(len(pieces)), n) * span + pitch - hole
    order = np.lexsort((stamp, row))
    row, on, off, stamp = (c[order] for c in (row, on, off, stamp))
    first = np.flatnonzero(np.diff(row, prepend=-1))
    size = np.diff(np.append(first, len(row)))
    alone = first[size == 1]
    alone = alone[np.fmod(stamp[alone], 128) > 0]
    found = [(row[alone], on[alone], off[alone], stamp[alone], np.ones(len(alone), bool))]
    many, width = np.flatnonzero(size > 1), int(off.max(initial=1))
    for begin in range(0, len(many), max(1, _CELLS // width)):
        lines = many[begin:begin + max(1, _CELLS // width)]
        found.append(_painted(row[first[lines]], size[lines], first[lines], on, off, stamp, width))
    row, on, off, stamp, starts = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(row, kind="stable")
    row, on, off, stamp, starts = (c[order] for c in (row, on, off, stamp, starts))
    pitch = row % span + hole
    columns = {
        "pitch": pa.array(pitch, mask=pitch == hole).cast(flat.field("pitch").type), "on": pa.array(on, pa.int32()), "off": pa.array(off, pa.int32()),
        "velocity": pa.array(np.fmod(stamp, 128), pa.int32()), "starts": pa.array(starts),
    }
    return listed(row // span, columns, len(pieces))


def _painted(
    row: np.ndarray, size: np.ndarray, first: np.ndarray, on: np.ndarray, off: np.ndarray, stamp: np.ndarray, width: int
) -> tuple[np.ndarray, ...]:
    """(row, on, off, stamp, starts) of rows whose ``size`` pieces from ``first`` on are in ascending order of their stamps."""
    at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
    line, n = np.repeat(np.arange(len(row)), size), off[at] - on[at]
    plane = np.full(len(row) * width, np.iinfo(np.int64).min)  # no velocity
    reach = np.cumsum(n)
    cuts = np.searchsorted(reach, np.arange(0, reach[-1], _CELLS))
    for a, b in zip(cuts, [*cuts[1:], len(at)]):
        k = n[a:b]
        inside = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        plane[np.repeat(line[a:b] * width + on[at[a:b]], k) + inside] = np.repeat(stamp[at[a:b]], k)  # the last one stays
    plane = plane.reshape(-1, width)
    lit = np.zeros((len(row), width + 2), bool)
    lit[:, 1:-1] = np.fmod(plane, 128) > 0
    change = np.ones((len(row), width + 1), bool)
    change[:, 1:-1] = plane[:, 1:] != plane[:, :-1]
    line, begin = np.nonzero(lit[:, 1:-1] & change[:, :-1])
    end = np.nonzero(lit[:, 1:-1] & change[:, 1:])[1] + 1
    return row[line], begin, end, plane[line, begin], ~lit[line, begin]


def _join_neighbours(parts: DataFrame, same: str) -> DataFrame:
    """Join adjacent intervals of a pitch that agree in ``same``; add ``starts``."""
    row = [*BAR, *_own(parts), "pitch"]
    w = Window.partitionBy(*row).orderBy("on")
    apart = F.coalesce(F.lag("off").over(w) != F.col("on"), F.lit(True))
    new = apart | (F.lag(same).over(w) != F.col(same))
    marked = parts.withColumns({"_apart": apart, "_new": new})
    island = F.sum(F.when(F.col("_new"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        marked.withColumn("_i", island)
        .groupBy(*row, "_i")
        .agg(
            F.min("on").cast("int").alias("on"), F.max("off").cast("int").alias("off"),
            F.max(same).alias(same), F.bool_or(F.col("_new") & F.col("_apart")).alias("starts"),
        )
        .drop("_i")
    )


def segments_to_cells(segments: DataFrame) -> DataFrame:
    """(bar, pitch, step, velocity, is_onset, is_sustain): a row per sounding position."""
    own = _own(segments)
    cells = segments.select(
        *BAR, *own, "pitch", "velocity", "starts", "on", F.explode(F.sequence("on", F.col("off") - 1)).alias("step")
    )
    onset = F.col("starts") & (F.col("step") == F.col("on"))
    return cells.select(*BAR, *own, "pitch", "step", "velocity", onset.alias("is_onset"), (~onset).alias("is_sustain"))


def notes_to_cells(notes: DataFrame, steps: int = STEPS, n_bars: int | None = None) -> DataFrame:
    return segments_to_cells(notes_to_segments(notes, steps, n_bars))


def cells_to_segments(cells: DataFrame) -> DataFrame:
    """Run-length code cells of equal velocity; the frame should be partitioned by bar."""
    steps = cells.select(*BAR, "pitch", F.col("step").alias("on"), (F.col("step") + 1).alias("off"), "velocity")
    return _join_neighbours(steps, "velocity").select(*BAR, "pitch", "on", "off", "velocity", "starts")


def with_masks(cells: DataFrame) -> DataFrame:
    """Add is_onset and is_sustain to cells that come without segments.

    An onset is an active step whose predecessor in the bar is inactive; the first
    step of a bar counts.
    """
    w = Window.partitionBy(*BAR, "pitch").orderBy("step")
    before = F.lag("step").over(w)
    onset = F.coalesce(before != F.col("step") - 1, F.lit(True))
    return cells.withColumn("is_onset", onset).withColumn("is_sustain", ~F.col("is_onset"))


def bar_note_counts(segments: DataFrame) -> DataFrame:
    """(bar, note_count): onset cells per bar; back-to-back notes of one pitch merge."""
    return segments.groupBy(*BAR).agg(F.count_if("starts").cast("int").alias("note_count"))


def valid_bars(segments: DataFrame, min_notes: int = 2) -> DataFrame:
    return bar_note_counts(segments).filter(F.col("note_count") >= min_notes)


def keep_valid(segments: DataFrame, min_notes: int = 2) -> DataFrame:
    """Segments of the bars that pass the note-count threshold."""
    return segments.join(valid_bars(segments, min_notes).select(*BAR), list(BAR), "left_semi")


def cap_bars(
    bars: DataFrame, k: int, scope: Sequence[str] = TRACK, seed: int = 42
) -> DataFrame:
    """At most ``k`` bars per track (or per ``scope``), chosen by a seeded hash."""
    return exact_sample(bars, k, keys=BAR, by=scope, seed=seed)


def bar_id(song: str = "song_id", instrument: str = "instrument", bar: str = "bar_index") -> Column:
    """Display id; the key of a bar is (song_id, track_idx, bar_index)."""
    return F.format_string("%s_%s_%04d", F.col(song).cast("string"), F.col(instrument), F.col(bar))


def resample_time(cells: DataFrame, steps_in: int, steps_out: int = STEPS, method: str = "bilinear") -> DataFrame:
    """Stretch bars of another length to the common grid; velocities become fractional.

    Works on the sparse cells: each one is spread over the target steps that read it.
    """
    if steps_in == steps_out:
        return cells
    return (
        cells.select(
            *BAR, "pitch", "velocity",
            F.explode(taps.scatter(F.col("step"), steps_in, steps_out, method)).alias("t"),
        )
        .groupBy(*BAR, "pitch", F.col("t.to").alias("step"))
        .agg(F.sum(F.col("velocity") * F.col("t.w")).alias("velocity"))
        .filter(F.col("velocity") > 0)
    )


def common_grid(cells: DataFrame, steps: int = STEPS, method: str = "bilinear", lengths: Sequence[int] | None = None) -> DataFrame:
    """(bar, pitch, step, velocity): bars of their songs' own lengths on one grid, partitioned as before.

    The weights of each source length are looked up by the column ``bar_steps``; bars that have ``steps`` already pass as they
    are. ``lengths`` are those of the supported signatures unless named; a bar of another length is an error.
    """
    known = sorted(set(lengths or [num * STEPS_PER_BEAT for num, _ in SUPPORTED_SIGNATURES]))
    kind = "array<struct<to:int,w:double>>"
    targets = F.when(F.col(BAR_STEPS) == steps, F.array(F.struct(F.col("step").cast("int").alias("to"), F.lit(1.0).alias("w"))))
    for n in known:
        if n != steps:
            targets = targets.when(F.col(BAR_STEPS) == n, taps.scatter(F.col("step"), n, steps, method))
    other = F.raise_error(F.concat(F.lit("no weights for bars of this many steps: "), F.col(BAR_STEPS).cast("string"))).cast(kind)
    spread = cells.select(*BAR, "pitch", "velocity", F.explode(targets.otherwise(other)).alias("t"))
    return (
        spread.groupBy(*BAR, "pitch", F.col("t.to").alias("step"))
        .agg(F.sum(F.col("velocity") * F.col("t.w")).alias("velocity"))
        .filter("velocity > 0")
    )
