"""Note tables derived from order lines, used by the registered queries.

The rule is arithmetic, so the same text runs in any SQL engine (see ``SQL``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.keys import BAR, STEPS, TRACK
from staffline.operators.ingest import (
    instrument_position,
    notes_to_segments,
    program_instrument,
    segments_to_cells,
)

#: Notes up to this velocity are not in the reconstruction.
SOFTEST = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes_of(table(spark, sf_dir, "lineitem"))


def notes_of(li: DataFrame) -> DataFrame:
    part, order, line = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    raw = li.select(
        F.col("l_suppkey").alias("song_id"),
        (F.col("l_returnflag") == "R").alias("is_drum"),
        (part % 56).cast("int").alias("program"),
        (order % 8).cast("int").alias("bar_index"),
        ((line * 13 + part) % 96).cast("int").alias("on_in_bar"),
        (24 + (part * 7 + order) % 80).cast("int").alias("pitch"),
        (1 + F.col("l_quantity").cast("bigint") % 24).cast("int").alias("dur"),
        (1 + F.floor("l_extendedprice") % 127).cast("int").alias("velocity"),
        (order * 8 + line).alias("note_ord"),
    )
    named = raw.withColumn("instrument", program_instrument(F.col("program"), F.col("is_drum")))
    return named.select(
        "song_id",
        instrument_position(F.col("instrument")).alias("track_idx"),
        "instrument",
        "program",
        "pitch",
        "bar_index",
        "on_in_bar",
        (F.col("bar_index") * STEPS + F.col("on_in_bar")).alias("onset_step"),
        (F.col("bar_index") * STEPS + F.col("on_in_bar") + F.col("dur")).alias("offset_step"),
        "dur",
        "velocity",
        "note_ord",
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes_to_segments(notes(spark, sf_dir), STEPS)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments_to_cells(segments(spark, sf_dir))


def rec_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reconstruction's notes, relative to their bar; ends may pass the bar line. It loses the softest notes."""
    n = notes(spark, sf_dir).filter(F.col("velocity") > SOFTEST)
    moved = F.greatest(
        F.lit(0), F.least(F.lit(95), F.col("on_in_bar") + (F.col("note_ord") % 3).cast("int") - 1)
    )
    return n.select(
        *BAR,
        "instrument",
        "pitch",
        moved.alias("onset"),
        (moved + F.col("dur")).alias("offset"),
        F.greatest(
            F.lit(1), F.least(F.lit(127), F.col("velocity") + (F.col("note_ord") % 11).cast("int") - 5)
        ).alias("velocity"),
        "note_ord",
    )


def rec_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rec_notes(spark, sf_dir).select(
        *TRACK,
        "pitch",
        "velocity",
        "note_ord",
        (F.col("bar_index") * STEPS + F.col("onset")).alias("onset_step"),
        (F.col("bar_index") * STEPS + F.col("offset")).alias("offset_step"),
    )
    return notes_to_segments(r, STEPS)


def rec_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments_to_cells(rec_segments(spark, sf_dir))


def _ripple(pitch: Column, step: Column) -> Column:
    return 0.7 + 0.3 * ((pitch * 7 + step * 13) % 10) / 9


def recon_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`recon_plane` as strips, (bar, row, step, values, starts): a row per segment."""
    s = rec_segments(spark, sf_dir)
    level = lambda t: F.col("velocity") / 127 * _ripple(F.col("pitch"), t)
    values = F.transform(F.sequence("on", F.col("off") - 1), level)
    return s.select(*BAR, F.col("pitch").alias("row"), F.col("on").alias("step"), values.alias("values"), "starts")


def recon_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bar, row, step, value): continuous velocity plane in [0, 1], zeros omitted."""
    return plane_of(rec_segments(spark, sf_dir))


def plane_of(rec: DataFrame) -> DataFrame:
    """:func:`recon_plane` of the reconstruction's segments."""
    c = segments_to_cells(rec)
    return c.select(
        *BAR, F.col("pitch").alias("row"), "step", (F.col("velocity") / 127 * _ripple(F.col("pitch"), F.col("step"))).alias("value")
    )


SQL = """
notes AS (
  SELECT song_id, CASE instrument WHEN 'drums' THEN 0 WHEN 'piano' THEN 1 WHEN 'guitar' THEN 2
                                  WHEN 'bass' THEN 3 ELSE 4 END AS track_idx,
         instrument, program, pitch, bar_index, on_in_bar, bar_index*96 + on_in_bar AS onset_step,
         bar_index*96 + on_in_bar + dur AS offset_step, dur, velocity, note_ord
  FROM (SELECT *, CASE WHEN is_drum THEN 'drums'
                       WHEN program BETWEEN 32 AND 39 THEN 'bass'
                       WHEN program BETWEEN 24 AND 31 THEN 'guitar'
                       WHEN program BETWEEN 0 AND 7 THEN 'piano'
                       WHEN program BETWEEN 40 AND 55 THEN 'strings'
                       ELSE 'piano' END AS instrument
        FROM (SELECT l_suppkey AS song_id, l_returnflag = 'R' AS is_drum,
                     CAST(l_partkey % 56 AS INT) AS program,
                     CAST(l_orderkey % 8 AS INT) AS bar_index,
                     CAST((l_linenumber*13 + l_partkey) % 96 AS INT) AS on_in_bar,
                     CAST(24 + (l_partkey*7 + l_orderkey) % 80 AS INT) AS pitch,
                     CAST(1 + CAST(l_quantity AS BIGINT) % 24 AS INT) AS dur,
                     CAST(1 + CAST(floor(l_extendedprice) AS BIGINT) % 127 AS INT) AS velocity,
                     l_orderkey*8 + l_linenumber AS note_ord
              FROM lineitem) a) b),
cells AS (
  SELECT song_id, track_idx, CAST(step // 96 AS INT) AS bar_index, pitch, CAST(step % 96 AS INT) AS step,
         arg_max(velocity, note_ord*128 + velocity) AS velocity
  FROM (SELECT *, unnest(range(onset_step, offset_step)) AS step
        FROM (SELECT *, (max(offset_step) OVER (PARTITION BY song_id, track_idx) + 1) // 96 * 96 AS whole FROM notes))
  WHERE step < whole
  GROUP BY 1, 2, 3, 4, 5),
rec_notes AS (
  SELECT song_id, track_idx, instrument, bar_index, pitch, onset, onset + dur AS "offset",
         greatest(1, least(127, velocity + CAST(note_ord % 11 AS INT) - 5)) AS velocity, note_ord
  FROM (SELECT *, greatest(0, least(95, on_in_bar + CAST(note_ord % 3 AS INT) - 1)) AS onset FROM notes)
  WHERE velocity > 12),
rec_cells AS (
  SELECT song_id, track_idx, CAST(step // 96 AS INT) AS bar_index, pitch, CAST(step % 96 AS INT) AS step,
         arg_max(velocity, note_ord*128 + velocity) AS velocity
  FROM (SELECT *, unnest(range(bar_index*96 + onset, bar_index*96 + "offset")) AS step
        FROM (SELECT *, (max(bar_index*96 + "offset") OVER (PARTITION BY song_id, track_idx) + 1) // 96 * 96 AS whole FROM rec_notes))
  WHERE step < whole
  GROUP BY 1, 2, 3, 4, 5),
recon_plane AS (
  SELECT song_id, track_idx, bar_index, pitch AS "row", step,
         velocity / 127.0::DOUBLE * (0.7::DOUBLE + 0.3::DOUBLE * ((pitch*7 + step*13) % 10) / 9.0::DOUBLE) AS value
  FROM rec_cells),
onset_cells AS (
  SELECT c.*, coalesce(step - lag(step) OVER (PARTITION BY song_id, track_idx, bar_index, pitch ORDER BY step), 0) <> 1
         AS is_onset FROM cells c)
"""


def with_tables(query: str) -> str:
    """Prefix a query with the derived tables as common table expressions."""
    q = query.strip()
    if q.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + SQL + ", " + q[len("WITH RECURSIVE"):]
    if q.upper().startswith("WITH"):
        return "WITH " + SQL + ", " + q[4:]
    return "WITH " + SQL + q
