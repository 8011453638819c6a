"""Ingest queries: notes, cells, masks, bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.keys import BAR, STEPS
from staffline.operators import ingest
from staffline.plans import derived, job
from staffline.plans.catalog import query
from staffline.plans.derived import with_tables
from staffline.sources import notes as note_sources

INSTRUMENT_SQL = (
    "CASE track_idx WHEN 0 THEN 'drums' WHEN 1 THEN 'piano' WHEN 2 THEN 'guitar' "
    "WHEN 3 THEN 'bass' ELSE 'strings' END"
)


def instrument_name():
    return ingest.track_name(F.col("track_idx"), F.lit(None).cast("string"))


@query(
    "bars_per_instrument",
    with_tables(f"""
    SELECT {INSTRUMENT_SQL} AS instrument, count(*) AS bars, CAST(sum(n) AS BIGINT) AS onsets
    FROM (SELECT song_id, track_idx, bar_index, count(*) AS n FROM onset_cells WHERE is_onset
          GROUP BY ALL HAVING count(*) >= 2)
    GROUP BY 1"""),
)
def bars_per_instrument(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = ingest.valid_bars(derived.segments(spark, sf_dir))
    return (
        bars.withColumn("instrument", instrument_name())
        .groupBy("instrument")
        .agg(F.count(F.lit(1)).alias("bars"), F.sum("note_count").alias("onsets"))
    )


@query(
    "instrument_mapping",
    with_tables(
        "SELECT program, instrument, count(*) AS n_notes, CAST(sum(velocity) AS BIGINT) AS velocity_sum "
        "FROM notes GROUP BY ALL"
    ),
)
def instrument_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        derived.notes(spark, sf_dir)
        .groupBy("program", "instrument")
        .agg(F.count(F.lit(1)).alias("n_notes"), F.sum("velocity").alias("velocity_sum"))
    )


@query(
    "track_names",
    """SELECT pos AS track_position, name AS track_name, count(*) AS n FROM (
         SELECT CAST(p_partkey % 7 AS INT) AS pos,
                CASE p_partkey % 7 WHEN 0 THEN 'drums' WHEN 1 THEN 'piano' WHEN 2 THEN 'guitar'
                     WHEN 3 THEN 'bass' WHEN 4 THEN 'strings'
                     ELSE replace(lower(p_name), ' ', '_') END AS name FROM part)
       GROUP BY ALL""",
)
def track_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = (F.col("p_partkey") % 7).cast("int")
    return (
        derived.table(spark, sf_dir, "part")
        .select(pos.alias("track_position"), ingest.track_name(pos, F.col("p_name")).alias("track_name"))
        .groupBy("track_position", "track_name")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tick-based note events with three resolutions, one of them invalid."""
    li = derived.table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_suppkey") % 3).cast("int").alias("kind"),
        F.expr("CASE l_suppkey % 3 WHEN 0 THEN 480 WHEN 1 THEN 96 ELSE 0 END").alias("ticks_per_quarter"),
        (F.col("l_partkey") * 17 + F.col("l_linenumber")).alias("start_tick"),
        (F.col("l_quantity").cast("bigint") * 11).alias("duration_ticks"),
        (F.col("l_partkey") % 140).cast("int").alias("pitch"),
        (F.col("l_orderkey") % 128).cast("int").alias("velocity"),
    )


_TICKS_SQL = """
  WITH raw AS (
    SELECT CAST(l_suppkey % 3 AS INT) AS kind, CASE l_suppkey % 3 WHEN 0 THEN 480 WHEN 1 THEN 96 ELSE 480 END AS tpq,
           l_partkey*17 + l_linenumber AS st, CAST(l_quantity AS BIGINT)*11 AS du,
           CAST(l_partkey % 140 AS INT) AS p, CAST(l_orderkey % 128 AS INT) AS velocity FROM lineitem),
  stepped AS (
    SELECT kind, least(127, p) AS pitch, velocity, CAST(st*24 // tpq AS INT) AS onset_step,
           CAST((st+du)*24 // tpq AS INT) AS offset_step FROM raw)"""


@query(
    "ticks_to_steps",
    _TICKS_SQL + """
    SELECT kind, count(*) AS n, CAST(sum(onset_step) AS BIGINT) AS onset_sum,
           CAST(sum(offset_step) AS BIGINT) AS offset_sum, CAST(sum(pitch) AS BIGINT) AS pitch_sum
    FROM stepped GROUP BY ALL""",
)
def ticks_to_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        ingest.ticks_to_steps(_ticks(spark, sf_dir))
        .groupBy("kind")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("onset_step").alias("onset_sum"),
            F.sum("offset_step").alias("offset_sum"),
            F.sum("pitch").alias("pitch_sum"),
        )
    )


@query(
    "rejected_notes",
    """SELECT reason, count(*) AS n FROM (
         SELECT CASE WHEN pitch NOT BETWEEN 0 AND 127 THEN 'pitch out of range'
                     WHEN velocity NOT BETWEEN 0 AND 127 THEN 'velocity out of range'
                     WHEN dur <= 0 THEN 'empty interval' ELSE 'valid' END AS reason
         FROM (SELECT l_partkey % 140 AS pitch, l_orderkey % 150 AS velocity,
                      CAST(l_quantity AS BIGINT) % 5 AS dur FROM lineitem)) GROUP BY ALL""",
)
def rejected_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = derived.table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 140).alias("pitch"),
        (F.col("l_orderkey") % 150).alias("velocity"),
        F.lit(0).alias("onset_step"),
        (F.col("l_quantity").cast("bigint") % 5).alias("offset_step"),
    )
    return (
        raw.select(F.coalesce(ingest.rejection_reason(), F.lit("valid")).alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


_SIGNATURE_EVENTS = """SELECT o_custkey % 5000 AS song_id, o_orderkey AS ord,
    CASE WHEN o_orderstatus <> 'P' THEN CAST(2 + o_orderkey % 6 AS INT) END AS num, CASE WHEN o_orderkey % 3 = 0 THEN 8 ELSE 4 END AS den FROM orders"""


@query(
    "song_signatures",
    f"""
    WITH ev AS ({_SIGNATURE_EVENTS}), songs AS (SELECT DISTINCT c_custkey % 5000 AS song_id FROM customer),
    ok AS (SELECT song_id, arg_min(num, ord) AS num, arg_min(den, ord) AS den FROM ev
           WHERE (num, den) IN ((2,4),(3,4),(4,4),(6,8)) GROUP BY 1),
    anyev AS (SELECT DISTINCT song_id FROM ev WHERE num IS NOT NULL)
    SELECT coalesce(num, 4) AS num, coalesce(den, 4) AS den, count(*) AS songs,
           CAST(sum(24 * coalesce(num, 4)) AS BIGINT) AS steps, CAST(sum(96 * coalesce(num, 4) // coalesce(den, 4)) AS BIGINT) AS roll_steps
    FROM songs LEFT JOIN ok USING (song_id) LEFT JOIN (SELECT song_id, true AS has FROM anyev) USING (song_id)
    WHERE has IS NULL OR num IS NOT NULL GROUP BY 1, 2""",
)
def song_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = derived.table(spark, sf_dir, "orders").selectExpr(
        "o_custkey % 5000 AS song_id",
        "o_orderkey AS ord",
        "CASE WHEN o_orderstatus <> 'P' THEN CAST(2 + o_orderkey % 6 AS INT) END AS num",
        "CASE WHEN o_orderkey % 3 = 0 THEN 8 ELSE 4 END AS den",
    )
    songs = derived.table(spark, sf_dir, "customer").selectExpr("c_custkey % 5000 AS song_id").distinct()
    num, den = F.col("num"), F.col("den")
    return (
        ingest.song_signatures(songs, events)
        .groupBy("num", "den")
        .agg(
            F.count(F.lit(1)).alias("songs"),
            F.sum(ingest.steps_per_bar(num, den)).alias("steps"),
            F.sum(ingest.steps_per_bar(num, den, use_denominator=True)).alias("roll_steps"),
        )
    )


@query(
    "song_tempo",
    """
    WITH t AS (SELECT o_custkey AS song_id, arg_min(60 + o_orderkey % 120, CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS q FROM orders GROUP BY 1)
    SELECT c_custkey AS song_id, CAST(coalesce(q, 120) AS DOUBLE) AS tempo
    FROM customer LEFT JOIN t ON c_custkey = song_id""",
)
def song_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = derived.table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS song_id", "o_orderkey AS tick", "CASE WHEN o_orderstatus = 'F' THEN 60 + o_orderkey % 120 END AS qpm"
    )
    songs = derived.table(spark, sf_dir, "customer").selectExpr("c_custkey AS song_id")
    return ingest.song_tempo(songs, events)


@query(
    "instrument_filter",
    with_tables(
        "SELECT instrument, pitch, count(*) AS n FROM notes WHERE instrument IN ('drums', 'bass') GROUP BY ALL"
    ),
)
def instrument_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ingest.keep_instruments(derived.notes(spark, sf_dir), ["drums", "bass"])
    return kept.groupBy("instrument", "pitch").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cells",
    with_tables("""
    SELECT song_id, track_idx, bar_index, count(*) AS n_cells,
           CAST(sum(velocity*(step+1)*(pitch+1)) AS BIGINT) AS checksum
    FROM cells GROUP BY ALL"""),
)
def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = F.sum(F.col("velocity").cast("bigint") * (F.col("step") + 1) * (F.col("pitch") + 1))
    return (
        derived.cells(spark, sf_dir)
        .groupBy(*BAR)
        .agg(F.count(F.lit(1)).alias("n_cells"), check.alias("checksum"))
    )


@query(
    "cells_complete_bars",
    with_tables("""
    , long_notes AS (SELECT *, offset_step + velocity // 12 AS end_step FROM notes),
    lengths AS (SELECT song_id, track_idx, (max(end_step) + 1) // 96 AS n_bars FROM long_notes GROUP BY ALL),
    c AS (SELECT DISTINCT song_id, track_idx, pitch, step FROM (
            SELECT *, unnest(range(onset_step, end_step)) AS step FROM long_notes))
    SELECT CAST(step // 96 AS INT) AS bar_index, count(*) AS n_cells,
           CAST(sum(pitch * (step % 96)) AS BIGINT) AS checksum
    FROM c JOIN lengths USING (song_id, track_idx) WHERE step // 96 < n_bars GROUP BY 1""".replace(", long_notes", "WITH long_notes", 1)),
)
def cells_complete_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer notes without a bar limit: the incomplete last bar of each track goes."""
    longer = derived.notes(spark, sf_dir).withColumn(
        "offset_step", F.col("offset_step") + F.floor(F.col("velocity") / 12)
    )
    c = ingest.notes_to_cells(longer, STEPS)
    return c.groupBy("bar_index").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum(F.col("pitch") * F.col("step")).alias("checksum")
    )


@query(
    "masks",
    with_tables("""
    SELECT song_id, track_idx, bar_index, count(*) FILTER (WHERE is_onset) AS onset_cells,
           count(*) FILTER (WHERE NOT is_onset) AS sustain_cells,
           CAST(sum(CASE WHEN is_onset THEN (pitch+1)*(step+1) ELSE 0 END) AS BIGINT) AS onset_checksum
    FROM onset_cells GROUP BY ALL"""),
)
def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = derived.cells(spark, sf_dir)
    place = (F.col("pitch") + 1) * (F.col("step") + 1)
    return m.groupBy(*BAR).agg(
        F.count_if("is_onset").alias("onset_cells"),
        F.count_if("is_sustain").alias("sustain_cells"),
        F.sum(F.when(F.col("is_onset"), place).otherwise(0)).alias("onset_checksum"),
    )


@query(
    "bar_index",
    with_tables(f"""
    SELECT song_id, track_idx, bar_index, CAST(count(*) AS INT) AS note_count,
           concat(song_id, '_', {INSTRUMENT_SQL}, '_', lpad(CAST(bar_index AS VARCHAR), 4, '0')) AS bar_id,
           substr(sha256(concat(song_id, '_', {INSTRUMENT_SQL}, '_', lpad(CAST(bar_index AS VARCHAR), 4, '0'))), 1, 16) AS content_key
    FROM onset_cells WHERE is_onset GROUP BY ALL HAVING count(*) >= 2"""),
)
def bar_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = ingest.valid_bars(derived.segments(spark, sf_dir)).withColumn("instrument", instrument_name())
    return bars.withColumn("bar_id", ingest.bar_id()).select(
        *BAR, "note_count", "bar_id", F.substring(F.sha2("bar_id", 256), 1, 16).alias("content_key")
    )


@query(
    "bars_capped_per_track",
    with_tables("""
    WITH v AS (SELECT song_id, track_idx, bar_index FROM onset_cells WHERE is_onset GROUP BY ALL HAVING count(*) >= 2)
    SELECT song_id, track_idx, bar_index FROM v
    QUALIFY row_number() OVER (PARTITION BY song_id, track_idx
                               ORDER BY md5(concat('42:', song_id, ':', track_idx, ':', bar_index))) <= 3"""),
)
def bars_capped_per_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = ingest.valid_bars(derived.segments(spark, sf_dir)).select(*BAR)
    return ingest.cap_bars(bars, 3)


@query(
    "resample_time",
    with_tables("""
    WITH taps AS (
      SELECT i, j, w FROM (
        SELECT i, floor(greatest((i + 0.5::DOUBLE) * 0.75::DOUBLE - 0.5::DOUBLE, 0)) AS base,
               greatest((i + 0.5::DOUBLE) * 0.75::DOUBLE - 0.5::DOUBLE, 0)
               - floor(greatest((i + 0.5::DOUBLE) * 0.75::DOUBLE - 0.5::DOUBLE, 0)) AS f FROM range(96) r(i)),
        LATERAL (SELECT CAST(base AS INT) AS j, 1 - f AS w UNION ALL
                 SELECT least(71, CAST(base AS INT) + 1), f) t),
    b AS (SELECT song_id, track_idx, CAST(step // 72 AS INT) AS bar_index, pitch, step % 72 AS step, arg_max(velocity, note_ord*128 + velocity) AS velocity FROM (
            SELECT *, unnest(range(onset_step, offset_step)) AS step
            FROM (SELECT *, (max(offset_step) OVER (PARTITION BY song_id, track_idx) + 1) // 72 * 72 AS whole FROM notes))
          WHERE step < whole GROUP BY 1, 2, 3, 4, 5),
    r AS (SELECT song_id, track_idx, bar_index, pitch, i AS step, sum(velocity*w) AS velocity
          FROM b JOIN taps ON b.step = taps.j GROUP BY ALL HAVING sum(velocity*w) > 0)
    SELECT bar_index, count(*) AS n_cells, round(sum(velocity), 3) AS mass, round(sum(velocity*step), 2) AS moment
    FROM r GROUP BY ALL"""),
)
def resample_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All notes in 3/4 bars of 72 steps stretched to 96."""
    return (
        ingest.resample_time(ingest.notes_to_cells(derived.notes(spark, sf_dir), 72), 72)
        .groupBy("bar_index")
        .agg(
            F.count(F.lit(1)).alias("n_cells"),
            F.round(F.sum("velocity"), 3).alias("mass"),
            F.round(F.sum(F.col("velocity") * F.col("step")), 2).alias("moment"),
        )
    )


_SIGNED = """
signed AS (SELECT s_suppkey AS song_id, CASE s_nationkey % 6 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 6 ELSE 4 END * 24 AS len FROM supplier WHERE s_nationkey % 6 <> 4),
won AS (SELECT song_id, track_idx, step // len AS bar_index, pitch, step % len AS step, any_value(len) AS len, arg_max(velocity, note_ord*128 + velocity) AS velocity
        FROM (SELECT n.song_id, track_idx, pitch, velocity, note_ord, len, unnest(range(onset_step, offset_step)) AS step FROM notes n JOIN signed USING (song_id)) GROUP BY 1, 2, 3, 4, 5),
whole AS (SELECT n.song_id, track_idx, (max(offset_step) + 1) // any_value(len) AS n_bars FROM notes n JOIN signed USING (song_id) GROUP BY ALL),
weights AS (SELECT len, i, j, sum(w) AS w FROM (
              SELECT len, i, CAST(floor(c) AS INT) AS a, c - floor(c) AS f FROM (SELECT len, i, greatest((i + 0.5::DOUBLE) * len / 96 - 0.5::DOUBLE, 0) AS c FROM range(96) r(i), (SELECT DISTINCT len FROM signed))),
            LATERAL (SELECT a AS j, 1 - f AS w UNION ALL SELECT least(len - 1, a + 1), f) t GROUP BY ALL),
grid AS (SELECT song_id, track_idx, bar_index, pitch, i AS step, sum(velocity * w) AS velocity FROM won JOIN whole USING (song_id, track_idx) JOIN weights ON weights.len = won.len AND weights.j = won.step
         WHERE bar_index < n_bars GROUP BY ALL HAVING sum(velocity * w) > 0)"""


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First supported signature of every song: mixed 4/4, 3/4, 2/4 and 6/8, some songs unsupported, some without any event."""
    s = derived.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("song_id"), (F.col("s_nationkey") % 6).alias("k"))
    kinds = {0: (4, 4), 1: (3, 4), 2: (2, 4), 3: (6, 8), 4: (5, 4)}  # 5: no event
    pick = lambda i: F.coalesce(*[F.when(F.col("k") == k, v[i]) for k, v in kinds.items()])
    first = s.where("k < 5").select("song_id", F.lit(2).alias("ord"), pick(0).alias("num"), pick(1).alias("den"))
    skipped = s.where("k < 5").select("song_id", F.lit(1).alias("ord"), F.lit(7).alias("num"), F.lit(8).alias("den"))
    return ingest.song_signatures(s.select("song_id"), first.unionByName(skipped))


@query(
    "bars_by_signature",
    with_tables(f"""
    WITH {_SIGNED}
    SELECT song_id, track_idx, CAST(bar_index AS INT) AS bar_index, count(*) AS n_cells, round(sum(velocity), 3) AS mass, round(sum(velocity * step), 2) AS moment FROM grid GROUP BY 1, 2, 3"""),
)
def bars_by_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every song cut by its own bar length, all bars on one grid of 96 steps."""
    notes = ingest.with_bar_steps(derived.notes(spark, sf_dir), signatures(spark, sf_dir))
    grid = ingest.common_grid(ingest.segments_to_cells(ingest.notes_to_segments(notes)))
    return grid.groupBy(*BAR).agg(
        F.count(F.lit(1)).alias("n_cells"), F.round(F.sum("velocity"), 3).alias("mass"), F.round(F.sum(F.col("velocity") * F.col("step")), 2).alias("moment")
    )


@query(
    "valid_bars_by_signature",
    with_tables(f"""
    WITH {_SIGNED},
    marked AS (SELECT *, coalesce(step - lag(step) OVER (PARTITION BY song_id, track_idx, bar_index, pitch ORDER BY step), 0) <> 1 AS is_onset FROM grid),
    v AS (SELECT song_id, track_idx, bar_index, sum(CASE WHEN is_onset THEN 1 ELSE 0 END) AS n FROM marked GROUP BY 1, 2, 3)
    SELECT song_id, track_idx, CAST(bar_index AS INT) AS bar_index, CAST(n AS INT) AS note_count FROM v WHERE n >= 3"""),
)
def valid_bars_by_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main path's ingest under signatures: bars with at least three notes."""
    true = job.ingest(derived.notes(spark, sf_dir), min_notes=3, signatures=signatures(spark, sf_dir))
    return ingest.bar_note_counts(true)


@query(
    "notes_from_files",
    """SELECT 'lineitem.parquet' AS file, l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines
       FROM lineitem GROUP BY ALL""",
)
def notes_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed scan of event files that keeps the file each row came from."""
    raw = note_sources.read_notes(
        spark, f"{sf_dir}/lineitem.parquet", schema="l_returnflag STRING, l_linenumber INT"
    )
    return (
        raw.groupBy(F.regexp_extract("source_path", "[^/]+$", 0).alias("file"), "l_returnflag")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))
    )
