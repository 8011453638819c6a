"""Render queries: channel layouts, ranges, resizing, padding, codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.functions import taps
from staffline.keys import BAR
from staffline.operators import codec, render
from staffline.plans import derived
from staffline.plans.catalog import query, rounded, stable
from staffline.plans.derived import with_tables


def checksum(pixels: DataFrame, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Per bar and channel: stored pixels, sum of values and a position-weighted sum; pixels may come as strips."""
    if "levels" in pixels.columns:
        parts = pixels.select(*BAR, "channel", "copies", "row", F.col("col").alias("first"), F.posexplode("levels").alias("i", "level"))
        pixels = parts.withColumn("col", F.col("first") + F.col("i"))
    value = render.to_range(F.col("level"), low, high)
    place = (F.col("row") * 3 + F.col("col") + 1) % 101
    return (
        pixels.groupBy(*BAR, "channel", "copies")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(value).alias("value_sum"),
            F.sum(F.col("level") * place).alias("placed"),
        )
        .transform(lambda d: rounded(d, BAR, 5))
    )


_SUMS = """count(*) AS n, round(sum(value) + 1e-10, 5) + 0.0 AS value_sum,
           round(sum((value + 1) / 2 * (("row"*3 + "col" + 1) % 101)) + 1e-10, 5) + 0.0 AS placed"""

_V = "velocity / 127.0::DOUBLE * 2 - 1"


@query(
    "render_velocity_only",
    with_tables(f"""
    SELECT song_id, track_idx, bar_index, 0 AS channel, 3 AS copies, {_SUMS}
    FROM (SELECT *, pitch AS "row", step AS "col", {_V} AS value FROM cells) GROUP BY ALL"""),
)
def render_velocity_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checksum(render.render(derived.cells(spark, sf_dir), "velocity_only"))


@query(
    "render_vo_split_width",
    with_tables(f"""
    SELECT song_id, track_idx, bar_index, channel, 1 AS copies, {_SUMS} FROM (
      SELECT song_id, track_idx, bar_index, step AS "row", pitch AS "col", 0 AS channel, {_V} AS value FROM onset_cells
      UNION ALL SELECT song_id, track_idx, bar_index, step, pitch, 1, 1.0 FROM onset_cells WHERE is_onset)
    GROUP BY ALL"""),
)
def render_vo_split_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checksum(render.render(derived.cells(spark, sf_dir), "vo_split", pitch_axis="width"))


@query(
    "render_vos_flipped",
    with_tables(f"""
    SELECT song_id, track_idx, bar_index, channel, 1 AS copies, {_SUMS} FROM (
      SELECT song_id, track_idx, bar_index, 127 - pitch AS "row", step AS "col", 0 AS channel, {_V} AS value FROM onset_cells
      UNION ALL SELECT song_id, track_idx, bar_index, 127 - pitch, step, 1, 1.0 FROM onset_cells WHERE is_onset
      UNION ALL SELECT song_id, track_idx, bar_index, 127 - pitch, step, 2, 1.0 FROM onset_cells WHERE NOT is_onset)
    GROUP BY ALL"""),
)
def render_vos_flipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checksum(render.flip_rows(render.render(derived.cells(spark, sf_dir), "vos")))


@query(
    "pad_and_normalise",
    with_tables("""
    SELECT song_id, track_idx, bar_index, min("row") AS first_row, max("col") AS last_col,
           round(sum((x + 1) / 2) + 1e-10, 5) AS unit_sum
    FROM (SELECT *, pitch AS "row", step + 16 AS "col", velocity / 127.0::DOUBLE * 2 - 1 AS x FROM cells) GROUP BY 1, 2, 3"""),
)
def pad_and_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 128 x 96 image centred on 128 x 128, values mapped from [-1, 1] to [0, 1]."""
    prepare = render.compose([
        lambda c: render.render(c, "velocity_only"),
        lambda p: render.pad(p, (128, 96), 128),
    ])
    value = render.remap(render.to_range(F.col("level")), (0.0, 1.0))
    return derived.cells(spark, sf_dir).transform(prepare).groupBy(*BAR).agg(
        F.min("row").alias("first_row"), F.max("col").alias("last_col"), stable(F.sum(value), 5).alias("unit_sum")
    )


def _taps_sql(name: str, n_in: int, n_out: int, method: str) -> str:
    """Weight table of a resize as literal rows: fixed numbers that depend on the sizes only."""
    rows = ", ".join(
        f"({i}, {j}, {w!r}::DOUBLE)" for i, ws in enumerate(taps.taps(n_in, n_out, method)) for j, w in ws.items()
    )
    return f"{name}(o, i, w) AS (VALUES {rows})"


def _resize_sql(method: str, height: int, width: int) -> str:
    return with_tables(f"""
    WITH {_taps_sql('tr', 128, height, method)}, {_taps_sql('tc', 96, width, method)},
    px AS (SELECT song_id, track_idx, bar_index, tr.o AS "row", tc.o AS "col",
                  sum(velocity / 127.0::DOUBLE * tr.w * tc.w) AS level
           FROM cells JOIN tr ON tr.i = pitch JOIN tc ON tc.i = step GROUP BY ALL)
    SELECT song_id, track_idx, bar_index, 0 AS channel, 3 AS copies, count(*) AS n,
           round(sum(level * 2 - 1) + 1e-10, 5) + 0.0 AS value_sum,
           round(sum(level * (("row"*3 + "col" + 1) % 101)) + 1e-10, 5) + 0.0 AS placed
    FROM px GROUP BY ALL""")


def _resized(spark: SparkSession, sf_dir: str, method: str, height: int, width: int) -> DataFrame:
    strips = render.strips(derived.segments(spark, sf_dir), "velocity_only")
    return checksum(render.resize(strips, (128, 96), (height, width), method))


@query("resize_bilinear", _resize_sql("bilinear", 128, 128))
def resize_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resized(spark, sf_dir, "bilinear", 128, 128)


@query("resize_nearest", _resize_sql("nearest", 64, 128))
def resize_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resized(spark, sf_dir, "nearest", 64, 128)


@query("resize_bicubic", _resize_sql("bicubic", 128, 64))
def resize_bicubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resized(spark, sf_dir, "bicubic", 128, 64)


@query("resize_area", _resize_sql("area", 32, 36))
def resize_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resized(spark, sf_dir, "area", 32, 36)


@query(
    "image_rows",
    with_tables("""
    SELECT song_id, track_idx, bar_index, channel, pitch AS "row", 96::INT AS width,
           round(sum(velocity / 127.0::DOUBLE * 2) - 96 + 1e-10, 6) + 0.0 AS value_sum
    FROM cells CROSS JOIN range(3) r(channel) GROUP BY ALL"""),
)
def image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = render.image_rows(render.strips(derived.segments(spark, sf_dir), "velocity_only"))
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return rows.select(
        *BAR, F.col("channel").cast("bigint").alias("channel"), "row",
        F.size("values").alias("width"), stable(total).alias("value_sum"),
    )


@query(
    "pool_codec",
    with_tables(f"""
    WITH {_taps_sql('ur', 16, 128, 'bilinear')}, {_taps_sql('uc', 16, 96, 'bilinear')},
    z AS (SELECT song_id, track_idx, bar_index, pitch // 8 AS r, step // 6 AS c, sum(velocity / 127.0::DOUBLE) / 48 AS level
          FROM cells GROUP BY ALL),
    px AS (SELECT song_id, track_idx, bar_index, ur.o AS "row", uc.o AS "col", sum(level * ur.w * uc.w) AS level
           FROM z JOIN ur ON ur.i = r JOIN uc ON uc.i = c GROUP BY ALL)
    SELECT song_id, track_idx, bar_index, 0 AS channel, 3 AS copies, count(*) AS n,
           round(sum(level * 2 - 1) + 1e-10, 5) + 0.0 AS value_sum,
           round(sum(level * (("row"*3 + "col" + 1) % 101)) + 1e-10, 5) + 0.0 AS placed
    FROM px GROUP BY ALL"""),
)
def pool_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode through the pooling codec."""
    pixels = render.render(derived.cells(spark, sf_dir), "velocity_only")
    return checksum(codec.pool_decode(codec.pool_encode(pixels)))


@query(
    "pool_latents",
    with_tables("""
    WITH z AS (SELECT song_id, track_idx, bar_index, pitch // 8 AS r, step // 6 AS c, sum(velocity / 127.0::DOUBLE) / 48 AS level
               FROM cells GROUP BY ALL)
    SELECT song_id, track_idx, bar_index, 1024::INT AS dims,
           round(3 * (sum(2 * level) - 256) + 1e-10, 6) + 0.0 AS mu_sum, round(102.4::DOUBLE + 1e-10, 6) AS sigma_sum
    FROM z GROUP BY 1, 2, 3"""),
)
def pool_latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = codec.pool_vectors(render.strips(derived.segments(spark, sf_dir)))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return z.select(
        *BAR, F.size("z_mu").alias("dims"), stable(total("z_mu")).alias("mu_sum"), stable(total("z_sigma")).alias("sigma_sum")
    )


@query("noisy_reconstruction")
def noisy_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth plus clamped Gaussian noise on every pixel; the numbers depend on this engine's hash."""
    noisy = codec.noisy_sums(render.velocity_strips(derived.segments(spark, sf_dir)))
    return noisy.groupBy("track_idx").agg(
        F.sum("n").alias("n"), F.round(F.try_divide(F.sum("total"), F.sum("n")), 4).alias("mean"), F.max("top").alias("top")
    )
