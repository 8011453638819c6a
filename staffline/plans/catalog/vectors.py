"""Vector queries over the embedding table: latents of 4 channels of 4 x 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.functions import vectors as V
from staffline.keys import BAR
from staffline.operators import codec
from staffline.operators import vectors as M
from staffline.operators.numbering import split_fraction
from staffline.plans import derived
from staffline.plans.catalog import query, rounded, stable
from staffline.plans.derived import with_tables

CHANNELS, AREA = 4, 16


def latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derived.table(spark, sf_dir, "embeddings")
    song = F.floor(F.col("vec_id") / 16)
    return e.select("vec_id", "label", song.alias("song_id"), (F.col("vec_id") % 16).alias("bar_index"), F.col("embedding").alias("z"))


_LAT = """lat AS (SELECT vec_id, label, vec_id // 16 AS song_id, vec_id % 16 AS bar_index,
                  list_transform(embedding, lambda x: x::DOUBLE) AS z FROM embeddings)"""


@query(
    "latent_variance",
    f"""WITH {_LAT}, ch AS (SELECT vec_id, c, unnest(z[c*16+1 : c*16+16]) AS v FROM lat, range(4) r(c)),
    s AS (SELECT vec_id, c, var_samp(v) AS x FROM ch GROUP BY ALL)
    SELECT vec_id, round(avg(x) + 1e-10, 6) AS latent_variance_mean, round(min(x) + 1e-10, 6) AS latent_variance_min,
           round(max(x) + 1e-10, 6) AS latent_variance_max FROM s GROUP BY 1""",
)
def latent_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.channel_variance(latents(spark, sf_dir), ["vec_id"], CHANNELS, AREA))


@query(
    "latent_channel_correlation",
    f"""WITH {_LAT}, ch AS (SELECT vec_id, c, i, z[c*16+i] AS v FROM lat, range(4) r(c), range(1, 17) p(i)),
    s AS (SELECT a.vec_id, abs(corr(a.v, b.v)) AS x FROM ch a JOIN ch b ON a.vec_id = b.vec_id AND a.i = b.i AND a.c < b.c GROUP BY a.vec_id, a.c, b.c)
    SELECT vec_id, round(avg(x) + 1e-10, 6) AS latent_channel_correlation_mean, round(max(x) + 1e-10, 6) AS latent_channel_correlation_max FROM s GROUP BY 1""",
)
def latent_channel_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.channel_correlation(latents(spark, sf_dir), ["vec_id"], CHANNELS, AREA))


@query(
    "latent_channel_means",
    f"""WITH {_LAT}, ch AS (SELECT c, unnest(z[c*16+1 : c*16+16]) AS v FROM lat, range(4) r(c))
    SELECT CAST(c AS INT) AS channel, round(avg(v) + 1e-10, 6) + 0.0 AS mu_mean, round(avg(abs(v) * 0.1::DOUBLE) + 1e-10, 6) AS sigma_mean FROM ch GROUP BY 1""",
)
def latent_channel_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat = latents(spark, sf_dir).withColumn("z_sigma", F.transform("z", lambda v: F.abs(v.cast("double")) * 0.1))
    return rounded(M.channel_means(lat, CHANNELS, AREA, "z", "z_sigma"))


@query(
    "self_similarity",
    f"""WITH {_LAT}, p AS (SELECT a.song_id, list_cosine_similarity(a.z, b.z) AS s FROM lat a JOIN lat b ON a.song_id = b.song_id AND a.vec_id < b.vec_id),
    n AS (SELECT song_id, count(*) AS n FROM lat GROUP BY 1)
    SELECT song_id, round(avg(s) + 1e-10, 6) + 0.0 AS self_similarity_mean, round(stddev_pop(s) + 1e-10, 6) + 0.0 AS self_similarity_std,
           n AS self_similarity_n_bars FROM p JOIN n USING (song_id) GROUP BY song_id, n""",
)
def self_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat = latents(spark, sf_dir)
    return rounded(M.self_similarity(lat, ["song_id"]))


@query(
    "interpolation_smoothness",
    f"""WITH {_LAT}, l AS (SELECT song_id, z, lead(z) OVER w AS z1, lead(z, 2) OVER w AS z2 FROM lat WINDOW w AS (PARTITION BY song_id ORDER BY bar_index)),
    d AS (SELECT song_id, list_distance(z, z1) AS s1,
                 sqrt(list_sum(list_transform(range(1, 65), lambda i: (z2[i] - 2*z1[i] + z[i]) * (z2[i] - 2*z1[i] + z[i])))) AS s2 FROM l)
    SELECT song_id, round(avg(s2) + 1e-10, 6) AS interpolation_smoothness, round(avg(s1) + 1e-10, 6) AS interpolation_step_size,
           count(*) AS interpolation_n_steps FROM d GROUP BY 1""",
)
def interpolation_smoothness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.smoothness(latents(spark, sf_dir), ["song_id"], "bar_index"))


_DISTANCES = f"""{_LAT},
    d AS (SELECT a.vec_id, a.label AS own, b.label AS other, list_distance(a.z, b.z) AS d FROM lat a JOIN lat b ON a.vec_id <> b.vec_id),
    m AS (SELECT vec_id, own, other, sum(d) AS t, count(*) AS n FROM d GROUP BY ALL)"""


@query(
    "silhouette",
    f"""WITH {_DISTANCES},
    ab AS (SELECT vec_id, max(CASE WHEN own = other THEN t / n END) AS a, min(CASE WHEN own <> other THEN t / n END) AS b FROM m GROUP BY 1)
    SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) + 1e-10, 6) + 0.0 AS silhouette_score FROM ab""",
)
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.silhouette(latents(spark, sf_dir), ["vec_id"], "label"))


@query(
    "silhouette_squared",
    f"""WITH {_LAT}, s AS (SELECT * FROM lat),
    d AS (SELECT a.vec_id, a.label AS own, b.label AS other, list_distance(a.z, b.z) * list_distance(a.z, b.z) AS d, a.vec_id = b.vec_id AS self FROM s a, s b),
    m AS (SELECT vec_id, own, other, sum(CASE WHEN self THEN 0 ELSE d END) AS t, count(*) AS n FROM d GROUP BY ALL),
    ab AS (SELECT vec_id, max(CASE WHEN own = other AND n > 1 THEN t / (n - 1) END) AS a,
                  min(CASE WHEN own <> other THEN t / n END) AS b FROM m GROUP BY 1)
    SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) + 1e-10, 6) + 0.0 AS silhouette_score FROM ab""",
)
def silhouette_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.silhouette_squared(latents(spark, sf_dir), ["vec_id"], "label"))


@query(
    "pca_fit",
)
def pca_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explained variance per component, with the loss of the 8-component code on held-out rows."""
    lat = split_fraction(latents(spark, sf_dir), 0.1, ["vec_id"])
    model = M.fit_pca(lat.filter("split = 'train'"), 8)
    loss = M.reconstruction_loss(lat.filter("split = 'val'"), model)
    ratio = F.array(*[F.lit(r) for r in model.explained])
    return loss.select(F.posexplode(ratio).alias("component", "explained"), "mse", "n").transform(rounded)


@query("pca_scatter")
def pca_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two coordinates per vector with its label."""
    lat = latents(spark, sf_dir)
    model = M.fit_pca(lat, 2)
    code = model.encode(M.doubles("z"))
    return lat.select("vec_id", "label", code.alias("s")).select(
        "vec_id", "label", stable(F.col("s")[0], 5).alias("x"), stable(F.col("s")[1], 5).alias("y")
    )


@query("linear_probe")
def linear_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out accuracy of label probes: class, and song parity as the attribute."""
    lat = latents(spark, sf_dir).withColumn("attribute", F.coalesce(F.nullif(F.col("label") % 3, F.lit(2)), F.lit(-1)))
    scores = {
        "linear_probe_instrument_accuracy": M.probe_accuracy(lat, ["vec_id"], "label"),
        "conditioning_attribute_accuracy": M.probe_accuracy(lat, ["vec_id"], "attribute"),
    }
    return lat.agg(F.count(F.lit(1)).alias("n"), *[F.lit(v).alias(k) for k, v in scores.items()]).transform(rounded)


@query(
    "dominant_pitch_label",
    with_tables("""
    WITH n AS (SELECT song_id, track_idx, bar_index, pitch, count(*) AS n FROM cells GROUP BY ALL)
    SELECT song_id, track_idx, bar_index, CAST(arg_max(pitch, n * 128 + 127 - pitch) % 12 AS INT) AS label FROM n GROUP BY 1, 2, 3"""),
)
def dominant_pitch_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.dominant_pitch_label(derived.segments(spark, sf_dir), BAR)


@query(
    "disentanglement",
    f"""WITH {_DISTANCES},
    s AS (SELECT sum(CASE WHEN own = other THEN t END) / sum(CASE WHEN own = other THEN n END) AS intra,
                 sum(CASE WHEN own <> other THEN t END) / sum(CASE WHEN own <> other THEN n END) AS inter FROM m)
    SELECT round((inter - intra) / inter + 1e-10, 6) + 0.0 AS disentanglement_score, round(intra + 1e-10, 6) AS intra_class_distance,
           round(inter + 1e-10, 6) AS inter_class_distance FROM s""",
)
def disentanglement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.disentanglement(latents(spark, sf_dir), ["vec_id"], "label"))


@query("reparameterised_sample")
def reparameterised_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z = mu + eps * sigma with hashed Gaussian eps; per class the mean and spread of eps."""
    lat = latents(spark, sf_dir).select(
        "vec_id", "label", M.doubles("z").alias("z_mu"), F.array_repeat(F.lit(0.1), 64).alias("z_sigma")
    )
    drawn = codec.sample_latents(lat, ["vec_id"]).withColumn("z_in", codec.decode_input(codec.sample_latents(lat, ["vec_id"])))
    eps = F.explode(F.zip_with("z_in", "z_mu", lambda a, b: (a - b) / 0.1))
    return drawn.select("label", eps.alias("e")).groupBy("label").agg(
        F.round(F.avg("e"), 3).alias("eps_mean"), F.round(F.stddev_pop("e"), 3).alias("eps_std")
    )


@query(
    "vector_functions",
    f"""WITH {_LAT}, p AS (SELECT a.vec_id, a.z AS x, coalesce(b.z, a.z) AS y FROM lat a LEFT JOIN lat b ON b.vec_id = a.vec_id + 1),
    h AS (SELECT vec_id, x, y, list_transform(x, lambda v: abs(v)) AS ax, list_transform(y, lambda v: abs(v)) AS ay FROM p),
    n AS (SELECT vec_id, x, y, list_transform(ax, lambda v: v / list_sum(ax)) AS px, list_transform(ay, lambda v: v / list_sum(ay)) AS py FROM h)
    SELECT vec_id, round(list_inner_product(x, y) + 1e-10, 6) + 0.0 AS dot, round(sqrt(list_inner_product(x, x)) + 1e-10, 6) AS norm,
           round(list_cosine_similarity(x, y) + 1e-10, 6) + 0.0 AS cosine, round(list_distance(x, y) + 1e-10, 6) AS distance,
           round(-list_sum(list_transform(px, lambda v: v * ln(greatest(v, 1e-12)))) + 1e-10, 6) AS entropy,
           round(list_sum(list_transform(range(1, 65), lambda i: greatest(px[i], 1e-10) * ln(greatest(px[i], 1e-10) / greatest(py[i], 1e-10)))) + 1e-10, 6) + 0.0 AS kl
    FROM n""",
)
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against its successor."""
    lat = latents(spark, sf_dir).select("vec_id", M.doubles("z").alias("x"))
    nxt = lat.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    pair = lat.join(nxt, "vec_id", "left").withColumn("y", F.coalesce("y", "x"))
    x, y = F.col("x"), F.col("y")
    share = lambda c: V.normalise(F.transform(c, lambda v: F.abs(v)))
    pair = pair.withColumns({"px": share(x), "py": share(y)})
    return pair.select(
        "vec_id", V.dot(x, y).alias("dot"), V.norm(x).alias("norm"), V.cosine(x, y).alias("cosine"),
        V.distance(x, y).alias("distance"), V.entropy(F.col("px")).alias("entropy"),
        V.kl_divergence(F.col("px"), F.col("py")).alias("kl"),
    ).transform(lambda d: rounded(d, ["vec_id"]))
