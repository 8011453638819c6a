import random

import pytest
from pyspark.sql import functions as F

from staffline.operators import numbering as N


def frame(spark, seed=0):
    rng = random.Random(seed)
    rows = []
    for g, n in (("hot", 400), ("cold", 3), ("single", 1)):
        for o in sorted(rng.sample(range(3000), n)):
            rows.append((g, o, rng.randrange(100)))
    return rows, spark.createDataFrame(rows, "g STRING, o BIGINT, v INT").repartition(5)


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_position_and_next_cross_blocks(spark, parts):
    rows, df = frame(spark)
    groups = {}
    for g, o, v in rows:
        groups.setdefault(g, []).append((o, v))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        want = {(g, o): i for g, s in groups.items() for i, (o, _) in enumerate(s)}
        got = {(r["g"], r["o"]): r["pos"] for r in N.sequence_position(df, ["g"], "o").collect()}
        assert got == want
        for steps in (1, 2, 3):
            want = {(g, o): (s[i + steps][1] if i + steps < len(s) else None) for g, s in groups.items() for i, (o, _) in enumerate(s)}
            got = {(r["g"], r["o"]): r["next_v"] for r in N.sequence_next(df, ["g"], "o", ["v"], steps=steps).collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("ties", [False, True])
def test_one_sequence_with_all_rows_is_cut(spark, ties, monkeypatch):
    """All rows in one sequence, order values with gaps of millions or all equal: no range holds more than a few."""
    monkeypatch.setattr(N, "FAN", 3)
    n = 4000
    order = F.lit(7) if ties else F.col("id") * F.col("id") * 1_000_003
    df = spark.range(n).select(F.lit(None).cast("string").alias("g"), order.alias("o"), "id", (F.col("id") % 97).alias("v")).repartition(6)
    spark.conf.set("spark.sql.shuffle.partitions", 20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in N.sequence_blocks(df, ["g"], ["o"]).groupBy("_block").count().collect()]
        assert len(sizes) >= 15 and max(sizes) < n / 5
        values = {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "x": ("xor", F.col("v")), "m": ("max", F.col("v"))}
        rows = sorted(N.running(df, ["g"], ["o"], values, ties=["id"]).collect(), key=lambda r: r["id"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total = x = top = 0
    for i, r in enumerate(rows):
        total, x, top = total + r["v"], x ^ r["v"], max(top, r["v"])
        assert (r["n"], r["s"], r["x"], r["m"]) == (i + 1, total, x, top)


@pytest.mark.parametrize("edge", [0, 3, 10_000])
def test_selection_takes_as_many_rounds_as_it_needs(spark, edge, monkeypatch):
    import hashlib

    monkeypatch.setattr(N, "EDGE_ROWS", edge)
    df = spark.range(900).withColumn("g", F.when(F.col("id") % 3 > 0, "hot"))
    got = {(r["g"], r["id"]) for r in N.exact_sample(df, 70, ["id"], by=["g"], seed=9).collect()}
    want = set()
    for g in ("hot", None):
        ids = [i for i in range(900) if (i % 3 > 0) == (g == "hot")]
        want |= {(g, i) for i in sorted(ids, key=lambda i: hashlib.md5(f"9:{i}".encode()).hexdigest())[:70]}
    assert got == want
    same = spark.range(500).select(F.lit(1).alias("k"), "id")  # equal keys: any rows, but as many as asked for
    assert N.exact_sample(same, 123, ["k"], seed=9).select("id").distinct().count() == 123


def test_samples_are_exact_and_partition_free(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 900, "hot").otherwise("cold"))
    a = {r["id"] for r in N.exact_sample(df, 150, ["id"], by=["g"], seed=3).collect()}
    b = {r["id"] for r in N.exact_sample(df.repartition(11), 150, ["id"], by=["g"], seed=3).collect()}
    assert a == b and len(a) == 250 and len([i for i in a if i < 900]) == 150
    c = {r["id"] for r in N.exact_sample(df, 150, ["id"], by=["g"], seed=4).collect()}
    assert a != c
    assert N.exact_fraction(df, 0.0005, ["id"]).count() == 1
    assert N.exact_fraction(df, 0.333, ["id"]).count() == 333
    assert N.exact_fraction(df, 1.0, ["id"]).count() == 1000
    with pytest.raises(ValueError):
        N.exact_fraction(df, 0.0, ["id"])


def test_split(spark):
    s = N.split_fraction(spark.range(95), 0.1, ["id"])
    assert {r["split"]: r["count"] for r in s.groupBy("split").count().collect()} == {"val": 9, "train": 86}


def test_ordered_limit_takes_one_path_for_any_number(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    got = sorted(r["k"] for r in N.ordered_limit(df, ["k"], 1234).collect())
    assert got == list(range(1234))
    chunks = N.with_chunk(df, ["k"], 100, limit=250).groupBy("chunk").count().orderBy("chunk").collect()
    assert [(r["chunk"], r["count"]) for r in chunks] == [(0, 100), (1, 100), (2, 50)]
