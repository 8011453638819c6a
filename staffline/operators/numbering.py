"""Row numbers, successors, limits and samples that survive hot groups.

A plain ``row_number`` over a group puts the whole group into one task. Here the
group is cut into ranges of about equal numbers of rows along its order, rows are numbered
inside a range and the carries come from a small aggregate, so a group that holds
most of all rows is still spread over many tasks.
"""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hexadecimal digits of the seeded hash that one round of a selection looks at.
ROUND_DIGITS = 3
#: A boundary bucket of at most so many rows per group is ranked at once; a larger one takes another round.
EDGE_ROWS = 10_000
#: Blocks whose carries one window adds up; their sums go one level up.
FAN = 512

COMBINE = {"sum": F.sum, "count": F.count, "xor": F.bit_xor, "max": F.max}


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join on ``keys`` where null equals null; the columns of ``right`` other than its keys are added."""
    there = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(F.broadcast(there) if small else there, on, how).drop(*[f"_r_{k}" for k in keys])


def _offsets(df: DataFrame, by: Sequence[str], block: str) -> DataFrame:
    """(by, block, _n, _before): rows per block and rows in earlier blocks."""
    counts = df.groupBy(*by, block).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(block)
    return counts.withColumn(
        "_before", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    )


# -- scans along sequences -------------------------------------------------------------------------

def sequence_blocks(df: DataFrame, by: Sequence[str], order: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """Rows dealt by ranges of (by, order, ties), each with ``_block``, the number of its range, and ``_uid``.

    Ranges hold about equal numbers of rows whatever the values: a sequence with gaps, with ties or with most of all
    rows is cut into many. Equal rows are told apart by ``_uid``, so they are cut as well. The result is written
    down once, since bounds come from a sample.
    """
    rows = df.withColumn("_uid", F.monotonically_increasing_id())
    return durable(rows.repartitionByRange(*by, *order, *ties, "_uid").withColumn("_block", F.spark_partition_id()))


def _carries(totals: DataFrame, by: Sequence[str], how: dict[str, str]) -> DataFrame:
    """(by, _block, _in_*): what the earlier blocks of a sequence amount to, for blocks that have earlier ones.

    Blocks are combined in groups of ``FAN``, the groups' totals by one more window. Only the first
    sequence of a block can have begun before it, so there is at most a row per block.
    """
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    near = earlier(Window.partitionBy(*by, "_group").orderBy("_block"))
    far = earlier(Window.partitionBy(*by).orderBy("_group"))
    rows = totals.withColumn("_group", F.floor(F.col("_block") / FAN))
    merge = lambda h: F.sum if h == "count" else COMBINE[h]
    groups = rows.groupBy(*by, "_group").agg(*[merge(h)(f"_t_{n}").alias(f"_t_{n}") for n, h in how.items()], F.count(F.lit(1)).alias("_b"))
    groups = groups.select(*by, "_group", F.sum("_b").over(far).alias("_far"), *[merge(h)(f"_t_{n}").over(far).alias(f"_far_{n}") for n, h in how.items()])
    inside = rows.select(*by, "_block", "_group", F.count(F.lit(1)).over(near).alias("_near"), *[merge(h)(f"_t_{n}").over(near).alias(f"_near_{n}") for n, h in how.items()])
    both = _match(inside, groups, [*by, "_group"])
    parts = [join_values(h, F.col(f"_near_{n}"), F.col(f"_far_{n}")).alias(f"_in_{n}") for n, h in how.items()]
    return both.where("_near > 0 OR _far > 0").select(*by, "_block", *parts)


def join_values(how: str, a: Column, b: Column) -> Column:
    """Two partial results as one; null is the absent one."""
    if how == "max":
        return F.greatest(a, b)
    whole = a.bitwiseXOR(b) if how == "xor" else a + b
    return F.coalesce(whole, a, b)


def running(
    df: DataFrame, by: Sequence[str], order: Sequence[str], values: Mapping[str, tuple[str, Column]], ties: Sequence[str] = ()
) -> DataFrame:
    """Add ``name``: the sum, count, xor or max of a column over the rows of the sequence up to this one.

    ``values[name] = (how, column)``. A distributed prefix scan: windows inside range blocks, then the carries of earlier
    blocks, one row per block at most, which is why they can be broadcast.
    """
    rows = sequence_blocks(df, by, order, ties)
    inside = Window.partitionBy("_block", *by).orderBy(*order, *ties, "_uid").rowsBetween(Window.unboundedPreceding, 0)
    how = {name: h for name, (h, _) in values.items()}
    totals = rows.groupBy("_block", *by).agg(*[COMBINE[h](c).alias(f"_t_{n}") for n, (h, c) in values.items()])
    out = rows.select("*", *[COMBINE[h](c).over(inside).alias(f"_w_{n}") for n, (h, c) in values.items()])
    out = _match(out, _carries(totals, by, how), ["_block", *by], "left", small=True)
    whole = [join_values(h, F.col(f"_w_{n}"), F.col(f"_in_{n}")).alias(n) for n, h in how.items()]
    return out.select(*[c for c in df.columns if c not in how], *whole)


def sequence_position(
    df: DataFrame, by: Sequence[str], order: str | Sequence[str], ties: Sequence[str] = (), name: str = "pos"
) -> DataFrame:
    """Zero-based position of each row in its sequence; ``by`` may be empty."""
    order = [order] if isinstance(order, str) else list(order)
    return running(df, by, order, {name: ("count", F.lit(1))}, ties).withColumn(name, F.col(name) - 1)


def sequence_next(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    values: Sequence[str],
    steps: int = 1,
    ties: Sequence[str] = (),
    prefix: str = "next_",
) -> DataFrame:
    """Add the values ``steps`` rows later in the sequence (NULL past the end).

    ``lead`` runs inside each range block. Rows at the end of a block look into the first rows of the following blocks;
    only the last sequence of a block goes on after it, so those heads are at most a row per block.
    """
    return sequence_ahead(df, by, order, values, {prefix: steps}, ties)


def sequence_ahead(
    df: DataFrame, by: Sequence[str], order: str, values: Sequence[str], steps: Mapping[str, int], ties: Sequence[str] = ()
) -> DataFrame:
    """As :func:`sequence_next` for several distances at once, ``steps`` by prefix: rows are dealt and written down once."""
    cut, reach = sequence_blocks(df, by, [order], ties), max(steps.values())
    block = Window.partitionBy("_block", *by)
    inside = block.orderBy(order, *ties, "_uid")
    payload = F.struct(*[F.col(v).alias(v) for v in values])
    cut = cut.select(
        "*", *[F.lead(payload, k).over(inside).alias(f"_lead{k}") for k in sorted(set(steps.values()))], F.row_number().over(inside).alias("_rn"),
        F.count(F.lit(1)).over(block).alias("_n"),
    ).withColumn("_left", F.col("_n") - F.col("_rn"))
    first = F.collect_list(F.struct(F.col("_rn"), payload.alias("v")))
    heads = cut.where(F.col("_rn") <= reach).groupBy("_block", *by).agg(
        F.transform(F.sort_array(first), lambda s: s["v"]).alias("_heads")
    )
    after = Window.partitionBy(*by).orderBy("_block").rowsBetween(1, reach)
    following = heads.select("_block", *by, F.flatten(F.collect_list("_heads").over(after)).alias("_following"))
    out = _match(cut, following.where(F.size("_following") > 0), ["_block", *by], "left", small=True)
    ahead = lambda k: F.when(F.col("_left") >= k, F.col(f"_lead{k}")).otherwise(F.get("_following", (F.lit(k - 1) - F.col("_left")).cast("int")))
    return out.select(*df.columns, *[ahead(k)[v].alias(f"{prefix}{v}") for prefix, k in steps.items() for v in values])


# -- samples ---------------------------------------------------------------------------------------

def sample_key(seed: int, *columns: str | Column) -> Column:
    """Seeded order key that depends on the row's key only, not on its partition."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[
        (F.col(c) if isinstance(c, str) else c).cast("string") for c in columns
    ]))


def _cut_by_rank(df: DataFrame, by: Sequence[str], keys: Sequence[str], quota, seed: int) -> DataFrame:
    """Keep the ``quota(group size)`` rows of each group with the smallest seeded hash.

    Selection by radix: a round counts rows by the next digits of the hash. Buckets below the quota are kept whole, those beyond
    it go, and the one that the quota cuts takes the next round, until it is small enough to be ranked. Each round leaves
    about 1/4096 of the rows, so the number of rounds follows the size of the table. Rows whose whole hashes
    are equal are placed by a scan.
    """
    rows = df.withColumn("_h", sample_key(seed, *keys))
    kept, left = [], F.sum("_n").over(Window.partitionBy(*by))
    for first in range(1, 32, ROUND_DIGITS):
        rows = rows.withColumn("_bucket", F.substring("_h", first, ROUND_DIGITS))
        extra = [F.max("_k").alias("_k")] if first > 1 else []
        counts = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"), *extra)
        w = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select(
            *by, "_bucket", "_n", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"),
            (F.col("_k") if first > 1 else quota(left)).alias("_quota"),
        ).where("_before < _quota")
        counts = durable(counts.select(*by, "_bucket", "_n", (F.col("_quota") - F.col("_before")).alias("_k")))
        placed = _match(rows.drop("_k"), counts, [*by, "_bucket"])
        kept.append(placed.where("_n <= _k").select(*df.columns))
        edge = placed.where("_n > _k").drop("_n", "_bucket")
        if (counts.where("_n > _k").agg(F.max("_n")).first()[0] or 0) <= EDGE_ROWS:
            w = Window.partitionBy(*by).orderBy("_h", *keys)
            kept.append(edge.withColumn("_rn", F.row_number().over(w)).where("_rn <= _k").select(*df.columns))
            break
        rows = durable(edge)
    else:
        placed = sequence_position(rows, by, ["_h", *keys], name="_pos")
        kept.append(placed.where("_pos < _k").select(*df.columns))
    return reduce(DataFrame.unionAll, kept)


def exact_sample(
    df: DataFrame, k: int, keys: Sequence[str], by: Sequence[str] = (), seed: int = 42
) -> DataFrame:
    """Exactly ``min(k, n)`` rows, global or per group, chosen by a seeded hash of ``keys``.

    Same seed, same rows, whatever the partitioning. The choice differs from that
    of a Mersenne-twister sampler with the same seed.
    """
    return _cut_by_rank(df, by, keys, lambda n: F.least(n, F.lit(k)), seed)


def exact_fraction(
    df: DataFrame, fraction: float, keys: Sequence[str], by: Sequence[str] = (), seed: int = 42
) -> DataFrame:
    """``max(1, int(n * fraction))`` rows, global or per group."""
    if not 0.0 < fraction <= 1.0:
        raise ValueError("fraction must be in (0, 1]")
    quota = lambda n: F.greatest(F.lit(1), F.floor(n * F.lit(fraction)))
    return _cut_by_rank(df, by, keys, quota, seed)


def split_fraction(
    df: DataFrame, fraction: float, keys: Sequence[str], seed: int = 42, name: str = "split"
) -> DataFrame:
    """Label rows 'train' or 'val'; ``max(1, int(fraction * n))`` rows are 'val'."""
    val = exact_fraction(df, fraction, keys, seed=seed).select(*keys, F.lit("val").alias(name))
    return df.join(val, list(keys), "left").withColumn(name, F.coalesce(name, F.lit("train")))


def first_k(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], k: int) -> DataFrame:
    """First ``k`` rows of each group; small ``k`` is cut before the shuffle by the optimizer."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def _ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows labelled with the range they fall into; the labels are written down once.

    Range bounds come from a sample, so the labels must not be computed twice.
    """
    return durable(df.repartitionByRange(*order).withColumn("_block", F.spark_partition_id()))


def ordered_limit(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows by ``order`` (a total order).

    Keys are sorted by range, rows are counted per range and ranked only inside ranges, so
    no task sees ``n`` rows, whatever ``n``.
    """
    return global_position(df, order, "_pos").filter(F.col("_pos") < n).drop("_pos")


def global_position(df: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """Zero-based position of each row in the whole table."""
    ranged = _ranged(df, order)
    w = Window.partitionBy("_block").orderBy(*order)
    return (
        ranged.join(F.broadcast(_offsets(ranged, [], "_block")), "_block")  # a row per range
        .withColumn(name, F.col("_before") + F.row_number().over(w) - 1)
        .drop("_block", "_n", "_before")
    )


def with_chunk(df: DataFrame, order: Sequence[str], size: int, limit: int | None = None) -> DataFrame:
    """Chunk number of each row: ``size`` consecutive rows per chunk, optionally capped."""
    placed = global_position(df, order, "_pos")
    if limit is not None:
        placed = placed.filter(F.col("_pos") < limit)
    return placed.withColumn("chunk", F.floor(F.col("_pos") / size)).drop("_pos")


def shared_folder(spark) -> str:
    """The folder that executors share: ``spark.checkpoint.dir``; only a local session may make up one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the folder that executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
