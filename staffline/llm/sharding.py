"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table. Shards take turns, each
claiming the first free slot of its order, until the table is full. A key's hash modulo the table's
size gives its slot, so placement is one lookup in a broadcast table whose size does not depend on the data. A
shard added or removed moves little more than its own share of the keys.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.llm.common import fresh

#: A prime well above a hundred times the usual number of shards.
TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[int] | None = None) -> np.ndarray:
    """Index of the shard that owns each slot.

    A shard of weight w claims w slots at each of its turns. Shards take turns in the order of their names, so the
    table depends only on the set of names and weights.
    """
    weights = list(weights or [1] * len(shards))
    if not shards or len(set(shards)) != len(shards) or len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("shards must be distinct names with weights of at least one")
    if not _is_prime(size) or size <= len(shards):
        raise ValueError("the table's size must be a prime above the number of shards")
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    offset = [xxhash.xxh64_intdigest(s, 1) % size for s in shards]
    skip = [xxhash.xxh64_intdigest(s, 2) % (size - 1) + 1 for s in shards]
    owner, at, taken = [-1] * size, [0] * len(shards), 0
    while taken < size:
        for i in turns:
            for _ in range(weights[i]):
                if taken == size:
                    break
                while owner[slot := (offset[i] + at[i] * skip[i]) % size] >= 0:
                    at[i] += 1
                owner[slot] = i
                taken += 1
    return np.array(owner, dtype=np.int32)


def table_frame(spark: SparkSession, shards: Sequence[str], owner: np.ndarray) -> DataFrame:
    """(slot, shard): one row per slot, at most ``TABLE_SIZE`` or the size given."""
    return spark.createDataFrame(
        [(i, shards[k]) for i, k in enumerate(owner.tolist())], "slot int, shard string"
    )


def slot_of(keys: Sequence[Column], size: int, spare: Sequence[Column] = ()) -> Column:
    """Slot of a key; where all keys are null, the spare columns decide, so that null is no hot key."""
    known = F.coalesce(*[F.when(k.isNotNull(), F.lit(True)) for k in keys], F.lit(False))
    value = F.when(known, F.xxhash64(*keys)).otherwise(F.xxhash64(*(spare or keys)))
    return F.pmod(value, F.lit(size)).cast("int")


def place(
    df: DataFrame, keys: Sequence[str], shards: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[int] | None = None,
    spare: Sequence[str] = (), names: tuple[str, str] = ("slot", "shard"),
) -> DataFrame:
    """``df`` with the slot and the shard of each row, without a shuffle.

    Rows with equal keys share a shard, repeated rows too. Rows whose keys are all null are spread by ``spare``. Columns
    that are already called ``slot`` or ``shard`` stay and the new ones get a trailing underscore. An empty
    table gives an empty one.
    """
    slot, shard = fresh(df, *names)
    lookup = table_frame(df.sparkSession, shards, fill_table(shards, size, weights))
    lookup = lookup.select(F.col("slot").alias(slot), F.col("shard").alias(shard))
    placed = df.withColumn(slot, slot_of([F.col(k) for k in keys], size, [F.col(c) for c in spare]))
    return placed.join(F.broadcast(lookup), slot).select(*df.columns, slot, shard)


def write_shards(placed: DataFrame, folder: str, shard: str = "shard", salts: int = 1) -> None:
    """One folder per shard. ``salts`` tasks write each shard, so a large shard is no single task."""
    rows = placed.repartition(shard, F.pmod(F.xxhash64(*placed.columns), F.lit(salts))) if salts > 1 else placed.repartition(shard)
    rows.write.partitionBy(shard).parquet(folder)


def moved(old: np.ndarray, new: np.ndarray, old_names: Sequence[str], new_names: Sequence[str]) -> float:
    """Share of slots whose owner changes between two tables of one size."""
    return float(np.mean(np.array(old_names, dtype=object)[old] != np.array(new_names, dtype=object)[new]))
