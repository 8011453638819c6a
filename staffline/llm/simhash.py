"""SimHash near-duplicates: tiled exact comparison by exclusive-or and bit counts.

Fingerprints are made in one pass over the texts. Distinct fingerprints are dealt to tiles, and pairs of tiles
are compared in full with numpy, except where their population counts differ by more than the radius, as
then no pair can be near. So that the number of tile pairs does not grow with the square of the corpus, the grid
is laid over agreeing bits: the fingerprint is cut into ``radius + share`` blocks, two fingerprints within
the radius agree on at least ``share`` whole blocks, and only tiles that agree on some such choice of blocks
can hold a near pair. Nothing is lost, and ``share`` follows from the number of fingerprints. A cell of the grid
with more fingerprints than a tile holds is cut by population count and by hash into several tiles.

A pair of tiles returns a spanning forest of its links, not the links, and components are found by
star contraction over those forests, so a group of thousands of near copies costs no square of rows.

``drop_near_duplicates`` decides by shared shingles. There the cells of the grid are bands of least hashes of a text's set of shingles, as
agreement on bits would leave too many pairs at the wide radius that a similarity of 0.8 asks for. Tiles of a cell are compared by
fingerprints as above; what they tie together inside one cell is a candidate group, and inside each group sets are compared
exactly, block by block. Components are taken of exact links only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffline.llm.common import BYTES_LOWER, durable, fresh, groups, id_field

BITS = 64
SEED = 42
#: Fingerprints in a tile.
TILE = 1024
HASHES_AT_ONCE = 1 << 15
#: Bands of least hashes and the hashes in each: two sets of similarity 0.8 share a band in 99.8 of 100 cases.
BANDS, BAND_ROWS = 16, 5
#: About how many shingles and sets a block holds that is compared exactly.
BLOCK_SHINGLES, BLOCK_SETS = 1 << 18, 512
#: Parts in which the edges of one node are dealt.
SALT = 16
#: Columns of a dense matrix of sets by shingles.
COLUMNS = 2048


# -- fingerprints ----------------------------------------------------------------------------------

def _mix(h: np.ndarray) -> np.ndarray:
    """A second hash of each shingle, from its first."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, lowest bit first."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def shingle_hashes(text: str, shingle: int) -> list[np.ndarray]:
    """Hashes of all shingles of a text, in arrays of bounded length; none without words."""
    words = text.encode().translate(BYTES_LOWER).split()
    if not words:
        return []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    n = len(words) - k + 1
    starts, ends = starts[:n].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return [
        np.array([digest(line[a:b], SEED) for a, b in zip(starts[i : i + HASHES_AT_ONCE], ends[i : i + HASHES_AT_ONCE])], dtype=np.uint64)
        for i in range(0, n, HASHES_AT_ONCE)
    ]


def _both_words(parts: list[np.ndarray], check: bool) -> tuple[int, int]:
    first, second = np.zeros(BITS, np.int64), np.zeros(BITS, np.int64)
    for h in (part[i : i + HASHES_AT_ONCE] for part in parts for i in range(0, len(part), HASHES_AT_ONCE)):
        first += _ones(h)
        if check:
            second += _ones(_mix(h))
    n = sum(map(len, parts))
    return _majority(first, n), _majority(second, n) if check else 0


def fingerprint(text: str, shingle: int, check: bool = False) -> tuple[int, int]:
    """(fingerprint, check word) of a text, zero without words; the check word is zero unless asked for."""
    return _both_words(shingle_hashes(text, shingle), check)


def shingle_set(parts: list[np.ndarray]) -> np.ndarray:
    """Distinct hashes in ascending order."""
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 4, check: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, check_word, n_words) of every row; words and shingles as in ``near_duplicates``."""
    schema = T.StructType([
        id_field(docs, id_col), T.StructField("fp", T.LongType()), T.StructField("check_word", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in groups(batch, text_col):
                both = np.array([fingerprint(t, shingle, check) for t in texts], dtype=np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(both[:, 0]), pa.array(both[:, 1])], names=schema.names
                )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


_ORDERS = np.random.default_rng(SEED).integers(1 << 63, size=(2, BANDS * BAND_ROWS), dtype=np.uint64) | np.uint64(1)


def bands(members: np.ndarray) -> np.ndarray:
    """A key for each band of least hashes of a set; of the empty set all are zero."""
    if not len(members):
        return np.zeros(BANDS, np.uint64)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(members), 4096):
        h = members[start : start + 4096, None] * _ORDERS[0] + _ORDERS[1]
        least = np.minimum(least, (h ^ (h >> np.uint64(32))).min(axis=0))
    return np.bitwise_xor.reduce(_mix(least.reshape(BANDS, BAND_ROWS) + np.arange(BAND_ROWS, dtype=np.uint64)), axis=1)


def named_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, key, fp, check_word, node, bands) of ``docs`` (id, key, text): ``node`` is a hash of the set of shingles, all others follow from the set."""
    numbers = [T.StructField(c, T.LongType()) for c in ("fp", "check_word", "node")]
    schema = T.StructType([*docs.schema.fields[:2], *numbers, T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in groups(batch, "text"):
                made, keys = [], []
                for text in texts:
                    members = shingle_set(shingle_hashes(text, shingle))
                    made.append((*_both_words([members], True), xxhash.xxh64_intdigest(members.tobytes(), SEED)))
                    keys.append(bands(members))
                made = np.array(made, dtype=np.uint64).reshape(-1, 3).view(np.int64)
                own = [batch.column(i).slice(first, len(texts)) for i in (0, 1)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(keys).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(made[:, i]) for i in range(3)], lists], names=schema.names)

    return docs.mapInArrow(run, schema)


# -- the grid --------------------------------------------------------------------------------------

def plan_share(n: int, radius: int, tile: int = TILE) -> int:
    """Blocks that must agree: the fewest for which a cell of the grid holds about half a tile of ``n`` fingerprints."""
    share = 1
    while share < 6:
        bits = share * BITS / (radius + share)
        if log2(max(n, 2)) - bits <= log2(tile / 2) or comb(radius + share + 1, share + 1) > 400:
            break
        share += 1
    return share


def block_masks(radius: int, share: int) -> list[int]:
    """A mask for every choice of ``share`` out of ``radius + share`` blocks."""
    count = radius + share
    cuts = [BITS * i // count for i in range(count + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, share)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def forest(
    left: np.ndarray, right: np.ndarray | None, radius: int, check_radius: int | None, earlier: Sequence[int] = (),
) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest, as index pairs, of the links between two tiles or within one (``right`` is None).

    Tiles are arrays (n, 2) of fingerprints and check words. Indices count through ``left`` and then ``right``. Pairs that
    agree on one of the ``earlier`` masks are left to the tiles of that mask, where they meet as well.
    """
    n, other = len(left), left if right is None else right
    shift = 0 if right is None else n
    pairs_a, pairs_b = [], []
    step = max(1, (1 << 20) // max(1, len(other)))
    for i in range(0, n, step):
        rows = left[i : i + step]
        away = np.bitwise_count(rows[:, None, 0] ^ other[None, :, 0])
        a, b = np.nonzero(away <= radius)
        a += i
        if right is None:
            a, b = a[a < b], b[a < b]
        if check_radius is not None and len(a):
            total = np.bitwise_count(left[a] ^ other[b]).sum(axis=1, dtype=np.int64)
            a, b = a[total <= check_radius], b[total <= check_radius]
        for mask in earlier:
            if not len(a):
                break
            own = ((left[a, 0] ^ other[b, 0]) & np.uint64(mask)) != 0
            a, b = a[own], b[own]
        pairs_a.append(a)
        pairs_b.append(b + shift)
    return _spanning(np.concatenate(pairs_a), np.concatenate(pairs_b), n + (0 if right is None else len(right)))


def _spanning(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every index below ``size`` that the links (a, b) tie to a smaller one, and the smallest one it is tied to."""
    label = np.arange(size)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = new[new]
        if (new == label).all():
            break
        label = new
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    while (label[label] != label).any():
        label = label[label]
    members = np.flatnonzero(label != np.arange(size))
    return members, label[members]


def cells_of_bits(prints: DataFrame, radius: int, share: int) -> DataFrame:
    """(grid, cell, fp, check_word, rep): the cells of each fingerprint, one for every choice of blocks."""
    masks = [_signed(m) for m in block_masks(radius, share)]
    cell = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("grid", "cell")
    return prints.select(cell, "fp", "check_word", "rep")


def tile_pairs(cells: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """(grid, left, right): tiles to compare, as arrays of (fp, check_word, rep); ``right`` is null for a tile with itself.

    All fingerprints of a cell that fits one tile are together; a larger cell is cut by population count, in classes of a quarter
    of the radius, and by hash, and tiles of classes that lie further apart than the radius do not meet.
    """
    width = max(1, radius // 4)
    reach = (radius + width - 1) // width
    cells = cells.withColumn("pop", F.floor(F.bit_count("fp") / width).cast("int"))
    # Only cells above one tile are listed with their cuts; all others are one tile.
    sizes = cells.groupBy("grid", "cell", "pop").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.groupBy("grid", "cell").agg(F.sum("n").alias("cell_n"), F.collect_list(F.struct("pop", "n")).alias("pops"))
    large = large.where(F.col("cell_n") > tile).select(
        "grid", "cell",
        F.map_from_entries(F.transform("pops", lambda p: F.struct(p["pop"], F.ceil(p["n"] / tile).cast("int")))).alias("cuts"),
    )
    dealt = cells.join(large, ["grid", "cell"], "left")
    cut = lambda pop: F.coalesce(F.col("cuts")[pop], F.lit(0))
    own = F.struct(F.col("pop").alias("pop"), F.pmod(F.xxhash64("fp"), F.greatest(cut(F.col("pop")), F.lit(1))).cast("int").alias("salt"))
    near = F.flatten(F.transform(
        F.sequence(F.greatest(F.col("pop") - reach, F.lit(0)), F.least(F.col("pop") + reach, F.lit(BITS // width))),
        lambda p: F.transform(
            F.when(cut(p) > 0, F.sequence(F.lit(0), cut(p) - 1)).otherwise(F.array().cast("array<int>")),
            lambda s: F.struct(p.alias("pop"), s.alias("salt")),
        ),
    ))
    nobody = F.struct(F.lit(-1).alias("pop"), F.lit(-1).alias("salt"))
    dealt = dealt.withColumn("own", F.when(F.col("cuts").isNull(), nobody).otherwise(own))
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("cuts").isNull(), F.array(nobody)).otherwise(near)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    item = F.struct("fp", "check_word", "rep")
    return (
        dealt.select("grid", "cell", low.alias("low"), high.alias("high"), (F.col("own") == low).alias("first"), item.alias("item"))
        .groupBy("grid", "cell", "low", "high")
        .agg(
            F.collect_list(F.when(F.col("first"), F.col("item"))).alias("left"),
            F.collect_list(F.when(~F.col("first"), F.col("item"))).alias("right"),
        )
        # A tile to which the hash dealt nothing meets nobody.
        .where((F.size("left") > 0) & F.when(F.col("low") == F.col("high"), F.size("left") > 1).otherwise(F.size("right") > 0))
        .select("grid", "left", "right")
    )


def links(prints: DataFrame, radius: int, check_radius: int | None = None, tile: int = TILE, share: int | None = None) -> DataFrame:
    """(hi, lo): a spanning forest of the near pairs of every pair of tiles, as representatives with hi > lo.

    A pair counts in the tiles of the first mask on which it agrees only, so no link is found twice.
    """
    share = share or plan_share(prints.count(), radius, tile)
    masks = block_masks(radius, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for grid, reps, a, b in _forests(batch, radius, check_radius, masks):
                hi.append(np.maximum(reps[a], reps[b]))
                lo.append(np.minimum(reps[a], reps[b]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hi)), pa.array(np.concatenate(lo))], names=["hi", "lo"])

    return tile_pairs(cells_of_bits(prints, radius, share), radius, tile).mapInArrow(run, "hi long, lo long").distinct()


def _rows_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = lists.flatten()
    fields = [np.asarray(flat.field(i)) for i in range(3)]
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists), dtype=np.int64))])
    return np.stack(fields[:2], axis=1).view(np.uint64), fields[2], ends


def _forests(batch: pa.RecordBatch, radius: int, check_radius: int | None, masks: Sequence[int]):
    """(grid, representatives, members, their roots) of every pair of tiles; pairs that an earlier mask ties are left to it."""
    grids = batch.column(0).to_pylist()
    (lw, lr, le), (rw, rr, re) = _rows_of(batch.column(1)), _rows_of(batch.column(2))
    for k in range(batch.num_rows):
        left, right = lw[le[k] : le[k + 1]], rw[re[k] : re[k + 1]]
        reps = np.concatenate([lr[le[k] : le[k + 1]], rr[re[k] : re[k + 1]]])
        yield grids[k], reps, *forest(left, right if len(right) else None, radius, check_radius, masks[: grids[k]])


def candidate_groups(cells: DataFrame, radius: int, check_radius: int | None, tile: int = TILE) -> DataFrame:
    """(root, node): what fingerprints tie together inside one pair of tiles; ``root`` names the group by its members.

    A group is no larger than two tiles, and one that several cells hold is returned once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, reps, a, b in _forests(batch, radius, check_radius, ()):
                for root in np.unique(b):
                    group = np.unique(np.append(reps[a[b == root]], reps[root]))
                    names.append(np.full(len(group), xxhash.xxh64_intdigest(group.tobytes(), SEED), np.uint64).view(np.int64))
                    nodes.append(group)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(nodes))], names=["root", "node"])

    return tile_pairs(cells, radius, tile).mapInArrow(run, "root long, node long").distinct()


# -- components ------------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (hi, lo) can reach, for all nodes but roots.

    Large-star and small-star steps in turn, until nothing changes; each round is written to the shared folder.
    """
    edges, before = durable(edges, "links"), None
    while True:
        both = edges.union(edges.select("lo", "hi")).toDF("node", "next")
        least = both.groupBy("node").agg(F.least(F.min("next"), F.col("node")).alias("low"))
        # The centre of a star has as many edges as the star has points: they are dealt to ``SALT`` parts.
        parts = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        dealt = both.where(F.col("next") > F.col("node")).withColumn("part", F.pmod(F.xxhash64("next"), F.lit(SALT)).cast("int"))
        large = dealt.join(parts, ["node", "part"]).select(F.col("next").alias("hi"), F.col("low").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("low"))
        small = large.join(lowest, "hi")
        small = small.select(F.explode(F.array(F.struct("lo", "low"), F.struct(F.col("hi").alias("lo"), "low"))).alias("e")).select(
            F.col("e.lo").alias("hi"), F.col("e.low").alias("lo")
        )
        edges = durable(small.where(F.col("hi") != F.col("lo")).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.toDF("node", "root")
        before = now


def near_duplicates(
    docs: DataFrame, shingle: int = 4, radius: int = 4, check_radius: int | None = None, tile: int = TILE,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, fingerprint, component_id) of every row of ``docs``.

    Texts are lower-cased (A-Z), words are runs without ASCII white space, shingles are ``shingle`` words with repeats
    (all words where there are fewer). Two rows are linked if their fingerprints differ in at most ``radius``
    bits and, where ``check_radius`` is given, if they and a second, independent 64-bit fingerprint
    differ in at most that many bits together. ``component_id`` is the smallest id that links reach.

    Ids must be integers. Null and empty texts have fingerprint zero and are linked like any other; a null
    id is no name for a component, so a component without other ids has a null one. Repeated rows are
    kept. Extra columns are ignored. An empty table gives an empty one.
    """
    known = durable(fingerprints(docs, shingle, check_radius is not None, id_col, text_col).withColumnRenamed(id_col, "id"), "fingerprints")
    prints = known.groupBy("fp", "check_word").agg(F.min("id").cast("long").alias("rep")).where(F.col("rep").isNotNull())
    # Representatives in ascending order of fingerprint and id: one for each distinct fingerprint.
    prints = durable(prints, "prints")
    roots = components(links(prints, radius, check_radius, tile))
    named = prints.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "fp", "check_word", F.coalesce("root", "rep").alias("component_id")
    )
    return known.join(named, ["fp", "check_word"], "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# -- exact comparison ------------------------------------------------------------------------------

def similar(sets: list[np.ndarray], split: int | None, least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the sets whose Jaccard similarity is ``least`` or more: all pairs, or only those across ``split``.

    Sets hold distinct values. Common values are counted by matrix products over a bounded number of values at a time.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    value, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)[1:]
    shared = times[value] > 1
    owner, value = owner[shared], (np.cumsum(times > 1) - 1)[value[shared]]
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    left, right = (slice(None), slice(None)) if split is None else (slice(0, split), slice(split, None))
    common = np.zeros((len(sizes[left]), len(sizes[right])), np.int64)
    for start in range(0, int(value[-1]) + 1 if len(value) else 0, COLUMNS):
        a, b = np.searchsorted(value, [start, start + COLUMNS])
        has = np.zeros((len(sets), min(COLUMNS, int(value[-1]) + 1 - start)), np.float32)
        has[owner[a:b], value[a:b] - start] = 1
        common += (has[left] @ has[right].T).astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - common
    a, b = np.nonzero(least.denominator * common >= least.numerator * union)
    return (a[a < b], b[a < b]) if split is None else (a, b + split)


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of ``docs`` (node, text): distinct hashes of 64 bits, ascending, as bytes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in groups(batch, "text"):
                made = [shingle_set(shingle_hashes(t, shingle)).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(made, pa.binary())], names=["node", "shingles"])

    return docs.select("node", "text").mapInArrow(make, "node long, shingles binary")


def set_links(sets: DataFrame, similarity: float, most_shingles: int = BLOCK_SHINGLES, most_sets: int = BLOCK_SETS) -> DataFrame:
    """(hi, lo): links of ``sets`` (root, node, shingles) with one root that have this Jaccard similarity or more.

    Sets of one root are together where they fit a block; more are dealt to blocks by hash, and every pair of blocks
    returns a spanning forest of its links.
    """
    least = Fraction(str(similarity))
    sizes = sets.groupBy("root").agg(
        F.greatest(F.ceil(F.sum(F.length("shingles")) / (8 * most_shingles)), F.ceil(F.count(F.lit(1)) / most_sets)).cast("int").alias("blocks")
    )
    dealt = sets.join(sizes.where("blocks > 1"), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high, item = F.least("own", "other"), F.greatest("own", "other"), F.struct("node", "shingles")
    pairs = (
        dealt.select("root", low.alias("low"), high.alias("high"), (F.col("own") == low).alias("first"), item.alias("item"))
        .groupBy("root", "low", "high")
        .agg(F.collect_list(F.when(F.col("first"), F.col("item"))).alias("left"), F.collect_list(F.when(~F.col("first"), F.col("item"))).alias("right"))
        .where(F.size("left") + F.size("right") > 1)
        .select("left", "right")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(batch.num_rows):
                sides = [batch.column(i)[k].values for i in (0, 1)]
                nodes = np.concatenate([np.asarray(side.field(0)) for side in sides])
                items = [np.frombuffer(x.as_buffer(), np.uint64) for side in sides for x in side.field(1)]
                a, b = _spanning(*similar(items, len(sides[0]) if len(sides[1]) else None, least), len(items))
                hi.append(np.maximum(nodes[a], nodes[b]))
                lo.append(np.minimum(nodes[a], nodes[b]))
            hi, lo = np.concatenate(hi), np.concatenate(lo)
            yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo)], names=["hi", "lo"])

    return pairs.mapInArrow(compare, "hi long, lo long")


def near_copies(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 20, check_radius: int = 36, tile: int = TILE,
) -> DataFrame:
    """(id, key, root) of every row of ``docs`` (id, key, text): rows with one root are near copies or tied by near copies.

    Rows are linked if the sets of their shingles have a Jaccard similarity of ``similarity`` or more; texts without words
    have equal sets. Pairs are compared that share a band and whose fingerprints lie within the two radii, or are tied by such pairs
    of one cell. An id and a key name one text. Sets of shingles are known by hashes of 64 bits.
    """
    known = durable(named_sets(docs.select("id", "key", "text"), shingle), "fingerprints")
    nodes = known.groupBy("node").agg(
        F.min("fp").alias("fp"), F.min("check_word").alias("check_word"), F.min(F.struct("id", "key")).alias("row"), F.first("bands").alias("bands")
    )
    nodes = durable(nodes, "prints")
    cells = nodes.select(F.posexplode("bands").alias("grid", "cell"), "fp", "check_word", F.col("node").alias("rep"))
    found = durable(candidate_groups(cells, radius, check_radius, tile), "candidates")
    members = found.select("node").distinct().join(nodes, "node").select("node", "row.id", "row.key")
    texts = docs.join(members, ["id", "key"]).select("node", "text").dropDuplicates(["node"])
    sets = durable(shingle_sets(texts, shingle), "sets")
    roots = components(set_links(durable(found.join(sets, "node"), "groups"), similarity))
    return known.join(roots, "node", "left").select("id", "key", F.coalesce("root", "node").alias("root"))


def drop_near_duplicates(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 20, check_radius: int = 36, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near copies, the one with the smallest id.

    Near copies are tied by links of a Jaccard similarity of ``similarity`` or more between the sets of their shingles, see
    ``near_copies``. A row is named by its id and its text, so unlike texts under one id are apart; of rows with both in common
    one stays. Rows with a null id can't be named and all stay. Columns are those of ``docs``.
    """
    key, = fresh(docs, "key")
    named = docs.where(F.col(id_col).isNotNull()).withColumn(key, F.xxhash64(text_col))
    found = near_copies(named.select(F.col(id_col).alias("id"), F.col(key).alias("key"), F.col(text_col).alias("text")), shingle, similarity, radius, check_radius)
    kept = found.groupBy("root").agg(F.min(F.struct("id", "key")).alias("r")).select(F.col("r.id").alias(id_col), F.col("r.key").alias(key))
    once = named.join(kept, [id_col, key], "left_semi").dropDuplicates([id_col, key])
    return once.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
