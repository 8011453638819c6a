"""Ranked lexical search by NRA: sequential reads of impact-sorted postings, a score interval per document.

An impact is what one term adds to one document's score. Postings of the query's terms are written down in levels of
falling impact; a round reads the next level of every list and no list is ever looked up by document. For each pair of query and document
seen so far the lower bound is the sum of the impacts read, the upper bound adds, for each list in which the document has not
come up, the highest impact that list can still hold. After a round a query's threshold is its k-th best lower bound:

* documents whose upper bound is below the threshold leave;
* a query is closed to new documents once a document that has not come up at all can't reach the threshold;
* reading goes on until both bounds of every document left are equal, so that membership, ties and scores are final.

Levels hold a fourfold number of postings each and the last one ends the lists, so a handful of rounds is enough, and the late, long levels are
read only for documents that are still in question. An upper bound needs to know which lists a document came up in. Instead of
that set a row carries, for each coming round, the sum of what these lists could still give: sums merge, sets don't.

The queries are taken in blocks of bounded vocabulary (``BLOCK_BYTES`` of text and ``BLOCK_ITEMS`` items), so terms, weights
and thresholds of a block fit into any worker whatever the number of queries. Documents are never collected or broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffline.llm.common import LOWER, UPPER, durable, fresh, spread

BLOCK_BYTES, BLOCK_ITEMS = 4 << 20, 20_000
#: A level holds so many times the postings of all levels before it.
GROWTH = 4
FIRST_SHARE = 1 / 64
#: Cells per octave of the histogram of impacts.
CELLS = 8
#: Pairs of a posting and an item that a task handles at once.
MEETINGS = 1 << 19
#: Bytes of a text that are split into words at once.
PIECE = 4 << 20
#: Saturation and length share of the scores, in hundredths, and the scale of impacts.
BASE, SHARE, RISE, SCALE = 75, 25, 12, 1_000_000_000

_BREAKS = bytes(b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123))
_TABLE = bytes.maketrans(_BREAKS + UPPER.encode(), b" " * len(_BREAKS) + LOWER.encode())


def count_words(text: str | None) -> tuple[int, Counter]:
    """Number of words and the count of each, as bytes; a long text is split in pieces that end at a break."""
    data = (text or "").encode().translate(_TABLE)
    counts, start = Counter(), 0
    while start < len(data):
        end = data.find(b" ", start + PIECE) if start + PIECE < len(data) else -1
        end = len(data) if end < 0 else end
        counts.update(data[start:end].split())
        start = end + 1
    return counts.total(), counts


@dataclass
class Queries:
    """A block of queries: the dictionary of its terms and, term by term, the items that hold it."""

    terms: dict[bytes, int] = field(default_factory=dict)
    ids: list = field(default_factory=list)
    pairs: list[tuple[int, int, int]] = field(default_factory=list)

    def add(self, item_id, text: str | None) -> None:
        for word, times in count_words(text)[1].items():
            self.pairs.append((self.terms.setdefault(word, len(self.terms)), len(self.ids), times))
        self.ids.append(item_id)

    def index(self) -> None:
        rows = np.array(sorted(self.pairs), dtype=np.int64).reshape(-1, 3)
        self.pairs = []
        self.term, self.item, self.times = rows.T
        self.start = np.searchsorted(self.term, np.arange(len(self.terms) + 1))


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


# -- postings --------------------------------------------------------------------------------------

def _hits(terms: dict[bytes, int]):
    """Words and query terms of every text that has a word."""
    known = terms.keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, size, term, tf, lengths = [], [], [], [], []
            for at, text in enumerate(batch.column("body")):
                n, counts = count_words(text.as_py())
                if n:
                    found = sorted((terms[w], counts[w]) for w in counts.keys() & known)
                    kept.append(at)
                    size.append(n)
                    lengths.append(len(found))
                    term.extend(t for t, _ in found)
                    tf.extend(c for _, c in found)
            rows = pa.array(kept, pa.int64())
            yield pa.record_batch([
                batch.column("uid").take(rows), batch.column("doc").take(rows), pa.array(size, pa.int64()),
                _lists(np.array(term, np.int32), np.array(lengths, np.int64), pa.int32()),
                _lists(np.array(tf, np.int64), np.array(lengths, np.int64), pa.int64()),
            ], names=["uid", "doc", "n", "term", "tf"])

    return run


def _flat(batch: pa.RecordBatch, *names: str) -> tuple[np.ndarray, ...]:
    """Row of each list element, then the elements of the named list columns."""
    lists = [batch.column(n) for n in names]
    lengths = np.diff(np.asarray(lists[0].offsets)).astype(np.int64)  # right for slices too, as flatten() is
    return np.repeat(np.arange(len(lengths)), lengths), *[np.asarray(c.flatten()).astype(np.int64) for c in lists]


def _impacts(batch: pa.RecordBatch, weights: np.ndarray, n_docs: int, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, impact) of each posting; the length norm is computed without overflow."""
    row, term, tf = _flat(batch, "term", "tf")
    norm = np.array([BASE + (SHARE * n * n_docs) // n_words for n in batch.column("n").to_pylist()], dtype=np.int64)
    return row, term, weights[term] * ((SCALE * tf) // (1000 * tf + RISE * norm[row]))


def _cell(impact: np.ndarray) -> np.ndarray:
    return np.floor(CELLS * np.log2(np.maximum(impact, 1))).astype(np.int64)


def _profile(weights: np.ndarray, n_docs: int, n_words: int):
    """Per task: the least and highest impact of each term and the number of postings per cell of impacts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, most, cells = np.full(len(weights), 2**62), np.zeros(len(weights), np.int64), Counter()
        for batch in batches:
            _, term, impact = _impacts(batch, weights, n_docs, n_words)
            np.minimum.at(least, term, impact)
            np.maximum.at(most, term, impact)
            at, n = np.unique(_cell(impact), return_counts=True)
            cells.update(dict(zip(at.tolist(), n.tolist())))
        seen = np.flatnonzero(least < 2**62)
        names = ["key", "least", "most", "n"]
        yield pa.record_batch([pa.array(seen), pa.array(least[seen]), pa.array(most[seen]), pa.array(np.zeros(len(seen), np.int64))], names=names)
        keys = sorted(cells)
        none = pa.array([0] * len(keys), pa.int64())
        yield pa.record_batch([pa.array([-1 - k for k in keys], pa.int64()), none, none, pa.array([cells[k] for k in keys], pa.int64())], names=names)

    return run


def level_ends(cells: dict[int, int]) -> list[int]:
    """Lowest impact of each level, falling; the last is 1, so every impact above zero has its level."""
    ends, total, seen, goal = [], sum(cells.values()), 0, FIRST_SHARE
    for cell in sorted(cells, reverse=True):
        seen += cells[cell]
        if seen >= goal * total:
            ends.append(max(1, math.floor(2 ** (cell / CELLS)) - 1))
            while seen >= goal * total:
                goal *= GROWTH
    ends = ends or [1]
    return [*ends[:-1], 1]


def _levels(weights: np.ndarray, n_docs: int, n_words: int, ends: list[int]):
    """(level, uid, term, impact) with the postings of a row in falling order of impact."""
    bounds = -np.array(ends, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, impact = _impacts(batch, weights, n_docs, n_words)
            level = np.searchsorted(bounds, -impact)
            good = impact > 0
            order = np.lexsort((-impact, row, level))
            order = order[good[order]]
            row, term, impact, level = row[order], term[order], impact[order], level[order]
            cut = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(level, prepend=-1)) if len(row) else np.zeros(0, np.int64)
            lengths = np.diff(np.append(cut, len(row)))
            uid = np.asarray(batch.column("uid"))
            yield pa.record_batch([
                pa.array(level[cut].astype(np.int32)), pa.array(uid[row[cut]]),
                _lists(term.astype(np.int32), lengths, pa.int32()), _lists(impact, lengths, pa.int64()),
            ], names=["level", "uid", "term", "impact"])

    return run


# -- rounds ----------------------------------------------------------------------------------------

def _read(q: Queries, takes: np.ndarray, floors: np.ndarray, rest: np.ndarray, asked: bool):
    """(item, uid, lower, cover_0, ...) of one level.

    ``takes`` marks the items that are open to new documents; where a row names items itself (``asked``), those are taken as well.
    ``rest[j, t]`` bounds what list ``t`` can give after ``j`` more rounds. New documents that can't reach the floor don't come in.
    """
    n_items, ahead = len(q.ids), len(rest)
    open_rest = np.zeros(n_items, np.int64)
    np.add.at(open_rest, q.item, q.times * rest[0][q.term])

    fans = np.diff(q.start)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slices whose postings meet about ``MEETINGS`` items."""
        for batch in batches:
            row, term = _flat(batch, "term")
            part = np.cumsum(np.bincount(row, fans[term], batch.num_rows)).astype(np.int64) // MEETINGS
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            row, term, impact = _flat(batch, "term", "impact")
            lengths = fans[term]
            at = spread(q.start[term], lengths)
            code = np.repeat(row, lengths) * n_items + q.item[at]
            new = takes[q.item[at]]
            if asked:
                r, i = _flat(batch, "asked")
                old_codes = np.sort(r * n_items + i)
                old = np.isin(code, old_codes)
                new = new | old
            at, code, each = at[new], code[new], np.repeat(impact, lengths)[new]
            keys, inverse = np.unique(code, return_inverse=True)
            item = keys % n_items
            add = lambda v: np.bincount(inverse, minlength=len(keys)) if v is None else _sums(inverse, v, len(keys))
            times = q.times[at]
            lower = add(times * each)
            cover = [add(times * rest[j][q.term[at]]) for j in range(ahead)]
            keep = lower + open_rest[item] - cover[0] >= floors[item]
            if asked:
                keep |= np.isin(keys, old_codes)
            uid = np.asarray(batch.column("uid"))[(keys // n_items)[keep]]
            yield pa.record_batch(
                [pa.array(item[keep].astype(np.int32)), pa.array(uid), pa.array(lower[keep]), *[pa.array(c[keep]) for c in cover]],
                names=["item", "uid", "lower", *[f"cover_{j}" for j in range(ahead)]],
            )

    return run


def _sums(inverse: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, inverse, values)
    return out


def _thresholds(state: DataFrame, k: int, n_items: int) -> np.ndarray:
    """k-th best lower bound of each item of the block, 1 where fewer documents have come up."""
    w = Window.partitionBy("item").orderBy(F.desc("lower"), "uid")
    best = state.select("item", "uid", "lower").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    rows = best.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("lower").alias("least")).collect()
    out = np.ones(n_items, np.int64)
    for r in rows:
        if r["n"] == k:
            out[r["item"]] = r["least"]
    return out


def _still_in(state: DataFrame, limits: DataFrame, cover: str) -> DataFrame:
    """Rows whose upper bound reaches their item's threshold; ``limits`` has a row per item of the block."""
    at = state.join(F.broadcast(limits), "item")
    return at.where(F.col("lower") + F.col("rest") - F.col(cover) >= F.col("least")).drop("rest", "least")


def _search_block(hits: DataFrame, q: Queries, n_docs: int, n_words: int, k: int) -> DataFrame | None:
    """(item, uid, score) of every document that can be among the ``k`` best of an item, with final scores."""
    spark = hits.sparkSession
    df = {r["t"]: r["n"] for r in hits.select(F.explode("term").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(q.terms))], dtype=np.int64)
    found = hits.select("n", "term", "tf").mapInArrow(_profile(weights, n_docs, n_words), "key bigint, least bigint, most bigint, n bigint")
    profile = found.groupBy("key").agg(F.min("least"), F.max("most"), F.sum("n")).collect()
    least, most, cells = np.zeros(len(weights), np.int64), np.zeros(len(weights), np.int64), {}
    for key, low, high, n in profile:
        if key < 0:
            cells[-1 - key] = n
        else:
            least[key], most[key] = low, high
    ends = level_ends(cells)
    made = hits.select("uid", "n", "term", "tf").mapInArrow(_levels(weights, n_docs, n_words, ends), "level int, uid bigint, term array<int>, impact array<bigint>")
    levels = durable(made, "levels", ["level"])
    # rest[r, t]: the most that list t can give after round r; a list read to its end gives nothing.
    rest = np.array([[min(m, e - 1) if l < e else 0 for l, m in zip(least, most)] for e in ends], dtype=np.int64)
    rest[-1] = 0
    takes, floors, state = np.ones(len(q.ids), bool), np.ones(len(q.ids), np.int64), None
    for r in range(len(ends)):
        ahead = rest[r:]
        names = [f"cover_{j}" for j in range(len(ahead))]
        schema = "item int, uid bigint, lower bigint, " + ", ".join(f"{c} bigint" for c in names)
        level = levels.where(F.col("level") == r).select("uid", "term", "impact")
        if state is not None:
            asked = state.groupBy("uid").agg(F.collect_list("item").alias("asked"))  # at most the items of a block
            level = level.join(asked, "uid", "left" if takes.any() else "inner")
            level = level.withColumn("asked", F.coalesce("asked", F.array().cast("array<int>")))
        read = level.mapInArrow(_read(q, takes, floors, ahead, state is not None), schema)
        if state is not None:
            # What is now cover_0 was one round away when the state was written.
            carried = state.select("item", "uid", "lower", *[F.col(f"cover_{j + 1}").alias(c) for j, c in enumerate(names)])
            read = carried.unionByName(read).groupBy("uid", "item").agg(*[F.sum(c).alias(c) for c in ("lower", *names)])
        state = durable(read.select("item", "uid", "lower", *names), "interval")
        floors = np.maximum(floors, _thresholds(state, k, len(q.ids)))
        left = _sums(q.item, q.times * rest[r][q.term], len(q.ids))
        takes = (left > 0) & (left >= floors)
        limits = spark.createDataFrame(list(zip(range(len(q.ids)), left.tolist(), floors.tolist())), "item int, rest bigint, least bigint")
        state = _still_in(state, limits, "cover_0")
        if not takes.any() and not state.join(F.broadcast(limits), "item").where("rest > cover_0").head(1):
            break
    return state.select("item", "uid", F.col("lower").alias("score"))


# -- the operator ----------------------------------------------------------------------------------

def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[Queries]:
    """Queries in blocks of bounded size, dealt by hash; equal rows count once. A block is all that the driver ever holds."""
    rows = items.select(F.col(item_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).distinct()
    rows = durable(rows, "queries")
    total, n = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(1, math.ceil(total / BLOCK_BYTES), math.ceil(n / BLOCK_ITEMS))
    for part in range(parts):
        q = Queries()
        for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).toLocalIterator():
            q.add(r["i"], r["t"])
        if q.terms:
            q.index()
            yield q


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, scores above 0, ties by ascending id.

    Every row of ``docs`` is a document of its own, also where ids or texts repeat; null ids come last among ties and
    are returned as null. Null and empty texts have no term: such a document counts nowhere, such an item returns nothing. Equal
    rows of ``items`` are one item; rows of one id with different texts are ranked separately, under the same id. Long texts are counted
    whole. Other columns are ignored. An empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    doc_type, item_type = docs.schema[doc_col].dataType, items.schema[item_col].dataType
    out_names = [item_col, *fresh(items.select(item_col), "rank"), doc_col, "score"]
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_col).alias("doc"), F.col(text_col).alias("body"))
    made = T.StructType([
        T.StructField("uid", T.LongType()), T.StructField("doc", doc_type), T.StructField("n", T.LongType()),
        T.StructField("term", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.LongType())),
    ])
    schema = T.StructType([T.StructField("item", item_type), T.StructField("rank", T.IntegerType()), T.StructField("doc", doc_type), T.StructField("score", T.LongType())])
    out = spark.createDataFrame([], schema)
    for q in _blocks(items, item_col, text_col):
        hits = durable(rows.mapInArrow(_hits(q.terms), made), "hits")
        n_docs, n_words = hits.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        best = _search_block(hits, q, n_docs, n_words, k)
        w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"), "uid")
        top = best.join(hits.select("uid", "doc"), "uid").withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col("score") > 0))
        names = spark.createDataFrame(list(enumerate(q.ids)), T.StructType([T.StructField("at", T.IntegerType()), T.StructField("item_id", item_type)]))
        top = top.join(F.broadcast(names), F.col("item") == F.col("at"))
        out = out.unionAll(top.select(F.col("item_id").alias("item"), "rank", "doc", "score"))
    return out.toDF(*out_names)
