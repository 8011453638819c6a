"""Byte-level BPE: padded matrices in which every row merges its leftmost pair of least rank each round.

Pieces are bucketed by length. A round looks for each row's first pair of least rank, writes the
merged token, closes the gap (compaction) and looks up the two pairs that changed in a hash table.
Rows without a pair left leave the matrix. Very long pieces use the same rule with minima per block.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffline.llm.common import groups, id_field, spread

NONE = np.int64(1) << 40
WIDTHS = (4, 8, 12, 16, 24, 32, 48, 64, 96, 128, 256, 512)
CELLS = 1 << 20
#: A worker forgets its chunks when they are more than this many, or have more characters than this.
CACHED_WORDS = 300_000
CACHED_CHARS = 1 << 24
_DOUBLE_SPACE = re.compile(r"\s\s")
_SAFE = regex.compile(r"(?<=\S) (?=\S)")


class PairTable:
    """Open-addressed hash table from (left id, right id) to the merged id, in numpy arrays."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(10, int(len(pairs)).bit_length() + 2)
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int64)
        left, slot, self.probes = np.arange(len(pairs)), self._slot(pairs), 0
        while len(left):
            self.probes += 1
            free = self.keys[slot[left]] < 0
            first = np.zeros(len(left), bool)
            first[np.unique(slot[left], return_index=True)[1]] = True
            put = free & first
            self.keys[slot[left[put]]], self.values[slot[left[put]]] = pairs[left[put]], merged[left[put]]
            left = left[~put]
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        mixed = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where there is no such pair or an id is negative (padding)."""
        pairs = (left << 32) | right
        slot = self._slot(pairs)
        found = self.keys[slot]
        out = np.where(found == pairs, self.values[slot], NONE)
        again = np.flatnonzero((found != pairs) & (found >= 0))
        for _ in range(self.probes):
            if not len(again):
                break
            slot[again] = (slot[again] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[again]]
            hit = found == pairs[again]
            out[again[hit]] = self.values[slot[again[hit]]]
            again = again[(~hit) & (found >= 0)]
        out[(left < 0) | (right < 0)] = NONE
        return out


class ByteBpe:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = regex.compile(pattern).findall
        self.bytes_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        size = max(ranks.values()) + 1
        words = [b""] * size
        for word, rank in ranks.items():
            words[rank] = word
        self.word_lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.word_starts = np.cumsum(self.word_lengths) - self.word_lengths
        self.word_bytes = np.frombuffer(b"".join(words), dtype=np.uint8)
        pairs, merged = [], []
        for word, rank in ranks.items():
            for i in range(1, len(word)):
                a, b = ranks.get(word[:i]), ranks.get(word[i:])
                if a is not None and b is not None:
                    pairs.append((a << 32) | b)
                    merged.append(rank)
        self.pairs = PairTable(np.array(pairs, dtype=np.int64), np.array(merged, dtype=np.int64))
        self.known: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self._reset()

    # -- pieces ------------------------------------------------------------------------------------

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, how many each has)."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        flat = self.bytes_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        starts = np.cumsum(sizes) - sizes
        counts, parts = np.zeros(len(pieces), np.int64), [np.zeros(0, np.int64)] * len(pieces)
        low = 0
        for width in WIDTHS:
            chosen = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            step = max(1, CELLS // width)
            for i in range(0, len(chosen), step):
                rows = chosen[i : i + step]
                for row, ids in zip(rows.tolist(), self._matrix(flat, starts[rows], sizes[rows], width)):
                    parts[row] = ids
        for row in np.flatnonzero(sizes > low).tolist():
            parts[row] = self._long(flat[starts[row] : starts[row] + sizes[row]])
        counts[:] = [len(p) for p in parts]
        return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), counts

    def _matrix(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> list[np.ndarray]:
        n, cols = len(starts), np.arange(width)
        tokens = np.full((n, width), -1, dtype=np.int64)
        tokens[cols < sizes[:, None]] = flat[spread(starts, sizes)]
        done, left, live = np.full((n, width), -1, dtype=np.int64), sizes.copy(), np.arange(n)
        ranks = np.full((n, width), NONE, dtype=np.int64)
        ranks[:, :-1] = self.pairs.get(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(n, width - 1)
        while len(live):
            at = ranks.argmin(axis=1)
            rows = np.arange(len(live))
            best = ranks[rows, at]
            over = best >= NONE
            if over.any():
                done[live[over]] = tokens[over]
                live, tokens, ranks, at, best = live[~over], tokens[~over], ranks[~over], at[~over], best[~over]
                rows = np.arange(len(live))
                if not len(live):
                    break
            left[live] -= 1
            tokens[rows, at] = best
            later = cols[None, :] > at[:, None]
            shift = np.minimum(cols[None, :] + later, width - 1)
            tokens = np.take_along_axis(tokens, shift, axis=1)
            tokens[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(cols[None, :] + (cols[None, :] >= at[:, None]), width - 1), axis=1)
            ranks[:, -1] = NONE
            after = np.minimum(at + 1, width - 1)
            ranks[rows, at] = np.where(at < width - 1, self.pairs.get(tokens[rows, at], tokens[rows, after]), NONE)
            back = np.flatnonzero(at > 0)
            ranks[back, at[back] - 1] = self.pairs.get(tokens[back, at[back] - 1], tokens[back, at[back]])
        return [done[i, :k] for i, k in enumerate(left.tolist())]

    def _long(self, tokens: np.ndarray, block: int = 512) -> np.ndarray:
        """One long piece: minima per block, links instead of compaction."""
        n = len(tokens)
        tokens = tokens.copy()
        blocks = -(-n // block)
        ranks = np.full(blocks * block, NONE, dtype=np.int64)
        ranks[: n - 1] = self.pairs.get(tokens[:-1], tokens[1:])
        grid = ranks.reshape(blocks, block)
        least = grid.min(axis=1)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        while True:
            b = int(least.argmin())
            if least[b] >= NONE:
                break
            at = b * block + int(grid[b].argmin())
            gone = int(after[at])
            tokens[at] = ranks[at]
            tokens[gone], ranks[gone] = -1, NONE
            nxt, prev = int(after[gone]), int(before[at])
            after[at] = nxt
            if nxt < n:
                before[nxt] = at
            here = np.array([prev, at] if prev >= 0 else [at])
            there = np.array([at, nxt] if prev >= 0 else [nxt])
            ok = there < n
            new = np.full(len(here), NONE, dtype=np.int64)
            new[ok] = self.pairs.get(tokens[here[ok]], tokens[there[ok]])
            ranks[here] = new
            for k in {p // block for p in (*here.tolist(), gone)}:
                least[k] = grid[k].min()
        return tokens[tokens >= 0]

    # -- texts -------------------------------------------------------------------------------------

    def _reset(self) -> None:
        self.known, self.first, self.held = {}, {}, 0
        self.pool, self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks and append their ids to the pool."""
        self.held += sum(map(len, chunks))
        pieces = [self.split(c) for c in chunks]
        own = np.array([len(p) for p in pieces], dtype=np.int64)
        distinct = list({p for ps in pieces for p in ps})
        index = dict(zip(distinct, range(len(distinct))))
        ids, counts = self.encode_pieces([p.encode() for p in distinct])
        begin = np.cumsum(counts) - counts
        used = np.fromiter((index[p] for ps in pieces for p in ps), dtype=np.int64, count=int(own.sum()))
        flat = ids[spread(begin[used], counts[used])]
        ends = np.concatenate([[0], np.cumsum(counts[used])])
        lengths = np.diff(ends[np.concatenate([[0], np.cumsum(own)])])
        base = len(self.pool)
        self.starts = np.concatenate([self.starts, base + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.pool = np.concatenate([self.pool, flat])

    def _chunks(self, text: str) -> list[str]:
        """Cut before single spaces, where no match of the pattern can reach across."""
        if _DOUBLE_SPACE.search(text) or text[0].isspace() or text[-1].isspace():
            return _SAFE.split(text)
        return text.split(" ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each has)."""
        if len(self.known) + len(self.first) > CACHED_WORDS or self.held > CACHED_CHARS:
            self._reset()
        chunks = [self._chunks(t) if t else [] for t in texts]
        heads, words = [c[0] for c in chunks if c], list(chain.from_iterable(c[1:] for c in chunks))
        new_heads, new_words = list(set(heads) - self.first.keys()), list(set(words) - self.known.keys())
        if new_heads or new_words:
            at = len(self.starts)
            self._learn(new_heads + [" " + w for w in new_words])
            self.first.update(zip(new_heads, range(at, at + len(new_heads))))
            self.known.update(zip(new_words, range(at + len(new_heads), at + len(new_heads) + len(new_words))))
        sizes = np.array([len(c) for c in chunks], dtype=np.int64)
        used = np.empty(int(sizes.sum()), dtype=np.int64)
        inner = np.ones(len(used), dtype=bool)
        begins = (np.cumsum(sizes) - sizes)[sizes > 0]
        inner[begins] = False
        used[begins] = np.fromiter(map(self.first.__getitem__, heads), dtype=np.int64, count=len(heads))
        used[inner] = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        ids = self.pool[spread(self.starts[used], self.lengths[used])]
        ends = np.concatenate([[0], np.cumsum(self.lengths[used])])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(sizes)])])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of every text."""
        sizes = self.word_lengths[ids]
        data = self.word_bytes[spread(self.word_starts[ids], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]


@lru_cache(maxsize=2)
def bpe(path: str, pattern: str) -> ByteBpe:
    """The encoder of a worker, built once."""
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row of ``docs``.

    A null or empty text has no ids. Null ids and repeated rows are kept, one result each; extra columns are
    ignored, whatever their names. An empty table gives an empty one.
    """
    schema = T.StructType([id_field(docs, id_col), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        for batch in batches:
            for first, texts in groups(batch, text_col):
                ids, counts = coder.encode(texts)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), arrays], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, data binary, text) from ids; ``text`` is null where the bytes are not UTF-8. Null ids give empty bytes."""
    schema = T.StructType([id_field(encoded, id_col), T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                lists = part.column(1)
                counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
                data = coder.decode(np.asarray(pc.list_flatten(lists), dtype=np.int64), counts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], names=[id_col, "data"])

    return encoded.select(id_col, ids_col).mapInArrow(run, schema).withColumn("text", F.expr("try_validate_utf8(cast(data AS string))"))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, decode, and digests of both, in one pass.

    Digests are of the ids as little-endian unsigned 32-bit integers and of the decoded bytes; edge cases as in
    ``encode_documents``.
    """
    schema = T.StructType([
        id_field(docs, id_col), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        for batch in batches:
            for first, texts in groups(batch, text_col):
                ids, counts = coder.encode(texts)
                wide, ends = ids.astype("<u4").tobytes(), (4 * np.concatenate([[0], np.cumsum(counts)])).tolist()
                digests = [hashlib.sha256(wide[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]
                back = [hashlib.sha256(x).hexdigest() for x in coder.decode(ids, counts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(counts), pa.array(digests, pa.string()), pa.array(back, pa.string())],
                    names=schema.names,
                )

    return docs.select(id_col, text_col).mapInArrow(run, schema)
