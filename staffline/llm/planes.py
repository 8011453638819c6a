"""Token-id files: blocks of ids as bit or byte planes, each plane compressed, with a chunk index.

File: magic, planes of every chunk, a footer and its length. A chunk holds a fixed number of ids, whatever documents
they belong to. The footer is a zstandard frame with, per chunk, the offset, the number of ids and the compressed
length of each plane, and, per document, its id count; document ids are a column of their own beside it. Attempts
of a task write files of different names and only the manifest of attempts that ended is read, so a lost executor
leaves at most a file that nobody reads.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from staffline.llm.common import durable, groups, open_folder, shared_folder, spread

MAGIC = b"IDPLANE1"
CHUNK_IDS = 1 << 15
#: A file ends when it has so many ids, or so many documents: its footer names each of them.
FILE_IDS = 1 << 25
FILE_DOCS = 1 << 20
#: A worker forgets its words when they are more than this many, or have more characters than this.
CACHED_WORDS = 600_000
CACHED_CHARS = 1 << 24
TAIL_MARKS = ".,!?;:%$&*#"
#: How vocabularies of this kind mark the last piece of a word.
WORD_END = "</w>"


# -- planes ----------------------------------------------------------------------------------------

def to_planes(ids: np.ndarray, kind: str = "bit") -> list[bytes]:
    """Transpose a block of ids: plane k holds bit (or byte) k of every id, lowest first."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    top = int(ids.max()).bit_length() if len(ids) else 0
    if kind == "bit":
        return [np.packbits(((ids >> k) & 1).astype(np.uint8)).tobytes() for k in range(top)]
    if kind != "byte":
        raise ValueError(f"unknown kind of planes: {kind}")
    return [plane.tobytes() for plane in ids.view(np.uint8).reshape(-1, 4).T[: -(-top // 8)]]


def from_planes(planes: list[bytes], n: int, kind: str = "bit") -> np.ndarray:
    out = np.zeros(n, dtype=np.uint32)
    for k, plane in enumerate(planes):
        values = np.frombuffer(plane, dtype=np.uint8)
        if kind == "bit":
            out |= np.unpackbits(values, count=n).astype(np.uint32) << np.uint32(k)
        else:
            out |= values.astype(np.uint32) << np.uint32(8 * k)
    return out


# -- files -----------------------------------------------------------------------------------------

class PlaneWriter:
    """Writes one file; ids arrive in pieces and leave in full chunks."""

    def __init__(self, sink, kind: str, chunk_ids: int, level: int = 1) -> None:
        import zstandard

        self.sink, self.kind, self.chunk_ids = sink, kind, chunk_ids
        self.press = zstandard.ZstdCompressor(level=level).compress
        self.chunks, self.counts, self.keys = [], [], []
        self.held, self.n_held, self.n_ids = [], 0, 0
        self.at = sink.write(MAGIC)

    def add(self, keys: list, counts: np.ndarray, ids: np.ndarray) -> None:
        self.keys += keys
        self.counts += counts.tolist()
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.chunk_ids:
            all_ids = np.concatenate(self.held)
            full = len(all_ids) // self.chunk_ids * self.chunk_ids
            for i in range(0, full, self.chunk_ids):
                self._chunk(all_ids[i : i + self.chunk_ids])
            self.held, self.n_held = [all_ids[full:]], len(all_ids) - full

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.press(p) for p in to_planes(ids, self.kind)]
        self.chunks.append([self.at, len(ids), [len(p) for p in planes]])
        for plane in planes:
            self.at += self.sink.write(plane)

    def close(self) -> None:
        if self.n_held:
            self._chunk(np.concatenate(self.held))
        footer = self.press(json.dumps({"kind": self.kind, "chunks": self.chunks, "counts": self.counts, "keys": self.keys}).encode())
        self.sink.write(footer)
        self.sink.write(struct.pack("<q", len(footer)) + MAGIC)
        self.sink.close()


class PlaneReader:
    """Random access to the chunks of one file."""

    def __init__(self, source) -> None:
        import zstandard

        self.source, self.expand = source, zstandard.ZstdDecompressor().decompress
        size = source.size()
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a file of id planes")
        length = struct.unpack("<q", tail[:8])[0]
        source.seek(size - 16 - length)
        footer = json.loads(self.expand(source.read(length)))
        self.kind, self.chunks, self.counts, self.keys = (footer[k] for k in ("kind", "chunks", "counts", "keys"))

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.chunks[k]
        self.source.seek(at)
        data = self.source.read(sum(sizes))
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(int).tolist()
        return from_planes([self.expand(data[a:b]) for a, b in zip(ends, ends[1:])], n, self.kind)


# -- encoding --------------------------------------------------------------------------------------

class Pool:
    """Ids of strings, one after the other, and where each string's are; number 0 is the empty string."""

    def __init__(self) -> None:
        self.number, self.held = {"": 0}, 0
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def add(self, names: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Give ``names``, none of them known, the next numbers."""
        at, base = len(self.starts), len(self.ids)
        self.held += sum(map(len, names))
        self.number.update(zip(names, range(at, at + len(names))))
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, base + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])

    def full(self) -> bool:
        return len(self.number) > CACHED_WORDS or self.held > CACHED_CHARS

    def numbers(self, names: list[str]) -> np.ndarray:
        """The number of each name, -1 where it is not known."""
        return np.fromiter(map(self.number.get, names, repeat(-1)), dtype=np.int64, count=len(names))

    def take(self, numbers: np.ndarray) -> np.ndarray:
        return self.ids[spread(self.starts[numbers], self.lengths[numbers])]


def strings(column: pa.Array) -> list[str]:
    """The strings of a column without nulls; ``to_pylist`` makes a scalar of each and takes several times as long."""
    return column.to_numpy(zero_copy_only=False).tolist()


def stem_and_tail(word: str) -> tuple[str, str]:
    """A word as two strings whose ids follow each other: closing marks are a run of their own for the tokenizer, and
    ASCII capitals count as small letters. Words that could hold a special string stay whole."""
    if word.isalpha():
        return (word.lower() if word.isascii() else word), ""
    if "<|" in word:
        return word, ""
    stem = word.rstrip(TAIL_MARKS)
    # Only after a Latin letter: elsewhere a letter's small or composed form can end in a mark, as that of İ does.
    if not stem or not stem[-1].isalpha() or stem[-1] >= "\u0250" or stem[-1] == "İ":
        stem = word
    tail = word[len(stem) :]
    return (stem.lower() if stem.isascii() else stem), tail


def stems_and_tails(words: list[str]) -> tuple[list[str], list[str]]:
    """``stem_and_tail`` of every word, of ASCII words in one go."""
    column = pa.array(words, pa.large_string())
    ascii_only = pc.string_is_ascii(column)
    bare = pc.utf8_rtrim(column, characters=TAIL_MARKS)
    special = pc.match_substring(column, "<|")
    parted = pc.and_not(pc.match_substring_regex(bare, "[A-Za-z]$"), special)
    stems = strings(pc.if_else(special, column, pc.ascii_lower(pc.if_else(parted, bare, column))))
    tails = [w[len(s) :] if len(s) < len(w) else "" for w, s in zip(words, stems)]
    for i in np.flatnonzero(~np.asarray(ascii_only)).tolist():
        stems[i], tails[i] = stem_and_tail(words[i])
    return stems, tails


@lru_cache(maxsize=2)
def word_encoder(path: str):
    """Function from texts to (ids one after the other, counts).

    For tokenizers that split at white space and drop it, a text's ids are those of its words, so
    distinct words are encoded in batches and kept. ``path`` must name such a tokenizer, one that makes
    letters small and parts letters from marks. Small ASCII letters pass its normalizer and its splitting as they
    are, so words of these alone are given to its model at once.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tokenizers

    coder = tokenizers.Tokenizer.from_file(path)
    ids_of = lambda text: coder.encode(text, add_special_tokens=False).ids
    for text, own in (("a b", "a|b"), ("1 1", "1|1"), ("b .", "b|."), ("é 's", "é|'s"), ("Word,.", "word|,."), ("é!", "é|!"), ("b.\n's", "b.|'s")):
        if ids_of(text) != sum(map(ids_of, own.split("|")), []):
            raise ValueError("this tokenizer does not treat words one by one")
    pools = {"words": Pool(), "stems": Pool()}
    # Ids that end a word: with them, words of letters alone can be told apart in one text.
    word_end = np.zeros(coder.get_vocab_size(), dtype=bool)
    word_end[[i for name, i in coder.get_vocab().items() if name.endswith(WORD_END)]] = True
    plain = tokenizers.Tokenizer(coder.model)
    plain.pre_tokenizer = tokenizers.pre_tokenizers.CharDelimiterSplit(" ")
    letters = "the quick brown fox jumps over a lazy dog abcdefghijklmnopqrstuvwxyz"
    if plain.encode(letters, add_special_tokens=False).ids != ids_of(letters):
        plain = coder

    def add_joined(words: list[str], coder: tokenizers.Tokenizer) -> None:
        """Encode words as texts of many; a text with another number of word ends is left out."""
        for i in range(0, len(words), 20_000):
            batch = []
            parts = [words[k : k + 200] for k in range(i, min(i + 20_000, len(words)), 200)]
            for part, found in zip(parts, coder.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
                ids = np.array(found.ids, dtype=np.int32)
                ends = np.flatnonzero(word_end[ids]) + 1
                if len(ends) == len(part) and ends[-1] == len(ids):
                    batch.append((part, ids, np.diff(ends, prepend=0)))
            if batch:
                pools["stems"].add([w for p, _, _ in batch for w in p], *(np.concatenate([b[k] for b in batch]) for k in (1, 2)))

    def add_each(words: list[str]) -> None:
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            found = [e.ids for e in coder.encode_batch_fast(part, add_special_tokens=False)]
            lengths = np.array([len(x) for x in found], dtype=np.int64)
            pools["stems"].add(part, np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(lengths.sum())), lengths)

    def learn(words: list[str]) -> None:
        if pools["stems"].full():
            pools["stems"] = Pool()
        stems = pools["stems"]
        heads, tails = stems_and_tails(words)
        tailed = [i for i, x in enumerate(tails) if x]
        used = np.zeros((len(words), 2), dtype=np.int64)
        for column, rows, names in ((0, slice(None), heads), (1, tailed, [tails[i] for i in tailed])):
            numbers = stems.numbers(names)
            new = np.flatnonzero(numbers < 0).tolist()
            if new:
                missing = {names[i] for i in new}
                if word_end.any():
                    letters = [x for x in missing if x.isalpha()]
                    add_joined([x for x in letters if x.isascii()], plain)
                    add_joined([x for x in letters if not x.isascii()], coder)
                add_each([x for x in missing if x not in stems.number])
                numbers[new] = stems.numbers([names[i] for i in new])
            used[rows, column] = numbers
        pools["words"].add(words, stems.take(used.ravel()), stems.lengths[used].sum(axis=1))

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if pools["words"].full():
            pools["words"] = Pool()
        pool, column = pools["words"], pa.array(texts, pa.large_string())
        lists = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        words = pc.list_flatten(lists).dictionary_encode()
        distinct = strings(words.dictionary)
        numbers = pool.numbers(distinct)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = np.arange(len(new)) + len(pool.starts)
            learn([distinct[i] for i in new.tolist()])
        used = numbers[np.asarray(words.indices)]
        ends = np.concatenate([[0], np.cumsum(pool.lengths[used])])
        cuts = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))])
        return pool.take(used), np.diff(ends[cuts])

    return encode


def _with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


# -- jobs ------------------------------------------------------------------------------------------

def write_planes(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    kind: str = "bit", chunk_ids: int = CHUNK_IDS, file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS,
) -> DataFrame:
    """Encode ``docs`` and write id files in ascending order of the id column; returns the manifest.

    Manifest: (path, part, file_no, n_docs, n_ids, start), where ``start`` is the number of ids in earlier files. A null
    or empty text is just its end id. Null ids come first; equal ids are ordered by text, so repeated rows
    are kept side by side. Extra columns are ignored. An empty table gives an empty manifest.
    """
    folder = folder or shared_folder(docs.sparkSession, "id-planes")
    rows = docs.select(id_col, text_col).withColumn("_tie", F.xxhash64(text_col))
    ordered = rows.repartitionByRange(id_col, "_tie").sortWithinPartitions(id_col, "_tie", text_col).drop("_tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        fs, base = open_folder(folder)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        writer, name, number, done = None, "", 0, []

        def finish() -> None:
            writer.close()
            done.append((name, part, number, len(writer.counts), writer.n_ids))

        for batch in batches:
            for first, texts in groups(batch, text_col):
                ids, counts = _with_end(*encode(texts), end_id)
                if writer is None:
                    name = f"part-{part:06d}-{number:04d}-{attempt}.ids"
                    fs.create_dir(base, recursive=True)
                    writer = PlaneWriter(fs.open_output_stream(f"{base}/{name}"), kind, chunk_ids)
                writer.add(batch.column(0).slice(first, len(texts)).to_pylist(), counts, ids)
                if writer.n_ids >= file_ids or len(writer.counts) >= file_docs:
                    finish()
                    writer, number = None, number + 1
        if writer is not None:
            finish()
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("path", "part", "file_no", "n_docs", "n_ids"), d)) for d in done],
            schema=pa.schema([("path", pa.string()), ("part", pa.int32()), ("file_no", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
        )

    written = ordered.mapInArrow(run, "path string, part int, file_no int, n_docs long, n_ids long")
    manifest = durable(written.withColumn("path", F.concat(F.lit(f"{folder}/"), "path")), "id-manifest")
    # One row per file: an order over all of them is small.
    before = Window.orderBy("part", "file_no").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_planes(manifest: DataFrame, id_type: T.DataType, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files of ``manifest``, one file per task.

    ``ids_crc32`` is of the ids as little-endian unsigned 32-bit integers. Chunks are read one by one, so a
    long document needs no more memory than a short one.
    """
    files = max(1, manifest.count())
    schema = T.StructType([
        T.StructField(id_col, id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ])
    key_type = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, name = open_folder(path)
                with fs.open_input_file(name) as source:
                    reader = PlaneReader(source)
                    counts = np.array(reader.counts, dtype=np.int64)
                    ends, crcs, doc, crc = np.cumsum(counts), [], 0, 0
                    left = reader.counts[0] if reader.counts else 0
                    for k in range(len(reader.chunks)):
                        data, at = reader.chunk(k).astype("<u4").tobytes(), 0
                        while at < len(data):
                            piece = data[at : at + 4 * left]
                            crc, at, left = zlib.crc32(piece, crc), at + len(piece), left - len(piece) // 4
                            if not left:
                                crcs.append(crc)
                                doc, crc = doc + 1, 0
                                left = reader.counts[doc] if doc < len(reader.counts) else 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.keys, key_type), pa.array(start + ends - counts), pa.array(counts), pa.array(crcs, pa.int64())],
                        names=schema.names,
                    )

    return manifest.select("path", "start").repartition(files).mapInArrow(run, schema)
