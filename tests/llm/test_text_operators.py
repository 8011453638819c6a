"""Token counts, byte-level BPE and id planes against the tokenizer libraries."""

import base64
import hashlib
import inspect
import json
import os
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from corpus_helpers import empty, odd_documents, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from staffline.llm import bpe, planes, tokencount

RANKS, MODEL, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
ODD = st.text(alphabet=st.one_of(st.sampled_from("ab A'.\n\t ▁　é1<|>"), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.fixture(scope="module")
def reference():
    import sentencepiece
    import tiktoken
    import tokenizers

    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return {
        "bpe": tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}),
        "pieces": sentencepiece.SentencePieceProcessor(model_file=MODEL),
        "words": tokenizers.Tokenizer.from_file(WORDS),
    }


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(ODD, min_size=1, max_size=4))
def test_encoders_equal_the_libraries_on_any_text(reference, texts):
    texts = [*texts, "<|endoftext|> a<|startoftext|>, <s> </s>", "aİ. ǅİ.. İ, İs 한국, ﬁx. Σ'bİ.. ⑳ᅣଢ଼.,"]
    ids, counts = bpe.bpe(RANKS, P.PATTERN).encode(texts)
    want = [reference["bpe"].encode_ordinary(t) for t in texts]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
    assert bpe.bpe(RANKS, P.PATTERN).decode(ids, counts) == [t.encode() for t in texts]
    assert tokencount.counter(MODEL)(texts).tolist() == [len(x) for x in reference["pieces"].encode(texts)]
    ids, counts = planes.word_encoder(WORDS)(texts)
    want = [reference["words"].encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


@pytest.mark.parametrize("text", ["ab" * 3000, " " * 3000, "aab" * 2000 + "é" * 900])
def test_long_pieces_follow_the_same_rule(reference, text):
    ids, _ = bpe.bpe(RANKS, P.PATTERN).encode([text])
    assert ids.tolist() == reference["bpe"].encode_ordinary(text)


def test_workers_keep_a_bounded_number_of_characters(reference, monkeypatch):
    for module in (bpe, planes, tokencount):
        monkeypatch.setattr(module, "CACHED_CHARS", 20_000)
    coder, encode, count = bpe.ByteBpe(RANKS, P.PATTERN), planes.word_encoder.__wrapped__(WORDS), tokencount.counter.__wrapped__(MODEL)
    for i in range(30):
        texts = [f"{i}é" * 1500, "a short one", f"b{i} " * 3]
        ids, _ = coder.encode(texts)
        assert ids.tolist() == sum((reference["bpe"].encode_ordinary(t) for t in texts), [])
        assert sum(map(len, coder.first)) + sum(map(len, coder.known)) <= 20_000 + sum(map(len, texts)) + 3 and len(coder.pool) < 60_000
        assert encode(texts)[0].tolist() == sum((reference["words"].encode(t, add_special_tokens=False).ids for t in texts), [])
        assert count(texts).tolist() == [len(x) for x in reference["pieces"].encode(texts)]
        known = inspect.getclosurevars(count).nonlocals["known"]
        pools = inspect.getclosurevars(encode).nonlocals["pools"]
        for names in (known, pools["words"].number, pools["stems"].number):
            assert sum(map(len, names)) <= 20_000 + sum(map(len, texts)), i


def test_words_parted_by_line_ends_are_kept_one_by_one(reference):
    words = [f"{a}{b}{c}" for a in "abcÉ" for b in "eio" for c in ("rn", "S", "st.", "é,", "1", "<|", "İ.")]
    texts = ["\n".join(f"{a}\n\n{b} {a}" for b in words) for a in words]
    encode = planes.word_encoder.__wrapped__(WORDS)
    for _ in range(2):
        ids, counts = encode(texts)
        want = [reference["words"].encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
    pools = inspect.getclosurevars(encode).nonlocals["pools"]
    assert set(pools["words"].number) == {"", *words}


def test_small_letters_alone_skip_the_normalizer(reference, monkeypatch):
    import tokenizers

    class Watched:
        def __new__(cls, model):
            return type(reference["words"])(model)

        @staticmethod
        def from_file(path):
            return object.__new__(Watched)

        def __getattr__(self, name):
            return getattr(reference["words"], name)

        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return reference["words"].encode_batch_fast(texts, **options)

    seen = []
    monkeypatch.setattr(tokenizers, "Tokenizer", Watched)
    text = "Plain words, and PLAIN ones. " * 3 + "été x1"
    assert planes.word_encoder.__wrapped__(WORDS)([text])[0].tolist() == reference["words"].encode(text, add_special_tokens=False).ids
    assert sorted(seen) == [",", ".", "x1", "été"]


def test_a_normalizer_that_changes_small_letters_is_not_skipped(tmp_path):
    import tokenizers

    with open(WORDS) as file:
        other = json.load(file)
    other["normalizer"]["normalizers"].append({"type": "Replace", "pattern": {"String": "q"}, "content": "k"})
    path = os.path.join(tmp_path, "other.json")
    with open(path, "w") as file:
        json.dump(other, file)
    text = "quick Quiet queens, quite"
    assert planes.word_encoder.__wrapped__(path)([text])[0].tolist() == tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_id_files_end_after_so_many_documents(spark):
    docs = spark.range(2500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a word").alias("text")).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        manifest = planes.write_planes(docs, WORDS, 1, file_docs=300)
        assert manifest.agg(F.sum("n_docs")).first()[0] == 2500 and manifest.agg(F.max("n_docs")).first()[0] <= 300 + 100
        got = planes.read_planes(manifest, docs.schema["doc_id"].dataType).orderBy("start").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.doc_id for r in got] == list(range(2500)) and [r.n_tokens for r in got] == [3 if i % 3 == 0 else 1 for i in range(2500)]


def test_the_pair_table_finds_what_was_put_and_nothing_else():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 300, (4000, 2)), axis=0)
    table = bpe.PairTable((pairs[:, 0] << 32) | pairs[:, 1], np.arange(len(pairs)))
    assert table.get(pairs[:, 0], pairs[:, 1]).tolist() == list(range(len(pairs)))
    known = set(map(tuple, pairs.tolist()))
    other = np.array([(a, b) for a in range(-1, 300, 7) for b in range(-1, 300, 5) if (a, b) not in known])
    assert (table.get(other[:, 0], other[:, 1]) == bpe.NONE).all()


def test_token_counts_of_odd_documents(spark, reference):
    docs = odd_documents(spark)
    got = rows(tokencount.token_counts(docs, MODEL), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = []
    for r in docs.select("doc_id", "text").collect():
        n = len(reference["pieces"].encode(r.text or ""))
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 4096))
    assert got == sorted(want, key=repr)
    assert tokencount.token_counts(empty(docs), MODEL).count() == 0


def test_round_trip_of_odd_documents(spark, reference):
    docs = odd_documents(spark)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = reference["bpe"].encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert rows(bpe.round_trip(docs, RANKS, P.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe.round_trip(empty(docs), RANKS, P.PATTERN).count() == 0
    encoded = bpe.encode_documents(docs, RANKS, P.PATTERN)
    back = rows(bpe.decode_documents(encoded, RANKS, P.PATTERN), "doc_id", "text")
    assert back == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_are_a_transposition(kind):
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1), (7, 2), (1000, 49408), (4096, 1 << 32)):
        ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
        assert (planes.from_planes(planes.to_planes(ids, kind), n, kind) == ids).all()


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_id_files_of_odd_documents(spark, reference, kind):
    docs = odd_documents(spark)
    manifest = planes.write_planes(docs, WORDS, 1, kind=kind, chunk_ids=1000, file_ids=20_000)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in planes.read_planes(manifest, docs.schema["doc_id"].dataType).collect())
    ordered = [r[1] for r in got]
    assert ordered == sorted(ordered, key=lambda x: (x is not None, x or 0))
    assert [r[0] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()
    want = []
    for r in docs.collect():
        ids = reference["words"].encode(r.text or "", add_special_tokens=False).ids + [1]
        want.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert sorted((r[1:] for r in got), key=repr) == sorted(want, key=repr)
    assert planes.read_planes(planes.write_planes(empty(docs), WORDS, 1), docs.schema["doc_id"].dataType).count() == 0


def test_a_file_that_is_no_id_file_is_refused(tmp_path):
    from pyarrow import fs

    path = os.path.join(tmp_path, "x")
    with open(path, "wb") as out:
        out.write(b"y" * 64)
    with pytest.raises(ValueError), fs.LocalFileSystem().open_input_file(path) as source:
        planes.PlaneReader(source)
