"""Toxicity by multiple-instance learning: a document is toxic if at least one of its sentences is.

A sentence's logit is a bias and the sum of its words' weights; a word has a weight of its own and weights for its
beginnings, which stand for all forms of a stem. Sentence scores are combined by noisy-or, and the weights are
trained from document labels alone, through that combination. A leak, the same for every document, takes up labels that no
sentence explains; it has no part in scores. The same sentence scores then show where in a document the
offence lies. Labels may be wrong: the likelihood allows for a share of flipped ones, so that they bend no weight.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffline.llm.common import GROUP_BYTES, fresh

WORD = r"[^\W\d_]+"
#: Words and ends of sentences.
TOKENS = re.compile(WORD + r"|[.!?\n]")
SENTENCE = re.compile(r"[^.!?\n]+")
ENDS = frozenset(".!?\n")
#: Bounds of the fit: labelled documents of each class, words with a weight.
MAX_TOXIC, MAX_CLEAN, MAX_WORDS = 4000, 8000, 4096
FLIPPED = 0.03
#: Lengths of beginnings that count as features.
STEMS = (4, 5, 6, 7, 8)
CACHED_WORDS = 400_000
#: Standard errors between a feature's document frequencies in the two classes.
LEAST_GAP = 6.0
SCORED = "struct<score double, sentences array<struct<start int, stop int, score double>>>"


@dataclass(frozen=True)
class Model:
    """Weights of at most ``MAX_WORDS`` features, and the bias of a sentence."""

    weights: dict[str, float]
    bias: float


class WordWeights(dict):
    """Summed weights of words, filled on demand."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = sum(self.model.weights.get(f, 0.0) for f in features(word))
        return value


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


# -- scoring ---------------------------------------------------------------------------------------

def document_score(text: str, weights: WordWeights) -> float:
    """Noisy-or over the sentences of a text; 0 where it has none."""
    tokens = TOKENS.findall(text.lower())
    values = np.fromiter((np.nan if t in ENDS else weights[t] for t in tokens), dtype=np.float64, count=len(tokens))
    end = np.isnan(values)
    sentence = np.cumsum(end)
    live = ~end
    if not live.any():
        return 0.0
    z = np.bincount(sentence[live], values[live])
    words = np.bincount(sentence[live])
    total = _softplus(weights.model.bias + z[words > 0]).sum()
    return float(-np.expm1(-total))


def sentences(text: str, weights: WordWeights, least: float = 0.5) -> list[dict]:
    """Offending sentences: character positions and scores, of at least ``least``."""
    out = []
    for found in SENTENCE.finditer(text):
        words = re.findall(WORD, found.group().lower())
        if words:
            p = 1.0 / (1.0 + np.exp(-(weights.model.bias + sum(weights[w] for w in words))))
            if p >= least:
                out.append({"start": found.start(), "stop": found.end(), "score": float(p)})
    return out


def score(text: Column | str, model: Model, threshold: float = 0.5) -> Column:
    """struct(score, sentences) of a text column, in Arrow batches; sentences only where the score reaches ``threshold``.

    Null and empty texts and texts without words score 0 and have no sentences.
    """
    kind = pa.struct([
        ("score", pa.float64()),
        ("sentences", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))),
    ])

    @F.arrow_udf(SCORED)
    def run(texts: pa.Array) -> pa.Array:
        out, weights = [], WordWeights(model)
        step = max(1, len(texts) * GROUP_BYTES // max(1, texts.nbytes))
        for i in range(0, len(texts), step):
            for text in texts.slice(i, step).to_pylist():
                p = document_score(text or "", weights)
                out.append({"score": p, "sentences": sentences(text, weights) if p >= threshold else []})
        return pa.array(out, kind)

    return run(text)


# -- training --------------------------------------------------------------------------------------

def labelled_sample(labels: DataFrame, label: str, id_col: str, max_toxic: int, max_clean: int) -> DataFrame:
    """(id, label) of at most so many documents of each class, by the hash of their ids; ids with both labels are left out."""
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(id_col)
        .agg(F.min(label).alias("label"), F.max(label).alias("_most")).where("label = _most AND label IN (0, 1)").select(id_col, "label")
    )
    take = lambda value, n: known.where(F.col("label") == value).orderBy(F.xxhash64(id_col), id_col).limit(n)
    return take(1, max_toxic).unionByName(take(0, max_clean))


def _stems(words: Column, k: int) -> Column:
    longer = F.filter(words, lambda w: F.length(w) > k)
    return F.transform(longer, lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_words: int = MAX_WORDS, rounds: int = 250, least_docs: int = 5,
) -> Model:
    """Train on a bounded sample of labelled documents (``max_toxic`` and ``max_clean``).

    Equal texts count once, and not at all if their labels differ. Spark finds the words and beginnings of words whose document frequencies differ most, and by at least
    ``LEAST_GAP`` standard errors, between the classes (at most ``max_words``) and turns the sample into
    sentences of feature numbers; these bounded arrays are fitted on the driver. Without documents of both classes the model has no
    weights and scores every document 0.
    """
    sample = labelled_sample(labels.select(id_col, label), label, id_col, max_toxic, max_clean)
    texts = docs.select(id_col, text_col).where(F.col(text_col).isNotNull()).join(F.broadcast(sample), id_col).groupBy(text_col).agg(F.min("label").alias("label"), F.max("label").alias("_most"))
    texts = texts.where("label = _most").drop("_most").persist()
    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model({}, -50.0)
    lowered = F.lower(text_col)
    words = F.array_distinct(F.regexp_extract_all(lowered, F.lit(r"(\p{L}+)"), F.lit(1)))
    stems = [_stems(words, k) for k in STEMS]
    found = texts.select("label", F.explode(F.array_distinct(F.concat(words, *stems))).alias("word"))
    counts = found.groupBy("word").agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_docs)
    share = F.col("n") / (sizes[0] + sizes[1])
    gap = F.abs(F.col("toxic") / sizes[1] - (F.col("n") - F.col("toxic")) / sizes[0]) / F.sqrt((share * (1 - share) + 1e-9) * (1 / sizes[0] + 1 / sizes[1]))
    counts = counts.withColumn("gap", gap).where(F.col("gap") >= LEAST_GAP)
    chosen = counts.orderBy(F.desc("gap"), "word").limit(max_words).select("word", "toxic", "n").collect()
    vocabulary = [r["word"] for r in chosen]
    number = {w: i for i, w in enumerate(vocabulary)}
    # Training starts from each feature's log ratio of document frequencies.
    start = np.array([np.log((r["toxic"] + 0.5) / sizes[1]) - np.log((r["n"] - r["toxic"] + 0.5) / sizes[0]) for r in chosen])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y, key in zip(*(batch.column(i).to_pylist() for i in range(3))):
                bags = [[number[f] for w in re.findall(WORD, s) for f in features(w) if f in number] for s in SENTENCE.findall(text.lower()) if re.search(WORD, s)]
                full = [b for b in bags if b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([y], pa.int32()), pa.array([len(bags)], pa.int32()), pa.array([[x for b in full for x in b]], pa.list_(pa.int32())), pa.array([[len(b) for b in full]], pa.list_(pa.int32())), pa.array([key], pa.int64())],
                    names=["label", "n_sentences", "words", "lengths", "key"],
                )

    keyed = texts.select(text_col, F.col("label").cast("int"), F.xxhash64(text_col))
    bags = keyed.mapInArrow(run, "label int, n_sentences int, words array<int>, lengths array<int>, key long").toArrow()
    texts.unpersist()
    # Sums follow the order of rows, which must not follow that of partitions.
    return _train(bags.sort_by("key"), vocabulary, start, rounds)


def _train(bags: pa.Table, vocabulary: list[str], start: np.ndarray, rounds: int, l1: float = 1e-4, rate: float = 0.1) -> Model:
    """Adam on the noisy-or likelihood, with soft thresholding of weights."""
    y = np.asarray(bags["label"], dtype=np.float64)
    per_doc = np.asarray(bags["n_sentences"], dtype=np.int64)
    words = np.asarray(bags["words"].combine_chunks().flatten(), dtype=np.int64)
    lengths = np.asarray(bags["lengths"].combine_chunks().flatten(), dtype=np.int64)
    full = np.asarray(pc.list_value_length(bags["lengths"].combine_chunks()), dtype=np.int64)
    sentence_of = np.repeat(np.arange(len(lengths)), lengths)
    doc_of = np.repeat(np.arange(len(y)), full)
    bare = per_doc - full
    # Weights of features, the bias of a sentence, the logit of the leak.
    theta = np.append(np.clip(start, -2.0, 6.0), [-np.log(max(per_doc.mean(), 1.0)) - 3.0, -3.0])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        bias, leak = theta[-2], theta[-1]
        z = bias + np.bincount(sentence_of, theta[words], minlength=len(lengths))
        quiet = -np.bincount(doc_of, _softplus(z), minlength=len(y)) - bare * _softplus(bias) - _softplus(leak)
        p = -np.expm1(quiet)
        seen = FLIPPED + (1 - 2 * FLIPPED) * p
        slope = (1 - 2 * FLIPPED) * np.exp(quiet) * ((1 - y) / (1 - seen) - y / seen) / len(y)
        per_sentence = slope[doc_of] / (1 + np.exp(-z))
        grad = np.append(np.bincount(words, per_sentence[sentence_of], minlength=len(vocabulary)), [0.0, 0.0])
        grad[-2] = per_sentence.sum() + (slope * bare).sum() / (1 + np.exp(-bias))
        grad[-1] = slope.sum() / (1 + np.exp(-leak))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        pace = rate / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        theta -= pace * (m / (1 - 0.9**step))
        theta[:-2] = np.sign(theta[:-2]) * np.maximum(np.abs(theta[:-2]) - pace[:-2] * l1, 0)
    return Model({w: float(x) for w, x in zip(vocabulary, theta[:-2]) if x}, float(theta[-2]))


# -- tables ----------------------------------------------------------------------------------------

def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt: a fifth, by the checksum of the id; null ids too."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **bounds: int) -> DataFrame:
    """(id, held_out, score, predicted, sentences) of every row of ``docs``.

    Labels of held-out rows are not used. Null and empty texts score 0. Null ids are held out. Repeated rows are scored
    alike; in the fit equal texts count once. Extra columns are ignored. Without labels of both kinds all scores are 0.
    """
    model = fit(docs, labels.where(~held_out(id_col)), id_col=id_col, text_col=text_col, **bounds)
    found = docs.select(id_col, held_out(id_col).alias("held_out"), score(F.col(text_col), model, threshold).alias("_found"))
    return found.select(
        id_col, "held_out", F.col("_found.score").alias("score"),
        (F.col("_found.score") >= threshold).cast("int").alias("predicted"), F.col("_found.sentences").alias("sentences"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **bounds: int) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with the columns of ``docs``; edge cases as in ``toxicity``."""
    model = fit(docs, labels.where(~held_out(id_col)), id_col=id_col, text_col=text_col, **bounds)
    found, = fresh(docs, "toxic_score")
    scored = docs.withColumn(found, score(F.col(text_col), model, threshold=2.0))
    return scored.where(F.col(f"{found}.score") < threshold).select(*docs.columns)
