"""Quality rules: a length-normalised log-likelihood ratio of hashed n-grams between trusted and raw text.

Words and pairs of neighbouring words are hashed into a fixed number of bins. Their counts in the whole raw corpus and in a trusted
target (documents labelled good) give two smoothed multinomials. A document's score is the mean, over its n-grams, of
the log ratio of target to raw probability. Every document is kept or rejected by one threshold, found on all labelled
documents. Plain rules on length and repetition come first.

Everything is built-in functions. One pass counts the bins of all texts, one those of texts that may be good by a bitmap of ids and
are after an exact join, one measures and scores; the threshold then comes from scores, not texts. Counts leave a task as one row per bin,
scores of labelled documents as one row per rounded score, and ratios and threshold return as constants of bounded size.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffline.llm.common import durable, fresh
from staffline.llm.text import BLANKS, blank_words, without

BINS = 1 << 14
#: Bits of the map of good ids.
FILTER_BITS = 1 << 20
SMOOTHING = 1.0
#: Decimals of the scores that are counted for the threshold.
DECIMALS = 4
SYMBOLS = "#*$%&|<>"
SLACK = 0.01
#: Repeated windows of a text that are looked up one by one; with more they are sorted.
SHORT_LIST = 24
LEAST_WORDS, MOST_REPEATED = 50, 50


# -- columns ---------------------------------------------------------------------------------------

def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: a one-element array stands for a variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _bin(h: Column, bins: int) -> Column:
    return F.pmod(h, F.lit(bins)).cast("int")


def _pair(hashes: Column, h: Column, i: Column) -> Column:
    """Hash of a word and the one before it."""
    return F.xxhash64(F.get(hashes, i - 1), h)


def _bins(hashes: Column, bins: int) -> Column:
    """Bins of single words and of neighbouring pairs, one array; the first word has no pair and a null."""
    pairs = F.transform(hashes, lambda h, i: F.when(i > 0, _bin(_pair(hashes, h, i), bins)))
    return F.concat(F.transform(hashes, lambda h: _bin(h, bins)), pairs)


def with_words(docs: DataFrame, text_col: str, words: str, hashes: str) -> DataFrame:
    """``docs`` with the words of the text and their hashes, each computed once."""
    return docs.withColumn(words, blank_words(F.col(text_col))).withColumn(hashes, _hashes(F.col(words)))


def base_columns(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, list[str], str]:
    """``docs`` with the base measures, their names, and the name of the column of word hashes."""
    words, hashes, grams, spots, n_words, chars, symbols, lines, repeats = fresh(
        docs, "words", "hashes", "grams", "spots", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = with_words(docs, text_col, words, hashes)
    h = F.col(hashes)
    out = out.withColumn(n_words, F.size(words).cast("long"))
    out = out.withColumn(chars, F.length(without(text, BLANKS)).cast("long"))
    out = out.withColumn(symbols, (F.length(text) - F.length(without(text, SYMBOLS))).cast("long"))
    full = F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0)
    twice = _once(full, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    out = out.withColumn(lines, twice.cast("long"))
    # Windows of three words by their hashes; most texts repeat none or a few, which are then looked up in a short list.
    last = F.size(h) - 3
    positions = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn(grams, F.transform(positions, lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))))
    g = F.col(grams)
    ordered = F.sort_array(g)
    twice = _once(ordered, lambda o: F.array_distinct(F.filter(o, lambda x, k: (k > 0) & (F.get(o, k - 1) == x))))
    out = out.withColumn(spots, F.when(F.size(F.array_distinct(g)) < F.size(g), twice).otherwise(F.array().cast("array<bigint>")))
    few = _once(F.col(spots), lambda d: F.filter(positions, lambda i: F.array_contains(d, F.get(g, i))))
    # Many repeated windows: sorted with their positions, equal ones are neighbours.
    paired = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = lambda a, x, k: F.coalesce(F.get(a, k)["h"] == x["h"], F.lit(False))
    equal = _once(paired, lambda a: F.filter(a, lambda x, k: same(a, x, k + 1) | F.when(k > 0, same(a, x, k - 1)).otherwise(F.lit(False))))
    many = F.sort_array(F.transform(equal, lambda x: x["i"]))
    found = F.when(F.size(spots) == 0, F.array().cast("array<int>")).when(F.size(spots) <= SHORT_LIST, few).otherwise(many)
    covered = _once(found, lambda s: F.transform(s, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - p, F.lit(3)))))
    out = out.withColumn(repeats, F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long"))
    return out.drop(words, grams, spots), [n_words, chars, symbols, lines, repeats], hashes


# -- the model -------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Model:
    """Log ratio of every bin and the threshold: ``BINS`` numbers, whatever the corpus."""

    ratios: tuple[float, ...]
    threshold: float

    def score(self, hashes: Column) -> Column:
        """Mean log ratio of the n-grams of a row; 0 without words."""
        # One constant of the plan, not an expression per bin.
        ratio = F.from_json(F.lit(json.dumps(self.ratios)), "array<double>")
        bins = len(self.ratios)
        pair = lambda h, i: F.when(i > 0, F.get(ratio, _bin(_pair(hashes, h, i), bins))).otherwise(F.lit(0.0))
        each = F.transform(hashes, lambda h, i: F.get(ratio, _bin(h, bins)) + pair(h, i))
        total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
        return F.when(F.size(hashes) > 0, total / (2 * F.size(hashes) - 1)).otherwise(F.lit(0.0))


def _known(labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """(known, good) of every id whose labels all are 1 or all are 0."""
    each = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label).alias("least"), F.max(label).alias("most"))
    return each.where((F.col("least") == F.col("most")) & F.col("least").isin(0, 1)).select(F.col(id_col).alias("known"), F.col("least").cast("long").alias("good"))


def _bitmap(ids: DataFrame) -> Callable[[Column], Column]:
    """Whether an id may be among ``ids``: one bit of ``FILTER_BITS`` per hash, whatever the number of ids."""
    at = F.pmod(F.xxhash64("known"), F.lit(FILTER_BITS))
    words = ids.select(at.alias("at")).groupBy(F.shiftright("at", 5).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 32 AS INT))")).alias("bits"))
    bits = [0] * (FILTER_BITS // 32)
    for r in words.collect():
        bits[r["w"]] = r["bits"]
    table = F.from_json(F.lit(json.dumps(bits)), "array<bigint>")

    def may_hold(ident: Column) -> Column:
        h = F.pmod(F.xxhash64(ident), F.lit(FILTER_BITS))
        word = F.get(table, F.shiftright(h, 5).cast("int"))
        return F.call_function("shiftright", word, (h % 32).cast("int")).bitwiseAND(F.lit(1)) == 1

    return may_hold


def _bin_counts(rows: DataFrame, bins: int, name: str) -> DataFrame:
    each = with_words(rows, "body", "w", "h").select(F.explode(_bins(F.col("h"), bins)).alias("bin")).where("bin IS NOT NULL")
    return durable(each.groupBy("bin").agg(F.count(F.lit(1)).alias(name)), name)


def fit_ratios(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS) -> Model:
    """Raw counts over all documents, target counts over all that are ``known`` to be good; no threshold yet.

    Texts that may be good by a bitmap of ids are shuffled to the good ids; the others stay where they are. That is the plan
    at every size.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    good = known.where("good = 1").select("known")
    likely = rows.where(F.col("id").isNotNull() & _bitmap(good)(F.col("id")))
    target = likely.join(good.hint("shuffle_hash"), F.col("id") == F.col("known"), "left_semi")
    counts = _bin_counts(rows, bins, "raw").join(_bin_counts(target, bins, "target"), "bin", "full")
    all_raw, all_target = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()
    whole = docs.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left")
    part = lambda c, n: F.log((F.coalesce(c, F.lit(0)) + SMOOTHING) / F.lit(n + SMOOTHING * bins))
    each = whole.select("bin", (part("target", all_target) - part("raw", all_raw) if all_target else F.lit(0.0)).alias("ratio"))
    return Model(tuple(r["ratio"] for r in each.orderBy("bin").collect()), float("-inf"))


def fit_threshold(scored: DataFrame, known: DataFrame) -> float:
    """The threshold from (id, n_words, score) of all documents: scores, not texts, meet the labels.

    It separates the labels best (share of good kept plus share of bad rejected); of thresholds within ``SLACK`` of
    the best it is the lowest, so that in doubt documents stay. Without labels of both kinds every score passes.
    """
    rows = scored.where(F.col("n_words") >= LEAST_WORDS).select("id", F.round("score", DECIMALS).alias("score"))
    judged = rows.join(known.hint("shuffle_hash"), F.col("id") == F.col("known"))
    return _best_threshold(judged.groupBy("score", "good").count().collect())


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", bins: int = BINS,
) -> Model:
    """Ratios and threshold; ``judge_all`` gives verdicts along with them for one reading less."""
    known = durable(_known(labels, id_col, label), "known")
    model = fit_ratios(docs, known, id_col, text_col, bins)
    words = with_words(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")), "body", "w", "h")
    # A generated row is computed once.
    once = F.explode(F.array(F.struct(F.size("h").alias("n_words"), model.score(F.col("h")).alias("score")))).alias("x")
    return replace(model, threshold=fit_threshold(words.select("id", once).select("id", "x.*"), known))


def _best_threshold(judged: list) -> float:
    """The score from which on documents are kept, from a bounded number of (score, good, count)."""
    good, bad = (sum(r["count"] for r in judged if r["good"] == g) for g in (1, 0))
    if not good or not bad:
        return float("-inf")
    gains, lost, gone, last = [], 0, 0, None
    for r in sorted(judged, key=lambda r: r["score"]):
        if last is not None and r["score"] > last:
            gains.append((gone / bad - lost / good, (last + r["score"]) / 2))
        lost, gone, last = lost + r["count"] * r["good"], gone + r["count"] * (1 - r["good"]), r["score"]
    best = max((g for g, _ in gains), default=0.0)
    return next((at for g, at in gains if g > 0 and g >= best - SLACK), float("-inf"))


# -- decisions -------------------------------------------------------------------------------------

def measure(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score), and those names."""
    out, names, hashes = base_columns(docs, text_col)
    score, measured = fresh(out, "score", "measured")
    out = out.withColumn(score, model.score(F.col(hashes)))
    # A generated row is computed once: filters on it are not pushed into the expressions it is made of.
    once = F.explode(F.array(F.struct(*names, score))).alias(measured)
    out = out.select(*docs.columns, once).select(*docs.columns, *[F.col(f"{measured}.{c}").alias(c) for c in (*names, score)])
    return out, [*names, score]


def _verdicts(measured: DataFrame, names: list[str], threshold: float) -> tuple[DataFrame, list[str]]:
    failed, kept = fresh(measured, "base_failed", "kept")
    n_words, repeats, score = F.col(names[0]), F.col(names[4]), F.col(names[5])
    out = measured.withColumn(failed, (n_words < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * n_words))
    return out.withColumn(kept, ~F.col(failed) & (F.round(score, 6) >= F.lit(threshold))), [*names, failed, kept]


def judge(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept), and those names.

    A name that ``docs`` has already gets a trailing underscore. Null and empty texts have no words and fail the
    base rules. Repeated rows are judged alike. An empty table gives an empty one.
    """
    return _verdicts(*measure(docs, model, text_col), model.threshold)


def judge_all(
    docs: DataFrame, labels: DataFrame, keep: Sequence[str], id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, list[str]]:
    """Columns ``keep`` of every document with its verdict by a model of these very documents, and the names as in ``judge``.

    Each text is measured and scored once and the outcome written down; the threshold is taken from what was
    written, and a verdict is a comparison.
    """
    known = durable(_known(labels, id_col, "quality"), "known")
    model = fit_ratios(docs, known, id_col, text_col)
    measured, names = measure(docs, model, text_col)
    measured = durable(measured.select(*dict.fromkeys([*keep, id_col]), *names), "measured")
    scored = measured.select(F.col(id_col).alias("id"), F.col(names[0]).alias("n_words"), F.col(names[5]).alias("score"))
    out, names = _verdicts(measured, names, fit_threshold(scored, known))
    return out.select(*keep, *names), names


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``; edge cases as in ``judge``."""
    judged, names = judge_all(docs, labels, docs.columns, id_col, text_col)
    return judged.where(F.col(names[-1])).select(*docs.columns)
