"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Statistics of every text are counted in an Arrow function and written down once, without the text. Shallow trees are grown on labelled rows; every path
from a root to a node is a rule, a conjunction of bounds on statistics. A lasso-penalised logistic regression weighs the rules
and leaves few of them; these are compiled back into one column expression, so scoring runs as plain Spark code without a
model object, and a model can be read as a list of sentences.

Trees and regression come from ``pyspark.ml``. They see at most ``MAX_ROWS`` labelled rows of each label (those with the smallest hash of their
id), weighted by how many there are, so the cost of a fit doesn't grow; statistics and scores cover all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice
from operator import eq

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffline.llm.common import LOWER, UPPER, durable, fresh
from staffline.llm.text import BLANKS

#: Bounds of a fit: labelled rows of each label, trees, their depth, and the lasso's strength.
MAX_ROWS, TREES, DEPTH, LASSO = 12_000, 24, 3, 0.001
SEED = 11
#: A rule must hold on this share of the rows at least, and fail on as many.
LEAST_SUPPORT = 0.002
SYMBOLS = "#*$%&|<>=~^\\_{}[]@+"
STOPS = ".,;:?"


# -- statistics ------------------------------------------------------------------------------------

#: The statistics of a text in their order, see ``_of_text``.
STATISTICS = (
    "n_chars", "n_words", "n_lines", "word_chars", "longest_word", "line_words", "upper", "lower", "digits", "symbols", "bangs", "stops", "bars",
    "blanks", "distinct_words", "same_as_last", "repeated_lines",
)
#: Bytes of UTF-8 that begin no character.
_INNER = bytes(range(0x80, 0xC0))
_SETS = [chars.encode() for chars in (UPPER, LOWER, "0123456789", SYMBOLS, "!", STOPS, "|", BLANKS)]


def _share(part: float, whole: float) -> float:
    return part / whole if whole > 0 else 0.0


def _of_text(text: bytes) -> tuple[float, ...]:
    """Statistics of one text in UTF-8: the sets are ASCII, so their characters are bytes; words lie between ASCII white space."""
    chars = text if text.isascii() else text.translate(None, _INNER)  # a byte per character
    n = len(chars)
    upper, lower, digits, symbols, bangs, stops, bars, blanks = (n - len(chars.translate(None, s)) for s in _SETS)
    words, lines = text.split(), [line for line in text.split(b"\n") if line.strip()]
    w, solid = len(words), n - blanks
    return (
        n, w, len(lines), _share(solid, w), max(map(len, chars.split()), default=0), _share(w, len(lines)),
        _share(upper, solid), _share(lower, solid), _share(digits, solid), _share(symbols, solid), _share(bangs, solid),
        _share(stops, w), _share(bars, w), _share(blanks, n), _share(len(set(words)), w),
        _share(sum(map(eq, words, islice(words, 1, None))), w), _share(len(lines) - len(set(lines)), len(lines)),
    )


def _of_texts(texts: pa.Array) -> pa.Array:
    columns = zip(*[_of_text(text.as_py()) for text in texts])
    return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns] or [pa.array([], pa.float64())] * len(STATISTICS), names=list(STATISTICS))


def statistics(docs: DataFrame, text_col: str, keep: list[Column]) -> tuple[DataFrame, list[str]]:
    """``keep`` and the statistics of each text, as doubles; null is the empty text, all of whose statistics are 0.

    They are counted in an Arrow function: the built-in ``translate`` looks up every character of a text in a map, once per set of characters.
    """
    count = F.arrow_udf(_of_texts, f"struct<{', '.join(f'{k}:double' for k in STATISTICS)}>")
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_t"))
    kept = [c for c in rows.columns if c != "_t"]
    names = fresh(rows, *[f"s_{k}" for k in STATISTICS])
    rows = rows.select(*kept, count("_t").alias("_s"))
    return rows.select(*kept, *[F.col(f"_s.{k}").alias(a) for k, a in zip(STATISTICS, names)]), names


# -- the model -------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds (statistic, above, bound): ``statistic > bound`` or ``statistic <= bound``."""

    bounds: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def holds(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(s) > x if above else F.col(s) <= x for s, above, x in self.bounds])

    def __str__(self) -> str:
        return " and ".join(f"{s} {'>' if above else '<='} {x:g}" for s, above, x in self.bounds) + f": {self.weight:+.3f}"


@dataclass(frozen=True)
class Ensemble:
    """Rules with weights and an intercept."""

    rules: tuple[Rule, ...]
    intercept: float

    def score(self) -> Column:
        """Chance of label 1 as one expression over the statistics, which are never null or NaN."""
        votes = [F.when(r.holds(), F.lit(r.weight)).otherwise(F.lit(0.0)) for r in self.rules]
        total = reduce(lambda a, b: a + b, votes, F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _paths(node, names: list[str], bounds: dict) -> Iterator[Rule]:
    """The rule of every node below the root; of several bounds on one side of a statistic the tightest stays."""
    if bounds:
        yield Rule(tuple((s, above, x) for (s, above), x in sorted(bounds.items())))
    if node.subtreeDepth() > 0:
        split = node.split()
        name, x = names[split.featureIndex()], float(split.threshold())
        for child, above in ((node.leftChild(), False), (node.rightChild(), True)):
            old = bounds.get((name, above), x)
            yield from _paths(child, names, bounds | {(name, above): max(old, x) if above else min(old, x)})


def _known(labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """(known, y) of every id whose labels are all 1 or all 0."""
    each = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("known")).agg(F.min(label).alias("y"), F.max(label).alias("most"))
    return each.where((F.col("y") == F.col("most")) & F.col("y").isin(0, 1)).select("known", F.col("y").cast("double").alias("y"))


def fit(stats: DataFrame, names: list[str], labels: DataFrame, usable: Column, id_col: str = "doc_id", label: str = "quality") -> Ensemble:
    """An ensemble from the labelled rows of ``stats`` (id, *names) with ``usable`` ids.

    Ids with labels that contradict each other teach nothing. Where one label or both are missing the score is the same for
    all rows: the share of label 1, smoothed by one row of each.
    """
    known = durable(stats.join(_known(labels, id_col, label).where(usable), F.col(id_col) == F.col("known")).select(F.col(id_col).alias("id"), "y", *names), "labelled")
    total = {int(r["y"]): r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        bad, good = total.get(0, 0) + 1, total.get(1, 0) + 1
        return Ensemble((), math.log(good / bad))
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), *names).limit(MAX_ROWS).withColumn("weight", F.lit(max(1.0, total[y] / MAX_ROWS))) for y in (0, 1)]
    sample = durable(picked[0].unionByName(picked[1]), "sample")
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(sample)
    forest = RandomForestClassifier(labelCol="y", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, maxBins=64, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=SEED).fit(rows)
    rules = sorted({r for tree in forest.trees for r in _paths(tree._java_obj.rootNode(), names, {})}, key=lambda r: r.bounds)
    flags = [r.holds().cast("double").alias(f"r{i}") for i, r in enumerate(rules)]
    marked = durable(sample.select("y", "weight", *flags), "marked")
    support = marked.agg(*[F.avg(f"r{i}") for i in range(len(rules))]).first() if rules else ()
    used = [i for i, share in enumerate(support) if LEAST_SUPPORT <= share <= 1 - LEAST_SUPPORT]
    if not used:
        return Ensemble((), math.log((total[1] + 1) / (total[0] + 1)))
    table = VectorAssembler(inputCols=[f"r{i}" for i in used], outputCol="features").transform(marked)
    lasso = LogisticRegression(labelCol="y", weightCol="weight", elasticNetParam=1.0, regParam=LASSO, maxIter=60, tol=1e-5).fit(table)
    kept = tuple(Rule(rules[i].bounds, float(w)) for i, w in zip(used, lasso.coefficients.toArray()) if w)
    return Ensemble(kept, float(lasso.intercept))


# -- the operator ----------------------------------------------------------------------------------

def classify(
    docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, label: str = "quality", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Rows whose crc32 of the id, as text, is ``held`` modulo ``folds`` are held out: their labels are never read. Null ids have no labels and are
    not held out. Null and empty texts are scored like any other, by statistics of 0; repeated rows are scored each, alike.
    Other columns of ``docs``, whatever their names, play no part. An empty table gives an empty one.
    """
    return score_table(*fitted(docs, labels, folds, held, label, id_col, text_col), folds, held, id_col)


def is_held(ident: Column, folds: int, held: int) -> Column:
    return F.coalesce(F.crc32(ident.cast("string")) % folds == held, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, folds: int, held: int, label: str, id_col: str, text_col: str) -> tuple[DataFrame, Ensemble]:
    """The statistics of all rows, written down, and the ensemble learned from rows that are not held out."""
    stats, names = statistics(docs, text_col, [F.col(id_col)])
    stats = durable(stats, "statistics")
    return stats, fit(stats, names, labels, ~is_held(F.col("known"), folds, held), id_col, label)


def score_table(stats: DataFrame, model: Ensemble, folds: int, held: int, id_col: str) -> DataFrame:
    out = stats.select(id_col, is_held(F.col(id_col), folds, held).alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
