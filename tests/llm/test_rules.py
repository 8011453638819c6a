import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from staffline.llm import rules
from staffline.llm.common import table

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    found = rules.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(found) > 1000
    right = [(found[found.quality == q].predicted == q).mean() for q in (0, 1)]
    assert right[1] > 0.97 and right[0] > 0.85, right
    good, bad = found[found.quality == 1].score, found[found.quality == 0].score
    auc = (bad.values[:, None] < good.values[None, :]).mean()
    assert auc > 0.95, auc


def test_compiled_rules_equal_rules_by_hand(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    stats, model = rules.fitted(docs, labels, 3, 1, "quality", "doc_id", "text")
    assert 2 <= len(model.rules) <= 200 and all(1 <= len(r.bounds) <= rules.DEPTH for r in model.rules)
    rows = {r["doc_id"]: r.asDict() for r in stats.collect()}
    for r in rules.score_table(stats, model, 3, 1, "doc_id").collect():
        s = rows[r["doc_id"]]
        z = model.intercept + sum(x.weight for x in model.rules if all((s[f] > v) if above else (s[f] <= v) for f, above, v in x.bounds))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    turned = labels.withColumn("quality", F.when(rules.is_held(F.col("doc_id"), 3, 1), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string"))
    a = sorted((r["doc_id"], r["score"]) for r in rules.classify(docs, labels).collect())
    b = sorted((r["doc_id"], r["score"]) for r in rules.classify(other, turned).collect())
    assert a == b


def test_odd_rows(spark):
    long = "word " * 60_000
    rows = [(1, "good text here"), (2, None), (3, ""), (4, " \n "), (5, long), (5, long), (None, "THE!! END!!"), (7, "BAD!! BAD!!"), (8, "some more words"), (9, "LOUD!! LOUD!!")]
    docs = spark.createDataFrame([(i, t, 1.5, "x") for i, t in rows], "doc_id bigint, text string, s_n_chars double, _w string")
    labels = spark.createDataFrame([(1, 1), (8, 1), (7, 0), (9, 0), (None, 0), (3, None), (5, 0), (5, 1)], "doc_id bigint, quality int")
    out = rules.classify(docs, labels).collect()
    assert sorted((r["doc_id"] or 0) for r in out) == sorted((i or 0) for i, _ in rows)
    assert all(0 <= r["score"] <= 1 for r in out) and len({r["score"] for r in out if r["doc_id"] == 5}) == 1
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [False]
    none = rules.classify(docs, labels.where("quality > 1")).collect()
    assert {r["score"] for r in none} == {0.5}
    only = rules.classify(docs, spark.createDataFrame([(2, 1)], "doc_id bigint, quality int")).collect()
    assert len({r["score"] for r in only}) == 1
    assert rules.classify(docs.limit(0), labels).collect() == []


@pytest.mark.parametrize("text,want", [("Ab! cd\ncd cd", {"s_n_words": 4, "s_n_lines": 2, "s_bangs": 1 / 9, "s_same_as_last": 2 / 4, "s_distinct_words": 2 / 4}), (None, {"s_n_words": 0, "s_upper": 0, "s_longest_word": 0})])
def test_statistics(spark, text, want):
    stats, names = rules.statistics(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), "text", [F.col("doc_id")])
    row = stats.first()
    assert all(row[n] is not None for n in names)
    for name, value in want.items():
        assert math.isclose(row[name], value), name


def test_statistics_are_counted_without_translating_each_set(spark):
    """F9 of round 4: characters are characters beyond ASCII too, and only ASCII white space parts words and blank lines."""
    odd = ["Über\u00a0straße  Ümlaut!\r\n\x0b|x| 42%", "日本 日本\n\n \t\n日本 日本\n日本 日本", "a\u2003b a\u2003b 😀😀😀😀 .", "\n\n", "\x1c \x85 a\x1c", ""]
    stats, names = rules.statistics(spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string").coalesce(1), "text", [F.col("doc_id")])
    assert "translate(" not in stats._jdf.queryExecution().optimizedPlan().toString()
    blank = " \t\n\x0b\f\r"
    share = lambda part, whole: part / whole if whole else 0.0
    for row in stats.collect():
        text = odd[row["doc_id"]]
        words = [w for w in re.split(f"[{blank}]+", text.strip(blank)) if w]
        lines = [x for x in text.split("\n") if x.strip(blank)]
        n, w, solid = len(text), len(words), sum(c not in blank for c in text)
        of = lambda chars: sum(c in chars for c in text)  # noqa: E731, B023
        assert tuple(row)[1:] == (
            n, w, len(lines), share(solid, w), max(map(len, words), default=0), share(w, len(lines)), share(of(rules.UPPER), solid), share(of(rules.LOWER), solid),
            share(of("0123456789"), solid), share(of(rules.SYMBOLS), solid), share(of("!"), solid), share(of(rules.STOPS), w), share(of("|"), w), share(n - solid, n),
            share(len(set(words)), w), share(sum(a == b for a, b in zip(words, words[1:])), w), share(len(lines) - len(set(lines)), len(lines)),
        )
