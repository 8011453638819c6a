import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from staffline.llm import ranked

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_search(docs, items, k):
    """Every document scored for every item."""
    tf = [(d, Counter(words(t))) for d, t in docs if words(t)]
    n_docs, n_words = len(tf), sum(c.total() for _, c in tf)
    df = Counter(w for _, c in tf for w in c)
    out = []
    for item, text in set(items):
        found = []
        for d, c in tf:
            m = 75 + 25 * c.total() * n_docs // n_words
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in words(text) if w in c
            )
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def searched(spark, docs, items, k):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, term string, uid int").repartition(3)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, rank int")
    return sorted((tuple(r) for r in ranked.search(d, q, k).collect()), key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.choice([1, 5, 40, 200]))) for i in range(n)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)]  # ties
    docs += [(7, docs[3][1]), (None, docs[3][1]), (None, "w1é W2é"), (2000, ""), (2001, None), (2002, "!? "), (2003, "w9é," * 5000), docs[5]]
    items = [(i, text(rng.choice([1, 3, 12]))) for i in range(12)]
    items += [(50, "unheard of"), (51, ""), (52, None), (None, "w3é w3é w50é"), items[0], (items[0][0], "w7é"), (53, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("seed,k,share", [(0, 5, 1 / 64), (1, 20, 1 / 1000), (2, 1, 1.0)])
def test_equals_scoring_every_document(spark, seed, k, share, monkeypatch):
    monkeypatch.setattr(ranked, "FIRST_SHARE", share)
    docs, items = corpus(seed)
    assert searched(spark, docs, items, k) == plain_search(docs, items, k)


def test_blocks_of_queries_and_slices_change_nothing(spark, monkeypatch):
    docs, items = corpus(3, 60)
    want = plain_search(docs, items, 6)
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", 6)
    monkeypatch.setattr(ranked, "MEETINGS", 7)
    monkeypatch.setattr(ranked, "PIECE", 16)
    assert searched(spark, docs, items, 6) == want


def test_empty_tables(spark):
    docs, items = corpus(4, 5)
    assert searched(spark, [], items, 3) == [] == searched(spark, docs, [], 3)
    assert searched(spark, [(1, None), (2, " ")], items, 3) == []


def test_words_are_those_of_the_pattern():
    text = "".join(map(chr, range(300))) * 3 + "İSTANBUL straße ét x"
    assert {w.decode(): n for w, n in ranked.count_words(text)[1].items()} == Counter(words(text))


def test_levels_cover_all_impacts_and_grow():
    rng = np.random.default_rng(0)
    impacts = (rng.lognormal(18, 2, 50_000)).astype(np.int64) + 1
    at, n = np.unique(ranked._cell(impacts), return_counts=True)
    ends = ranked.level_ends(dict(zip(at.tolist(), n.tolist())))
    assert ends == sorted(ends, reverse=True) and ends[-1] == 1 and 3 <= len(ends) <= 6
    assert ranked.level_ends({}) == [1]


def test_late_levels_are_read_for_candidates_only(spark, monkeypatch):
    """With one clear winner per query the second half of the lists brings no new pair of item and document."""
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices(["the", "of", "and"], k=60))) for i in range(300)]
    docs += [(1000 + i, f"rare{i} scarce{i} the of") for i in range(10)]
    items = [(i, f"rare{i} scarce{i} the") for i in range(10)]
    seen, durable = [], ranked.durable

    def spy(df, name, *rest):
        out = durable(df, name, *rest)
        if name == "interval":
            seen.append(out.count())
        return out

    monkeypatch.setattr(ranked, "durable", spy)
    assert searched(spark, docs, items, 1) == plain_search(docs, items, 1)
    assert seen and max(seen[1:] or [0]) <= 300
