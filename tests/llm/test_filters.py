"""Quality rules, URL reputation, toxicity and decontamination."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from corpus_helpers import empty, odd_documents, rows
from pyspark.sql import functions as F

from staffline.llm import decontam, quality, toxicity, urlrep

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def labels(spark, values):
    return spark.createDataFrame(values, "doc_id BIGINT, quality INT, toxic INT")


# -- quality ---------------------------------------------------------------------------------------

def plain_measures(text):
    words = WORD.findall(text or "")
    grams, covered = Counter(zip(words, words[1:], words[2:])), set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(covered)


REPEATS = [(20, "a b c a b c a b c d"), (21, "x y\nx y\n \nx y"), (22, " ".join(f"{i} {i} z" for i in range(60)) * 2), (23, "a a a a a"), (24, "#$ %&|<> **")]


def test_base_measures_of_odd_documents(spark):
    docs = odd_documents(spark, REPEATS)
    model = quality.Model((0.0,) * 8, float("-inf"))
    judged, names = quality.judge(docs, model)
    assert names[5] == "score_" and names[7] == "kept_" and judged.columns[: len(docs.columns)] == docs.columns
    for r in judged.select("text", *names).collect():
        want = plain_measures(r.text)
        assert tuple(r)[1:6] == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and r.kept_ == (not failed)
    assert judged.where(F.col(names[7])).count() == judged.select(names[7]).collect().count((True,))
    assert quality.judge(empty(docs), model)[0].count() == 0


def test_score_is_the_mean_log_ratio_and_the_threshold_separates(spark):
    import xxhash

    good = [(i, " ".join(f"good{(i * 7 + k) % 58}" for k in range(60))) for i in range(30)]
    bad = [(100 + i, " ".join(f"bad{(i * 3 + k) % 58}" for k in range(60))) for i in range(30)]
    docs = spark.createDataFrame([*good, *bad, (999, None)], "doc_id BIGINT, text STRING")
    marks = labels(spark, [(i, 1, 0) for i, _ in good[:20]] + [(i, 0, 0) for i, _ in bad[:20]] + [(None, 1, 0), (good[0][0], 1, 0)])
    model = quality.fit(docs, marks, bins=256)
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h

    def bins(text):
        hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in text.split()]
        out = [signed(h) % 256 for h in hashes]
        for a, b in zip(hashes, hashes[1:]):
            out.append(signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))) % 256)
        return out

    raw, target = Counter(b for _, t in good + bad for b in bins(t)), Counter(b for _, t in good[:20] for b in bins(t))
    part = lambda c, b: math.log((c[b] + 1) / (sum(c.values()) + 256))
    ratios = [part(target, b) - part(raw, b) for b in range(256)]
    assert model.ratios == pytest.approx(ratios)
    judged, _ = quality.judge(docs, model)
    for r in judged.where("text IS NOT NULL").collect():
        found = bins(r.text)
        assert r.score == pytest.approx(sum(ratios[b] for b in found) / len(found))
        assert r.kept == (r.doc_id < 100)
    assert quality.drop_rejected(docs, marks).columns == docs.columns


@pytest.mark.parametrize("limit", ["-1", "100000000"])
def test_model_and_verdicts_do_not_depend_on_broadcasts(spark, limit):
    """One plan at every size: joins with labels give the same numbers whatever Spark would broadcast."""
    docs = odd_documents(spark, [(100 + i, " ".join(f"{'good' if i % 3 else 'bad'}{(i * k) % 71}" for k in range(60))) for i in range(40)])
    marks = labels(spark, [(100 + i, int(i % 3 > 0), 0) for i in range(0, 40, 2)] + [(1, 0, 0), (1, 1, 0), (None, 1, 0)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        model = quality.fit(docs, marks)
        want, names = quality.judge(docs, model)
        got, same = quality.judge_all(docs, marks, ["doc_id"])
        assert rows(got, "doc_id", *same) == rows(want, "doc_id", *names)
        assert rows(quality.drop_rejected(docs, marks), "doc_id", "text") == rows(want.where(names[-1]), "doc_id", "text")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert round(sum(model.ratios), 6) == round(sum(_plain_ratios(docs, {100 + i for i in range(0, 40, 2) if i % 3})), 6)


def _plain_ratios(docs, good):
    import xxhash

    raw, target = Counter(), Counter()
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    for r in docs.collect():
        hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(r.text or "")]
        pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(hashes, hashes[1:])]
        found = Counter(signed(h) % quality.BINS for h in hashes + pairs)
        raw += found
        target += found if r.doc_id in good else Counter()
    part = lambda c, b: math.log((c[b] + 1) / (c.total() + quality.BINS))
    return [part(target, b) - part(raw, b) for b in range(quality.BINS)]
    assert quality.fit(docs, empty(marks)).threshold == float("-inf")


def test_all_labelled_documents_are_counted(spark):
    docs = spark.range(20_500).selectExpr("id AS doc_id", "concat('w', id % 97, ' v', id % 89) AS text")
    marks = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    # The target is the whole corpus, so no bin may differ from the raw counts.
    assert set(quality.fit(docs, marks, bins=256).ratios) == {0.0}


def test_the_threshold_rests_on_all_labelled_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "_best_threshold", lambda judged: seen.extend(judged) or 0.0)
    docs = spark.range(10_400).selectExpr("id AS doc_id", "concat(repeat(concat('w', id % 7, ' '), 49), 'v') AS text")
    marks = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality", "0 AS toxic")
    quality.fit(docs, marks, bins=256)
    assert [sum(r["count"] for r in seen if r["good"] == g) for g in (0, 1)] == [5200, 5200] and len(seen) <= 14


# -- urls ------------------------------------------------------------------------------------------

URLS = [
    (1, "http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x"), (2, "https://example.com", "example.com", ""), (3, None, "", ""),
    (4, "no scheme/x", "", ""), (5, "x://b.org?q", "b.org", ""), (6, "http://h/p://q#f", "h", "/p://q"), (7, "", "", ""), (None, "http://É.org/fr/", "É.org", "/fr/"),
]
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def test_hosts_paths_and_the_longest_rule(spark):
    pages = spark.createDataFrame([(i, u, 1, 2.0) for i, u, _, _ in URLS], "page_id BIGINT, url STRING, bad INT, rate DOUBLE")
    got = {r.page_id: r for r in urlrep.judge(pages, labels(spark, []), RULES).collect()}
    for i, _, host, path in URLS:
        assert (got[i].host, got[i].path) == (host, path)
    assert (got[1].rule, got[1].verdict) == ("example.net/en/", "allow") and (got[None].rule, got[None].verdict) == ("org/fr/", "allow")
    assert got[2].rule is None and got[2].verdict == "allow"
    assert urlrep.judge(empty(pages), labels(spark, []), RULES).count() == 0


def test_evidence_moves_a_host_and_priors_hold_small_ones_back(spark):
    pages, marks = [], []
    for host, n, bad in (("bad.x.com", 200, 190), ("good.x.com", 200, 2), ("tiny.y.com", 1, 1), ("a.z.co.uk", 50, 49), ("b.z.co.uk", 50, 50)):
        for k in range(n):
            i = len(pages)
            pages.append((i, f"http://{host}/{k}"))
            marks.append((i, int(k >= bad), 0))
    pages.append((9999, "http://bad.x.com/unlabelled"))
    found = urlrep.judge(spark.createDataFrame(pages, "page_id BIGINT, url STRING"), labels(spark, marks), [])
    verdicts = {(r.host, r.verdict) for r in found.collect()}
    assert verdicts == {("bad.x.com", "block"), ("good.x.com", "allow"), ("tiny.y.com", "allow"), ("a.z.co.uk", "block"), ("b.z.co.uk", "block")}
    domains = spark.createDataFrame([("a.b.co.uk",), ("b.com",), ("",), ("h",), ("co.uk",)], "h STRING").select(*urlrep.levels(F.col("h")))
    assert [tuple(r) for r in domains.collect()] == [("b.co.uk", "co.uk"), ("b.com", "com"), ("", ""), ("h", "h"), ("co.uk", "uk")]


# -- toxicity --------------------------------------------------------------------------------------

def toxic_corpus(spark, n=300):
    docs = []
    for i in range(n):
        said = [f"calm{(i * 5 + k) % 30} words{(i + k) % 17} here" for k in range(12)]
        if i % 4 == 0:
            said[i % 12] = f"you are vile{'abc'[i % 3]}x"
        docs.append((i, ". ".join(said) + "."))
    marks = [(i, 1, int(i % 4 == 0) ^ int(i % 53 == 7)) for i in range(n)]
    return spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), labels(spark, marks)


def test_held_out_documents_and_their_offending_sentence(spark):
    docs, marks = toxic_corpus(spark)
    found = toxicity.toxicity(docs, marks).collect()
    for r in found:
        assert r.predicted == int(r.doc_id % 4 == 0) == int(r.score >= 0.5), r
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in found:
        assert all("vile" in text[r.doc_id][s.start : s.stop] for s in r.sentences) and len(r.sentences) == r.predicted
    assert 0.1 < sum(r.held_out for r in found) / len(found) < 0.3
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in text if i % 4}


def test_toxicity_of_odd_documents(spark):
    docs, marks = odd_documents(spark, [(30, "vileax! fine"), (31, "...\n!?")]), toxic_corpus(spark)[1]
    train = toxic_corpus(spark)[0]
    model = toxicity.fit(train, marks)
    scored = docs.select("doc_id", "text", toxicity.score(F.col("text"), model).alias("s")).collect()
    for r in scored:
        weights = toxicity.WordWeights(model)
        quiet = 1.0
        for sentence in re.split(r"[.!?\n]", (r.text or "").lower()):
            words = re.findall(r"[^\W\d_]+", sentence)
            if words:
                quiet *= 1 - 1 / (1 + math.exp(-(model.bias + sum(weights[w] for w in words))))
        assert r.s.score == pytest.approx(1 - quiet, abs=1e-9)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, empty(marks)).collect()}
    assert got[2].score == 0.0 and got[30].predicted == 0 and got[None].held_out
    assert toxicity.toxicity(empty(docs), marks).count() == 0


def test_equal_texts_with_unlike_labels_teach_nothing(spark):
    train, marks = toxic_corpus(spark)
    torn = spark.createDataFrame([(900 + i, "you are vileax. torn words", 5) for i in range(40)], "doc_id BIGINT, text STRING, label INT")
    both = train.withColumn("label", F.lit(0)).unionByName(torn)
    more = marks.unionByName(labels(spark, [(900 + i, 1, i % 2) for i in range(40)]))
    model = toxicity.fit(train, marks)
    assert toxicity.fit(both.repartition(7), more) == model == toxicity.fit(both.orderBy(F.desc("doc_id")), more)


# -- decontamination -------------------------------------------------------------------------------

def plain_contamination(docs, items, size=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: PLAIN.findall((t or "").translate(lower))
    phrases = {}
    for item, text in items:
        w = words(text)
        for s in range(max(len(w) - size, 0) + 1 if w else 0):
            phrases.setdefault(tuple(w[s : s + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for p, own in phrases.items():
            for s in range(len(w) - len(p) + 1):
                if w[s] == p[0] and tuple(w[s : s + len(p)]) == p:
                    hit |= set(range(s, s + len(p)))
                    names |= {str(i) for i in own if i is not None}
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_contamination_of_odd_documents(spark):
    q = [" ".join(f"q{k}" for k in range(i, i + 14)) for i in (0, 7, 100)]
    items = [(1, q[0]), (2, q[1].upper()), (3, "Lone-word"), (4, None), (5, ""), (None, q[2]), (6, "the the the the"), (7, q[0])]
    texts = [
        (40, f"before {q[0]} after"), (41, q[0].replace("q5", "q 5")), (42, f"x, {q[1]}! {q[1]}"), (43, "a lone word b lone"), (44, "the " * 9), (45, q[2]),
        (46, " ".join(["pad"] * 250) + " " + q[0] + " " + " ".join(["pad"] * 300)), (47, " ".join(q[0].split()[:9])), (48, "Q3; " + q[0][: len(q[0]) // 2]),
    ]
    docs = odd_documents(spark, texts)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id BIGINT, text STRING, window INT")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    plain = plain_contamination([(r.doc_id, r.text) for r in docs.collect()], items)
    assert rows(decontam.contamination(docs, bench), *columns) == plain
    clean = decontam.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(map(repr, (r.doc_id for r in clean.collect()))) == sorted(repr(p[0]) for p in plain if not p[-1])
    assert rows(decontam.contamination(docs, empty(bench)), *columns) == plain_contamination([(r.doc_id, r.text) for r in docs.collect()], [])
    assert decontam.contamination(empty(docs), bench).count() == 0


def plain_proximity(docs, items, leads, slop, least, near, size=10):
    texts = set(docs)  # documents of one id with other texts have rows of their own
    count = Counter(w for _, t in docs for w in PLAIN.findall(t or ""))
    out = []
    for phrase in {tuple(w[i : i + size]) for w in map(PLAIN.findall, items) for i in range(max(1, len(w) - size + 1))}:
        if not near and any(not count[w] for w in phrase):
            continue
        own = sorted((count[w], phrase.index(w), w) for w in set(phrase) if count[w])[:leads]
        for doc, text in texts:
            starts = {w: [p - o for p, x in enumerate(PLAIN.findall(text or "")) if x == w] for _, o, w in own}
            for s in {s for found in starts.values() for s in found}:
                gaps = [min(abs(s - t) for t in found) for found in starts.values() if found]
                gaps = [g for g in gaps if g <= slop]
                if len(gaps) >= least:
                    out.append((" ".join(phrase), doc, s, len(gaps), max(gaps)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("leads", "slop", "least", "near"), [(2, 5, 2, False), (4, 3, 3, True), (3, 1, 2, True)])
def test_proximity_equals_brute_force(spark, leads, slop, least, near):
    rng = random.Random(leads)
    quote = [f"q{k}" for k in range(12)]
    docs = [(None, " ".join(quote)), (None, " ".join(quote)), (1, None), (2, "")]
    for i in range(60):
        said = list(quote)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(said))
            said[at : at + rng.randrange(2)] = ["um"] * rng.randrange(4)
        docs.append((i % 50, " ".join(["pad"] * rng.randrange(300) + said + ["q3", "pad", "q7"] * rng.randrange(3))))
    items = [" ".join(quote), " ".join([*quote[:5], "unheard", *quote[5:]]), "q3 q7", "unheard", ""]
    table = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    index = decontam.build_index(table, spark.createDataFrame(list(enumerate(items)), "item_id BIGINT, text STRING"), leads=leads, near=near)
    found = decontam.proximity_matches(index, slop, least).join(index.windows, "window").select(F.array_join("phrase", " "), "doc", "start", "n_terms", "gap")
    want = plain_proximity(docs, items, leads, slop, least, near)
    assert sorted(map(tuple, found.collect()), key=repr) == want
    assert any("unheard" in w[0] for w in want) == near
    exact = {r.doc for r in decontam.exact_matches(index, leads).collect()}
    assert exact == {d for d, t in docs if t and " ".join(quote[:10]) in t or t and " ".join(quote[1:11]) in t or t and " ".join(quote[2:]) in t or t and "q3 q7" in t}


def test_proximity_finds_loose_quotes_and_no_far_ones(spark):
    phrase = " ".join(f"q{k}" for k in range(10))
    docs = spark.createDataFrame([(1, phrase), (2, phrase.replace("q1 ", "q1 um um ")), (3, phrase.replace("q1 ", "q1 " + "um " * 30))], "doc_id BIGINT, text STRING")
    items = spark.createDataFrame([(1, phrase)], "item_id BIGINT, text STRING")
    index = decontam.build_index(docs.unionByName(docs.withColumn("text", F.lit("q2 q3 q4 q5 q6 q7 q8 q9"))), items)
    assert {r.doc for r in decontam.exact_matches(index).collect()} == {1}
    # The two rarest words are q0 and q1, which stand together in all three.
    assert {(r.doc, r.gap) for r in decontam.proximity_matches(index).collect()} == {(1, 0), (2, 0), (3, 0)}
    wide = decontam.build_index(docs, items, leads=10)
    assert {(r.doc, r.n_terms) for r in decontam.proximity_matches(wide, least=9).collect()} == {(1, 10), (2, 10)}
