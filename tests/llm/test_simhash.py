import numpy as np
import pytest
import xxhash
from corpus_helpers import empty, odd_documents, rows

from pyspark.sql import functions as F

from staffline.llm import simhash


def plain_fingerprint(text, shingle):
    words = text.encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, near):
    """{key: smallest key reachable}, all pairs."""
    parent = {k: k for k in prints}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if near(prints[a], prints[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("text", ["", "  \n", "one", "One TWO three", "a b c d e f g a b c d " * 9, "é ß\x1cx É"])
def test_fingerprint_by_bits(text):
    assert simhash.fingerprint(text, 4)[0] == plain_fingerprint(text, 4)


def test_masks_leave_no_near_pair_without_a_common_cell():
    rng = np.random.default_rng(3)
    for radius, share in ((4, 1), (4, 2), (10, 2), (6, 3)):
        masks = simhash.block_masks(radius, share)
        for _ in range(200):
            flips = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
            assert any(flips & m == 0 for m in masks)


@pytest.mark.parametrize("radius, check, tile, share", [(4, None, 1024, 1), (12, None, 8, 1), (12, None, 8, 2), (20, 44, 16, 1)])
def test_links_equal_all_pairs_for_any_grid_and_tile(spark, radius, check, tile, share):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, (60, 2), dtype=np.int64)
    noise = np.zeros((400, 2), dtype=np.int64)
    for row in noise:
        for k in range(2):
            for bit in rng.choice(63, rng.integers(0, radius), replace=False):
                row[k] |= 1 << int(bit)
    prints = {i: tuple((base[i % 60] ^ noise[i]).tolist()) for i in range(400)}
    prints = {i: p for i, p in prints.items() if p not in {q for j, q in prints.items() if j < i}}
    frame = spark.createDataFrame([(*p, i) for i, p in prints.items()], "fp long, check_word long, rep long")
    ones = lambda x: int(x & (1 << 64) - 1).bit_count()
    near = lambda p, q: ones(p[0] ^ q[0]) <= radius and (check is None or ones(p[0] ^ q[0]) + ones(p[1] ^ q[1]) <= check)
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame, radius, check, tile, share)).collect()}
    assert {i: roots.get(i, i) for i in prints} == plain_components(prints, near)


def test_a_group_of_copies_makes_a_forest_not_pairs(spark):
    frame = spark.range(3000).selectExpr("shiftleft(1L, cast(id % 60 as int)) | (id << 0) as fp", "0L as check_word", "id as rep")
    frame = frame.groupBy("fp", "check_word").agg({"rep": "min"}).toDF("fp", "check_word", "rep")
    n = frame.count()
    assert simhash.links(frame, 12, None, tile=256, share=1).count() < 40 * n


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 300).selectExpr("id as hi", "id - 1 as lo")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 300)}


def test_near_duplicates_of_odd_documents(spark):
    docs = odd_documents(spark)
    got = rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id")
    texts = docs.select("doc_id", "text").collect()
    prints = {i: plain_fingerprint(r.text or "", 4) for i, r in enumerate(texts)}
    groups = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, r in enumerate(texts):
        if r.doc_id is not None:
            least[groups[i]] = min(r.doc_id, least.get(groups[i], r.doc_id))
    assert got == sorted(((r.doc_id, f"{prints[i]:016x}", least.get(groups[i])) for i, r in enumerate(texts)), key=repr)
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_one_of_each_group_stays(spark):
    docs = odd_documents(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and 9 not in ids and 5 in ids and len([i for i in ids if i in (2, 3, 4)]) == 1
    assert simhash.drop_near_duplicates(empty(docs)).count() == 0


def plain_jaccard(a, b, shingle=5):
    sets = []
    for text in (a, b):
        words = text.encode().lower().split()
        sets.append({tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1])) if any(sets) else 1.0


def edited(rng, words, spots):
    words = list(words)
    for at in rng.choice(len(words), spots, replace=False):
        words[at] = f"new{rng.integers(1 << 30)}"
    return words


def near_and_far_copies(n=40):
    """Texts with copies that differ in 1 to 14 of 200 words: similarities from 0.5 to 0.95."""
    rng = np.random.default_rng(11)
    texts = {}
    for i in range(n):
        base = [f"w{x}" for x in rng.integers(0, 3000, 200)]
        for k, spots in enumerate((0, 1 + i % 14, 2 + i % 5)):
            texts[10 * i + k] = " ".join(edited(rng, base, spots))
    return texts


def test_shingle_similarity_decides_on_near_copies(spark):
    texts = near_and_far_copies()
    want = plain_components(texts, lambda a, b: plain_jaccard(a, b) >= 0.8)
    between = [s for i in range(40) if 0.5 <= (s := plain_jaccard(texts[10 * i], texts[10 * i + 1])) < 0.85]
    assert len([s for s in between if s >= 0.8]) >= 3 and len([s for s in between if s < 0.8]) >= 10
    kept = simhash.drop_near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id BIGINT, text STRING"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_exact_links_equal_all_pairs_for_any_block(spark):
    texts = near_and_far_copies(12)
    frame = spark.createDataFrame([(0, i, t) for i, t in texts.items()], "root BIGINT, node BIGINT, text STRING")
    made = frame.select("root", "node").join(simhash.shingle_sets(frame, 5), "node")
    want = plain_components(texts, lambda a, b: plain_jaccard(a, b) >= 0.8)
    for shingles, sets in ((1 << 18, 512), (1 << 18, 5), (600, 512)):
        roots = {r.node: r.root for r in simhash.components(simhash.set_links(made, 0.8, shingles, sets)).collect()}
        assert {i: roots.get(i, i) for i in texts} == want


def test_recall_on_given_data_against_an_unrestricted_brute_force(spark):
    """Every pair of 0.8 or more on the tables of sf0.01, by counting common shingles without any restriction."""
    import os
    from collections import Counter

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("test tables not present")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {r.doc_id: frozenset(simhash.shingle_set(simhash.shingle_hashes(r.text or "", 5)).tolist()) for r in docs.collect()}
    held = {}
    for i, s in sets.items():
        for x in s:
            held.setdefault(x, []).append(i)
    common = Counter((i, j) for ids in held.values() for n, i in enumerate(ids) for j in ids[n + 1 :])
    near = [(i, j) for (i, j), n in common.items() if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n)]
    found = simhash.near_copies(docs.selectExpr("doc_id AS id", "xxhash64(text) AS key", "text"))
    root = {r.id: r.root for r in found.collect()}
    lost = [(i, j) for i, j in near if root[i] != root[j]]
    assert len(near) > 100 and len(lost) <= 0.01 * len(near), (len(lost), len(near))
    want = plain_components(sets, lambda a, b: len(a & b) * 5 >= 4 * len(a | b)) if not lost else None
    groups = {}
    for i, r in root.items():
        groups.setdefault(r, set()).add(i)
    if want:
        assert {min(g) for g in groups.values()} == set(want.values())


def test_compared_rows_grow_with_the_documents(spark):
    """Unlike texts share next to no cell, however many there are: nothing like all pairs meet."""
    rng = np.random.default_rng(3)
    frame = lambda n: spark.createDataFrame([(i, i, " ".join(f"w{x}" for x in rng.integers(0, 5000, 60))) for i in range(n)], "id BIGINT, key BIGINT, text STRING")
    for n in (200, 800):
        sets = simhash.named_sets(frame(n), 5)
        cells = sets.select(F.posexplode("bands").alias("grid", "cell"), "fp", "check_word", F.col("node").alias("rep"))
        assert simhash.tile_pairs(cells, 20).count() <= n / 50


def test_unlike_texts_of_one_id_stay_apart(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(1, a), (1, b), (1, a), (2, b), (None, a), (None, a)], "doc_id BIGINT, text STRING")
    kept = sorted(((r.doc_id or 0), r.text) for r in simhash.drop_near_duplicates(docs).collect())
    assert kept == sorted([(1, a), (1, b), (0, a), (0, a)])
