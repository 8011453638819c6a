import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from staffline.llm import trie


def plain_trie(rows):
    """Every prefix of every rebuilt conversation, node by node."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        cost = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
        saved[node] = cost + sum(saved[k] for k in kids[node])
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(m), len(node), parent, len(m), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, conv string, depth int").repartition(4)
    return sorted((tuple(r) for r in trie.rebuilt_trie(table).collect()), key=str)


def talks(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.15:
            continue
        for t in range(rng.choice([1, 2, 3, 8, 14])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None])))
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_the_plain_trie(spark, seed):
    rows = talks(seed)
    rows += [(None, 0, "user", "x"), (3, None, "user", "first"), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, 1, "ab", "c"), (3, 1, "a", "bc")]
    assert found(spark, rows) == plain_trie(rows)


def test_long_chains_copies_and_stars(spark, monkeypatch):
    """A conversation of many turns, many equal ones, and a root with many children."""
    monkeypatch.setattr(trie, "HOT_SHARE", 20)
    monkeypatch.setattr(trie, "PACK", 3)
    rows = [(5, t, "user", f"t{t % 7}") for t in range(150)] + [(10, t, "user", f"t{t % 7}") for t in range(120)]
    rows += [(c, t, "user", f"same{t}") for c in range(200, 240) for t in range(12)]
    rows += [(c, 0, "user", f"own{c}") for c in range(1000, 1060)]
    assert found(spark, rows) == plain_trie(rows)


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []


def test_contraction_takes_few_rounds(spark, monkeypatch):
    n = 200
    nodes = spark.range(n).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"),
        F.col("id").alias("depth"), (F.col("id") < n - 1).cast("long").alias("n_children"),
    )
    rounds, durable = [], trie.durable

    def spy(df, name, *rest):
        rounds.append(name)
        return durable(df, name, *rest)

    monkeypatch.setattr(trie, "durable", spy)
    got = {int(r["id"]): r["v"] for r in trie.subtree_sums(nodes, {"v": F.lit(1).cast("long")}).collect()}
    assert got == {i: n - i for i in range(n)}
    assert rounds.count("raked") <= 12
