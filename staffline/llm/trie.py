"""Prefix trie of conversations by parallel tree contraction.

Every distinct sequence of first turns is a node; a node's key is its depth and the exclusive-or of hashes of (position, role, text), which a
distributed prefix scan gives for all turns at once, so neither a long conversation nor a common first turn makes one task.

Subtree totals come from contraction. A round of joins first rakes: every leaf hands its total to its parent and leaves. Then it
compresses: a node with one child left is spliced out where one bit of its depth is set and the same bit of its parent's depth is
not. No two neighbours satisfy that, so all of them go at once, and bit after bit a chain halves. A spliced node
leaves its own sum with its parent and a note of its child. When the root has gone the notes are read backwards: a spliced
node's total is its own sum and the total of its child. A chain of n turns takes some log2(n) rounds.

Tables shrink from round to round, are written down, and nothing but counts reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staffline.llm.common import durable
from staffline.operators.numbering import running, sequence_blocks, sequence_position

#: A key with more than one in so many of all rows is looked up by broadcast: there are fewer such keys than that.
HOT_SHARE = 1000
#: Ids that are packed into one row before they are hashed.
PACK = 1024
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Turns that a rebuilt conversation can take from another one.
MOST_SHARED = 8


def lookup(rows: DataFrame, key: str, facts: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` with the columns of ``facts`` for their key; rows without facts go. ``facts`` has one row per key.

    Keys that hold more than a thousandth of all rows are met by broadcast, fewer than a thousand facts; the rest by a
    shuffle in which no key is large. ``counts`` (key, n) saves counting.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    counts = durable(counts.where(F.col(key).isNotNull()), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = counts.where(F.col("n") * HOT_SHARE > total).select(key)
    hot_facts = facts.join(F.broadcast(hot), key, "left_semi")
    return (
        rows.join(F.broadcast(hot_facts), key)
        .unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(facts, key))
    )


# -- turns -----------------------------------------------------------------------------------------

def numbered_turns(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, mark, n_bytes): turns numbered from 1 by (turn, role, digest of text), null turns first.

    Null roles and texts are empty; rows without a conversation are left out, as nothing can name them. Rows that are
    equal in everything are turns of their own.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = table.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"),
        F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"),
    )
    rows = sequence_position(rows, ["conv"], ["turn"], ties=["role", "digest"], name="at")
    mark = F.sha2(F.concat_ws("/", F.octet_length("role").cast("string"), "role", "digest"), 256)
    return rows.select("conv", (F.col("at") + 1).alias("pos"), mark.alias("mark"), "n_bytes")


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv) of every conversation with a turn."""
    return turns.select("conv").distinct()


def share_openings(turns: DataFrame, source: Column, taken: Column) -> DataFrame:
    """Rebuilt turns: the first ``taken`` (at most 8) turns of conversation ``source``, then the own ones after the first ``taken``.

    Both are expressions of ``conv``. A source that is absent or shorter gives what it has; its rows go to as many conversations
    as name it, so ``source`` should fan out to a bounded number.
    """
    turns = durable(turns, "turns")
    plan = conversations_of(turns).select("conv", source.alias("source"), taken.alias("taken"))
    opening = turns.where(F.col("pos") <= MOST_SHARED).withColumnRenamed("conv", "source")
    plan = durable(plan, "plan")
    shared = plan.join(opening, "source").where(F.col("pos") <= F.col("taken")).select("conv", "pos", "mark", "n_bytes")
    n = opening.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    shift = plan.join(n, "source", "left").select("conv", "taken", F.least("taken", F.coalesce("n", F.lit(0))).alias("n_shared"))
    own = lookup(turns, "conv", shift).where(F.col("pos") > F.col("taken"))
    own = own.select("conv", (F.col("pos") - F.col("taken") + F.col("n_shared")).alias("pos"), "mark", "n_bytes")
    return shared.unionByName(own)


# -- nodes -----------------------------------------------------------------------------------------

def _half(digest: Column, first: int) -> Column:
    return F.conv(F.substring(digest, first, 15), 16, 10).cast("long")


def _name(a: Column, b: Column) -> Column:
    return F.concat_ws("", F.lpad(F.hex(a), 15, "0"), F.lpad(F.hex(b), 15, "0"))


def _nodes(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, parent, depth, conv, n_convs, n_bytes, n_children) of every node, and (id, conv) of where conversations end."""
    digest = F.sha2(F.concat_ws("/", F.col("pos").cast("string"), "mark"), 256)
    rows = turns.select("conv", "pos", "n_bytes", digest.alias("d")).select("conv", "pos", "n_bytes", _half(F.col("d"), 1).alias("a"), _half(F.col("d"), 16).alias("b"))
    rows = running(rows, ["conv"], ["pos"], {"xa": ("xor", F.col("a")), "xb": ("xor", F.col("b"))})
    before = _name(F.col("xa").bitwiseXOR(F.col("a")), F.col("xb").bitwiseXOR(F.col("b")))
    rows = rows.select("conv", F.col("pos").alias("depth"), "n_bytes", _name(F.col("xa"), F.col("xb")).alias("id"), before.alias("parent"))
    root = _name(F.lit(0), F.lit(0))
    tops = conversations.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_bytes"), root.alias("id"), F.lit(None).cast("string").alias("parent"))
    rows = durable(rows.unionByName(tops), "places")
    nodes = rows.groupBy("id").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv").alias("conv"),
        F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
    )
    nodes = durable(nodes, "nodes")
    kids = nodes.groupBy(F.col("parent").alias("of")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(kids, F.col("id") == F.col("of"), "left").drop("of").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    ends = rows.groupBy("conv").agg(F.max_by("id", "depth").alias("id"))
    return durable(nodes, "nodes"), ends


def _end_digests(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256): SHA-256 of the conversations that end at a node, ascending and comma-joined.

    Ids are ordered and packed inside range blocks; what is left of a hot node is a stream of packs that one task hashes
    without holding it.
    """
    blocks = sequence_blocks(ends, ["id"], ["conv"])
    w = Window.partitionBy("_block", "id").orderBy("conv")
    placed = blocks.select("_block", "id", "conv", F.floor((F.row_number().over(w) - 1) / PACK).alias("pack"))
    packs = placed.groupBy("_block", "id", "pack").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, done = None, None, []
        for batch in batches:
            for i, ids in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist()):
                if i != node:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = i, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _pairs(done)
            done = []
        if node is not None:
            yield _pairs([(node, digest.hexdigest())])

    ordered = packs.repartition("id").sortWithinPartitions("id", "_block", "pack").select("id", "ids")
    return ordered.mapInArrow(hashed, "id string, ends_sha256 string")


def _pairs(rows: Sequence[tuple[str, str]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["id", "ends_sha256"])


# -- contraction -----------------------------------------------------------------------------------

def subtree_sums(nodes: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(id, *values): each value summed over the subtree of every node, by rake and compress.

    ``nodes`` has id, parent (null at roots), depth and n_children, and forms a forest in which a child is one deeper than its parent.
    """
    names = list(values)
    bits = max(1, int(nodes.agg(F.coalesce(F.max("depth"), F.lit(1))).first()[0]).bit_length())
    tree = nodes.select("id", "parent", "depth", (F.col("depth") - 1).alias("above"), F.col("n_children").alias("left"), *[c.alias(n) for n, c in values.items()])
    tree = durable(tree, "tree")
    finished, spliced, turn = [], [], 0
    while tree.head(1):
        leaf = F.col("left") == 0
        finished.append(tree.where(leaf).select("id", *names))
        # Rake: what leaves hand up, and the child that stays where one stays.
        gifts = tree.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("to")).agg(
            F.count_if(leaf).alias("raked"), F.max(F.when(~leaf, F.col("id"))).alias("heir"),
            *[F.sum(F.when(leaf, F.col(n)).otherwise(0)).alias(f"_{n}") for n in names],
        )
        raked = tree.where(~leaf).join(gifts, F.col("id") == F.col("to")).select(
            "id", "parent", "depth", "above", (F.col("left") - F.col("raked")).alias("left"), "heir", *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in names]
        )
        bit = lambda c: F.shiftright(F.col(c), turn % bits).bitwiseAND(F.lit(1))  # noqa: E731, B023
        out = (F.col("left") == 1) & F.col("parent").isNotNull() & (bit("depth") == 1) & (bit("above") == 0)
        raked = durable(raked.withColumn("out", out), "raked")
        # Compress: a spliced node gives its sum to its parent and its parent to its child.
        gone = raked.where("out")
        spliced.append(gone.select("id", F.col("heir").alias("child"), *names))
        up = gone.select(F.col("parent").alias("to"), *[F.col(n).alias(f"_{n}") for n in names], F.lit(None).cast("string").alias("over"), F.lit(None).cast("long").alias("height"))
        down = gone.select(F.col("heir").alias("to"), *[F.lit(0).cast("long").alias(f"_{n}") for n in names], F.col("parent").alias("over"), F.col("above").alias("height"))
        news = up.unionAll(down).groupBy("to").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in names], F.max("over").alias("over"), F.max("height").alias("height"))
        tree = raked.where("NOT out").join(news, F.col("id") == F.col("to"), "left").select(
            "id", F.coalesce("over", "parent").alias("parent"), "depth", F.coalesce("height", "above").alias("above"), "left",
            *[(F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in names],
        )
        tree = durable(tree, "tree")
        turn += 1
    if not finished:
        return tree.select("id", *names)
    known = finished[0]
    for more in finished[1:]:
        known = known.unionAll(more)
    # Backwards: the child of a spliced node was finished or spliced later.
    for gone in reversed(spliced):
        below = known.select(F.col("id").alias("child"), *[F.col(n).alias(f"_{n}") for n in names])
        whole = gone.join(below, "child").select("id", *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in names])
        known = known.unionAll(durable(whole, "expanded"))
    return known


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The trie of ``turns`` (conv, pos from 1 without gaps, mark, n_bytes) of all ``conversations`` (conv), one row per node.

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens (bytes of the last text
    times the members but one, summed over the subtree) and ends_sha256. A conversation without turns is a member of the
    root. Equal turns under equal openings share a node, however many conversations hold them. Without any conversation
    there is no node.
    """
    nodes, ends = _nodes(turns, conversations)
    sums = subtree_sums(nodes, {
        "n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes"),
    })
    above = nodes.select(F.col("id").alias("parent"), F.col("conv").alias("parent_conv_id"))
    counts = nodes.where("n_children > 0").select(F.col("id").alias("parent"), F.col("n_children").alias("n"))
    placed = lookup(nodes.where("parent IS NOT NULL"), "parent", above, counts)
    placed = placed.unionByName(nodes.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = placed.join(sums, "id").join(_end_digests(ends), "id", "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def rebuilt_trie(table: DataFrame, fan: int = 5, most: int = 9) -> DataFrame:
    """The trie of conversations whose openings are taken from the first one of each run of ``fan`` ids.

    Conversation c takes its first crc32(c) mod ``most`` turns from conversation c - c mod ``fan``. ``table`` has conv_id, turn, role and text; other columns are
    ignored. Edge cases as in ``numbered_turns``, ``share_openings`` and ``prefix_trie``.
    """
    turns = durable(numbered_turns(table), "turns")
    taken = F.crc32(F.col("conv").cast("string")) % most
    rebuilt = share_openings(turns, F.col("conv") - F.col("conv") % fan, taken)
    return prefix_trie(rebuilt, conversations_of(turns))
