"""Benchmark decontamination with a positional inverted index of the corpus.

Test items are cut into windows of consecutive words. The terms of the test set are counted over the whole corpus, each
window leads with its rarest terms, and the index stores the postings of those lead terms: term, document, position and
the words around it. A window's lists are shifted by the terms' offsets and intersected from the rarest on; what
is left at one start is compared word by word with the words around the posting, which gives exact phrases, and
starts that lie close together give proximity matches.

All of it is built-in functions. Lists of the test set are broadcast below ``BROADCAST_ROWS`` rows; above that Spark joins them by
shuffling. A term that fills the corpus is no hot key: postings meet the windows where they are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staffline.llm.common import durable, fresh
from staffline.llm.text import plain_words

WINDOW = 10
#: Lists that are intersected for a window.
LEADS = 2
#: Words of a document that are unrolled together.
BLOCK = 256
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _key(id_col: str, text_col: str) -> list[Column]:
    """Rows of one id with different texts are different documents."""
    return [F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_key")]


def blocks(docs: DataFrame, id_col: str, text_col: str, margin: int = 0, block: int = BLOCK) -> DataFrame:
    """(doc, text_key, first, words): blocks of words with ``margin`` more words at either side; ``first`` is the
    position of the block's own first word. A long document becomes many rows."""
    words = docs.select(*_key(id_col, text_col), plain_words(F.col(text_col)).alias("all_words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("all_words") - 1, F.lit(0)), F.lit(block))
    cut = words.select("doc", "text_key", "all_words", F.explode(starts).alias("first"))
    low = F.greatest(F.col("first") - margin, F.lit(0))
    return cut.select("doc", "text_key", "first", low.alias("low"), F.slice("all_words", low + 1, F.col("first") + block + margin - low).alias("words"))


def windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, length, phrase array, items): distinct windows of the test items and the items that have them, as strings.

    An item of fewer words is one window, one without words none.
    """
    words = items.select(F.col(id_col).cast("string").alias("item"), plain_words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    cut = words.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s + 1, size))).alias("phrase"))
    grouped = cut.groupBy("phrase").agg(F.collect_set("item").alias("items"))
    return grouped.select(F.xxhash64("phrase").alias("window"), F.size("phrase").alias("length"), "phrase", "items")


@dataclass
class Index:
    """What is stored for one corpus and one test set."""

    windows: DataFrame
    leads: DataFrame
    postings: DataFrame


def corpus_frequency(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, frequency) over all documents, for the given terms only; 0 for absent ones."""
    found = blocks(docs, id_col, text_col).select(F.explode("words").alias("term")).join(bounded(terms), "term")
    counts = found.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(counts, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("frequency"))


def build_index(
    docs: DataFrame, items: DataFrame, size: int = WINDOW, leads: int = LEADS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", near: bool = False,
) -> Index:
    """Choose the lead terms of every window and store their postings in the shared folder.

    ``near`` keeps windows with terms that the corpus lacks, led by the terms it has: no phrase, but a near match.
    """
    cut = durable(windows(items, size, item_col, item_text), "windows")
    terms = durable(cut.select(F.explode("phrase").alias("term")).distinct(), "terms")
    frequency = durable(corpus_frequency(docs, terms, id_col, text_col), "frequency")
    each = cut.select("window", "length", F.posexplode("phrase").alias("offset", "term")).join(frequency, "term")
    once = each.groupBy("window", "length", "term").agg(F.min("frequency").alias("frequency"), F.min("offset").alias("offset"))
    if near:
        once = once.where(F.col("frequency") > 0)
    order = Window.partitionBy("window").orderBy("frequency", "offset")
    chosen = once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= leads)
    # A window with a term that the corpus lacks occurs nowhere.
    absent = F.min("frequency").over(Window.partitionBy("window")) == 0
    chosen = durable(chosen.withColumn("absent", absent).where(~F.col("absent")).drop("absent"), "leads")
    listed = chosen.groupBy("term").agg((F.min("place") == 1).alias("first"))
    spots = blocks(docs, id_col, text_col, margin=size - 1)
    spots = spots.select("doc", "text_key", "first", "low", "words", F.posexplode("words").alias("at", "term"))
    own = (F.col("low") + F.col("at") >= F.col("first")) & (F.col("low") + F.col("at") < F.col("first") + BLOCK)
    spots = spots.where(own).join(bounded(listed.withColumnRenamed("first", "leading")), "term")
    begin = F.greatest(F.col("at") - (size - 1), F.lit(0))
    around = F.when(F.col("leading"), F.slice("words", begin + 1, 2 * size - 1))
    postings = spots.select("term", "doc", "text_key", (F.col("low") + F.col("at")).alias("pos"), around.alias("around"), (F.col("at") - begin).alias("inside"))
    return Index(cut, chosen, durable(postings.sortWithinPartitions("term"), "postings"))


def _lists(index: Index, place: int) -> DataFrame:
    """The postings of every window's lead term of that place, shifted to the window's start."""
    lead = index.leads.where(F.col("place") == place).select("window", "length", "term", "offset")
    found = index.postings.join(bounded(lead), "term")
    return found.select("window", "doc", "text_key", (F.col("pos") - F.col("offset")).alias("start"), "offset", "length", "around", "inside")


def exact_matches(index: Index, leads: int = LEADS) -> DataFrame:
    """(window, doc, text_key, start, length): every occurrence of a window."""
    found = _lists(index, 1).where("start >= 0")
    same = ["window", "text_key", "start"]
    for place in range(2, leads + 1):
        # Windows of a single term have no list at the later places and pass.
        longer = index.leads.where(F.col("place") == place).select("window").withColumn("more", F.lit(True))
        listed = _lists(index, place).select(*same, F.col("doc").alias("other_doc")).withColumn("hit", F.lit(True))
        found = found.join(bounded(longer), "window", "left").join(
            listed, [found[c].eqNullSafe(listed[c]) for c in same] + [found["doc"].eqNullSafe(listed["other_doc"])], "left"
        ).where("more IS NULL OR hit").select(*[found[c] for c in found.columns])
    phrases = index.windows.select("window", "phrase")
    there = found.withColumn("words", F.slice("around", F.greatest(F.col("inside") - F.col("offset") + 1, F.lit(1)), F.col("length")))
    return there.where("inside >= offset").join(bounded(phrases), "window").where(F.col("words") == F.col("phrase")).select(
        "window", "doc", "text_key", "start", "length"
    )


def proximity_matches(index: Index, slop: int = 5, least: int = 2) -> DataFrame:
    """(window, doc, text_key, start, n_terms, gap): places where most of a window's lead terms stand about as in the window.

    A lead's posting, shifted by its offset, names a start of the window. A row is a start at which at least ``least`` leads name a
    start within ``slop`` words, itself included; ``n_terms`` counts these leads and ``gap`` is the greatest of their
    least distances. So words may be replaced, inserted or left out between the leads. Take more ``leads`` in ``build_index``
    to find windows of which one lead was replaced, and ``near`` for those with terms that the corpus lacks. A window
    with fewer leads than ``least`` has no near match. Repeated rows count once; null ids are kept.
    """
    if slop < 1:
        raise ValueError("slop must be at least 1")
    lead = index.leads.select("window", "term", "offset", "place")
    spots = index.postings.join(bounded(lead), "term").select("window", "doc", "text_key", "place", (F.col("pos") - F.col("offset")).alias("start")).distinct()
    same = ["window", "doc", "text_key", "start"]
    # A start meets its own stretch of ``slop`` words and the two beside it: few rows, however long the document.
    stretch = F.floor(F.col("start") / slop)
    one = spots.select(*same).distinct().withColumn("stretch", stretch)
    near = spots.select("window", F.col("doc").alias("doc_2"), "text_key", "place", F.col("start").alias("start_2"), F.explode(F.array(*[stretch + d for d in (-1, 0, 1)])).alias("stretch"))
    away = F.abs(F.col("start_2") - F.col("start"))
    met = one.join(near, ["window", "text_key", "stretch"]).where(F.col("doc").eqNullSafe(F.col("doc_2")) & (away <= slop))
    nearest = met.groupBy(*same, "place").agg(F.min(away).alias("gap"))
    return nearest.groupBy(*same).agg(F.count(F.lit(1)).alias("n_terms"), F.max("gap").alias("gap")).where(F.col("n_terms") >= least)


def contamination(
    docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``.

    ``n_hit`` counts the words inside any occurrence of a window, ``n_items`` the items with occurring windows; the digest
    is of their ids as strings, sorted and comma-joined. Null and empty texts have no words; null ids are kept; repeated
    rows get equal results; an item without an id counts for hits only. Extra columns are ignored. Without
    documents or items the result is empty or clean.
    """
    index = build_index(docs, items, size, id_col=id_col, text_col=text_col, item_col=item_col, item_text=item_text)
    found = durable(exact_matches(index), "matches")
    spots = found.select("doc", "text_key", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct()
    hits = spots.groupBy("doc", "text_key").agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.select("doc", "text_key", "window").distinct().join(bounded(index.windows.select("window", "items")), "window")
    named = named.select("doc", "text_key", F.explode_outer("items").alias("item")).distinct()
    listed = named.groupBy("doc", "text_key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    both = hits.join(listed, hits["doc"].eqNullSafe(listed["doc"]) & (hits["text_key"] == listed["text_key"]), "left").select(hits["doc"], hits["text_key"], "n_hit", "items")
    rows = docs.select(F.col(id_col), F.xxhash64(text_col).alias("text_key"), F.size(plain_words(F.col(text_col))).cast("long").alias("n_words"))
    joined = rows.join(both, rows[id_col].eqNullSafe(both["doc"]) & (rows["text_key"] == both["text_key"]), "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        rows[id_col].alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", **item_columns: str) -> DataFrame:
    """The rows of ``docs`` in which no window of a test item occurs, with the columns of ``docs``; edge cases as in ``contamination``."""
    index = build_index(docs, items, size, id_col=id_col, text_col=text_col, **item_columns)
    hit = durable(exact_matches(index).select("doc", "text_key").distinct(), "contaminated").withColumnRenamed("text_key", "hit_key")
    key, = fresh(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64(text_col))
    return keyed.join(hit, keyed[id_col].eqNullSafe(hit["doc"]) & (keyed[key] == hit["hit_key"]), "left_anti").select(*docs.columns)
