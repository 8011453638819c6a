"""Registered queries of the corpus operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.llm import bpe, decontam, planes, quality, ranked, rules, sharding, simhash, tokencount, toxicity, trie, urlrep, warc
from staffline.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
SHARDS = [f"shard-{i:03d}" for i in range(96)]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("text_hash"))
    return sharding.place(docs, ["doc_id"], SHARDS, spare=["text_hash"]).select("doc_id", "slot", "shard")


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge_all(docs, table(spark, sf_dir, "labels"), ["doc_id"])[0]


@query
def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    return urlrep.judge(pages, labels, URL_RULES)


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("n_sentences", F.size("sentences").cast("long")).drop("sentences")


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = warc.read_archives(warc.write_archives(pages), payload=False)
    kind = pages.schema["page_id"].dataType
    return found.select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"),
    )


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op10_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = planes.write_planes(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return planes.read_planes(manifest, docs.schema["doc_id"].dataType)


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


@query
def op12_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


# -- SQL twins -------------------------------------------------------------------------------------

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES["op7_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
     d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
     m AS (SELECT payload_digest, min(page_id) AS least FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN least IS NULL OR least = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN least <> page_id THEN least END AS refers_to
FROM d LEFT JOIN m ON m.payload_digest = d.payload_digest
"""

ORACLES["op8_decontamination"] = rf"""
WITH raw_docs AS (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{60}}\x{{7B}}-\x{{7F}}]+') AS w FROM documents),
     docs AS (SELECT doc_id, coalesce(w, []) AS w FROM raw_docs),
     items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{60}}\x{{7B}}-\x{{7F}}]+') AS w FROM benchmark),
     cut AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM items WHERE len(w) > 0),
     phrases AS (SELECT DISTINCT item, CAST(n AS BIGINT) AS n, array_to_string(w[s : s + n - 1], ' ') AS phrase FROM cut),
     spans AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS phrase
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, (SELECT DISTINCT n FROM phrases) WHERE len(w) >= n)),
     found AS (SELECT doc_id, item, s, spans.n AS n FROM spans JOIN phrases ON spans.phrase = phrases.phrase AND spans.n = phrases.n),
     hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id),
     named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""
_STRENGTH = """round(least(greatest(coalesce(CASE WHEN sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER {w} > 1
      AND sum(n * ({rate} - prior) * ({rate} - prior)) OVER {w} / greatest(sum(n) OVER {w}, 1) - prior * (1 - prior) * sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER {w} / greatest(sum(n) OVER {w}, 1) > 0
    THEN prior * (1 - prior) / (sum(n * ({rate} - prior) * ({rate} - prior)) OVER {w} / greatest(sum(n) OVER {w}, 1)
      - prior * (1 - prior) * sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER {w} / greatest(sum(n) OVER {w}, 1)) - 1
    ELSE 1000.0 END, 1000.0), 1.0), 1000.0), 6)"""
_RATE = "(CASE WHEN n > 0 THEN CAST(bad AS DOUBLE) / n ELSE 0.0 END)"
_DOUBLE = ", ".join(f"'{s}'" for s in urlrep.DOUBLE_SUFFIXES)


def _shrunk(columns: str, source: str, by: str) -> str:
    strength = _STRENGTH.format(rate=_RATE, w=f"(PARTITION BY {by})")
    return f"SELECT *, round((bad + prior * strength) / (n + strength), 6) AS rate FROM (SELECT {columns}, n, bad, prior, {strength} AS strength FROM ({source}))"


def _fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"(j.host = '{host}' OR j.host LIKE '%.{host}') AND starts_with(path, '/{path}')"


_ORDERED = sorted(URL_RULES, key=lambda r: -len(r[0]))
ORACLES["op4_url_reputation"] = f"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
     rows_ AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
                      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
     known AS (SELECT doc_id, 1 - min(quality) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
     counted AS (SELECT host, count(bad) AS n, CAST(coalesce(sum(bad), 0) AS BIGINT) AS bad FROM rows_ LEFT JOIN known ON doc_id = page_id GROUP BY host),
     split_ AS (SELECT *, string_split(host, '.') AS l FROM counted),
     pair AS (SELECT *, array_to_string(l[-2:], '.') AS two FROM split_),
     hosts AS (SELECT host, n, bad, CASE WHEN two IN ({_DOUBLE}) AND len(l) > 2 THEN array_to_string(l[-3:], '.') ELSE two END AS domain,
                      CASE WHEN two IN ({_DOUBLE}) AND len(l) > 2 THEN two ELSE l[-1] END AS suffix FROM pair),
     domains AS (SELECT domain, suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM hosts GROUP BY domain, suffix),
     suffixes AS (SELECT suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM domains GROUP BY suffix),
     s AS ({_shrunk("suffix", "SELECT *, round((sum(bad) OVER () + 1) / (sum(n) OVER () + 2), 6) AS prior FROM suffixes", "1")}),
     d AS ({_shrunk("domain, suffix", "SELECT domains.*, s.rate AS prior FROM domains JOIN s USING (suffix)", "suffix")}),
     h AS ({_shrunk("host, domain", "SELECT hosts.*, d.rate AS prior FROM hosts JOIN d USING (domain)", "domain")}),
     j AS (SELECT page_id, rows_.host AS host, path, rate, round(rate - 2.0 * sqrt(rate * (1 - rate) / (n + strength + 1)), 6) AS lower FROM rows_ LEFT JOIN h USING (host))
SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(r)} THEN '{r}'" for r, _ in _ORDERED)} END AS rule,
       CASE {" ".join(f"WHEN {_fits(r)} THEN '{v}'" for r, v in _ORDERED)} WHEN lower > 0.5 THEN 'block' ELSE 'allow' END AS verdict, rate, lower
FROM j
"""

_TERMS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{40}}\x{{5B}}-\x{{60}}\x{{7B}}-\x{{7F}}]+')"
ORACLES["op11_ranked_search"] = f"""
WITH said AS (SELECT doc_id, {_TERMS} AS w FROM documents),
     sized AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM said WHERE len(w) > 0),
     corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sized),
     tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM sized) GROUP BY ALL),
     weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY term, docs),
     asked AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
     scored AS (SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS BIGINT) AS score
                FROM asked JOIN tf USING (term) JOIN weight USING (term), corpus GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""

# CRC-32 of a decimal number, bit by bit: the reflected polynomial is a fixed value.
_CRC = """xor(list_reduce([ascii(d) FOR d IN string_split(CAST({c} AS VARCHAR), '')],
       lambda r, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(r, CAST(b AS BIGINT))), CAST(4294967295 AS BIGINT)), 4294967295)"""
ORACLES["op13_prefix_trie"] = f"""
WITH said AS (SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS w
              FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
     taken AS (SELECT c, w, CAST({_CRC.format(c="c")} % 9 AS INTEGER) AS h FROM said),
     rebuilt AS (SELECT x.c, coalesce(y.w[1 : h], []) || x.w[h + 1 :] AS w FROM taken x LEFT JOIN said y ON y.c = x.c - x.c % 5),
     prefixes AS (SELECT c, w[1 : d] AS p, d, d = len(w) AS ends FROM (SELECT c, w, unnest(range(len(w) + 1)) AS d FROM rebuilt)),
     nodes AS (SELECT p, d, min(c) AS c, count(*) AS n, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS digest FROM prefixes GROUP BY p, d),
     kids AS (SELECT p[1 : d - 1] AS p, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
     grown AS (SELECT nodes.*, coalesce(k, 0) AS k, CASE WHEN nodes.d > 0 THEN (n - 1) * octet_length(encode(nodes.p[nodes.d].t)) ELSE 0 END AS cost
               FROM nodes LEFT JOIN kids ON kids.d = nodes.d AND kids.p = nodes.p),
     below AS (SELECT p[1 : a] AS p, a AS d, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves, sum(cost) AS cost
               FROM (SELECT *, unnest(range(d + 1)) AS a FROM grown) GROUP BY ALL)
SELECT g.c AS conv_id, CAST(g.d AS BIGINT) AS depth, up.c AS parent_conv_id, g.n AS n_convs, CAST(g.k AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(b.cost AS BIGINT) AS saved_tokens, g.digest AS ends_sha256
FROM grown g JOIN below b ON b.d = g.d AND b.p = g.p LEFT JOIN nodes up ON up.d = g.d - 1 AND up.p = g.p[1 : g.d - 1]
"""
