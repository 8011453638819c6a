"""Source selection, sampling, limits; the order table stands for a list of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.keys import BAR
from staffline.operators import numbering
from staffline.operators.ingest import valid_bars
from staffline.plans import derived
from staffline.plans.catalog import query
from staffline.plans.derived import with_tables
from staffline.sources import notes, selection

ROOT = "/data"
_PATH = "'/data/' || lower(hex(o_orderkey % 16)) || '/' || o_custkey % 3 || '/' || o_orderkey || CASE WHEN o_orderkey % 5 = 0 THEN '.midi' ELSE '.mid' END"
_FILES = f"files AS (SELECT {_PATH.replace('lower(hex(o_orderkey % 16))', 'lower(to_hex(o_orderkey % 16))')} AS path, o_orderkey FROM orders)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.table(spark, sf_dir, "orders").selectExpr(f"{_PATH} AS path", "o_orderkey")


@query("select_subdirectory", f"WITH {_FILES} SELECT path FROM files WHERE path LIKE '/data/a/%'")
def select_subdirectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select_sources(files(spark, sf_dir), ROOT, subdirectory="a").select("path")


@query("select_glob", f"""WITH {_FILES} SELECT path FROM files WHERE regexp_matches(path, '^/data/[0-4]/([^/]+/)*1[^/]*\\.mid$')""")
def select_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select_sources(files(spark, sf_dir), ROOT, glob="[0-4]/**/1*.mid").select("path")


@query(
    "select_allow_list",
    f"WITH {_FILES} SELECT path FROM files WHERE o_orderkey % 7 = 0 AND o_orderkey % 3 <> 0",
)
def select_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List lines: blanks, comments, relative, absolute and dotted paths."""
    f = files(spark, sf_dir)
    k = F.col("o_orderkey")
    relative = F.substring("path", len(ROOT) + 2, 1000)
    line = (
        F.when(k % 3 == 0, F.concat(F.lit("# "), "path"))
        .when(k % 3 == 1, F.concat(F.lit("  "), F.lit("x/../"), relative))
        .otherwise(F.concat(F.col("path"), F.lit("  ")))
    )
    lines = f.select(F.when(k % 7 == 0, line).otherwise("").alias("line"))
    return selection.select_sources(f, ROOT, allowed=selection.allow_list(lines, ROOT)).select("path")


@query(
    "select_fraction",
    f"""WITH {_FILES}, s AS (SELECT path, row_number() OVER (ORDER BY md5(concat('7:', path)), path) AS rn, count(*) OVER () AS n FROM files WHERE path LIKE '%.mid')
    SELECT path FROM s WHERE rn <= greatest(1, floor(n * 0.13::DOUBLE))""",
)
def select_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select_sources(files(spark, sf_dir), ROOT, glob="**/*.mid", fraction=0.13, fraction_seed=7).select("path")


@query("select_max_files", f"WITH {_FILES} SELECT path FROM files WHERE path LIKE '/data/3/%' ORDER BY path LIMIT 50")
def select_max_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select_sources(files(spark, sf_dir), ROOT, subdirectory="3", max_files=50).select("path")


@query(
    "collection_files",
    f"""WITH {_FILES} SELECT 'lakh' AS collection, count(*) AS n FROM files WHERE path LIKE '%.mid'
    UNION ALL SELECT 'maestro', count(*) FROM files WHERE path LIKE '%.midi'
    UNION ALL SELECT 'maestro union', count(*) FROM files WHERE path LIKE '%.mid' OR path LIKE '%.midi'
    UNION ALL SELECT 'maestro fallback', count(*) FROM files WHERE path LIKE '%.mid'""",
)
def collection_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    only_mid = f.filter(F.col("path").endswith(".mid"))
    found = {
        "lakh": notes.collection_files(f, "lakh"),
        "maestro": notes.collection_files(f, "maestro"),
        "maestro union": notes.collection_files(f, "maestro", union=True),
        "maestro fallback": notes.collection_files(only_mid, "maestro"),
    }
    parts = [d.select(F.lit(name).alias("collection")) for name, d in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


@query(
    "bars_global_cap",
    with_tables("""
    SELECT song_id, track_idx, bar_index FROM onset_cells WHERE is_onset GROUP BY ALL HAVING count(*) >= 2
    ORDER BY song_id, track_idx, bar_index LIMIT 1000"""),
)
def bars_global_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.ordered_limit(valid_bars(derived.segments(spark, sf_dir)).select(*BAR), BAR, 1000)


@query(
    "file_chunks",
    f"""WITH {_FILES}, r AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS pos FROM files)
    SELECT pos // 100 AS chunk, count(*) AS n, min(path) AS first_path, max(path) AS last_path FROM r WHERE pos < 12345 GROUP BY 1""",
)
def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 100 files in path order, capped."""
    chunks = numbering.with_chunk(files(spark, sf_dir), ["path"], 100, limit=12345)
    return chunks.groupBy("chunk").agg(
        F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"), F.max("path").alias("last_path")
    )


@query(
    "sample_per_group",
    """SELECT event_id, user_id % 7 AS grp FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id % 7 ORDER BY md5(concat('5:', event_id)), event_id) <= 250""",
)
def sample_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derived.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).alias("grp"))
    return numbering.exact_sample(e, 250, ["event_id"], by=["grp"], seed=5)


@query(
    "first_per_group",
    """SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 4""",
)
def first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derived.table(spark, sf_dir, "events").select("event_id", "event_type")
    return numbering.first_k(e, ["event_type"], ["event_id"], 4)
