"""Physical layout shared by the per-bar operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from staffline.keys import BAR


def by_bar(df: DataFrame) -> DataFrame:
    """Hash-partition by bar into ``spark.sql.shuffle.partitions`` partitions.

    The number is explicit so that adaptive execution does not merge partitions by
    their size before the explode that follows: a note of a few bytes becomes tens
    of cells, and a bar becomes thousands of pixels. Callers combine rows per bar
    first, which bounds what one bar can send.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *BAR)
