"""Choosing source files: sub-folder, glob, allow list, exact fraction, cap."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.operators.numbering import exact_fraction, ordered_limit


def glob_pattern(pattern: str) -> str:
    """Regular expression of a path glob; ``*`` stays inside a folder, ``**`` spans folders."""
    parts = [p for p in pattern.split("/") if p not in ("", ".")]
    out = ""
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
            continue
        piece, j = "", 0
        while j < len(part):
            c = part[j]
            end = part.find("]", j + 2) if c == "[" else -1
            if c == "*":
                piece += "[^/]*"
            elif c == "?":
                piece += "[^/]"
            elif end > 0:
                body = part[j + 1 : end]
                piece += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
                j = end
            else:
                piece += re.escape(c)
            j += 1
        out += piece + ("" if last else "/")
    return "^" + out + "$"


def _relative(path: Column, root: str) -> Column:
    """Path below ``root``, NULL outside it."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path)))


def resolved(path: Column) -> Column:
    """Absolute path without ``.``, ``..`` and empty components, however many; ``..`` at the root stays there."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = lambda kept: F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
    kept = F.aggregate(
        parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", up(a)).otherwise(F.array_append(a, p))
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def read_allow_list(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Paths of a text file; blank lines and ``#`` lines are skipped, relative ones start at ``root``."""
    return allow_list(spark.read.text(path).select(F.col("value").alias("line")), root)


def allow_list(lines: DataFrame, root: str) -> DataFrame:
    line = F.trim("line")
    full = F.when(line.startswith("/"), line).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), line))
    kept = lines.filter((line != "") & ~line.startswith("#"))
    return kept.select(resolved(full).alias("path")).distinct()


def select_sources(
    sources: DataFrame,
    root: str,
    subdirectory: str | None = None,
    glob: str | None = None,
    allowed: DataFrame | None = None,
    fraction: float | None = None,
    fraction_seed: int | None = None,
    seed: int = 42,
    max_files: int | None = None,
) -> DataFrame:
    """Apply the filters in order: sub-folder, glob, allow list, fraction, cap.

    ``sources`` has a ``path`` column, one row per file. The fraction keeps exactly
    max(1, int(n * fraction)) files, chosen by a seeded hash of the path.
    """
    if subdirectory is not None and glob is not None:
        raise ValueError("subdirectory and glob exclude each other")
    if fraction is not None and not 0.0 < fraction <= 1.0:
        raise ValueError("fraction must be in (0, 1]")
    out, path = sources, F.col("path")
    if subdirectory is not None:
        prefix = root.rstrip("/") + "/" + subdirectory.strip("/")
        out = out.filter((path == prefix) | path.startswith(prefix + "/"))
    if glob is not None:
        out = out.filter(_relative(path, root).rlike(glob_pattern(glob)))
    if allowed is not None:
        out = out.withColumn("_r", resolved(path)).join(
            allowed.select(F.col("path").alias("_r")), "_r", "left_semi"
        ).drop("_r")
    if fraction is not None:
        out = exact_fraction(out, fraction, ["path"], seed=seed if fraction_seed is None else fraction_seed)
    if max_files is not None:
        out = ordered_limit(out, ["path"], max_files)
    return out
