"""Joins that SQL engines lack by name: nearest ancestor, longest prefix, first candidate, only candidate, span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ancestors


def nearest_ancestor(files: DataFrame, marks: DataFrame, mark: str, path: str = "path", by: tuple[str, ...] = ()) -> DataFrame:
    """Each file with the mark of the nearest directory at or above its own. marks: directory, a column `mark`, and the
    columns `by`, which must be equal too.

    Directories are exploded with their depth and joined by equality; the deepest hit is a maximum, so no range join.
    """
    up = files.select(path, *by, F.posexplode(ancestors(F.col(path))).alias("depth", "directory"))
    best = up.join(marks, ["directory", *by]).groupBy(path, *by).agg(F.max_by(F.struct("directory", F.col(mark)), "depth").alias("m"))
    return files.join(best, [path, *by], "left").select(*[files[c] if c not in (path, *by) else F.col(c) for c in files.columns], F.col("m.directory").alias("nearest"), F.col(f"m.{mark}").alias(mark))


def longest_prefix(files: DataFrame, prefixes: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    """Each file with the longest of the directory prefixes that holds it."""
    return nearest_ancestor(files, prefixes.select(F.col(prefix).alias("directory"), F.col(prefix).alias("owner")), "owner", path).drop("nearest")


def first_candidate(candidates: DataFrame, targets: DataFrame, key: list[str], candidate: str, priority: str, target: str) -> DataFrame:
    """(key..., target): of candidates that exist among the targets, the one of smallest priority."""
    hit = candidates.join(targets.select(F.col(target).alias(candidate)).distinct(), candidate, "left_semi")
    return hit.groupBy(*key).agg(F.min_by(candidate, priority).alias(target))


def only_candidate(left: DataFrame, right: DataFrame, on: list[str], value: str) -> DataFrame:
    """left with `value` of the right side, where the right side has exactly one for the key."""
    single = right.select(*on, value).distinct().groupBy(*on).agg(F.count("*").alias("_n"), F.first(value).alias(value)).where("_n = 1").drop("_n")
    return left.join(single, on, "left")


def within_span(points: DataFrame, spans: DataFrame, on: list[str], at: str, lo: str, hi: str) -> DataFrame:
    """Points inside a span of their key; equality first, so the range is only a filter."""
    return points.join(spans, on).where((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi)))


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of the left that the right lacks."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def upward(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """Edges from a lower to a higher layer (rank 0 is the top). ranks: id, rank."""
    r = lambda end: ranks.select(F.col("id").alias(end), F.col("rank").alias(f"{end}_rank"))
    return edges.join(r("src"), "src").join(r("dst"), "dst").where("src_rank > dst_rank")


def boundaries(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds the previous and next position within a key."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn("previous", F.lag(order).over(w)).withColumn("following", F.lead(order).over(w))


def route_windows(routes: DataFrame, lines: DataFrame, look_back: Column, most: int = 60) -> DataFrame:
    """Each route (path, line) with its own text: up to the next route's line, at most `most` lines, and `look_back` lines
    above, never the previous route's. lines: path, line, text."""
    w = boundaries(routes, ["path"], "line")
    lo = F.greatest(F.coalesce(F.col("previous"), F.lit(0)) + 1, F.col("line") - look_back)
    hi = F.least(F.coalesce(F.col("following") - 1, F.lit(2**31 - 1)), F.col("line") + most)
    w = w.withColumn("lo", lo).withColumn("hi", hi).drop("previous", "following")
    text = lines.select("path", F.col("line").alias("at"), F.col("text").alias("line_text"))
    joined = w.join(text, "path").where("at >= lo and at <= hi")
    keys = [c for c in w.columns]
    return joined.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line_text"))), lambda x: x["line_text"]), "\n").alias("window"))
