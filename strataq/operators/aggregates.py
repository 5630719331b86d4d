"""Aggregations: roll-ups, percentiles, module and directory summaries, detection quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import ratio, round_half_up
from ..functions.text import ancestors, dir_of, module_key


def nearest_rank(df: DataFrame, keys: list[str], value: str, percent: int) -> DataFrame:
    """The value at position floor(percent / 100 * n) of each key's sorted values (0-based, at most n - 1); no interpolation.

    Equal values are counted first, so what is ordered per key is its distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    per = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    counts = counts.withColumn("n", F.sum("c").over(per)).withColumn("upto", F.sum("c").over(per.orderBy(value).rowsBetween(W.unboundedPreceding, 0)))
    at = F.least(F.col("n") - 1, F.floor(F.lit(percent) * F.col("n") / 100))
    return counts.where(F.col("upto") > at).groupBy(*keys).agg(F.min(value).alias(value))


def language_rollup(files: DataFrame) -> DataFrame:
    """Per language: files, code and comment lines, functions, mean (2 places) and largest complexity."""
    return files.groupBy("language").agg(
        F.count("*").alias("files"), F.sum("code_lines").alias("code_lines"), F.sum("comment_lines").alias("comment_lines"), F.sum("functions").alias("functions"),
        round_half_up(F.avg("complexity"), 2).alias("avg_complexity"), F.max("complexity").alias("max_complexity"),
    )


def module_rollup(files: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Modules (directories to a depth): files, lines, fan-in, fan-out, instability and the layer of more than half of the
    files. files: path, loc, layer. edges: src, dst (paths)."""
    f = files.withColumn("module", module_key(F.col("path"), depth))
    size = f.groupBy("module").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))
    layers = f.where("layer is not null").groupBy("module", "layer").agg(F.count("*").alias("n"))
    top = layers.groupBy("module").agg(F.max(F.struct("n", "layer")).alias("top"))
    between = module_edges(edges, depth)
    out = between.groupBy(F.col("src").alias("module")).agg(F.count_distinct("dst").alias("fan_out"))
    into = between.groupBy(F.col("dst").alias("module")).agg(F.count_distinct("src").alias("fan_in"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    d = size.join(top, "module", "left").join(out, "module", "left").join(into, "module", "left")
    return d.select(
        "module", "files", "loc", zero("fan_in").alias("fan_in"), zero("fan_out").alias("fan_out"),
        F.coalesce(ratio(zero("fan_out"), zero("fan_in") + zero("fan_out"), 2), F.lit(0.0)).alias("instability"),
        F.when(F.col("top.n") * 2 > F.col("files"), F.col("top.layer")).alias("layer"),
    )


def module_edges(edges: DataFrame, depth: int) -> DataFrame:
    """File edges summed between different modules."""
    e = edges.select(module_key(F.col("src"), depth).alias("src"), module_key(F.col("dst"), depth).alias("dst"), F.coalesce("weight", F.lit(1)).alias("weight") if "weight" in edges.columns else F.lit(1).alias("weight"))
    return e.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def fan_in_out(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out) with 0 for isolated nodes; distinct neighbours."""
    e = edges.select("src", "dst").distinct()
    out, into = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out")), e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.select("id").join(into, "id", "left").join(out, "id", "left").select("id", zero("fan_in"), zero("fan_out"))


def adaptive_depth(files: DataFrame, deepest: int = 8, most: int = 30) -> DataFrame:
    """(depth, modules): the smallest depth that gives the most modules, among depths with at most `most` of them (1 if none)."""
    d = files.select("path", F.explode(F.sequence(F.lit(1), F.lit(deepest))).alias("depth"))
    n = d.groupBy("depth").agg(F.count_distinct(module_key(F.col("path"), F.col("depth"))).alias("modules"))
    fits = (F.col("modules") <= most).cast("int")
    return n.orderBy(F.desc(fits), F.desc(F.when(F.col("modules") <= most, F.col("modules"))), "depth").limit(1)


def tree_rollup(files: DataFrame) -> DataFrame:
    """(directory, depth, size, files) of every directory, each file counted in all directories above it."""
    d = files.select(F.explode(ancestors(F.col("path"))).alias("directory"), "size")
    depth = F.when(F.col("directory") == "", 0).otherwise(F.size(F.split("directory", "/")))
    return d.groupBy("directory").agg(F.sum("size").alias("size"), F.count("*").alias("files")).withColumn("depth", depth)


# First directories that hold several packages.
WORKSPACES = ("packages", "apps", "services", "libs", "modules", "projects")


def top_directories(files: DataFrame, most: int = 50) -> DataFrame:
    """Files by first directory, by the first two where the first holds workspaces; the largest `most`."""
    parts = F.split(dir_of(F.col("path")), "/")
    first = F.get(parts, F.lit(0))
    group = F.when(dir_of(F.col("path")) == "", ".").when(first.isin(*WORKSPACES) & (F.size(parts) > 1), F.concat_ws("/", first, F.get(parts, F.lit(1)))).otherwise(first)
    return files.groupBy(group.alias("directory")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "directory").limit(most)


def detection_quality(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Micro-averaged precision, recall and F1 (4 places, null where undefined) from columns tp, fp, fn."""
    s = matches.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return s.select(*keys, "tp", "fp", "fn", ratio(tp, tp + fp, 4).alias("precision"), ratio(tp, tp + fn, 4).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn, 4).alias("f1"))


def match_findings(expected: DataFrame, found: DataFrame) -> DataFrame:
    """One row per rule: tp, fp, fn of a one-to-one match. An expected issue (issue, rule_id, path, lo, hi) is met by a
    finding (finding, rule_id, path, line) of its rule and path within its lines; the first free one in line order.

    Spans of one rule and path must not overlap: then the first finding inside a span is its match.
    """
    hit = expected.join(found, ["rule_id", "path"]).where((F.col("line") >= F.col("lo")) & (F.col("line") <= F.col("hi")))
    one = W.partitionBy("issue").orderBy("line", "finding")
    met = hit.withColumn("n", F.row_number().over(one)).where("n = 1").select("issue", "finding", "rule_id")
    tp = met.groupBy("rule_id").agg(F.count("*").alias("tp"))
    fn = expected.join(met.select("issue"), "issue", "left_anti").groupBy("rule_id").agg(F.count("*").alias("fn"))
    # more findings inside a matched span are duplicates, neither right nor wrong
    fp = found.join(hit.select("finding").distinct(), "finding", "left_anti").groupBy("rule_id").agg(F.count("*").alias("fp"))
    d = tp.join(fp, "rule_id", "full_outer").join(fn, "rule_id", "full_outer")
    return d.select("rule_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")])


def unpivoted(df: DataFrame, ids: list[str], measures: list[str]) -> DataFrame:
    """Long form (ids..., key, value) of numeric columns."""
    return df.unpivot(ids, [F.col(m).cast("double").alias(m) for m in measures], "key", "value").where("value is not null")


def counts_in_one_pass(df: DataFrame, keys: list[str], **conditions: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in conditions.items()])
