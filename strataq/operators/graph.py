"""Graph operators on edge DataFrames (src, dst): breadth-first search, PageRank, cycles, impact.

Loops cut lineage with written tables, stop when nothing changes, and bring no more than counts to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch


def bfs(edges: DataFrame, start: DataFrame, scratch: Scratch, direction: str = "out", max_depth: int = 10, limit: int | None = None) -> DataFrame:
    """(id, distance) of what the start nodes (id) reach within max_depth steps, themselves left out; self edges don't count.

    With a limit the nearest are kept, ties by id.
    """
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")) if direction == "out" else edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    e = scratch.save(e.where("a <> b").distinct(), "adjacency")
    seen = scratch.save(start.select("id").distinct().withColumn("distance", F.lit(0)), "seen")
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = e.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        frontier = scratch.save(step.join(seen, "id", "left_anti").withColumn("distance", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    found = seen.where("distance > 0")
    return found if limit is None else found.orderBy("distance", "id").limit(limit)


def pagerank(edges: DataFrame, nodes: DataFrame, scratch: Scratch, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(id, rank): parallel edges count each, nodes without out-edges spread their rank over all. Ranks are written each
    round, as a round reads them twice and its plan would double with every one that is not."""
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    links = scratch.save(edges.groupBy("src", "dst").agg(F.count("*").alias("k")).join(out, "src").select("src", "dst", (F.col("k") / F.col("out")).alias("share")), "shares")
    hanging = scratch.save(nodes.select("id").join(out, F.col("id") == F.col("src"), "left_anti"), "hanging")
    ranks = nodes.select("id", F.lit(1.0 / n).alias("rank"))
    for _ in range(rounds):
        loose = ranks.join(hanging, "id", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        into = links.join(ranks, links["src"] == ranks["id"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("into"))
        new = nodes.select("id").join(into, F.col("id") == F.col("dst"), "left").crossJoin(F.broadcast(loose))  # one row
        ranks = new.select("id", ((1 - damping) / n + damping * (F.coalesce("into", F.lit(0.0)) + F.col("loose") / n)).alias("rank"))
        ranks = scratch.save(ranks, "ranks")
    return ranks


def reach(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): b can be reached from a by at least one edge. For module-sized graphs: paths double in length each round,
    until no pair is new."""
    paths = scratch.save(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), "paths")
    known = paths.count()
    while True:
        longer = paths.alias("p").join(paths.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        paths = scratch.save(paths.union(longer).distinct(), "paths")
        now = paths.count()
        if now == known:
            break
        known = now
    return paths


def strong_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): nodes on a cycle with the smallest node of their strongly connected component.

    Nodes that cannot lie on a cycle are trimmed round by round. Then every node takes the smallest label that reaches it
    (forward colouring); within a colour, the nodes from which its smallest node can be reached form one component. They
    go, and the rest starts anew until no cycle is left: each round settles at least one component per colour, with joins
    only.
    """
    left = scratch.save(edges.where("src <> dst").select("src", "dst").distinct(), "left")
    done: DataFrame | None = None
    while True:
        left = _trim(left, scratch)
        if left.isEmpty():
            break
        colour = _spread(left, left.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")), scratch)
        inside = left.join(colour.select(F.col("id").alias("src"), F.col("label").alias("c")), "src").join(colour.select(F.col("id").alias("dst"), F.col("label").alias("d")), "dst").where("c = d")
        inside = scratch.save(inside.select("src", "dst", F.col("c").alias("label")), "inside")
        found = _backward(inside, scratch)
        done = found if done is None else done.union(found)
        rest = left.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti")
        left = scratch.save(rest, "left")
    if done is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    sizes = done.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return done.join(sizes, "component", "left_semi").select("id", "component")


def _trim(edges: DataFrame, scratch: Scratch) -> DataFrame:
    n = edges.count()
    while n:
        edges = scratch.save(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"), "trimmed")
        now = edges.count()
        if now == n:
            break
        n = now
    return edges


def _spread(edges: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Smallest label that reaches each node."""
    labels = scratch.save(labels, "labels")
    while True:
        offered = edges.join(labels.select(F.col("id").alias("src"), F.col("label").alias("new")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("new").alias("new"))
        after = scratch.save(labels.join(offered, "id", "left").select("id", F.least("label", F.coalesce("new", "label")).alias("label"), (F.col("new") < F.col("label")).alias("moved")), "labels")
        labels = after.select("id", "label")
        if after.where("moved").isEmpty():
            return labels


def _backward(inside: DataFrame, scratch: Scratch) -> DataFrame:
    """Within each colour, what reaches the node that gave it its label."""
    roots = inside.select(F.col("label").alias("id"), F.col("label").alias("component")).distinct()
    seen = scratch.save(roots, "component")
    frontier = seen
    while True:
        step = inside.join(frontier.select(F.col("id").alias("dst"), F.col("component").alias("label")), ["dst", "label"]).select(F.col("src").alias("id"), F.col("label").alias("component")).distinct()
        frontier = scratch.save(step.join(seen, ["id", "component"], "left_anti"), "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)


def cycles(components: DataFrame, most: int = 50) -> DataFrame:
    """Cycles by size, then by their first path: (component, size, members)."""
    c = components.groupBy("component").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("id")).alias("members"))
    return c.orderBy(F.desc("size"), F.get("members", F.lit(0))).limit(most)


def shortest_cycle(edges: DataFrame, components: DataFrame, scratch: Scratch) -> DataFrame:
    """(component, length) of `cycle_paths`."""
    return cycle_paths(edges, components, scratch).select("component", "length")


def cycle_paths(edges: DataFrame, components: DataFrame, scratch: Scratch) -> DataFrame:
    """(component, length, path): the shortest cycle through each component's smallest node, which its path begins and ends
    with; of several the first in order. A component's search goes as deep as it has nodes."""
    inside = edges.where("src <> dst").join(components.select(F.col("id").alias("src"), "component"), "src").join(components.select(F.col("id").alias("dst"), F.col("component").alias("other")), "dst").where("component = other")
    inside = scratch.save(inside.select("src", "dst", "component").distinct(), "inside")
    at = scratch.save(components.select("component").distinct().select("component", F.col("component").alias("id"), F.array("component").alias("path")), "at")
    seen, found = at.select("component", "id"), None
    while True:
        step = inside.join(at.select(F.col("id").alias("src"), "component", "path"), ["src", "component"]).select("component", F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        step = scratch.save(step.groupBy("component", "id").agg(F.min("path").alias("path")), "step")  # one path to a node is enough
        closed = step.where("id = component").select("component", (F.size("path") - 1).alias("length"), "path")
        found = closed if found is None else found.union(closed)
        open_ = step.join(closed.select("component"), "component", "left_anti")
        at = scratch.save(open_.join(seen, ["component", "id"], "left_anti"), "at")
        if at.isEmpty():
            return found
        seen = seen.union(at.select("component", "id"))


def impact(edges: DataFrame, target: str, tests: DataFrame, scratch: Scratch, max_depth: int = 10, limit: int = 200) -> DataFrame:
    """(path, distance, relation) of what a change of a file touches: direct and transitive importers, and tests, which are
    files (path) that import it directly or not, or are named after it. edges: src imports dst."""
    from ..functions.text import source_stem, test_stem

    start = edges.sparkSession.createDataFrame([(target,)], "id string")
    back = bfs(edges, start, scratch, "in", max_depth, limit)
    is_test = tests.select(F.col("path").alias("id")).distinct().withColumn("test", F.lit(True))
    hit = back.join(is_test, "id", "left").select(F.col("id").alias("path"), "distance", F.when(F.col("test"), "test").when(F.col("distance") == 1, "direct").otherwise("transitive").alias("relation"))
    named = tests.where(test_stem(F.col("path")) == source_stem(F.lit(target))).select("path").distinct()
    named = named.join(hit.select("path"), "path", "left_anti").select("path", F.lit(None).cast("int").alias("distance"), F.lit("test by name").alias("relation"))
    return hit.union(named)


def find_symbols(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols of exactly this name, or, if there are none, of this name in any case."""
    exact = F.col("name") == name
    hits = symbols.where(F.lower("name") == name.lower()).withColumn("exact", exact)
    from pyspark.sql import Window as W

    return hits.withColumn("any_exact", F.max("exact").over(W.partitionBy(F.lower("name")))).where("exact = any_exact").drop("exact", "any_exact")


def callers(references: DataFrame, target_key: str, name: str) -> DataFrame:
    """Call sites of a symbol: resolved ones, then those known by name only, unless one is resolved at the same place."""
    resolved = references.where(F.col("target_key") == target_key).withColumn("resolved", F.lit(True))
    loose = references.where(F.col("target_key").isNull() & (F.col("name") == name)).withColumn("resolved", F.lit(False))
    return resolved.union(loose.join(resolved.select("path", "line"), ["path", "line"], "left_anti").select(resolved.columns))


def symbol_impact(references: DataFrame, edges: DataFrame, target_key: str, name: str, path: str) -> DataFrame:
    """(path, reason): files that call a symbol; only if no call is seen, files that import its file."""
    called = callers(references, target_key, name).select("path", F.lit("call").alias("reason")).distinct()
    imported = edges.where(F.col("dst") == path).select(F.col("src").alias("path"), F.lit("import").alias("reason")).distinct()
    some = called.limit(1).select(F.lit(1).alias("one"))
    return called.union(imported.join(F.broadcast(some), F.lit(True), "left_anti"))


def subgraph(edges: DataFrame, target: str, most: int = 60) -> DataFrame:
    """The target, its direct dependants (at most `most` nodes, by path) and the edges between them."""
    near = edges.where(F.col("dst") == target).select(F.col("src").alias("id")).distinct().orderBy("id").limit(most - 1)
    nodes = near.union(edges.sparkSession.createDataFrame([(target,)], "id string"))
    from .query import induced

    return induced(edges, nodes)


def related_config(files: DataFrame, manifests: DataFrame, path: str) -> DataFrame:
    """The nearest manifests above a file and the configuration beside it. files: path, kind. manifests: directory, manifest."""
    from ..functions.text import dir_of
    from .joins import nearest_ancestor

    one = files.where(F.col("path") == path)
    up = nearest_ancestor(one, manifests, "manifest").where("manifest is not null").select(F.col("manifest").alias("config"), F.lit("manifest").alias("why"))
    here = dir_of(F.lit(path))
    beside = files.where((F.col("kind") == "CONFIG") & (dir_of(F.col("path")) == here)).select(F.col("path").alias("config"), F.lit("same directory").alias("why"))
    return up.union(beside.join(up.select("config"), "config", "left_anti"))


def weighted_edges(imports: DataFrame, kinds: Column | None = None) -> DataFrame:
    """(src, dst, weight) of resolved imports between different files."""
    e = imports.where("to_path is not null and from_path <> to_path")
    e = e if kinds is None else e.where(kinds)
    return e.groupBy(F.col("from_path").alias("src"), F.col("to_path").alias("dst")).agg(F.count("*").alias("weight"))
