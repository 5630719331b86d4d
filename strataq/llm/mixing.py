"""Mixing sources to target weights by Pareto order sampling (native: no Python on the executors).

Every source gets a word target by water filling. Within a source a document's expected copies are in proportion to its
inclusion weight (the bits of its length in words, at most HEAVIEST, so scraps are drawn less often than full texts), up
to `most`, and such that the source's expected words are its target. The whole copies are certain; the fraction left is
the document's inclusion probability, and by it documents are drawn: they stand in the order of their random odds over
their inclusion odds, and the first ones are taken until the source's words come nearest to its target.

The order of a source is never sorted as a whole: the logarithm of the rank is cut into slots, slot totals are summed
first, and only the documents of the slot in which the target is reached are ordered one by one. What a join brings to
the documents has a row per source: it is broadcast where it is small, else dealt in salted copies, so no task holds a
source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, n_words

HEAVIEST = 8
#: Slots to a unit of the rank's logarithm: one holds at most 1 in 4 * SLOTS of the documents of a weight.
SLOTS, LEAST_LOG = 2048, -80
#: A table of sources is broadcast up to this many rows and characters; beyond, documents meet it in SALTS copies.
SMALL_ROWS, SMALL_CHARS, SALTS = 100_000, 8_000_000, 64
#: 13 hexadecimal digits of MD5 make a uniform number that any engine can recompute exactly.
DIGITS, SPAN = 13, 16.0**13


def uniform(id_col: Column, seed: str) -> Column:
    """A number strictly between 0 and 1, the same for an id on every run; a null id counts as empty."""
    text = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":" + seed))
    return (F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") + 0.5) / SPAN


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """(source, source_size, target): one row per source, null last. sizes: source, size.

    Sources in code-point order weigh `weights`, repeating, and share `percent` of all words. No target passes `most`
    times its source's words; what is over is shared again by weight until none is above. With every source sorted by
    the level at which it fills up, the full ones are a prefix, so one pass over the sources finds the level.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everywhere = W.partitionBy(F.lit(0))  # one row per source: far fewer than documents, and small
    w = F.get(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(everywhere.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)).cast("int"))
    d = total.withColumn("weight", w).withColumn("cap", most * F.col("source_size"))
    by_level = everywhere.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("all", F.sum("source_size").over(everywhere)).withColumn("weights", F.sum("weight").over(everywhere))
    left = F.col("all") * (percent / 100) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    d = d.withColumn("level", left / open_weight)
    d = d.withColumn("open", F.col("cap") > F.col("weight") * F.col("level"))
    # the first source that stays below its cap sets the level for all after it
    d = d.withColumn("final", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("final"), F.col("cap").cast("double")))
    return d.select("source", "source_size", target.alias("target"))


def _source(df: DataFrame) -> DataFrame:
    """Adds a join key that tells null sources from any text."""
    return df.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    return _source(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), *more))


def _met(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with their sources' row, whatever share of them one source holds. `sources` is a saved table."""
    n, chars = sources.agg(F.count("*"), F.coalesce(F.sum(F.length("skey")), F.lit(0))).first()
    if n <= SMALL_ROWS and chars <= SMALL_CHARS:
        return docs.join(F.broadcast(sources), "skey")
    salted = docs.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
    return salted.join(sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["skey", "salt"]).drop("salt")


def mix(docs: DataFrame, scratch: Scratch, seed: str = "mix", weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row of `docs`.

    Null text has size 0; documents of size 0 are taken 0 times. Null sources form one source, last in order. Rows with
    the same id, source and size are ties: they share one rank and are taken or left together. An empty table gives no
    rows. Other columns are ignored whatever their names. Reruns agree, as ranks depend on ids, sizes and `seed` alone.
    """
    sizes = scratch.save(_sized(docs, id_col, text_col, source_col), "sizes")
    copies = _copies(_met(sizes, _cuts(sizes, scratch, seed, weights, percent, most)), seed)
    return copies.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def repeated(docs: DataFrame, scratch: Scratch, seed: str = "mix", weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`docs` with every row as many times as `mix` takes it. A row's copies follow from the row and its source's cut, so
    rows are not matched by their ids, which may be null or repeat."""
    sizes = scratch.save(_sized(docs, id_col, text_col, source_col), "sizes")
    cuts = _cuts(sizes, scratch, seed, weights, percent, most)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    taken = _copies(_met(_sized(docs, id_col, text_col, source_col, row), cuts), seed)
    # rows not taken go after the generator: a filter before it would become part of the join and work all of this out again
    copies = F.explode_outer(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int"))))
    taken = taken.select("row", copies.alias("copy")).where("copy is not null")
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def inclusion_weight(size: Column) -> Column:
    return F.least(F.length(F.bin(size)), F.lit(HEAVIEST)).cast("int")


def expected_copies(sizes: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """`targets` with a map `by_weight` from inclusion weight to (whole, share), and the words `want` that are left to draw.

    With a source's weights in falling order those that reach `most` copies come first, so one pass finds the factor that
    brings all others to the target. There are at most HEAVIEST rows to a source.
    """
    d = sizes.where("size > 0").groupBy("skey", inclusion_weight(F.col("size")).alias("weight")).agg(F.sum("size").alias("words"))
    d = d.join(targets.select("skey", "target"), "skey")
    falling = W.partitionBy("skey").orderBy(F.col("weight").desc())
    before, after = falling.rowsBetween(W.unboundedPreceding, -1), falling.rowsBetween(W.currentRow, W.unboundedFollowing)
    factor = (F.col("target") - most * F.coalesce(F.sum("words").over(before), F.lit(0))) / F.sum(F.col("weight") * F.col("words")).over(after)
    d = d.withColumn("factor", factor).withColumn("open", most > F.col("weight") * F.col("factor"))
    d = d.withColumn("final", F.first(F.when(F.col("open"), F.col("factor")), ignorenulls=True).over(falling.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    copies = F.least(F.lit(float(most)), F.coalesce(F.col("weight") * F.col("final"), F.lit(float(most))))
    d = d.withColumn("copies", copies).withColumn("whole", F.floor("copies"))
    found = d.groupBy("skey").agg(
        F.map_from_entries(F.collect_list(F.struct("weight", F.struct("whole", (F.col("copies") - F.col("whole")).alias("share"))))).alias("by_weight"),
        F.sum(F.col("whole") * F.col("words")).alias("certain"),
    )
    return targets.join(found, "skey", "left").withColumn("want", F.col("target") - F.coalesce("certain", F.lit(0)))


def _cuts(sizes: DataFrame, scratch: Scratch, seed: str, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """A row per source: its target, what its documents' weights come to and where its order is cut."""
    targets = scratch.save(_source(source_targets(sizes, weights, percent, most)).drop("source"), "targets")
    targets = scratch.save(expected_copies(sizes, targets, most), "copies")
    drawn = _ranked(_met(sizes, targets), seed).where("rank is not null")
    slots = drawn.groupBy("skey", "slot").agg(F.sum("size").alias("slot_size"), F.first("want").alias("want"))
    running = W.partitionBy("skey").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)  # slots, whose number is bounded
    slots = slots.withColumn("before", F.coalesce(F.sum("slot_size").over(running), F.lit(0)))
    edge = slots.where((F.col("before") < F.col("want")) & (F.col("before") + F.col("slot_size") >= F.col("want")))
    edge = scratch.save(edge.select("skey", F.col("slot").alias("edge_slot"), "before"), "edges")
    # inside the edge slot: documents in order, ties together; the last one is taken if that comes nearer
    inside = _met(drawn, edge).where("slot = edge_slot")
    ties = inside.groupBy("skey", "want", "before", "rank", "doc_id").agg(F.sum("size").alias("tied"))
    order = W.partitionBy("skey").orderBy("rank", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    ties = ties.withColumn("at", F.col("before") + F.coalesce(F.sum("tied").over(order), F.lit(0)))
    ties = ties.where("at < want and at + tied - want <= want - at")
    last = ties.groupBy("skey").agg(F.max(F.struct("rank", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"))).alias("last"))
    return scratch.save(targets.join(edge, "skey", "left").join(last, "skey", "left").drop("before"), "cuts")


def _ranked(d: DataFrame, seed: str) -> DataFrame:
    """Adds whole copies, the inclusion probability `share`, and for those that are drawn their Pareto rank and its slot."""
    found = F.when(F.col("size") > 0, F.col("by_weight")[inclusion_weight(F.col("size"))])
    d = d.withColumn("whole", F.coalesce(found["whole"], F.lit(0))).withColumn("share", F.coalesce(found["share"], F.lit(0.0)))
    u, share = uniform(F.col("doc_id"), seed), F.col("share")
    d = d.withColumn("rank", F.when(share > 0, u / (1 - u) / (share / (1 - share))))
    return d.withColumn("slot", F.floor((F.log("rank") - LEAST_LOG) * SLOTS).cast("int"))


def _copies(d: DataFrame, seed: str) -> DataFrame:
    """Rows joined with their sources' cuts, with how often each is taken."""
    d = _ranked(d, seed)
    here = F.struct("rank", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"))
    first = F.col("edge_slot").isNull() | (F.col("slot") < F.col("edge_slot")) | ((F.col("slot") == F.col("edge_slot")) & F.coalesce(here <= F.col("last"), F.lit(False)))
    extra = F.col("rank").isNotNull() & (F.col("want") > 0) & first
    return d.withColumn("copies", (F.col("whole") + F.when(extra, 1).otherwise(0)).cast("long"))


#: The same in DuckDB SQL, from the documents on; the operator's ranks are recomputed from MD5.
ORACLE = r"""
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
t0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
t1 AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM t0),
t2 AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)::DOUBLE)
         / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
       FROM t1 WINDOW b AS (ORDER BY cap::DOUBLE / weight::DOUBLE, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT min_by(level, cap::DOUBLE / weight::DOUBLE) FILTER (cap::DOUBLE > weight::DOUBLE * level) AS final FROM t2),
t3 AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(weight::DOUBLE * final, cap::DOUBLE)) AS target FROM t2, lv),
c0 AS (SELECT s.source, least(length(bin(size)), 8)::BIGINT AS weight, sum(size)::BIGINT AS words FROM s WHERE size > 0 GROUP BY 1, 2),
c1 AS (SELECT c0.*, target, (target - (2 * coalesce(sum(words) OVER (PARTITION BY c0.source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE)
         / (sum(weight * words) OVER (PARTITION BY c0.source ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS factor
       FROM c0 JOIN t3 ON c0.source IS NOT DISTINCT FROM t3.source),
c2 AS (SELECT *, max_by(factor, weight) FILTER (2 > weight::DOUBLE * factor) OVER (PARTITION BY source) AS final FROM c1),
c3 AS (SELECT *, least(2::DOUBLE, coalesce(weight::DOUBLE * final, 2::DOUBLE)) AS expected FROM c2),
c4 AS (SELECT *, floor(expected)::BIGINT AS whole, expected - floor(expected) AS share FROM c3),
c5 AS (SELECT source, sum(whole * words)::BIGINT AS certain FROM c4 GROUP BY source),
r0 AS (SELECT s.*, source_size, t3.target, coalesce(whole, 0) AS whole, coalesce(share, 0) AS share, t3.target - coalesce(certain, 0)::DOUBLE AS want,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
       FROM s JOIN t3 ON s.source IS NOT DISTINCT FROM t3.source LEFT JOIN c5 ON s.source IS NOT DISTINCT FROM c5.source
       LEFT JOIN c4 ON s.source IS NOT DISTINCT FROM c4.source AND s.size > 0 AND least(length(bin(s.size)), 8) = c4.weight),
r1 AS (SELECT *, CASE WHEN share > 0 THEN u / (1 - u) / (share / (1 - share)) END AS rank FROM r0),
r2 AS (SELECT *, coalesce(sum(CASE WHEN share > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS begun FROM r1),
r3 AS (SELECT *, whole + (share > 0 AND begun < want AND begun + size - want <= want - begun)::BIGINT AS copies FROM r2)
SELECT doc_id, size, source_size, target, copies::BIGINT AS copies, (copies * size)::BIGINT AS taken FROM r3
"""
