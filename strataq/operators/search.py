"""Keyword search with weights, and bundles of numbered evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import base_of, similarity, tokens

# Words that a question holds but that name nothing.
STOP_WORDS = "find where what which who show list get me all the of for in on to and or is are a an how does do defined definition implementation implemented implements code function functions method methods file files class classes used uses using called calls".split()
NAME_WEIGHT, PATH_WEIGHT, ROUTE_WEIGHT, EXPORTED = 2.0, 0.5, 1.5, 0.5
LIMITS = {"symbol": 40, "import": 6, "dependant": 6, "test": 12, "config": 10, "package": 15, "finding": 20, "route": 12}
MOST_FILES, MOST_EVIDENCE = 12, 150


def query_terms(question: str) -> list[str]:
    """The words of a question that are searched for, in order, each once (on the driver: one short string)."""
    import re

    plain = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", question)).lower()
    found = [w for w in re.split(r"[^a-z0-9]+", plain) if len(w) >= 2 and w not in STOP_WORDS]
    return list(dict.fromkeys(found))


def _word_scores(items: DataFrame, terms: list[str], weights: dict[str, float]) -> DataFrame:
    """(id, words): per term the best similarity to a word of each column, weighted and summed."""
    words = reduce(DataFrame.union, [items.select("id", F.lit(w).alias("weight"), F.explode(tokens(F.col(c))).alias("word")) for c, w in weights.items()])
    best = words.groupBy("id", "weight").agg(*[F.max(similarity(F.lit(t), F.col("word"))).alias(f"t{k}") for k, t in enumerate(terms)])
    total = reduce(lambda a, b: a + b, [F.col(f"t{k}") for k in range(len(terms))])
    return best.groupBy("id").agg(F.sum(F.col("weight") * total).alias("words"))


def keyword_search(items: DataFrame, question: str, limit: int = 25, threshold: float = 2.0) -> DataFrame:
    """Symbols (id, name, path, exported, line) by score: per term the best similarity to a word of the name, twice, and to a
    word of the path, half; half a point more for exported ones. What scores below the threshold is left out.
    """
    terms = query_terms(question)
    if not terms:
        return items.withColumn("score", F.lit(0.0)).limit(0)
    scored = _word_scores(items, terms, {"name": NAME_WEIGHT, "path": PATH_WEIGHT})
    d = items.join(scored, "id").withColumn("score", F.col("words") + F.when(F.col("exported"), EXPORTED).otherwise(0.0)).drop("words")
    return d.where(F.col("score") >= threshold).orderBy(F.desc("score"), "path", F.col("line").asc_nulls_last(), "name", "id").limit(limit)


def search_everything(symbols: DataFrame, files: DataFrame, routes: DataFrame, question: str, limit: int = 25) -> DataFrame:
    """(type, score, path, line, name) of symbols, files (path, kind) of source and tests, and routes (method, route, path,
    line), best first. Files count their path's words once, routes one and a half times; both need a score of 3."""
    terms = query_terms(question)
    found = keyword_search(symbols, question, limit).select(F.lit("symbol").alias("type"), "score", "path", "line", "name")
    if not terms:
        return found
    f = files.where(F.col("kind").isin("SOURCE", "TEST")).withColumn("id", F.col("path"))
    f = f.join(_word_scores(f, terms, {"path": 1.0}), "id").where("words >= 3").select(F.lit("file"), "words", "path", F.lit(None).cast("int"), base_of(F.col("path")))
    r = routes.withColumn("id", F.struct("method", "route", "path", "line"))
    r = r.join(_word_scores(r, terms, {"route": ROUTE_WEIGHT}), "id").where("words >= 3").select(F.lit("route"), "words", "path", "line", F.concat_ws(" ", "method", "route"))
    return found.union(f).union(r).orderBy(F.desc("score"), "path", F.col("line").asc_nulls_first(), "name").limit(limit)


def evidence_bundle(hits: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """Evidence E1, E2, ... about the best files of a search: (ref, kind, path, summary).

    hits: path, score. parts: for each kind rows (path, of, summary), `of` the file they belong to. Files come in order of
    their best hit; every kind has its limit per bundle; what repeats kind, path and summary counts once.
    """
    files = hits.groupBy("path").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "path").limit(MOST_FILES)
    ranked = files.withColumn("file_rank", F.row_number().over(W.orderBy(F.desc("score"), "path")))  # at most MOST_FILES rows
    rows = []
    for order, (kind, df) in enumerate(parts.items()):
        r = df.join(ranked.select(F.col("path").alias("of"), "file_rank"), "of")
        r = r.select(F.lit(order).alias("kind_order"), F.lit(kind).alias("kind"), "path", "summary", "file_rank").groupBy("kind_order", "kind", "path", "summary").agg(F.min("file_rank").alias("file_rank"))
        n = F.row_number().over(W.partitionBy("kind").orderBy("file_rank", "path", "summary"))
        rows.append(r.withColumn("n", n).where(F.col("n") <= LIMITS.get(kind, 20)))
    found = reduce(DataFrame.union, rows)
    top = found.orderBy("file_rank", "kind_order", "path", "summary").limit(MOST_EVIDENCE)
    ref = F.row_number().over(W.orderBy("file_rank", "kind_order", "path", "summary"))  # at most MOST_EVIDENCE rows
    return top.withColumn("ref", F.concat(F.lit("E"), ref.cast("string"))).select("ref", "kind", "path", "summary")
