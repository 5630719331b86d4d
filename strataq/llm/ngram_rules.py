"""Quality rules: repetition counts plus a hashed n-gram log-likelihood ratio (native: no Python on the executors).

The ratio compares two multinomials over hashed word unigrams and bigrams: one of trusted documents, one of the whole
corpus. A document's score is its mean log ratio per n-gram, so that length plays no part, and one fixed threshold
decides every document alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import literal_doubles, words

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS, REPEAT_PERCENT = 20, 30


def _pairs(hashes: str, size: Column, step: int) -> Column:
    """Hash of each element with the one `step` places on; from hashes of runs of `step` words to runs of twice that."""
    left = F.greatest(size - step, F.lit(0))
    return F.when(
        left > 0,
        F.zip_with(F.slice(hashes, 1, left), F.slice(hashes, step + 1, left), lambda a, b: F.xxhash64(a, b)),
    ).otherwise(F.array().cast("array<bigint>"))


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, h, h2, *extra): 64-bit hashes of each word and of each run of two words, in reading order."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *extra)
    base = base.withColumn("h", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
    return base.withColumn("h2", _pairs("h", F.size("h"), 1))


def _buckets(buckets: int) -> Column:
    return F.transform(F.concat("h", "h2"), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))


def fit_log_ratio(docs: DataFrame, trusted: DataFrame, buckets: int = 16384, fit_rows: int = 20000, alpha: float = 0.5) -> list[float]:
    """Log ratio per bucket, trusted over raw. Raw counts cover every document; the trusted side is a bounded sample.

    docs: doc_id, text. trusted: doc_id of labelled good documents; null and repeated ids count once. At most `fit_rows`
    of them are used (those with the smallest id hash), which bounds what is broadcast: fit_rows ids.
    No trusted documents or an empty corpus: all ratios are 0.
    """
    ids = trusted.select(F.col("doc_id").alias("trusted_id")).where("trusted_id is not null").distinct()
    ids = ids.orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(fit_rows)
    flagged = hashed(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("trusted_id"), "left")
    counts = (
        flagged.select(F.explode(_buckets(buckets)).alias("bucket"), F.col("trusted_id").isNotNull().cast("int").alias("t"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("t").alias("good"))
        .collect()  # at most `buckets` rows
    )
    raw, good = [0] * buckets, [0] * buckets
    for row in counts:
        raw[row["bucket"]], good[row["bucket"]] = row["raw"], row["good"]
    if not sum(good):
        return [0.0] * buckets
    all_raw, all_good = sum(raw) + alpha * buckets, sum(good) + alpha * buckets
    return [round(math.log((g + alpha) / all_good) - math.log((r + alpha) / all_raw), 5) for g, r in zip(good, raw, strict=True)]


def quality_rules(docs: DataFrame, ratios: list[float], threshold: float = -0.07, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts, the base verdict, the score and whether the row is kept.

    Null or wordless text: all counts 0, base_failed. Repeated rows each get their own row. Other columns of `docs` are
    ignored whatever their names. A word run counts as repeated if its 64-bit hash recurs in the text.
    """
    m = len(ratios)
    text = F.coalesce("text", F.lit(""))
    d = hashed(docs, id_col, text_col)
    d = d.withColumn("n", F.size("h")).withColumn("h4", _pairs("h2", F.size("h2"), 2))
    d = d.withColumn("h8", _pairs("h4", F.size("h4"), 4)).withColumn("grams", _buckets(m))
    d = d.withColumn("lines", F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE, "") != ""))
    d = d.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.aggregate("grams", F.lit(0.0), lambda acc, b: acc + F.get(literal_doubles(ratios), b)) / F.greatest(F.size("grams"), F.lit(1))).alias("score"),
        # only texts in which some window recurs go through the sort
        F.when(
            F.size(F.array_distinct("h8")) < F.size("h8"),
            F.sort_array(F.transform("h8", lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
        ).alias("runs"),
    )
    same = lambda e, j: (e["x"] == F.get("runs", j - 1)["x"]) | (e["x"] == F.get("runs", j + 1)["x"])
    d = d.withColumn("found", F.sort_array(F.filter(F.transform("runs", lambda e, j: F.when(F.coalesce(same(e, j), F.lit(False)), e["i"])), lambda p: p.isNotNull())))
    covered = F.transform("found", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("found", k + 1) - p, F.lit(WINDOW))))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    d = d.withColumn("base_failed", failed)
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"), F.round("score", 6).alias("score"),
    )
