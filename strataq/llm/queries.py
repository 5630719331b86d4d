"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import language, mixing, near_dups, ngram_rules, packing, quality, secret_scan, token_files, topk, warc
from .common import Scratch, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_digest(packing.pack(table(spark, sf_dir, "documents")))


def op2_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark), size=2, percent=80)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.learn_and_identify(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.ratings(table(spark, sf_dir, "labels")), grades=3)
    graded = quality.classify(docs, model, wanted=2)
    return graded.select("doc_id", "expected_grade", "tail_probability", (graded.tail_probability >= 0.5).alias("kept"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"), Scratch(spark))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), Scratch(spark))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ratios = ngram_rules.fit_log_ratio(docs, labels.where("quality = 1 and toxic = 0"))
    return ngram_rules.quality_rules(docs, ratios).drop("score")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.train(words=secret_scan.dictionary(docs, Scratch(spark))))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), Scratch(spark))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_packing, op2_near_dups, op3_language_id, op4_quality_classifier, op5_warc, op6_exact_topk, op7_quality_rules, op8_secret_scan,
        op9_mixing, op10_token_files, pipeline,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op9_mixing": mixing.ORACLE}
