"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the next
stage's docs. All stages but the last keep the columns of the documents table.

1. quality: documents that the classifier rates below the grade "good" go.
2. near_duplicates: of each group of near copies (five-word shingles, similarity 0.8) the smallest id stays.
3. secrets: secrets are replaced in the text; every document stays.
4. mixing: sources are brought to their targets; a document taken twice becomes two rows.
5. packing: the rows' token ids are packed into sequences; the result has a row per piece, with its ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm import mixing, near_dups, packing, quality, secret_scan
from strataq.llm.common import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose probability of the highest grade is at least one half. Labels come from the labels table; where
    none fits, every row with words stays. Null and wordless texts have the lowest grade and go; repeated rows are judged
    alike, null ids and sources like others. An empty table gives no rows, and more columns are left out."""
    model = quality.fit(docs, quality.ratings(table(spark, sf_dir, "labels")), grades=3)
    graded = quality.classify(docs, model, wanted=2, names=("_expected_grade", "_tail_probability"))
    return graded.where("_tail_probability >= 0.5").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that of the smallest id, of rows that share it the one with the smallest
    hash of its text.

    Rows that share an id but not a text are judged by their texts; of rows that share both, one stays. Rows with a null id
    are linked with nothing, so of them only repeated texts go. Null, empty and wordless texts are no copies of others.
    An empty table gives no rows, and more columns are left out.
    """
    scratch = Scratch(spark)
    found = scratch.save(near_dups.near_duplicates(docs, scratch, size=5, percent=80).select("doc_id", "text_key", "group"), "groups")
    row = F.struct(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    rows = found.groupBy("doc_id", "text_key").agg(F.first("group").alias("group"), F.count("*").alias("n"))
    first = found.where("group is not null").groupBy("group").agg(F.min(row).alias("first"), F.count("*").alias("size"))
    first = scratch.save(first.where("size > 1"), "first")
    hot = near_dups.hot_keys(first, "group", "size")
    gone = near_dups.joined_by(rows.where("group is not null"), first.drop("size"), "group", hot).where(row != F.col("first")).select("doc_id", "text_key")
    gone = scratch.save(gone, "gone")
    repeated = scratch.save(rows.where("n > 1").select("doc_id", "text_key"), "repeated")
    left = docs.select(*COLUMNS).withColumn("text_key", F.xxhash64("text"))
    left = left.join(gone, ["doc_id", "text_key"], "left_anti")  # ids of `gone` are never null
    if repeated.isEmpty():
        return left.select(*COLUMNS)
    same = [left.doc_id.eqNullSafe(repeated.doc_id), left.text_key == repeated.text_key]
    once = left.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text_key"])
    return left.join(repeated, same, "left_anti").union(once).select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts, found with the words of these texts as dictionary; every row stays, null and empty
    texts as they are, and n_chars follows the text. An empty table gives no rows, and more columns are left out."""
    detector = secret_scan.train(words=secret_scan.dictionary(docs, Scratch(spark)))
    return secret_scan.redact(docs.select(*COLUMNS), detector).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it, whether its id is null or repeats. Rows without words are taken 0 times.
    An empty table gives no rows, and more columns are left out."""
    return mixing.repeated(docs.select(*COLUMNS), Scratch(spark))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all rows. A null or empty text is its end id alone; a very long one is cut into pieces; rows that
    share an id are packed each. An empty table gives no rows, and other columns are ignored whatever their names."""
    return packing.pack(docs, most_pieces=1 << 18)  # beside what earlier stages leave in the workers


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the classifier nor the tokenizer; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared scratch folder and read again."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs, before = stage(spark, docs, sf_dir), docs
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, name)
            scratch.drop(before)
    return docs
