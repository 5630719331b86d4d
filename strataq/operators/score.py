"""Health score: capped penalties per dimension, weighted over the dimensions that apply, limited by the worst finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import SEVERITIES, grade, round_half_up

# Fixed values: (dimension, weight, categories, penalties are per thousand lines).
DIMENSIONS = (
    ("security", 25, ("SECRET", "SECURITY"), False),
    ("codeQuality", 15, ("CODE_QUALITY",), True),
    ("dependencies", 15, ("DEPENDENCY",), False),
    ("testing", 15, ("TESTING",), False),
    ("architecture", 10, ("ARCHITECTURE",), True),
    ("documentation", 10, ("DOCUMENTATION",), False),
    ("api", 5, ("API",), False),
    ("database", 5, ("DATABASE",), False),
)
PENALTY = {"CRITICAL": 30, "HIGH": 15, "MEDIUM": 6, "LOW": 2, "INFO": 0}
CAP = {"CRITICAL": 60, "HIGH": 45, "MEDIUM": 30, "LOW": 15, "INFO": 0}
FIXED = {"testing/no-tests": 80, "documentation/missing-readme": 40}
DUPLICATION_FREE, DUPLICATION_MOST = 5, 15
LIMITS = {"CRITICAL": 49, "HIGH": 69}
ALWAYS = ("security", "documentation")


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def dimension_of(category: Column) -> Column:
    return F.try_element_at(_map({c: d for d, _, cs, _ in DIMENSIONS for c in cs}), category)


def dimension_scores(findings: DataFrame, subjects: DataFrame, excluded: DataFrame) -> DataFrame:
    """(subject, dimension, weight, applies, score) of every subject and dimension; the score is null where it doesn't apply.

    findings: subject, rule_id, category, severity, fingerprint. subjects: subject, lines (production code), duplication
    (percent), present (dimensions whose matter was found). excluded: fingerprints that were triaged; they cost nothing,
    but still show that their dimension applies.
    """
    f = findings.withColumn("dimension", dimension_of(F.col("category"))).where("dimension is not null")
    applies = f.select("subject", "dimension").distinct().withColumn("has_findings", F.lit(True))
    live = f.join(excluded.select("fingerprint").distinct(), "fingerprint", "left_anti").withColumn("fixed", F.try_element_at(_map(FIXED), F.col("rule_id")))
    counts = live.where("fixed is null").groupBy("subject", "dimension", "severity").agg(F.count("*").alias("n"))
    fixed = live.where("fixed is not null").groupBy("subject", "dimension").agg(F.sum("fixed").alias("fixed"))
    table = findings.sparkSession.createDataFrame([(d, w, k) for d, w, _, k in DIMENSIONS], "dimension string, weight int, per_kloc boolean")
    s = subjects.withColumn("kloc", F.greatest(F.lit(1.0), F.col("lines") / 1000.0))
    c = counts.join(table, "dimension").join(s.select("subject", "kloc"), "subject")
    n = F.col("n") / F.when(F.col("per_kloc"), F.col("kloc")).otherwise(1.0)
    points = round_half_up(F.least(F.element_at(_map(CAP), F.col("severity")).cast("double"), F.element_at(_map(PENALTY), F.col("severity")) * n), 1)
    lost = c.withColumn("points", points).groupBy("subject", "dimension").agg(F.sum("points").alias("lost"))
    d = s.crossJoin(F.broadcast(table))  # eight constant rows
    d = d.join(lost, ["subject", "dimension"], "left").join(fixed, ["subject", "dimension"], "left").join(applies, ["subject", "dimension"], "left")
    surcharge = F.when((F.col("dimension") == "codeQuality") & (F.col("duplication") > DUPLICATION_FREE), round_half_up(F.least(F.lit(float(DUPLICATION_MOST)), F.col("duplication") - DUPLICATION_FREE), 1)).otherwise(0.0)
    total = F.coalesce("lost", F.lit(0.0)) + F.coalesce("fixed", F.lit(0)) + surcharge
    score = F.greatest(F.lit(0), round_half_up(100 - F.least(F.lit(100.0), total)).cast("int"))
    uses = F.coalesce("has_findings", F.lit(False)) | F.array_contains("present", F.col("dimension")) | F.col("dimension").isin(*ALWAYS)
    return d.select("subject", "dimension", "weight", uses.alias("applies"), F.when(uses, score).alias("score"))


def health(findings: DataFrame, subjects: DataFrame, excluded: DataFrame) -> DataFrame:
    """(subject, score, grade): the weighted mean of the dimensions that apply, at most 49 with a live critical and 69 with
    a live high finding of security or secrets."""
    d = dimension_scores(findings, subjects, excluded).where("applies")
    mean = d.groupBy("subject").agg(round_half_up(F.sum(F.col("weight") * F.col("score")) / F.sum("weight").cast("double")).cast("int").alias("mean"))
    live = findings.where(F.col("category").isin("SECRET", "SECURITY")).join(excluded.select("fingerprint").distinct(), "fingerprint", "left_anti")
    worst = live.groupBy("subject").agg(F.min(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))).alias("worst"))
    limit = F.when(F.col("worst") == 1, LIMITS["CRITICAL"]).when(F.col("worst") == 2, LIMITS["HIGH"]).otherwise(100)
    out = mean.join(worst, "subject", "left").withColumn("score", F.least("mean", limit))
    return out.select("subject", "score", grade(F.col("score")).alias("grade"))
