"""One text looked at again, as after an edit: secrets, insecure calls and whether it still parses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import secret_rules
from ..sources import brace_code, files, python_code
from ..sources.parse import parsed


def inspected(texts: DataFrame) -> DataFrame:
    """(path, rule_id, severity, line) of texts (path, text): secrets everywhere, insecure calls in source only, and
    `syntax/error` for Python that doesn't parse. A byte-order mark is passed over."""
    t = texts.withColumn("text", F.regexp_replace("text", "^﻿", "")).withColumn("language", files.language_of(F.col("path")))
    t = t.withColumn("kind", files.kind_of(F.col("path"), F.col("language"), F.lit(False)))
    lines = t.select("path", "kind", F.posexplode(F.split("text", "\n")).alias("at", "text")).select("path", "kind", (F.col("at") + 1).alias("line"), "text")
    columns = ["path", "rule_id", "severity", "line"]
    source = t.where("kind = 'SOURCE'")
    security = ~F.col("rule_id").rlike("^(?:smell|dead-code)/")
    python = t.where("language = 'python' and kind in ('SOURCE', 'TEST')")
    broken = parsed(python, python_code.metrics, python_code.METRICS).where("error").select("path", F.lit("syntax/error").alias("rule_id"), F.lit("HIGH").alias("severity"), F.lit(None).cast("int").alias("line"))
    return (
        secret_rules.scan_lines(lines).select(*columns)
        .union(parsed(source.where("language = 'python'"), python_code.insecure, python_code.FINDINGS).select(*columns))
        .union(parsed(source.where("language <> 'python'"), brace_code.findings, brace_code.FINDINGS).where(security).select(*columns))
        .union(broken)
    )


def new_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings of edited texts (path, text) that the texts before the edit had not, counted by path and rule."""
    count = lambda df, name: inspected(df).groupBy("path", "rule_id").agg(F.count("*").alias(name))
    d = count(after, "now").join(count(before, "then"), ["path", "rule_id"], "left")
    return d.withColumn("added", F.col("now") - F.coalesce("then", F.lit(0))).where("added > 0").select("path", "rule_id", "added")
