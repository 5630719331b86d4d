"""Plans and edits: validation against what exists, scope, exact-match edits and line diffs."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import plan_confidence
from ..functions.text import redact_secrets

FORBIDDEN = r"(?i)(?:^|/)(?:\.git|node_modules|dist|build|\.github/workflows)(?:/|$)|(?:^|/)\.env(?:\.|$)|\.(?:pem|key|p12|pfx|lock)$|(?:^|/)(?:package-lock\.json|pnpm-lock\.yaml)$|(?:^|/)\.\.(?:/|$)|^/"
MOST_LINES, CONTEXT = 4000, 3


def validate_plan(items: DataFrame, evidence: DataFrame, files: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plan items checked: (items with their certainty put right and text redacted, issues).

    items: plan, item, certainty, text, refs (array of evidence ids), path, symbol. Unknown references go and are errors;
    VERIFIED without any reference left becomes INFERRED with a warning; paths and symbols that don't exist are errors.
    """
    refs = items.select("plan", "item", F.explode_outer("refs").alias("ref"))
    known = refs.join(evidence.select(F.col("id").alias("ref")).distinct(), "ref", "left_semi").groupBy("plan", "item").agg(F.sort_array(F.collect_set("ref")).alias("kept"))
    d = items.join(known, ["plan", "item"], "left").withColumn("refs", F.coalesce("kept", F.array().cast("array<string>"))).drop("kept")
    weak = (F.col("certainty") == "VERIFIED") & (F.size("refs") == 0)
    issue = lambda df, level, code, what: df.select("plan", "item", F.lit(level).alias("level"), F.lit(code).alias("code"), what.alias("what"))
    issues = issue(refs.where("ref is not null").join(evidence.select(F.col("id").alias("ref")), "ref", "left_anti"), "error", "unknown-evidence", F.col("ref"))
    issues = issues.union(issue(d.where(weak), "warning", "verified-without-evidence", F.col("certainty")))
    issues = issues.union(issue(items.where("path is not null").join(files.select("path").distinct(), "path", "left_anti"), "error", "missing-file", F.col("path")))
    issues = issues.union(issue(items.where("symbol is not null").join(symbols.select(F.col("name").alias("symbol")).distinct(), "symbol", "left_anti"), "error", "missing-symbol", F.col("symbol")))
    fixed = d.withColumn("certainty", F.when(weak, "INFERRED").otherwise(F.col("certainty"))).withColumn("text", redact_secrets(F.col("text")))
    return fixed, issues


def confidence(plans: DataFrame, issues: DataFrame) -> DataFrame:
    """(plan, confidence): the model's own, less a tenth per error and three hundredths per warning."""
    n = issues.groupBy("plan").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return plans.join(n, "plan", "left").select("plan", plan_confidence(F.col("model"), zero("errors"), zero("warnings")).alias("confidence"))


def edit_scope(plan_files: DataFrame, files: DataFrame) -> DataFrame:
    """(path, action, state): what a plan may touch: edits of known files, new files, and neither on forbidden paths."""
    d = plan_files.join(files.select("path", F.lit(True).alias("exists")), "path", "left")
    state = F.when(F.col("path").rlike(FORBIDDEN), "forbidden").when((F.col("action") != "create") & F.col("exists").isNull(), "missing").when((F.col("action") == "create") & F.col("exists"), "exists already").otherwise("allowed")
    return d.select("path", "action", state.alias("state"))


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, state, text): edits (path, ordinal, find, replace) applied in order; each must match exactly once."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        text, state = pdf["text"].iloc[0], "applied"
        if text is None:
            return pd.DataFrame([(key[0], "no such file", None)], columns=["path", "state", "text"])
        for e in pdf.sort_values("ordinal").itertuples():
            n = text.count(e.find) if e.find else 0
            if n != 1:
                state = f"edit {e.ordinal}: {'not found' if n == 0 else f'{n} matches'}"
                break
            text = text.replace(e.find, e.replace, 1)
        return pd.DataFrame([(key[0], state, text if state == "applied" else None)], columns=["path", "state", "text"])

    return edits.join(files.select("path", "text"), "path", "left").groupBy("path").applyInPandas(run, "path string, state string, text string")


def unified(before: str, after: str, path: str) -> tuple[str, int, int]:
    """(diff, additions, deletions) by lines; beyond MOST_LINES lines a side the whole file is replaced."""
    a, b = before.split("\n"), after.split("\n")
    if max(len(a), len(b)) > MOST_LINES:
        lines = [f"--- a/{path}", f"+++ b/{path}", f"@@ -1,{len(a)} +1,{len(b)} @@", *("-" + x for x in a), *("+" + x for x in b)]
    else:
        lines = list(difflib.unified_diff(a, b, f"a/{path}", f"b/{path}", lineterm="", n=CONTEXT))
    body = lines[2:]
    return "\n".join(lines), sum(x.startswith("+") for x in body), sum(x.startswith("-") for x in body)


def line_diffs(pairs: DataFrame) -> DataFrame:
    """(path, diff, additions, deletions) of pairs (path, before, after); null counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r.path, *unified(r.before or "", r.after or "", r.path)) for r in pdf.itertuples()]
            yield pd.DataFrame(rows, columns=["path", "diff", "additions", "deletions"])

    return pairs.select("path", "before", "after").mapInPandas(run, "path string, diff string, additions int, deletions int")
