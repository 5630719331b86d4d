"""Reports of runs: outcome, chain, timeline, identity and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean_text

ACTIVE = ("QUEUED", "MATERIALIZING", "GENERATING", "VALIDATING", "APPLYING", "INSTALLING", "TESTING", "REPAIRING")
TIMELINE = 150


def last_test(executions: DataFrame) -> DataFrame:
    """(run_id, tests): passed if the run's last test ended with code 0 and in time, else failed."""
    last = executions.where("kind = 'TEST'").groupBy("run_id").agg(F.max_by(F.struct("exit_code", "timed_out"), F.struct("started_at", "id")).alias("t"))
    return last.select("run_id", F.when((F.col("t.exit_code") == 0) & ~F.col("t.timed_out"), "passed").otherwise("failed").alias("tests"))


def outcome_of(type_: Column, status: Column, tests: Column) -> Column:
    """The outcome of a report; success is never claimed without a test that passed."""
    run = (
        F.when(status == "READY_FOR_REVIEW", F.when(tests == "passed", "TESTS_PASSED").when(tests == "failed", "TESTS_FAILED").otherwise("NOT_TESTED"))
        .when(status.isin("DISCARDED", "FAILED", "CANCELLED", "AWAITING_APPROVAL"), status).otherwise("IN_PROGRESS")
    )
    return F.when(type_ == "RUN", run).when(status.isin("COMPLETED", "FAILED"), status).otherwise("IN_PROGRESS")


def report_status(outcome: Column) -> Column:
    return F.when(outcome.isin("IN_PROGRESS", "AWAITING_APPROVAL"), "PARTIAL").otherwise("COMPLETE")


def outcomes(subjects: DataFrame, executions: DataFrame) -> DataFrame:
    """subjects (run_id, type, status) with outcome and report status."""
    d = subjects.join(last_test(executions), "run_id", "left").withColumn("outcome", outcome_of(F.col("type"), F.col("status"), F.col("tests")))
    return d.withColumn("report_status", report_status(F.col("outcome")))


def chain(subjects: DataFrame) -> DataFrame:
    """(run_id, step, name, state): analysis, plan, changes, tests, review, each done, failed, pending or not done."""
    steps = ("analysis", "plan", "changes", "tests", "review")
    states = {
        "analysis": F.lit("done"),
        "plan": F.when(F.col("type") == "ANALYSIS", "not done").otherwise("done"),
        "changes": F.when(F.col("type") != "RUN", "not done").when(F.col("outcome") == "FAILED", "failed").when(F.col("outcome") == "IN_PROGRESS", "pending").otherwise("done"),
        "tests": F.when(F.col("tests") == "passed", "done").when(F.col("tests") == "failed", "failed").when(F.col("outcome") == "IN_PROGRESS", "pending").otherwise("not done"),
        "review": F.when(F.col("outcome").isin("TESTS_PASSED", "TESTS_FAILED", "NOT_TESTED"), "pending").when(F.col("outcome") == "DISCARDED", "done").otherwise("not done"),
    }
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(s).alias("name"), states[s].alias("state")) for i, s in enumerate(steps)])
    return subjects.select("run_id", F.explode(rows).alias("r")).select("run_id", "r.*")


def timeline(events: DataFrame, most: int = TIMELINE) -> DataFrame:
    """The last `most` events of each run, in ascending order, texts cleaned."""
    n = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("created_at"), F.desc("event_id")))
    d = events.withColumn("n", n).where(F.col("n") <= most)
    return d.withColumn("position", F.row_number().over(W.partitionBy("run_id").orderBy("created_at", "event_id"))).withColumn("message", clean_text(F.col("message"), 200)).drop("n")


def duration(start: Column, end: Column) -> Column:
    """Milliseconds, null while one end is open, never below 0."""
    took = F.unix_millis(end) - F.unix_millis(start)
    return F.when(took.isNotNull(), F.greatest(F.lit(0), took))  # greatest passes over nulls


def new_reports(reports: DataFrame, stored: DataFrame) -> DataFrame:
    """Reports whose body is not stored for their subject yet, each body once; the fingerprint leaves the time out."""
    body = F.sha2(F.to_json(F.struct(*[c for c in reports.columns if c not in ("generated_at", "id")])), 256)
    d = reports.withColumn("fingerprint", body)
    first = W.partitionBy("subject_key", "fingerprint").orderBy("generated_at", "id")
    d = d.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return d.join(stored.select("subject_key", "fingerprint"), ["subject_key", "fingerprint"], "left_anti")


def as_markdown(findings: DataFrame) -> DataFrame:
    """One line of Markdown per finding, with characters that Markdown reads escaped; to be written as text."""
    escaped = lambda c: F.regexp_replace(clean_text(F.col(c), 400), r"([\\`*_{}\[\]<>#|])", r"\\$1")
    return findings.select(F.concat(F.lit("- **"), F.col("severity"), F.lit("** "), escaped("title"), F.lit(" ("), escaped("path"), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("?")), F.lit(")")).alias("value"))
