"""Run lifecycles, idempotence, rate limits and windows, as batch columns and as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The states of a run and what may follow each.
NEXT = {
    "QUEUED": ("MATERIALIZING",),
    "MATERIALIZING": ("GENERATING",),
    "GENERATING": ("VALIDATING",),
    "VALIDATING": ("APPLYING", "REPAIRING", "READY_FOR_REVIEW"),
    "APPLYING": ("AWAITING_APPROVAL", "INSTALLING", "TESTING", "READY_FOR_REVIEW"),
    "AWAITING_APPROVAL": ("INSTALLING", "TESTING", "READY_FOR_REVIEW"),
    "INSTALLING": ("TESTING",),
    "TESTING": ("REPAIRING", "READY_FOR_REVIEW"),
    "REPAIRING": ("VALIDATING",),
    "READY_FOR_REVIEW": ("DISCARDED",),
    "DISCARDED": (),
    "FAILED": (),
    "CANCELLED": (),
}
TERMINAL = ("DISCARDED", "FAILED", "CANCELLED")
STOPS = ("FAILED", "CANCELLED")
GATES = {("APPLYING", "INSTALLING"): ("execution", "install"), ("AWAITING_APPROVAL", "INSTALLING"): ("execution", "install"), ("APPLYING", "TESTING"): ("execution",), ("AWAITING_APPROVAL", "TESTING"): ("execution",), ("INSTALLING", "TESTING"): ("execution",), ("TESTING", "REPAIRING"): ("repair",)}


def allowed(before: str, after: str) -> bool:
    return after in NEXT.get(before, ()) or (after in STOPS and before in NEXT and before not in TERMINAL and before != "READY_FOR_REVIEW")


PAIRS = tuple((a, b) for a in NEXT for b in NEXT if allowed(a, b))


def is_allowed(before: Column, after: Column) -> Column:
    """Whether a run may go from one state to another; a first state may only be QUEUED."""
    table = F.array(*[F.lit(f"{a}>{b}") for a, b in PAIRS])
    return F.when(before.isNull(), after == "QUEUED").otherwise(F.array_contains(table, F.concat(before, F.lit(">"), after)))


def missing_gates(before: Column, after: Column, approvals: Column) -> Column:
    """Approvals that a transition needs and has not got."""
    needed = F.coalesce(F.try_element_at(F.create_map(*[x for (a, b), g in GATES.items() for x in (F.lit(f"{a}>{b}"), F.array(*map(F.lit, g)))]), F.concat(before, F.lit(">"), after)), F.array().cast("array<string>"))
    return F.array_except(needed, approvals)


def transitions(events: DataFrame, key: str = "run_id", at: str = "created_at", tie: str = "event_id") -> DataFrame:
    """Each event with the state before it and whether that step is allowed."""
    w = W.partitionBy(key).orderBy(at, tie)
    return events.withColumn("before", F.lag("status").over(w)).withColumn("ok", is_allowed(F.col("before"), F.col("status")))


def compare_and_set(current: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (run_id, from_status, to_status, approvals) against the current states (run_id, status): the new state, and
    why a request was refused: stale, not allowed, or an approval that is missing."""
    d = requests.join(current, "run_id", "left")
    missing = missing_gates(F.col("from_status"), F.col("to_status"), F.col("approvals"))
    refused = F.when(F.col("status").isNull(), "unknown run").when(F.col("status") != F.col("from_status"), "stale").when(~is_allowed(F.col("from_status"), F.col("to_status")), "not allowed").when(F.size(missing) > 0, F.concat(F.lit("needs "), F.array_join(missing, ", ")))
    return d.withColumn("refused", refused).withColumn("new_status", F.when(F.col("refused").isNull(), F.col("to_status")).otherwise(F.col("status")))


def idle(events: DataFrame, now: Column, limit_seconds: int, key: str = "run_id", at: str = "created_at") -> DataFrame:
    """Runs in an unfinished state that have been silent for longer than the limit."""
    last = events.groupBy(key).agg(F.max_by("status", F.struct(at, "event_id")).alias("status"), F.max(at).alias("last"))
    return last.where(~F.col("status").isin(*TERMINAL, "READY_FOR_REVIEW") & (F.unix_micros(now) - F.unix_micros("last") > limit_seconds * 1_000_000))


def repair_state(events: DataFrame, key: str = "run_id") -> DataFrame:
    """Per run: the last approval and how often it went from testing to repairing."""
    return transitions(events, key).groupBy(key).agg(
        F.max_by("approval", F.when(F.col("approval").isNotNull(), F.struct("created_at", "event_id"))).alias("approval"),
        F.count_if((F.col("before") == "TESTING") & (F.col("status") == "REPAIRING")).alias("repairs"),
    )


def first_per_window(events: DataFrame, keys: list[str], at: str, tie: str, duration: str) -> DataFrame:
    """Idempotence as a batch: of events with equal keys in one window of time, the first."""
    w = W.partitionBy(*keys, F.window(at, duration)).orderBy(at, tie)
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rate_limit(events: DataFrame, keys: list[str], at: str, points: int, duration: str) -> DataFrame:
    """Fixed windows in which a key spent more than its points: (keys, window start, used, refused)."""
    n = events.groupBy(*keys, F.window(at, duration).alias("w")).agg(F.count("*").alias("used"))
    return n.where(F.col("used") > points).select(*keys, F.col("w.start").alias("window_start"), "used", (F.col("used") - points).alias("refused"))


def available_now(df: DataFrame, folder: str, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into a parquet table of the folder, and reads it."""
    out, spark = f"{folder}/{name}", df.sparkSession
    schema = df.schema
    if mode == "append":
        q = df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start(out)
    else:
        q = df.writeStream.outputMode(mode).foreachBatch(lambda b, n: b.write.mode("append").parquet(out)).option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def events_stream(spark: SparkSession, folder: str, file: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)


def tumbling(events: DataFrame, at: str, late: str, duration: str, *keys: str) -> DataFrame:
    """Counts and sums per tumbling window and key, with a watermark."""
    g = events.withWatermark(at, late).groupBy(F.window(at, duration), *keys)
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "value")


def sliding(events: DataFrame, at: str, late: str, duration: str, slide: str, *keys: str) -> DataFrame:
    g = events.withWatermark(at, late).groupBy(F.window(at, duration, slide), *keys)
    return g.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, at: str, late: str, gap: str, *keys: str) -> DataFrame:
    g = events.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys)
    return g.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


BROKEN = "run_id long, event_id long, before string, after string"


def broken_transitions(events: DataFrame) -> DataFrame:
    """The state machine on a stream: steps that are not allowed, with the state of each run kept between batches.

    Events of a run are taken in order of (created_at, event_id) within a batch.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        out = []
        for e in pd.concat(list(batches)).sort_values(["created_at", "event_id"]).itertuples():
            ok = allowed(before, e.status) if before else e.status == "QUEUED"
            if not ok:
                out.append((key[0], e.event_id, before, e.status))
            before = e.status
        state.update((before,))
        yield pd.DataFrame(out, columns=["run_id", "event_id", "before", "after"])

    return events.groupBy("run_id").applyInPandasWithState(step, BROKEN, "status string", "append", "NoTimeout")
