"""Lifecycles, limits and windows over events (batch and streaming), clones over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import STAGES, progress
from ..operators import clones
from ..plans.scratch import Scratch
from ..sources.tables import inline, table, values
from ..streaming import lifecycle

STATUS = {"signup": "QUEUED", "view": "MATERIALIZING", "click": "GENERATING", "purchase": "VALIDATING", "error": "FAILED"}


def events_table(spark, sf_dir):
    """The events with an instant as time; the files hold it without a zone, and UTC is meant."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def runs(spark, sf_dir, events=None):
    """Events as a log of runs: a user's events are the states of one run."""
    e = events_table(spark, sf_dir) if events is None else events
    status = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.col("event_type"))
    return e.select("event_id", F.col("user_id").alias("run_id"), status.alias("status"), F.col("ts").alias("created_at"), F.when(F.col("value") > 20, F.col("event_type")).alias("approval"))


_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END"
RUNS = f"runs AS (SELECT event_id, user_id AS run_id, {_CASE} AS status, ts AS created_at, CASE WHEN value > 20 THEN event_type END AS approval FROM events), steps AS (SELECT *, lag(status) OVER (PARTITION BY run_id ORDER BY created_at, event_id) AS before FROM runs), ok(before, status) AS ({values(list(lifecycle.PAIRS))}),\nt AS (SELECT s.*, CASE WHEN s.before IS NULL THEN s.status = 'QUEUED' ELSE EXISTS (SELECT 1 FROM ok WHERE ok.before = s.before AND ok.status = s.status) END AS fine FROM steps s)"


def run_transitions_invalid(spark, sf_dir):
    t = lifecycle.transitions(runs(spark, sf_dir)).where(~F.col("ok"))
    return t.groupBy(F.coalesce("before", F.lit("none")).alias("before"), F.col("status").alias("after")).agg(F.count("*").alias("n"))


def run_timeouts(spark, sf_dir):
    return lifecycle.idle(runs(spark, sf_dir), F.lit("2024-01-31 00:00:00").cast("timestamp"), 4 * 3600).select("run_id", "status")


RUN_TIMEOUTS = f"WITH {RUNS}, l AS (SELECT run_id, arg_max(status, (created_at, event_id)) AS status, max(created_at) AS last FROM runs GROUP BY run_id) SELECT run_id, status FROM l WHERE status NOT IN ('DISCARDED', 'FAILED', 'CANCELLED', 'READY_FOR_REVIEW') AND epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(last) > 14400000000"


def repair_state(spark, sf_dir):
    return lifecycle.repair_state(runs(spark, sf_dir))


REPAIR_STATE = f"WITH {RUNS} SELECT run_id, arg_max(approval, (created_at, event_id)) FILTER (approval IS NOT NULL) AS approval, count(*) FILTER (before = 'TESTING' AND status = 'REPAIRING') AS repairs FROM t GROUP BY run_id"


def rate_limit_windows(spark, sf_dir):
    return lifecycle.rate_limit(events_table(spark, sf_dir), ["event_type"], "ts", 12, "3 hours").withColumn("window_start", F.unix_seconds("window_start"))


RATE_LIMIT = "SELECT event_type, (epoch(time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01')))::BIGINT AS window_start, count(*) AS used, count(*) - 12 AS refused FROM events GROUP BY 1, 2 HAVING count(*) > 12"


def idempotent_enqueue(spark, sf_dir):
    return lifecycle.first_per_window(events_table(spark, sf_dir), ["user_id", "event_type"], "ts", "event_id", "1 day").select("event_id", "user_id", "event_type")


IDEMPOTENT = "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') ORDER BY ts, event_id) AS n FROM events) WHERE n = 1"


def _stream(spark, sf_dir):
    return lifecycle.events_stream(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_events_windowed(spark, sf_dir):
    """Tumbling windows on a stream; complete mode, so the open windows count too."""
    out = lifecycle.available_now(lifecycle.tumbling(_stream(spark, sf_dir), "ts", "1 hour", "6 hours", "event_type"), Scratch(spark).root, "tumbling", "complete")
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "n")


STREAM_WINDOWED = "SELECT epoch(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"


def stream_sessions(spark, sf_dir):
    out = lifecycle.available_now(lifecycle.sessions(_stream(spark, sf_dir), "ts", "1 hour", "2 hours", "user_id"), Scratch(spark).root, "sessions", "complete")
    return out.select(F.unix_micros("start").alias("start"), "user_id", "n")


STREAM_SESSIONS = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT epoch_us(min(ts)) AS start, user_id, count(*) AS n FROM h GROUP BY user_id, k"""


def stream_sliding(spark, sf_dir):
    out = lifecycle.available_now(lifecycle.sliding(_stream(spark, sf_dir), "ts", "1 hour", "1 day", "12 hours", "event_type"), Scratch(spark).root, "sliding", "complete")
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "n")


STREAM_SLIDING = "WITH b AS (SELECT event_type, epoch(time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01'))::BIGINT AS s FROM events), x AS (SELECT event_type, s FROM b UNION ALL SELECT event_type, s - 43200 FROM b) SELECT s AS start, event_type, count(*) AS n FROM x GROUP BY 1, 2"


def stream_broken_transitions(spark, sf_dir):
    out = lifecycle.available_now(lifecycle.broken_transitions(runs(spark, sf_dir, _stream(spark, sf_dir))), Scratch(spark).root, "broken")
    return out.groupBy(F.coalesce("before", F.lit("none")).alias("before"), "after").agg(F.count("*").alias("n"))


INVALID = f"WITH {RUNS} SELECT coalesce(before, 'none') AS before, status AS after, count(*) AS n FROM t WHERE NOT fine GROUP BY 1, 2"


def stream_deduplicated(spark, sf_dir):
    """Job ids (user and kind) once within the watermark; how many jobs of each kind are left when every repeat is late."""
    d = _stream(spark, sf_dir).withWatermark("ts", "400 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    out = lifecycle.available_now(d.select("user_id", "event_type"), Scratch(spark).root, "jobs")
    return out.groupBy("event_type").agg(F.count("*").alias("jobs"))


REQUESTS = [("r1", "APPLYING", "INSTALLING", ["execution"]), ("r2", "QUEUED", "MATERIALIZING", []), ("r3", "TESTING", "REPAIRING", ["repair"]), ("r4", "QUEUED", "TESTING", []), ("r5", "APPLYING", "TESTING", ["execution"]), ("r6", "QUEUED", "FAILED", [])]
CURRENT = [("r1", "APPLYING"), ("r2", "GENERATING"), ("r3", "TESTING"), ("r4", "QUEUED"), ("r5", "APPLYING")]
ANSWERS = [("r1", "needs install", "APPLYING"), ("r2", "stale", "GENERATING"), ("r3", None, "REPAIRING"), ("r4", "not allowed", "QUEUED"), ("r5", None, "TESTING"), ("r6", "unknown run", None)]


def compare_and_set(spark, sf_dir):
    r = inline(spark, REQUESTS, "run_id string, from_status string, to_status string, approvals array<string>")
    return lifecycle.compare_and_set(inline(spark, CURRENT, "run_id string, status string"), r).select("run_id", "refused", "new_status")


def stage_progress(spark, sf_dir):
    return inline(spark, [(s,) for s in STAGES], "stage string").withColumn("percent", progress(F.col("stage")).cast("long"))


STAGE_PROGRESS = f"SELECT stage, floor(n * 100 / 12.0::DOUBLE + 0.5)::BIGINT AS percent FROM ({values([(s, i) for i, s in enumerate(STAGES)])}) t(stage, n)"


def _hashed(spark, sf_dir):
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"\s+"), "")
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"))


def clones_windows(spark, sf_dir):
    """Maximal runs of 50 words or more that a document shares with the first document that has them."""
    c = clones.window_clones(_hashed(spark, sf_dir), 50, "doc_id", Scratch(spark))
    return c.select(F.col("path").alias("doc_id"), F.col("start").cast("long").alias("start"), F.col("original").alias("original_id"), F.col("original_start").cast("long").alias("original_start"), F.col("tokens").cast("long").alias("words"))


CLONES_WINDOWS = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT doc_id, pos, md5(array_to_string(w[pos + 1:pos + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS pos FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min((doc_id, pos)) AS o FROM x GROUP BY h HAVING count(*) > 1), m AS (SELECT doc_id, pos, o[1] AS original_id, o[2] AS a0 FROM x JOIN f USING (h) WHERE doc_id <> o[1] OR o[2] + 50 <= pos),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, original_id, pos - a0 ORDER BY pos) AS island FROM m)
SELECT doc_id, min(pos) AS start, original_id, min(a0) AS original_start, max(pos) - min(pos) + 50 AS words FROM i GROUP BY doc_id, original_id, pos - a0, island"""


def duplicated_lines(spark, sf_dir):
    """Per document, lines that another place of the corpus repeats, and their share of all its lines; empty ones don't count."""
    l = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").select("doc_id", F.sha2("line", 256).alias("k"))
    often = l.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k", F.lit(1).alias("dup"))
    d = l.join(often, "k", "left").groupBy("doc_id").agg(F.count("*").alias("lines"), F.count("dup").alias("duplicated"))
    return d.where("duplicated > 0").withColumn("percent", F.floor(F.col("duplicated") * 1000.0 / F.col("lines") + 0.5) / 10)


DUPLICATED_LINES = """WITH l AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> ''), o AS (SELECT line FROM l GROUP BY line HAVING count(*) > 1)
SELECT doc_id, count(*) AS lines, count(o.line) AS duplicated, floor(count(o.line) * 1000.0::DOUBLE / count(*) + 0.5) / 10 AS percent FROM l LEFT JOIN o ON o.line = l.line GROUP BY doc_id HAVING count(o.line) > 0"""


def clones_greedy(spark, sf_dir):
    """The order-dependent scan of each source's documents in id order, by lines as rows."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("repository"), F.format_string("%012d", "doc_id").alias("path"), F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))
    d = d.withColumn("words", F.transform("l", lambda x: F.transform(F.array_remove(F.split(x, r"\s+"), ""), lambda w: F.xxhash64(w))))
    rows = F.flatten(F.transform("words", lambda x, i: F.array_repeat(i, F.size(x))))
    flat = d.select("repository", "path", F.flatten("words").alias("hashes"), rows.alias("rows"))
    return clones.greedy_clones(flat, 50, 2)


QUERIES = {
    "run_transitions_invalid": (run_transitions_invalid, INVALID),
    "run_timeouts": (run_timeouts, RUN_TIMEOUTS),
    "repair_state": (repair_state, REPAIR_STATE),
    "rate_limit_windows": (rate_limit_windows, RATE_LIMIT),
    "idempotent_enqueue": (idempotent_enqueue, IDEMPOTENT),
    "stream_events_windowed": (stream_events_windowed, STREAM_WINDOWED),
    "stream_sessions": (stream_sessions, STREAM_SESSIONS),
    "stream_sliding": (stream_sliding, STREAM_SLIDING),
    "stream_broken_transitions": (stream_broken_transitions, INVALID),
    "stream_deduplicated": (stream_deduplicated, "SELECT event_type, count(DISTINCT user_id) AS jobs FROM events GROUP BY 1"),
    "compare_and_set": (compare_and_set, f"SELECT * FROM ({values(ANSWERS)}) t(run_id, refused, new_status)"),
    "stage_progress": (stage_progress, STAGE_PROGRESS),
    "clones_windows": (clones_windows, CLONES_WINDOWS),
    "duplicated_lines": (duplicated_lines, DUPLICATED_LINES),
    "clones_greedy": (clones_greedy, None),
}
