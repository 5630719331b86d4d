"""Aggregates, windows, top-k, bands and set operations over the relational tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.text import line_count
from ..operators import aggregates, joins, query
from ..sources.tables import inline, table, values


def language_rollup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    files = docs.select(
        F.col("lang").alias("language"), line_count(F.col("text")).alias("code_lines"),
        F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) == "")).alias("comment_lines"),
        F.regexp_count("text", F.lit(r"\. ")).alias("functions"), (F.regexp_count("text", F.lit(",")) + 1).alias("complexity"),
    )
    return aggregates.language_rollup(files)


LANGUAGE_ROLLUP = r"""WITH f AS (SELECT lang AS language, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN right(text, 1) = chr(10) THEN 0 ELSE 1 END END AS code_lines,
  len(list_filter(string_split(text, chr(10)), lambda x: trim(x) = '')) AS comment_lines, len(regexp_extract_all(text, '\. ')) AS functions, len(regexp_extract_all(text, ',')) + 1 AS complexity FROM (SELECT lang, coalesce(text, '') AS text FROM documents))
SELECT language, count(*) AS files, sum(code_lines) AS code_lines, sum(comment_lines) AS comment_lines, sum(functions) AS functions, floor(avg(complexity) * 100 + 0.5) / 100 AS avg_complexity, max(complexity) AS max_complexity FROM f GROUP BY language"""


def p90_nearest_rank(spark, sf_dir):
    a = aggregates.nearest_rank(table(spark, sf_dir, "documents"), ["lang"], "n_chars", 90).select(F.concat(F.lit("n_chars "), "lang").alias("what"), F.col("n_chars").cast("double").alias("p90"))
    b = aggregates.nearest_rank(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", 90).select(F.concat(F.lit("l_quantity "), "l_returnflag"), F.col("l_quantity").cast("double"))
    return a.union(b)


P90 = """WITH d AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents),
l AS (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT 'n_chars ' || lang AS what, n_chars::DOUBLE AS p90 FROM d WHERE i = least(n - 1, floor(90 * n / 100.0::DOUBLE)) UNION ALL SELECT 'l_quantity ' || l_returnflag, l_quantity::DOUBLE FROM l WHERE i = least(n - 1, floor(90 * n / 100.0::DOUBLE))"""


def top_hotspots(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").orderBy(F.desc_nulls_last("n_chars"), "doc_id").limit(20)


def files_sorted_nulls_last(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("price", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")))
    top = query.page(o, [F.col("price").desc_nulls_last(), F.col("o_orderkey")], 1, 50)
    tail = o.orderBy(F.col("price").asc_nulls_first(), F.col("o_orderkey").desc()).limit(50)
    return top.select("o_orderkey", "price").union(tail.select("o_orderkey", "price"))


FILES_SORTED = """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS price FROM orders)
SELECT * FROM (SELECT * FROM o ORDER BY price DESC NULLS LAST, o_orderkey LIMIT 50) UNION ALL SELECT * FROM (SELECT * FROM o ORDER BY price ASC NULLS FIRST, o_orderkey DESC LIMIT 50)"""


def latest_per_group(spark, sf_dir):
    orders = query.latest_per(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select(F.lit("customer").alias("what"), F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("latest"))
    events = query.latest_per(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select(F.lit("user"), "user_id", "event_id")
    return orders.union(events)


LATEST = """SELECT 'customer' AS what, o_custkey AS key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY o_custkey
UNION ALL SELECT 'user', user_id, arg_max(event_id, (ts, event_id)) FROM events GROUP BY user_id"""


def fingerprint_ordinals(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("duplicate/text").alias("rule_id"), F.concat_ws("/", "source", "lang").alias("path"), F.sha2("text", 256).alias("key"))
    return query.with_fingerprints(d, "doc_id").select("doc_id", "ordinal", "fingerprint")


FINGERPRINT_ORDINALS = """WITH d AS (SELECT doc_id, source || '/' || lang AS path, sha256(text) AS key FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY path, key ORDER BY doc_id) - 1 AS ordinal FROM d)
SELECT doc_id, ordinal, sha256('duplicate/text' || chr(0) || path || chr(0) || key || CASE WHEN ordinal > 0 THEN '#' || ordinal ELSE '' END) AS fingerprint FROM n"""


def content_hash_dups(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.count_distinct("source").alias("sources")).where("copies > 1")


CONTENT_HASH_DUPS = "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id, count(DISTINCT source) AS sources FROM documents GROUP BY 1 HAVING count(*) > 1"


def severity_bands(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    out = None
    for measure, column in (("complexity", "l_quantity"), ("nesting", "l_linenumber"), ("fan_out", "l_quantity"), ("parameters", "l_linenumber")):
        part = l.groupBy(F.lit(measure).alias("measure"), numbers.threshold_severity(F.col(column), measure).alias("severity")).agg(F.count("*").alias("n"))
        out = part if out is None else out.union(part)
    return out


SEVERITY_BANDS = " UNION ALL ".join(
    f"SELECT '{m}' AS measure, CASE " + " ".join(f"WHEN {c} > {b} THEN '{s}'" for b, s in numbers.CODE_BANDS[m]) + " END AS severity, count(*) AS n FROM lineitem GROUP BY 2"
    for m, c in (("complexity", "l_quantity"), ("nesting", "l_linenumber"), ("fan_out", "l_quantity"), ("parameters", "l_linenumber"))
)


def grade_bands(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("score", F.col("p_size") * 2)
    return p.groupBy(numbers.grade(F.col("score")).alias("grade")).agg(F.count("*").alias("n"), F.min("score").alias("lowest"), F.max("score").alias("highest"))


GRADE_BANDS = "WITH p AS (SELECT p_size * 2 AS score FROM part) SELECT CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade, count(*) AS n, min(score) AS lowest, max(score) AS highest FROM p GROUP BY 1"

VECTORS = [
    ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8, "CRITICAL"), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", 10.0, "CRITICAL"), ("CVSS:3.0/AV:N/AC:H/PR:L/UI:R/S:U/C:L/I:L/A:N", 3.7, "LOW"),
    ("CVSS:3.1/AV:L/AC:L/PR:H/UI:N/S:U/C:H/I:N/A:N", 4.4, "MEDIUM"), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1, "MEDIUM"), ("CVSS:3.1/AV:P/AC:H/PR:H/UI:R/S:U/C:N/I:N/A:N", 0.0, "INFO"),
    ("CVSS:3.1/AV:N/AC:L/PR:L/UI:N/S:C/C:H/I:H/A:H", 9.9, "CRITICAL"), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:H", 7.5, "HIGH"), ("CVSS:2.0/AV:N/AC:L/Au:N/C:P/I:P/A:P", None, None), ("CVSS:3.1/AV:N/AC:L", None, None), ("", None, None),
]


def cvss_scores(spark, sf_dir):
    d = inline(spark, [(v,) for v, _, _ in VECTORS], "vector string")
    d = d.withColumn("score", numbers.cvss3_base(F.col("vector")))
    return d.withColumn("severity", numbers.cvss_severity(F.col("score")))


CVSS_SCORES = f"SELECT * FROM ({values(VECTORS)}) t(vector, score, severity)"


def metric_unpivot(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"), F.floor(F.max("o_totalprice")).alias("largest"))
    return aggregates.unpivoted(o, ["month"], ["orders", "customers", "largest"])


_MONTHS = "m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders, count(DISTINCT o_custkey) AS customers, floor(max(o_totalprice)) AS largest FROM orders GROUP BY 1)"
METRIC_UNPIVOT = f"WITH {_MONTHS} SELECT month, 'orders' AS key, orders::DOUBLE AS value FROM m UNION ALL SELECT month, 'customers', customers::DOUBLE FROM m UNION ALL SELECT month, 'largest', largest::DOUBLE FROM m"


def metric_trend(spark, sf_dir):
    m = metric_unpivot(spark, sf_dir)
    w = W.partitionBy("key").orderBy("month")
    return m.withColumn("change", F.col("value") - F.lag("value").over(w)).withColumn("nth", F.row_number().over(w).cast("long"))


METRIC_TREND = f"WITH u AS ({METRIC_UNPIVOT}) SELECT month, key, value, value - lag(value) OVER w AS change, row_number() OVER w AS nth FROM u WINDOW w AS (PARTITION BY key ORDER BY month)"


def conditional_counts(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    d = aggregates.counts_in_one_pass(l, ["l_returnflag", "l_linestatus"], discounted=F.col("l_discount") > 0.05, large=F.col("l_quantity") >= 40, late=F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp"))
    return d.withColumn("discounted_share", numbers.ratio(F.col("discounted") * 100, F.col("n"), 1))


CONDITIONAL_COUNTS = """SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (l_discount > 0.05::DOUBLE) AS discounted, count(*) FILTER (l_quantity >= 40) AS large, count(*) FILTER (l_shipdate >= TIMESTAMP '1998-01-01') AS late,
floor(count(*) FILTER (l_discount > 0.05::DOUBLE) * 100.0::DOUBLE / count(*) * 10 + 0.5) / 10 AS discounted_share FROM lineitem GROUP BY 1, 2"""


def grouping_set_facets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    g = o.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("g"))
    return g.select(F.coalesce("o_orderstatus", "o_orderpriority", F.lit("all")).alias("value"), "n", "g")


GROUPING_SET_FACETS = "SELECT coalesce(o_orderstatus, o_orderpriority, 'all') AS value, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"


def cube_rollup(spark, sf_dir):
    """Ship modes of the standard grouping operators: CUBE over flags, ROLLUP over nation and segment."""
    l = table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).select(F.lit("cube").alias("what"), F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"), "n")
    c = table(spark, sf_dir, "customer").withColumn("nation", F.col("c_nationkey").cast("string")).rollup("nation", "c_mktsegment").agg(F.count("*").alias("n")).select(F.lit("rollup"), "nation", "c_mktsegment", "n")
    return l.union(c)


CUBE_ROLLUP = "SELECT 'cube' AS what, l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus) UNION ALL SELECT 'rollup', c_nationkey::VARCHAR, c_mktsegment, count(*) FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)"


def distinct_counts(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("o_custkey").alias("customers"), F.count("*").alias("lines"))


DISTINCT_COUNTS = "SELECT o_orderpriority, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT o_custkey) AS customers, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"


def transitive_minus_direct(spark, sf_dir):
    """Parts that lines use and no order of the highest priority asks for."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joins.difference(l, l.where(F.col("o_orderpriority") == "1-URGENT"), ["l_partkey"]).select(F.col("l_partkey").alias("part_key"))


TRANSITIVE_MINUS_DIRECT = "SELECT DISTINCT l_partkey AS part_key FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT')"


def set_operations(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    tag = lambda df, name: df.select(F.lit(name).alias("op"), "k")
    return tag(c.union(s).distinct(), "union").union(tag(c.intersect(s), "intersect")).union(tag(c.exceptAll(s).distinct(), "except all")).union(tag(c.subtract(s), "except"))


SET_OPERATIONS = """WITH c AS (SELECT c_nationkey AS k FROM customer), s AS (SELECT s_nationkey AS k FROM supplier)
SELECT 'union' AS op, k FROM (SELECT * FROM c UNION SELECT * FROM s) UNION ALL SELECT 'intersect', k FROM (SELECT * FROM c INTERSECT SELECT * FROM s)
UNION ALL SELECT 'except all', k FROM (SELECT DISTINCT k FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM s)) UNION ALL SELECT 'except', k FROM (SELECT * FROM c EXCEPT SELECT * FROM s)"""


def left_outer_with_counts(spark, sf_dir):
    """Customers with how many orders they placed, none included: F9 and J2."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("path"))
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("loc"), F.lit(None).cast("int").alias("complexity"), F.lit(None).cast("int").alias("duplicated"))
    return query.files_page(files, orders, kind=["BUILDING", "MACHINERY"], sort="loc", size=100).select("path", "kind", "loc", "findings")


LEFT_OUTER = "WITH n AS (SELECT o_custkey, count(*) AS findings FROM orders GROUP BY 1) SELECT c_custkey::VARCHAR AS path, c_mktsegment AS kind, c_acctbal AS loc, coalesce(findings, 0) AS findings FROM customer LEFT JOIN n ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY c_acctbal DESC NULLS LAST, path LIMIT 100"


def keep_last(spark, sf_dir):
    """The last 200 events, in ascending order."""
    e = table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200)
    return e.orderBy("ts", "event_id").select("event_id", "user_id", "event_type")


KEEP_LAST = "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200"


def json_readers(spark, sf_dir):
    """Defensive reads of a JSON column: absent or ill-typed fields are null."""
    e = table(spark, sf_dir, "events").withColumn("v", F.try_parse_json("props"))
    d = e.select("event_type", F.try_variant_get("v", "$.k", "int").alias("k"), F.try_variant_get("v", "$.missing", "string").alias("m"))
    return d.groupBy("event_type").agg(F.sum("k").alias("k"), F.count("m").alias("missing"))


JSON_READERS = "SELECT event_type, sum(TRY_CAST(json_extract_string(props, '$.k') AS INT)) AS k, count(json_extract_string(props, '$.missing')) AS missing FROM events GROUP BY 1"


def dependency_page(spark, sf_dir):
    """The dependency listing's filters on parts: ecosystem = type, name contains, sorted."""
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("ecosystem"), F.col("p_name").alias("name"), F.col("p_brand").alias("manifest_path"), (F.col("p_size") > 25).alias("direct"), (F.col("p_retailprice") > 1500).alias("dev"), F.array().cast("array<string>").alias("vuln_ids"), F.lit(False).alias("unused_candidate"), F.col("p_partkey").alias("key"))
    rows = query.page(p.where(query._all(query.dependencies_where(ecosystem=["SMALL", "ECONOMY"], scope="direct", dev="exclude", vulnerable=False, q="RING"))), [F.col("name"), F.col("ecosystem"), F.col("manifest_path"), F.col("key")], 2, 10)
    return rows.select("key", "ecosystem", "name", "manifest_path")


DEPENDENCY_PAGE = "SELECT p_partkey AS key, p_type AS ecosystem, p_name AS name, p_brand AS manifest_path FROM part WHERE p_type IN ('SMALL', 'ECONOMY') AND p_size > 25 AND NOT p_retailprice > 1500 AND contains(lower(p_name), 'ring') ORDER BY name, ecosystem, manifest_path, key LIMIT 10 OFFSET 10"


def ecosystem_facet(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("ecosystem"), F.col("p_name").alias("name"), F.col("p_brand").alias("manifest_path"), (F.col("p_size") > 25).alias("direct"), (F.col("p_retailprice") > 1500).alias("dev"), F.array().cast("array<string>").alias("vuln_ids"), F.lit(False).alias("unused_candidate"))
    return query.ecosystem_facet(p, ecosystem=["SMALL"], scope="direct", dev="exclude", q="RING")


ECOSYSTEM_FACET = "SELECT p_type AS ecosystem, count(*) AS n FROM part WHERE p_size > 25 AND NOT p_retailprice > 1500 AND contains(lower(p_name), 'ring') GROUP BY 1"


def approximate_counts(spark, sf_dir):
    """HyperLogLog distinct counts are within 5 percent of the exact ones."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.count_distinct("l_partkey").alias("parts"))
    return l.select("l_returnflag", "parts", (F.abs(F.col("a") - F.col("parts")) <= 0.06 * F.col("parts")).alias("close"))


APPROXIMATE_COUNTS = "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS close FROM lineitem GROUP BY 1"


def detection_scores(spark, sf_dir):
    """Spans of documents found by a word rule against the labels: precision, recall and F1 by language and in all."""
    flagged = F.coalesce(F.lower("text"), F.lit("")).rlike(r"\b(idiot|loser|scum|trash|stupid|moron|clown|worthless|pathetic|disgusting)\b")
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", flagged.alias("found"), (F.col("toxic") == 1).alias("real"))
    m = d.select("lang", (F.col("found") & F.col("real")).cast("int").alias("tp"), (F.col("found") & ~F.col("real")).cast("int").alias("fp"), (~F.col("found") & F.col("real")).cast("int").alias("fn"))
    return aggregates.detection_quality(m, ["lang"]).union(aggregates.detection_quality(m.withColumn("lang", F.lit("all")), ["lang"]))


DETECTION_SCORES = r"""WITH d AS (SELECT lang, regexp_matches(lower(coalesce(text, '')), '\b(idiot|loser|scum|trash|stupid|moron|clown|worthless|pathetic|disgusting)\b') AS f, toxic = 1 AS r FROM documents JOIN labels USING (doc_id)),
e AS (SELECT * FROM d UNION ALL SELECT 'all', f, r FROM d), s AS (SELECT lang, count(*) FILTER (f AND r) AS tp, count(*) FILTER (f AND NOT r) AS fp, count(*) FILTER (NOT f AND r) AS fn FROM e GROUP BY lang)
SELECT lang, tp, fp, fn, floor(tp::DOUBLE / nullif(tp + fp, 0) * 10000 + 0.5) / 10000 AS precision, floor(tp::DOUBLE / nullif(tp + fn, 0) * 10000 + 0.5) / 10000 AS recall, floor(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0) * 10000 + 0.5) / 10000 AS f1 FROM s"""

EXPECTED = [(1, "quality/a", "x.py", 10, 20), (2, "quality/a", "x.py", 30, 40), (3, "quality/b", "y.py", 1, 5), (4, "quality/c", "z.py", 7, 7)]
FOUND = [(1, "quality/a", "x.py", 12), (2, "quality/a", "x.py", 15), (3, "quality/a", "x.py", 50), (4, "quality/b", "y.py", 5), (5, "quality/c", "z.py", 8), (6, "quality/d", "z.py", 8)]


def match_findings(spark, sf_dir):
    return aggregates.match_findings(inline(spark, EXPECTED, "issue int, rule_id string, path string, lo int, hi int"), inline(spark, FOUND, "finding int, rule_id string, path string, line int"))


MATCH_FINDINGS = f"""WITH e(issue, rule_id, path, lo, hi) AS ({values(EXPECTED)}), f(finding, rule_id, path, line) AS ({values(FOUND)}), r AS (SELECT rule_id FROM e UNION SELECT rule_id FROM f)
SELECT rule_id, (SELECT count(*) FROM e WHERE e.rule_id = r.rule_id AND EXISTS (SELECT 1 FROM f WHERE f.rule_id = e.rule_id AND f.path = e.path AND f.line BETWEEN e.lo AND e.hi)) AS tp,
 (SELECT count(*) FROM f WHERE f.rule_id = r.rule_id AND NOT EXISTS (SELECT 1 FROM e WHERE f.rule_id = e.rule_id AND f.path = e.path AND f.line BETWEEN e.lo AND e.hi)) AS fp,
 (SELECT count(*) FROM e WHERE e.rule_id = r.rule_id AND NOT EXISTS (SELECT 1 FROM f WHERE f.rule_id = e.rule_id AND f.path = e.path AND f.line BETWEEN e.lo AND e.hi)) AS fn FROM r"""

QUERIES = {
    "language_rollup": (language_rollup, LANGUAGE_ROLLUP),
    "p90_nearest_rank": (p90_nearest_rank, P90),
    "top_hotspots": (top_hotspots, "SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 20"),
    "files_sorted_nulls_last": (files_sorted_nulls_last, FILES_SORTED),
    "latest_per_group": (latest_per_group, LATEST),
    "fingerprint_ordinals": (fingerprint_ordinals, FINGERPRINT_ORDINALS),
    "content_hash_dups": (content_hash_dups, CONTENT_HASH_DUPS),
    "severity_bands": (severity_bands, SEVERITY_BANDS),
    "grade_bands": (grade_bands, GRADE_BANDS),
    "cvss_scores": (cvss_scores, CVSS_SCORES),
    "metric_unpivot": (metric_unpivot, METRIC_UNPIVOT),
    "metric_trend": (metric_trend, METRIC_TREND),
    "conditional_counts": (conditional_counts, CONDITIONAL_COUNTS),
    "grouping_set_facets": (grouping_set_facets, GROUPING_SET_FACETS),
    "cube_rollup": (cube_rollup, CUBE_ROLLUP),
    "distinct_counts": (distinct_counts, DISTINCT_COUNTS),
    "transitive_minus_direct": (transitive_minus_direct, TRANSITIVE_MINUS_DIRECT),
    "set_operations": (set_operations, SET_OPERATIONS),
    "left_outer_with_counts": (left_outer_with_counts, LEFT_OUTER),
    "keep_last": (keep_last, KEEP_LAST),
    "json_readers": (json_readers, JSON_READERS),
    "dependency_page": (dependency_page, DEPENDENCY_PAGE),
    "ecosystem_facet": (ecosystem_facet, ECOSYSTEM_FACET),
    "approximate_counts": (approximate_counts, APPROXIMATE_COUNTS),
    "detection_scores": (detection_scores, DETECTION_SCORES),
    "match_findings": (match_findings, MATCH_FINDINGS),
}
