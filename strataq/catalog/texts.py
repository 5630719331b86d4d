"""Text functions, listings and rules over whole tables that the other catalogs only show on a few rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import practice_rules, query
from ..plans.reports import duration
from ..sources.tables import table


def word_counts(spark, sf_dir):
    """Words outside fenced code; every third text gets a fence before it, every fifth an open one after it."""
    fenced = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```py\nx = 1\n``` "), "text")).when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" ``` not closed"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.word_count(fenced).cast("long").alias("words"))


WORD_COUNTS = r"""SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(t, '```(.|\n)*?(```|$)', ' ', 'g'), '\s+'), lambda x: x <> ''))::BIGINT AS words
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '```py' || chr(10) || 'x = 1' || chr(10) || '``` ' || text WHEN doc_id % 5 = 0 THEN text || ' ``` not closed' ELSE text END AS t FROM documents WHERE text IS NOT NULL)"""


def line_positions(spark, sf_dir):
    """The line of each text's middle character."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", text.line_at(F.col("text"), F.floor(F.length("text") / 2).cast("int")).cast("long").alias("line"))


LINE_POSITIONS = "SELECT doc_id, (1 + length(h) - length(replace(h, chr(10), '')))::BIGINT AS line FROM (SELECT doc_id, left(text, length(text) // 2) AS h FROM documents WHERE text IS NOT NULL)"


def durations(spark, sf_dir):
    """Milliseconds from each user's first event to the last, both ways round; -1 where it is open."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    end = F.when(F.col("user_id") % 7 != 0, F.col("last"))
    return e.select("user_id", F.coalesce(duration(F.col("first").cast("timestamp"), end.cast("timestamp")), F.lit(-1)).alias("took"), duration(F.col("last").cast("timestamp"), F.col("first").cast("timestamp")).alias("back"))


DURATIONS = "SELECT user_id, CASE WHEN user_id % 7 <> 0 THEN epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 ELSE -1 END AS took, 0::BIGINT AS back FROM events GROUP BY user_id"


def first_emitted(spark, sf_dir):
    """DISTINCT by customer that keeps the order emitted first."""
    return query.first_per(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


FIRST_EMITTED = "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey"


def files_listed(spark, sf_dir):
    """The second page of files of two kinds by size, unknown sizes last, with the findings of each."""
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("lang").alias("kind"), F.when(F.col("doc_id") % 4 != 0, F.col("n_chars")).alias("loc"))
    findings = table(spark, sf_dir, "labels").where("quality = 0 or toxic = 1").select(F.concat(F.lit("d"), "doc_id").alias("path"))
    return query.files_page(files, findings, ["en", "de"], "loc", 2, 30).select("path", "kind", "loc", "findings")


FILES_LISTED = """WITH f AS (SELECT 'd' || doc_id AS path, lang AS kind, CASE WHEN doc_id % 4 <> 0 THEN n_chars END AS loc FROM documents WHERE lang IN ('en', 'de')),
c AS (SELECT 'd' || doc_id AS path, count(*) AS n FROM labels WHERE quality = 0 OR toxic = 1 GROUP BY 1)
SELECT path, kind, loc, coalesce(n, 0) AS findings FROM f LEFT JOIN c USING (path) ORDER BY loc DESC NULLS LAST, path LIMIT 30 OFFSET 30"""


def architecture_rules(spark, sf_dir):
    """Nations as cycles of their customers, of which some segments are loose languages; suppliers in debt as violations;
    part brands as modules with their suppliers' number as fan-out."""
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("component"), F.when(F.col("c_nationkey") % 2 == 0, "python").otherwise("java").alias("language"))
    owing = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    fan = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("fan_out")).select(F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("m"), "l_suppkey", F.lit("/index.ts"))).otherwise(F.concat(F.lit("m"), "l_suppkey")).alias("id"), (F.col("fan_out") % 60).alias("fan_out"))
    found = practice_rules.architecture_findings(customers.select("id", "component"), customers.select("id", "language"), owing, fan)
    return found.select("rule_id", "severity", "path", "evidence")


ARCHITECTURE_RULES = """WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1),
f AS (SELECT l_suppkey, count(DISTINCT l_partkey) % 60 AS fan_out FROM lineitem GROUP BY 1)
SELECT 'architecture/circular-dependency' AS rule_id, CASE WHEN c_nationkey % 2 = 0 THEN CASE WHEN n >= 10 THEN 'HIGH' ELSE 'MEDIUM' END ELSE CASE WHEN n >= 10 THEN 'MEDIUM' ELSE 'LOW' END END AS severity, 'n' || c_nationkey AS path, n::VARCHAR AS evidence FROM c
UNION ALL SELECT 'architecture/layer-violation', 'LOW', 's' || s_suppkey, 'n' || s_nationkey FROM supplier WHERE s_acctbal < 0
UNION ALL SELECT 'architecture/high-fan-out', {severity}, 'm' || l_suppkey, fan_out::VARCHAR FROM f WHERE l_suppkey % 3 <> 0 AND {severity} IS NOT NULL"""


def _redacted(line: str) -> str:
    """What the texts of the table hold of secrets, replaced."""
    for pattern, shown in ((r"\b(AKIA|ASIA)[0-9A-Z]{16}\b", "<redacted>"), (r'(?i)(token\s*=\s*)"[^"\n]+"', r'\1"<redacted>"'), (r"(?i)(password\s*=\s*)[0-9a-f]{8,}", r"\1<redacted>")):
        line = f"regexp_replace({line}, '{pattern}', '{shown}', 'g')"
    return line


def snippets(spark, sf_dir):
    """The first line of each text as evidence: white space collapsed, secrets redacted, 160 characters."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.snippet(F.col("text")).alias("shown"))


SNIPPETS = rf"""SELECT doc_id, CASE WHEN length(s) > 160 THEN left(s, 159) || '…' ELSE s END AS shown FROM (SELECT doc_id, {_redacted(r"trim(regexp_replace(rtrim(split_part(text, chr(10), 1), chr(13)), '\s+', ' ', 'g'))")} AS s FROM documents WHERE text IS NOT NULL)"""


def cleaned_texts(spark, sf_dir):
    """Texts with line ends and control characters put among them, cleaned and cut."""
    noisy = F.concat(F.lit("a\r\nb\rc\x07\x1f"), "text")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(text.clean_text(noisy, 500), 256).alias("cleaned"))


CLEANED_TEXTS = f"""SELECT doc_id, sha256(left({_redacted("'a' || chr(10) || 'b' || chr(10) || 'c' || text")}, 500)) AS cleaned FROM documents WHERE text IS NOT NULL"""


def sanitized_outputs(spark, sf_dir):
    """Texts as a terminal's output, escapes taken out and the last 300 characters kept from a line start on."""
    shown = F.concat(F.lit("\x1b[31mred\x1b[0m \x1b]0;title\x07"), "text")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.sanitize_output(shown, 300).alias("output"))


SANITIZED_OUTPUTS = f"""WITH s AS (SELECT doc_id, {_redacted("'red ' || text")} AS t FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, t, right(t, 300) AS tail FROM s)
SELECT doc_id, CASE WHEN length(t) <= 300 THEN t WHEN contains(tail, chr(10)) THEN substring(tail, instr(tail, chr(10)) + 1) ELSE tail END AS output FROM c"""


QUERIES = {
    "word_counts": (word_counts, WORD_COUNTS),
    "line_positions": (line_positions, LINE_POSITIONS),
    "durations": (durations, DURATIONS),
    "first_emitted": (first_emitted, FIRST_EMITTED),
    "files_listed": (files_listed, FILES_LISTED),
    "architecture_rules": (architecture_rules, ARCHITECTURE_RULES.format(severity="CASE WHEN fan_out > 40 THEN 'MEDIUM' WHEN fan_out > 20 THEN 'LOW' END")),
    "snippets": (snippets, SNIPPETS),
    "cleaned_texts": (cleaned_texts, CLEANED_TEXTS),
    "sanitized_outputs": (sanitized_outputs, SANITIZED_OUTPUTS),
}
