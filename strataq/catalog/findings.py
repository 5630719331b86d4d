"""Secret findings over documents, and the query surface on them: pages, facets, triage, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import SEVERITIES, severity_rank
from ..functions.text import line_count, redact_secrets
from ..operators import query, score
from ..plans.scratch import Scratch
from ..sources.tables import table

RULE = "secret/hardcoded-credential"
ASSIGNED = r'\b(token|password|secret|api_key)\b\s*=\s*"([^"]{20,})"'
MAIL = r"[0-9A-Za-z._]+@[0-9A-Za-z.]+\.[a-z]+"


def findings(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Findings in lines of documents: secrets, mail addresses, license lines and repeated words.

    A document is a file source/lang/id.txt. Severity falls with the kind of finding; the fingerprint holds the rule, the
    path, a digest of what was found, and its ordinal. `keep`: of the columns line_text.
    """
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    lines = docs.select("doc_id", "lang", path.alias("path"), F.posexplode(F.split("text", "\n")).alias("at", "line_text"))
    lines = lines.where(F.col("line_text").rlike(ASSIGNED) | F.col("line_text").rlike(MAIL) | F.col("line_text").contains("Licensed under"))
    secret = F.when(F.col("line_text").rlike(ASSIGNED), F.struct(F.lit(RULE).alias("rule_id"), F.lit("SECRET").alias("category"), F.lit("hardcoded-credential").alias("type"), F.lit("HIGH").alias("severity"), F.regexp_extract("line_text", ASSIGNED, 2).alias("found")))
    mail = F.when(F.col("line_text").rlike(MAIL), F.struct(F.lit("privacy/mail-address").alias("rule_id"), F.lit("SECURITY").alias("category"), F.lit("mail-address").alias("type"), F.lit("MEDIUM").alias("severity"), F.regexp_extract("line_text", MAIL, 0).alias("found")))
    license_ = F.when(F.col("line_text").contains("Licensed under"), F.struct(F.lit("documentation/license-line").alias("rule_id"), F.lit("DOCUMENTATION").alias("category"), F.lit("license-line").alias("type"), F.lit("INFO").alias("severity"), F.regexp_extract("line_text", r"Licensed under .*", 0).alias("found")))
    hits = lines.select("doc_id", "lang", "path", (F.col("at") + 1).cast("long").alias("line"), *keep, F.explode(F.filter(F.array(secret, mail, license_), lambda x: x.isNotNull())).alias("f"))
    hits = hits.select("doc_id", "lang", "path", "line", *keep, "f.*").withColumn("key", F.sha2("found", 256))
    return query.with_fingerprints(hits.withColumn("emit_order", F.col("line"))).drop("emit_order")


FINDINGS = rf"""
lines AS (SELECT doc_id, lang, source || '/' || lang || '/' || doc_id || '.txt' AS path, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line FROM documents),
hits AS (
  SELECT doc_id, lang, path, line, '{RULE}' AS rule_id, 'SECRET' AS category, 'hardcoded-credential' AS type, 'HIGH' AS severity, regexp_extract(t, '{ASSIGNED}', 2) AS found FROM lines WHERE regexp_matches(t, '{ASSIGNED}')
  UNION ALL SELECT doc_id, lang, path, line, 'privacy/mail-address', 'SECURITY', 'mail-address', 'MEDIUM', regexp_extract(t, '{MAIL}') FROM lines WHERE regexp_matches(t, '{MAIL}')
  UNION ALL SELECT doc_id, lang, path, line, 'documentation/license-line', 'DOCUMENTATION', 'license-line', 'INFO', regexp_extract(t, 'Licensed under .*') FROM lines WHERE contains(t, 'Licensed under')),
keyed AS (SELECT *, sha256(found) AS key FROM hits),
numbered AS (SELECT *, row_number() OVER (PARTITION BY rule_id, path, key ORDER BY line) - 1 AS ordinal FROM keyed),
findings AS (SELECT *, sha256(rule_id || chr(0) || path || chr(0) || key || CASE WHEN ordinal > 0 THEN '#' || ordinal ELSE '' END) AS fingerprint,
  list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'], severity) - 1 AS severity_rank FROM numbered)"""
#: Findings of documents whose label says quality 0 count as triaged.
TRIAGE = "triage AS (SELECT DISTINCT fingerprint, CASE WHEN toxic = 1 THEN 'IGNORED' ELSE 'EXPECTED' END AS status FROM findings JOIN labels USING (doc_id) WHERE quality = 0)"


def triage(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where("quality = 0")
    return found.join(labels, "doc_id").select("fingerprint", F.when(F.col("toxic") == 1, "IGNORED").otherwise("EXPECTED").alias("status")).distinct()


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings, written, for queries that read them more than once: the texts are scanned once."""
    return Scratch(spark).save(findings(spark, sf_dir), "findings")


def secret_findings(spark, sf_dir):
    found = findings(spark, sf_dir, "line_text").where(F.col("category") == "SECRET")
    evidence = F.regexp_extract(redact_secrets(F.trim(F.regexp_replace("line_text", r"\s+", " "))), r'(\w+ ?= ?"<redacted>")', 1)
    return found.withColumn("evidence", evidence).select("doc_id", "path", "line", "rule_id", "severity", "ordinal", "fingerprint", "evidence")


SECRET_FINDINGS = f"""WITH {FINDINGS},
shown AS (SELECT doc_id, line, regexp_extract(regexp_replace(t, '\\s+', ' ', 'g'), '(\\w+ ?= ?")', 1) || '<redacted>"' AS evidence FROM lines WHERE regexp_matches(t, '{ASSIGNED}'))
SELECT doc_id, path, line, rule_id, severity, ordinal, fingerprint, regexp_replace(evidence, '^.*?(token|password|secret|api_key)( ?= ?")', '\\1\\2') AS evidence
FROM findings JOIN shown USING (doc_id, line) WHERE category = 'SECRET'"""


def findings_page(spark, sf_dir):
    found = _saved(spark, sf_dir)
    rows = query.findings_page(found, triage(spark, sf_dir, found), number=2, size=20, category=["SECRET", "SECURITY"])
    return rows.select("fingerprint", "severity", "path", "line", "triage_status")


FINDINGS_PAGE = f"""WITH {FINDINGS}, {TRIAGE},
p AS (SELECT * FROM findings WHERE category IN ('SECRET', 'SECURITY') ORDER BY severity_rank, path, line, fingerprint LIMIT 20 OFFSET 20)
SELECT fingerprint, severity, path, line, status AS triage_status FROM p LEFT JOIN triage USING (fingerprint)"""


def findings_facets(spark, sf_dir):
    found = _saved(spark, sf_dir)
    return query.findings_facets(found, triage(spark, sf_dir, found), "untriaged", category=["SECRET", "SECURITY"])


FINDINGS_FACETS = f"""WITH {FINDINGS}, {TRIAGE},
s AS (SELECT * FROM findings WHERE category IN ('SECRET', 'SECURITY') AND fingerprint NOT IN (SELECT fingerprint FROM triage))
SELECT 'severity' AS facet, severity AS value, count(*) AS n FROM s GROUP BY severity UNION ALL SELECT 'type', type, count(*) FROM s GROUP BY type UNION ALL SELECT 'total', 'all', count(*) FROM s"""


def _triaged(which):
    def run(spark, sf_dir):
        found = _saved(spark, sf_dir)
        return query.triaged(found, triage(spark, sf_dir, found), which).select("fingerprint", "path", "line", "severity")

    return run


def _triaged_sql(negate):
    return f"WITH {FINDINGS}, {TRIAGE} SELECT fingerprint, path, line, severity FROM findings WHERE fingerprint {negate} IN (SELECT fingerprint FROM triage)"


def severity_counts(spark, sf_dir):
    counts = findings(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"))
    return query.zero_filled(counts, "severity", SEVERITIES)


SEVERITY_COUNTS = f"WITH {FINDINGS}, d(severity) AS (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')) SELECT d.severity, count(f.fingerprint) AS n FROM d LEFT JOIN findings f ON f.severity = d.severity GROUP BY d.severity"


def worst_per_document(spark, sf_dir):
    ranked = findings(spark, sf_dir).withColumn("rank", severity_rank(F.col("severity")))
    return ranked.groupBy("path").agg(F.min_by("severity", "rank").alias("worst"), F.count("*").alias("n"), F.count_distinct("rule_id").alias("rules"))


WORST_PER_DOCUMENT = f"WITH {FINDINGS} SELECT path, min_by(severity, severity_rank) AS worst, count(*) AS n, count(DISTINCT rule_id) AS rules FROM findings GROUP BY path"


def most_severe_kept(spark, sf_dir):
    found = _saved(spark, sf_dir)
    kept, _ = query.most_severe(found, 25)
    total = found.agg(F.count("*").alias("total"))
    return kept.select("fingerprint", "severity", "path", "line").crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > 25)  # one row


MOST_SEVERE_KEPT = f"""WITH {FINDINGS}, t AS (SELECT count(*) AS total FROM findings)
SELECT fingerprint, severity, path, line, total, total > 25 AS truncated FROM (SELECT * FROM findings ORDER BY severity_rank, path, line, fingerprint LIMIT 25), t"""


def capped_lists(spark, sf_dir):
    """At most five findings of each rule, with how many there were."""
    return query.capped(_saved(spark, sf_dir), ["rule_id"], [F.col("path"), F.col("line"), F.col("fingerprint")], 5).select("rule_id", "path", "line", "total")


CAPPED_LISTS = f"""WITH {FINDINGS}
SELECT rule_id, path, line, total FROM (SELECT *, count(*) OVER (PARTITION BY rule_id) AS total, row_number() OVER (PARTITION BY rule_id ORDER BY path, line, fingerprint) AS n FROM findings) WHERE n <= 5"""


def _subjects(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = docs.groupBy(F.col("lang").alias("subject")).agg(F.sum(line_count(F.coalesce("text", F.lit("")))).alias("lines"))
    copies = docs.groupBy("lang", F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n")).groupBy(F.col("lang").alias("subject"))
    share = copies.agg((F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) * 100.0 / F.sum("n")).alias("duplication"))
    return lines.join(share, "subject").withColumn("present", F.array(F.lit("codeQuality"), F.lit("documentation")))


def _scored(spark, sf_dir):
    found = _saved(spark, sf_dir).withColumn("subject", F.col("lang"))
    return found, _subjects(spark, sf_dir), triage(spark, sf_dir, found)


def language_health(spark, sf_dir):
    """The flagship: findings, triage and size of each language's documents, scored and graded."""
    return score.health(*_scored(spark, sf_dir))


def dimension_scores(spark, sf_dir):
    return score.dimension_scores(*_scored(spark, sf_dir))


DIMENSIONS = f"""{FINDINGS}, {TRIAGE},
subjects AS (SELECT lang AS subject, sum(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN right(text, 1) = chr(10) THEN 0 ELSE 1 END END) AS lines FROM documents GROUP BY lang),
copies AS (SELECT lang AS subject, sum(CASE WHEN n > 1 THEN n ELSE 0 END) * 100.0::DOUBLE / sum(n) AS duplication FROM (SELECT lang, sha256(text), count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang),
dims(dimension, weight, cats, kloc, present) AS (VALUES ('security', 25, ['SECRET', 'SECURITY'], false, true), ('codeQuality', 15, ['CODE_QUALITY'], true, true), ('dependencies', 15, ['DEPENDENCY'], false, false), ('testing', 15, ['TESTING'], false, false),
  ('architecture', 10, ['ARCHITECTURE'], true, false), ('documentation', 10, ['DOCUMENTATION'], false, true), ('api', 5, ['API'], false, false), ('database', 5, ['DATABASE'], false, false)),
live AS (SELECT * FROM findings WHERE fingerprint NOT IN (SELECT fingerprint FROM triage)),
c AS (SELECT lang AS subject, dimension, kloc, severity, count(*) AS n FROM live JOIN dims ON list_contains(cats, category) GROUP BY ALL),
pts AS (SELECT c.subject, dimension, floor(least(CASE severity WHEN 'CRITICAL' THEN 60 WHEN 'HIGH' THEN 45 WHEN 'MEDIUM' THEN 30 WHEN 'LOW' THEN 15 ELSE 0 END::DOUBLE,
  CASE severity WHEN 'CRITICAL' THEN 30 WHEN 'HIGH' THEN 15 WHEN 'MEDIUM' THEN 6 WHEN 'LOW' THEN 2 ELSE 0 END * (n / CASE WHEN kloc THEN greatest(1.0::DOUBLE, lines / 1000.0::DOUBLE) ELSE 1.0::DOUBLE END)) * 10 + 0.5) / 10 AS p FROM c JOIN subjects USING (subject)),
lost AS (SELECT subject, dimension, sum(p) AS lost FROM pts GROUP BY ALL),
uses AS (SELECT DISTINCT lang AS subject, dimension FROM findings JOIN dims ON list_contains(cats, category)),
dimension_scores AS (SELECT s.subject, d.dimension, d.weight, d.present OR u.subject IS NOT NULL AS applies,
  CASE WHEN d.present OR u.subject IS NOT NULL THEN greatest(0, floor(100 - least(100.0::DOUBLE, coalesce(lost, 0) + CASE WHEN d.dimension = 'codeQuality' AND duplication > 5 THEN floor(least(15.0::DOUBLE, duplication - 5) * 10 + 0.5) / 10 ELSE 0 END) + 0.5))::INT END AS score
  FROM subjects s CROSS JOIN dims d JOIN copies USING (subject) LEFT JOIN lost l ON l.subject = s.subject AND l.dimension = d.dimension LEFT JOIN uses u ON u.subject = s.subject AND u.dimension = d.dimension)"""
LANGUAGE_HEALTH = f"""WITH {DIMENSIONS},
mean AS (SELECT subject, floor(sum(weight * score) / sum(weight)::DOUBLE + 0.5)::INT AS m FROM dimension_scores WHERE applies GROUP BY subject),
worst AS (SELECT lang AS subject, min(severity_rank) AS w FROM live WHERE category IN ('SECRET', 'SECURITY') GROUP BY lang),
final AS (SELECT subject, least(m, CASE w WHEN 0 THEN 49 WHEN 1 THEN 69 ELSE 100 END) AS score FROM mean LEFT JOIN worst USING (subject))
SELECT subject, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM final"""


QUERIES = {
    "secret_findings": (secret_findings, SECRET_FINDINGS),
    "findings_page": (findings_page, FINDINGS_PAGE),
    "findings_facets": (findings_facets, FINDINGS_FACETS),
    "triage_untriaged": (_triaged("untriaged"), _triaged_sql("NOT")),
    "triage_triaged": (_triaged("triaged"), _triaged_sql("")),
    "severity_counts": (severity_counts, SEVERITY_COUNTS),
    "worst_per_document": (worst_per_document, WORST_PER_DOCUMENT),
    "most_severe_kept": (most_severe_kept, MOST_SEVERE_KEPT),
    "capped_lists": (capped_lists, CAPPED_LISTS),
    "dimension_scores": (dimension_scores, f"WITH {DIMENSIONS} SELECT subject, dimension, weight, applies, score FROM dimension_scores"),
    "language_health": (language_health, LANGUAGE_HEALTH),
}
