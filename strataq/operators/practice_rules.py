"""Findings from what the practice readers saw: API, database, testing, documentation and architecture rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import threshold_severity, upgrade
from ..functions.text import dir_of, join_path, source_stem, specifier_stem, test_stem, word_count

# Thresholds.
SPEC_FROM, TESTS_FROM, TESTS_HIGH, RATIO = 5, 200, 2000, ((0.05, "MEDIUM"), (0.2, "LOW"))
COVERAGE, UNTESTED_LINES, UNTESTED_MOST, README_WORDS, LINKS_MOST = ((50, "MEDIUM"), (70, "LOW")), 150, 20, 150, 50
MUTATING = ("POST", "PUT", "PATCH", "DELETE")


def _rows(df: DataFrame, rule: str, severity: Column | str, evidence: Column, path: str = "path", line: Column | None = None) -> DataFrame:
    return df.select(F.lit(rule).alias("rule_id"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.col(path).alias("path") if path in df.columns else F.lit(None).cast("string").alias("path"), (line if line is not None else F.lit(None).cast("int")).alias("line"), evidence.alias("evidence"))


def api_findings(endpoints: DataFrame, has_specification: bool, has_rate_limit: bool) -> DataFrame:
    """Changing routes without authentication, bodies without validation, sign-in without a rate limit, many routes without
    a specification."""
    route = F.concat_ws(" ", "method", "route")
    a = _rows(endpoints.where(F.col("method").isin(*MUTATING) & ~F.col("auth")), "api/unauthenticated-mutation", "MEDIUM", route, line=F.col("line"))
    b = _rows(endpoints.where(F.col("method").isin(*MUTATING) & F.col("reads_body") & ~F.col("validated")), "api/missing-input-validation", "LOW", route, line=F.col("line"))
    login = endpoints.where(F.col("route").rlike(r"(?i)/(?:login|signin|sign-in|auth|token|password|register|signup)(?:/|$)") & F.col("method").isin("POST", "ANY"))
    c = _rows(login.where(F.lit(not has_rate_limit)), "api/auth-without-rate-limit", "MEDIUM", route, line=F.col("line"))
    n = endpoints.agg(F.count("*").alias("n")).where((F.col("n") >= SPEC_FROM) & F.lit(not has_specification))
    return a.union(b).union(c).union(_rows(n, "api/no-specification", "LOW", F.concat(F.col("n").cast("string"), F.lit(" endpoints"))))


def endpoint_summary(endpoints: DataFrame) -> DataFrame:
    """Counts by method, by framework and in all, in one pass: (what, value, n, mutating, without_auth, unvalidated)."""
    mutating = F.col("method").isin(*MUTATING)
    g = endpoints.groupingSets([["method"], ["framework"], []], "method", "framework").agg(
        F.count("*").alias("n"), F.count_if(mutating).alias("mutating"), F.count_if(mutating & ~F.col("auth")).alias("without_auth"), F.count_if(F.col("reads_body") & ~F.col("validated")).alias("unvalidated"), F.grouping_id().alias("g"),
    )
    return g.select(F.when(F.col("g") == 1, "method").when(F.col("g") == 2, "framework").otherwise("all").alias("what"), F.coalesce("method", "framework", F.lit("all")).alias("value"), "n", "mutating", "without_auth", "unvalidated")


def database_findings(schema: DataFrame, has_migrations: bool = True) -> DataFrame:
    """Foreign keys that no index begins with, in their order, tables without a primary key, and models without migration
    files. schema: path, owner, kind, columns, line."""
    keys = schema.where(F.col("kind").isin("index", "primary")).groupBy("owner").agg(F.collect_list("columns").alias("keys"))
    fk = schema.where("kind = 'foreign'").join(keys, "owner", "left")
    covered = F.exists(F.coalesce("keys", F.array().cast("array<array<string>>")), lambda k: F.slice(k, F.lit(1), F.size("columns")) == F.col("columns"))
    a = _rows(fk.where(~covered), "database/unindexed-foreign-key", "LOW", F.concat(F.col("owner"), F.lit("."), F.array_join("columns", ",")), line=F.col("line"))
    bare = schema.where("kind = 'table'").join(schema.where("kind = 'primary'").select("owner").distinct(), "owner", "left_anti")
    models = schema.where(F.col("path").endswith(".prisma") & (F.col("kind") == "table") & F.lit(not has_migrations)).groupBy("path").agg(F.count("*").alias("models"))
    b = _rows(bare, "database/table-without-primary-key", "MEDIUM", F.col("owner"), line=F.col("line"))
    return a.union(b).union(_rows(models, "database/no-migrations", "LOW", F.concat(F.col("models").cast("string"), F.lit(" models"))))


def testing_summary(files: DataFrame, tests: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row: test and source lines, their ratio (2 places), cases, focused, skipped, the lowest coverage reported."""
    s = files.agg(F.coalesce(F.sum(F.when(F.col("kind") == "TEST", F.col("lines"))), F.lit(0)).alias("test_lines"), F.coalesce(F.sum(F.when(F.col("kind") == "SOURCE", F.col("lines"))), F.lit(0)).alias("source_lines"))
    t = tests.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("cases", "focused", "skipped")])
    c = coverage.agg(F.min("percent").alias("coverage"))
    ratio = F.floor(F.try_divide(F.col("test_lines").cast("double"), F.col("source_lines")) * 100 + 0.5) / 100
    return s.crossJoin(t).crossJoin(c).withColumn("ratio", ratio)  # one row each


def testing_findings(summary: DataFrame, tests: DataFrame, in_ci: bool, script: bool) -> DataFrame:
    n, r = F.col("source_lines"), F.col("ratio")
    none = summary.where((n >= TESTS_FROM) & (F.col("test_lines") == 0))
    out = _rows(none, "testing/no-tests", F.when(n >= TESTS_HIGH, "HIGH").otherwise("MEDIUM"), F.concat(n.cast("string"), F.lit(" source lines")))
    low = summary.where((n >= TESTS_FROM) & (F.col("test_lines") > 0) & (r < RATIO[1][0]))
    out = out.union(_rows(low, "testing/low-test-ratio", F.when(r < RATIO[0][0], RATIO[0][1]).otherwise(RATIO[1][1]), r.cast("string")))
    covered = summary.where(F.col("coverage") < COVERAGE[1][0])
    out = out.union(_rows(covered, "testing/low-coverage", F.when(F.col("coverage") < COVERAGE[0][0], COVERAGE[0][1]).otherwise(COVERAGE[1][1]), F.col("coverage").cast("string")))
    out = out.union(_rows(tests.where("focused > 0"), "testing/focused-test", "MEDIUM", F.col("focused").cast("string")))
    out = out.union(_rows(tests.where("skipped > 0"), "testing/skipped-test", "LOW", F.col("skipped").cast("string")))
    some = summary.where("cases > 0")
    out = out.union(_rows(some.where(F.lit(not in_ci)), "testing/tests-not-in-ci", "LOW", F.col("cases").cast("string")))
    return out.union(_rows(some.where(F.lit(not script)), "testing/no-test-script", "LOW", F.col("cases").cast("string")))


def untested(files: DataFrame, test_imports: DataFrame) -> DataFrame:
    """The largest source files that no test imports or is named after. files: path, kind, lines. test_imports: specifier."""
    stems = files.where("kind = 'TEST'").select(test_stem(F.col("path")).alias("stem")).union(test_imports.select(specifier_stem(F.col("specifier")))).distinct()
    s = files.where((F.col("kind") == "SOURCE") & (F.col("lines") >= UNTESTED_LINES)).withColumn("stem", source_stem(F.col("path")))
    return s.join(stems, "stem", "left_anti").orderBy(F.desc("lines"), "path").limit(UNTESTED_MOST).select("path", "lines")


def documentation_findings(files: DataFrame, links: DataFrame, used: DataFrame, documented: DataFrame) -> DataFrame:
    """Missing or short README, missing license, undocumented variables, broken links. files: path, text. links: path,
    target, line. used and documented: name."""
    root = files.where(~F.col("path").contains("/"))
    none = lambda found: files.limit(1).select(F.lit(1).alias("one")).join(found.limit(1).select(F.lit(1).alias("one")), "one", "left_anti")
    readme, license_ = root.where(F.lower("path").rlike(r"^readme(?:\.[a-z]+)?$")), root.where(F.lower("path").rlike(r"^(?:license|licence|copying)(?:\.[a-z]+)?$"))
    out = _rows(none(readme), "documentation/missing-readme", "MEDIUM", F.lit("no README"))
    out = out.union(_rows(readme.where(word_count(F.col("text")) < README_WORDS), "documentation/incomplete-readme", "LOW", word_count(F.col("text")).cast("string")))
    out = out.union(_rows(none(license_), "documentation/missing-license", "LOW", F.lit("no license")))
    out = out.union(_rows(used.select("name").distinct().join(documented.select("name"), "name", "left_anti"), "documentation/undocumented-env-vars", "LOW", F.col("name")))
    target = F.when(F.col("target").startswith("/"), F.substring("target", 2, 4000)).otherwise(join_path(dir_of(F.col("path")), F.col("target")))
    there = files.select(F.col("path").alias("to")).union(files.select(dir_of(F.col("path")))).distinct()
    broken = links.withColumn("to", F.regexp_replace(target, "/$", "")).join(there, "to", "left_anti").orderBy("path", "line", "target").limit(LINKS_MOST)
    return out.union(_rows(broken, "documentation/broken-link", "LOW", F.col("target"), line=F.col("line")))


def architecture_findings(components: DataFrame, languages: DataFrame, violations: DataFrame, fan_out: DataFrame) -> DataFrame:
    """Cycles (MEDIUM with JavaScript or Python, else LOW; one step worse from ten files), layer violations, high fan-out
    (barrel files left out). components: id, component. languages: id, language. fan_out: id, fan_out."""
    c = components.join(languages, "id", "left").groupBy("component").agg(F.count("*").alias("size"), F.max(F.col("language").isin("javascript", "typescript", "python").cast("int")).alias("loose"))
    base = F.when(F.col("loose") == 1, "MEDIUM").otherwise("LOW")
    out = _rows(c, "architecture/circular-dependency", F.when(F.col("size") >= 10, upgrade(base)).otherwise(base), F.col("size").cast("string"), "component")
    out = out.union(_rows(violations, "architecture/layer-violation", "LOW", F.col("dst"), "src"))
    wide = fan_out.withColumn("severity", threshold_severity(F.col("fan_out"), "fan_out")).where(F.col("severity").isNotNull() & ~F.col("id").rlike(r"(?:^|/)(?:index\.[cm]?[jt]sx?|__init__\.py)$"))
    return out.union(_rows(wide, "architecture/high-fan-out", F.col("severity"), F.col("fan_out").cast("string"), "id"))


