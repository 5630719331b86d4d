"""A source tree to typed tables: inventory, metrics, symbols, imports, findings, graph, score; written as partitioned Parquet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import rank_of, round_half_up, threshold_severity
from ..functions.rules import catalogue
from ..functions.text import LAYER_ORDER, infer_layer, line_count
from ..operators import aggregates, clones, dependency_rules, graph, joins, practice_rules, query, resolve, score, secret_rules
from ..sources import brace_code, files, manifests, practices, python_code, routes, schemas, tooling
from ..sources.parse import parsed
from .scratch import Scratch

MODULES = ("code", "security", "dependencies", "architecture", "practices")
MOST_KEPT = 5000
#: Lines beyond which a copied block is worse.
LONG_COPY = 30

# What shows a specification, its tools, its documents, a rate limit, and the placeholder of a test script.
SPECIFICATION = r"(?i)(?:^|/)(?:openapi|swagger)[\w.-]*\.(?:json|ya?ml)$"
SPECIFICATION_TOOLS = r"(?i)swagger|openapi|springdoc|drf-spectacular|drf-yasg|flasgger|\btsoa\b|apispec"
API_DOCUMENTS = r"(?i)(?:^|/)(?:docs?/)?api[\w-]*\.(?:md|mdx|rst|adoc)$|(?:^|/)docs?/api/"
RATE_LIMIT = r"(?i)rate[-_ ]?limit|throttl|slowapi|bucket4j|express-slow-down|\blimiter\b|brute"
NO_TEST = "no test specified"
MANIFEST = r"(?:^|/)(?:package\.json|requirements[^/]*\.txt|pyproject\.toml|pom\.xml|build\.gradle(?:\.kts)?)$"


def _some(rows: DataFrame, condition: Column | None = None) -> bool:
    return not (rows if condition is None else rows.where(condition)).isEmpty()


def _copies(code: DataFrame, s: Scratch) -> tuple[DataFrame, DataFrame]:
    """(findings of copied blocks, duplicated lines of each path) of the production code of the tree, taken as one
    repository, so its scan is one task; a tree has at most as many files as the inventory reads."""
    source = code.where("kind = 'SOURCE'")
    tokens = parsed(source.where("language = 'python'"), python_code.tokens, brace_code.TOKENS).union(parsed(source.where("language <> 'python'"), brace_code.tokens, brace_code.TOKENS))
    found = s.save(clones.greedy_clones(tokens.withColumn("repository", F.lit("")).select("repository", "path", "hashes", "rows")), "clones")
    lines = F.col("last_line") - F.col("first_line") + 1
    evidence = F.format_string("lines %d-%d (%d tokens) are those of lines %d-%d of %s", "first_line", "last_line", "tokens", "original_first", "original_last", "original")
    severity = F.when(lines > LONG_COPY, "MEDIUM").otherwise("LOW")
    rows = found.select(F.lit("duplication/duplicate-block").alias("rule_id"), severity.alias("severity"), "path", F.col("first_line").alias("line"), evidence.alias("evidence"), F.concat_ws(":", F.lit("dup"), "original", F.col("tokens").cast("string")).alias("key"))
    both = found.select("path", "first_line", "last_line").union(found.select(F.col("original"), F.col("original_first"), F.col("original_last")))
    return rows, clones.duplicated_lines(both)


def _raw(df: DataFrame, module: str) -> DataFrame:
    """A finding in the common form; what is missing is null."""
    has = lambda c, t: F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)
    return df.select("rule_id", "severity", has("path", "string").alias("path"), has("line", "int").alias("line"), has("evidence", "string").alias("evidence"), F.coalesce(has("key", "string"), has("evidence", "string"), F.lit("")).alias("key"), F.lit(module).alias("module"))


def _threshold_findings(functions: DataFrame, metrics: DataFrame, symbols: DataFrame) -> DataFrame:
    rules = (("complexity/high-cyclomatic", "complexity", "complexity"), ("complexity/deep-nesting", "nesting", "nesting"), ("smell/long-parameter-list", "parameters", "parameters"))
    out = [functions.select(F.lit(rule).alias("rule_id"), threshold_severity(F.col(c), m).alias("severity"), "path", "line", F.concat_ws(" ", "name", F.col(c).cast("string")).alias("evidence"), F.col("name").alias("key")) for rule, c, m in rules]
    out.append(functions.select(F.lit("size/long-function"), threshold_severity(F.col("end_line") - F.col("line") + 1, "function_lines"), "path", "line", F.col("name"), F.col("name")))
    methods = symbols.where("kind = 'method'").groupBy("path", F.col("parent").alias("name")).agg(F.count("*").alias("methods"))
    classes = symbols.where("kind = 'class'").select("path", "name", "line").join(methods, ["path", "name"])
    out.append(classes.select(F.lit("smell/god-class"), threshold_severity(F.col("methods"), "class_methods"), "path", "line", F.concat_ws(" ", "name", F.col("methods").cast("string")), F.col("name")))
    out.append(metrics.select(F.lit("size/large-file"), threshold_severity(F.col("code_lines"), "file_lines"), "path", F.lit(1), F.col("code_lines").cast("string"), F.lit("file")))
    return reduce(DataFrame.union, out).where("severity is not null")


def analyse(spark: SparkSession, root: str, advisories: DataFrame | None = None, excluded: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every table of one analysis. Each file is parsed once per table it feeds; parsed tables are written, not recomputed."""
    s = Scratch(spark)
    tree, truncated = files.read_tree(spark, root)
    inventory = s.save(files.inventory(tree), "files")
    code = inventory.where(F.col("kind").isin("SOURCE", "TEST") & F.col("text").isNotNull() & files.skipped(F.col("text")).isNull())
    python, braces = code.where("language = 'python'"), code.where(F.col("language").isin("javascript", "typescript", "java", "c", "cpp"))
    shared = ["path", "code_lines", "comment_lines", "blank_lines", "functions", "classes", "max_complexity", "max_nesting"]
    metrics = s.save(parsed(python, python_code.metrics, python_code.METRICS).select(*shared).union(parsed(braces, brace_code.metrics, brace_code.METRICS).select(*shared)), "metrics")
    span = ["path", "name", "line", "end_line", "complexity", "nesting", "parameters"]
    functions = s.save(parsed(python, python_code.functions, python_code.FUNCTIONS).select(*span).union(parsed(braces, brace_code.functions, brace_code.FUNCTIONS).select(*span)), "functions")
    tools = parsed(inventory.select("path", F.coalesce("text", F.lit("")).alias("text")), tooling.detections, tooling.DETECTIONS).union(parsed(inventory, tooling.frameworks, tooling.DETECTIONS))
    runtimes = parsed(inventory, tooling.runtimes, tooling.RUNTIMES)
    name = ["path", "name", "kind", "parent", "exported", "line"]
    symbols = s.save(parsed(python, python_code.symbols, python_code.SYMBOLS).select(*name).union(parsed(braces.where(F.col("language").isin("javascript", "typescript")), brace_code.symbols, brace_code.SYMBOLS).select(*name)), "symbols")

    # imports and graph
    py_imports = parsed(python, python_code.imports, python_code.IMPORTS).select("path", F.lit("python").alias("language"), "specifier")
    js = braces.where(F.col("language").isin("javascript", "typescript")).select("path", "language", F.explode(F.regexp_extract_all("text", F.lit(r"(?:from\s+|require\(\s*|import\(\s*|import\s+)['\"]([^'\"\n]+)['\"]"), F.lit(1))).alias("specifier"))
    java = braces.where("language = 'java'").select("path", "language", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;"), F.lit(1))).alias("specifier"))
    c = braces.where(F.col("language").isin("c", "cpp")).select("path", "language", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*#\s*include\s+\"([^\"]+)\""), F.lit(1))).alias("specifier"))
    packages = inventory.where("path like '%package.json'").select(F.get_json_object("text", "$.name").alias("name"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory")).where("name is not null")
    imports = s.save(resolve.imports(py_imports.union(js).union(java).union(c), inventory.select("path"), packages=packages), "imports")
    edges = s.save(graph.weighted_edges(imports.select(F.col("path").alias("from_path"), "to_path")).join(inventory.where("kind = 'SOURCE'").select(F.col("path").alias("src")), "src", "left_semi"), "edges")
    layered = inventory.select(F.col("path").alias("id"), infer_layer(F.col("path")).alias("layer")).where("layer is not null")
    violations = joins.upward(edges, layered.select("id", rank_of(F.col("layer"), LAYER_ORDER).alias("rank")))
    components = graph.strong_components(edges, s)
    fan = aggregates.fan_in_out(edges, inventory.where("kind = 'SOURCE'").select(F.col("path").alias("id")))

    # findings of the five modules
    secret_text = inventory.where(F.col("text").isNotNull() & (F.col("kind") != "GENERATED")).select("path", "kind", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    lines = secret_text.select("path", "kind", (F.col("at") + 1).alias("line"), "text")
    direct = s.save(parsed(inventory, manifests.dependencies, manifests.DEPENDENCIES), "dependencies")
    locked = s.save(parsed(inventory, manifests.locked, manifests.LOCKED), "locked")
    resolved = dependency_rules.resolved_by_lock(direct, locked)
    endpoints = s.save(parsed(code.where("kind = 'SOURCE'"), routes.endpoints, routes.ENDPOINTS), "endpoints")
    tests = parsed(code.where("kind = 'TEST'"), practices.tests, practices.TESTS)
    texts = inventory.where("text is not null")
    coverage = parsed(texts.where(F.col("path").rlike(r"(?i)(?:^|/)(?:lcov\.info|coverage-summary\.json|coverage\.json|coverage\.xml|cobertura[\w-]*\.xml|jacoco[\w-]*\.xml)$")), practices.coverage, practices.COVERAGE)
    sized = inventory.select("path", "kind", F.coalesce(line_count(F.col("text")), F.lit(0)).alias("lines"))
    ci = not texts.where(F.col("path").rlike(r"^\.github/workflows/|^\.gitlab-ci\.yml$|^Jenkinsfile$") & F.col("text").rlike(r"\b(?:npm|pnpm|yarn)\s+(?:run\s+)?test\b|\b(?:pytest|vitest|jest|mvn|gradle)\b")).isEmpty()
    schema = parsed(texts.where(F.col("path").rlike(r"\.(?:sql|prisma)$")), schemas.schema, schemas.SCHEMA)
    test_imports = imports.join(inventory.where("kind = 'TEST'").select("path"), "path", "left_semi").select("specifier")
    some_tests = not sized.where("kind = 'TEST'").isEmpty()
    untested = practice_rules.untested(sized, test_imports).where(F.lit(some_tests)).select(F.lit("testing/untested-file").alias("rule_id"), F.lit("INFO").alias("severity"), "path", F.col("lines").cast("string").alias("evidence"))
    migrations = not inventory.where(F.col("path").rlike(r"(?i)(?:^|/)(?:migrations?|alembic/versions|db/migrate)/")).isEmpty()
    documentation = texts.where("kind = 'DOCUMENTATION'")
    told = texts.where((F.col("kind") == "SOURCE") | F.col("path").rlike(MANIFEST))  # sources and manifests
    limited = _some(told, F.col("text").rlike(RATE_LIMIT))
    specified = _some(endpoints, F.col("framework") == "FastAPI") or _some(inventory, F.col("path").rlike(SPECIFICATION) | F.col("path").rlike(API_DOCUMENTS)) or _some(told, F.col("text").rlike(SPECIFICATION_TOOLS))
    test_script = F.get_json_object("text", "$.scripts.test")
    scripted = texts.where("path = 'package.json'").where(test_script.isNull() | test_script.contains(NO_TEST))
    script = not (_some(scripted) and _some(code, (F.col("kind") == "SOURCE") & F.col("language").isin("javascript", "typescript")))
    copied, duplicated = _copies(code, s)
    found = [
        _raw(_threshold_findings(functions, metrics, symbols), "code"),
        _raw(parsed(python, python_code.quality, python_code.FINDINGS), "code"),
        _raw(parsed(braces, brace_code.findings, brace_code.FINDINGS), "code"),
        _raw(parsed(python, python_code.insecure, python_code.FINDINGS), "security"),
        _raw(secret_rules.scan_lines(lines), "security"),
        _raw(secret_rules.env_values(lines), "security"),
        _raw(dependency_rules.hygiene(resolved, locked).withColumn("evidence", F.coalesce("name", F.lit("no lock file"))), "dependencies"),
        _raw(practice_rules.architecture_findings(components, inventory.select(F.col("path").alias("id"), "language"), violations, fan), "architecture"),
        _raw(copied, "code"),
        _raw(practice_rules.api_findings(endpoints, specified, limited), "practices"),
        _raw(parsed(code.where("kind = 'SOURCE'"), practices.setup_checks, practices.CHECKS), "practices"),
        _raw(practice_rules.database_findings(schema, migrations), "practices"),
        _raw(untested, "practices"),
        _raw(practice_rules.testing_findings(practice_rules.testing_summary(sized, tests, coverage), tests, ci, script), "practices"),
        _raw(practice_rules.documentation_findings(texts, parsed(documentation, practices.documentation_links, "path string, target string, line int"), parsed(code.where("kind = 'SOURCE'"), practices.environment, "path string, name string, line int"), texts.where(F.col("path").rlike(r"(?i)readme|\.env\.(?:example|sample|template)$")).select(F.explode(F.regexp_extract_all("text", F.lit(r"\b([A-Z][A-Z0-9_]{2,})\b"), F.lit(1))).alias("name")).distinct()), "practices"),
    ]
    if advisories is not None:
        hits = dependency_rules.fixed_versions(dependency_rules.advisory_matches(resolved, advisories))
        found.append(_raw(hits.select(F.lit("dependency/known-vulnerability").alias("rule_id"), "severity", "path", F.concat_ws(" ", "name", F.array_join("advisories", ",")).alias("evidence")), "dependencies"))
    union = reduce(DataFrame.unionByName, found).withColumn("module_order", F.array_position(F.array(*map(F.lit, MODULES)), F.col("module")))
    union = union.join(F.broadcast(catalogue(spark)), "rule_id").withColumn("emit_order", F.struct("module_order", "line", "evidence"))
    findings = s.save(query.with_fingerprints(union).drop("emit_order", "module_order"), "findings")

    lines_of_code = metrics.join(inventory.where("kind = 'SOURCE'").select("path"), "path", "left_semi").agg(F.coalesce(F.sum("code_lines"), F.lit(0)).alias("lines"))
    some_code = not code.where("kind = 'SOURCE'").isEmpty()
    present = F.array_compact(F.array(F.when(F.lit(some_code), "codeQuality"), F.when(F.lit(some_code), "testing"), F.when(F.lit(not direct.isEmpty()), "dependencies"), F.when(F.lit(not edges.isEmpty()), "architecture"), F.when(F.lit(not endpoints.isEmpty()), "api"), F.when(F.lit(not schema.isEmpty()), "database")))
    twice = duplicated.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("twice"))
    percent = round_half_up(F.coalesce(F.try_divide(F.col("twice") * 100.0, F.col("lines")), F.lit(0.0)), 2)
    subjects = lines_of_code.crossJoin(F.broadcast(twice)).select(F.lit(root).alias("subject"), "lines", percent.alias("duplication"), present.alias("present"))  # one row each
    none = spark.createDataFrame([], "fingerprint string") if excluded is None else excluded
    health = score.health(findings.withColumn("subject", F.lit(root)), subjects, none)
    summary = findings.agg(F.count("*").alias("findings"), F.lit(truncated).alias("truncated"), (F.count("*") > MOST_KEPT).alias("findings_truncated"))
    return {"files": inventory.drop("text"), "metrics": metrics, "functions": functions, "symbols": symbols, "imports": imports, "edges": edges, "dependencies": resolved, "locked": locked, "endpoints": endpoints, "tools": tools, "runtimes": runtimes, "findings": findings, "health": health, "summary": summary}


def write(tables: dict[str, DataFrame], folder: str, analysis_id: str) -> None:
    """Tables as Parquet partitioned by analysis; a rerun of an analysis replaces its own rows only."""
    for name, df in tables.items():
        df.withColumn("analysis_id", F.lit(analysis_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("analysis_id").parquet(f"{folder}/{name}")
