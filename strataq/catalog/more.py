"""Further listings and exports: reports, summaries, evidence, route windows, tooling, rules, single texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import CATEGORY_OF, RULES, catalogue
from ..functions.text import base_of, infer_layer, repository_url, specifier_stem, test_stem
from ..operators import graph, joins, query, search
from ..plans import inspect, reports
from ..sources import tooling
from ..sources.parse import parsed
from ..sources.tables import inline, table, values
from .graphs import CODE_EDGES


def reports_page(spark, sf_dir):
    """Orders as reports: customers of a segment own them; page two of one owner's open ones, newest first."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    r = o.select(F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("owner"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("generated_at"))
    return query.reports_page(r, "BUILDING", 2, 30, status="O").select("id", "status")


REPORTS_PAGE = "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30 OFFSET 30"


def report_markdown(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.lit("LOW").alias("severity"), F.concat(F.col("n_name"), F.lit(" *x* [y]")).alias("title"), F.lower("n_name").alias("path"), F.col("n_nationkey").alias("line"))
    return reports.as_markdown(n)


REPORT_MARKDOWN = r"SELECT '- **LOW** ' || replace(n_name, '_', '\_') || ' \*x\* \[y\] (' || replace(lower(n_name), '_', '\_') || ':' || n_nationkey || ')' AS value FROM nation"


def report_chain(spark, sf_dir):
    s = inline(spark, [("a", "RUN", "TESTS_PASSED", "passed"), ("b", "RUN", "IN_PROGRESS", None), ("c", "ANALYSIS", "COMPLETED", None)], "run_id string, type string, outcome string, tests string")
    return reports.chain(s).select("run_id", "name", "state")


CHAIN = [("a", "analysis", "done"), ("a", "plan", "done"), ("a", "changes", "done"), ("a", "tests", "done"), ("a", "review", "pending"), ("b", "analysis", "done"), ("b", "plan", "done"), ("b", "changes", "pending"), ("b", "tests", "pending"), ("b", "review", "not done"), ("c", "analysis", "done"), ("c", "plan", "not done"), ("c", "changes", "not done"), ("c", "tests", "not done"), ("c", "review", "not done")]


def summary_json(spark, sf_dir):
    """A summary document per region, as it is stored with an analysis."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("nations"), F.min("n_name").alias("first"))
    return n.select("n_regionkey", F.to_json(F.struct("nations", "first")).alias("summary"))


SUMMARY_JSON = """SELECT n_regionkey, '{"nations":' || count(*) || ',"first":"' || min(n_name) || '"}' AS summary FROM nation GROUP BY 1"""

ROUTE_LINES = [("a.py", i, f"line {i}") for i in range(1, 11)]
ROUTES = [("a.py", 3), ("a.py", 6), ("a.py", 7)]
ROUTE_WINDOWS = [(3, "line 1\nline 2\nline 3\nline 4\nline 5"), (6, "line 4\nline 5\nline 6"), (7, "line 7\nline 8\nline 9\nline 10")]


def route_windows(spark, sf_dir):
    r, l = inline(spark, ROUTES, "path string, line int"), inline(spark, ROUTE_LINES, "path string, line int, text string")
    return joins.route_windows(r, l, F.lit(2)).select("line", "window")


def evidence_bundle(spark, sf_dir):
    """Evidence about the parts that a question names: their brand's other parts as dependants, their sizes as findings."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws("/", "p_type", "p_brand").alias("path"), (F.col("p_size") > 25).alias("exported"), F.col("p_size").alias("line"))
    hits = search.keyword_search(p, "red widget", 60)
    parts = {"symbol": p.select("path", F.col("path").alias("of"), F.col("name").alias("summary")), "finding": p.where("line > 45").select("path", F.col("path").alias("of"), F.concat(F.lit("size "), F.col("line").cast("string")).alias("summary"))}
    return search.evidence_bundle(hits, parts)


def _catalogue(spark, sf_dir):
    return catalogue(spark).groupBy("category").agg(F.count("*").alias("rules"), F.count("cwe").alias("with_cwe"))


_R = values([(i, CATEGORY_OF[i.split("/")[0]], c) for i, _, c in RULES])
TOOL_FILES = [("package.json", '{"engines": {"node": ">=20"}, "packageManager": "pnpm@9.1.0+sha", "dependencies": {"express": "4.18.2", "left": "1"}, "devDependencies": {"vitest": "1.0.0"}}'), ("pnpm-lock.yaml", ""), ("Dockerfile", "FROM --platform=linux/amd64 node:20-alpine AS b\nFROM python:3.12\n"), (".github/workflows/ci.yml", ""), (".env.example", ""), (".env", ""), ("README.md", ""), ("src/main.py", ""), ("pyproject.toml", '[project]\nrequires-python = ">=3.11"\ndependencies = ["fastapi"]\n'), (".tool-versions", "nodejs 20.1.0\nerlang 1\n"), ("go.mod", "module x\ngo 1.22\n")]
TOOLS = [("package.json", "framework", "Express"), ("package.json", "framework", "Vitest"), ("pyproject.toml", "framework", "FastAPI"), ("pnpm-lock.yaml", "package-manager", "pnpm"), ("Dockerfile", "container", "Dockerfile"), (".github/workflows/ci.yml", "ci", "GitHub Actions"), (".env.example", "env-template", "environment template"), (".env", "env-file", "environment file"), ("README.md", "document", "readme"), ("src/main.py", "entry", "entry file"), ("go.mod", "package-manager", "Go modules")]
VERSIONS = [("package.json", "Node.js", ">=20"), ("package.json", "pnpm", "9.1.0"), ("Dockerfile", "Node.js", "20-alpine"), ("Dockerfile", "Python", "3.12"), ("pyproject.toml", "Python", ">=3.11"), (".tool-versions", "Node.js", "20.1.0"), ("go.mod", "Go", "1.22")]


def tooling_detected(spark, sf_dir):
    f = inline(spark, TOOL_FILES, "path string, text string")
    return parsed(f, tooling.detections, tooling.DETECTIONS).union(parsed(f, tooling.frameworks, tooling.DETECTIONS))


def runtime_versions(spark, sf_dir):
    return parsed(inline(spark, TOOL_FILES, "path string, text string"), tooling.runtimes, tooling.RUNTIMES)


EDITED = [("a.py", "import os\n"), ("b.py", "x = 1\n")], [("a.py", "import os\nos.system(cmd)\ntoken = 'ghp_" + "a1B2" * 9 + "'\n"), ("b.py", "x = (\n"), ("tests/test_a.py", "eval(x)\n")]


def edit_reinspection(spark, sf_dir):
    before, after = (inline(spark, e, "path string, text string") for e in EDITED)
    return inspect.new_findings(before, after)


def related_tests(spark, sf_dir):
    """Names that tests and sources share: X12 on a handful of paths."""
    paths = inline(spark, [("src/orders.test.ts",), ("tests/test_billing.py",), ("a/CartTest.java",)], "path string")
    return paths.select("path", test_stem(F.col("path")).alias("stem"))


def specifiers(spark, sf_dir):
    return inline(spark, [("../src/orders.js",), ("app.pipeline",), ("com.demo.Service",)], "spec string").select("spec", specifier_stem(F.col("spec")).alias("stem"))


def layers_inferred(spark, sf_dir):
    d = inline(spark, [("src/api/x.ts",), ("src/user.repository.ts",), ("lib/OrderService.java",), ("core/x.ts",)], "path string")
    return d.select(base_of(F.col("path")).alias("file"), infer_layer(F.col("path")).alias("layer"))


URLS = [("https://github.com/a/b.git", "github.com", "a", "b"), ("https://gitlab.com/g/s/p/", "gitlab.com", "g/s", "p"), ("https://evil.example/a/b", None, None, None), ("git@github.com:a/b", None, None, None)]


def repository_urls(spark, sf_dir):
    d = inline(spark, [(u[0],) for u in URLS], "url string").withColumn("r", repository_url(F.col("url")))
    return d.select("url", "r.host", "r.owner", "r.name")


def importers(spark, sf_dir):
    e = inline(spark, CODE_EDGES, "from_path string, to_path string").withColumn("specifier", F.col("to_path"))
    a = query.importers_of(e, "core/orders.ts").select(F.lit("importer").alias("what"), F.col("from_path").alias("path"))
    return a.union(query.imports_of(e, "web/api/orders.ts").select(F.lit("import"), "to_path"))


CONFIG_FILES = [("package.json", "CONFIG"), ("src/app/index.ts", "SOURCE"), ("src/app/app.config.json", "CONFIG"), ("src/tsconfig.json", "CONFIG")]


def related_config(spark, sf_dir):
    f = inline(spark, CONFIG_FILES, "path string, kind string")
    m = inline(spark, [("", "package.json"), ("src", "src/tsconfig.json")], "directory string, manifest string")
    return graph.related_config(f, m, "src/app/index.ts").select("config", "why")


def role_turns(spark, sf_dir):
    """Conversations: the last turn of each role, and turns that don't alternate."""
    c = table(spark, sf_dir, "conversations")
    last = query.latest_per(c, ["conv_id", "role"], [F.desc("turn"), F.desc("text")]).groupBy("role").agg(F.count("*").alias("conversations"), F.sum("turn").alias("last_turns"))
    odd = joins.boundaries(c.groupBy("conv_id", "turn").agg(F.max("role").alias("role")), ["conv_id"], "turn")
    return last.crossJoin(F.broadcast(odd.agg(F.count_if(F.col("previous").isNull()).alias("first_turns"))))  # one row


ROLE_TURNS = "WITH l AS (SELECT conv_id, role, max(turn) AS turn FROM conversations GROUP BY 1, 2) SELECT role, count(*) AS conversations, sum(turn) AS last_turns, (SELECT count(DISTINCT conv_id) FROM conversations) AS first_turns FROM l GROUP BY role"


def _expect(rows, columns):
    return f"SELECT * FROM ({values(rows)}) t({columns})"


QUERIES = {
    "reports_page": (reports_page, REPORTS_PAGE),
    "report_markdown": (report_markdown, REPORT_MARKDOWN),
    "report_chain": (report_chain, _expect(CHAIN, "run_id, name, state")),
    "summary_json": (summary_json, SUMMARY_JSON),
    "route_windows": (route_windows, f"SELECT line, replace(w, '~', chr(10)) AS window FROM ({values([(n, w.replace(chr(10), '~')) for n, w in ROUTE_WINDOWS])}) t(line, w)"),
    "evidence_bundle": (evidence_bundle, None),
    "rule_catalogue": (_catalogue, f"SELECT category, count(*) AS rules, count(cwe) AS with_cwe FROM ({_R}) t(id, category, cwe) GROUP BY category"),
    "tooling_detected": (tooling_detected, _expect(TOOLS, "path, category, name")),
    "runtime_versions": (runtime_versions, _expect(VERSIONS, "path, name, version")),
    "edit_reinspection": (edit_reinspection, _expect([("a.py", "injection/os-command", 1), ("a.py", "secret/api-token", 1), ("b.py", "syntax/error", 1)], "path, rule_id, added")),
    "related_tests": (related_tests, _expect([("src/orders.test.ts", "orders"), ("tests/test_billing.py", "billing"), ("a/CartTest.java", "cart")], "path, stem")),
    "specifier_stems": (specifiers, _expect([("../src/orders.js", "orders"), ("app.pipeline", "pipeline"), ("com.demo.Service", "service")], "spec, stem")),
    "layers_inferred": (layers_inferred, _expect([("x.ts", "interface"), ("user.repository.ts", "data"), ("OrderService.java", "service"), ("x.ts", None)], "file, layer")),
    "repository_urls": (repository_urls, _expect(URLS, "url, host, owner, name")),
    "imports_and_importers": (importers, _expect([("importer", "web/api/orders.ts"), ("importer", "tests/orders.test.ts"), ("import", "core/orders.ts")], "what, path")),
    "related_config": (related_config, _expect([("src/tsconfig.json", "manifest"), ("src/app/app.config.json", "same directory")], "config, why")),
    "role_turns": (role_turns, ROLE_TURNS),
}
