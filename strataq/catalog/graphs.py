"""Graph queries: the trade graph of nations, and a small code graph of symbols, calls and imports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import graph, query, resolve, search
from ..plans.scratch import Scratch
from ..sources.tables import inline, table, values


def trade(spark, sf_dir, top: int = 2):
    """(src, dst): each nation's `top` supplying nations by number of lines, itself left out."""
    l, o, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    e = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    n = e.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count("*").alias("w"))
    return n.withColumn("k", F.row_number().over(W.partitionBy("src").orderBy(F.desc("w"), "dst"))).where(F.col("k") <= top).select("src", "dst")


def _trade(top: int) -> str:
    return f"""e AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS k FROM (
  SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)) WHERE k <= {top})"""


def bfs_distance(spark, sf_dir):
    s = Scratch(spark)
    e = s.save(trade(spark, sf_dir), "edges")
    return graph.bfs(e, inline(spark, [(0,)], "id long"), s, "out", 25).select("id", F.col("distance").cast("long").alias("distance"))


BFS_DISTANCE = f"""WITH RECURSIVE {_trade(2)}, r(id, distance) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT e.dst, r.distance + 1 FROM r JOIN e ON e.src = r.id WHERE r.distance < 25)
SELECT id, min(distance) AS distance FROM r GROUP BY id HAVING min(distance) > 0"""


def pagerank_20(spark, sf_dir):
    s = Scratch(spark)
    e = s.save(trade(spark, sf_dir, 3), "edges")
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return graph.pagerank(e, nodes, s).select("id", (F.floor(F.col("rank") * 1e6 + 0.5) / 1e6).alias("rank"))


_STEP = "SELECT n.id, 0.15::DOUBLE / c.n + 0.85::DOUBLE * (coalesce((SELECT sum(p.rank / o.out) FROM e JOIN p ON p.id = e.src JOIN o ON o.src = e.src WHERE e.dst = n.id), 0) + (SELECT coalesce(sum(rank), 0) FROM p WHERE id NOT IN (SELECT src FROM o)) / c.n) AS rank FROM n, c"
PAGERANK_20 = (
    f"WITH {_trade(3)}, n AS (SELECT n_nationkey::BIGINT AS id FROM nation), c AS (SELECT count(*)::DOUBLE AS n FROM n), o AS (SELECT src, count(*) AS out FROM e GROUP BY src), p0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / c.n AS rank FROM n, c), "
    + ", ".join(f"p{k} AS MATERIALIZED ({_STEP.replace(' p ', f' p{k - 1} p ').replace('FROM p WHERE', f'FROM p{k - 1} WHERE')})" for k in range(1, 21))
    + " SELECT id, floor(rank * 1e6 + 0.5) / 1e6 AS rank FROM p20"
)


def scc_cycles(spark, sf_dir):
    s = Scratch(spark)
    e = s.save(trade(spark, sf_dir, 1), "edges")
    return graph.strong_components(e, s)


SCC_CYCLES = f"""WITH RECURSIVE {_trade(1)}, r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b), m AS (SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a)
SELECT a AS id, min(b) AS component FROM m GROUP BY a"""


def shortest_cycle(spark, sf_dir):
    s = Scratch(spark)
    e = s.save(trade(spark, sf_dir, 1), "edges")
    return graph.shortest_cycle(e, graph.strong_components(e, s), s).select("component", F.col("length").cast("long").alias("length"))


SHORTEST_CYCLE = f"""WITH RECURSIVE {_trade(1)}, r(a, b, d) AS (SELECT src, dst, 1::BIGINT FROM e UNION SELECT r.a, e.dst, d + 1 FROM r JOIN e ON e.src = r.b WHERE d < 26), comp AS (SELECT a AS id, min(a) AS x FROM r WHERE a = b GROUP BY a),
m AS (SELECT p.a, min(p.b) AS component FROM (SELECT DISTINCT a, b FROM r) p JOIN (SELECT DISTINCT a, b FROM r) q ON p.a = q.b AND p.b = q.a GROUP BY p.a)
SELECT m.component, min(r.d) AS length FROM m JOIN r ON r.a = m.component AND r.b = m.component WHERE m.a = m.component GROUP BY m.component"""


def cycles(spark, sf_dir):
    s = Scratch(spark)
    e = s.save(trade(spark, sf_dir, 1), "edges")
    return graph.cycles(graph.strong_components(e, s)).select("component", F.col("size"), F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


CYCLES = f"WITH RECURSIVE s AS ({SCC_CYCLES.replace('WITH RECURSIVE ', 'WITH RECURSIVE ')}) SELECT component, count(*) AS size, string_agg(id::VARCHAR, ',' ORDER BY id) AS members FROM s GROUP BY component"

# A small code base: file imports, symbols and call sites.
CODE_EDGES = [("web/app.ts", "web/api/orders.ts"), ("web/api/orders.ts", "core/orders.ts"), ("core/orders.ts", "core/db.ts"), ("core/billing.ts", "core/db.ts"), ("tests/orders.test.ts", "core/orders.ts"), ("core/db.ts", "core/types.ts"), ("cli/main.ts", "core/billing.ts"), ("core/types.ts", "core/types.ts")]
CODE_TESTS = [("tests/orders.test.ts",), ("tests/db.spec.ts",)]
SYMBOLS = [
    ("s1", "createOrder", "function", "core/orders.ts", None, True, 10), ("s2", "createorder", "function", "legacy/orders.ts", None, True, 5), ("s3", "save", "method", "core/db.ts", "Db", False, 20),
    ("s4", "connect", "function", "core/db.ts", None, True, 3), ("s5", "bill", "function", "core/billing.ts", None, True, 8), ("s6", "OrderPage", "class", "web/app.ts", None, True, 1), ("s7", "total", "function", "core/orders.ts", None, False, 40),
]
REFERENCES = [
    ("web/api/orders.ts", "s6", "s1", "createOrder", None, 12), ("tests/orders.test.ts", None, "s1", "createOrder", None, 4), ("cli/main.ts", "s5", None, "createOrder", None, 9), ("tests/orders.test.ts", None, None, "createOrder", None, 4),
    ("core/orders.ts", "s1", "s3", "save", "db", 14), ("core/billing.ts", "s5", "s4", "connect", None, 9),
]
SYMBOL_SCHEMA = "key string, name string, kind string, path string, parent string, exported boolean, line int"
REFERENCE_SCHEMA = "path string, from_key string, target_key string, name string, receiver string, line int"


def impact_file(spark, sf_dir):
    e, t = inline(spark, CODE_EDGES, "src string, dst string"), inline(spark, CODE_TESTS, "path string")
    d = graph.impact(e, "core/db.ts", t, Scratch(spark))
    return d.select("path", F.col("distance").cast("long").alias("distance"), "relation")


IMPACT_FILE = f"""WITH RECURSIVE e(src, dst) AS ({values(CODE_EDGES)}), t(path) AS ({values(CODE_TESTS)}), r(id, d) AS (SELECT 'core/db.ts', 0::BIGINT UNION SELECT src, d + 1 FROM r JOIN e ON dst = id AND src <> dst WHERE d < 10),
h AS (SELECT id AS path, min(d) AS distance FROM r GROUP BY id HAVING min(d) > 0)
SELECT path, distance, CASE WHEN path IN (SELECT path FROM t) THEN 'test' WHEN distance = 1 THEN 'direct' ELSE 'transitive' END AS relation FROM h UNION ALL SELECT path, NULL, 'test by name' FROM t WHERE path NOT IN (SELECT path FROM h) AND regexp_extract(path, '([^/]*)\\.(?:test|spec)\\.ts$', 1) = 'db'"""


def callers(spark, sf_dir):
    return graph.callers(inline(spark, REFERENCES, REFERENCE_SCHEMA), "s1", "createOrder").select("path", "line", "resolved")


CALLERS = f"""WITH r(path, from_key, target_key, name, receiver, line) AS ({values(REFERENCES)}), x AS (SELECT path, line, true AS resolved FROM r WHERE target_key = 's1')
SELECT * FROM x UNION ALL SELECT path, line, false FROM r WHERE target_key IS NULL AND name = 'createOrder' AND (path, line) NOT IN (SELECT (path, line) FROM x)"""


def symbols_with_callers(spark, sf_dir):
    return query.symbols_page(inline(spark, SYMBOLS, SYMBOL_SCHEMA), inline(spark, REFERENCES, REFERENCE_SCHEMA), q="ORDER", exported=True).select("key", "name", "path", "callers")


SYMBOLS_WITH_CALLERS = f"""WITH s(key, name, kind, path, parent, exported, line) AS ({values(SYMBOLS)}), r(path, from_key, target_key, name, receiver, line) AS ({values(REFERENCES)})
SELECT key, name, path, (SELECT count(*) FROM r WHERE target_key = key) AS callers FROM s WHERE contains(lower(name), 'order') AND exported"""


def find_symbols(spark, sf_dir):
    s = inline(spark, SYMBOLS, SYMBOL_SCHEMA)
    return graph.find_symbols(s, "createOrder").select("key", "name").union(graph.find_symbols(s, "CREATEORDER").select(F.concat("key", F.lit("*")), "name"))


FIND_SYMBOLS = f"WITH s(key, name, kind, path, parent, exported, line) AS ({values(SYMBOLS)}) SELECT key, name FROM s WHERE name = 'createOrder' UNION ALL SELECT key || '*', name FROM s WHERE lower(name) = 'createorder'"


def references_listed(spark, sf_dir):
    return query.references_of(inline(spark, REFERENCES, REFERENCE_SCHEMA), inline(spark, SYMBOLS, SYMBOL_SCHEMA), symbol_key="s1").select("path", "line", "caller")


REFERENCES_LISTED = f"WITH s(key, name, kind, path, parent, exported, line) AS ({values(SYMBOLS)}), r(path, from_key, target_key, name, receiver, line) AS ({values(REFERENCES)}) SELECT r.path, r.line, s.name AS caller FROM r LEFT JOIN s ON key = from_key WHERE target_key = 's1'"


def symbol_impact(spark, sf_dir):
    r, e = inline(spark, REFERENCES, REFERENCE_SCHEMA), inline(spark, CODE_EDGES, "src string, dst string")
    called = graph.symbol_impact(r, e, "s1", "createOrder", "core/orders.ts").withColumn("of", F.lit("s1"))
    return called.union(graph.symbol_impact(r, e, "s7", "total", "core/orders.ts").withColumn("of", F.lit("s7")))


SYMBOL_IMPACT = f"WITH e(src, dst) AS ({values(CODE_EDGES)}) SELECT DISTINCT path, 'call' AS reason, 's1' AS of FROM (VALUES ('web/api/orders.ts'), ('tests/orders.test.ts'), ('cli/main.ts')) t(path) UNION ALL SELECT src, 'import', 's7' FROM e WHERE dst = 'core/orders.ts'"


def impact_subgraph(spark, sf_dir):
    return graph.subgraph(inline(spark, CODE_EDGES, "src string, dst string"), "core/db.ts").select("src", "dst")


IMPACT_SUBGRAPH = f"WITH e(src, dst) AS ({values(CODE_EDGES)}), n AS (SELECT src AS id FROM e WHERE dst = 'core/db.ts' UNION SELECT 'core/db.ts') SELECT src, dst FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)"


def architecture_graph(spark, sf_dir):
    """The ten nations of highest degree in the trade graph and the edges between them."""
    e = trade(spark, sf_dir, 2).withColumn("in_cycle", F.lit(False))
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("label"))
    top, edges = query.architecture_graph(nodes, e, 10)
    return edges.select("src", "dst")


ARCHITECTURE_GRAPH = f"""WITH {_trade(2)}, d AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id), t AS (SELECT n_nationkey AS id FROM nation LEFT JOIN d ON id = n_nationkey ORDER BY coalesce(n, 0) DESC, n_name LIMIT 10)
SELECT src, dst FROM e WHERE src IN (SELECT id FROM t) AND dst IN (SELECT id FROM t)"""

CALLS = [("a.ts", "run", None, 3), ("a.ts", "load", "db", 4), ("a.ts", "map", "items", 5), ("b.ts", "run", None, 2), ("b.ts", "save", "this", 7), ("a.ts", "ghost", None, 9)]
BINDINGS = [("a.ts", "run", "core/run.ts", "run"), ("a.ts", "db", "core/db.ts", "*"), ("b.ts", "fetch", None, None)]
DEFINED = [("k1", "run", "core/run.ts", None), ("k2", "load", "core/db.ts", None), ("k3", "save", "b.ts", "Store"), ("k4", "save", "c.ts", "Other"), ("k5", "run", "b.ts", None)]
RESOLVED = [("a.ts", "run", 3, "k1"), ("a.ts", "load", 4, "k2"), ("b.ts", "run", 2, "k5"), ("b.ts", "save", 7, "k3")]


def call_resolution(spark, sf_dir):
    c = inline(spark, CALLS, "path string, name string, receiver string, line int")
    b = inline(spark, BINDINGS, "path string, local string, to_path string, imported string")
    s = inline(spark, DEFINED, "key string, name string, path string, parent string")
    return resolve.calls(c, b, s).where("target_key is not null").select("path", "name", "line", "target_key")


def keyword_search(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws("/", "p_type", "p_brand").alias("path"), (F.col("p_size") > 25).alias("exported"), F.col("p_size").alias("line"))
    return search.keyword_search(parts, "find the red widgets of brand", 25).select("id", "score")


_SIM = "CASE WHEN t = w THEN 3 WHEN len(list_filter(range(1, least(length(t), length(w)) + 1), lambda k: left(t, k) = left(w, k))) >= 5 AND len(list_filter(range(1, least(length(t), length(w)) + 1), lambda k: left(t, k) = left(w, k))) >= 0.7 * least(length(t), length(w)) THEN 2.5 WHEN starts_with(t, w) OR starts_with(w, t) THEN 1 ELSE 0 END"
KEYWORD_SEARCH = rf"""WITH q(t) AS (VALUES ('red'), ('widgets'), ('brand')), p AS (SELECT p_partkey AS id, p_name AS name, p_type || '/' || p_brand AS path, p_size > 25 AS exported, p_size AS line FROM part),
tk AS (SELECT id, 2.0::DOUBLE AS weight, unnest(regexp_split_to_array(lower(name), '[^a-z0-9]+')) AS w FROM p UNION ALL SELECT id, 0.5::DOUBLE, unnest(list_filter(regexp_split_to_array(lower(path), '[^a-z0-9]+'), lambda x: length(x) >= 2)) FROM p),
best AS (SELECT id, weight, t, max({_SIM}) AS s FROM tk, q WHERE length(w) >= 2 GROUP BY ALL), sc AS (SELECT id, sum(weight * s) AS s, max(s) AS top FROM best GROUP BY id)
SELECT p.id, sc.s + CASE WHEN exported THEN 0.5 ELSE 0 END AS score FROM p JOIN sc USING (id) WHERE sc.s + CASE WHEN exported THEN 0.5 ELSE 0 END >= 2 ORDER BY score DESC, path, line, name, id LIMIT 25"""


SEARCHED = [("symbol", 7.75, "core/orders.ts", 10, "createOrder"), ("symbol", 6.5, "web/app.ts", 1, "OrderPage"), ("route", 3.75, "web/api/orders.ts", 3, "POST /orders")]


def search_everything(spark, sf_dir):
    s = inline(spark, SYMBOLS, SYMBOL_SCHEMA).withColumn("id", F.col("key"))
    f = inline(spark, [("web/app.ts", "SOURCE"), ("docs/orders.md", "DOCUMENTATION")], "path string, kind string")
    r = inline(spark, [("POST", "/orders", "web/api/orders.ts", 3), ("GET", "/users", "web/api/users.ts", 4)], "method string, route string, path string, line int")
    return search.search_everything(s, f, r, "where is the order", 10)


QUERIES = {
    "search_everything": (search_everything, f"SELECT type, score::DOUBLE AS score, path, line, name FROM ({values(SEARCHED)}) t(type, score, path, line, name)"),
    "bfs_distance": (bfs_distance, BFS_DISTANCE),
    "pagerank_20": (pagerank_20, PAGERANK_20),
    "scc_cycles": (scc_cycles, SCC_CYCLES),
    "shortest_cycle": (shortest_cycle, SHORTEST_CYCLE),
    "cycles": (cycles, CYCLES),
    "impact_file": (impact_file, IMPACT_FILE),
    "callers": (callers, CALLERS),
    "symbols_with_callers": (symbols_with_callers, SYMBOLS_WITH_CALLERS),
    "find_symbols": (find_symbols, FIND_SYMBOLS),
    "references_listed": (references_listed, REFERENCES_LISTED),
    "symbol_impact": (symbol_impact, SYMBOL_IMPACT),
    "impact_subgraph": (impact_subgraph, IMPACT_SUBGRAPH),
    "architecture_graph": (architecture_graph, ARCHITECTURE_GRAPH),
    "call_resolution": (call_resolution, f"SELECT * FROM ({values(RESOLVED)}) t(path, name, line, target_key)"),
    "keyword_search": (keyword_search, KEYWORD_SEARCH),
}
