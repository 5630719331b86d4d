"""Paths, modules, links and resolution over pages: a page is the file host/lang/name, its links are its imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import base_of, dir_of, extension_of, infer_layer, module_key, normalized, tokens
from ..operators import aggregates, joins
from ..sources.tables import inline, table, values

PATH = r"^https?://([^?#]*)"
SQL_PATH = r"rtrim(regexp_extract(url, '^https?://([^?#]*)', 1), '/')"
LINK = r'href="(/[^"]*)"'
FILES = f"files AS (SELECT page_id, {SQL_PATH} AS path, length(html) AS size FROM pages)"
DIR = "regexp_extract({0}, '^(.*)/[^/]*$', 1)"


def files(spark, sf_dir):
    """(page_id, path, size) of every page."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_extract("url", PATH, 1), "/+$", "").alias("path"), F.length("html").alias("size"), "html")


def links(spark, sf_dir):
    """(path, target) of every link of a page, as host + href."""
    f = files(spark, sf_dir).select("path", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("href"))
    return f.select("path", "href", F.concat(F.substring_index("path", "/", 1), "href").alias("target"))


LINKS = "links AS (SELECT path, href, split_part(path, '/', 1) || href AS target FROM (SELECT " + SQL_PATH + r""" AS path, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS href FROM pages))"""


def path_parts(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.select("page_id", "path", dir_of(F.col("path")).alias("directory"), base_of(F.col("path")).alias("base"), extension_of(base_of(F.col("path"))).alias("extension"), module_key(F.col("path"), 1).alias("module"))


PATH_PARTS = f"""WITH {FILES} SELECT page_id, path, {DIR.format('path')} AS directory, regexp_extract(path, '([^/]*)$', 1) AS base, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+\\.([^.]*)$', 1)) AS extension,
CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS module FROM files"""


def tree_rollup(spark, sf_dir):
    return aggregates.tree_rollup(files(spark, sf_dir))


TREE_ROLLUP = f"""WITH {FILES}, p AS (SELECT string_split({DIR.format('path')}, '/') AS parts, size FROM files), a AS (SELECT CASE WHEN k = 0 THEN '' ELSE array_to_string(parts[1:k], '/') END AS directory, size FROM (SELECT parts, size, unnest(range(0, len(parts) + 1)) AS k FROM p))
SELECT directory, sum(size) AS size, count(*) AS files, CASE WHEN directory = '' THEN 0 ELSE len(string_split(directory, '/')) END AS depth FROM a GROUP BY directory"""


def top_directories(spark, sf_dir):
    return aggregates.top_directories(files(spark, sf_dir))


TOP_DIRECTORIES = f"WITH {FILES} SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS directory, count(*) AS files FROM files GROUP BY 1 ORDER BY files DESC, directory LIMIT 50"


def adaptive_depth(spark, sf_dir):
    f = files(spark, sf_dir).select(F.concat_ws("/", F.lit("pages"), F.element_at(F.split("path", r"[./]"), -3), "path").alias("path"))
    return aggregates.adaptive_depth(f)


ADAPTIVE_DEPTH = f"""WITH {FILES}, f AS (SELECT 'pages/' || list_extract(regexp_split_to_array(path, '[./]'), -3) || '/' || path AS path FROM files), d AS (SELECT string_split({DIR.format('path')}, '/') AS parts, unnest(range(1, 9)) AS depth FROM f),
m AS (SELECT depth, count(DISTINCT array_to_string(parts[1:depth], '/')) AS modules FROM d GROUP BY depth)
SELECT depth, modules FROM m ORDER BY (modules <= 30)::INT DESC, CASE WHEN modules <= 30 THEN modules END DESC, depth LIMIT 1"""


def page_link_edges(spark, sf_dir):
    """Links between hosts: a page's host to the language directory that its links' words are most used in."""
    l = links(spark, sf_dir)
    return l.groupBy(module_key(F.col("path"), 2).alias("src"), F.col("href").alias("dst")).agg(F.count("*").alias("weight")).where("weight > 1")


PAGE_LINK_EDGES = f"WITH {LINKS} SELECT array_to_string(string_split({DIR.format('path')}, '/')[1:2], '/') AS src, href AS dst, count(*) AS weight FROM links GROUP BY 1, 2 HAVING count(*) > 1"


def _edges(spark, sf_dir):
    """Pages that link the same word: the page with the smallest id is imported by the others."""
    f = files(spark, sf_dir).select("page_id", "path", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("href"))
    first = f.groupBy("href").agg(F.min_by("path", "page_id").alias("dst"))
    return f.join(first, "href").select(F.col("path").alias("src"), "dst").where("src <> dst")


EDGES = f"""f AS (SELECT DISTINCT page_id, {SQL_PATH} AS path, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS href FROM pages), firsts AS (SELECT href, min_by(path, page_id) AS dst FROM f GROUP BY href),
edges AS (SELECT path AS src, dst FROM f JOIN firsts USING (href) WHERE path <> dst)"""


def fan_in_out(spark, sf_dir):
    return aggregates.fan_in_out(_edges(spark, sf_dir), files(spark, sf_dir).select(F.col("path").alias("id")).distinct())


FAN_IN_OUT = f"""WITH {EDGES}, e AS (SELECT DISTINCT * FROM edges), n AS (SELECT DISTINCT {SQL_PATH} AS id FROM pages)
SELECT id, (SELECT count(*) FROM e WHERE dst = id) AS fan_in, (SELECT count(*) FROM e WHERE src = id) AS fan_out FROM n"""


def module_edges(spark, sf_dir):
    return aggregates.module_edges(_edges(spark, sf_dir), 1)


MODULE_EDGES = f"WITH {EDGES} SELECT split_part(src, '/', 1) AS src, split_part(dst, '/', 1) AS dst, count(*) AS weight FROM edges WHERE split_part(src, '/', 1) <> split_part(dst, '/', 1) GROUP BY 1, 2"


def module_rollup(spark, sf_dir):
    f = files(spark, sf_dir).select("path", F.col("size").alias("loc"), F.get(F.split("path", "/"), F.lit(1)).alias("layer"))
    return aggregates.module_rollup(f, _edges(spark, sf_dir).distinct(), 1)


MODULE_ROLLUP = f"""WITH {EDGES}, fl AS (SELECT {SQL_PATH} AS path, length(html) AS loc, split_part({SQL_PATH}, '/', 2) AS layer, split_part({SQL_PATH}, '/', 1) AS module FROM pages),
me AS (SELECT DISTINCT split_part(src, '/', 1) AS s, split_part(dst, '/', 1) AS d FROM edges WHERE split_part(src, '/', 1) <> split_part(dst, '/', 1)),
sz AS (SELECT module, count(*) AS files, sum(loc) AS loc FROM fl GROUP BY module), ly AS (SELECT module, layer, count(*) AS n FROM fl GROUP BY ALL),
tp AS (SELECT module, arg_max(layer, (n, layer)) AS layer, max(n) AS n FROM ly GROUP BY module),
g AS (SELECT sz.*, (SELECT count(*) FROM me WHERE d = module) AS fan_in, (SELECT count(*) FROM me WHERE s = module) AS fan_out FROM sz)
SELECT module, files, loc, fan_in, fan_out, coalesce(floor(fan_out::DOUBLE / nullif(fan_in + fan_out, 0) * 100 + 0.5) / 100, 0.0) AS instability, CASE WHEN tp.n * 2 > files THEN tp.layer END AS layer FROM g JOIN tp USING (module)"""



def nearest_ancestor(spark, sf_dir):
    """Each page with the nearest marked directory at or above its own: directories with two pages or more, and hosts."""
    f = files(spark, sf_dir).select("page_id", "path")
    dirs = f.groupBy(dir_of(F.col("path")).alias("directory")).agg(F.count("*").alias("n"), F.min("page_id").alias("mark")).where("n > 1").drop("n")
    hosts = f.groupBy(F.substring_index("path", "/", 1).alias("directory")).agg(F.min("page_id").alias("mark"))
    marks = dirs.union(hosts.join(dirs.select("directory"), "directory", "left_anti"))
    return joins.nearest_ancestor(f, marks, "mark").select("page_id", "nearest", "mark")


NEAREST_ANCESTOR = f"""WITH {FILES}, dd AS (SELECT {DIR.format('path')} AS directory, min(page_id) AS mark FROM files GROUP BY 1 HAVING count(*) > 1), hh AS (SELECT split_part(path, '/', 1) AS directory, min(page_id) AS mark FROM files GROUP BY 1),
m AS (SELECT * FROM dd UNION ALL SELECT * FROM hh WHERE directory NOT IN (SELECT directory FROM dd)), h AS (SELECT page_id, path, m.directory, mark, row_number() OVER (PARTITION BY page_id ORDER BY length(m.directory) DESC) AS n FROM files JOIN m ON {DIR.format('path')} = m.directory OR starts_with(path, m.directory || '/'))
SELECT f.page_id, h.directory AS nearest, mark FROM files f LEFT JOIN h ON h.page_id = f.page_id AND n = 1"""


def longest_prefix(spark, sf_dir):
    f = files(spark, sf_dir).select("page_id", "path")
    owners = f.groupBy(module_key(F.col("path"), 2).alias("prefix")).agg(F.count("*").alias("n")).where("n > 2").select("prefix").union(f.select(F.substring_index("path", "/", 1).alias("prefix"))).distinct()
    return joins.longest_prefix(f, owners, "prefix").select("page_id", "owner")


LONGEST_PREFIX = f"""WITH {FILES}, o AS (SELECT array_to_string(string_split({DIR.format('path')}, '/')[1:2], '/') AS prefix FROM files GROUP BY 1 HAVING count(*) > 2 UNION SELECT split_part(path, '/', 1) FROM files)
SELECT page_id, (SELECT prefix FROM o WHERE starts_with(path, prefix || '/') ORDER BY length(prefix) DESC LIMIT 1) AS owner FROM files"""


def resolve_links(spark, sf_dir):
    """Links resolved by the first candidate that exists: the page itself, the page as .html, the directory of that name."""
    l = links(spark, sf_dir)
    host = F.substring_index("path", "/", 1)
    tries = F.array(F.col("target"), F.concat("target", F.lit(".html")), F.concat(host, F.lower("href")))
    c = l.select("path", "href", F.posexplode(tries).alias("priority", "candidate"))
    f = files(spark, sf_dir)
    targets = f.select("path").union(f.select(dir_of(F.col("path")))).distinct().select(F.col("path").alias("to_path"))
    found = joins.first_candidate(c, targets, ["path", "href"], "candidate", "priority", "to_path")
    return l.select("path", "href").distinct().join(found, ["path", "href"], "left").groupBy(F.when(F.col("to_path").isNull(), "UNRESOLVED").otherwise("INTERNAL").alias("kind")).agg(F.count("*").alias("n"), F.min("to_path").alias("example"))


RESOLVE_LINKS = f"""WITH {FILES}, {LINKS}, t AS (SELECT path AS p FROM files UNION SELECT {DIR.format('path')} FROM files), d AS (SELECT DISTINCT path, href, target, split_part(path, '/', 1) || lower(href) AS low FROM links),
r AS (SELECT path, href, CASE WHEN target IN (SELECT p FROM t) THEN target WHEN target || '.html' IN (SELECT p FROM t) THEN target || '.html' WHEN low IN (SELECT p FROM t) THEN low END AS to_path FROM d)
SELECT CASE WHEN to_path IS NULL THEN 'UNRESOLVED' ELSE 'INTERNAL' END AS kind, count(*) AS n, min(to_path) AS example FROM r GROUP BY 1"""


def unique_match(spark, sf_dir):
    """Links whose word begins exactly one page's directory path: linked; others stay open."""
    f = files(spark, sf_dir)
    names = f.select(F.concat(F.lit("/"), F.get(F.split("path", "/"), F.lit(1))).alias("href"), F.substring_index("path", "/", 1).alias("host")).distinct()
    l = links(spark, sf_dir).select("href").distinct()
    return joins.only_candidate(l, names, ["href"], "host")


UNIQUE_MATCH = f"WITH {FILES}, {LINKS}, n AS (SELECT '/' || split_part(path, '/', 2) AS href, min(split_part(path, '/', 1)) AS host FROM files GROUP BY 1 HAVING count(DISTINCT split_part(path, '/', 1)) = 1) SELECT DISTINCT l.href, n.host FROM links l LEFT JOIN n USING (href)"


def broken_links(spark, sf_dir):
    """Distinct link targets that no page has, by host."""
    f = files(spark, sf_dir).select(F.col("path").alias("target"))
    gone = joins.difference(links(spark, sf_dir), f, ["target"])
    return gone.groupBy(F.substring_index("target", "/", 1).alias("host")).agg(F.count("*").alias("broken"))


BROKEN_LINKS = f"WITH {FILES}, {LINKS} SELECT split_part(target, '/', 1) AS host, count(DISTINCT target) AS broken FROM links WHERE target NOT IN (SELECT path FROM files) GROUP BY 1"


def undocumented_terms(spark, sf_dir):
    """Words linked in pages that no benchmark item uses."""
    used = links(spark, sf_dir).select(F.explode(tokens(F.expr("substring(href, 2)"))).alias("term"))
    told = table(spark, sf_dir, "benchmark").select(F.explode(tokens(F.col("text"))).alias("term"))
    return joins.difference(used, told, ["term"])


_TOK = r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: length(x) >= 2)"
UNDOCUMENTED_TERMS = f"WITH {LINKS}, u AS (SELECT DISTINCT unnest({_TOK.format('substring(href, 2)')}) AS term FROM links), b AS (SELECT DISTINCT unnest({_TOK.format('text')}) AS term FROM benchmark) SELECT term FROM u WHERE term NOT IN (SELECT term FROM b)"

PATHS = [
    ("src/api/orders.ts", "interface"), ("src/services/billing.ts", "service"), ("src/db/orders.repository.ts", "data"), ("src/utils/format.ts", "shared"), ("src/orders.controller.ts", "interface"),
    ("src/OrderService.java", "service"), ("lib/model/user_dao.py", "data"), ("main.py", None), ("src/components/db/button.tsx", "data"), ("pages/home-page.tsx", "interface"), ("src/core/engine.ts", None),
]
IMPORTS = [("src/api/orders.ts", "src/services/billing.ts"), ("src/db/orders.repository.ts", "src/services/billing.ts"), ("src/utils/format.ts", "src/db/orders.repository.ts"), ("src/services/billing.ts", "src/db/orders.repository.ts"), ("src/services/billing.ts", "src/api/orders.ts"), ("main.py", "src/utils/format.ts")]
RANK = {"interface": 0, "service": 1, "data": 2, "shared": 3}


def layer_violations(spark, sf_dir):
    from ..functions.numbers import rank_of
    from ..functions.text import LAYER_ORDER

    f = inline(spark, [(p,) for p, _ in PATHS], "id string").withColumn("layer", infer_layer(F.col("id")))
    ranks = f.where("layer is not null").select("id", rank_of(F.col("layer"), LAYER_ORDER).alias("rank"))
    return joins.upward(inline(spark, IMPORTS, "src string, dst string"), ranks).select("src", "dst", F.col("src_rank").cast("long").alias("src_rank"), F.col("dst_rank").cast("long").alias("dst_rank"))


LAYER_VIOLATIONS = f"WITH l(id, layer, rank) AS ({values([(p, l, RANK.get(l)) for p, l in PATHS])}), e(src, dst) AS ({values(IMPORTS)}) SELECT src, dst, a.rank::BIGINT AS src_rank, b.rank::BIGINT AS dst_rank FROM e JOIN l a ON a.id = src JOIN l b ON b.id = dst WHERE a.rank > b.rank"

DOTTED = [("src/a", "../b/c.ts", "src/b/c.ts"), ("src", "./x.ts", "src/x.ts"), ("", "a//b/./c", "a/b/c"), ("src", "../../x", None), ("a/b/c", "../../../d", "d"), ("a", "..", "")]


def normalized_paths(spark, sf_dir):
    d = inline(spark, [(a, b) for a, b, _ in DOTTED], "directory string, relative string")
    return d.withColumn("path", normalized(F.concat_ws("/", "directory", "relative")))


QUERIES = {
    "path_parts": (path_parts, PATH_PARTS),
    "tree_rollup": (tree_rollup, TREE_ROLLUP),
    "top_dirs": (top_directories, TOP_DIRECTORIES),
    "adaptive_depth": (adaptive_depth, ADAPTIVE_DEPTH),
    "page_link_edges": (page_link_edges, PAGE_LINK_EDGES),
    "fan_in_out": (fan_in_out, FAN_IN_OUT),
    "module_edges": (module_edges, MODULE_EDGES),
    "module_rollup": (module_rollup, MODULE_ROLLUP),
    "nearest_ancestor": (nearest_ancestor, NEAREST_ANCESTOR),
    "longest_prefix": (longest_prefix, LONGEST_PREFIX),
    "resolve_links": (resolve_links, RESOLVE_LINKS),
    "unique_match": (unique_match, UNIQUE_MATCH),
    "broken_links": (broken_links, BROKEN_LINKS),
    "undocumented_terms": (undocumented_terms, UNDOCUMENTED_TERMS),
    "layer_violations": (layer_violations, LAYER_VIOLATIONS),
    "normalized_paths": (normalized_paths, f"SELECT * FROM ({values(DOTTED)}) t(directory, relative, path)"),
}
