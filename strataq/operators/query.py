"""The query surface: filtered, faceted, ranked and paged listings. Every function is DataFrame -> DataFrame."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import severity_rank

PAGE_SIZE, MOST_PAGE_SIZE, MOST_LISTED = 50, 200, 20


def one_of(column: str, values: Iterable | None) -> Column:
    """column IN values; no values, no restriction."""
    values = list(values or ())
    return F.col(column).isin(values) if values else F.lit(True)


def contains(column: str, text: str | None) -> Column:
    """Case-insensitive substring, taken literally."""
    return F.contains(F.lower(column), F.lower(F.lit(text))) if text else F.lit(True)


def equals(column: str, value) -> Column:
    return F.col(column) == value if value is not None else F.lit(True)


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page of an ordered listing; a top-k, as the optimizer sees it."""
    size = max(1, min(size, MOST_PAGE_SIZE))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def triaged(findings: DataFrame, triage: DataFrame, which: str) -> DataFrame:
    """which: all, triaged or untriaged. Without triage rows, untriaged is everything and triaged nothing."""
    keys = triage.select("fingerprint").distinct()
    if which == "all":
        return findings
    return findings.join(keys, "fingerprint", "left_semi" if which == "triaged" else "left_anti")


def findings_where(severity=None, category=None, type=None, path: str | None = None) -> Column:
    return one_of("severity", severity) & one_of("category", category) & one_of("type", type) & equals("path", path)


FINDING_ORDER = ("severity_rank", "path", "line")


def finding_order(*last: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in (*FINDING_ORDER, *last)]


def findings_page(findings: DataFrame, triage: DataFrame, number: int = 1, size: int = PAGE_SIZE, triage_state: str = "all", **where) -> DataFrame:
    """A page of findings in order of severity, path and line, with the triage state of each."""
    found = triaged(findings, triage, triage_state).where(findings_where(**where)).withColumn("severity_rank", severity_rank(F.col("severity")))
    rows = page(found, finding_order("fingerprint"), number, size)
    return rows.join(triage.select("fingerprint", F.col("status").alias("triage_status")), "fingerprint", "left")


def findings_facets(findings: DataFrame, triage: DataFrame, triage_state: str = "all", category=None, path: str | None = None) -> DataFrame:
    """(facet, value, n) by severity and type, and the total, in one pass; the severity and type filters don't apply."""
    scope = triaged(findings, triage, triage_state).where(findings_where(category=category, path=path))
    sets = scope.groupingSets([["severity"], ["type"], []], "severity", "type").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    facet = F.when(F.col("g") == 1, "severity").when(F.col("g") == 2, "type").otherwise("total")
    return sets.select(facet.alias("facet"), F.coalesce("severity", "type", F.lit("all")).alias("value"), "n")


def zero_filled(counts: DataFrame, key: str, values: tuple[str, ...]) -> DataFrame:
    """(key, n) for every value of a dimension, 0 where there is none."""
    dimension = counts.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return dimension.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def dependencies_where(ecosystem=None, scope: str | None = None, dev: str = "include", vulnerable: bool | None = None, unused: bool | None = None, q: str | None = None, manifest: str | None = None) -> dict[str, Column]:
    """The predicates by name, so that a facet can leave its own out."""
    true = F.lit(True)
    return {
        "ecosystem": one_of("ecosystem", ecosystem),
        "scope": {None: true, "direct": F.col("direct"), "transitive": ~F.col("direct")}[scope],
        "dev": {"include": true, "exclude": ~F.col("dev"), "only": F.col("dev")}[dev],
        "vulnerable": true if vulnerable is None else (F.size("vuln_ids") > 0) == F.lit(vulnerable),
        "unused": true if unused is None else F.col("unused_candidate") == F.lit(unused),
        "q": contains("name", q),
        "manifest": equals("manifest_path", manifest),
    }


def _all(conditions: dict[str, Column], but: str = "") -> Column:
    out = F.lit(True)
    for name, c in conditions.items():
        out = out if name == but else out & c
    return out


DEPENDENCY_SORTS = {"name": ("name", "ecosystem", "manifest_path"), "ecosystem": ("ecosystem", "name", "manifest_path"), "manifest": ("manifest_path", "ecosystem", "name")}


def dependencies_page(deps: DataFrame, sort: str = "name", number: int = 1, size: int = PAGE_SIZE, **where) -> DataFrame:
    return page(deps.where(_all(dependencies_where(**where))), [F.col(c).asc_nulls_last() for c in DEPENDENCY_SORTS[sort]], number, size)


def ecosystem_facet(deps: DataFrame, **where) -> DataFrame:
    """Counts by ecosystem under every filter but its own."""
    return deps.where(_all(dependencies_where(**where), but="ecosystem")).groupBy("ecosystem").agg(F.count("*").alias("n"))


def symbols_page(symbols: DataFrame, references: DataFrame, q: str | None = None, kind=None, path: str | None = None, exported: bool | None = None, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """Symbols with how many resolved references each has."""
    calls = references.where("target_key is not null").groupBy("target_key").agg(F.count("*").alias("callers"))
    found = symbols.where(contains("name", q) & one_of("kind", kind) & equals("path", path) & equals("exported", exported))
    counted = found.join(calls, found["key"] == calls["target_key"], "left").select(*[found[c] for c in found.columns], F.coalesce("callers", F.lit(0)).cast("long").alias("callers"))
    return page(counted, [F.col(c).asc_nulls_last() for c in ("name", "path", "line", "key")], number, size)


def references_of(references: DataFrame, symbols: DataFrame, symbol_key: str | None = None, name: str | None = None) -> DataFrame:
    """References to a symbol or by a name, one of the two, with the calling symbol's name."""
    if (symbol_key is None) == (name is None):
        raise ValueError("give a symbol or a name, not both")
    found = references.where(equals("target_key", symbol_key) & equals("name", name))
    callers = symbols.select(F.col("key").alias("from_key"), F.col("name").alias("caller"))
    return found.join(callers, "from_key", "left").orderBy(F.col("path").asc_nulls_last(), F.col("line").asc_nulls_last())


def imports_of(edges: DataFrame, path: str) -> DataFrame:
    """What a file imports: internal files, packages, builtins and what could not be resolved."""
    return edges.where(F.col("from_path") == path).orderBy("specifier")


def importers_of(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("to_path") == path).orderBy("from_path")


FILE_SORTS = ("path", "loc", "complexity", "duplicated")


def files_page(files: DataFrame, findings: DataFrame, kind=None, sort: str = "path", number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """Files with how many findings each has; measures fall, unknown ones last."""
    counts = findings.groupBy("path").agg(F.count("*").alias("findings"))
    found = files.where(one_of("kind", kind)).join(counts, "path", "left").withColumn("findings", F.coalesce("findings", F.lit(0)).cast("long"))
    order = [F.col("path")] if sort == "path" else [F.col(sort).desc_nulls_last(), F.col("path")]
    return page(found, order, number, size)


def architecture_graph(nodes: DataFrame, edges: DataFrame, most: int = 60, module: str | None = None, cycles_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """The `most` nodes of highest degree (with ties by label) and the edges between them."""
    keep = nodes.where(F.col("label").startswith(module) if module else F.lit(True))
    if cycles_only:
        inside = edges.where("in_cycle")
        keep = keep.join(inside.select(F.col("src").alias("id")).union(inside.select("dst")).distinct(), "id", "left_semi")
    degree = edges.select(F.col("src").alias("id")).union(edges.select("dst")).groupBy("id").agg(F.count("*").alias("degree"))
    top = keep.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long")).orderBy(F.desc("degree"), "label").limit(most)
    return top, induced(edges, top)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def reports_page(reports: DataFrame, owner: str, number: int = 1, size: int = PAGE_SIZE, **where) -> DataFrame:
    """An owner's reports, newest first; other owners' reports are as good as absent."""
    found = reports.where(F.col("owner") == owner)
    for column, value in where.items():
        found = found.where(equals(column, value))
    return page(found, [F.col("generated_at").desc_nulls_last(), F.col("id").desc_nulls_last()], number, size)


def latest_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that must be total."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def first_per(df: DataFrame, keys: list[str], emitted: str) -> DataFrame:
    """DISTINCT that keeps the first by an explicit emission order."""
    return latest_per(df, keys, [F.col(emitted).asc()])


def capped(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """At most `most` rows of each key, with `total`, how many there were."""
    # the limit on the window lets each task keep `most` rows of a key; totals are counted before the shuffle
    first = df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
    same = [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys]
    totals = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("total"))
    return first.join(totals, same).select(*df.columns, "total")


def most_severe(findings: DataFrame, most: int) -> tuple[DataFrame, Column]:
    """The most severe findings, and the condition that tells from a total whether some were left out."""
    ranked = findings.withColumn("severity_rank", severity_rank(F.col("severity")))
    return ranked.orderBy(*finding_order("fingerprint")).limit(most), F.col("total") > most


def with_fingerprints(findings: DataFrame, emitted: str = "emit_order") -> DataFrame:
    """Adds `ordinal` among findings of one rule, path and key, and a fingerprint that holds it from the second on."""
    same = W.partitionBy("rule_id", "path", "key").orderBy(emitted)
    n = F.row_number().over(same) - 1
    key = F.when(F.col("ordinal") > 0, F.concat("key", F.lit("#"), F.col("ordinal").cast("string"))).otherwise(F.col("key"))
    return findings.withColumn("ordinal", n.cast("long")).withColumn("fingerprint", F.sha2(F.concat_ws("\x00", "rule_id", "path", key), 256))


# --- checks of query arguments, on the driver


def checked_list(text: str | None, allowed: Iterable[str] | None = None, most: int = MOST_LISTED) -> list[str]:
    """A comma list of at most `most` values, each allowed."""
    values = [x.strip() for x in (text or "").split(",") if x.strip()]
    if len(values) > most:
        raise ValueError(f"at most {most} values")
    if allowed is not None and (bad := [x for x in values if x not in set(allowed)]):
        raise ValueError(f"unknown: {', '.join(bad)}")
    return values


def checked_path(path: str) -> str:
    """A relative path that stays inside its root."""
    if not path or path.startswith(("/", "\\")) or "\x00" in path or ":" in path.split("/")[0] or ".." in path.replace("\\", "/").split("/"):
        raise ValueError("path must be relative and stay inside")
    return path
