"""Dependencies against lock files and advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import SEVERITIES, downgrade, severity_rank, version_key
from ..functions.text import dir_of, is_unpinned, redact_spec
from .joins import nearest_ancestor


def transitive(locked: DataFrame, direct: DataFrame) -> DataFrame:
    """Locked packages that no manifest asks for, each version once."""
    return locked.dropDuplicates(["ecosystem", "name", "version"]).join(direct.select("ecosystem", "name").distinct(), ["ecosystem", "name"], "left_anti")


def resolved_by_lock(direct: DataFrame, locked: DataFrame) -> DataFrame:
    """Direct dependencies with the version in the lock files of the nearest directory at or above their manifest that has
    any of their ecosystem, where they pin none."""
    l = locked.withColumn("directory", dir_of(F.col("path")))
    manifests = nearest_ancestor(direct.select("path", "ecosystem").distinct(), l.select("directory", "ecosystem").distinct().withColumn("mark", F.lit(True)), "mark", by=("ecosystem",)).select("path", "ecosystem", F.col("nearest").alias("directory"))
    versions = l.groupBy("directory", "ecosystem", "name").agg(F.max_by("version", version_key(F.col("version"))).alias("locked"))
    d = direct.join(manifests, ["path", "ecosystem"], "left").join(versions, ["directory", "ecosystem", "name"], "left")
    return d.withColumn("resolved", F.coalesce("resolved", "locked")).drop("locked", "directory")


def advisory_matches(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies hit by advisories, equal (ecosystem, name) with a version in [introduced, fixed); a fix that is null is
    none yet. Severity is one step lower for development dependencies."""
    d = dependencies.where("resolved is not null")
    hit = d.join(advisories, ["ecosystem", "name"]).where((version_key(F.col("resolved")) >= version_key(F.coalesce("introduced", F.lit("0")))) & (F.col("fixed").isNull() | (version_key(F.col("resolved")) < version_key(F.col("fixed")))))
    return hit.withColumn("severity", F.when(F.col("dev"), downgrade(F.col("severity"))).otherwise(F.col("severity")))


def fixed_versions(matches: DataFrame) -> DataFrame:
    """Per dependency: its advisories, the worst severity, and the version that fixes them all, null if one has no fix."""
    worst = F.get(F.array(*map(F.lit, SEVERITIES)), F.min(severity_rank(F.col("severity"))).cast("int"))
    fix = F.when(F.count_if(F.col("fixed").isNull()) == 0, F.max_by("fixed", version_key(F.col("fixed"))))
    return matches.groupBy("path", "ecosystem", "name", "resolved").agg(F.sort_array(F.collect_set("id")).alias("advisories"), worst.alias("severity"), fix.alias("fixed"))


def hygiene(direct: DataFrame, locked: DataFrame) -> DataFrame:
    """(rule_id, path, name, severity, spec): manifests without a lock file, versions that nothing pins, sources other than
    a registry. direct: as resolved by the locks.

    A package.json with registry dependencies needs a lock at or above it (LOW if all are for development), a Pipfile its
    own; requirements are their own pins. Unpinned development dependencies are INFO.
    """
    none = F.lit(None).cast("string")
    locks = locked.select(dir_of(F.col("path")).alias("directory"), "ecosystem").distinct().withColumn("lock", F.lit(True))
    needs = direct.where((F.col("source") == "registry") & ((F.col("ecosystem") == "npm") | F.col("path").rlike("(?:^|/)Pipfile$")))
    m = needs.groupBy("path", "ecosystem").agg(F.count_if(~F.col("dev")).alias("production"))
    without = nearest_ancestor(m, locks, "lock", by=("ecosystem",)).where("lock is null")
    a = without.select(F.lit("dependency/missing-lockfile").alias("rule_id"), "path", none.alias("name"), F.when((F.col("ecosystem") == "npm") & (F.col("production") > 0), "MEDIUM").otherwise("LOW").alias("severity"), none.alias("spec"))
    loose = (F.col("source") == "registry") & F.col("resolved").isNull() & is_unpinned(F.col("spec"), F.col("ecosystem"))
    b = direct.where(loose).select(F.lit("dependency/unpinned-version"), "path", "name", F.when(F.col("dev"), "INFO").otherwise("LOW"), "spec")
    c = direct.where(F.col("source").isin("git", "url")).select(F.lit("dependency/non-registry-source"), "path", "name", F.lit("LOW"), redact_spec(F.col("spec")))
    return a.union(b).union(c)


def unused(direct: DataFrame, imports: DataFrame, scripts: DataFrame) -> DataFrame:
    """Production dependencies that no import of a package (name) and no script (name) uses. Type packages follow theirs."""
    used = imports.select("name").union(scripts.select("name")).distinct()
    used = used.union(used.select(F.concat(F.lit("@types/"), F.regexp_replace(F.regexp_replace("name", "^@", ""), "/", "__"))))
    return direct.where(~F.col("dev")).join(used, "name", "left_anti")
