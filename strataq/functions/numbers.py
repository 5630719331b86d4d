"""Rounding, ranks, bands and scores as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Enumerations in the order in which they sort.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
CATEGORIES = ("SECRET", "SECURITY", "CODE_QUALITY", "DEPENDENCY", "TESTING", "ARCHITECTURE", "DOCUMENTATION", "API", "DATABASE", "GIT", "DEVOPS")
STAGES = ("QUEUED", "CLONING", "SCANNING", "PARSING", "SECURITY", "DEPENDENCIES", "ARCHITECTURE", "PRACTICES", "INDEXING", "GIT", "AI", "REPORT", "COMPLETED")


def round_half_up(x: Column, places: int = 0) -> Column:
    """Rounds half toward plus infinity, on doubles: -2.5 gives -2."""
    scale = float(10**places)
    return F.floor(x.cast("double") * scale + 0.5) / F.lit(scale)


def rank_of(x: Column, order: tuple[str, ...]) -> Column:
    """Position of a value in an enumeration; null for a value that is none of it."""
    return F.nullif(F.array_position(F.array(*map(F.lit, order)), x), F.lit(0)) - 1


def severity_rank(x: Column) -> Column:
    return rank_of(x, SEVERITIES)


def severity_at(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, SEVERITIES)), rank.cast("int"))


def downgrade(x: Column, steps: int | Column = 1) -> Column:
    """Less severe by steps, but never below LOW; INFO stays INFO."""
    rank = severity_rank(x)
    return severity_at(F.when(rank >= SEVERITIES.index("LOW"), rank).otherwise(F.least(rank + steps, F.lit(SEVERITIES.index("LOW")))))


def upgrade(x: Column) -> Column:
    return severity_at(F.greatest(severity_rank(x) - 1, F.lit(0)))


def banded(x: Column, bands: list[tuple[float, str]], otherwise: str | None, inclusive: bool) -> Column:
    """The label of the first band (highest first) that x reaches (inclusive) or passes."""
    reached = (lambda b: x >= b) if inclusive else (lambda b: x > b)
    first, *rest = bands
    out = reduce(lambda w, b: w.when(reached(b[0]), b[1]), rest, F.when(reached(first[0]), first[1]))
    return out.otherwise(F.lit(otherwise).cast("string"))


def grade(score: Column) -> Column:
    return banded(score, [(90, "A"), (75, "B"), (60, "C"), (40, "D")], "F", True)


def cvss_severity(score: Column) -> Column:
    return F.when(score.isNull(), None).when(score == 0, "INFO").otherwise(banded(score, [(9, "CRITICAL"), (7, "HIGH"), (4, "MEDIUM")], "LOW", True))


# Thresholds of the code rules; a value must pass them.
CODE_BANDS = {
    "complexity": [(20, "HIGH"), (10, "MEDIUM")],
    "nesting": [(6, "HIGH"), (4, "MEDIUM")],
    "function_lines": [(150, "HIGH"), (60, "MEDIUM")],
    "parameters": [(7, "MEDIUM"), (5, "LOW")],
    "file_lines": [(2000, "HIGH"), (1000, "MEDIUM"), (500, "LOW")],
    "class_methods": [(20, "MEDIUM")],
    "class_lines": [(500, "MEDIUM")],
    "duplicate_lines": [(30, "MEDIUM"), (5, "LOW")],
    "fan_out": [(40, "MEDIUM"), (20, "LOW")],
}


def threshold_severity(x: Column, measure: str) -> Column:
    return banded(x, CODE_BANDS[measure], None, False)


def ratio(a: Column, b: Column, places: int) -> Column:
    """a / b rounded half up; null where b is 0."""
    return round_half_up(F.try_divide(a.cast("double"), b.cast("double")), places)


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def plan_confidence(model: Column, errors: Column, warnings: Column) -> Column:
    return clamp01(round_half_up(clamp01(model) - 0.1 * errors - 0.03 * warnings, 2))


def progress(stage: Column) -> Column:
    """Percent done when a stage begins."""
    return round_half_up(rank_of(stage, STAGES) * 100 / F.lit(len(STAGES) - 1)).cast("int")


# The metric weights of CVSS 3.0 and 3.1 base scores.
CVSS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "PR_U": {"N": 0.85, "L": 0.62, "H": 0.27},
    "PR_C": {"N": 0.85, "L": 0.68, "H": 0.5},
    "UI": {"N": 0.85, "R": 0.62},
    "CIA": {"H": 0.56, "L": 0.22, "N": 0.0},
}


def cvss3_base(vector: Column) -> Column:
    """The base score of a CVSS 3.0 or 3.1 vector by the specification; null if the vector is none or lacks a metric."""
    parts = F.str_to_map(vector, F.lit("/"), F.lit(":"))

    def weight(metric: str, table: str) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for kv in CVSS[table].items() for x in kv]), F.element_at(parts, metric))

    scope = F.element_at(parts, "S")
    changed = scope == "C"
    pr = F.when(changed, weight("PR", "PR_C")).otherwise(weight("PR", "PR_U"))
    isc = 1 - (1 - weight("C", "CIA")) * (1 - weight("I", "CIA")) * (1 - weight("A", "CIA"))
    impact = F.when(changed, 7.52 * (isc - 0.029) - 3.25 * F.pow(isc - 0.02, F.lit(15))).otherwise(6.42 * isc)
    exploit = 8.22 * weight("AV", "AV") * weight("AC", "AC") * pr * weight("UI", "UI")
    raw = F.least(F.when(changed, 1.08 * (impact + exploit)).otherwise(impact + exploit), F.lit(10.0))
    scaled = F.floor(raw * 100000 + 0.5).cast("long")  # round up to one place, on whole numbers as the specification asks
    up = F.when(scaled % 10000 == 0, scaled / 100000.0).otherwise((F.floor(scaled / 10000.0) + 1) / 10.0)
    known = vector.rlike(r"^CVSS:3\.[01]/") & scope.isin("U", "C") & raw.isNotNull()
    return F.when(known, F.when(impact <= 0, F.lit(0.0)).otherwise(up))


def version_key(v: Column) -> Column:
    """A string that sorts as versions do, numbers by value, and a pre-release before its release.

    Numbers are padded to twelve digits; build metadata and a leading v are dropped; missing parts count as 0, up to four.
    """
    plain = F.regexp_replace(F.regexp_replace(v, r"\+.*$", ""), r"^[vV=\s]+", "")
    main, pre = F.regexp_extract(plain, r"^([0-9.]*)", 1), F.regexp_extract(plain, r"^[0-9.]*[-.]?(.*)$", 1)
    numbers = F.transform(F.slice(F.concat(F.filter(F.split(main, r"\."), lambda x: x != ""), F.array(*[F.lit("0")] * 4)), 1, 4), lambda x: F.lpad(x, 12, "0"))
    padded = F.transform(F.split(pre, r"[.\-]"), lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, 12, "0")).otherwise(x))
    return F.concat(F.array_join(numbers, "."), F.when(pre == "", "~").otherwise(F.concat(F.lit("-"), F.array_join(padded, "."))))
