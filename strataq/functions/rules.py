"""The rule catalogue as data: id, finding type, category and weakness number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Rule id, finding type and, for security rules, the CWE number.
RULES = (
    ("complexity/high-cyclomatic", "high-complexity", None), ("complexity/deep-nesting", "deep-nesting", None), ("size/long-function", "long-function", None), ("smell/long-parameter-list", "long-parameter-list", None),
    ("size/large-file", "large-file", None), ("smell/god-class", "god-class", None), ("smell/empty-catch", "empty-catch", None), ("smell/bare-except", "bare-except", None), ("smell/debugger-statement", "debugger-statement", None),
    ("smell/todo-comment", "todo-comment", None), ("duplication/duplicate-block", "duplicate-code", None), ("dead-code/unreachable", "unreachable-code", None), ("dead-code/unused-import", "unused-import", None), ("dead-code/unused-private", "unused-private-member", None),
    ("secret/private-key", "private-key", 321), ("secret/cloud-credential", "cloud-credential", 798), ("secret/api-token", "api-token", 798), ("secret/database-credentials", "database-credentials", 798), ("secret/json-web-token", "json-web-token", 798),
    ("secret/hardcoded-credential", "hardcoded-credential", 798), ("secret/committed-env-file", "committed-env-file", 538), ("injection/dynamic-code-execution", "code-injection", 95), ("injection/os-command", "command-injection", 78), ("injection/sql", "sql-injection", 89),
    ("injection/xss-sink", "xss", 79), ("unsafe/deserialization", "insecure-deserialization", 502), ("crypto/tls-verification-disabled", "tls-verification-disabled", 295), ("crypto/jwt-verification-disabled", "jwt-verification-disabled", 347), ("crypto/weak-hash", "weak-hash", 328),
    ("crypto/weak-cipher", "weak-cipher", 327), ("crypto/insecure-randomness", "insecure-randomness", 338), ("memory/unsafe-c-function", "unsafe-c-function", 120), ("config/debug-mode", "debug-mode", 489),
    ("dependency/known-vulnerability", "vulnerable-dependency", None), ("dependency/missing-lockfile", "missing-lockfile", None), ("dependency/unpinned-version", "unpinned-dependency", None), ("dependency/non-registry-source", "non-registry-dependency", None), ("dependency/unused-candidate", "unused-dependency", None),
    ("architecture/circular-dependency", "circular-dependency", None), ("architecture/layer-violation", "layer-violation", None), ("architecture/high-fan-out", "high-fan-out", None),
    ("api/permissive-cors", "permissive-cors", None), ("api/error-details-exposed", "error-details-exposed", None), ("api/unauthenticated-mutation", "unauthenticated-mutation", None), ("api/missing-input-validation", "missing-input-validation", None), ("api/auth-without-rate-limit", "auth-without-rate-limit", None), ("api/no-specification", "no-api-specification", None),
    ("database/unindexed-foreign-key", "unindexed-foreign-key", None), ("database/table-without-primary-key", "table-without-primary-key", None), ("database/auto-schema-sync", "auto-schema-sync", None), ("database/no-migrations", "no-migrations", None),
    ("testing/no-tests", "no-tests", None), ("testing/low-test-ratio", "low-test-ratio", None), ("testing/low-coverage", "low-coverage", None), ("testing/focused-test", "focused-test", None), ("testing/skipped-test", "skipped-test", None), ("testing/tests-not-in-ci", "tests-not-in-ci", None), ("testing/no-test-script", "no-test-script", None), ("testing/untested-file", "untested-file", None),
    ("documentation/missing-readme", "missing-readme", None), ("documentation/incomplete-readme", "incomplete-readme", None), ("documentation/missing-license", "missing-license", None), ("documentation/undocumented-env-vars", "undocumented-env-vars", None), ("documentation/broken-link", "broken-link", None),
)
CATEGORY_OF = {
    "complexity": "CODE_QUALITY", "size": "CODE_QUALITY", "smell": "CODE_QUALITY", "duplication": "CODE_QUALITY", "dead-code": "CODE_QUALITY", "secret": "SECRET", "injection": "SECURITY", "unsafe": "SECURITY", "crypto": "SECURITY", "memory": "SECURITY", "config": "SECURITY",
    "dependency": "DEPENDENCY", "architecture": "ARCHITECTURE", "api": "API", "database": "DATABASE", "testing": "TESTING", "documentation": "DOCUMENTATION",
}


def catalogue(spark: SparkSession) -> DataFrame:
    """(rule_id, type, category, cwe), small enough to be sent to every executor."""
    return spark.createDataFrame([(i, t, CATEGORY_OF[i.split("/")[0]], c) for i, t, c in RULES], "rule_id string, type string, category string, cwe int")
