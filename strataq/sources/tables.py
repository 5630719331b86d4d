"""The driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small constant table."""
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple]) -> str:
    """The same rows as a SQL VALUES list."""

    def one(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, int | float):
            return repr(x)
        if isinstance(x, list | tuple):
            return "[" + ", ".join(map(one, x)) + "]"
        return "'" + str(x).replace("'", "''") + "'"

    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
