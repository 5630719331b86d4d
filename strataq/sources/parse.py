"""Parsers over texts: one Python call per file, Arrow batches in and out. A text that can't be parsed gives no rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def parsed(files: DataFrame, parse: Callable[[str, str], Iterator[tuple] | list[tuple]], schema: str) -> DataFrame:
    """Rows that `parse(path, text)` gives for each file (path, text); `schema` names its columns, path first."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True) if text is not None for r in parse(path, text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return files.select("path", "text").mapInArrow(run, schema)
