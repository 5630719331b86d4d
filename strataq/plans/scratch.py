"""Written tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Parquet below spark.checkpoint.dir; it survives a lost executor. Only a local session may leave that unset, as tests do, and gets
    a temporary folder: on a cluster other machines would not see it."""

    def __init__(self, spark: SparkSession):
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="strataq-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.root, self.n = spark, f"{base.rstrip('/')}/strataq-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
