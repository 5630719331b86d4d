"""What the operators share: the word rule, table reading and a scratch folder all executors see."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    """How many words a text has, without building them; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sliced(text: Column, slices: int, chars: int) -> Column:
    """A text of up to slices * chars characters as it is, of a longer one so many slices, spread from its start to its end."""
    last = F.length(text) - chars
    cuts = [F.substring(text, (F.floor(last * i / (slices - 1)) + 1).cast("int"), F.lit(chars)) for i in range(slices)]
    return F.when(last <= chars * (slices - 1), text).otherwise(F.concat(*cuts))


def literal_doubles(values) -> Column:
    """A constant array column. The text form is folded by the optimizer into one literal, so tasks get it once."""
    return F.split(F.lit(",".join(format(float(v), ".6g") for v in values)), ",").cast("array<double>")


_kept: dict = {}


def kept(key, make):
    """What `make` gives, kept between a worker's tasks as long as they ask for the same key. A worker serves one operator
    after another, so it keeps one thing at a time, else their caches would add up."""
    if key not in _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _kept[key] = make()
    return _kept[key]


def scratch_root(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Only where that is unset and the session is local, as in tests, a temporary
    one of this machine: on a cluster other machines would not see it, so there the setting is asked for."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strataq-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/strataq-{uuid.uuid4().hex}"


class Scratch:
    """Written tables that cut lineage. Parquet in the shared folder survives a lost executor, unlike cached blocks."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, scratch_root(spark), 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._strataq_path = path
        return saved

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for t in tables:
            if path := getattr(t, "_strataq_path", None):
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
