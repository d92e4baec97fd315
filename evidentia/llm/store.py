"""Tables written to the shared folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a scratch folder in local mode, as in tests, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that are run within remove their shuffle files when they end; else these stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: its size is then known to the planner. What was shuffled for it is gone by then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a batch that a Python function of the pipeline gets.
BATCH_ROWS = 1_000


def short_batches(spark: SparkSession) -> None:
    """From now on Python functions of this session get ``BATCH_ROWS`` rows at once at most: rows are whole texts, and a worker keeps the memory of its largest batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A key of sixteen bytes that only rows of equal id and text share; a null id or text has a key as well."""
    text = F.col(text_col)
    both = F.concat_ws("\x1f", F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")), F.when(text.isNull(), "n").otherwise(F.concat(F.lit("t"), text)))
    return F.unhex(F.substring(F.sha2(both, 256), 1, 32))


def marked(rows: DataFrame, col: str, keys: DataFrame) -> DataFrame:
    """``rows`` with ``likely_``, which is false only where ``col`` is surely not among the one column of ``keys``.

    A Bloom filter of one hash, 8 MB at most whatever the number of keys, is broadcast; rows that it rules out need no shuffle.
    With over some ten million keys it rules out fewer rows, and none wrongly.
    """
    bits = 1 << min(26, max(15, keys.count().bit_length() + 4))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    inside = F.col("b_").bitwiseAND(F.lit(32767))
    maps = keys.select(place(keys.columns[0]).alias("b_")).groupBy(F.shiftright("b_", 15).alias("m_")).agg(F.bitmap_construct_agg(inside).alias("map_"))
    out = rows.withColumn("b_", place(col)).withColumn("m_", F.shiftright("b_", 15)).join(F.broadcast(maps), "m_", "left")
    byte = F.expr("cast(conv(hex(substring(map_, int((b_ & 32767) div 8) + 1, 1)), 16, 10) as bigint)")
    likely = F.coalesce(F.getbit(byte, F.col("b_").bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    return out.withColumn("likely_", likely).drop("b_", "m_", "map_")
