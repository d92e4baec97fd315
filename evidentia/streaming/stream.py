"""Continuous capture and materialisation, by state that Spark keeps by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from evidentia.operators import corpus

#: Keeps state on the executors' disks and its changes in the checkpoint, so that it may outgrow memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """State by key in RocksDB, for the session's streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def stream_snapshots(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Captures deduplicated by (source_id, sha256) within a watermark on acquired_at; later rows are dropped, so state stays bounded."""
    return stream.withWatermark("acquired_at", late).dropDuplicatesWithinWatermark(["source_id", "sha256"])


def stream_store(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Deduplication without a time bound: the keys of (source_id, sha256) seen so far are state, so a batch meets only its own keys and the table is never read again.

    The file sink commits each batch once, also when it is repeated.
    """
    keyed_state(stream.sparkSession)
    one = stream.dropDuplicates(["source_id", "sha256"])
    return one.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_materialize(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Provisions of the documents that a micro-batch of blocks touches, from all their blocks so far.

    Blocks are state by document: a batch gets the documents that it touches with all their blocks, and nothing
    is read again. Each batch appends one folder with what these documents now are, which :func:`materialized` reads
    as the documents' latest state; a repeated batch replaces its folder by itself, and :func:`compact` drops what is
    outdated. Of blocks that come again for a document's position the last batch's counts, within a batch the greatest
    text. A null text is a blank line.
    """
    keyed_state(stream.sparkSession)
    timed = stream.select("doc_id", "pos", F.current_timestamp().alias("at"), F.coalesce("text", F.lit("")).alias("text"))
    documents = timed.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "at", "text")).alias("blocks"))

    def add(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read twice; the state is to be stepped once
        b = batch.select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.*")
        # a document's blocks are in one row, so its last ones are found without another exchange
        b = b.withColumn("no", F.row_number().over(Window.partitionBy("doc_id", "pos").orderBy(F.desc("at"), F.desc("text")))).filter("no = 1")
        corpus.reproject(b.select("doc_id", "pos", "text")).write.mode("overwrite").parquet(f"{path}/batch={number}")
        # documents whose blocks give no provision any more leave a mark, else their old rows would still count
        batch.select("doc_id").write.mode("overwrite").parquet(f"{path.rstrip('/')}-touched/batch={number}")
        batch.unpersist()

    return documents.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def provision_schema(spark: SparkSession) -> StructType:
    """The columns of the table that :func:`stream_materialize` writes, for document ids that are longs."""
    return corpus.reproject(spark.createDataFrame([], "doc_id long, pos int, text string")).schema


def materialized(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The table of :func:`stream_materialize` as of its last batch: each document's rows of the last batch that touched it."""
    schema = schema or spark.read.parquet(f"{path}/batch=0").schema
    doc = schema["doc_id"]
    rows = spark.read.schema(StructType([f for f in schema if f.name != "batch"]).add("batch", "long")).option("basePath", path).parquet(path)
    marks = spark.read.schema(StructType([doc]).add("batch", "long")).parquet(f"{path.rstrip('/')}-touched")
    last = marks.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["doc_id", "batch"], "left_semi")


def compact(spark: SparkSession, path: str, into: str, buckets: int = 256) -> None:
    """The table as of now, as a new one of one batch in ``buckets`` parts by document; for a time when no batch is running."""
    now = materialized(spark, path).drop("batch").repartition(buckets, "doc_id")
    now.write.mode("overwrite").parquet(f"{into}/batch=0")
    spark.read.parquet(f"{path.rstrip('/')}-touched").select("doc_id").distinct().write.mode("overwrite").parquet(f"{into.rstrip('/')}-touched/batch=0")
