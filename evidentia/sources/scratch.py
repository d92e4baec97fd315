"""Where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(s: SparkSession) -> str:
    """A folder that driver and executors share; one of this machine only where everything runs on it."""
    base = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not s.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        s.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/q-{uuid.uuid4().hex}"


#: Rows of a partition of :func:`spread`.
SPREAD_ROWS = 50_000


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` dealt out by ``by`` in as many partitions as ``rows`` ask for, so that a task's share does not grow with the table.

    Windows, groupings and joins on all of ``by`` that follow keep the partitioning. Where the session's number of partitions is enough, nothing is done.
    """
    parts = -(-rows // SPREAD_ROWS)
    return df.repartition(parts, *by) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table: its lineage is cut, its size is known, and lost executors cost no recomputation."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def likely(rows: DataFrame, col: str, keys: DataFrame) -> DataFrame:
    """``rows`` without those whose ``col`` is surely not among the one column of ``keys``, and without moving any.

    Places of the keys' hashes are broadcast, two million at most whatever the number of keys; with more keys more rows stay, and none goes wrongly.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 21))
    places = keys.select(place(keys.columns[0]).alias("place_")).distinct()
    return rows.join(F.broadcast(places), place(col) == F.col("place_"), "left_semi")
