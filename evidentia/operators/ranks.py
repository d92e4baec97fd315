"""Places in order without one task that sorts a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.sources.scratch import cut


def same(a: DataFrame, b: DataFrame, columns: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, y: x & y, (a[p].eqNullSafe(b[q]) for p, q in columns))


def ranked(df: DataFrame, by: list[str], order: list[str], name: str = "n", parts: int | None = None) -> DataFrame:
    """Adds each row's place (from 1) in its group, ties in any order.

    Rows are dealt out in ranges of (group, order), ties at random, and written with their range. A row's place is its place in
    its range and what the group has in ranges before: a range is what one task gets, however large the group.
    Groups of null are groups; nulls come first in order, as Spark sorts them.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = df.withColumn("tie_", F.rand(11)).repartitionByRange(parts, *by, *order, "tie_")
    r = cut(r.withColumn("range_", F.spark_partition_id()))
    here = r.groupBy(*by, "range_").agg(F.count("*").alias("c_"))
    before = F.coalesce(F.sum("c_").over(Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = here.select(*(F.col(c).alias(f"b{i}_") for i, c in enumerate(by)), F.col("range_").alias("r_"), before.alias("before_"))
    own = r.withColumn("own_", F.row_number().over(Window.partitionBy(*by, "range_").orderBy(*order, "tie_")))
    on = same(own, here, [(c, f"b{i}_") for i, c in enumerate(by)]) & (own["range_"] == here["r_"])
    return own.join(here, on).withColumn(name, F.col("before_") + F.col("own_")).drop("tie_", "range_", "r_", "own_", "before_", *(f"b{i}_" for i in range(len(by))))


def fingerprint(df: DataFrame, key: str, order: list[str], fields: list[str], fan: int = 1000, levels: int | None = None) -> DataFrame:
    """One hash per key that depends on all rows and their order, by a tree of hashes of ``fan`` rows each, so that no group is ever one row or one task.

    Rows that tie in ``order`` are taken in the order of their hashes. A key without rows has no hash. Groups of fewer than ``fan`` rows
    are hashed where their rows meet; only larger ones are dealt out by ranges. With ``levels`` the tree is that deep at most:
    of 1, a key's hash is that of its rows' chunks, whose hashes (65 bytes for ``fan`` rows) then meet in one row.
    """
    rows = df.select(F.col(key).alias("k_"), *(F.col(c).alias(f"o{i}_") for i, c in enumerate(order)), *(F.col(c).alias(f"f{i}_") for i, c in enumerate(fields)))
    own = F.sha2(F.to_json(F.struct(*(F.col(f"f{i}_").alias(c) for i, c in enumerate(fields)))), 256)
    names = [f"o{i}_" for i in range(len(order))]
    sizes = cut(rows.groupBy("k_").agg(F.count("*").alias("c")).filter(F.col("c") >= fan).select(F.col("k_").alias("l_")))
    in_large = F.col("k_").eqNullSafe(F.col("l_"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "h"))), lambda x: x["h"]), "\n")
    group = F.sort_array(F.transform(F.collect_list(F.struct(*names, *(f"f{i}_" for i in range(len(fields))))), lambda x: F.struct(*(x[c].alias(c) for c in names), F.sha2(F.to_json(F.struct(*(x[f"f{i}_"].alias(c) for i, c in enumerate(fields)))), 256).alias("h"))))
    whole = F.sha2(F.sha2(F.array_join(F.transform(group, lambda x: x["h"]), "\n"), 256), 256)
    if sizes.isEmpty():
        return rows.groupBy("k_").agg(whole.alias("fingerprint")).withColumnRenamed("k_", key)
    done = rows.join(sizes, in_large, "left_anti").groupBy("k_").agg(whole.alias("fingerprint"))
    level = rows.join(sizes, in_large, "left_semi").select("k_", *names, own.alias("h"))
    level = ranked(level, ["k_"], [*names, "h"]).select("k_", "n", "h")
    depth = 0
    while True:  # once for each factor of ``fan`` in the largest group
        level, depth = cut(level.groupBy("k_", F.floor(F.col("n") / fan).alias("c")).agg(F.sha2(joined, 256).alias("h")).withColumnRenamed("c", "n")), depth + 1
        large = level.groupBy(F.col("k_").alias("l_")).agg(F.count("*").alias("c")).filter(F.col("c") > (fan if depth != levels else 2**62))
        small = level.join(large, in_large, "left_anti").groupBy("k_").agg(F.sha2(joined, 256).alias("fingerprint"))
        done = done.unionByName(small)
        if large.isEmpty():
            return done.withColumnRenamed("k_", key)
        level = level.join(large, in_large, "left_semi")
