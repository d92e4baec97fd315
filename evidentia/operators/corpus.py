"""Snapshots, versions and their lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.structure import classify_blocks, flat_hierarchy


def store_snapshots(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """One row per (source_id, sha256) of the captures that came in, the earliest; ``created`` is false for known ones."""
    one = incoming.groupBy("source_id", "sha256").agg(F.min("acquired_at").alias("acquired_at"), F.count("*").alias("captures"))
    known = existing.select("source_id", "sha256").distinct().withColumn("known", F.lit(True))
    return one.join(known, ["source_id", "sha256"], "left").withColumn("created", F.col("known").isNull()).drop("known")


def latest_snapshot(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("source_id").orderBy(F.desc("acquired_at"), F.desc("snapshot_id"))
    return df.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def snapshot_by_sha(df: DataFrame, sha: str) -> DataFrame:
    return df.filter(F.col("sha256") == sha)


def list_snapshots(df: DataFrame, raw: str = "raw_bytes") -> DataFrame:
    return df.select("snapshot_id", "source_id", "acquired_at", F.octet_length(raw).cast("long").alias("byte_length")).orderBy(F.desc("acquired_at"), F.desc("snapshot_id"))


def list_versions(versions: DataFrame, acts: DataFrame, snapshots: DataFrame) -> DataFrame:
    j = versions.join(acts, "act").join(snapshots, "snapshot_id")
    return j.withColumn("parser", F.concat_ws("/", "parser_name", "parser_version")).withColumn("is_latest", F.col("version") == F.max_by("version", F.struct("materialized_at", "version")).over(Window.partitionBy("act")))


def table_counts(named: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in named.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def materialize(parsed: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of versions that aren't known yet; writing them again adds none."""
    return parsed.join(existing.select("version").distinct(), "version", "left_anti")


def materialize_counts(parsed: DataFrame, existing: DataFrame) -> DataFrame:
    known = existing.select("version").distinct().withColumn("known", F.lit(True))
    return parsed.groupBy("version").agg(F.count("*").alias("provisions"), F.count_if(F.col("text").rlike(r"\S")).alias("units")).join(known, "version", "left").withColumn("created", F.col("known").isNull()).drop("known")


def write_version(parsed: DataFrame, path: str) -> None:
    """Partition overwrite by version: a rerun replaces a version by itself."""
    parsed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def validate_before_write(provisions: DataFrame, links: DataFrame) -> DataFrame:
    """Violations (version, rule, item): repeated keys or orders, unknown parents, links to unknown provisions."""
    dup = lambda c, rule: provisions.groupBy("version", c).count().filter("count > 1").select("version", F.lit(rule).alias("rule"), F.col(c).cast("string").alias("item"))
    keys = provisions.select("version", F.col("key").alias("k")).distinct()
    lost = lambda df, c, rule: df.filter(F.col(c).isNotNull()).join(keys.withColumnRenamed("k", c), ["version", c], "left_anti").select("version", F.lit(rule).alias("rule"), F.col(c).alias("item")).distinct()
    return dup("key", "DUPLICATE_KEY").union(dup("document_order", "DUPLICATE_ORDER")).union(lost(provisions, "parent_key", "UNKNOWN_PARENT")).union(lost(links, "stable_key", "UNKNOWN_PROVISION"))


def activate_versions(versions: DataFrame) -> DataFrame:
    """Exactly one active version per act, the latest; derived, never updated in place."""
    w = Window.partitionBy("act").orderBy(F.desc("materialized_at"), F.desc("version"))
    return versions.withColumn("is_active", F.row_number().over(w) == 1)


def reconcile_provisions(new: DataFrame, known: DataFrame) -> DataFrame:
    """Per (act, key): REUSED, CREATED, CONFLICT (type or label differ) or ABSENT (known only)."""
    n = new.select("act", "key", F.col("element_type").alias("n_type"), F.col("label").alias("n_label"), F.lit(1).alias("n"))
    k = known.select("act", "key", F.col("element_type").alias("k_type"), F.col("label").alias("k_label"), F.lit(1).alias("k"))
    j = n.join(k, ["act", "key"], "full_outer")
    same = F.col("n_type").eqNullSafe(F.col("k_type")) & F.col("n_label").eqNullSafe(F.col("k_label"))
    return j.select("act", "key", F.when(F.col("k").isNull(), "CREATED").when(F.col("n").isNull(), "ABSENT").when(same, "REUSED").otherwise("CONFLICT").alias("status"))


def run_ledger(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """What a wanted (source_id, parser) run meets: ALREADY_PARSED, IN_PROGRESS, RETRY (the latest failed) or CREATED."""
    last = runs.groupBy("source_id", "parser").agg(F.max_by("status", F.struct("started_at", "run_id")).alias("last"))
    return wanted.join(last, ["source_id", "parser"], "left").withColumn("outcome", F.when(F.col("last").isNull(), "CREATED").when(F.col("last") == "COMPLETED", "ALREADY_PARSED").when(F.col("last") == "RUNNING", "IN_PROGRESS").otherwise("RETRY"))


def reproject(blocks: DataFrame) -> DataFrame:
    """Provisions of stored pages' blocks, from nothing but the blocks."""
    return flat_hierarchy(classify_blocks(blocks))
