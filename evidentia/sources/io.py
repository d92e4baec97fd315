"""Readers with fixed schemas, write-once sinks, and the fetch log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = {
    "retrieval": "dataset string, version string, cases array<struct<case_id:string,category:string,question:string,expected_provisions:array<string>>>",
    "gold": "dataset string, version string, cases array<struct<case_id:string,category:string,question:string,gold_provisions:array<string>,required_provisions:array<string>,expected_decision:string>>",
    "abstention": "dataset string, version string, cases array<struct<case_id:string,question:string,reason:string>>",
    "holdout": "dataset string, version string, cases array<struct<case_id:string,category:string,question:string,sealed_sha256:string>>",
    "semantic": "dataset string, version string, cases array<struct<case_id:string,claim:string,evidence:string,expected:string>>",
}
RESPONSES = "case_id string, raw_response string, latency_ms double"
BUNDLE = "case_id string, category string, expected_decision string, required_provisions array<string>, gold_provisions array<string>, prompt_name string, prompt_version string, dataset_sha256 string, version_hash string, system_prompt string, user_prompt string, evidence array<struct<stable_key:string,provision_type:string,citation_text:string,document_order:bigint>>"


def read_cases(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One row per case of a JSON dataset file."""
    d = spark.read.schema(CASES[kind]).json(path, multiLine=True, mode="FAILFAST")
    return d.select("dataset", "version", F.explode("cases").alias("c")).select("dataset", "version", "c.*")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a corrupt one fails the read."""
    return spark.read.schema(RESPONSES).json(path, mode="FAILFAST")


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Evidence bundle; dataset, version and prompt must be the same in all records and required fields there."""
    b = spark.read.schema(BUNDLE).json(path, mode="FAILFAST")
    same = ("prompt_name", "prompt_version", "dataset_sha256", "version_hash")
    s = b.agg(*(F.count_distinct(c).alias(c) for c in same), F.count_if(F.col("case_id").isNull() | F.col("user_prompt").isNull()).alias("lost")).first()
    bad = [c for c in same if s[c] > 1] + ["required fields"] * (s["lost"] > 0)
    if bad:
        raise ValueError(f"bundle is inconsistent: {', '.join(bad)}")
    return b


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), F.col("content").alias("raw_bytes"), F.col("length").alias("byte_length"))


def write_once(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def report_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON with sorted keys, in sorted order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).orderBy("value")


def write_report(df: DataFrame, path: str) -> None:
    report_lines(df).write.mode("errorifexists").text(path)


def classify_fetch_log(log: DataFrame, min_bytes: int = 10, max_bytes: int = 10**7, allowed: tuple = ("text/html",), attempts: int = 3, base_delay: float = 1.0) -> DataFrame:
    """Outcome of each attempt, its number within (source, request), whether to try again and after how long.

    ``log``: source_id, request_id, at, status, content_type, byte_length, headers (array of k, v; the last of a name holds).
    """
    from pyspark.sql import Window

    last = lambda name: F.try_element_at(F.filter("headers", lambda h: F.lower(h["k"]) == name), F.lit(-1))["v"]
    kind = F.lower(F.trim(F.split("content_type", ";")[0]))
    outcome = (
        F.when(F.col("status") == 304, "NOT_MODIFIED")
        .when((F.col("status") >= 500) | F.col("status").isin(408, 429), "TRANSIENT")
        .when(F.col("status") != 200, "REJECTED_STATUS")
        .when(~kind.isin(*allowed), "REJECTED_TYPE")
        .when(F.col("byte_length") < min_bytes, "REJECTED_SMALL")
        .when(F.col("byte_length") > max_bytes, "REJECTED_LARGE")
        .otherwise("ACQUIRED")
    )
    d = log.withColumn("outcome", outcome).withColumn("attempt", F.row_number().over(Window.partitionBy("source_id", "request_id").orderBy("at")))
    again = (F.col("outcome") == "TRANSIENT") & (F.col("attempt") < attempts)
    charset = F.lower(F.regexp_extract("content_type", r"(?i)charset=\"?([A-Za-z0-9_-]+)", 1))
    return d.withColumns({"etag": last("etag"), "charset": F.when(charset == "", "utf-8").otherwise(charset), "retry": again, "retry_delay": F.when(again, F.lit(base_delay) * F.pow(F.lit(2.0), F.col("attempt") - 1))})


def bundle_rows(cases: DataFrame, provisions: DataFrame, prompt: str) -> DataFrame:
    """One row per case: its gold provisions in document order as an array, and the rendered prompt."""
    e = cases.select("case_id", F.explode("gold").alias("key")).join(provisions, "key").groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("document_order", "key", "text"))).alias("evidence"))
    body = F.array_join(F.transform("evidence", lambda x: F.concat(F.lit("["), x["key"], F.lit("] "), x["text"])), "\n")
    return cases.join(e, "case_id", "left").withColumn("user_prompt", F.concat(F.lit(prompt), F.lit("\n"), F.col("question"), F.lit("\n"), F.coalesce(body, F.lit("(no evidence)"))))


def export_bundle(cases: DataFrame, provisions: DataFrame, prompt: str, path: str) -> None:
    bundle_rows(cases, provisions, prompt).write.mode("errorifexists").json(path)


def campaign_tables(results: DataFrame) -> dict[str, DataFrame]:
    """A result set as raw, automatic, diagnostic and review tables."""
    return {
        "raw": results.select("case_id", "raw_response", "latency_ms"),
        "automatic": results.select("case_id", "category", "automatic_pass"),
        "diagnostic": results.select("case_id", "failure_class"),
        "review": results.select("case_id", *(F.lit(None).cast("string").alias(c) for c in ("legal_correctness", "groundedness", "completeness", "comments"))),
    }
