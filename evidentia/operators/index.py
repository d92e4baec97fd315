"""Units, terms, postings and weights: the lexical index as plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions.text import content_hash, fold_terms


def project_units(provisions: DataFrame, key: str = "unit_key", text: str = "text") -> DataFrame:
    """One search unit per provision with text that isn't blank, with its content hash."""
    return provisions.filter(F.col(text).rlike(r"\S")).withColumn("content_hash", content_hash(F.col(text)))


def chunk_drafts(elements: DataFrame, versions: DataFrame, acts: DataFrame) -> DataFrame:
    """Current normative elements of active versions: a header line, their text, and a word count."""
    e = elements.filter((F.col("text_status") == "CURRENT") & (F.col("content_role") == "NORMATIVE"))
    e = e.join(versions.filter("is_active").select("version"), "version", "left_semi").join(acts, "act")
    chunk = F.concat(F.col("title"), F.lit(" | "), F.col("path"), F.lit("\n"), F.col("text"))
    return e.withColumn("chunk_text", chunk).withColumn("token_count", F.size(F.split(F.trim("chunk_text"), r"\s+")))


def lexemes(units: DataFrame, text: str = "text", **shape) -> DataFrame:
    """One row per term occurrence: version, unit_key, position, term."""
    return units.select("version", "unit_key", F.posexplode(fold_terms(F.col(text), **shape)).alias("position", "term"))


def _by_term(terms: Column) -> Column:
    """A text's terms, each once with its sorted positions: sorted within the row and cut where the term changes."""
    sorted_ = F.sort_array(F.transform(terms, lambda x, i: F.struct(x.alias("term"), i.alias("p"))))

    def starts(a: Column) -> Column:
        return F.filter(F.transform(a, lambda x, i: F.struct(x["term"].alias("term"), i.alias("i"))), lambda x: ~F.get(a, x["i"] - 1)["term"].eqNullSafe(x["term"]))

    def cut_(x: Column) -> Column:
        a, b = x["a"], x["b"]
        upto = lambda k: F.coalesce(F.get(b, k + 1)["i"], F.size(a))
        return F.transform(b, lambda y, k: F.struct(y["term"].alias("term"), F.transform(F.slice(a, y["i"] + 1, upto(k) - y["i"]), lambda z: z["p"]).alias("positions")))

    # arrays of one element give a value a name, so that it is worked out once and not for each element
    both = F.transform(F.array(sorted_), lambda a: F.struct(a.alias("a"), starts(a).alias("b")))
    return F.transform(both, cut_)[0]


def build_postings(units: DataFrame, text: str = "text", **shape) -> DataFrame:
    """(version, term, unit_key) with tf and sorted positions. Terms meet within their unit's row, so nothing is shuffled; only where unit keys repeat are postings merged."""
    p = units.select("version", "unit_key", F.explode(_by_term(fold_terms(F.col(text), **shape))).alias("x")).select("version", "x.term", "unit_key", "x.positions")
    if not units.groupBy("version", "unit_key").count().filter("count > 1").isEmpty():
        p = p.groupBy("version", "term", "unit_key").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return p.withColumn("tf", F.size("positions"))


BUCKETED = ("version", "term")


def _append(df: DataFrame, name: str, path: str, buckets: int) -> None:
    """Appended to a table in parts by version and buckets by (version, term): a task writes the one bucket that its rows hash to."""
    w = df.repartition(buckets, *BUCKETED).withColumn("part", F.col("version")).write.mode("append").partitionBy("part").bucketBy(buckets, *BUCKETED)
    (w if df.sparkSession.catalog.tableExists(name) else w.option("path", path)).saveAsTable(name)


def store_index(units: DataFrame, name: str, path: str, buckets: int = 64, **shape) -> None:
    """Postings and document frequencies as tables ``name`` and ``name_df``, bucketed by (version, term), with sizes in ``name_sizes``; versions are appended.

    Joins on (version, term) and groupings by it read the buckets as they lie: no posting is shuffled again.
    ``path`` and ``buckets`` are fixed with the first call; there should be so many that they leave a bucket of a version some hundred MB at most. A version is
    stored once; :func:`withdraw_version` takes it out before it is stored anew.
    """
    spark = units.sparkSession
    versions = [r.version for r in units.select("version").distinct().collect()] if spark.catalog.tableExists(f"{name}_sizes") else []
    have = {r.part for r in spark.table(f"{name}_sizes").select("part").distinct().collect()} if versions else set()
    if again := have & set(versions):
        raise ValueError(f"versions are stored already: {sorted(again)}")
    _append(build_postings(units, **shape), name, f"{path}/postings", buckets)
    new = spark.table(name).filter(~F.col("part").isin(*have)) if have else spark.table(name)
    _append(document_frequency(new), f"{name}_df", f"{path}/df", buckets)
    sizes = corpus_size(units).withColumn("part", F.col("version"))
    w = sizes.coalesce(1).write.mode("append").partitionBy("part")
    (w if spark.catalog.tableExists(f"{name}_sizes") else w.option("path", f"{path}/sizes")).saveAsTable(f"{name}_sizes")


def withdraw_version(spark: SparkSession, name: str, version: str) -> None:
    """A version's postings, frequencies and size are gone; other versions' files are not touched."""
    for t in (name, f"{name}_df", f"{name}_sizes"):
        nothing = spark.createDataFrame([], spark.table(t).drop("part").schema)
        spark.sql(f"insert overwrite table {t} partition (part = :v) select * from {{nothing}}", args={"v": version}, nothing=nothing)


def stored(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, document frequencies and sizes of a stored index."""
    return tuple(spark.table(t).drop("part") for t in (name, f"{name}_df", f"{name}_sizes"))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("version", "term").agg(F.count("*").alias("df"))


def corpus_size(units: DataFrame) -> DataFrame:
    return units.groupBy("version").agg(F.count("*").alias("n_units"))


def idf_weights(df_table: DataFrame, sizes: DataFrame, plus: float = 0.0) -> DataFrame:
    """ln((N + 1) / (df + 1)) + ``plus``. Sizes have a row per version: a small side, which the planner checks."""
    return df_table.join(sizes, "version").withColumn("weight", F.log((F.col("n_units") + 1) / (F.col("df") + 1)) + plus)


def index_status(units: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Per version: CREATED without any vector, ALREADY_INDEXED with all, else PARTIAL."""
    have = embeddings.select("version", "unit_key").distinct().withColumn("has", F.lit(1))
    s = units.select("version", "unit_key").join(have, ["version", "unit_key"], "left").groupBy("version").agg(F.count("*").alias("expected"), F.count("has").alias("found"))
    return s.withColumn("status", F.when(F.col("found") == 0, "CREATED").when(F.col("found") == F.col("expected"), "ALREADY_INDEXED").otherwise("PARTIAL"))


def attach_embeddings(chunks: DataFrame, vectors: DataFrame, dimensions: int) -> DataFrame:
    """Chunks with their vector and an error: MISSING, EMPTY, BAD_DIMENSIONS, DUPLICATE or null."""
    v = vectors.groupBy("chunk_id").agg(F.count("*").alias("copies"), F.min_by("vector", F.size("vector")).alias("vector"))
    j = chunks.join(v, "chunk_id", "left")
    return j.withColumn("error", F.when(F.col("copies").isNull(), "MISSING").when(F.col("copies") > 1, "DUPLICATE").when(F.size("vector") == 0, "EMPTY").when(F.size("vector") != dimensions, "BAD_DIMENSIONS"))


def with_provision_keys(units: DataFrame, links: DataFrame) -> DataFrame:
    """Each unit with its provision keys in link order; units without links have an empty list."""
    keys = links.groupBy("version", "unit_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "stable_key"))), lambda x: x["stable_key"]).alias("provision_keys"))
    return units.join(keys, ["version", "unit_key"], "left").withColumn("provision_keys", F.coalesce("provision_keys", F.array().cast("array<string>")))


def top_k(df: DataFrame, by: str, order: list, k, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; a constant ``k`` lets each task keep only k rows before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col(name) <= k)
