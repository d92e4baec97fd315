"""Inputs of the queries, derived from the given tables, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.text import ACCENTED, FOLDED
from evidentia.operators import index
from evidentia.sources.scratch import spread

STOP = ("the", "and", "for", "with", "that", "les", "des", "der", "die", "und", "los", "las", "que")
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def units(spark: SparkSession, d: str) -> DataFrame:
    """One unit per line with text: version is the language, the document is the parent."""
    x = t(spark, d, "documents").select(F.col("lang").alias("version"), "doc_id", F.posexplode(F.split("text", "\n")).alias("document_order", "text"))
    return x.filter(F.col("text").rlike(r"\S")).select("version", "doc_id", F.concat_ws(":", "doc_id", F.lpad(F.col("document_order").cast("string"), 6, "0")).alias("unit_key"), F.col("doc_id").cast("string").alias("parent_key"), F.col("document_order").cast("long").alias("document_order"), "text")


UNITS = """units as (select lang as version, doc_id, doc_id || ':' || lpad((i)::varchar, 6, '0') as unit_key, doc_id::varchar as parent_key, i::bigint as document_order, line as text
 from (select lang, doc_id, unnest(range(len(l))) as i, unnest(l) as line from (select lang, doc_id, string_split(text, chr(10)) as l from documents)) where regexp_matches(line, '\\S'))"""


def whole_questions(spark: SparkSession, d: str) -> DataFrame:
    """Each whole benchmark passage, asked of each language."""
    b = t(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))
    return b.select("*", F.explode(F.array(*(F.lit(x) for x in ("de", "en", "es", "fr")))).alias("version")).withColumn("question_id", F.concat_ws("-", "item_id", "version"))


WHOLE_QUESTIONS = """questions as (select item_id, text as question, version, item_id || '-' || version as question_id
 from benchmark, (values ('de'), ('en'), ('es'), ('fr')) v(version))"""

#: DuckDB form of fold_terms and fold_tokens over an expression.
def terms_sql(x: str, stop: bool = False, min_len: int = 3, plural: bool = True, stem: int = 6) -> str:
    words = f"regexp_extract_all(lower(coalesce({x}, '')), '\\p{{L}}{{{min_len},}}')"
    if stop:
        words = f"list_filter({words}, lambda w: w not in ({STOP_SQL}))"
    shaped = f"translate(w, '{ACCENTED}', '{FOLDED}')"
    if plural:
        shaped = f"regexp_replace({shaped}, '^(.{{4,}})s$', '\\1')"
    return f"list_transform({words}, lambda w: substr({shaped}, 1, {stem}))"


POSTINGS = f"""lexemes as (select version, unit_key, unnest(ts) as term, unnest(range(len(ts))) as position from (select version, unit_key, {terms_sql('text')} as ts from units)),
postings as (select version, term, unit_key, count(*)::int as tf, list(position order by position) as positions from lexemes group by all),
freq as (select version, term, count(*) as df from postings group by all),
sizes as (select version, count(*) as n_units from units group by all)"""

QTERMS = f"""q0 as (select question_id, version, question, {terms_sql('question')} as ts from questions),
q1 as (select question_id, version, term, min(p) as p from (select question_id, version, unnest(ts) as term, unnest(range(len(ts))) as p from q0) group by all),
qterms as (select question_id, version, term, (row_number() over (partition by question_id order by p) - 1)::int as slot, count(*) over (partition by question_id) as n_terms from q1)"""


def sql(*ctes: str) -> str:
    """Common table expressions, then the query."""
    return "with " + ",\n".join(ctes[:-1]) + "\n" + ctes[-1] if len(ctes) > 1 else ctes[0]


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def tree(spark: SparkSession, d: str) -> DataFrame:
    """Orders over their line items, dealt out by order as their number asks; what goes on by order stays so."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return spread(li, li.count(), "l_orderkey").select(F.concat(F.lit("o"), "l_orderkey").alias("parent"), F.row_number().over(w).alias("child_order"), "l_orderkey").withColumn("child", F.concat(F.lit("l"), "l_orderkey", F.lit("."), "child_order"))


TREE = """tree as (select 'o' || l_orderkey as parent, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)::int as child_order, l_orderkey, 'l' || l_orderkey || '.' || row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as child from lineitem)"""


def provisions(spark: SparkSession, d: str) -> DataFrame:
    """Orders and line items as provisions: version is the order's status."""
    o = t(spark, d, "orders").select(F.col("o_orderstatus").alias("version"), F.concat(F.lit("o"), "o_orderkey").alias("key"), F.lit(None).cast("string").alias("parent_key"), (F.col("o_orderkey").cast("long") * 100).alias("document_order"), F.col("o_orderpriority").alias("text"))
    c = tree(spark, d).join(t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("version")), "l_orderkey")
    c = c.select("version", F.col("child").alias("key"), F.col("parent").alias("parent_key"), (F.col("l_orderkey").cast("long") * 100 + F.col("child_order")).alias("document_order"), F.when(F.col("child_order") % 5 != 0, F.concat(F.lit("line "), F.col("child_order").cast("string"))).otherwise(" ").alias("text"))
    return o.union(c)


PROVISIONS = TREE + """,
provisions as (select o_orderstatus as version, 'o' || o_orderkey as key, null::varchar as parent_key, o_orderkey::bigint * 100 as document_order, o_orderpriority as text from orders
 union all select o_orderstatus, child, parent, l_orderkey::bigint * 100 + child_order, case when child_order % 5 <> 0 then 'line ' || child_order else ' ' end from tree join orders on o_orderkey = l_orderkey)"""


def order_cands(spark: SparkSession, d: str) -> DataFrame:
    """Customers as questions, their orders by price as ranked candidates."""
    from pyspark.sql import Window

    o = t(spark, d, "orders")
    w = Window.partitionBy("o_custkey", "o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.select(F.concat(F.col("o_custkey").cast("string"), "o_orderstatus").alias("question_id"), F.col("o_orderstatus").alias("version"), F.concat(F.lit("o"), "o_orderkey").alias("key"), F.row_number().over(w).alias("rank"))


ORDER_CANDS = "cands as (select o_custkey || o_orderstatus as question_id, o_orderstatus as version, 'o' || o_orderkey as key, row_number() over (partition by o_custkey, o_orderstatus order by o_totalprice desc, o_orderkey)::int as rank from orders)"


def cases(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as evaluation cases; quality is what's expected, toxicity and the id's residues what came out."""
    x = t(spark, d, "labels").join(t(spark, d, "documents"), "doc_id")
    i = F.col("doc_id")
    arr = lambda n, step, off: F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("k"), ((i * step + k + off) % 11).cast("string")))
    none = F.array().cast("array<string>")
    x = x.select(i.cast("string").alias("case_id"), F.col("lang").alias("category"), (F.col("quality") == 1).alias("expect_answer"), ((i % 7) != 3).alias("answered"), ((i % 5) != 1).alias("target_hit"), ((i % 9) != 4).alias("found_it"), ((i % 6) != 5).alias("selected_it"), (F.col("n_chars") % 997).cast("double").alias("latency_ms"), F.col("toxic"), i.alias("doc_id"),
                 arr((i % 3 + 1).cast("int"), 3, 0).alias("expected"), arr((i % 4 + 1).cast("int"), 2, 1).alias("retrieved"), arr((i % 6 + 1).cast("int"), 2, 1).alias("assembled"), arr((i % 2 + 1).cast("int"), 3, 1).alias("cited"), arr(F.lit(1), 5, 2).alias("acceptable"))
    decision = lambda c: F.when(F.col(c), "ANSWER").otherwise("ABSTAIN")
    return x.withColumns({"expected_decision": decision("expect_answer"), "decision": decision("answered")}).withColumn("required", F.when(F.col("expect_answer"), F.col("expected")).otherwise(none)).withColumn("citations", F.when(F.col("answered"), F.col("cited")).otherwise(none))


def _arr(n: str, step: int, off: int) -> str:
    return f"list_transform(range(1, ({n})::bigint + 1), lambda k: 'k' || ((doc_id * {step} + k + {off}) % 11))"


CASES = f"""cases0 as (select doc_id::varchar as case_id, lang as category, quality = 1 as expect_answer, doc_id % 7 <> 3 as answered, doc_id % 5 <> 1 as target_hit, doc_id % 9 <> 4 as found_it, doc_id % 6 <> 5 as selected_it, (n_chars % 997)::double as latency_ms, toxic, doc_id,
 {_arr('doc_id % 3 + 1', 3, 0)} as expected, {_arr('doc_id % 4 + 1', 2, 1)} as retrieved, {_arr('doc_id % 6 + 1', 2, 1)} as assembled, {_arr('doc_id % 2 + 1', 3, 1)} as cited, {_arr('1', 5, 2)} as acceptable
 from labels join documents using (doc_id)),
cases as (select *, case when expect_answer then 'ANSWER' else 'ABSTAIN' end as expected_decision, case when answered then 'ANSWER' else 'ABSTAIN' end as decision, case when expect_answer then expected else [] end as required, case when answered then cited else [] end as citations from cases0)"""


#: Bytes of text for which a stored index has a bucket more, above 32.
BUCKET_BYTES = 16_000_000


def stored_index(spark: SparkSession, d: str, kind: str = "lines") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, frequencies and sizes of the units (lines or whole documents), stored once in a session for the files as they are."""
    from evidentia.sources.scratch import scratch

    files = t(spark, d, "documents").select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size")
    state = files.agg(F.count("*"), F.expr("sum(cast(xxhash64(file_path, file_modification_time, file_size) as decimal(38, 0)))")).first()
    name = f"postings_{kind}_" + hashlib.md5(str(tuple(state)).encode()).hexdigest()[:16]
    if not spark.catalog.tableExists(f"{name}_sizes"):
        size = t(spark, d, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
        index.store_index({"lines": units, "documents": whole_documents}[kind](spark, d), name, scratch(spark), buckets=max(32, -(-size // BUCKET_BYTES)))
    return index.stored(spark, name)


def whole_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each document as one unit of one version."""
    return t(spark, d, "documents").select(F.lit("v").alias("version"), F.col("doc_id").cast("string").alias("unit_key"), "text")
