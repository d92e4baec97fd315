"""Queries of sources, snapshots, versions, audits and streams."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators import audit, corpus, law, rules
from evidentia.plans import structures
from evidentia.plans.inputs import PROVISIONS, provisions, sql, t
from evidentia.plans.register import query
from evidentia.sources.scratch import scratch
from evidentia.sources import io
from evidentia.streaming import stream

C = F.col


def snapshots(s, d) -> DataFrame:
    """Documents as captures of their source at the time of an event."""
    e = t(s, d, "events").select(C("event_id").alias("doc_id"), C("ts").alias("acquired_at"))
    return t(s, d, "documents").join(e, "doc_id").select(C("doc_id").alias("snapshot_id"), C("source").alias("source_id"), F.sha2("text", 256).alias("sha256"), C("text").cast("binary").alias("raw_bytes"), "acquired_at")


SNAP = "snap as (select doc_id as snapshot_id, source as source_id, sha256(text) as sha256, text, ts as acquired_at from documents join events on event_id = doc_id)"


@query("A1_read_cases", "select item_id::varchar as case_id, 'c' || (item_id % 4) as category, text as question, 1 as n_expected from benchmark")
def _(s, d):
    """Cases written as one JSON dataset per category, read back."""
    b = t(s, d, "benchmark").select(C("item_id").cast("string").alias("case_id"), F.concat(F.lit("c"), (C("item_id") % 4).cast("string")).alias("category"), C("text").alias("question"), F.array(F.concat(F.lit("k"), "item_id")).alias("expected_provisions"))
    path = scratch(s)
    b.groupBy(C("category").alias("dataset")).agg(F.lit("1").alias("version"), F.collect_list(F.struct(*b.columns)).alias("cases")).select(F.to_json(F.struct("*")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return io.read_cases(s, path, "retrieval").select("case_id", "category", "question", F.size("expected_provisions").alias("n_expected"))


@query("A2_read_responses", "select doc_id::varchar as case_id, sha256(text) as h, (n_chars % 97)::double as latency_ms from documents")
def _(s, d):
    path = scratch(s)
    t(s, d, "documents").select(C("doc_id").cast("string").alias("case_id"), C("text").alias("raw_response"), (C("n_chars") % 97).cast("double").alias("latency_ms")).write.json(path)
    return io.read_responses(s, path).select("case_id", F.sha2("raw_response", 256).alias("h"), "latency_ms")


BUNDLED = """li as (select l_orderkey, 'p' || l_partkey as key, min(l_partkey)::bigint as o from lineitem where l_quantity > 25 group by all),
ev as (select l_orderkey, string_agg('[' || key || '] part ' || o, chr(10) order by o, key) as body, count(*) as n from li group by 1)"""


def bundle(s, d) -> DataFrame:
    li = t(s, d, "lineitem").filter("l_quantity > 25")
    c = li.groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("p"), "l_partkey")).alias("gold")).select(C("l_orderkey").cast("string").alias("case_id"), F.lit("q?").alias("question"), "gold")
    p = t(s, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("key"), C("p_partkey").cast("long").alias("document_order"), F.concat(F.lit("part "), "p_partkey").alias("text"))
    return io.bundle_rows(c, p, "Answer:")


@query("A14_export_bundle", sql(BUNDLED, "select l_orderkey::varchar as case_id, n as n_evidence, sha256('Answer:' || chr(10) || 'q?' || chr(10) || body) as prompt_sha256 from ev"))
def _(s, d):
    return bundle(s, d).select("case_id", F.size("evidence").cast("long").alias("n_evidence"), F.sha2("user_prompt", 256).alias("prompt_sha256"))


@query("A3_read_bundle", sql(BUNDLED, "select l_orderkey::varchar as case_id, n as n_evidence from ev"))
def _(s, d):
    path = scratch(s)
    b = bundle(s, d).select("case_id", "user_prompt", F.lit("p").alias("prompt_name"), F.lit("1").alias("prompt_version"), F.lit("h").alias("dataset_sha256"), F.lit("v").alias("version_hash"), F.transform("evidence", lambda e: F.struct(e["key"].alias("stable_key"), e["document_order"].alias("document_order"))).alias("evidence"))
    b.write.json(path)
    return io.read_bundle(s, path).select("case_id", F.size("evidence").cast("long").alias("n_evidence"))


@query("A4_read_pages", "select page_id, url, sha256(html) as sha256, strlen(html) as byte_length from pages")
def _(s, d):
    return io.read_pages(s, f"{d}/pages.parquet").select("page_id", "url", F.sha2(C("html").cast("binary"), 256).alias("sha256"), F.octet_length("html").cast("long").alias("byte_length"))


@query("A5_write_once", "select o_orderkey, o_totalprice from orders")
def _(s, d):
    path = scratch(s)
    io.write_once(t(s, d, "orders").select("o_orderkey", "o_totalprice"), path)
    return s.read.parquet(path)


@query("A6_write_report", """select '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' as value from orders""")
def _(s, d):
    path = scratch(s)
    io.write_report(t(s, d, "orders").select("o_orderstatus", "o_orderkey"), path)
    return s.read.text(path)


@query("A7_store_snapshots", sql(SNAP, "known as (select distinct source_id, sha256 from snap where snapshot_id % 3 = 0)", "select s.source_id, s.sha256, min(acquired_at) as acquired_at, count(*) as captures, max(k.sha256) is null as created from snap s left join known k using (source_id, sha256) where snapshot_id % 2 = 0 group by all"))
def _(s, d):
    x = snapshots(s, d)
    return corpus.store_snapshots(x.filter("snapshot_id % 2 = 0"), x.filter("snapshot_id % 3 = 0"))


@query("A8_latest_snapshot", sql(SNAP, "select source_id, snapshot_id, sha256 from (select *, row_number() over (partition by source_id order by acquired_at desc, snapshot_id desc) as r from snap) where r = 1"))
def _(s, d):
    return corpus.latest_snapshot(snapshots(s, d)).select("source_id", "snapshot_id", "sha256")


@query("A9_snapshot_by_sha", sql(SNAP, "select snapshot_id, source_id from snap where sha256 = (select sha256(text) from documents where doc_id = 5)"))
def _(s, d):
    sha = t(s, d, "documents").filter("doc_id = 5").select(F.sha2("text", 256)).first()[0]
    return corpus.snapshot_by_sha(snapshots(s, d), sha).select("snapshot_id", "source_id")


@query("A10_list_snapshots", sql(SNAP, "select snapshot_id, source_id, acquired_at, strlen(text) as byte_length from snap"))
def _(s, d):
    return corpus.list_snapshots(snapshots(s, d))


def versions(s, d) -> DataFrame:
    """Orders as versions of their customer's act."""
    return t(s, d, "orders").select(C("o_orderkey").alias("version"), C("o_custkey").alias("act"), C("o_orderkey").alias("snapshot_id"), F.lit("flat").alias("parser_name"), (C("o_orderkey") % 3).cast("string").alias("parser_version"), C("o_orderdate").alias("materialized_at"))


@query("A11_list_versions", "select o_orderkey as version, c_name, 'flat/' || (o_orderkey % 3) as parser, o_orderkey = first_value(o_orderkey) over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as is_latest from orders join customer on c_custkey = o_custkey")
def _(s, d):
    a = t(s, d, "customer").select(C("c_custkey").alias("act"), "c_name")
    return corpus.list_versions(versions(s, d), a, t(s, d, "orders").select(C("o_orderkey").alias("snapshot_id"))).select("version", "c_name", "parser", "is_latest")


@query("A12_table_counts", " union all ".join(f"select '{n}' as table_name, count(*) as n from {n}" for n in ("documents", "pages", "orders", "lineitem")))
def _(s, d):
    return corpus.table_counts({n: t(s, d, n) for n in ("documents", "pages", "orders", "lineitem")})


@query("A13_classify_fetch_log", """with x as (select *, case event_id % 6 when 0 then 304 when 1 then 503 when 2 then 404 else 200 end as status, case event_id % 5 when 0 then 'application/pdf' else 'Text/HTML; charset=ISO-8859-1' end as ct, (event_id % 50) * 10 as bytes from events),
y as (select *, case when status = 304 then 'NOT_MODIFIED' when status >= 500 then 'TRANSIENT' when status <> 200 then 'REJECTED_STATUS' when ct = 'application/pdf' then 'REJECTED_TYPE' when bytes < 20 then 'REJECTED_SMALL' when bytes > 400 then 'REJECTED_LARGE' else 'ACQUIRED' end as outcome, row_number() over (partition by user_id, event_type order by event_id)::int as attempt from x)
select event_id, outcome, attempt, 'b' || event_id as etag, case when ct = 'application/pdf' then 'utf-8' else 'iso-8859-1' end as charset, outcome = 'TRANSIENT' and attempt < 3 as retry, case when outcome = 'TRANSIENT' and attempt < 3 then power(2.0, attempt - 1) end as retry_delay from y""")
def _(s, d):
    k = C("event_id")
    h = lambda n, v: F.struct(F.lit(n).alias("k"), F.concat(F.lit(v), k.cast("string")).alias("v"))
    log = t(s, d, "events").select("event_id", C("user_id").alias("source_id"), C("event_type").alias("request_id"), k.alias("at"), F.when(k % 6 == 0, 304).when(k % 6 == 1, 503).when(k % 6 == 2, 404).otherwise(200).alias("status"), F.when(k % 5 == 0, "application/pdf").otherwise("Text/HTML; charset=ISO-8859-1").alias("content_type"), ((k % 50) * 10).alias("byte_length"), F.array(h("ETag", "a"), h("x", "c"), h("etag", "b")).alias("headers"))
    return io.classify_fetch_log(log, 20, 400).select("event_id", "outcome", "attempt", "etag", "charset", "retry", "retry_delay")


@query("A15_campaign_tables", "select 'raw' as table_name, count(*) as n from documents union all select 'automatic', count(*) from documents union all select 'diagnostic', count(*) from documents union all select 'review', count(*) from documents")
def _(s, d):
    r = t(s, d, "documents").select(C("doc_id").alias("case_id"), C("lang").alias("category"), C("text").alias("raw_response"), C("n_chars").alias("latency_ms"), F.lit(True).alias("automatic_pass"), F.lit(None).cast("string").alias("failure_class"))
    return corpus.table_counts(io.campaign_tables(r))


# --- versions ---


@query("D1_materialize", sql(PROVISIONS, "select version, key, document_order from provisions where version <> 'F'"))
def _(s, d):
    p = provisions(s, d)
    path = scratch(s)
    corpus.write_version(corpus.materialize(p, p.filter("version = 'F'")), path)
    return s.read.schema(p.schema).parquet(path).select("version", "key", "document_order")


@query("D1_materialize_counts", sql(PROVISIONS, "select version, count(*) as provisions, count(*) filter (regexp_matches(text, '\\S')) as units, version <> 'F' as created from provisions group by 1"))
def _(s, d):
    p = provisions(s, d)
    return corpus.materialize_counts(p, p.filter("version = 'F'"))


@query("D2_validate_before_write", """with p as (select l_returnflag as version, l_orderkey || '.' || l_linenumber as key, l_orderkey::bigint * 100 + l_linenumber as o, case when l_partkey % 9 = 0 then 'x' || l_partkey end as parent from lineitem)
select version, 'DUPLICATE_KEY' as rule, key as item from p group by version, key having count(*) > 1 union all select version, 'DUPLICATE_ORDER', o::varchar from p group by version, o having count(*) > 1 union all select distinct version, 'UNKNOWN_PARENT', parent from p where parent is not null union all select distinct version, 'UNKNOWN_PROVISION', 'y' from p""")
def _(s, d):
    p = t(s, d, "lineitem").select(C("l_returnflag").alias("version"), F.concat_ws(".", "l_orderkey", "l_linenumber").alias("key"), (C("l_orderkey").cast("long") * 100 + C("l_linenumber")).alias("document_order"), F.when(C("l_partkey") % 9 == 0, F.concat(F.lit("x"), "l_partkey")).alias("parent_key"))
    return corpus.validate_before_write(p, p.select("version", F.lit("y").alias("stable_key")))


@query("D3_activate_versions", "select o_orderkey as version, o_custkey as act, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1 as is_active from orders")
def _(s, d):
    return corpus.activate_versions(versions(s, d)).select("version", "act", "is_active")


@query("D4_reconcile_provisions", "select l_orderkey as act, l_linenumber || '.' || l_partkey || '.' || l_suppkey as key, case when l_partkey % 3 = 0 then 'CREATED' when l_partkey % 3 = 1 and l_partkey % 4 = 0 then 'ABSENT' when l_partkey % 5 = 0 then 'CONFLICT' else 'REUSED' end as status from lineitem")
def _(s, d):
    k = C("l_partkey")
    x = t(s, d, "lineitem").select(C("l_orderkey").alias("act"), F.concat_ws(".", "l_linenumber", "l_partkey", "l_suppkey").alias("key"), F.lit("A").alias("element_type"), C("l_returnflag").alias("label"), "l_partkey")
    new = x.filter(~((k % 3 == 1) & (k % 4 == 0)))
    known = x.filter(k % 3 != 0).withColumn("label", F.when(k % 5 == 0, "other").otherwise(C("label")))
    return corpus.reconcile_provisions(new, known)


@query("D5_run_ledger", """with l as (select user_id, arg_max(event_type, epoch_us(ts)::hugeint * 100000 + event_id) as last from events where user_id % 4 <> 1 group by 1), w as (select distinct user_id from events)
select user_id as source_id, case when last is null then 'CREATED' when last = 'purchase' then 'ALREADY_PARSED' when last = 'click' then 'IN_PROGRESS' else 'RETRY' end as outcome from w left join l using (user_id)""")
def _(s, d):
    e = t(s, d, "events")
    st = F.when(C("event_type") == "purchase", "COMPLETED").when(C("event_type") == "click", "RUNNING").otherwise("FAILED")
    r = e.filter("user_id % 4 != 1").select(C("user_id").alias("source_id"), F.lit("p").alias("parser"), st.alias("status"), C("ts").alias("started_at"), C("event_id").alias("run_id"))
    return corpus.run_ledger(r, e.select(C("user_id").alias("source_id"), F.lit("p").alias("parser")).distinct()).select("source_id", "outcome")


@query("D6_reproject", sql(structures.LAWS, structures.LAW_ROWS, "select doc_id, document_order, stable_key, parent_key, provision_type, number_label, text, status, pos_start, pos_end, anchor from law_rows where doc_id % 11 <> 0"))
def _(s, d):
    """Provisions of whole laws from their stored bytes."""
    return law.reproject(structures.law_snapshots(s, d)).provisions.drop("version", "content_hash")


@query("D6_units", sql(structures.LAWS, structures.LAW_ROWS, "select doc_id, stable_key as unit_key, sha256(text) as content_hash from law_rows where doc_id % 11 <> 0 and text is not null"))
def _(s, d):
    return law.reproject(structures.law_snapshots(s, d)).units.select("doc_id", "unit_key", "content_hash")


@query("D6_rejects", sql(structures.LAWS, "select doc_id, 'STRUCTURE' as stage, pos, reason from law_rejects where doc_id % 11 <> 0 union all select distinct doc_id, 'DECODE', -1, 'UnicodeDecodeError' from lines where doc_id % 11 = 0"))
def _(s, d):
    return law.reproject(structures.law_snapshots(s, d)).rejected.select("doc_id", "stage", "pos", "reason")


@query("D6_reparse_difference", sql(structures.LAWS, structures.LAW_ROWS, "select doc_id, document_order, stable_key, case when document_order % 9 = 4 then 'NEW' else 'MISSING_NOW' end as change, 1::bigint as n from law_rows where doc_id % 11 <> 0 and document_order % 9 in (4, 7) union all select doc_id, document_order, stable_key, 'NEW', 1 from law_rows where doc_id % 11 <> 0 and document_order % 9 = 7"))
def _(s, d):
    """A stored table that lacks some rows and holds others in an older form, against what its bytes give now."""
    now = law.reproject(structures.law_snapshots(s, d)).provisions
    stored = now.filter("document_order % 9 != 4").withColumn("number_label", F.when(C("document_order") % 9 == 7, "old").otherwise(C("number_label")))
    return law.reparse_difference(stored, now).select("doc_id", "document_order", "stable_key", "change", "n")


# --- audits ---


@query("J1_corpus_audit", """with v as (select distinct lang as version from documents), c as (select unnest(['snapshot_hash', 'snapshot_length', 'unique_keys', 'unique_orders', 'contiguous_order', 'provision_hashes', 'no_self_parent', 'unique_units', 'unit_hashes', 'unit_text', 'known_parents', 'known_links']) as "check")
select version, "check", case when "check" = 'snapshot_length' and version = 'de' then false when "check" = 'known_parents' and version = 'fr' then false when "check" = 'unique_orders' then (select count(distinct n_chars) = count(*) from documents where lang = version) when "check" = 'contiguous_order' then (select max(n_chars) - min(n_chars) + 1 = count(*) from documents where lang = version) else true end as ok from v, c""")
def _(s, d):
    x = t(s, d, "documents").withColumnRenamed("lang", "version")
    raw = C("text").cast("binary")
    snap = x.select("version", raw.alias("raw_bytes"), F.sha2(raw, 256).alias("sha256"), (F.octet_length(raw) + (C("version") == "de").cast("int")).alias("byte_length"))
    key = C("doc_id").cast("string")
    p = x.select("version", key.alias("key"), F.when(C("version") == "fr", "lost").alias("parent_key"), C("n_chars").alias("document_order"), "text", F.sha2("text", 256).alias("content_hash"))
    u = p.select("version", C("key").alias("unit_key"), "text", "content_hash")
    return audit.corpus_audit(snap, p, u, p.select("version", C("key").alias("unit_key"), C("key").alias("stable_key")))


@query("J2_trace_unit", """select o_orderkey as unit_key, (select 'k' || arg_min(l_partkey, l_linenumber * 10000000 + l_partkey) from lineitem where l_orderkey = o_orderkey) as key, c_name, n_name from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where exists (select 1 from lineitem where l_orderkey = o_orderkey)""")
def _(s, d):
    o = t(s, d, "orders").join(t(s, d, "customer"), C("o_custkey") == C("c_custkey"))
    u = o.select(C("o_custkey").alias("version"), C("o_orderkey").alias("unit_key"))
    li = t(s, d, "lineitem").join(o.select(C("o_orderkey").alias("l_orderkey"), C("o_custkey").alias("version")), "l_orderkey")
    ln = li.select("version", C("l_orderkey").alias("unit_key"), F.struct("l_linenumber", "l_partkey").alias("position"), F.concat(F.lit("k"), "l_partkey").alias("stable_key"))
    p = ln.select("version", C("stable_key").alias("key")).distinct().withColumn("document_order", F.lit(1))
    v = t(s, d, "customer").select(C("c_custkey").alias("version"), "c_name", C("c_nationkey").alias("snapshot_id"))
    return audit.trace_unit(u, ln, p, v, t(s, d, "nation").select(C("n_nationkey").alias("snapshot_id"), "n_name")).select("unit_key", "key", "c_name", "n_name")


@query("J3_constraint_report", """select 'quantity' as rule, 'CHECK' as kind, count(*) filter (not l_quantity <= 45) as violations from lineitem union all select 'flag', 'CHECK', count(*) filter (l_returnflag not in ('A', 'R')) from lineitem
union all select 'line', 'UNIQUE', count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1) union all select 'part', 'FOREIGN', count(*) filter (l_partkey not in (select p_partkey from part where p_partkey % 10 <> 3)) from lineitem""")
def _(s, d):
    li = t(s, d, "lineitem")
    return audit.constraint_report(li, {"quantity": "l_quantity <= 45", "flag": "l_returnflag in ('A', 'R')"}, {"line": ["l_orderkey", "l_linenumber"]}, {"part": (["l_partkey"], t(s, d, "part").filter("p_partkey % 10 != 3"), ["p_partkey"])})


@query("J1_version_audit", """with v as (select o_orderkey as version, o_orderkey % 10 <> 3 as hash_ok from orders), l as (select *, l_orderkey as version, l_linenumber || '-' || l_partkey as unit_key from lineitem),
p as (select version, count(*) as stored, count(*) filter (l_partkey % 50 = 0) as misplaced, count(*) filter (l_partkey % 30 <> 2) as parsed, count(*) filter (l_partkey % 45 <> 4) as projected, count(*) filter (l_suppkey % 9 <> 5) as covered, count(*) filter (l_partkey % 60 = 7 and l_partkey % 40 <> 1) as crossed from l group by 1),
k as (select version, count(*) as loose from (select distinct version, unit_key from l where unit_key not in (select unit_key from l m where m.version = l.version and m.l_partkey % 40 <> 1)) group by 1),
x as (select * from v left join p using (version) left join k using (version)),
c as (select unnest(['version_hash', 'source_locators', 'all_units_linked', 'links_same_version', 'coverage', 'materialized_provisions', 'materialized_units']) as "check")
select version, "check", case "check" when 'version_hash' then hash_ok when 'source_locators' then coalesce(misplaced, 0) = 0 when 'all_units_linked' then coalesce(loose, 0) = 0 when 'links_same_version' then coalesce(crossed, 0) = 0 when 'coverage' then coalesce(covered, 0) = coalesce(stored, 0) when 'materialized_provisions' then coalesce(parsed, 0) = coalesce(stored, 0) else coalesce(projected, 0) = coalesce(stored, 0) end as ok from x, c""")
def _(s, d):
    """Orders as versions, their line items as provisions, units, links and lines, some of which were not derived again."""
    k = C("o_orderkey")
    identity = F.concat(F.lit("act|"), C("o_custkey").cast("string"), F.lit("|"), k.cast("string"))
    v = t(s, d, "orders").select(k.alias("version"), identity.alias("identity"), F.when(k % 10 == 3, "other").otherwise(F.sha2(identity, 256)).alias("version_hash"))
    li = t(s, d, "lineitem").select(C("l_orderkey").alias("version"), F.concat_ws("-", C("l_linenumber").cast("string"), C("l_partkey").cast("string")).alias("unit_key"), C("l_partkey").alias("k"), C("l_suppkey").alias("u"), C("l_linenumber").alias("pos_start"))
    p = li.withColumn("pos_end", C("pos_start") + C("k") % 50 - F.when(C("k") % 50 == 0, 1).otherwise(0))
    links = li.filter("k % 40 <> 1").withColumn("provision_version", C("version") + (C("k") % 60 == 7).cast("int"))
    return audit.version_audit(v, p, li, links, li, li.filter("u % 9 <> 5"), li.filter("k % 30 <> 2"), li.filter("k % 45 <> 4"))


KEPT = {
    "sources": ("nation", "n_nationkey as id, concat('A', n_regionkey) as authority_code, concat('u', n_nationkey % 20) as official_url, n_name as name"),
    "source_snapshots": ("documents", "doc_id as id, doc_id % 30 as source_id, case when doc_id % 50 = 7 then upper(sha2(text, 256)) else sha2(text, 256) end as sha256, encode(text, 'UTF-8') as raw_bytes, octet_length(text) + cast(doc_id % 41 = 3 as int) as byte_length, case when doc_id % 67 = 4 then 'changed' else 'text/html' end as content_type"),
    "legal_acts": ("customer", "c_custkey as id, concat('act', c_custkey div 2 * 2) as act_code, 'j' as jurisdiction, c_mktsegment as act_type, cast(c_custkey as string) as number, c_nationkey as year, case when c_custkey % 3 = 0 then null else c_name end as title"),
    "act_versions": ("orders", "o_orderkey as id, o_custkey as legal_act_id, o_orderkey % 500 as source_snapshot_id, 'p' as parser_name, '1' as parser_version, o_orderstatus as projection_name, '1' as projection_version, concat(sha2(cast(o_orderkey % 700 as string), 256), case when o_orderkey % 9 = 0 then '0' else '' end) as version_hash"),
    "provisions": ("lineitem", "l_orderkey * 10 + l_linenumber as id, l_orderkey as act_version_id, concat('p', l_partkey) as stable_key, element_at(array('DOCUMENT_ROOT', 'CHAPTER', 'ARTICLE', 'CAPUT', 'PARAGRAPH', 'INCISO', 'OTHER'), cast(l_linenumber as int)) as provision_type, case when l_linenumber > 1 then l_orderkey * 10 + l_linenumber - cast(l_partkey % 5 > 0 as int) end as parent_id, l_linenumber - cast(l_partkey % 97 = 0 as int) as document_order, l_linenumber as paragraph_start, l_linenumber + l_partkey % 7 - 1 as paragraph_end, sha2(l_returnflag, 256) as content_hash, case when l_returnflag = 'A' then 'IN_FORCE' when l_returnflag = 'N' then 'VETOED' else 'LOST' end as legal_status"),
    "search_units": ("orders", "o_orderkey as id, o_orderkey - o_orderkey % 2 as act_version_id, o_orderstatus as unit_key, case when o_orderkey % 31 = 0 then '  ' else o_orderpriority end as search_text, sha2(o_orderpriority, 256) as content_hash"),
    "search_unit_provisions": ("lineitem", "l_orderkey as search_unit_id, l_orderkey * 10 + l_linenumber as provision_id, l_linenumber - 2 as position"),
}


def kept(s, d) -> dict[str, DataFrame]:
    """The given tables as the seven corpus tables, with rows that break rules."""
    return {name: s.sql(f"select {e} from {{rows}}", rows=t(s, d, base)) for name, (base, e) in KEPT.items()}


def kept_sql(e: str) -> str:
    """The same expressions for DuckDB."""
    e = re.sub(r"sha2\(((?:[^()]|\([^()]*\))*), 256\)", r"sha256(\1)", e)
    return e.replace(" as string)", " as varchar)").replace(" div ", " // ").replace("encode(text, 'UTF-8')", "encode(text)").replace("octet_length(text)", "octet_length(encode(text))").replace("element_at(array(", "list_extract(list_value(")


def _rule(table: str, rule: str, kind: str, count: str) -> str:
    return f"select '{table}' as \"table\", '{rule}' as rule, '{kind}' as kind, ({count}) as violations"


HEX_SQL = "regexp_full_match({}, '[0-9a-f]{{64}}')"
RULES_SQL = [
    *(_rule(n, c, "NOT_NULL", f"select count(*) from {n} where {c} is null") for n, r in rules.CATALOGUE.items() for c in (*r.key, *r.required)),
    *(_rule(n, k, "PRIMARY" if k == f"pk_{n}" else "UNIQUE", f"select count(*) from (select 1 from {n} where {' and '.join(f'{c} is not null' for c in cs)} group by {', '.join(cs)} having count(*) > 1)") for n, r in rules.CATALOGUE.items() for k, cs in {f"pk_{n}": r.key, **r.unique}.items()),
    *(_rule(n, k, "CHECK", f"select count(*) from {n} where not ({e})") for n, k, e in (
        ("source_snapshots", "ck_source_snapshots_sha256_hex", HEX_SQL.format("sha256")), ("source_snapshots", "ck_source_snapshots_byte_length", "byte_length = octet_length(raw_bytes)"),
        ("legal_acts", "ck_legal_acts_year_positive", "year >= 1"), ("act_versions", "ck_act_versions_hash_hex", HEX_SQL.format("version_hash")),
        ("provisions", "ck_provisions_type", "provision_type <> 'OTHER'"), ("provisions", "ck_provisions_status", "legal_status <> 'LOST'"), ("provisions", "ck_provisions_order_positive", "document_order > 0"),
        ("provisions", "ck_provisions_content_hash_hex", "true"), ("provisions", "ck_provisions_source_locator", "paragraph_start <= paragraph_end"), ("provisions", "ck_provisions_no_self_parent", "parent_id <> id"),
        ("search_units", "ck_search_units_text_nonempty", "trim(search_text) <> ''"), ("search_units", "ck_search_units_content_hash_hex", "true"), ("search_unit_provisions", "ck_search_unit_provisions_position", "position >= 0"),
    )),
    *(_rule(n, k, "FOREIGN", f"select count(*) from {n} x where {' and '.join(f'x.{c} is not null' for c in cs)} and not exists (select 1 from {o} y where {' and '.join(f'x.{c} = y.{v}' for c, v in zip(cs, vs, strict=True))})") for n, r in rules.CATALOGUE.items() for k, (cs, o, vs) in r.foreign.items()),
    _rule("source_snapshots", "trg_source_snapshots_immutable", "IMMUTABLE", "select count(distinct doc_id) from documents where doc_id % 61 = 5 or doc_id % 67 = 4"),
    _rule("search_unit_provisions", "trg_search_unit_provision_same_version", "SAME_VERSION", "select count(*) from search_unit_provisions l left join (select distinct id, act_version_id from search_units) u on u.id = l.search_unit_id left join (select distinct id, act_version_id from provisions) p on p.id = l.provision_id where u.act_version_id is distinct from p.act_version_id"),
]


@query("J3_rule_catalogue", sql(*(f"{n} as (select {kept_sql(e)} from {base}{' where doc_id % 61 <> 5' if n == 'source_snapshots' else ''})" for n, (base, e) in KEPT.items()), " union all ".join(RULES_SQL)))
def _(s, d):
    """All rules of the corpus tables; since the earlier state some snapshots are gone and some have another content type."""
    tables = kept(s, d)
    before = {"source_snapshots": tables["source_snapshots"].withColumn("content_type", F.lit("text/html"))}
    tables["source_snapshots"] = tables["source_snapshots"].filter("id % 61 != 5")
    return rules.catalogue_report(tables, before)


# --- streams ---


def _stream(s, d) -> DataFrame:
    path = scratch(s)
    snapshots(s, d).select("source_id", "sha256", C("acquired_at").cast("timestamp").alias("acquired_at"), "snapshot_id").write.parquet(path)
    return s.readStream.schema(s.read.parquet(path).schema).option("maxFilesPerTrigger", 4).parquet(path)


@query("K1_stream_store", sql(SNAP, "select source_id, sha256 from snap group by all"))
def _(s, d):
    """Captures streamed into a table without repeats."""
    path = scratch(s)
    stream.stream_store(_stream(s, d), f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return s.read.parquet(f"{path}/table").select("source_id", "sha256")


@query("K1_stream_snapshots")
def _(s, d):
    path = scratch(s)
    w = stream.stream_snapshots(_stream(s, d), "3650 days").writeStream.format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    w.awaitTermination()
    return s.read.parquet(f"{path}/table").select("source_id", "sha256")


@query("K2_stream_materialize", sql(structures.LINES, structures.CLASSED, structures.CARRIED, "select doc_id, document_order, stable_key, parent_key, text from flat"))
def _(s, d):
    """Lines in three batches that split every document; the table as it is after the last."""
    path = scratch(s)
    structures.lines(s, d).repartition(6).write.parquet(f"{path}/lines")
    src = s.readStream.schema(s.read.parquet(f"{path}/lines").schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/lines")
    stream.stream_materialize(src, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return stream.materialized(s, f"{path}/table").select("doc_id", "document_order", "stable_key", "parent_key", "text")
