"""Queries of evidence, verification and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators import evaluate, evidence, verify
from evidentia.plans.inputs import CASES, ORDER_CANDS, PROVISIONS, cases, order_cands, provisions, sql, t, terms_sql
from evidentia.plans.register import query

C = F.col

CHILDREN = """kidsn as (select * from (select *, row_number() over (partition by version, parent_key order by document_order, key)::int as child_no from provisions where parent_key is not null and regexp_matches(text, '\\S')) where child_no <= 8)"""
ASSEMBLED = """own as (select question_id, key, rank, 0 as child_no from cands union all select c.question_id, k.key, c.rank, k.child_no from cands c join kidsn k on k.version = c.version and k.parent_key = c.key),
place as (select question_id, key, min(rank * 1000 + child_no) as p from own group by all),
assembled as (select question_id, key, pos as position, p % 1000 as child_no from (select *, row_number() over (partition by question_id order by p, key)::int as pos from place) where pos <= 24)"""


@query("G1_assemble_evidence", sql(PROVISIONS, ORDER_CANDS, CHILDREN, ASSEMBLED, "select question_id, key, position, child_no::int as child_no from assembled"))
def g1(s, d) -> DataFrame:
    return evidence.assemble_evidence(order_cands(s, d), provisions(s, d))


@query("G2_direct_children", sql(PROVISIONS, CHILDREN, "select version, parent_key, key, child_no from kidsn"))
def _(s, d):
    p = provisions(s, d)
    return evidence.direct_children(p, p.filter("parent_key is null")).select("version", "parent_key", "key", "child_no")


@query("G3_materialize_keys", sql(PROVISIONS, ORDER_CANDS, "select c.question_id, version, key, document_order, text from cands c join provisions using (version, key)"))
def _(s, d):
    return evidence.materialize_keys(order_cands(s, d), provisions(s, d)).select("question_id", "version", "key", "document_order", "text")


@query("G4_missing_keys", sql(ORDER_CANDS, "select question_id, key from cands where substr(key, 2)::bigint % 7 = 0"))
def _(s, d):
    return evidence.missing_keys(order_cands(s, d), provisions(s, d).filter("parent_key is not null or document_order % 7 != 0")).select("question_id", "key")


@query("G5_freeze_evidence", "select conv_id as question_id, turn as id, printf('EV%03d', turn + 1) as code from conversations where turn % 3 <> 1")
def _(s, d):
    x = t(s, d, "conversations").select(C("conv_id").alias("question_id"), F.struct("conv_id", "turn").alias("id"), "turn", "text", (C("turn") + 1).alias("position"))
    st = x.select("id", F.when(C("turn") % 3 == 1, F.concat("text", F.lit("x"))).otherwise(C("text")).alias("text")).dropDuplicates(["id"])
    return evidence.freeze_evidence(x, st).select("question_id", C("turn").alias("id"), "code")


def turns(s, d) -> DataFrame:
    """Assistant turns as questions, the user turns of their conversation as candidates."""
    c = t(s, d, "conversations")
    first = c.filter("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question")).withColumn("question", F.when(C("conv_id") % 6 == 0, "").otherwise(C("question")))
    w = Window.partitionBy("conv_id").orderBy("turn")
    u = c.filter("role = 'user'").withColumn("position", F.row_number().over(w) - 1)
    return u.join(first, "conv_id").select(C("conv_id").alias("question_id"), C("turn").alias("id"), C("turn").alias("provision"), "position", "question", "text", F.when(C("turn") % 4 == 0, "parent clause text").alias("parent_text"))


def _set(c: str) -> str:
    return f"list_distinct({terms_sql(c)})"


TURNS = f"""first as (select conv_id, case when conv_id % 6 = 0 then '' else arg_min(text, turn) end as question from conversations where role = 'assistant' group by 1),
u0 as (select conv_id as question_id, turn as id, row_number() over (partition by conv_id order by turn) - 1 as position, question, text, case when turn % 4 = 0 then 'parent clause text' end as parent_text from conversations join first using (conv_id) where role = 'user'),
u1 as (select *, {_set('question')} as q, list_distinct(list_concat({_set('text')}, {_set("coalesce(parent_text, '')")})) as tk from u0),
u2 as (select *, list_filter(q, lambda a: list_contains(tk, a)) as shared from u1),
rel as (select *, len(shared) >= case when len(q) <= 3 then 1 else greatest(1, floor((max(len(shared)) over (partition by question_id) + 1) / 2)) end as eligible,
 case when len(q) > 0 then 0.65::double * len(shared) / len(q) else 0 end + 0.20::double / (position + 1) + case when parent_text is not null then 0.15::double else 0 end as base from u2)"""


@query("G6_select_evidence", sql(TURNS, "p1 as (select question_id, id from (select question_id, id, row_number() over (partition by question_id order by round(base, 9) desc, position) as r from rel where eligible) where r = 1)", """select question_id, 1 as pick, r.id, round(base, 6) as base from rel r join p1 using (question_id) where r.id = p1.id"""))
def _(s, d):
    return evidence.select_evidence(turns(s, d), 1).select("question_id", "pick", "id", "base")


JACCARD = "(case when len(list_distinct(list_concat({a}, {b}))) = 0 then 0 else len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b}))) end)"
FINAL = "0.45::double * base + 0.40::double * m + 0.15::double * (1.0::double - red)"
PICKS = f"""p1 as (select *, 0::double as m, 0::double as red, base as f from rel where eligible qualify row_number() over (partition by question_id order by base desc, position) = 1),
s2 as (select r.*, len(list_filter(r.shared, lambda a: not list_contains(p1.shared, a)))::double / len(r.q) as m, {JACCARD.format(a='r.tk', b='p1.tk')} as red from rel r join p1 using (question_id) where r.eligible and r.id <> p1.id),
p2 as (select *, {FINAL} as f from s2 where not (m = 0 and (base < 0.30::double or red >= 0.85::double)) qualify row_number() over (partition by question_id order by {FINAL} desc, position) = 1),
s3 as (select r.*, len(list_filter(r.shared, lambda a: not list_contains(p1.shared, a) and not list_contains(p2.shared, a)))::double / len(r.q) as m, greatest({JACCARD.format(a='r.tk', b='p1.tk')}, {JACCARD.format(a='r.tk', b='p2.tk')}) as red from rel r join p1 using (question_id) join p2 using (question_id) where r.eligible and r.id <> p1.id and r.id <> p2.id),
p3 as (select *, {FINAL} as f from s3 where not (m = 0 and (base < 0.30::double or red >= 0.85::double)) qualify row_number() over (partition by question_id order by {FINAL} desc, position) = 1)"""


@query("G6_select_evidence_greedy", sql(TURNS, PICKS, "select question_id, pick::int as pick, id, round(base, 6) as base, round(m, 6) as marginal, round(red, 6) as redundancy, round(f, 6) as final from (select 1 as pick, question_id, id, base, m, red, f from p1 union all select 2, question_id, id, base, m, red, f from p2 union all select 3, question_id, id, base, m, red, f from p3)"))
def _(s, d):
    return evidence.select_evidence(turns(s, d), 3)


@query("G7_selection_fallbacks", sql(TURNS, "f as (select *, max(eligible::int) over (partition by question_id) as an, row_number() over (partition by question_id order by position)::int as no from rel)", "select question_id, id, case when len(q) = 0 then 'NO_QUESTION' else 'NONE_ELIGIBLE' end as reason, no as pick from f where (len(q) = 0 and no <= 3) or (len(q) > 0 and an = 0 and no = 1)"))
def _(s, d):
    return evidence.selection_fallbacks(turns(s, d))


@query("G8_sufficiency", """with g as (select doc_id % 500 as question_id, count(*) as n, max(case when doc_id % 3 <> 0 then n_chars % 40 / 100.0 end)::double as l, max(case when doc_id % 4 <> 0 then n_chars % 80 / 100.0 end)::double as v, count(*) filter (doc_id % 3 <> 0 and doc_id % 4 <> 0) as ag, max((n_chars % 9 = 0)::int) as an from documents where doc_id % 500 % 7 <> 1 group by 1),
q as (select distinct doc_id % 500 as question_id from documents)
select question_id, case when r is null then 'SUFFICIENT' else 'INSUFFICIENT' end as status, r as reason, l as max_lexical, v as max_vector, coalesce(ag, 0) as agreement from (select *, case when question_id % 25 = 7 then 'OUT_OF_SCOPE' when n is null then 'NO_CANDIDATES' when coalesce(l, 0) < 0.15 and coalesce(v, 0) < 0.60 and coalesce(an, 0) = 0 then 'WEAK_MATCH' end as r from q left join g using (question_id))""")
def _(s, d):
    x = t(s, d, "documents").withColumn("question_id", C("doc_id") % 500)
    q = x.select("question_id").distinct().withColumn("question", F.when(C("question_id") % 25 == 7, "a tax penalty").otherwise("ordinary"))
    c = x.filter("question_id % 7 != 1").select("question_id", F.when(C("doc_id") % 3 != 0, (C("n_chars") % 40) / 100.0).alias("lexical_score"), F.when(C("doc_id") % 4 != 0, (C("n_chars") % 80) / 100.0).alias("vector_score"), (C("n_chars") % 9 == 0).alias("anchored"))
    return evidence.sufficiency(q, c, [r"\btax\b"])


CORE = """core as (select question_id, case when bool_and(coverage is not null) then arg_min(id, -(coverage * 1e6)::bigint * 1000::hugeint + position) end as core_id from (select conv_id as question_id, turn as id, row_number() over (partition by conv_id order by turn) as position, case when conv_id % 9 <> 2 then len(text) % 10 / 10.0 end as coverage from conversations) group by 1)"""


def core_items(s, d) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t(s, d, "conversations").select(C("conv_id").alias("question_id"), F.format_string("EV%03d", C("turn").cast("int")).alias("code"), F.row_number().over(w).alias("position"), F.when(C("conv_id") % 9 != 2, (F.length("text") % 10) / 10.0).alias("coverage"), F.lit(0.5).alias("marginal"), F.lit(0.5).alias("base"), "text")


@query("G9_core_evidence", sql(CORE, "select question_id, case when core_id is not null then printf('EV%03d', core_id) end as core_code from core"))
def _(s, d):
    return evidence.core_evidence(core_items(s, d))


@query("G10_extractive_answer", sql(CORE, "select question_id, case when text is null then 'ABSTAIN' else 'ANSWER' end as decision, text as claim, case when text is null then '' else printf('EV%03d', core_id) end as citations from core left join conversations on conv_id = question_id and turn = core_id"))
def _(s, d):
    i = core_items(s, d)
    return evidence.extractive_answer(evidence.core_evidence(i), i).withColumn("citations", F.array_join("citations", ","))


@query("G11_route_mode", "select doc_id, case lang when 'en' then 'LEGAL_RULE' when 'fr' then 'CASE_APPLICATION' when 'de' then 'OTHER' end as mode, case lang when 'fr' then 'CLARIFY' when 'es' then 'REJECT' end as decision, lang = 'en' as retrieve from documents")
def _(s, d):
    m = s.createDataFrame([("en", "LEGAL_RULE"), ("fr", "CASE_APPLICATION"), ("de", "OTHER")], "category string, mode string")
    return evidence.route_mode(t(s, d, "documents").select("doc_id", C("lang").alias("category")), m).select("doc_id", "mode", "decision", "retrieve")


@query("G12_abstain_when_empty", "select o_custkey as question_id, 'ABSTAIN' as decision, false as executed from orders group by 1 having max(o_totalprice) <= 400000")
def _(s, d):
    o = t(s, d, "orders").select(C("o_custkey").alias("question_id"), "o_totalprice")
    return evidence.abstain_when_empty(o.select("question_id").distinct(), o.filter("o_totalprice > 400000"))


@query("G13_consult_batch", """with a as (select user_id as question_id, event_id as attempt, case when event_id % 5 = 0 then 'retrieval' when event_id % 7 = 1 then 'selection' when event_id % 3 = 2 then 'attribution' when event_id % 2 = 1 then 'citation' when event_id % 11 = 4 then 'semantic' end as failed_stage from events)
select question_id, count(*) as attempts, arg_min(attempt, (failed_stage is not null)::bigint * 1000000000 + attempt) as attempt, case when bool_or(failed_stage is null) then null else arg_min(failed_stage, attempt) end as failed_stage, case when bool_or(failed_stage is null) then 'ANSWER' else 'ABSTAIN' end as decision from a group by 1""")
def _(s, d):
    e = C("event_id")
    stages = {"retrieval": e % 5 != 0, "selection": e % 7 != 1, "sufficiency": F.lit(True), "attribution": e % 3 != 2, "locator": F.lit(True), "citation": e % 2 != 1, "polarity": F.lit(True), "semantic": e % 11 != 4}
    return evidence.consult_batch(t(s, d, "events").select(C("user_id").alias("question_id"), e.alias("attempt"), *(x.alias(k) for k, x in stages.items())))


@query("G14_persist_citations", "select question_id, sha256(string_agg(claim || ' [' || codes || ']', chr(10) order by claim_no)) as answer_sha256 from (select conv_id as question_id, turn as claim_no, text as claim, 'EV' || turn || ', EV' || (turn + 1) as codes from conversations where role = 'assistant') group by 1")
def _(s, d):
    c = t(s, d, "conversations").filter("role = 'assistant'").select(C("conv_id").alias("question_id"), C("turn").alias("claim_no"), C("text").alias("claim"), F.array(F.concat(F.lit("EV"), "turn"), F.concat(F.lit("EV"), C("turn") + 1)).alias("codes"))
    return evidence.persist_citations(c)[1].select("question_id", "answer_sha256")


# --- verification ---

DEFECTS = """case doc_id % 12 when 0 then '{"decision": "ANSWER"' when 1 then '[1]' when 2 then '{"decision": "ANSWER", "answer": "x", "citations": ["a"], "more": 1}' when 3 then '{"decision": "ANSWER", "answer": 5, "citations": ["a"]}' when 4 then '{"decision": "MAYBE", "answer": "x", "citations": []}' when 5 then '{"decision": "ANSWER", "answer": "  ", "citations": ["a"]}' when 6 then '{"decision": "ABSTAIN", "answer": "x", "citations": ["a"]}' when 7 then '{"decision": "ANSWER", "answer": "x", "citations": []}' when 8 then '{"decision": "ANSWER", "answer": "x", "citations": ["a", "a"]}' when 9 then '{"decision": "ABSTAIN", "answer": "x", "citations": []} tail' when 10 then '{"decision": "CLARIFY", "answer": "x", "citations": []}' else '{"decision": "ANSWER", "answer": "x", "citations": ["a", "b"]}' end"""


@query("H1_parse_answers", "select doc_id, (['INVALID_JSON', 'NOT_OBJECT', 'BAD_FIELDS', 'BAD_TYPES', 'BAD_DECISION', 'BLANK_ANSWER', 'CITATIONS_WITHOUT_ANSWER', 'ANSWER_WITHOUT_CITATIONS', 'DUPLICATE_CITATION', 'INVALID_JSON', null, null])[doc_id % 12 + 1] as error from documents")
def _(s, d):
    return verify.parse_answers(t(s, d, "documents").select("doc_id", F.expr(DEFECTS).alias("raw_response"))).select("doc_id", "error")


@query("H2_validate_citations", """with o as (select o_orderkey as question_id, o_custkey from orders), c as (select l_orderkey as question_id, l_partkey % 1000 as key, bool_or(l_quantity > 20) as inside from lineitem group by all),
s as (select question_id, list(key::varchar order by key::varchar) filter (key % 50 = 7) as unknown, list(key::varchar order by key::varchar) filter (key % 50 <> 7 and not inside) as outside from c group by 1)
select question_id, case when unknown is not null then 'INVALID_CITATION' when outside is not null then 'OUT_OF_EVIDENCE' else 'VALID' end as status, coalesce(array_to_string(coalesce(unknown, outside), ','), '') as keys from s""")
def _(s, d):
    li = t(s, d, "lineitem").select(C("l_orderkey").alias("question_id"), (C("l_partkey") % 1000).alias("k"), C("l_quantity"))
    a = li.groupBy("question_id").agg(F.collect_set(C("k").cast("string")).alias("citations"))
    keys = li.filter("k % 50 != 7").select(C("k").cast("string").alias("key"))
    ev = li.filter("l_quantity > 20").select("question_id", C("k").cast("string").alias("key"))
    return verify.validate_citations(a, ev, keys).withColumn("keys", F.array_join("keys", ","))


@query("H3_ambiguous_citations", "select l_orderkey, l_linenumber, 'p' || l_partkey as key from lineitem where l_partkey % 5 = 0 and l_partkey < 1000 and l_partkey >= 10")
def _(s, d):
    li = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("p"), "l_partkey").alias("key"), "l_partkey")
    return verify.ambiguous_citations(li, li.filter("l_partkey % 5 != 0"), r"^p\d{2,3}$").select("l_orderkey", "l_linenumber", "key")


@query("H4_split_clauses", r"""select o_orderkey, unnest(range(len(l)))::int as clause_no, unnest(l) as clause from (select o_orderkey, case o_orderkey % 4 when 0 then ['the rate is ' || lower(o_orderstatus), 'the sum was paid'] when 1 then ['the order is open and late'] when 2 then ['it must stay; unless it was sold'] else ['buyers can pay', 'and sellers may wait'] end as l from orders)""")
def _(s, d):
    k = C("o_orderkey") % 4
    claim = F.when(k == 0, F.concat(F.lit("the rate is "), F.lower("o_orderstatus"), F.lit("; the sum was paid"))).when(k == 1, "the order is open and late").when(k == 2, "it must stay; unless it was sold").otherwise("buyers can pay, and sellers may wait")
    return verify.split_clauses(t(s, d, "orders").select("o_orderkey", claim.alias("claim"))).select("o_orderkey", "clause_no", "clause")


CLAUSE_SPLITTERS = (r"\.\s*\n", r",\s+", r"\s+and\s+")


@query("H4_clause_offsets", sql("c as (select conv_id, turn, text, " + ", ".join(f"string_split_regex(text, '{p}') as p{i}, regexp_extract_all(text, '{p}') as d{i}" for i, p in enumerate(CLAUSE_SPLITTERS)) + " from conversations where role = 'assistant')",
    "t as (select *, " + ", ".join(f"list_filter(list_transform(range(1, len(p{i}) + 1), lambda k: {{'at': 1 + list_sum(list_transform(range(1, k), lambda j: length(p{i}[j]) + length(coalesce(d{i}[j], ''))))::bigint, 'raw': p{i}[k], 'clause': trim(p{i}[k], ' ,;' || chr(9) || chr(10))}}), lambda x: x.clause <> '') as s{i}" for i in range(3)) + " from c)",
    "u as (select *, regexp_matches(lower(text), '\\bwas\\b') as whole, " + ", ".join(f"len(s{i}) > 1 and len(list_filter(s{i}, lambda x: len(regexp_extract_all(x.clause, '\\p{{L}}+')) < 2 or not regexp_matches(lower(x.clause), '[a-z]{{4,}}'))) = 0 as ok{i}" for i in range(3)) + " from t)",
    "v as (select conv_id, turn, text, case when whole then null when ok0 then s0 when ok1 then s1 when ok2 then s2 end as s from u)",
    "w as (select conv_id, turn, unnest(range(len(s)))::int as clause_no, unnest(s) as x from v where s is not null)",
    "select conv_id, turn, clause_no, x.clause as clause, (coalesce(x.at, 1) + length(x.raw) - length(ltrim(x.raw, ' ,;' || chr(9) || chr(10))))::int as start, length(x.clause)::int as length, true as held from w union all select conv_id, turn, 0, trim(text, ' ' || chr(9) || chr(10)), 1 + length(text) - length(ltrim(text, ' ' || chr(9) || chr(10))), length(trim(text, ' ' || chr(9) || chr(10))), true from v where s is null"))
def _(s, d):
    """Whole answers in their clauses, with their places."""
    c = t(s, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", C("text").alias("claim"), C("text").alias("whole"))
    x = verify.split_clauses(c, r"[a-z]{4,}", CLAUSE_SPLITTERS, r"\bwas\b")
    return x.select("conv_id", "turn", "clause_no", "clause", "start", "length", (F.substr("whole", "start", "length") == C("clause")).alias("held"))


def clauses(s, d) -> tuple[DataFrame, DataFrame]:
    c = t(s, d, "conversations")
    cl = c.filter("role = 'assistant'").select(C("conv_id").alias("question_id"), C("turn").alias("claim_no"), F.lit(0).alias("clause_no"), C("text").alias("clause"))
    return cl, c.filter("role = 'user'").select(C("conv_id").alias("question_id"), F.format_string("EV%03d", C("turn").cast("int")).alias("code"), "text")


SCORES = f"""e0 as (select conv_id as question_id, printf('EV%03d', turn) as code, text from conversations where role = 'user'),
e1 as (select question_id, code, unnest({_set('text')}) as token from e0), n as (select question_id, count(*) as n_items from e0 group by 1), df as (select question_id, token, count(*) as df from e1 group by all),
c1 as (select conv_id as question_id, turn as claim_no, unnest({_set('text')}) as token from conversations where role = 'assistant'),
c2 as (select c1.*, ln((n_items + 1) / (coalesce(df, 0) + 1)) + 1 as w from c1 join n using (question_id) left join df using (question_id, token)),
tot as (select question_id, claim_no, sum(w) as total from c2 group by all),
scores as (select question_id, claim_no, code, round(sum(w) / max(total), 6) as score from c2 join e1 using (question_id, token) join tot using (question_id, claim_no) group by all),
ranked as (select *, row_number() over (partition by question_id, claim_no order by score desc, code) as r from scores),
tops as (select question_id, claim_no, max(score) filter (r = 1) as best, coalesce(max(score) filter (r = 2), 0) as second from ranked group by all)"""


@query("H5_clause_scores", sql(SCORES, "select question_id, claim_no, code, score from scores"))
def _(s, d):
    return verify.clause_scores(*clauses(s, d)).select("question_id", "claim_no", "code", "score")


@query("H5_attribute_claims", sql(SCORES, "select conv_id as question_id, turn as claim_no, best as best_score, case when best is null or best < 0.40 then 'NO_EVIDENCE' when best < 0.55 and best - second < 0.08 then 'AMBIGUOUS' end as reason from conversations left join tops on conv_id = question_id and turn = claim_no where role = 'assistant'"))
def _(s, d):
    return verify.attribute_claims(*clauses(s, d)).select("question_id", "claim_no", "best_score", "reason")


@query("H5_attribution_codes")
def _(s, d):
    return verify.attribute_claims(*clauses(s, d)).withColumn("codes", F.array_join("codes", ","))


PAIRS = [("the buyer must not sell goods", "the buyer may sell goods"), ("the buyer must sell goods", "selling goods is optional for the buyer"), ("the buyer may sell goods", "the buyer may sell goods unless closed"), ("the buyer may sell goods", "the buyer may sell goods"), ("the weather", "different things entirely"), ("buyer goods", "buyer goods may move")]
STATUS = ["CONTRADICTED", "CONTRADICTED", "UNRESOLVED", "CONSISTENT", "UNRESOLVED", "UNRESOLVED"]


@query("H6_polarity_check", f"select o_orderkey, ({STATUS})[o_orderkey % 6 + 1] as status, (['PROHIBITION_PERMISSION', 'OBLIGATION_OPTION', 'EXCEPTION_MISSING', 'SHARED_FLAG', 'NO_TARGET_OVERLAP', 'NO_POLARITY_RELATION'])[o_orderkey % 6 + 1] as reason, o_orderkey % 6 in (3, 5) as passes from orders")
def _(s, d):
    pick = lambda i: F.element_at(F.array(*(F.lit(p[i]) for p in PAIRS)), (C("o_orderkey") % 6 + 1).cast("int"))
    return verify.polarity_check(t(s, d, "orders").select("o_orderkey", pick(0).alias("claim"), pick(1).alias("evidence"))).select("o_orderkey", "status", "reason", "passes")


@query("H7_locator_check", "select o_orderkey, (o_orderkey % 4 <> 1 or o_orderkey % 3 = 0) as locator_ok from orders")
def _(s, d):
    n = (C("o_orderkey") % 9).cast("string")
    x = t(s, d, "orders").select("o_orderkey", F.concat(F.lit("see Article "), n).alias("claim"), (C("o_orderkey") % 3 == 0).alias("is_extract"), F.when(C("o_orderkey") % 4 != 1, F.array(n)).otherwise(F.array(F.lit("99"))).alias("cited_numbers"))
    return verify.locator_check(x).select("o_orderkey", "locator_ok")


PLACES = "case o_orderkey % 5 when 0 then 'sem lugar' when 1 then 'no art. ' || a when 2 then 'Art ' || a || 'º, inciso iv' when 3 then 'art. ' || a || ' § 2' else 'art. 77 e art. ' || a || ', inciso IV, alínea \"b\"' end"


@query("H7_locator_groups", sql("o as (select o_orderkey, o_custkey, o_orderkey % 4 + 1 as a, o_orderkey % 3 + 1 as b, o_orderkey % 7 = 3 as extract from orders)",
    "x as (select *, ['ARTICLE:' || b || '/PARAGRAPH:2'] || case when o_orderkey % 2 = 0 and not extract then ['ARTICLE:' || a || '/INCISO:IV/ALINEA:B'] else [] end as ids from o)",
    "select o_custkey as question_id, o_orderkey as claim_no, (case o_orderkey % 5 when 0 then 0 when 4 then 2 else 1 end)::int as places, extract or o_orderkey % 5 = 0 or len(list_filter(ids, lambda i: contains(i, 'ARTICLE:' || a) and (o_orderkey % 5 not in (2, 4) or contains(i, ':IV')) and (o_orderkey % 5 <> 3 or contains(i, ':2')) and (o_orderkey % 5 <> 4 or contains(i, 'ALINEA:B')))) > 0 as locator_ok from x"))
def _(s, d):
    o = t(s, d, "orders").withColumns({"a": (C("o_orderkey") % 4 + 1).cast("string"), "b": (C("o_orderkey") % 3 + 1).cast("string"), "extract": C("o_orderkey") % 7 == 3}).withColumn("claim", F.expr(PLACES))
    key = [C("o_custkey").alias("question_id"), C("o_orderkey").alias("claim_no")]
    first = o.select(*key, F.concat(F.lit("article:"), "b", F.lit("/PARAGRAPH:2")).alias("identity_key"), F.when(C("extract"), C("claim")).alias("snapshot_text"))
    second = o.filter("o_orderkey % 2 = 0 and not extract").select(*key, F.concat(F.lit("ARTICLE:"), "a", F.lit("/INCISO:IV/ALINEA:B")).alias("identity_key"), F.lit("other").alias("snapshot_text"))
    return verify.locator_groups(o.select(*key, "claim", F.lit("EBCG_V1").alias("mode")), first.union(second)).select("question_id", "claim_no", "places", "locator_ok")


@query("H8_citation_chain_check", """with c as (select conv_id as question_id, 'C' || (turn // 2) as claim_code, turn from conversations where role = 'assistant'), n as (select *, count(*) over (partition by question_id, claim_code) as n from c)
select distinct question_id, claim_code, null::varchar as code, 'DUPLICATE_CODE' as error from n where n > 1
union all select distinct question_id, claim_code, null, 'NO_CITATION' from n where turn % 5 = 1
union all select distinct question_id, claim_code, 'E' || turn, case when turn % 5 = 2 then 'UNKNOWN_CODE' else 'TEXT_DRIFT' end from n where turn % 5 in (2, 3)""")
def _(s, d):
    c = t(s, d, "conversations").filter("role = 'assistant'").dropDuplicates(["conv_id", "turn"])
    code = F.concat(F.lit("E"), "turn")
    cl = c.select(C("conv_id").alias("question_id"), F.concat(F.lit("C"), F.floor(C("turn") / 2).cast("string")).alias("claim_code"), C("text").alias("claim"), F.when(C("turn") % 5 == 1, F.array().cast("array<string>")).otherwise(F.array(code)).alias("codes"))
    i = c.filter("turn % 5 != 2").select(C("conv_id").alias("question_id"), code.alias("code"), C("text").alias("snapshot_text"), F.when(C("turn") % 5 == 3, "other").otherwise(C("text")).alias("stored_text"))
    return verify.citation_chain_check(cl, i)


@query("H8_answer_chain", """with a as (select c_custkey as q, c_custkey % 6 = 1 as abstain from customer),
o as (select o_custkey as q, o_orderkey as k, 'EV' || lpad(o_orderkey::varchar, 7, '0') as code, o_orderkey % 5 as r from orders where o_custkey % 11 <> 0),
live as (select o.* from o join a using (q) where not abstain)
select q as question_id, null::varchar as claim_code, null::varchar as code, 'CLAIMS_OF_ABSTAINED' as error from a where abstain and q in (select q from o)
union all select q, null, null, 'NO_CLAIMS' from a where not abstain and q not in (select q from o)
union all select q, null, 'EV' || lpad((q % 7 + 100)::varchar, 3, '0'), 'UNKNOWN_IN_ANSWER' from a where not abstain and q % 4 = 2
union all select q, 'C' || k, code, (['UNKNOWN_CODE', 'NOT_VALIDATED', 'CHAIN_MISSING', 'URL_DRIFT'])[r + 1] from live where r < 4
union all select q, 'C' || k, code, 'TEXT_DRIFT' from live where r = 3 and k % 2 = 0""")
def _(s, d):
    a = t(s, d, "customer").select(C("c_custkey").alias("question_id"), F.when(C("c_custkey") % 4 == 2, F.format_string("see EV%d, EV12 and xEV999", (C("c_custkey") % 7 + 100).cast("int"))).otherwise("plain").alias("answer"), (C("c_custkey") % 6 == 1).alias("abstain"))
    k, r = C("o_orderkey"), C("o_orderkey") % 5
    o = t(s, d, "orders").filter("o_custkey % 11 != 0").select(C("o_custkey").alias("question_id"), k, F.concat(F.lit("EV"), F.lpad(k.cast("string"), 7, "0")).alias("code"))
    claims = o.select("question_id", F.concat(F.lit("C"), k).alias("claim_code"), F.lit("a claim").alias("claim"), F.array("code").alias("codes"))
    items = o.filter(r != 0).select("question_id", "code", (r != 1).alias("validated"), F.lit("text").alias("snapshot_text"), F.when(r == 2, None).when((r == 3) & (k % 2 == 0), "other").otherwise("text").alias("stored_text"), F.lit("u").alias("source_url"), F.when(r == 3, "v").otherwise("u").alias("stored_url"))
    return verify.answer_chain_check(a, claims, items)


@query("H9_semantic_report", """with c as (select o_custkey as q, o_orderkey as k, o_custkey % 17 as f, o_orderkey % 6 as r from orders),
j as (select *, case when f = 3 and k % 2 = 0 then 'OMITTED_CLAIM' when f = 5 and k % 3 = 0 then 'FOREIGN_CODE' when f = 7 and k % 4 = 0 then 'BAD_DECISION' end as own, case when f = 9 then 'UNKNOWN_CLAIM' end as extra from c),
a as (select *, coalesce(max(extra) over (partition by q), min(own) filter (own <> 'OMITTED_CLAIM') over (partition by q), max(own) over (partition by q)) as reason from j)
select q as question_id, 'C' || k as claim_code, case when reason is null then case when r in (0, 1) then 'UNSUPPORTED' when r = 2 then 'PARTIALLY_SUPPORTED' when r = 3 then 'UNSUPPORTED' else 'SUPPORTED' end end as status, reason from a
union all select distinct q, 'C0', null, reason from a where f = 9""")
def _(s, d):
    o = t(s, d, "orders").select(C("o_custkey").alias("question_id"), F.concat(F.lit("C"), "o_orderkey").alias("claim_code"), C("o_orderkey").alias("k"), (C("o_custkey") % 17).alias("f"), (C("o_orderkey") % 6).alias("r"), F.concat(F.lit("E"), "o_orderkey").alias("code"))
    claims = o.select("question_id", "claim_code", F.lit("the seller delivers").alias("claim"), F.array("code").alias("codes"))
    evidence = o.select("question_id", "code", F.when(C("r") == 3, "nothing alike").otherwise("sellers wait").alias("text"))
    bad = (C("f") == 7) & (C("k") % 4 == 0)
    j = o.filter("not (f = 3 and k % 2 = 0)").select("question_id", "claim_code", F.when((C("f") == 5) & (C("k") % 3 == 0), F.array(F.lit("E0"))).otherwise(F.array("code")).alias("codes"), (C("r") != 0).alias("has_supported"), F.when(bad, None).otherwise(C("r") >= 3).alias("all_supported"), (C("r") == 1).alias("contradicted"))
    extra = o.filter("f = 9").select("question_id", F.lit("C0").alias("claim_code"), F.array().cast("array<string>").alias("codes"), F.lit(True), F.lit(True), F.lit(False)).distinct()
    return verify.semantic_report(claims, evidence, j.union(extra))


@query("H9_semantic_status", """with j as (select o_custkey as question_id, o_orderkey as claim_no, case when o_orderkey % 8 = 5 then 'MISSING' when o_orderkey % 2 = 0 and o_orderkey % 3 <> 0 and o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 then 'SUPPORTED' when o_orderkey % 2 = 0 and o_orderkey % 5 <> 0 then 'PARTIALLY_SUPPORTED' else 'UNSUPPORTED' end as status from orders)
select question_id, claim_no, status, bool_and(status <> 'MISSING') over (partition by question_id) as report_valid from j""")
def _(s, d):
    o = t(s, d, "orders")
    k = C("o_orderkey")
    c = o.select(C("o_custkey").alias("question_id"), k.alias("claim_no"), (k % 7 != 0).alias("anchored"))
    j = o.filter("o_orderkey % 8 != 5").select(C("o_custkey").alias("question_id"), k.alias("claim_no"), (k % 2 == 0).alias("entails"), (k % 3 != 0).alias("complete"), (k % 5 == 0).alias("contradicts"))
    return verify.semantic_status(c, j).select("question_id", "claim_no", "status", "report_valid")


L = "(list_filter({0}, lambda a: not list_contains({1}, a)))"


@query("H10_evaluate_answers", sql(CASES, f"""x as (select *, list_concat(assembled, acceptable) as ev, list_filter(citations, lambda a: a <> 'k9') as hits from cases)""", f"""select case_id, json_valid, citation_subset, no_invalid, no_out_of_evidence, required_covered, no_false_abstention, no_unsafe_answer, decision_match, json_valid and payload_valid and decision_match and citation_subset and no_invalid and no_out_of_evidence and required_covered and no_false_abstention and no_unsafe_answer as automatic_pass from (
 select case_id, doc_id % 13 <> 6 as json_valid, true as payload_valid, decision = expected_decision as decision_match, len({L.format('citations', 'ev')}) = 0 as citation_subset, len({L.format('citations', 'hits')}) = 0 as no_invalid, len({L.format('hits', 'ev')}) = 0 as no_out_of_evidence, expected_decision <> 'ANSWER' or len({L.format('required', 'citations')}) = 0 as required_covered, not (expect_answer and not answered) as no_false_abstention, not (not expect_answer and answered) as no_unsafe_answer from x)"""))
def _(s, d):
    x = cases(s, d).withColumns({"is_json": C("doc_id") % 13 != 6, "schema_ok": F.lit(True), "evidence": F.concat("assembled", "acceptable"), "corpus_hit": F.filter("citations", lambda a: a != "k9")})
    return verify.evaluate_answers(x).select("case_id", "json_valid", "citation_subset", "no_invalid", "no_out_of_evidence", "required_covered", "no_false_abstention", "no_unsafe_answer", "decision_match", "automatic_pass")


@query("H11_target_fidelity", sql(CASES, "select case_id, case when expect_answer then len(list_filter(cited, lambda a: list_contains(list_concat(expected, acceptable), a))) > 0 end as target_hit from cases"))
def _(s, d):
    return verify.target_fidelity(cases(s, d)).select("case_id", "target_hit")


# --- evaluation ---

EXPECTED = """e as (select 'c' || o_custkey as case_id, 'o' || o_orderkey as key from orders where o_orderkey % 4 = 1), r as (select question_id as case_id, key, rank from (select 'c' || o_custkey as question_id, 'o' || o_orderkey as key, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::int as rank from orders)),
ids as (select distinct case_id from r), fr as (select case_id, min(rank) as first_rank from e join r using (case_id, key) group by 1)"""


def ranked_cases(s, d) -> tuple[DataFrame, DataFrame]:
    o = t(s, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    key = F.concat(F.lit("o"), "o_orderkey")
    r = o.select(F.concat(F.lit("c"), "o_custkey").alias("case_id"), key.alias("key"), F.row_number().over(w).alias("rank"))
    c = o.groupBy(F.concat(F.lit("c"), "o_custkey").alias("case_id")).agg(F.collect_list(F.when(C("o_orderkey") % 4 == 1, key)).alias("expected"), F.first("o_custkey").alias("k"))
    return c.select("case_id", "expected", F.array().cast("array<string>").alias("acceptable"), F.concat(F.lit("g"), (C("k") % 5).cast("string")).alias("category")), r


@query("I1_rank_metrics", sql(EXPECTED, "select case_id, first_rank, coalesce(round(1.0::double / first_rank, 6), 0) as reciprocal_rank, coalesce(first_rank <= 1, false) as hit_1, coalesce(first_rank <= 3, false) as hit_3, coalesce(first_rank <= 5, false) as hit_5, coalesce(first_rank <= 10, false) as hit_10 from ids left join fr using (case_id)"))
def i1(s, d) -> DataFrame:
    return evaluate.rank_metrics(*ranked_cases(s, d))


@query("I2_recall_at_k", sql(EXPECTED, "select case_id, coalesce(round(count(e.key) filter (r.rank <= 3)::double / nullif(count(e.key), 0), 6), 0) as recall, count(e.key) filter (r.rank <= 3) > 0 as hit from r left join e using (case_id, key) group by 1"))
def _(s, d):
    return evaluate.recall_at_k(*ranked_cases(s, d), 3)


@query("I3_aggregate_metrics", sql(EXPECTED, "m as (select 'g' || (substr(case_id, 2)::int % 5) as category, coalesce(round(1.0::double / first_rank, 6), 0) as reciprocal_rank, coalesce(first_rank <= 3, false)::int as hit_3 from ids left join fr using (case_id))", "select case when grouping(category) = 0 then category end as category, grouping(category) = 1 as overall, count(*) as n, round(sum(round(reciprocal_rank * 1e6)::bigint) / count(reciprocal_rank)) / 1e6 as reciprocal_rank, round(sum(hit_3::bigint * 1000000) / count(hit_3)) / 1e6 as hit_3 from m group by grouping sets ((), (category))"))
def _(s, d):
    c, _r = ranked_cases(s, d)
    return evaluate.aggregate_metrics(i1(s, d).join(c.select("case_id", "category"), "case_id").withColumn("hit_3", C("hit_3").cast("int")), "category", ["reciprocal_rank", "hit_3"])


@query("I4_latency_summary", """with x as (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events where value is not null)
select event_type, count(*) as n, round(median(value), 6) as p50, round(max(value) filter (r = greatest(1, floor(n * 0.95))), 6) as p95, round(avg(value), 6) as mean, max(value) as maximum, round(sum(value), 4) as total from x group by 1""")
def _(s, d):
    return evaluate.latency_summary(t(s, d, "events"), "event_type", "value")


@query("I5_decision_confusion", sql(CASES, "select count(*) filter (expect_answer and answered) as answered_right, count(*) filter (expect_answer and not answered) as false_abstention, count(*) filter (not expect_answer and answered) as unsafe_answer, count(*) filter (not expect_answer and not answered) as right_abstention, count(*) as n, round(count(*) filter (expect_answer = answered) / count(*), 6) as correct_rate from cases"))
def _(s, d):
    return evaluate.decision_confusion(cases(s, d).withColumn("expected_answer", C("expect_answer")))


I6 = "coalesce(round(count(*) filter ({0}) / nullif(count(*) filter ({1}), 0), 6), 0)"


@query("I6_evidence_quality", sql(CASES, f"select {I6.format('expect_answer and len(list_filter(expected, lambda a: list_contains(assembled, a))) > 0', 'expect_answer')} as expected_in_selected, round(avg(len(retrieved)), 6) as avg_retrieved, round(avg(len(assembled)), 6) as avg_selected, round(avg(len(retrieved) - len(list_distinct(retrieved))), 6) as avg_duplicates, {I6.format('not expect_answer and not answered', 'not expect_answer')} as correct_abstention_rate, {I6.format('expect_answer and not answered', 'expect_answer')} as false_abstention_rate, {I6.format('not expect_answer and answered', 'not expect_answer')} as unsafe_rate from cases"))
def _(s, d):
    return evaluate.evidence_quality(cases(s, d).withColumn("selected", C("assembled")))


@query("I7_classify_outcomes", sql(CASES, "o as (select *, case when expect_answer and answered and target_hit then 'CORRECT_ANSWER' when expect_answer and answered then 'WRONG_TARGET' when expect_answer then 'FALSE_ABSTENTION' when answered then 'UNSAFE_ANSWER' else 'CORRECT_ABSTENTION' end as outcome from cases)", "select case_id, outcome, case when outcome like 'CORRECT%' then null when expect_answer then case when not found_it then 'RETRIEVAL' when not selected_it then 'SELECTION' when not answered then 'GENERATION' else 'ATTRIBUTION' end else 'SAFETY' end as failure_stage from o"))
def _(s, d):
    return evaluate.classify_outcomes(cases(s, d).drop("retrieved").withColumns({"retrieved": C("found_it"), "selected": C("selected_it")}))


I8 = """c8 as (select *, len(required) as required_n, len(list_filter(required, lambda a: list_contains(retrieved, a))) as retrieved_n, len(list_filter(required, lambda a: list_contains(assembled, a))) as assembled_n, doc_id % 13 <> 6 as contract_ok, doc_id % 8 <> 3 as citations_ok from cases),
campaign as (select case_id, category, required_n, retrieved_n, assembled_n, assembled_n = required_n and contract_ok and citations_ok and decision = expected_decision as automatic_pass, case when retrieved_n < required_n and assembled_n < required_n then 'RETRIEVAL' when assembled_n < required_n then 'ASSEMBLY' when not contract_ok then 'CONTRACT' when not citations_ok then 'CITATION' when decision <> expected_decision then 'DECISION' when toxic = 1 then 'REVIEW' end as failure_class from c8)"""


@query("I8_campaign_cases", sql(CASES, I8, "select case_id, category, required_n::int as required_n, retrieved_n::int as retrieved_n, assembled_n::int as assembled_n, automatic_pass, failure_class from campaign"))
def i8(s, d) -> DataFrame:
    x = cases(s, d).withColumns({"contract_ok": C("doc_id") % 13 != 6, "citations_ok": C("doc_id") % 8 != 3, "review": F.when(C("toxic") == 1, "FAIL").otherwise("PASS")})
    x = x.withColumns({c: F.array_distinct(c) for c in ("required", "retrieved", "assembled")})
    return evaluate.campaign_cases(x)


METRICS = ["automatic_pass", "retrieval_recall", "assembly_recall", "failed_retrieval", "failed_decision"]
I9 = """count(*) as n, count(*) filter (automatic_pass) as automatic_pass, case when sum(required_n) > 0 then round(sum(retrieved_n) / sum(required_n), 6) else 1 end as retrieval_recall, case when sum(required_n) > 0 then round(sum(assembled_n) / sum(required_n), 6) else 1 end as assembly_recall, count(*) filter (retrieved_n = required_n) as full_retrieval, """ + ", ".join(f"count(*) filter (failure_class = '{k}') as failed_{k.lower()}" for k in ("RETRIEVAL", "ASSEMBLY", "CONTRACT", "CITATION", "DECISION", "REVIEW"))


@query("I9_campaign_metrics", sql(CASES, I8, f"select {I9} from campaign"))
def _(s, d):
    return evaluate.campaign_metrics(i8(s, d))


@query("I10_compare_runs", sql(CASES, I8, f"a as (select {I9} from campaign where category = 'en'), b as (select {I9} from campaign where category <> 'en')", " union all ".join(f"select '{m}' as metric, a.{m}::double as before, b.{m}::double as after, round(b.{m}::double - a.{m}::double, 6) as delta from a, b" for m in METRICS)))
def _(s, d):
    x = i8(s, d)
    return evaluate.compare_runs(evaluate.campaign_metrics(x.filter("category = 'en'")), evaluate.campaign_metrics(x.filter("category != 'en'")), METRICS)


REVIEW = """auto as (select case_id, category, doc_id, automatic_pass from campaign join cases using (case_id, category)),
final as (select case_id, category, automatic_pass, case when doc_id % 10 = 1 then 'MISSING' when doc_id % 10 = 2 then 'CHANGED' when doc_id % 10 = 3 then 'BAD_VALUE' end as error, case when doc_id % 10 in (1, 2, 3) then 'ERROR' when doc_id % 10 = 4 then 'PENDING' when automatic_pass and doc_id % 10 <> 5 then 'PASS' else 'FAIL' end as final_status from auto)"""


def reviewed(s, d) -> DataFrame:
    k = C("case_id").cast("long") % 10
    x = i8(s, d).select("case_id", "category", "automatic_pass")
    r = x.filter(k != 1).select("case_id", F.when(k == 2, "zz").otherwise(C("category")).alias("category"), F.when(k == 3, "MAYBE").when(k == 4, F.lit(None)).when(k == 5, "FAIL").otherwise("PASS").alias("legal_correctness"), F.lit("PASS").alias("groundedness"), F.lit("NOT_APPLICABLE").alias("completeness"))
    return evaluate.join_review(x, r)


@query("I11_join_review", sql(CASES, I8, REVIEW, "select * from final"))
def _(s, d):
    return reviewed(s, d)


@query("I11_review_template", sql(CASES, "select case_id, category, null::varchar as legal_correctness, null::varchar as groundedness, null::varchar as completeness, null::varchar as comments from cases"))
def _(s, d):
    return evaluate.review_template(cases(s, d))


@query("I12_review_summary", sql(CASES, I8, REVIEW, "select category, count(*) as n, count(*) filter (final_status = 'PASS') as passed, count(*) filter (final_status = 'PENDING') as pending, coalesce(round(count(*) filter (final_status = 'PASS') / nullif(count(*) filter (final_status in ('PASS', 'FAIL')), 0), 6), 0) as pass_rate from final group by 1"))
def _(s, d):
    return evaluate.review_summary(reviewed(s, d))


@query("I13_hash_stratified_sample", "select case_id, category, pick from (select doc_id as case_id, lang as category, row_number() over (partition by lang order by sha256('salt:' || doc_id), doc_id)::int as pick from documents) where pick <= 3")
def _(s, d):
    return evaluate.hash_stratified_sample(t(s, d, "documents").select(C("doc_id").alias("case_id"), C("lang").alias("category")), "salt", 3)[0].select("case_id", "category", "pick")


@query("I14_stability", """with r as (select o_custkey as case_id, case when o_orderkey % 3 = 0 then 'ANSWER' when o_orderkey % 3 = 1 then null else 'ABSTAIN' end as decision, o_orderkey % 2 = 0 as covered, (o_orderkey % 4)::varchar as cite from orders)
select case_id, count(*) as runs, count(distinct coalesce(decision, '-')) = 1 as decision_stable, case when count(case when decision = 'ANSWER' then covered end) > 0 then count(distinct case when decision = 'ANSWER' then covered end) = 1 end as coverage_stable, count(distinct cite) as citation_sets from r group by 1""")
def _(s, d):
    k = C("o_orderkey")
    r = t(s, d, "orders").select(C("o_custkey").alias("case_id"), F.when(k % 3 == 0, "ANSWER").when(k % 3 == 2, "ABSTAIN").alias("decision"), (k % 2 == 0).alias("covered"), F.array((k % 4).cast("string")).alias("citations"))
    return evaluate.stability(r)


@query("I15_check_dataset", """with c as (select o_orderkey // 2 as case_id, case o_orderkey % 5 when 0 then 'single' when 1 then 'composite' when 2 then 'insufficient' when 3 then 'ambiguous' else 'odd' end as category, case when o_orderkey % 17 = 0 then ' ' else 'q' end as question, (o_orderkey % 3)::int as n, o_orderkey % 19 = 0 as stray from orders), d as (select *, count(*) over (partition by case_id) as k from c)
select case_id, unnest(list_filter([case when k > 1 then 'DUPLICATE_ID' end, case when category = 'odd' then 'UNKNOWN_CATEGORY' end, case when trim(question) = '' then 'BLANK_QUESTION' end, case when stray and n > 0 then 'REQUIRED_NOT_GOLD' end, case when (category = 'single' and n <> 1) or (category = 'composite' and n < 2) or (category in ('insufficient', 'ambiguous') and n > 0) then 'SHAPE' end], lambda x: x is not null)) as rule from d""")
def _(s, d):
    k = C("o_orderkey")
    none = F.array().cast("array<string>")
    req = F.when(k % 3 == 0, none).when(k % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    x = t(s, d, "orders").select(F.floor(k / 2).alias("case_id"), F.element_at(F.array(*map(F.lit, ("single", "composite", "insufficient", "ambiguous", "odd"))), (k % 5 + 1).cast("int")).alias("category"), F.when(k % 17 == 0, " ").otherwise("q").alias("question"), req.alias("required"), F.when(k % 19 == 0, none).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("gold"))
    return evaluate.check_dataset(x, ["single", "composite", "insufficient", "ambiguous"])


@query("I16_check_pairing", "select coalesce(c, o) as custkey, case when o is null then 'MISSING' when c is null then 'EXTRA' else 'DUPLICATE' end as problem from (select c_custkey as c from customer where c_custkey % 5 <> 0) full outer join (select o_custkey as o, count(*) as n from orders group by 1) on c = o where o is null or c is null or n > 1")
def _(s, d):
    return evaluate.check_pairing(t(s, d, "customer").filter("c_custkey % 5 != 0").select(C("c_custkey").alias("custkey")), t(s, d, "orders").select(C("o_custkey").alias("custkey")), "custkey")


@query("I17_judge_benchmark", """with c as (select case when quality = 1 then 'SUPPORTED' when toxic = 1 then 'UNSUPPORTED' else 'PARTIALLY_SUPPORTED' end as e, case when doc_id % 3 = 0 then 'SUPPORTED' else 'UNSUPPORTED' end as v from labels)
select count(*) as n, round(count(*) filter (e = v) / count(*), 6) as accuracy, round(count(*) filter (e = 'SUPPORTED' and v = 'SUPPORTED') / count(*) filter (v = 'SUPPORTED'), 6) as supported_precision, round(count(*) filter (e = 'SUPPORTED' and v = 'SUPPORTED') / count(*) filter (e = 'SUPPORTED'), 6) as supported_recall, count(*) filter (v = 'SUPPORTED' and e = 'UNSUPPORTED') as unsafe_acceptance, count(*) filter (e = 'SUPPORTED' and v <> 'SUPPORTED') as false_abstention_potential from c""")
def _(s, d):
    x = t(s, d, "labels").select(F.when(C("quality") == 1, "SUPPORTED").when(C("toxic") == 1, "UNSUPPORTED").otherwise("PARTIALLY_SUPPORTED").alias("expected"), F.when(C("doc_id") % 3 == 0, "SUPPORTED").otherwise("UNSUPPORTED").alias("verdict"))
    return evaluate.judge_benchmark(x)


@query("I18_provenance_consistency", "select l_partkey as key, count(distinct l_suppkey || ':' || l_returnflag) as payloads from lineitem group by 1 having count(distinct l_suppkey || ':' || l_returnflag) > 1")
def _(s, d):
    return evaluate.provenance_consistency(t(s, d, "lineitem").withColumnRenamed("l_partkey", "key"), "key", ["l_suppkey", "l_returnflag"])
