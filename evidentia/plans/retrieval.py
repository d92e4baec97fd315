"""Queries of retrieval and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators import index, retrieve
from evidentia.plans.inputs import POSTINGS, QTERMS, TREE, UNITS, WHOLE_QUESTIONS, sql, stored_index, t, tree, vectors, whole_questions
from evidentia.plans.register import query

C = F.col
HITS = "hits as (select q.question_id, q.slot, q.n_terms, p.unit_key, p.tf, p.positions from qterms q join postings p using (version, term))"
RANKED = "select * from (select *, row_number() over (partition by question_id order by {order})::int as rank from {rows}) where rank <= {k}"
OR_SCORE = "scored as (select question_id, unit_key, round(sum(tf) * 0.1, 6) as score from hits group by all)"


@query("F1_search_strict", sql(WHOLE_QUESTIONS, UNITS, POSTINGS, QTERMS, HITS, """full_units as (select question_id, unit_key, max(n_terms) as n from hits group by all having count(*) = max(n_terms)),
occ as (select h.question_id, h.unit_key, f.n, h.slot, unnest(h.positions) as p from hits h join full_units f using (question_id, unit_key)),
ends as (select a.question_id, a.unit_key, a.n, a.p as r, b.slot, max(b.p) as latest from occ a join occ b using (question_id, unit_key) where b.p <= a.p group by all),
lefts as (select question_id, unit_key, r, min(latest) as l from ends group by question_id, unit_key, n, r having count(*) = n),
covers as (select *, lag(l) over (partition by question_id, unit_key order by r) as before from lefts),
kept as (select question_id, unit_key, l, r, (select count(*) from occ o where o.question_id = c.question_id and o.unit_key = c.unit_key and o.p between c.l and c.r) as m from covers c where before is null or l > before),
scored as (select question_id, unit_key, round(sum(0.1::double / (1 + (r - l) - (m - 1))), 6) as score from kept group by all)""", RANKED.format(order="score desc, unit_key", rows="scored", k=10)))
def _(s, d):
    postings, df, _ = stored_index(s, d)
    return retrieve.search_strict(whole_questions(s, d), postings, frequencies=df)


@query("F2_search_relaxed_or", sql(WHOLE_QUESTIONS, UNITS, POSTINGS, QTERMS, HITS, OR_SCORE, RANKED.format(order="score desc, unit_key", rows="scored", k=10)))
def _(s, d):
    return retrieve.search_relaxed_or(whole_questions(s, d), stored_index(s, d)[0])


F3 = """w as (select q.question_id, q.version, q.term, coalesce(ln((n_units + 1) / (df + 1)), ln(coalesce(n_units, 0) + 1.0)) as weight from qterms q left join sizes using (version) left join freq using (version, term)),
totals as (select question_id, count(*) as n, sum(weight) as total from w group by 1),
m as (select question_id, unit_key, count(*) as matched, sum(weight) as ww, sum(tf) as tf from w join postings using (version, term) group by all),
scored as (select question_id, unit_key, round(case when total <> 0 then ww / total end, 6) as weighted_coverage, round(matched / n, 6) as coverage, round(tf * 0.1, 6) as score from m join totals using (question_id))"""


@query("F3_search_weighted_coverage", sql(WHOLE_QUESTIONS, UNITS, POSTINGS, QTERMS, F3, RANKED.format(order="weighted_coverage desc, coverage desc, score desc, unit_key", rows="scored", k=10)))
def f3(s, d) -> DataFrame:
    postings, df, sizes = stored_index(s, d)
    return retrieve.search_weighted_coverage(whole_questions(s, d), postings, index.idf_weights(df, sizes), sizes)


@query("F4_lexical_search", sql(WHOLE_QUESTIONS, UNITS, POSTINGS, QTERMS, HITS, """places as (select question_id, unit_key, n_terms, unnest(list_transform(positions, lambda p: p - slot)) as base from hits),
phrases as (select question_id, unit_key, count(*) as n from (select question_id, unit_key, base from places group by question_id, unit_key, n_terms, base having count(*) = n_terms) group by all),
scored as (select question_id, unit_key, round(sum(tf) * 0.1 + 2.0 * case when max(n_terms) > 1 then coalesce(max(n), 0) else sum(tf) end, 6)::double as score from hits left join phrases using (question_id, unit_key) group by all)""", RANKED.format(order="score desc, unit_key", rows="scored", k=20)))
def _(s, d):
    return retrieve.lexical_search(whole_questions(s, d), stored_index(s, d)[0], 20)


COS = "cosines as (select q.vec_id as question_id, v.vec_id as id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as score from embeddings q, embeddings v where q.vec_id % 50 = 0)"


@query("F6_vector_search", sql(COS, RANKED.format(order="score desc, id", rows="cosines", k=10)))
def f6(s, d) -> DataFrame:
    v = vectors(s, d)
    return retrieve.vector_search(v.filter("id % 50 = 0").select(C("id").alias("question_id"), "vector"), v)


@query("F6_vector_search_near")
def _(s, d):
    """By cells of random hyperplanes; tests measure its recall against the exact form."""
    v = vectors(s, d)
    return retrieve.vector_search_near(v.filter("id % 50 = 0").select(C("id").alias("question_id"), "vector"), v, tables=24, probes=16)


def channels(s, d) -> list[DataFrame]:
    """Two rankings of each customer's orders: by price and by date."""
    o = t(s, d, "orders").select(C("o_custkey").alias("question_id"), C("o_orderkey").alias("id"), "o_totalprice", "o_orderdate", (C("o_custkey") % 4 == 0).alias("is_short"))
    w = Window.partitionBy("question_id")
    a = o.filter("id % 5 != 0").withColumn("rank", F.row_number().over(w.orderBy(F.desc("o_totalprice"), "id")))
    b = o.filter("id % 3 != 0").withColumn("rank", F.row_number().over(w.orderBy("o_orderdate", "id")))
    return [a, b]


FUSED = """a as (select o_custkey as question_id, o_orderkey as id, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::int as rank_0 from orders where o_orderkey % 5 <> 0),
b as (select o_custkey as question_id, o_orderkey as id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)::int as rank_1 from orders where o_orderkey % 3 <> 0),
f0 as (select question_id, id, rank_0, rank_1, round(coalesce(1.0::double / (60 + rank_0), 0) + coalesce(1.0::double / (60 + rank_1), 0), 9) as rrf_score from a full outer join b using (question_id, id)),
fused as (select *, row_number() over (partition by question_id order by rrf_score desc, id)::int as rank from f0)"""


@query("F8_reciprocal_rank_fusion", sql(FUSED, "select question_id, id, rank_0, rank_1, rrf_score, rank from fused"))
def f8(s, d) -> DataFrame:
    return retrieve.reciprocal_rank_fusion(channels(s, d))


@query("F9_short_query_boost", sql(FUSED, "select question_id, id, round(rrf_score + case when question_id % 4 = 0 then case when rank_0 <= 20 then (21 - rank_0) * 0.05::double / 20 when rank_0 is null and rank_1 is not null then -0.01 else 0 end else 0 end, 9) as boosted from fused"))
def _(s, d):
    return retrieve.short_query_boost(f8(s, d).withColumn("is_short", C("question_id") % 4 == 0)).select("question_id", "id", "boosted")


@query("F10_attach_parent_text", sql(TREE, "select child as id, parent as parent_key, o_orderpriority as parent_text from tree join orders on o_orderkey = l_orderkey"))
def _(s, d):
    from evidentia.plans.inputs import provisions

    e = provisions(s, d)
    return retrieve.attach_parent_text(tree(s, d).select(C("child").alias("id")), e).select("id", "parent_key", "parent_text")


BOOST = """x as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as parent_text, first_value(text) over (partition by conv_id order by turn) as q from conversations)"""


def _tok(c: str) -> str:
    from evidentia.plans.inputs import terms_sql

    return f"list_distinct({terms_sql(c, plural=False)})"


@query("F11_parent_union_boost", sql(BOOST, f"""y as (select conv_id, turn, {_tok("coalesce(parent_text, text) || ' ' || text")} as q, {_tok('text')} as own, {_tok('parent_text')} as par from x)""", "select conv_id, turn, round(0.1::double + case when turn % 2 = 1 and len(q) > 0 and len(list_filter(q, lambda a: not list_contains(list_concat(own, par), a))) = 0 and len(list_filter(q, lambda a: not list_contains(own, a))) > 0 then 0.04 else 0 end, 9) as contextual_score from y"))
def _(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = t(s, d, "conversations").withColumn("parent_text", F.lag("text").over(w))
    q = F.concat(F.coalesce("parent_text", "text"), F.lit(" "), "text")
    x = x.withColumns({"question": q, "rrf_score": F.lit(0.1), "element_type": F.when(C("turn") % 2 == 1, "ITEM").otherwise("ARTICLE")})
    return retrieve.parent_union_boost(x).select("conv_id", "turn", "contextual_score")


PATHS = """cs as (select question_id, id, rank_0, rank_1, rrf_score as score, '@root/ARTICLE:' || (id // 8) || case when id % 8 = 0 then '/@caput' else '/INCISO:' || (id % 8) end as path from fused),
rk as (select *, row_number() over (partition by question_id order by score desc, id) as r from cs),
seeds as (select question_id, regexp_extract(path, '^(.*?/ARTICLE:[^/]+)', 1) || '/@caput' as path, max(score) as seed from rk where r <= 3 group by all),
up as (select question_id, id, case when seed is not null and least(rank_0, rank_1) <= 30 then greatest(score, round(seed * 0.999, 9)) else score end as score from rk left join seeds using (question_id, path))"""


@query("F12_promote_caput", sql(FUSED, PATHS, "select question_id, id, score, row_number() over (partition by question_id order by score desc, id)::int as rank from up"))
def _(s, d):
    art = F.concat(F.lit("@root/ARTICLE:"), F.floor(C("id") / 8).cast("string"), F.when(C("id") % 8 == 0, "/@caput").otherwise(F.concat(F.lit("/INCISO:"), (C("id") % 8).cast("string"))))
    x = f8(s, d).select("question_id", "id", "rank_0", "rank_1", C("rrf_score").alias("score"), art.alias("path"))
    return retrieve.promote_caput(x, 3).select("question_id", "id", "score", "rank")


EXPAND = TREE + """,
found as (select o_custkey as question_id, 'o' || o_orderkey as id, round(1.0::double / row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey), 6) as score, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::int as rank from orders),
kids as (select * from (select *, count(*) over (partition by parent) as n from tree) where n <= 4),
promos as (select * from (select question_id, parent, child as id, round(score * 0.85, 9) as score, rank as parent_rank, child_order, row_number() over (partition by question_id order by rank, child_order, child)::int as rank2 from found join kids on parent = id) where rank2 <= 6)"""


def found(s, d) -> DataFrame:
    w = Window.partitionBy("question_id").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t(s, d, "orders").select(C("o_custkey").alias("question_id"), F.concat(F.lit("o"), "o_orderkey").alias("id"), "o_totalprice", "o_orderkey").withColumn("rank", F.row_number().over(w)).select("question_id", "id", F.round(1.0 / C("rank"), 6).alias("score"), "rank")


@query("F13_expand_children", sql(EXPAND, "select question_id, parent, id, score, rank2 as rank from promos"))
def f13(s, d) -> DataFrame:
    return retrieve.expand_children(found(s, d), tree(s, d), 4, 0.85, 6).select("question_id", "parent", "id", "score", "rank")


@query("F14_structural_reserve", sql(EXPAND, "select question_id, id, score, rank, false as reserved from found union all select n.question_id, n.id, n.score, (l.last + n.place)::int, true from (select question_id, id, score, row_number() over (partition by question_id order by score desc, id) as place from promos) n join (select question_id, max(rank) as last from found group by 1) l using (question_id) where place <= 3"))
def _(s, d):
    return retrieve.structural_reserve(found(s, d), f13(s, d), 3)


@query("F7_hybrid_search")
def _(s, d):
    """Whole benchmark passages over documents in articles of eight, of which the first is the opening and the others are items."""
    docs = t(s, d, "documents").select(F.lit("v").alias("version"), C("doc_id").cast("string").alias("unit_key"), C("doc_id").cast("long").alias("key"), "text")
    q = t(s, d, "benchmark").select(C("item_id").cast("long").alias("question_id"), F.lit("v").alias("version"), C("text").alias("question"))
    v = vectors(s, d)
    qv = v.join(q.select(C("question_id").alias("id")), "id", "left_semi").select(C("id").alias("question_id"), "vector")
    article, item = F.floor(C("key") / 8), C("key") % 8
    path = F.concat(F.lit("@root/ARTICLE:"), article.cast("string"), F.when(item == 0, "/@caput").otherwise(F.concat(F.lit("/INCISO:"), item.cast("string"))))
    elements = docs.select("key", F.when(item != 0, article * 8).alias("parent_key"), "text", F.when(item == 0, "ARTICLE").otherwise("ITEM").alias("element_type"), path.alias("path"))
    return retrieve.hybrid_search(q, qv, stored_index(s, d, "documents")[0], v.select("id", "vector"), elements).select("question_id", "id", C("score").alias("boosted"), "rank")


@query("F16_corpus_keys", "select distinct l_returnflag as version, l_partkey as stable_key from lineitem")
def _(s, d):
    return retrieve.corpus_keys(t(s, d, "lineitem").select(C("l_returnflag").alias("version"), C("l_partkey").alias("stable_key")))


@query("F15_search_context", "select o_orderkey, c_name, n_name from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey")
def _(s, d):
    """Every order is traced."""
    o = t(s, d, "orders").select("o_orderkey", C("o_custkey").cast("long").alias("version"))
    v = t(s, d, "customer").select(C("c_custkey").cast("long").alias("version"), C("c_nationkey").alias("act"), "c_name", C("c_custkey").alias("snapshot_id"))
    a = t(s, d, "nation").select(C("n_nationkey").alias("act"), "n_name")
    good, _ = retrieve.search_context(o, v, a, t(s, d, "customer").select(C("c_custkey").alias("snapshot_id")))
    return good.select("o_orderkey", "c_name", "n_name")


@query("F17_rank_of", sql(FUSED, "select question_id, id, rank_0 as price_rank, rank_1 as date_rank from (select o_custkey as question_id, o_orderkey as id from orders) left join f0 using (question_id, id)"))
def _(s, d):
    """Every order is ranked; those that a channel lacks are null there."""
    a, b = channels(s, d)
    c = a.select("question_id", "id", "rank", F.lit("price").alias("channel")).union(b.select("question_id", "id", "rank", F.lit("date").alias("channel")))
    return retrieve.rank_of(c, t(s, d, "orders").select(C("o_custkey").alias("question_id"), C("o_orderkey").alias("id")), ["price", "date"])
