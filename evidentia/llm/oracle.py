"""DuckDB forms of those queries of this subpackage that SQL can express."""

from __future__ import annotations

from evidentia.llm.secrets import KINDS, OWNED

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

OP1 = f"""with d as (select doc_id, source, md5(text) as digest, row_number() over (partition by doc_id, text) as no, coalesce(len({WORDS.format('text')}), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by 1),
w as (select *, ((row_number() over (order by source is null, source) - 1) % 3 + 1)::double as weight, (source_size * 3)::double as cap, sum(source_size) over ()::double as total from s),
c as (select *, coalesce(sum(cap) over (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding), 0) as before, sum(weight) over (order by cap / weight, source is null, source rows between current row and unbounded following) as rest from w),
k as (select *, cap * rest <= weight * (total - before) as capped from c),
o as (select *, total - coalesce(sum(cap) filter (capped) over (), 0) as rest_total, sum(weight) filter (not capped) over () as open from k),
t as (select source, source_size, case when capped then cap else coalesce(rest_total * weight / open, 0) end as target from o),
r as (select d.*, source_size, target, least(coalesce(target / nullif(source_size, 0), 0), 3.0::double) as rate, ('0x' || substr(md5('7:' || coalesce(doc_id::varchar, 'null') || ':' || coalesce(digest, 'null') || ':' || no), 1, 13))::bigint / 4503599627370496.0::double as u from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, size * (floor(rate) + (u < rate - floor(rate))::int)::bigint as taken, (floor(rate) + (u < rate - floor(rate))::int)::int as copies from r"""

OP3 = f"""with l as (select doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
x as (select doc_id, unnest(ws) as w, unnest(range(len(ws))) as i from l),
g as (select doc_id, i, w as g1, lag(w) over p || ' ' || w as g2, lag(w, 2) over p || ' ' || lag(w) over p || ' ' || w as g3, lag(w) over p as h1, lag(w, 2) over p || ' ' || lag(w) over p as h2 from x window p as (partition by doc_id order by i)),
c1 as (select g1 as g, count(*) as n from g group by 1), c2 as (select g2 as g, count(*) as n from g where g2 is not null group by 1), c3 as (select g3 as g, count(*) as n from g where g3 is not null group by 1),
o1 as (select doc_id, g1 as g, count(*) as n from g group by all), o2 as (select doc_id, g2 as g, count(*) as n from g where g2 is not null group by all), o3 as (select doc_id, g3 as g, count(*) as n from g where g3 is not null group by all),
r1 as (select doc_id, g, c1.n - o1.n as n from o1 join c1 using (g)), r2 as (select doc_id, g, c2.n - o2.n as n from o2 join c2 using (g)), r3 as (select doc_id, g, c3.n - o3.n as n from o3 join c3 using (g)),
size as (select doc_id, len(ws) as n_words, sum(len(ws)) over () as total from l),
s as (select g.doc_id, case when r3.n > 0 then ln(r3.n / b2.n) when r2.n > 0 then ln(r2.n / b1.n) + case when g3 is not null then ln(0.4) else 0 end else ln(greatest(1, r1.n) / greatest(1, total - n_words)) + case when g3 is not null then 2 * ln(0.4) when g2 is not null then ln(0.4) else 0 end end as lp,
 case when r3.n > 0 then 0 when r2.n > 0 then (g3 is not null)::int else (g3 is not null)::int + (g2 is not null)::int end as b
 from g join size using (doc_id) left join r1 on r1.doc_id = g.doc_id and r1.g = g1 left join r2 on r2.doc_id = g.doc_id and r2.g = g2 left join r3 on r3.doc_id = g.doc_id and r3.g = g3
 left join r1 b1 on b1.doc_id = g.doc_id and b1.g = h1 left join r2 b2 on b2.doc_id = g.doc_id and b2.g = h2)
select doc_id, n_words::bigint as n_words, coalesce(sum(b), 0)::bigint as backed_off, round(coalesce(sum(lp), 0), 4) as logprob, round(case when n_words > 0 then coalesce(sum(lp), 0) / n_words else 0 end, 4) as mean_logprob from size left join s using (doc_id) group by doc_id, n_words"""


def _found(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"select doc_id, source, {order} as ord, '{kind}' as kind, {least} as least, regexp_extract_all(t, {p}, 0) as hits, regexp_extract_all(t, {p}, {group}) as vals, string_split_regex(t, {p}) as gaps from d"


OP6 = f"""with d as (select doc_id, source, coalesce(text, '') as t from documents),
m as ({' union all '.join(_found(i, *k) for i, k in enumerate((*KINDS, OWNED)))}),
k as (select *, unnest(range(1, len(hits) + 1)) as k from m where len(hits) > 0),
p0 as (select doc_id, source, ord, kind, least, vals[k] as v, length(hits[k]) as n, (coalesce(list_sum(list_transform(gaps[1:k], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda h: length(h))), 0))::bigint as a from k),
p as (select *, a + n as e from p0 where length(v) >= least),
s0 as (select * from p where kind <> '{OWNED[0]}' union all select * from p o where kind = '{OWNED[0]}' and regexp_matches(v, '[0-9]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]') and not exists (select 1 from p b where b.doc_id = o.doc_id and b.kind <> '{OWNED[0]}' and b.a < o.e and o.a < b.e)),
own as (select v, count(distinct coalesce(source, chr(1))) as owners from s0 group by 1),
s as (select s0.*, owners from s0 join own using (v) where kind <> '{OWNED[0]}' or owners <= 1),
g as (select doc_id, {', '.join(f"count(*) filter (kind = '{k[0]}') as n_{k[0]}" for k in (*KINDS, OWNED))}, string_agg(kind || ':' || a || ':' || e, ',' order by a, ord) filter (kind <> '{OWNED[0]}') as base, string_agg(kind || ':' || a || ':' || e, ',' order by a, ord) as spans, count(*) filter (owners < 3) as n_live, count(*) filter (owners >= 3) as n_example from s group by 1)
select doc_id, {', '.join(f'coalesce(n_{k[0]}, 0) as n_{k[0]}' for k in (*KINDS, OWNED))}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example from documents left join g using (doc_id)"""

OP12 = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
 where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
p as (select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, other))::int as rank, other as negative_id, positive_score, score as negative_score
 from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score qualify rank <= 10"""

ORACLE_SQL = {"op1_mixing": OP1, "op3_lm_score": OP3, "op6_secrets": OP6, "op12_hard_negatives": OP12}
