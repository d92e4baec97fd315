"""Queries of page structure and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators import act_audit, audit, deep, law, structure
from evidentia.plans.inputs import TREE, sql, t, tree
from evidentia.plans.register import query
from evidentia.sources.scratch import cut, spread

C = F.col


@query("C1_html_blocks")
def _(s, d):
    return structure.html_blocks(t(s, d, "pages")).select("page_id", "block", "text")


@query("C1_html_blocks_regex", r"""select page_id, unnest(range(len(l)))::int as block, unnest(list_transform(l, lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')))) as text from (select page_id, regexp_extract_all(html, '(?s)<p(?: [^>]*)?>(.*?)</p>', 1) as l from pages)""")
def _(s, d):
    return structure.html_blocks_regex(t(s, d, "pages"))


@query("C2_page_metrics", r"""select page_id, len(regexp_extract_all(l, '<p[ >]')) as n_p, len(regexp_extract_all(l, '<a[ >]')) as n_a, len(regexp_extract_all(l, 'href=')) as n_href, len(regexp_extract_all(l, '<(?:strike|s|del)[ >]')) as n_strike, len(regexp_extract_all(l, '<table[ >]')) as n_table, len(regexp_extract_all(l, '<script[ >]')) as n_script, strpos(l, '</html>') > 0 as has_close,
 case when strpos(l, '</html>') > 0 then length(regexp_replace(substr(html, strpos(l, '</html>') + 7), '\s', '', 'g')) else 0 end as tail_length from (select page_id, html, lower(html) as l from pages)""")
def _(s, d):
    return structure.page_metrics(t(s, d, "pages"))


@query("C3_block_flags")
def _(s, d):
    return structure.html_blocks(t(s, d, "pages")).select("page_id", "block", "in_table", "any_struck", "fully_struck")


def lines(s, d) -> DataFrame:
    """Statute-like lines made of the line items of an order."""
    x = tree(s, d)
    n = (C("l_orderkey") * 7 + C("child_order") * 3) % 10
    i = C("child_order").cast("string")
    line = (
        F.when(C("child_order") == 1, F.concat(F.lit("CAPÍTULO I"), F.when(C("l_orderkey") % 3 == 0, "").otherwise(" DO NOME")))
        .when(C("child_order") == 2, F.when(C("l_orderkey") % 3 == 0, "TÍTULO ABERTO").otherwise("Art. 2º Caput ."))
        .when(n < 3, F.concat(F.lit("Art. "), i, F.lit("º Texto  do artigo ;")))
        .when(n < 5, F.concat(F.lit("§ "), i, F.lit("º Parágrafo.")))
        .when(n == 5, "Parágrafo único. Texto só.")
        .when(n < 9, F.concat(F.element_at(F.array(*map(F.lit, ("I", "II", "III", "IV", "V", "VI", "VII"))), (C("child_order") % 7 + 1).cast("int")), F.lit(" - inciso")))
        .otherwise(F.when(C("l_orderkey") % 2 == 0, "").otherwise("texto solto"))
    )
    return x.select(C("l_orderkey").alias("doc_id"), (C("child_order") - 1).alias("pos"), line.alias("text"))


LINES = TREE + """,
lines as (select l_orderkey as doc_id, child_order - 1 as pos, case when child_order = 1 then 'CAPÍTULO I' || case when l_orderkey % 3 = 0 then '' else ' DO NOME' end
 when child_order = 2 then case when l_orderkey % 3 = 0 then 'TÍTULO ABERTO' else 'Art. 2º Caput .' end
 when n < 3 then 'Art. ' || child_order || 'º Texto  do artigo ;' when n < 5 then '§ ' || child_order || 'º Parágrafo.' when n = 5 then 'Parágrafo único. Texto só.'
 when n < 9 then (['I', 'II', 'III', 'IV', 'V', 'VI', 'VII'])[child_order % 7 + 1] || ' - inciso' else case when l_orderkey % 2 = 0 then '' else 'texto solto' end end as text
 from (select *, (l_orderkey * 7 + child_order * 3) % 10 as n from tree))"""
CLASSED = """classed as (select doc_id, pos, text, case when trim(text) = '' then 'BLANK' when text like 'CAPÍTULO %' then 'CHAPTER' when text like 'Art. %' then 'ARTICLE' when text like '§ %' then 'PARAGRAPH' when text like 'Parágrafo único%' then 'SOLE_PARAGRAPH' when text like '% - inciso' then 'INCISO' else 'TEXT' end as class,
 case when text like 'CAPÍTULO %' then 'I' when text like 'Art. %' or text like '§ %' then regexp_extract(text, '(\\d+)', 1) when text like 'Parágrafo único%' then 'Parágrafo único' when text like '% - inciso' then regexp_extract(text, '^([IV]+)', 1) end as label,
 case when text like 'CAPÍTULO %' then trim(substr(text, 11)) when text like 'Art. %' then regexp_replace(text, '^Art. \\d+º ', '') when text like '§ %' then 'Parágrafo.' when text like 'Parágrafo único%' then 'Texto só.' when text like '% - inciso' then 'inciso' else text end as rest from lines)"""
CARRIED = """w0 as (select *, max(case when class = 'CHAPTER' then pos end) over w as ch_pos, max(case when class = 'ARTICLE' then pos end) over w as art_pos, max(case when class in ('ARTICLE', 'PARAGRAPH', 'SOLE_PARAGRAPH') then pos end) over w as host_pos from classed window w as (partition by doc_id order by pos)),
w1 as (select w0.*, case when w0.ch_pos is null or w0.art_pos > w0.ch_pos then 'article:' || a.label end as art from w0 left join classed a on a.doc_id = w0.doc_id and a.pos = w0.art_pos),
hosts as (select doc_id, pos, case class when 'ARTICLE' then art || '/caput' when 'PARAGRAPH' then art || '/paragraph:' || label when 'SOLE_PARAGRAPH' then art || '/paragraph:unique' end as host from w1),
w2 as (select w1.*, case when ch_pos is null or v_pos > ch_pos then v.host end as host from (select *, (select max(h.pos) from hosts h where h.doc_id = w1.doc_id and h.pos <= w1.pos and h.host is not null) as v_pos from w1) w1 left join hosts v on v.doc_id = w1.doc_id and v.pos = v_pos),
made as (select doc_id, pos, 0 as sub, 'chapter:i' as stable_key, 'root' as parent_key, 'CHAPTER' as provision_type, label as number_label, rest as text from w2 where class = 'CHAPTER'
 union all select doc_id, pos, 0, art, case when ch_pos is null then 'root' else 'chapter:i' end, 'ARTICLE', label, null from w2 where class = 'ARTICLE'
 union all select doc_id, pos, 1, art || '/caput', art, 'CAPUT', null, rest from w2 where class = 'ARTICLE'
 union all select doc_id, pos, 0, art || '/paragraph:' || case when class = 'PARAGRAPH' then label else 'unique' end, art, 'PARAGRAPH', case when class = 'PARAGRAPH' then label else 'UNIQUE' end, rest from w2 where class in ('PARAGRAPH', 'SOLE_PARAGRAPH') and art is not null
 union all select doc_id, pos, 0, host || '/inciso:' || lower(label), host, 'INCISO', label, rest from w2 where class = 'INCISO' and host is not null),
flat as (select doc_id, row_number() over (partition by doc_id order by pos, sub)::int as document_order, pos, stable_key, parent_key, provision_type, number_label, trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '\\s+([,.;:])', '\\1', 'g')) as text from made)"""


@query("C5_segment", sql(LINES, """st as (select doc_id, count(*) filter (text like 'CAPÍTULO%') as n0, count(*) filter (text like 'Parágrafo único%') as n1, min(pos) filter (text like 'Parágrafo único%') as p1 from lines group by 1)""", "select doc_id, pos, 1 + (pos >= p1)::int as region from lines join st using (doc_id) where n0 = 1 and n1 = 1"))
def _(s, d):
    return structure.segment(lines(s, d), ["^CAPÍTULO", "^Parágrafo único"])[0].select("doc_id", "pos", "region")


@query("C5_segment_rejects", sql(LINES, """st as (select doc_id, count(*) filter (text like 'CAPÍTULO%') as n0, count(*) filter (text like 'Parágrafo único%') as n1 from lines group by 1)""", "select doc_id, case when n1 = 0 then 'MISSING_1' else 'DUPLICATE_1' end as reason from st where n1 <> 1"))
def _(s, d):
    return structure.segment(lines(s, d), ["^CAPÍTULO", "^Parágrafo único"])[1]


def classed(s, d) -> DataFrame:
    return structure.classify_blocks(lines(s, d))


@query("C6_classify_blocks", sql(LINES, CLASSED, "select doc_id, pos, class, label, rest from classed"))
def _(s, d):
    return classed(s, d).select("doc_id", "pos", "class", "label", "rest")


@query("C7_flat_hierarchy", sql(LINES, CLASSED, CARRIED, "select doc_id, document_order, pos, stable_key, parent_key, provision_type, number_label, text from flat"))
def c7(s, d) -> DataFrame:
    return structure.flat_hierarchy(classed(s, d))


@query("C8_merge_heading_lines", sql(LINES, CLASSED, "isl as (select *, sum((class not in ('TEXT', 'BLANK'))::int) over (partition by doc_id order by pos) as g from classed)", "select doc_id, min(pos) as pos, max(label) filter (class = 'CHAPTER') as label, case when max(rest) filter (class = 'CHAPTER') <> '' then max(rest) filter (class = 'CHAPTER') else coalesce(string_agg(text, ' ' order by pos) filter (class = 'TEXT'), '') end as title from isl group by doc_id, g having bool_or(class = 'CHAPTER')"))
def _(s, d):
    return structure.merge_heading_lines(classed(s, d))


@query("C9_coverage", sql(LINES, CLASSED, CARRIED, "used as (select doc_id, pos, min(stable_key) as consumed_by from flat group by all)", "select doc_id, pos, class, consumed_by, case when consumed_by is null then case class when 'BLANK' then 'EMPTY' when 'TEXT' then 'TEXT' else 'NO_PLACE' end end as ignored_reason from classed left join used using (doc_id, pos)"))
def c9(s, d) -> DataFrame:
    return structure.coverage(classed(s, d), c7(s, d))


@query("C10_unsupported_blocks", sql(LINES, CLASSED, CARRIED, "bef as (select *, max(case when class not in ('TEXT', 'BLANK') then pos end) over (partition by doc_id order by pos) as b_pos from w1)", """x as (select b.doc_id, b.pos, b.class, case when b.class = 'TEXT' and b.b_pos is not null and not (p.class = 'CHAPTER' and p.rest = '') then 'UNMATCHED_TEXT' when b.class in ('PARAGRAPH', 'SOLE_PARAGRAPH') and not (coalesce(b.art_pos, -1) > coalesce(b.ch_pos, -1)) then 'PARAGRAPH_WITHOUT_ARTICLE' when b.class = 'INCISO' and not (coalesce(b.host_pos, -1) > coalesce(b.ch_pos, -1)) then 'INCISO_WITHOUT_PARENT' end as reason from bef b left join classed p on p.doc_id = b.doc_id and p.pos = b.b_pos)""", "select * from x where reason is not null"))
def _(s, d):
    return structure.unsupported_blocks(classed(s, d))


# --- whole laws: lines as pages with header, anchors, tables and struck text ---


def law_pages(s, d) -> DataFrame:
    """The lines of an order as a page: a header and a summary before them, a tail behind the end of the page."""
    pos, line = C("pos") + 2, C("text")
    inner = F.concat(F.when(pos % 2 == 0, F.format_string('<a name="a%s"></a>', pos)).otherwise(""), F.when(pos % 4 == 1, F.concat(F.lit("<strike>"), line, F.lit("</strike>"))).otherwise(line))
    p = F.concat(F.lit("<p>"), inner, F.lit("</p>"))
    p = F.when(pos % 5 == 2, F.concat(F.lit("<table><tr><td>"), p, F.lit("</td></tr></table>"))).otherwise(p)
    body = lines(s, d).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", p.alias("p")))), lambda x: x["p"]), "\n").alias("body"))
    head = F.concat(F.when(C("doc_id") % 13 == 0, "<html><body><p>DECRETO <s>").otherwise("<html><body><p>LEI Nº <s>"), C("doc_id").cast("string"), F.lit("</s></p><p>Ementa.</p>"))
    return body.select("doc_id", F.concat(head, "body", F.lit("</body></html><script>t</script><p>tail</p>")).alias("html"))


def law_snapshots(s, d) -> DataFrame:
    """The pages as stored bytes; of some the last byte stands for no character."""
    raw = F.encode("html", "ISO-8859-1")
    return law_pages(s, d).select("doc_id", F.when(C("doc_id") % 11 == 0, F.concat(raw, F.unhex(F.lit("81")))).otherwise(raw).alias("raw_bytes"))


def law_lines(s, d) -> DataFrame:
    x = lines(s, d)
    docs = x.select("doc_id").distinct()
    head = F.concat(F.when(C("doc_id") % 13 == 0, "DECRETO ").otherwise("LEI Nº "), C("doc_id").cast("string"))
    return x.withColumn("pos", C("pos") + 2).unionByName(docs.select("doc_id", F.lit(0).alias("pos"), head.alias("text"))).unionByName(docs.select("doc_id", F.lit(1).alias("pos"), F.lit("Ementa.").alias("text")))


PLACED = "('CHAPTER', 'ARTICLE', 'PARAGRAPH', 'SOLE', 'INCISO')"
LAWS = LINES + f""",
law0 as (select distinct doc_id, 0 as pos, case when doc_id % 13 = 0 then 'DECRETO ' else 'LEI Nº ' end || doc_id as text from lines union all select distinct doc_id, 1, 'Ementa.' from lines union all select doc_id, pos + 2, text from lines),
law1 as (select doc_id, pos, trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '\\s+([,.;:])', '\\1', 'g')) as text from law0),
law2 as (select *, case when text like 'CAPÍTULO %' then 'CHAPTER' when text like 'Art. %' then 'ARTICLE' when text like '§ %' then 'PARAGRAPH' when text like 'Parágrafo único.%' then 'SOLE' when text like '% - inciso' then 'INCISO' when text like 'LEI N%' then 'HEADER' else 'TEXT' end as class,
 case when text like 'CAPÍTULO %' then 'I' when text like 'Art. %' or text like '§ %' then regexp_extract(text, '(\\d+)', 1) when text like 'Parágrafo único.%' then 'UNIQUE' when text like '% - inciso' then regexp_extract(text, '^([IV]+)', 1) end as label from law1),
law3 as (select *, min(case when class = 'HEADER' then pos end) over d as h, min(case when class = 'CHAPTER' then pos end) over d as c0, max(case when class in {PLACED} then pos end) over d as ls from law2 window d as (partition by doc_id)),
law4 as (select *, coalesce(h < c0, false) as sound, coalesce(h < c0, false) and text <> '' and pos >= h and pos < c0 as root, coalesce(h < c0, false) and text <> '' and pos >= c0 as live from law3),
law5 as (select *, case when live and class in {PLACED} then class end as kind from law4),
law6 as (select *, max(case when kind is not null then pos end) over w as b_pos, max(case when kind = 'CHAPTER' then pos end) over w as ch_pos, max(case when kind = 'ARTICLE' then pos end) over w as art_pos from law5 window w as (partition by doc_id order by pos)),
law7 as (select x.*, b.kind = 'CHAPTER' and b.text = 'CAPÍTULO I' as bare, case when art_pos > ch_pos then 'ARTICLE:' || a.label end as article from law6 x left join law2 a on a.doc_id = x.doc_id and a.pos = x.art_pos left join law5 b on b.doc_id = x.doc_id and b.pos = x.b_pos),
law8 as (select *, case when kind = 'ARTICLE' then article || '/CAPUT' when kind in ('PARAGRAPH', 'SOLE') then article || '/PARAGRAPH:' || label end as own from law7),
law9 as (select *, max(case when own is not null then pos end) over (partition by doc_id order by pos) as host_pos from law8),
law10 as (select x.*, case when x.host_pos > x.ch_pos then v.own end as host, x.live and x.kind is null and coalesce(x.bare, false) as title from law9 x left join law8 v on v.doc_id = x.doc_id and v.pos = x.host_pos),
law11 as (select *, coalesce(text <> '' and not root and not title and (pos < h or pos > ls), false) as chrome, case when root then h when title then b_pos else pos end as opener,
 case when root then 'PREAMBLE' when title or kind = 'CHAPTER' then 'CHAPTER:I' when kind in ('ARTICLE', 'PARAGRAPH', 'SOLE') then own when kind = 'INCISO' then host || '/INCISO:' || label end as key,
 case when kind = 'CHAPTER' then 'PREAMBLE' when kind in ('ARTICLE', 'PARAGRAPH', 'SOLE') then article when kind = 'INCISO' then host end as parent from law10),
law12 as (select *, case when live and not chrome and key is null then case when kind = 'INCISO' then 'INCISO_WITHOUT_PARENT' when kind is not null then 'PARAGRAPH_WITHOUT_ARTICLE' else 'UNMATCHED_TEXT' end end as why from law11),
law_rejects as (select doc_id, case when bool_and(sound) then min(case when why is not null then pos end) else -1 end as pos, case when bool_and(sound) then arg_min(why, pos) filter (why is not null) else 'NO_PREAMBLE' end as reason from law12 group by 1 having not bool_and(sound) or count(why) > 0),
law as (select * from law12 where doc_id not in (select doc_id from law_rejects))"""
LAW_ROWS = """joined as (select doc_id, opener, key, string_agg(text, chr(10) order by pos) as text, min(pos) as pos_start, max(pos) as pos_end, max(kind) as kind, max(label) as label, max(parent) as parent from law where key is not null group by all),
parts as (select doc_id, opener, 0 as sub, case when kind = 'ARTICLE' then parent else key end as stable_key, case when kind = 'ARTICLE' then 'CHAPTER:I' else parent end as parent_key, case when key = 'PREAMBLE' then 'DOCUMENT_ROOT' when kind = 'SOLE' then 'PARAGRAPH' else kind end as provision_type, case when key <> 'PREAMBLE' then label end as number_label, case when kind = 'ARTICLE' then null else text end as text, pos_start, pos_end from joined
 union all select doc_id, opener, 1, key, parent, 'CAPUT', null, text, pos_start, pos_end from joined where kind = 'ARTICLE'),
law_rows as (select doc_id, row_number() over (partition by doc_id order by opener, sub)::int as document_order, stable_key, parent_key, provision_type, number_label, text, 'IN_FORCE' as status, pos_start, pos_end, case when pos_start % 2 = 0 and pos_start > 1 then 'a' || pos_start end as anchor from parts)"""
FLAGS = LINES + """,
blocks as (select doc_id, pos + 2 as block, pos + 2 > 1 and (pos + 2) % 5 = 2 as in_table, text <> '' and (pos + 2) % 4 = 1 as any_struck, text <> '' and (pos + 2) % 4 = 1 as fully_struck, case when (pos + 2) % 2 = 0 then 'a' || (pos + 2) end as anchor from lines
 union all select distinct doc_id, 0, false, true, false, null from lines union all select distinct doc_id, 1, false, false, false, null from lines)"""


@query("C3_law_block_flags", sql(FLAGS, "select doc_id, block, in_table, any_struck, fully_struck from blocks union all select distinct doc_id, max(block) over (partition by doc_id) + 1, false, false, false from blocks"))
def _(s, d):
    """Also of the paragraph behind the page's end, which is cut off only later."""
    return structure.html_blocks(law_pages(s, d), "doc_id", only=("in_table", "any_struck", "fully_struck"))


@query("C4_block_anchors", sql(FLAGS, "select doc_id, block, anchor, anchor as first_anchor from blocks where anchor is not null"))
def _(s, d):
    return structure.html_blocks(law_pages(s, d), "doc_id", only=("anchors",)).select("doc_id", "block", F.explode("anchors").alias("anchor"), F.get("anchors", F.lit(0)).alias("first_anchor"))


@query("C7_law_provisions", sql(LAWS, LAW_ROWS, "select doc_id, document_order, stable_key, parent_key, provision_type, number_label, text, status, pos_start, pos_end from law_rows"))
def _(s, d):
    return law.parse_law(law_lines(s, d)).provisions.drop("anchor")


@query("C9_law_coverage", sql(LAWS, "select doc_id, pos, key as consumed_by, case when text = '' then 'EMPTY' when chrome then 'CHROME' end as ignored_reason from law"))
def _(s, d):
    return law.parse_law(law_lines(s, d)).coverage


@query("C10_law_rejects", sql(LAWS, "select doc_id, pos, reason from law_rejects"))
def _(s, d):
    return law.parse_law(law_lines(s, d)).rejected.select("doc_id", "pos", "reason")


KINDS = ("TITLE", "CHAPTER", "ARTICLE", "PARAGRAPH", "INCISO", "ALINEA", "ITEM")


def elements(s, d) -> DataFrame:
    """Line items as elements of an order's hierarchy: the first ones are headings and an article."""
    x = tree(s, d)
    kind = F.when(C("child_order") == 1, "TITLE").when(C("child_order") == 2, "CHAPTER").when(C("child_order") == 3, "ARTICLE").otherwise(F.element_at(F.array(*(F.lit(k) for k in KINDS[2:])), ((C("l_orderkey") + C("child_order") * C("child_order")) % 5 + 1).cast("int")))
    e = x.select(C("l_orderkey").alias("doc_id"), (C("child_order") - 1).alias("pos"), kind.alias("element_type"), (C("child_order") % 4).cast("string").alias("label"), F.when(C("child_order") % 6 != 0, F.concat(F.lit("t"), (C("child_order") % 3).cast("string"))).alias("text"), ((C("l_orderkey") + C("child_order")) % 7 == 0).alias("struck"))
    return structure.deep_hierarchy(e)


def deep_rows(s, d) -> DataFrame:
    x = elements(s, d)
    return x.withColumn("text_status", F.when(C("struck"), "UNRESOLVED").when(C("pos") % 5 == 4, "REVOKED").otherwise("CURRENT"))


ELEMENTS = TREE + """,
els as (select l_orderkey as doc_id, child_order - 1 as pos, case when child_order = 1 then 'TITLE' when child_order = 2 then 'CHAPTER' when child_order = 3 then 'ARTICLE' else (['ARTICLE', 'PARAGRAPH', 'INCISO', 'ALINEA', 'ITEM'])[(l_orderkey + child_order * child_order) % 5 + 1] end as element_type, (child_order % 4)::varchar as label, case when child_order % 6 <> 0 then 't' || (child_order % 3) end as text, (l_orderkey + child_order) % 7 = 0 as struck from tree),
lv as (select *, element_type || ':' || label as step, """ + ", ".join(f"max(case when element_type = '{k}' then pos end) over w as {k}_pos" for k in KINDS) + """ from els window w as (partition by doc_id order by pos)),
st as (select lv.*, """ + ", ".join(f"(case when {k}_pos is not null" + "".join(f" and ({a}_pos is null or {k}_pos > {a}_pos)" for a in (KINDS[:2] if k in KINDS[:2] else KINDS[2:])[: (KINDS[:2] if k in KINDS[:2] else KINDS[2:]).index(k)]) + f" then (select step from lv x where x.doc_id = lv.doc_id and x.pos = lv.{k}_pos) end) as {k}_step" for k in KINDS) + """ from lv),
deep0 as (select *, case element_type """ + " ".join(f"when '{k}' then concat_ws('/', '@root', " + ", ".join(f"{x}_step" for x in KINDS[: i + 1]) + ")" for i, k in enumerate(KINDS)) + """ end as identity_key from st),
deep as (select doc_id, pos, element_type, label, text, struck, row_number() over (partition by doc_id order by pos)::int as document_order, identity_key, regexp_extract(identity_key, '^(.*)/[^/]+$', 1) as parent_key, (element_type in ('PARAGRAPH', 'INCISO') and not contains(identity_key, '/ARTICLE:')) or (element_type = 'ALINEA' and not contains(identity_key, '/INCISO:')) or (element_type = 'ITEM' and not contains(identity_key, '/ALINEA:')) as orphan, case when struck then 'UNRESOLVED' when pos % 5 = 4 then 'REVOKED' else 'CURRENT' end as text_status from deep0)"""


@query("C11_deep_hierarchy", sql(ELEMENTS, "select doc_id, pos, element_type, document_order, identity_key, parent_key, orphan from deep"))
def _(s, d):
    return deep_rows(s, d).select("doc_id", "pos", "element_type", "document_order", "identity_key", "parent_key", "orphan")


def act_lines(s, d) -> DataFrame:
    """The lines of an order as a deep act, from the seventh on items: some have a rubric in place of an article, some no alínea to hang an item on."""
    o, n = C("l_orderkey"), C("child_order")
    line = (
        F.when(n == 1, "TÍTULO I").when(n == 2, F.when(o % 4 == 0, "DO TÍTULO").otherwise("Art. 1º Texto (Vide Lei 1) só."))
        .when(n == 3, "Art. 2º Outro.").when(n == 4, "§ 1º Parágrafo.").when(n == 5, "I - inciso").when(n == 6, F.when(o % 3 == 0, "texto").otherwise("a) alínea")).otherwise("1. item")
    )
    return tree(s, d).select(o.alias("doc_id"), (n - 1).alias("pos"), line.alias("text"), ((o % 5 == 0) & (n == 5)).alias("struck"))


ACTS = TREE + """,
al as (select l_orderkey as doc_id, child_order - 1 as pos, max(child_order) over (partition by l_orderkey) as n from tree),
ae as (select doc_id, -1 as pos, 0 as sub, 'DOCUMENT_ROOT' as element_type, null as label, 'root' as text, 'CURRENT' as text_status, '@root' as identity_key, null as parent_key from al where pos = 0
 union all select doc_id, 0, 0, 'TITLE', 'I', 'TÍTULO I' || case when doc_id % 4 = 0 and n > 1 then chr(10) || 'DO TÍTULO' else '' end, 'CURRENT', '@root/TITLE:I', '@root' from al where pos = 0
 union all select doc_id, 1, 0, 'ARTICLE', '1', 'Art. 1º', 'CURRENT', '@root/TITLE:I/ARTICLE:1', '@root/TITLE:I' from al where pos = 1 and doc_id % 4 <> 0
 union all select doc_id, 1, 1, 'CAPUT', null, 'Texto  só.', 'CURRENT', '@root/TITLE:I/ARTICLE:1/CAPUT:@caput', '@root/TITLE:I/ARTICLE:1' from al where pos = 1 and doc_id % 4 <> 0
 union all select doc_id, 1, 2, 'NOTE', null, '(Vide Lei 1)', 'NOT_APPLICABLE', null, '@root/TITLE:I/ARTICLE:1/CAPUT:@caput' from al where pos = 1 and doc_id % 4 <> 0
 union all select doc_id, 2, 0, 'ARTICLE', '2', 'Art. 2º', 'CURRENT', '@root/TITLE:I/ARTICLE:2', '@root/TITLE:I' from al where pos = 2
 union all select doc_id, 2, 1, 'CAPUT', null, 'Outro.', 'CURRENT', '@root/TITLE:I/ARTICLE:2/CAPUT:@caput', '@root/TITLE:I/ARTICLE:2' from al where pos = 2
 union all select doc_id, 3, 0, 'PARAGRAPH', '1', 'Parágrafo.', 'CURRENT', '@root/TITLE:I/ARTICLE:2/PARAGRAPH:1', '@root/TITLE:I/ARTICLE:2' from al where pos = 3
 union all select doc_id, 4, 0, 'INCISO', 'I', 'inciso', case when doc_id % 5 = 0 then 'UNRESOLVED' else 'CURRENT' end, '@root/TITLE:I/ARTICLE:2/PARAGRAPH:1/INCISO:I', '@root/TITLE:I/ARTICLE:2/PARAGRAPH:1' from al where pos = 4
 union all select doc_id, 5, 0, 'ALINEA', 'a', 'alínea', 'CURRENT', '@root/TITLE:I/ARTICLE:2/PARAGRAPH:1/INCISO:I/ALINEA:A', '@root/TITLE:I/ARTICLE:2/PARAGRAPH:1/INCISO:I' from al where pos = 5 and doc_id % 3 <> 0
 union all select doc_id, pos, 0, 'ITEM', '1', 'item', case when pos = n - 1 then 'CURRENT' else 'UNRESOLVED' end, '@root/TITLE:I/ARTICLE:2/PARAGRAPH:1/INCISO:I/ALINEA:A/ITEM:1', '@root/TITLE:I/ARTICLE:2/PARAGRAPH:1/INCISO:I/ALINEA:A' from al where pos >= 6 and doc_id % 3 <> 0)"""


@query("C11_act_elements", sql(ACTS, "select doc_id, row_number() over (partition by doc_id order by pos, sub)::int as document_order, element_type, label, text, text_status, case when element_type = 'NOTE' then 'REFERENCE_NOTE' else 'NORMATIVE' end as content_role, identity_key, parent_key from ae"))
def _(s, d):
    return deep.parse_act(act_lines(s, d)).elements.drop("pos")


@query("C11_act_coverage", sql(ACTS, "select doc_id, pos, case when pos >= 5 and doc_id % 3 = 0 then null when pos = 1 and doc_id % 4 = 0 then 'TITLE' else (['TITLE', 'ARTICLE', 'ARTICLE', 'PARAGRAPH', 'INCISO', 'ALINEA', 'ITEM'])[least(pos + 1, 7)] end as consumed_as, case when pos >= 5 and doc_id % 3 = 0 then 'UNCLASSIFIED' end as ignored_reason from al"))
def _(s, d):
    return deep.parse_act(act_lines(s, d)).coverage


def headed(s, d) -> DataFrame:
    n = (C("l_orderkey") * 3 + C("child_order") * C("child_order")) % 7
    return tree(s, d).select(C("l_orderkey").alias("doc_id"), C("child_order").alias("pos"), F.when(n == 0, "HEADING").when(n < 3, "NOTE").when(n < 6, "RUBRIC").otherwise("BODY").alias("class"))


HEADED = TREE + """,
hd as (select l_orderkey as doc_id, child_order as pos, case when n = 0 then 'HEADING' when n < 3 then 'NOTE' when n < 6 then 'RUBRIC' else 'BODY' end as class from (select *, (l_orderkey * 3 + child_order * child_order) % 7 as n from tree)),
h1 as (select *, max(case when class = 'HEADING' then pos end) over (partition by doc_id order by pos) as heading_pos from hd),
h2 as (select *, (select count(*) from h1 b where b.doc_id = a.doc_id and b.heading_pos = a.heading_pos and b.class <> 'HEADING' and b.class <> 'NOTE' and b.pos <= a.pos) as others, (select count(*) from h1 b where b.doc_id = a.doc_id and b.heading_pos = a.heading_pos and b.class = 'BODY' and b.pos <= a.pos) as ends from h1 a where class <> 'HEADING' and heading_pos is not null),
h3 as (select *, sum((class = 'NOTE' and others > 0)::int) over w as late, sum((class = 'RUBRIC')::int) over w as rubrics from h2 window w as (partition by doc_id, heading_pos order by pos)),
h4 as (select doc_id, pos, heading_pos, case when class = 'NOTE' and others = 0 then 'NOTE' when class = 'RUBRIC' and ends = 0 and late = 0 then case when rubrics = 1 then 'RUBRIC' else 'EXTRA_RUBRIC' end end as role from h3)"""


@query("C12_heading_lookahead", sql(HEADED, "select * from h4 where role is not null"))
def _(s, d):
    return structure.heading_lookahead(headed(s, d))


NOTED = "concat('Texto do artigo ', o_orderkey, case o_orderkey % 5 when 0 then ' (Redação dada pela Lei 1)' when 1 then ' (Incluído pela Lei 2) (Vide Lei 3)' when 2 then ' (Revogado pela Lei 4)' when 3 then ' (VETADO)' else '' end, ' .')"


def noted(s, d) -> DataFrame:
    return t(s, d, "orders").select(C("o_orderkey").alias("doc_id"), F.lit(0).alias("pos"), F.expr(NOTED).alias("text"), (C("o_orderkey") % 2 == 0).alias("struck"))


@query("C13_split_notes", f"""with n as (select o_orderkey as doc_id, {NOTED} as text from orders), l as (select doc_id, regexp_extract_all(text, '\\(((?:Redação|Incluído|Revogado|Vide|Vetado)[^()]*)\\)', 1) as l from n), x as (select doc_id, unnest(range(len(l)))::int as note_no, unnest(l) as note from l)
select doc_id, note_no, note, case when note like 'Redação%' then 'AMENDMENT' when note like 'Incluído%' then 'INCLUSION' when note like 'Revogado%' then 'REVOCATION' else 'REFERENCE' end as role from x""")
def _(s, d):
    return structure.split_notes(noted(s, d))[1].select("doc_id", "note_no", "note", "role")


@query("C13_split_texts", "select o_orderkey as doc_id, 'Texto do artigo ' || o_orderkey || case when o_orderkey % 5 = 3 then ' (VETADO)' else '' end || '.' as text from orders")
def _(s, d):
    return structure.split_notes(noted(s, d))[0].select("doc_id", "text")


@query("C14_text_status", "select o_orderkey as doc_id, case when o_orderkey % 5 = 2 then 'REVOKED' when o_orderkey % 5 = 3 then 'VETOED' when o_orderkey % 2 = 0 and o_orderkey % 5 in (0, 1) then 'HISTORICAL' when o_orderkey % 2 = 0 then 'UNRESOLVED' else 'CURRENT' end as text_status from orders")
def _(s, d):
    return structure.text_status(noted(s, d)).select("doc_id", "text_status")


@query("C15_identity_keys", sql(ELEMENTS, "select doc_id, identity_key, count(*) as n from deep where not orphan group by all"))
def _(s, d):
    return deep_rows(s, d).filter("not orphan").groupBy("doc_id", "identity_key").agg(F.count("*").alias("n"))


@query("C16_distinct_provisions", sql(ELEMENTS, "select doc_id, identity_key, arg_min(element_type, document_order) as element_type, arg_min(label, document_order) as label, arg_min(parent_key, document_order) as parent_key, count(*) as occurrences from deep group by all"))
def _(s, d):
    return structure.distinct_provisions(deep_rows(s, d))[0]


DEMOTED = "dem as (select *, case when text_status = 'CURRENT' and element_type not in ('ARTICLE', 'CAPUT') and row_number() over (partition by doc_id, identity_key, text_status order by document_order desc) > 1 then 'UNRESOLVED' else text_status end as new_status from deep)"


@query("C17_demote_current_collisions", sql(ELEMENTS, DEMOTED, "select doc_id, document_order, identity_key, new_status as text_status from dem"))
def demoted(s, d) -> DataFrame:
    return structure.demote_current_collisions(deep_rows(s, d)).select("doc_id", "document_order", "identity_key", "text_status")


@query("C18_document_order", "select l_orderkey as doc_id, l_linenumber, l_partkey, l_suppkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)::int as document_order from lineitem")
def _(s, d):
    x = t(s, d, "lineitem").select(C("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey", "l_suppkey")
    return structure.document_order(x, ("l_linenumber", "l_partkey", "l_suppkey"))


@query("C19_resolve_parents", sql(LINES, CLASSED, CARRIED, "ks as (select doc_id, stable_key, min(document_order) as o from flat group by all)", "select f.doc_id, f.document_order, k.o as parent_order from flat f left join ks k on k.doc_id = f.doc_id and k.stable_key = f.parent_key"))
def _(s, d):
    p = c7(s, d)
    keys = p.groupBy("doc_id", "stable_key").agg(F.min("document_order").alias("document_order"))
    e = p.select(C("doc_id").alias("version"), F.concat_ws("#", "stable_key", "document_order").alias("key"), "parent_key", "document_order")
    k = keys.select(C("doc_id").alias("version"), C("stable_key").alias("key"), F.lit(None).cast("string").alias("parent_key"), "document_order")
    r = structure.resolve_parents(e.union(k.withColumn("document_order", C("document_order"))))
    return r.filter("key like '%#%'").select(C("version").alias("doc_id"), "document_order", "parent_order")


@query("C20_ancestors", sql(ELEMENTS, "select doc_id, document_order, len(string_split(identity_key, '/')) - 1 as depth, array_to_string(list_transform(range(1, len(string_split(identity_key, '/'))), lambda n: array_to_string(list_slice(string_split(identity_key, '/'), 1, n), '/')), ',') as ancestors from deep"))
def _(s, d):
    return structure.ancestors(deep_rows(s, d), "identity_key").select("doc_id", "document_order", "depth", F.array_join("ancestors", ",").alias("ancestors"))


KEYED = LINES + ",\n" + CLASSED + ",\n" + CARRIED + """,
nodes as (select distinct doc_id, 'n' || document_order as key, 'n' || coalesce((select min(q.document_order) from flat q where q.doc_id = p.doc_id and q.stable_key = p.parent_key), case when document_order % 40 = 39 then document_order else 0 end) as parent_key from flat p)"""


def keyed(s, d) -> DataFrame:
    """Provisions by numbers that say nothing of their parents; some are their own parents."""
    p = c7(s, d)
    first = p.groupBy(C("doc_id").alias("f_doc"), C("stable_key").alias("f_key")).agg(F.min("document_order").alias("at"))
    rows = 2 * t(s, d, "lineitem").count()  # at most: an article is two provisions
    p, first = spread(p, rows, "doc_id", "parent_key"), spread(first, rows, "f_doc", "f_key")
    j = p.join(first, (C("doc_id") == C("f_doc")) & (C("parent_key") == C("f_key")), "left")
    at = F.coalesce("at", F.when(C("document_order") % 40 == 39, C("document_order")).otherwise(0))
    return j.select("doc_id", F.concat(F.lit("n"), "document_order").alias("key"), F.concat(F.lit("n"), at).alias("parent_key"))


@query("C20_ancestors_of_keys", "with recursive " + KEYED + """,
walk as (select doc_id, key, 0 as depth, '' as ancestors from nodes n where not exists (select 1 from nodes m where m.doc_id = n.doc_id and m.key = n.parent_key)
 union all select n.doc_id, n.key, depth + 1, case when w.ancestors = '' then w.key else w.ancestors || ',' || w.key end from nodes n join walk w on w.doc_id = n.doc_id and w.key = n.parent_key)
select doc_id, key, depth, ancestors from walk""")
def _(s, d):
    return structure.ancestors_of_keys(keyed(s, d))[0].select("doc_id", "key", "depth", F.array_join("ancestors", ",").alias("ancestors"))


@query("C21_validate_tree", sql(LINES, CLASSED, CARRIED, """g as (select doc_id, count(*) filter (text is null and provision_type not in ('ROOT', 'ARTICLE')) as b, count(*) filter (number_label is null and provision_type in ('ARTICLE', 'INCISO', 'PARAGRAPH')) as l from flat group by 1)""", "select doc_id, 'ROOT_NOT_FIRST' as rule, 1::bigint as n from g union all select doc_id, 'BLANK_TEXT', b from g where b > 0 union all select doc_id, 'NO_LABEL', l from g where l > 0"))
def _(s, d):
    return structure.validate_tree(c7(s, d))


@query("C22_article_projection", sql(ELEMENTS, "arts as (select distinct doc_id, identity_key as article from deep where element_type = 'ARTICLE' and label in ('1', '3'))", "select doc_id, article, element_type, count(*) as n from arts join (select doc_id, element_type, regexp_extract(identity_key, '^(.*?/ARTICLE:[^/]+)', 1) as article, identity_key from deep where contains(identity_key, '/ARTICLE:')) using (doc_id, article) where identity_key <> article group by all"))
def _(s, d):
    return structure.article_projection(deep_rows(s, d), ["1", "3"])


# --- audits over these structures ---


@query("J4_structure_counters", sql(ELEMENTS, "x as (select *, regexp_extract(parent_key, '([A-Z]+):[^/]*$', 1) as pt, (len(string_split(identity_key, '/')) - 1)::varchar as depth from deep)", "select 'TYPE' as counter, element_type as a, null::varchar as b, count(*) as n from x group by all union all select 'STATUS', element_type, text_status, count(*) from x group by all union all select 'EDGE', pt, element_type, count(*) from x group by all union all select 'DEPTH', depth, null, count(*) from x group by all"))
def _(s, d):
    return audit.structure_counters(deep_rows(s, d))


@query("J4_act_counters", sql(ACTS, "r as (select *, case when element_type = 'NOTE' then 'REFERENCE_NOTE' else 'NORMATIVE' end as role, case when parent_key = '@root' then 'DOCUMENT_ROOT' else regexp_extract(parent_key, '([A-Z_]+):[^/]*$', 1) end as above from ae)",
    """select doc_id, 'NOTE_PARENT' as counter, above as a, count(*) as n from r where element_type = 'NOTE' group by all union all select doc_id, 'NOTE_ARTICLE', regexp_extract(parent_key, '/ARTICLE:([^/]+)', 1), count(*) from r where element_type = 'NOTE' group by all
 union all select doc_id, 'ROLE', role, count(*) from r group by all union all select doc_id, 'DUPLICATE_KEY', identity_key, count(*) from r where identity_key is not null group by all having count(*) > 1 union all select doc_id, 'ODD_LABEL', label, count(*) from r where element_type = 'ARTICLE' and not regexp_full_match(label, '[0-9]+') group by all"""))
def _(s, d):
    return audit.act_counters(deep.parse_act(act_lines(s, d)).elements)


@query("J5_deepest_path", sql(ELEMENTS, "select doc_id, arg_max(identity_key, (len(string_split(identity_key, '/'))) * 1000 - document_order) as deepest_path, max(len(string_split(identity_key, '/')) - 1) as depth from deep group by 1"))
def _(s, d):
    return audit.deepest_path(deep_rows(s, d))


@query("J6_duplicate_groups", sql(ELEMENTS, "g as (select doc_id, identity_key, count(*) as n, count(*) filter (text_status = 'CURRENT') as current, count(distinct coalesce(text, '')) as texts from deep group by all having count(*) > 1)", "select *, case when current = 1 then 'HISTORICAL_REDACTION' when texts = 1 then 'PARSER_DUPLICATION' else 'AMBIGUITY' end as kind from g"))
def _(s, d):
    return audit.duplicate_groups(deep_rows(s, d))


EDGES = [("TITLE", "CHAPTER"), ("CHAPTER", "ARTICLE"), ("ARTICLE", "PARAGRAPH"), ("ARTICLE", "INCISO"), ("PARAGRAPH", "INCISO"), ("INCISO", "ALINEA"), ("ALINEA", "ITEM"), ("", "TITLE")]
FOUND = "pt as (select *, regexp_extract(parent_key, '([A-Z]+):[^/]*$', 1) as parent_type from deep), fnd as (select doc_id, 'ORPHAN' as code, 'BLOCKER' as severity, pos as block from pt where orphan union all select doc_id, 'HIERARCHY_EDGE', 'ERROR', pos from pt where not orphan and parent_type || '>' || element_type not in (" + ", ".join(f"'{a}>{b}'" for a, b in EDGES) + ") union all select doc_id, 'BLANK_TEXT', 'WARNING', pos from pt where text is null)"


@query("J7_findings", sql(ELEMENTS, FOUND, "select * from fnd"))
def j7(s, d) -> DataFrame:
    return audit.findings(deep_rows(s, d), EDGES)


def damaged_act(s, d):
    """Deep acts whose elements have one kind of damage for each remainder of 13."""
    act = deep.parse_act(act_lines(s, d))
    act = act._replace(elements=cut(act.elements), coverage=cut(act.coverage))
    k, kind = C("doc_id") % 13, C("element_type")
    hit = lambda n, what: (k == n) & (kind == what)
    e = act.elements.withColumns({
        "text": F.when(hit(0, "CAPUT"), "").when(hit(11, "INCISO"), "outro").when(hit(12, "CAPUT") & (C("pos") == 2), "Art. 2º Outro.").otherwise(C("text")),
        "identity_key": F.when(hit(1, "NOTE"), "@root/NOTE:x").when(hit(2, "INCISO"), F.concat("identity_key", F.lit("X"))).when(hit(10, "ARTICLE"), "@root/TITLE:I/ARTICLE:1").otherwise(C("identity_key")),
        "parent_key": F.when(hit(4, "PARAGRAPH"), "@root/TITLE:I").otherwise(C("parent_key")),
        "text_status": F.when(hit(5, "ITEM") | hit(8, "NOTE"), "CURRENT").when(hit(9, "ALINEA"), "REVOKED").otherwise(C("text_status")),
        "document_order": C("document_order") + (k == 6).cast("int"),
        "pos": C("pos") + F.when(hit(7, "ALINEA"), 1000).otherwise(0),
        "element_type": F.when(hit(3, "PARAGRAPH"), "ITEM").otherwise(kind),
    })
    return e, act_lines(s, d), act.coverage, structure.distinct_provisions(act.elements.filter("identity_key is not null"))[0]


DAMAGED = ACTS + """,
lt as (select doc_id, pos, doc_id % 5 = 0 and pos = 4 as struck, case pos when 0 then 'TÍTULO I' when 1 then case when doc_id % 4 = 0 then 'DO TÍTULO' else 'Art. 1º Texto (Vide Lei 1) só.' end when 2 then 'Art. 2º Outro.' when 3 then '§ 1º Parágrafo.' when 4 then 'I - inciso' when 5 then case when doc_id % 3 = 0 then 'texto' else 'a) alínea' end else '1. item' end as line from al),
oe as (select * replace (greatest(pos, 0) as pos), doc_id % 13 as k, row_number() over (partition by doc_id order by pos, sub) as o, case when element_type = 'NOTE' then 'REFERENCE_NOTE' else 'NORMATIVE' end as role from ae),
fe as (select doc_id, pos + case when k = 7 and element_type = 'ALINEA' then 1000 else 0 end as pos, case when k = 3 and element_type = 'PARAGRAPH' then 'ITEM' else element_type end as element_type, label,
 case when k = 0 and element_type = 'CAPUT' then '' when k = 11 and element_type = 'INCISO' then 'outro' when k = 12 and element_type = 'CAPUT' and pos = 2 then 'Art. 2º Outro.' else text end as text,
 case when (k = 5 and element_type = 'ITEM') or (k = 8 and element_type = 'NOTE') then 'CURRENT' when k = 9 and element_type = 'ALINEA' then 'REVOKED' else text_status end as text_status, role,
 case when k = 1 and element_type = 'NOTE' then '@root/NOTE:x' when k = 2 and element_type = 'INCISO' then identity_key || 'X' when k = 10 and element_type = 'ARTICLE' then '@root/TITLE:I/ARTICLE:1' else identity_key end as identity_key,
 case when k = 4 and element_type = 'PARAGRAPH' then '@root/TITLE:I' else parent_key end as parent_key, o + case when k = 6 then 1 else 0 end as o from oe),
pv as (select doc_id, identity_key, any_value(element_type) as ptype, any_value(parent_key) as pparent from ae where identity_key is not null group by all),
fx as (select fe.*, lt.line, lt.struck, pv.ptype, pv.pparent, lag(coalesce(fe.identity_key, parent_key)) over w as before, row_number() over w as rn, sum((element_type = 'ARTICLE')::int) over w as art,
 case when parent_key = '@root' then 'DOCUMENT_ROOT' else regexp_extract(parent_key, '([A-Z_]+):[^/]*$', 1) end as above
 from fe left join lt using (doc_id, pos) left join pv on pv.doc_id = fe.doc_id and pv.identity_key = fe.identity_key window w as (partition by fe.doc_id order by o, fe.pos, element_type)),
arts as (select a.doc_id, a.pos, a.label, a.o, a.identity_key, count(c.element_type) as caputs, count(*) filter (c.text <> '' and c.pos = a.pos) as good, max(c.text_status) as st
 from fx a left join fx c on c.doc_id = a.doc_id and c.art = a.art and c.element_type = 'CAPUT' and c.parent_key = a.identity_key where a.element_type = 'ARTICLE' group by all)"""
J7_PARTS = {
    "ARTICLE_CAPUT_INVALID": "select doc_id, pos as block, 'ARTICLE' as element_type, label, 'BLOCKER' as severity, caputs::varchar as detail from arts where caputs <> 1 or good <> 1",
    "NOTE_WITH_IDENTITY": "select doc_id, pos, element_type, label, 'BLOCKER', null from fx where element_type = 'NOTE' and identity_key is not null",
    "UNMATCHED_NORMATIVE_OCCURRENCE": "select doc_id, pos, element_type, label, 'BLOCKER', identity_key from fx where element_type <> 'NOTE' and ptype is null",
    "ACT_OR_TYPE_IDENTITY_MISMATCH": "select doc_id, pos, element_type, label, 'BLOCKER', identity_key from fx where element_type <> 'NOTE' and ptype <> element_type",
    "IDENTITY_PARENT_MISMATCH": "select doc_id, pos, element_type, label, 'BLOCKER', identity_key from fx where element_type <> 'NOTE' and ptype is not null and pparent is distinct from parent_key",
    "MULTIPLE_CURRENT_PER_VERSION_PROVISION": "select doc_id, null, null, null, 'BLOCKER', identity_key from fx where element_type <> 'NOTE' and ptype is not null and text_status = 'CURRENT' group by doc_id, identity_key having count(*) > 1",
    "DOCUMENT_ORDER_INVALID": "select doc_id, null, null, null, 'BLOCKER', null from fx group by doc_id having not bool_and(o = rn and (element_type = 'DOCUMENT_ROOT' or coalesce(before = parent_key or starts_with(before, parent_key || '/'), false)))",
    "PROVENANCE_INVALID": "select doc_id, null, null, null, 'BLOCKER', count(*)::varchar from fx where line is null group by doc_id",
    "HIERARCHY_EDGE_UNEXPECTED": "select doc_id, pos, element_type, label, 'BLOCKER', above || '>' || element_type from fx where parent_key is not null and above || '>' || element_type not in (" + ", ".join(f"'{a}>{b}'" for a, bs in act_audit.EDGES.items() for b in bs) + ")",
    "NOTE_INVALID": "select doc_id, pos, element_type, label, 'BLOCKER', null from fx where element_type = 'NOTE' and (text_status <> 'NOT_APPLICABLE' or trim(text) = '' or role = 'NORMATIVE' or parent_key is null)",
    "REVOKED_WITHOUT_TEXTUAL_EVIDENCE": "select doc_id, pos, element_type, label, 'BLOCKER', null from fx where text_status = 'REVOKED' and not coalesce(regexp_matches(line, 'Revogad[oa]', 'i'), false)",
    "HISTORICAL_OCCURRENCES_RECONCILED": "select doc_id, arg_min(pos, o), 'ARTICLE', arg_min(label, o), 'INFO', 'SAME_LEGAL_DEVICE_HISTORICAL_REDACTION' from arts group by doc_id, identity_key having count(*) > 1 and bool_or(coalesce(st in ('HISTORICAL', 'REVOKED', 'UNRESOLVED'), false))",
    "DUPLICATE_ARTICLE_STRUCTURAL_KEY": "select doc_id, arg_min(pos, o), 'ARTICLE', arg_min(label, o), 'BLOCKER', case when count(distinct pos) < count(*) then 'PARSER_DUPLICATION' else 'STRUCTURAL_AMBIGUITY' end from arts group by doc_id, identity_key having count(*) > 1 and not bool_or(coalesce(st in ('HISTORICAL', 'REVOKED', 'UNRESOLVED'), false))",
    "IGNORED_BLOCK_DIAGNOSED": "select doc_id, pos, null, null, 'WARNING', 'REQUIRES_REVIEW' from lt where doc_id % 3 = 0 and pos >= 5",
    "UNRESOLVED_PRESERVED": "select doc_id, null, null, null, 'WARNING', concat_ws(',', case when count(*) filter (struck) > 0 then 'FULL_STRIKE_WITHOUT_DECISIVE_MARKER=' || count(*) filter (struck) end, case when count(*) filter (not coalesce(struck, false)) > 0 then 'UNCLASSIFIED_STATUS_PATTERN=' || count(*) filter (not coalesce(struck, false)) end) from fx where text_status = 'UNRESOLVED' group by doc_id",
    "TEXT_NOT_IN_SOURCE": "select doc_id, pos, element_type, label, 'BLOCKER', null from fx where doc_id % 13 = 11 and element_type = 'INCISO'",
    "SOURCE_TEXT_OVERLAP": "select doc_id, pos, element_type, label, 'WARNING', null from fx where doc_id % 13 = 12 and element_type = 'CAPUT' and pos = 2",
    "SOURCE_TEXT_UNCLAIMED": "select doc_id, pos, null, null, 'WARNING', null from fx where (doc_id % 13 = 11 and element_type = 'INCISO') or (doc_id % 13 = 12 and element_type = 'CAPUT' and pos = 2) or (doc_id % 13 = 0 and element_type = 'CAPUT')",
}


@query("J7_act_findings", sql(DAMAGED, " union all ".join(f"select *, '{code}' as code from ({body}) q(doc_id, block, element_type, label, severity, detail)" for code, body in J7_PARTS.items())))
def _(s, d):
    return act_audit.act_findings(*damaged_act(s, d))


@query("J8_diagnose_unclassified", r"""select doc_id, pos, kind, case when kind in ('NUMBERED', 'HEADING_LIKE') then 'ERROR' when kind = 'EMPTY' then 'INFO' else 'WARNING' end as severity from (select doc_id, i as pos, case when not regexp_matches(x, '\S') then 'EMPTY' when regexp_matches(x, '^\s*\(') then 'NOTE_LIKE' when regexp_matches(x, '^\s*\d+[.)-]') then 'NUMBERED' when regexp_matches(x, '^[^a-zà-ÿ]*[A-ZÀ-Þ][^a-zà-ÿ]*$') then 'HEADING_LIKE' when regexp_matches(x, '[.;:]\s*$') then 'SENTENCE' else 'FRAGMENT' end as kind from (select doc_id, unnest(range(len(l)))::int as i, unnest(l) as x from (select doc_id, string_split(text, chr(10)) as l from documents)))""")
def _(s, d):
    b = t(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return audit.diagnose_unclassified(b).select("doc_id", "pos", "kind", "severity")


@query("J9_unresolved_causes", sql(ELEMENTS, DEMOTED, "select case when struck then 'STRUCK_WITHOUT_MARKER' else 'COLLISION' end as cause, count(*) as n from dem where new_status = 'UNRESOLVED' group by 1"))
def _(s, d):
    return audit.unresolved_causes(structure.demote_current_collisions(deep_rows(s, d)))


@query("J9_strike_matrix", sql(ELEMENTS, "select struck, count(*) filter (text_status = 'CURRENT') as current, count(*) filter (text_status = 'UNRESOLVED') as unresolved, count(*) filter (text_status = 'REVOKED') as revoked from deep group by 1"))
def _(s, d):
    return audit.strike_matrix(deep_rows(s, d), ["CURRENT", "UNRESOLVED", "REVOKED"])


@query("J9_block_reuse", sql(LINES, CLASSED, CARRIED, "select doc_id, pos, count(*) as n, string_agg(distinct provision_type, '+' order by provision_type) as types, string_agg(distinct provision_type, '+' order by provision_type) <> 'ARTICLE+CAPUT' as unusual from flat group by all having count(*) > 1"))
def _(s, d):
    return audit.block_reuse(c7(s, d))


@query("J10_coverage_summary", sql(LINES, CLASSED, CARRIED, "used as (select distinct doc_id, pos, 1 as u from flat), cv as (select doc_id, pos, class, u from classed left join used using (doc_id, pos))", "select doc_id, count(*) as blocks, count(u) as consumed, count(*) - count(u) as ignored, round(count(u) / count(*), 6) as ratio, count(*) filter (u is null and class = 'BLANK') as empty from cv group by 1"))
def _(s, d):
    return audit.coverage_summary(c9(s, d))


@query("J11_gate", sql(ELEMENTS, FOUND, "select doc_id, case when bool_or(severity = 'BLOCKER') then 'BLOCKED' else 'PASSED' end as status, count(*) as findings from fnd group by 1"))
def _(s, d):
    return audit.gate(j7(s, d))
