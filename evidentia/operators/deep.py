"""Deeply nested acts: from lines to elements, where what a line is depends on what is open above it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import normalize_matching

# Lines of a deep act. Groups: label, text.
DIVISIONS = ("TITLE", r"(?iu)^TÍTULO\s+([IVXLCDM]+(?:-[A-Z])?)$"), ("CHAPTER", r"(?iu)^CAPÍTULO\s+([IVXLCDM]+(?:-[A-Z])?)$"), ("SECTION", r"(?iu)^SEÇÃO\s+([IVXLCDM]+(?:-[A-Z])?)$"), ("SUBSECTION", r"(?iu)^SUBSEÇÃO\s+([IVXLCDM]+(?:-[A-Z])?)$")
ARTICLE = r"(?ius)^(\s*Art\.\s*(\d+[º°.]?(?:\s*-\s*[A-Z])?)\s*)(.*)$"
LINES = (
    ("SOLE_PARAGRAPH", r"(?ius)^\s*Parágrafo\s+(único)[.:]?\s*(.*)$"),
    ("PARAGRAPH", r"(?ius)^\s*§\s*(\d+[º°.]?(?:\s*-\s*[A-Z])?)\s*(.*)$"),
    ("INCISO", r"(?s)^\s*([IVXLCDM]+(?:-?[A-Z])?)(?:\s*[-–—]\s*|\s+)(\S.*)$"),
    ("ALINEA", r"(?is)^\s*([a-z])\s*\)\s*(.*)$"),
    ("ITEM", r"(?s)^\s*(\d+)\s*[.)-]\s*(.*)$"),
)
NOTE = r"(?iu)\([^()]*(?:Emenda Constitucional|Vide\b|Regulamento|Vigência|Produção de efeito)[^()]*\)"
NOTE_LINE = r"(?iu)Este texto não substitui|Vigência"
RUBRIC = r"^(?:do|da|dos|das)\s+"
PREAMBLE_LINE = "preâmbulo"
LEVELS = tuple(name for name, _ in DIVISIONS)
OPENED = ("ARTICLE", "PARAGRAPH", "INCISO", "ALINEA")


class Act(NamedTuple):
    """What one pass over lines gives. A document is in ``elements`` and ``coverage`` or in ``rejected``."""

    elements: DataFrame
    coverage: DataFrame
    rejected: DataFrame


def _clean(label: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(F.trim(label), "[º°.]", ""), r"\s*-\s*", "-"))


def _token(label: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(label), r"\s+", " "))


def _step(name: str, label: Column) -> Column:
    return F.concat(F.lit(f"/{name}:"), _token(label))


def classify_lines(blocks: DataFrame) -> DataFrame:
    """Lines (doc_id, pos, text, struck) with ``kind``, ``label``, ``body`` and, of lines that a heading takes, ``role``; ``head`` is
    the last heading (pos, kind, label), ``level`` and ``level_label`` are those of the division a line opens, and a column for each
    of LEVELS and OPENED holds the last one opened (pos, step).

    First what a line looks like by itself; then headings take the notes right below them, and the rubric lines behind
    these, whatever they look like; then a numbered item is one only while an alínea is open, which articles, paragraphs
    and incisos close. A preamble line takes the next one. All windows have one order, so lines are sorted once; instead of counts
    within a heading they look at the last place where something was, and whether it is behind the heading.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    last = lambda x: F.last(x, ignorenulls=True).over(w)
    text, pos = F.col("text"), F.col("pos")
    b = blocks.withColumn("text", F.coalesce(text, F.lit(""))).withColumn("match", F.coalesce(normalize_matching(text), F.lit("")))
    looks = (("ARTICLE", ARTICLE), *LINES)
    division = look = label = body = F.lit(None).cast("string")
    for name, pattern in reversed(DIVISIONS):
        division = F.when(F.col("match").rlike(pattern), name).otherwise(division)
    for name, pattern in reversed(looks):
        look = F.when(text.rlike(pattern), name).otherwise(look)
    b = b.withColumns({"division": division, "look": look, "opens": F.col("match") == PREAMBLE_LINE, "note_like": F.trim(text).rlike(f"^{NOTE}$") | text.rlike(NOTE_LINE), "rubric_like": F.col("match").rlike(RUBRIC)})
    for name, pattern in looks:
        at = 2 if name == "ARTICLE" else 1
        own = F.regexp_extract(text, pattern, at)
        own = {"SOLE_PARAGRAPH": F.lit("único"), "PARAGRAPH": _clean(own), "ARTICLE": _clean(own), "INCISO": F.upper(own)}.get(name, own)
        label, body = F.when(F.col("look") == name, own).otherwise(label), F.when(F.col("look") == name, F.regexp_extract(text, pattern, at + 1)).otherwise(body)
    for name, pattern in DIVISIONS:
        label = F.when(F.col("division") == name, F.regexp_extract("match", pattern, 1)).otherwise(label)
    b = b.withColumns({"label": label, "body": body}).drop("match")
    b = b.withColumn("after", F.coalesce(F.lag("opens").over(w), F.lit(False)) & ~F.coalesce(F.lag("opens", 2).over(w), F.lit(False))).withColumn("opens", F.col("opens") & ~F.col("after"))
    free = ~F.col("opens") & ~F.col("after")
    b = b.withColumn("division", F.when(free, F.col("division")))
    opened = F.col("division").isNotNull()
    b = b.withColumns({"head": last(F.when(opened, F.struct(pos.alias("pos"), F.col("division").alias("kind"), F.upper("label").alias("label")))), "other_pos": last(F.when(~opened & ~F.col("note_like"), pos))})
    below = F.col("head").isNotNull() & ~opened
    behind = lambda c: F.coalesce(F.col(c) > F.col("head.pos"), F.lit(False))
    b = b.withColumn("past_notes", below & behind("other_pos"))
    rubric = F.col("past_notes") & F.col("rubric_like")
    b = b.withColumns({"end_pos": last(F.when(F.col("past_notes") & ~F.col("rubric_like"), pos)), "rubric_pos": F.last(F.when(rubric, pos), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    role = F.when(below & ~F.col("past_notes"), "NOTE").when(below & ~behind("end_pos"), F.when(behind("rubric_pos"), "ALTERNATIVE").otherwise("RUBRIC"))
    b = b.withColumn("role", role)
    b = b.withColumn("seen", F.when(F.col("role").isNull() & ~opened & free, F.col("look")))
    alternative = F.col("role") == "ALTERNATIVE"
    b = b.withColumns({"level": F.coalesce("division", F.when(alternative, F.col("head.kind"))), "level_label": F.when(opened, F.upper("label")).when(alternative, F.col("head.label"))})
    opening = lambda cond, x, label: last(F.when(cond, F.struct(pos.alias("pos"), _step(x, F.col(label)).alias("step"))))
    numbered = F.when(F.col("seen") == "SOLE_PARAGRAPH", "PARAGRAPH").otherwise(F.col("seen"))
    b = b.withColumns({x: opening(F.col("level") == x, x, "level_label") for x in LEVELS} | {x: opening(numbered == x, x, "label") for x in OPENED})
    kind = (
        F.when(F.col("opens"), "PREAMBLE").when(F.col("after"), "PREAMBLE_TEXT").when(opened, F.col("division")).when(F.col("role").isNotNull(), F.lit("OF_HEADING"))
        .when((F.col("seen") == "ITEM") & ~_later("ALINEA", *OPENED[:-1]), F.when(F.col("note_like"), "NOTE").otherwise("UNCLASSIFIED"))
        .when(F.col("seen") == "SOLE_PARAGRAPH", "PARAGRAPH").when(F.col("seen").isNotNull(), F.col("seen"))
        .when(F.col("note_like"), "NOTE").when(F.trim(text) == "", "EMPTY").otherwise("UNCLASSIFIED")
    )
    return b.select(*blocks.columns, kind.alias("kind"), "label", "body", "role", "head", "level", "level_label", *LEVELS, *OPENED)


def status(text: Column, struck: Column) -> Column:
    changed = text.rlike("(?iu)Redação dada|Incluído")
    return F.when(text.rlike("(?iu)Revogad[oa]"), "REVOKED").when(struck & changed, "HISTORICAL").when(struck, "UNRESOLVED").otherwise("CURRENT")


def note_role(text: Column) -> Column:
    return F.when(text.rlike("(?iu)Emenda Constitucional|Revogad|Incluído|Redação dada"), "AMENDMENT_NOTE").when(text.rlike("(?iu)Vide|Regulamento"), "REFERENCE_NOTE").otherwise("EDITORIAL_NOTE")


def parse_act(blocks: DataFrame, root_text: str = "root") -> Act:
    """Elements of deep acts in the order of their tree, with identity, status and notes; coverage of every line; rejected documents.

    ``blocks`` has doc_id, pos, text, struck. Headings clear lower headings only and leave the article open; an article has one
    opening text; paragraphs hang on the article, incisos on paragraph or article, alíneas on the inciso, items on the
    alínea. Notes in a line's text, and note lines, are elements of their own without identity. The key of an element is its
    parent's with its own step, as both were when the line came. A line whose parent is not open rejects its document, as
    does a key with two different labels. All windows share one partitioning by document.

    All is worked out on lines, which become elements last; they are sorted by place, by key, and by their place in the tree. A line
    carries places and one step of each open kind, its keys are put together from these: what is open still hangs
    on what it hung on when it came, only an article keeps the key of headings that may be closed by now. The tree's order is that of
    places but for lines below an article that come behind a later heading, and for preambles, which hang on the root: lines go by the outermost
    heading, then by article, or themselves where they are below none, then by place.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    doc = Window.partitionBy("doc_id")
    c = classify_lines(blocks.select("doc_id", "pos", "text", F.coalesce("struck", F.lit(False)).alias("struck")))
    last = lambda x: F.last(x, ignorenulls=True).over(w)
    kind, pos, text = F.col("kind"), F.col("pos"), F.col("text")
    none = F.lit(None).cast("string")
    late = {}
    for i, x in enumerate(LEVELS):
        late[x] = _later(x, *LEVELS[:i])
    c = c.withColumns({"top": F.coalesce(*(F.when(late[x], F.col(f"{x}.pos")) for x in LEVELS), pos)} | {x: F.when(late[x], F.col(f"{x}.step")).otherwise("") for x in LEVELS})
    c = c.withColumn("in_key", F.concat(F.lit("@root"), *LEVELS))
    c = c.withColumns({
        "art": last(F.when(kind == "ARTICLE", F.struct(pos.alias("pos"), F.concat("in_key", F.col("ARTICLE.step")).alias("key"), F.col("top").alias("top")))),
        "next_text": F.when(kind == "PREAMBLE", F.lead("text").over(w)), "next_struck": F.when(kind == "PREAMBLE", F.lead("struck").over(w)),
    })
    art, put = F.col("art"), lambda a, base: F.concat(base, F.col(f"{a}.step"))
    c = c.withColumn("par_key", F.when(_later("PARAGRAPH", "ARTICLE"), put("PARAGRAPH", art["key"])))
    c = c.withColumns({"host": F.coalesce("par_key", "art.key"), "PARAGRAPH": F.when(F.col("par_key").isNotNull(), F.col("PARAGRAPH"))})
    c = c.withColumn("inc_key", F.when(_later("INCISO", "ARTICLE", "PARAGRAPH"), put("INCISO", F.col("host"))))
    c = c.withColumn("INCISO", F.when(F.col("inc_key").isNotNull(), F.col("INCISO")))
    c = c.withColumn("ali_key", F.when(_later("ALINEA", *OPENED[:-1]), put("ALINEA", F.col("inc_key")))).drop(*OPENED)
    needs = {"PARAGRAPH": "art.key", "INCISO": "art.key", "ALINEA": "inc_key", "ITEM": "ali_key"}
    why = none
    for name, parent in needs.items():
        why = F.when((kind == name) & F.col(parent).isNull(), f"{name}_WITHOUT_PARENT").otherwise(why)
    c = c.withColumn("reject", F.min(F.when(why.isNotNull(), F.struct(pos.alias("pos"), why.alias("reason")))).over(doc))
    head_parent = F.lit(None).cast("string")
    for i, x in enumerate(LEVELS):  # of what such a heading hangs on
        head_parent = F.when(F.col("level") == x, F.concat(F.lit("@root"), *LEVELS[:i])).otherwise(head_parent)
    parent = (
        F.when(F.col("level").isNotNull(), head_parent).when(kind == "ARTICLE", F.col("in_key")).when(kind == "PARAGRAPH", art["key"]).when(kind == "INCISO", F.col("host"))
        .when(kind == "ALINEA", F.col("inc_key")).when(kind == "ITEM", F.col("ali_key")).when(kind == "PREAMBLE", F.lit("@root"))
        .when(kind == "NOTE", F.coalesce("ali_key", "inc_key", "par_key", "art.key", "in_key")).when(F.col("role") == "NOTE", F.col("in_key"))
    )
    key = (
        F.when(F.col("level").isNotNull(), F.concat("parent", F.lit("/"), "level", F.lit(":"), _token(F.col("level_label")))).when(kind == "ARTICLE", art["key"]).when(kind == "PARAGRAPH", F.col("par_key"))
        .when(kind == "INCISO", F.col("inc_key")).when(kind == "ALINEA", F.col("ali_key")).when(kind == "ITEM", F.concat("ali_key", _step("ITEM", F.col("label")))).when(kind == "PREAMBLE", F.lit("@root/PREAMBLE:@preamble"))
        .when(F.col("role") == "RUBRIC", F.col("in_key"))  # the heading's own
    )
    has = F.col("level").isNotNull() | kind.isin("ARTICLE", "PARAGRAPH", "INCISO", "ALINEA", "ITEM", "PREAMBLE")
    below = kind.isin("ARTICLE", "PARAGRAPH", "INCISO", "ALINEA", "ITEM", "NOTE") & art["key"].isNotNull()
    consumed = F.when(kind.isin("EMPTY", "UNCLASSIFIED"), None).when(kind == "PREAMBLE_TEXT", "PREAMBLE").when(kind == "OF_HEADING", F.when(F.col("role") == "NOTE", "NOTE").otherwise(F.coalesce("level", "head.kind"))).otherwise(kind)
    c = c.withColumn("parent", parent).select(
        "doc_id", "pos", "text", "struck", "kind", "role", "body", "next_text", "next_struck", "reject", "parent", key.alias("key"), consumed.alias("consumed_as"),
        F.when(has, F.coalesce("level", "kind")).alias("element_type"), F.when(F.col("level").isNotNull(), F.col("level_label")).when(has & (kind != "PREAMBLE"), F.col("label")).alias("label"),
        F.when(below, art["top"]).when(kind == "PREAMBLE", pos).otherwise(F.col("top")).alias("top"), F.when(below, art["pos"]).when(F.col("role") == "RUBRIC", F.col("head.pos")).otherwise(pos).alias("anchor"),
    )

    # by key: what the first rubric adds to its heading, which is right behind it; later texts that are in force; labels that differ
    by_key = Window.partitionBy("doc_id", "key").orderBy(F.desc("top"), F.desc("anchor"), F.desc("pos"))
    g = c.filter("reject is null")
    rubric = F.lag(F.when(F.col("role") == "RUBRIC", F.struct("anchor", "text", "struck"))).over(by_key)
    g = g.withColumn("rubric", rubric).withColumn("rubric", F.when(kind.isin(*LEVELS) & (F.col("rubric.anchor") == pos), F.col("rubric")))
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    said = F.when(F.col("rubric").isNotNull(), F.col("rubric.text")).when(kind == "PREAMBLE", F.coalesce("next_text", "text")).otherwise(text)
    crossed = F.when(F.col("rubric").isNotNull(), F.col("rubric.struck")).when(kind == "PREAMBLE", F.coalesce("next_struck", "struck")).otherwise(F.col("struck"))
    g = g.withColumn("text_status", status(said, crossed))
    current = F.col("element_type").isNotNull() & (F.col("text_status") == "CURRENT")
    identity = F.when(F.col("element_type").isNotNull(), F.struct("element_type", F.coalesce("label", F.lit("")).alias("label"), "parent"))
    same = Window.partitionBy("doc_id", "key")
    g = g.withColumns({"later": F.sum(F.when(current, 1)).over(by_key), "odd": F.min(identity).over(same) != F.max(identity).over(same)})
    g = g.withColumn("bad", F.max(F.coalesce("odd", F.lit(False))).over(doc))
    g = g.withColumn("text_status", F.when(current & (F.col("later") > 1) & (F.col("element_type") != "ARTICLE"), "UNRESOLVED").otherwise(F.col("text_status")))
    good = g.filter(~F.col("bad"))

    lower = kind.isin("PARAGRAPH", "INCISO", "ALINEA", "ITEM")
    nothing = F.array().cast("array<string>")
    e = good.withColumn("found", F.when(lower | (kind == "ARTICLE"), F.regexp_extract_all("body", F.lit(NOTE), F.lit(0))).otherwise(nothing))
    by_tree = Window.partitionBy("doc_id").orderBy("top", "anchor", "pos")
    is_note = (kind == "NOTE") | F.coalesce(F.col("role") == "NOTE", F.lit(False))
    e = e.withColumn("number", F.when(kind == "ARTICLE", 2).when(F.col("element_type").isNotNull() | is_note, 1).otherwise(0) + F.size("found"))
    e = e.withColumns({"upto": F.sum("number").over(by_tree), "line_no": F.row_number().over(by_tree)})
    left = F.trim(F.regexp_replace("body", NOTE, ""))
    left = F.when(left == "", F.trim(text)).otherwise(left)
    head_text = F.when(F.col("rubric").isNotNull() & ~blank(F.col("rubric.text")), F.concat(F.trim(text), F.lit("\n"), F.trim("rubric.text"))).otherwise(F.trim(text))
    raw = F.when(kind == "PREAMBLE", F.when(~blank(F.col("next_text")), F.col("next_text")).otherwise(text)).when(kind == "ARTICLE", F.regexp_extract(text, ARTICLE, 1)).when(lower, left).otherwise(head_text)
    caput = F.concat("key", F.lit("/CAPUT:@caput"))
    texts = F.when(kind == "ARTICLE", F.array(raw, left)).when(F.col("element_type").isNotNull() | is_note, F.array(raw)).otherwise(nothing)
    # the root comes with the document's first line, so that elements keep the partitioning of lines; an element's place tells what it is
    e = e.withColumns({"root": F.when(F.col("line_no") == 1, 1).otherwise(0), "texts": F.when(F.col("line_no") == 1, F.concat(F.array(F.lit(root_text)), texts, "found")).otherwise(F.concat(texts, "found"))})
    e = e.select("*", F.posexplode("texts").alias("at", "said")).withColumn("at", F.col("at") - F.col("root"))
    at = F.col("at")
    what = F.when(at < 0, "DOCUMENT_ROOT").when((at == 0) & ~is_note, F.col("element_type")).when((at == 1) & (kind == "ARTICLE"), "CAPUT").otherwise("NOTE")
    e = e.withColumns({"what": what, "said": F.trim("said")})
    noted, first, inner, above = F.col("what") == "NOTE", at == 0, F.col("what") == "CAPUT", at < 0
    elements = e.select(
        "doc_id", "pos", F.col("what").alias("element_type"), F.when(first, F.col("label")).alias("label"), F.col("said").alias("text"), F.when(noted, "NOT_APPLICABLE").when(above, "CURRENT").otherwise(F.col("text_status")).alias("text_status"),
        F.when(noted, note_role(F.col("said"))).otherwise("NORMATIVE").alias("content_role"), F.when(above, "@root").when(noted, None).when(inner, caput).otherwise(F.col("key")).alias("identity_key"),
        F.when(first, F.col("parent")).when(inner, F.col("key")).when(noted, F.when(kind == "ARTICLE", caput).otherwise(F.col("key"))).alias("parent_key"),
        F.when(above, 1).otherwise(F.col("upto") - F.col("number") + at + 2).cast("int").alias("document_order"),
    )
    collisions = g.filter("bad").groupBy("doc_id").agg(F.lit(-1).cast(blocks.schema["pos"].dataType).alias("pos")).withColumn("reason", F.lit("IDENTITY_COLLISION"))
    rejected = c.filter("reject is not null").groupBy("doc_id").agg(F.first("reject").alias("r")).select("doc_id", "r.*").unionByName(collisions)
    coverage = good.select("doc_id", "pos", "consumed_as", F.when(kind.isin("EMPTY", "UNCLASSIFIED"), kind).alias("ignored_reason"))
    return Act(elements, coverage, rejected)


def _later(a: str, *others: str) -> Column:
    out = F.col(a).isNotNull()
    for o in others:
        out = out & (F.col(o).isNull() | (F.col(f"{a}.pos") > F.col(f"{o}.pos")))
    return out
