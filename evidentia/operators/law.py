"""Whole laws: from lines, or from stored bytes, to provisions, coverage and rejected documents."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import content_hash, cut_after_html_close, decode_strict, normalize_presentation
from evidentia.operators.index import project_units
from evidentia.operators.structure import classify_blocks, html_blocks

# The grammar of a law's lines, first match wins. The header opens the preamble.
LAW_GRAMMAR = (
    ("CHAPTER", r"(?iu)^CAPÍTULO\s+([IVXLCDM]+(?:-[A-Z])?)(?:\s+(.+))?$"),
    ("ARTICLE", r"(?iu)^Art\.\s*(\d+(?:-[A-Z])?)\s*(?:[.º]|o)?\s+(.*)$"),
    ("PARAGRAPH", r"(?iu)^§\s*(\d+)\s*(?:[º°]|o)?\s+(.*)$"),
    ("SOLE_PARAGRAPH", r"(?iu)^(Parágrafo\s+único)\.\s*(.*)$"),
    ("INCISO", r"^([IVXLCDM]+)\s*[-–]\s+(.+)$"),
    ("HEADER", r"(?iu)^LEI\s+(N[ºO])(.*)$"),
)
STRUCTURAL = ("CHAPTER", "ARTICLE", "PARAGRAPH", "SOLE_PARAGRAPH", "INCISO")
ROOT = "PREAMBLE"


class Law(NamedTuple):
    """What one pass over lines gives. A document is in ``provisions`` and ``coverage`` or in ``rejected``."""

    provisions: DataFrame
    coverage: DataFrame
    rejected: DataFrame


def place_lines(blocks: DataFrame) -> DataFrame:
    """Lines (doc_id, pos, text, …) with where they belong: ``consumed_by``, ``opener`` (the line whose provision they are part of), ``parent_key``, ``ignored`` and the document's ``reject``.

    Lines from the header to the first chapter are the preamble, whatever they look like, and set no context; a chapter
    without title takes the plain lines below it; lines before the header or after the last structural line are
    chrome. A document is rejected as a whole by the first line that has no place. All of it is windows over one
    partitioning by document.
    """
    doc, w = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("pos")
    text, pos, kind = F.col("text"), F.col("pos"), F.col("class")
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    b = classify_blocks(blocks.withColumn("text", F.coalesce(normalize_presentation(F.col("text")), F.lit(""))), LAW_GRAMMAR)
    b = b.withColumn("label", F.when(kind == "SOLE_PARAGRAPH", "UNIQUE").otherwise(F.upper("label")))
    b = b.withColumns({
        "header": F.min(F.when(kind == "HEADER", pos)).over(doc),
        "chapter": F.min(F.when(kind == "CHAPTER", pos)).over(doc),
        "final": F.max(F.when(kind.isin(*STRUCTURAL), pos)).over(doc),
    })
    sound = F.coalesce(F.col("header") < F.col("chapter"), F.lit(False))
    b = b.withColumns({"root": sound & (text != "") & (pos >= F.col("header")) & (pos < F.col("chapter")), "live": sound & (text != "") & (pos >= F.col("chapter"))})
    b = b.withColumn("kind", F.when(F.col("live") & kind.isin(*STRUCTURAL), kind))
    kind = F.col("kind")
    b = b.withColumns({
        "before": last(F.when(kind.isNotNull(), F.struct(kind.alias("kind"), pos.alias("pos"), (F.coalesce("rest", F.lit("")) == "").alias("bare")))),
        "ch": last(F.when(kind == "CHAPTER", F.struct(pos.alias("pos"), F.concat(F.lit("CHAPTER:"), "label").alias("key")))),
        "art": last(F.when(kind == "ARTICLE", F.struct(pos.alias("pos"), F.concat(F.lit("ARTICLE:"), "label").alias("key")))),
    })
    in_chapter = F.col("art.pos") > F.col("ch.pos")
    b = b.withColumn("article", F.when(in_chapter, F.col("art.key")))
    host = F.when(kind == "ARTICLE", F.concat("article", F.lit("/CAPUT"))).when(kind.isin("PARAGRAPH", "SOLE_PARAGRAPH"), F.concat("article", F.lit("/PARAGRAPH:"), "label"))
    b = b.withColumn("own", host).withColumn("host", last(F.when(F.col("own").isNotNull(), F.struct(pos.alias("pos"), F.col("own").alias("key")))))
    host = F.when(F.col("host.pos") > F.col("ch.pos"), F.col("host.key"))
    title = F.coalesce(F.col("live") & kind.isNull() & (F.col("before.kind") == "CHAPTER") & F.col("before.bare"), F.lit(False))
    chrome = (text != "") & ~F.col("root") & ~title & ((pos < F.col("header")) | (pos > F.col("final")))
    key = (
        F.when(F.col("root"), F.lit(ROOT)).when(title | (kind == "CHAPTER"), F.col("ch.key"))
        .when(kind.isin("ARTICLE", "PARAGRAPH", "SOLE_PARAGRAPH"), F.col("own"))
        .when(kind == "INCISO", F.concat(host, F.lit("/INCISO:"), "label"))
    )
    parent = F.when(kind == "CHAPTER", F.lit(ROOT)).when(kind.isin("ARTICLE", "PARAGRAPH", "SOLE_PARAGRAPH"), F.col("article")).when(kind == "INCISO", host)
    opener = F.when(F.col("root"), F.col("header")).when(title, F.col("before.pos")).otherwise(pos)
    why = F.when(F.col("live") & ~chrome & key.isNull(), F.when(kind == "INCISO", "INCISO_WITHOUT_PARENT").when(kind.isNotNull(), "PARAGRAPH_WITHOUT_ARTICLE").otherwise("UNMATCHED_TEXT"))
    b = b.withColumns({"consumed_by": key, "parent_key": parent, "opener": opener, "ignored": F.when(text == "", "EMPTY").when(chrome, "CHROME"), "why": why})
    first = F.min(F.when(F.col("why").isNotNull(), F.struct(pos.alias("pos"), F.col("why").alias("reason")))).over(doc)
    return b.withColumn("reject", F.when(~sound, F.struct(F.lit(-1).cast(blocks.schema["pos"].dataType).alias("pos"), F.lit("NO_PREAMBLE").alias("reason"))).otherwise(first))


def parse_law(blocks: DataFrame) -> Law:
    """Provisions (root, chapters, articles with their opening text, paragraphs, incisos), coverage of every line, and rejected documents with the first line that has no place.

    ``blocks`` has doc_id, pos, text and, if there are any, ``anchors``. Texts are whole lines; a provision of several lines
    joins them by line feeds and names the first and the last. Lines of one position in a document are taken in
    the order of their text; documents without lines are in no table.
    """
    if "anchors" not in blocks.columns:
        blocks = blocks.withColumn("anchors", F.array().cast("array<string>"))
    placed = place_lines(blocks.select("doc_id", "pos", "text", "anchors"))
    good = placed.filter("reject is null")
    coverage = good.select("doc_id", "pos", F.when(F.col("consumed_by").isNotNull(), F.col("consumed_by")).alias("consumed_by"), F.col("ignored").alias("ignored_reason"))
    rejected = placed.filter("reject is not null").groupBy("doc_id").agg(F.first("reject").alias("r"), F.min_by("text", F.when(F.col("pos") == F.col("reject.pos"), F.col("pos"))).alias("text")).select("doc_id", "r.pos", "r.reason", "text")
    used = good.filter("consumed_by is not null")
    line = F.struct("pos", "text", "anchors")
    p = used.groupBy("doc_id", "opener", "consumed_by").agg(F.sort_array(F.collect_list(line)).alias("lines"), F.max("kind").alias("kind"), F.max("label").alias("label"), F.max("parent_key").alias("parent_key"), F.max(F.col("ch.key")).alias("chapter_key"))
    text = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    p = p.select("doc_id", "opener", "consumed_by", "kind", "label", "parent_key", "chapter_key", text.alias("text"), F.col("lines")[0]["pos"].alias("pos_start"), F.element_at("lines", -1)["pos"].alias("pos_end"), F.get(F.col("lines")[0]["anchors"], F.lit(0)).alias("anchor"))
    status = F.when(F.col("kind").isin("ARTICLE", "PARAGRAPH", "SOLE_PARAGRAPH", "INCISO") & F.upper("text").contains("(VETADO)"), "VETOED").otherwise("IN_FORCE")
    none = F.lit(None).cast("string")

    def row(sub: int, key: Column, parent: Column, kind: Column, label: Column, text: Column) -> Column:
        return F.struct(F.lit(sub).alias("sub"), key.alias("stable_key"), parent.alias("parent_key"), kind.alias("provision_type"), label.alias("number_label"), text.alias("text"))

    own, kind = F.col("consumed_by"), F.col("kind")
    article = F.array(row(0, F.col("parent_key"), F.col("chapter_key"), F.lit("ARTICLE"), F.col("label"), none), row(1, own, F.col("parent_key"), F.lit("CAPUT"), none, F.col("text")))
    root = F.array(row(0, own, none, F.lit("DOCUMENT_ROOT"), none, F.col("text")))
    other = F.array(row(0, own, F.col("parent_key"), F.when(kind == "SOLE_PARAGRAPH", "PARAGRAPH").otherwise(kind), F.col("label"), F.col("text")))
    p = p.withColumn("r", F.explode(F.when(own == ROOT, root).when(kind == "ARTICLE", article).otherwise(other)))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("opener", "r.sub"))
    provisions = p.select("doc_id", order.alias("document_order"), "r.stable_key", "r.parent_key", "r.provision_type", "r.number_label", "r.text", status.alias("status"), "pos_start", "pos_end", "anchor")
    return Law(provisions, coverage, rejected)


class Derived(NamedTuple):
    provisions: DataFrame
    units: DataFrame
    rejected: DataFrame


def reproject(snapshots: DataFrame, charset: str = "windows-1252", parser: str = "law/1") -> Derived:
    """Derived tables from stored bytes alone: decoded strictly, cut behind ``</html>``, blocks, provisions, units.

    ``snapshots`` has doc_id and raw_bytes. ``version`` names bytes and parser, so that equal bytes give an equal version.
    Documents that cannot be decoded, or have a line without place, are in ``rejected`` with the stage; nothing of them is
    in the other tables.
    """
    raw = snapshots.select("doc_id", F.sha2(F.concat(F.sha2("raw_bytes", 256), F.lit("\n" + parser)), 256).alias("version"), decode_strict(F.col("raw_bytes"), charset).alias("d"))
    pages = raw.filter("d.error is null").select("doc_id", cut_after_html_close(F.col("d.text"))[0].alias("html"))
    law = parse_law(html_blocks(pages, "doc_id", only=("text", "anchors")).withColumnRenamed("block", "pos"))
    empty = raw.filter("d.error is not null").select("doc_id", F.lit(-1).alias("pos"), F.col("d.error").alias("reason"), F.lit(None).cast("string").alias("text"))
    rejected = law.rejected.withColumn("stage", F.lit("STRUCTURE")).unionByName(empty.withColumn("stage", F.lit("DECODE")))
    versions = raw.groupBy("doc_id").agg(F.min("version").alias("version"))  # one a document, so the join goes where no version is asked for
    p = law.provisions.join(versions, "doc_id", "left").withColumn("content_hash", content_hash(F.col("text")))
    units = project_units(p.select("doc_id", "version", F.col("stable_key").alias("unit_key"), "text"))
    return Derived(p, units, rejected)


def reparse_difference(stored: DataFrame, derived: DataFrame, on: tuple = ("doc_id", "document_order", "stable_key", "parent_key", "provision_type", "number_label", "text")) -> DataFrame:
    """Rows that a stored table has more often (``MISSING_NOW``) or less often (``NEW``) than what is derived again, with how often: a difference of multisets by one grouping."""
    rows = stored.select(*on, F.lit(1).alias("d")).unionByName(derived.select(*on, F.lit(-1).alias("d")))
    return rows.groupBy(*on).agg(F.sum("d").alias("n")).filter("n <> 0").select(*on, F.when(F.col("n") > 0, "MISSING_NOW").otherwise("NEW").alias("change"), F.abs("n").alias("n"))
