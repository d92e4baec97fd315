"""Findings of deep acts: openings, identities, order, provenance, edges, notes, revocations and the texts' places in their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import normalize_matching
from evidentia.sources.scratch import cut, spread

# What may hang on what.
EDGES = {
    "DOCUMENT_ROOT": ("PREAMBLE", "TITLE", "CHAPTER", "SECTION", "SUBSECTION", "ARTICLE", "NOTE"),
    "TITLE": ("CHAPTER", "SECTION", "ARTICLE", "NOTE"),
    "CHAPTER": ("SECTION", "SUBSECTION", "ARTICLE", "NOTE"),
    "SECTION": ("SUBSECTION", "ARTICLE", "NOTE"),
    "SUBSECTION": ("ARTICLE", "NOTE"),
    "ARTICLE": ("CAPUT", "PARAGRAPH", "INCISO", "NOTE"),
    "CAPUT": ("NOTE",),
    "PARAGRAPH": ("INCISO", "NOTE"),
    "INCISO": ("ALINEA", "NOTE"),
    "ALINEA": ("ITEM", "NOTE"),
    "ITEM": ("NOTE",),
}
# What a line that nothing took is, first pattern wins; the table's place is between SIGNATURE_BLOCK and TECHNICAL_ARTIFACT.
MISSED = r"^(?:art\.|§|parágrafo único|[ivxlcdm]+(?:-?[a-z])?\s+|[a-z]\s*\))|^(?:título|capítulo|seção|subseção)\s+[ivxlcdm]+(?:-[a-z])?$"
RUBRIC_GAP = r"^(?:do|da|dos|das)\s+"
NOTICE = r"este texto não substitui|publicad[oa] no dou|nota editorial"
SIGNATURE = r"brasília|presidente|ministro|constituinte"
TECHNICAL = r"javascript|cookie|f5_|menu|voltar"
REVOKED = r"(?iu)Revogad[oa]"

FOUND = "array<struct<code:string,severity:string,detail:string>>"
NO_SOURCE = ("DOCUMENT_ROOT", "PREAMBLE")  # their text stands elsewhere, or nowhere


def _table(df: DataFrame, tag: int, names: dict) -> DataFrame:
    """The columns in ``names`` (with their types), null where ``df`` has none, marked with its number."""
    return df.select(F.lit(tag).alias("tag"), *((F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in names.items()))


def _together(elements: DataFrame, lines: DataFrame, coverage: DataFrame, provisions: DataFrame) -> DataFrame:
    """All four tables as rows of one, written once and dealt out by document: what follows are windows within it, so nothing is shuffled again."""
    doc = elements.schema["doc_id"].dataType.simpleString()
    names = {"doc_id": doc, "pos": "long", "text": "string", "struck": "boolean", "in_table": "boolean", "ignored_reason": "string"}
    names |= dict.fromkeys(("element_type", "label", "text_status", "content_role", "identity_key", "parent_key"), "string") | {"document_order": "long"}
    out = _table(lines, 0, names)
    for tag, df in ((1, elements), (2, provisions), (3, coverage)):
        out = out.union(_table(df, tag, names))
    out = cut(out)
    return spread(out, out.count(), "doc_id")


def unclassified_kind(match: Column, in_table: Column) -> Column:
    """Kind of an ignored line, from its normalised text."""
    return (
        F.when(match == "", "EMPTY_PRESENTATION").when(match.rlike(RUBRIC_GAP), "HISTORICAL_RUBRIC_MODEL_GAP").when(match.rlike(MISSED), "PARSER_MISSED_STRUCTURE")
        .when(match.rlike(NOTICE), "EDITORIAL_NOTICE").when(match.rlike(SIGNATURE), "SIGNATURE_BLOCK").when(in_table, "NAVIGATION_ARTIFACT")
        .when(match.rlike(TECHNICAL), "TECHNICAL_ARTIFACT").when(F.length(match) <= 3, "EDITORIAL_SPACING").otherwise("REQUIRES_REVIEW")
    )


def _bare(x: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "[º°]", ""), r"[^\p{L}\p{N}]", ""))


def _dense(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", "")


def _without(x: Column, at: Column, n: Column, mark: str) -> Column:
    return F.concat(F.substr(x, F.lit(1), at - 1), F.lit(mark), F.substr(x, at + n))


def text_alignment(rows: DataFrame) -> DataFrame:
    """Findings (doc_id, block, element_type, label, code, severity, detail) about where texts stand in their line.

    ``rows`` as :func:`_together` gives them. Notes are taken out of the line first, then each other text in document order
    claims its characters, white space aside: a text that is nowhere in the line is TEXT_NOT_IN_SOURCE, one whose characters
    others hold SOURCE_TEXT_OVERLAP, and letters or digits that nobody claims, but for the label in front, are
    SOURCE_TEXT_UNCLAIMED. A heading's further lines are rubrics and stand elsewhere. Elements of no line are left to
    PROVENANCE_INVALID, blank texts claim nothing, a text that is the whole line may be so where nothing but notes follows its
    label. A group is one line's elements.
    """
    item = F.struct("document_order", "element_type", "label", F.element_at(F.split("text", "\n"), 1).alias("text"))
    own = (F.col("tag") == 1) & ~F.col("element_type").isin(*NO_SOURCE)
    g = rows.filter("tag < 2").groupBy("doc_id", "pos").agg(F.max(F.when(F.col("tag") == 0, F.col("text"))).alias("line"), F.sort_array(F.collect_list(F.when(own, item))).alias("items"))
    g = g.filter(F.col("line").isNotNull() & (F.size("items") > 0))
    bad = "array<struct<code:string,element_type:string,label:string>>"

    def claim(acc: Column, x: Column, text: Column, whole: Column, at: Column, mark: str, marker_only: Column) -> Column:
        code = F.when(F.position(text, whole) > 0, "SOURCE_TEXT_OVERLAP").otherwise("TEXT_NOT_IN_SOURCE")
        miss = F.struct(code.alias("code"), x["element_type"].alias("element_type"), x["label"].alias("label"))
        held = (text == "") | (at > 0) | marker_only
        rest = F.when(text == "", acc["rest"]).when(at > 0, _without(acc["rest"], at, F.length(text), mark)).when(marker_only, "").otherwise(acc["rest"])
        return F.struct(rest.alias("rest"), F.when(held, acc["found"]).otherwise(F.concat(acc["found"], F.array(miss))).alias("found"))

    def note(acc: Column, x: Column) -> Column:
        text = F.trim(F.coalesce(x["text"], F.lit("")))
        return claim(acc, x, text, F.col("line"), F.position(text, acc["rest"]), "", F.lit(False))

    def other(acc: Column, x: Column) -> Column:
        text, rest, whole = _dense(x["text"]), acc["rest"], _dense(F.col("line"))
        at = F.when((x["element_type"] != "ARTICLE") & F.endswith(rest, text), F.length(rest) - F.length(text) + 1).otherwise(F.position(text, rest))
        alone = (text == whole) & ((_bare(rest) == "") | (_bare(rest) == _bare(x["label"])))
        return claim(acc, x, text, F.concat(F.col("left"), F.lit("\u0001"), whole), at, "\u0001", alone)

    notes = F.filter("items", lambda x: x["element_type"] == "NOTE")
    others = F.filter("items", lambda x: x["element_type"] != "NOTE")
    g = g.select("doc_id", "pos", "line", notes.alias("notes"), others.alias("others"))
    g = g.withColumn("acc", F.aggregate("notes", F.struct(F.col("line").alias("rest"), F.array().cast(bad).alias("found")), note))
    g = g.withColumn("left", _dense(F.col("acc.rest")))
    g = g.withColumn("acc", F.aggregate("others", F.struct(F.col("left").alias("rest"), F.col("acc.found").alias("found")), other))
    parts = F.split("acc.rest", "\u0001")
    front = F.regexp_replace(F.element_at(parts, 1), "(?iu)^Parágrafo(?=único)", "")
    labels = F.transform("others", lambda x: _bare(x["label"]))
    fits = (_bare(front) == "") | F.array_contains(labels, _bare(front))
    gap = ~fits | F.exists(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: _bare(p) != "")
    none = F.lit(None).cast("string")
    open_ = F.when(gap, F.array(F.struct(F.lit("SOURCE_TEXT_UNCLAIMED").alias("code"), none.alias("element_type"), none.alias("label")))).otherwise(F.array().cast(bad))
    x = g.select("doc_id", F.col("pos").alias("block"), F.explode(F.concat("acc.found", open_)).alias("f")).select("doc_id", "block", "f.element_type", "f.label", "f.code")
    return x.withColumns({"severity": F.when(F.col("code") == "TEXT_NOT_IN_SOURCE", "BLOCKER").otherwise("WARNING"), "detail": none})


def act_findings(elements: DataFrame, lines: DataFrame, coverage: DataFrame, provisions: DataFrame) -> DataFrame:
    """Findings (doc_id, block, element_type, label, code, severity, detail) of acts as :func:`deep.parse_act` gives them.

    ``lines``: doc_id, pos, text and, if known, struck and in_table; ``provisions``: doc_id, identity_key, element_type,
    parent_key (of keys met twice the greatest counts). Documents are shuffled once, and sorted by line, by order, by article and by key; texts
    are left behind after the first of these. Findings of a group stand at its first
    row, those of a document have no block. Orders are right if they are 1 to n and each element's parent is open
    when it comes. An element without a line can't prove a revocation. Repeated rows are elements of their own; empty tables
    have no findings.
    """
    rows = _together(elements, lines, coverage.filter("ignored_reason is not null"), provisions)
    c, one = F.col, F.lit(1)
    el = c("tag") == 1
    kind, key, parent, status = c("element_type"), c("identity_key"), c("parent_key"), c("text_status")
    note = kind == "NOTE"
    per = lambda *by: Window.partitionBy("doc_id", *by)
    place = ("document_order", "pos", "element_type")
    rowwise = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    count = lambda cond, w: F.sum(F.when(cond, 1).otherwise(0)).over(w)

    # by place of the line: notes that repeat, and what the line says; texts are not needed any more
    at_line, of_kind = per("pos"), per("pos", "tag", "element_type")
    x = rows.withColumn("note_first", F.row_number().over(of_kind.orderBy("document_order")) == 1)
    x = x.withColumn("repeated_notes", F.size(F.collect_set(F.when(el & note, F.struct("text"))).over(of_kind)) < count(el & note, of_kind))
    x = x.withColumn("line", F.max(F.when(c("tag") == 0, F.struct(one.alias("is"), c("text").alias("text"), c("struck").alias("struck"), c("in_table").alias("in_table")))).over(at_line))
    x = x.filter("tag > 0").select(
        "doc_id", "tag", "pos", "element_type", "label", "text_status", "content_role", "identity_key", "parent_key", "document_order", "note_first", "repeated_notes",
        (~F.coalesce(c("text").rlike(r"\S"), F.lit(False))).alias("blank"), c("line").isNotNull().alias("in_line"), F.coalesce(c("line.struck"), F.lit(False)).alias("line_struck"),
        F.when(status == "REVOKED", F.coalesce(c("line.text").rlike(REVOKED), F.lit(False))).alias("proven"),
        F.when(c("tag") == 3, unclassified_kind(F.coalesce(normalize_matching(c("line.text")), F.lit("")), F.coalesce(c("line.in_table"), F.lit(False)))).alias("ignored"),
    )

    # by order: what comes before, and the article that is open
    in_order = per("tag").orderBy(*place)
    x = x.withColumns({
        "before": F.lag(F.coalesce(key, parent)).over(in_order), "key_no": F.row_number().over(in_order), "art_no": count(el & (kind == "ARTICLE"), in_order),
        "art": F.last(F.when(el & (kind == "ARTICLE"), F.struct(key.alias("key"), c("pos").alias("pos"))), ignorenulls=True).over(in_order),
    })
    step_ok = (kind == "DOCUMENT_ROOT") | F.coalesce((c("before") == parent) | F.startswith(c("before"), F.concat(parent, F.lit("/"))), F.lit(False))
    x = x.withColumns({"right": step_ok & c("document_order").eqNullSafe(c("key_no").cast("long")), "hangs": el & (kind == "CAPUT") & parent.eqNullSafe(c("art.key")), "art_pos": c("art.pos")}).drop("before", "art")

    # by article, and by document
    art, doc = per("tag", "art_no"), per("tag")
    open_status = el & (status == "UNRESOLVED")
    x = x.withColumns({"caputs": count(c("hangs"), art), "good_caputs": count(c("hangs") & ~c("blank") & c("pos").eqNullSafe(c("art_pos")), art), "caput_status": F.max(F.when(c("hangs"), status)).over(art)})
    x = x.withColumns({"ordered": F.min(c("right").cast("int")).over(doc), "lost": count(el & ~c("in_line"), doc), "open": count(open_status, doc), "struck_open": count(open_status & c("line_struck"), doc)}).drop("right", "hangs", "art_pos", "art_no")

    # by key: the first in force, articles that share it, its provision
    same, article = per("identity_key", "tag"), kind == "ARTICLE"
    by_key = rowwise(same.orderBy(*place))
    x = x.withColumns({"current_no": count(status == "CURRENT", by_key), "twin_no": count(article, by_key)})
    x = x.withColumns({"twins": count(article, same), "twin_places": F.size(F.collect_set(F.when(article, c("pos"))).over(same)), "old_twins": count(article & c("caput_status").isin("HISTORICAL", "REVOKED", "UNRESOLVED"), same)})
    x = x.withColumns({"prov": F.max(F.when(c("tag") == 2, F.struct("element_type", "parent_key"))).over(per("identity_key")), "currents": count(el & ~note & (status == "CURRENT"), per("identity_key"))})
    blank, twin_first = c("blank"), c("twin_no") == 1

    parent_type = F.when(parent == "@root", "DOCUMENT_ROOT").otherwise(F.regexp_extract(parent, r"([A-Z_]+):[^/]*$", 1))
    allowed = F.lit(False)
    for above, below in EDGES.items():
        allowed = allowed | ((parent_type == above) & kind.isin(*below))
    ignored = c("ignored")
    known = el & ~note
    old = c("old_twins") > 0
    none = F.lit(None).cast("string")
    of_row = [
        (el & (kind == "ARTICLE") & ~((c("caputs") == 1) & (c("good_caputs") == 1)), "ARTICLE_CAPUT_INVALID", "BLOCKER", c("caputs").cast("string")),
        (el & note & key.isNotNull(), "NOTE_WITH_IDENTITY", "BLOCKER", none),
        (known & c("prov").isNull(), "UNMATCHED_NORMATIVE_OCCURRENCE", "BLOCKER", key),
        (known & (c("prov.element_type") != kind), "ACT_OR_TYPE_IDENTITY_MISMATCH", "BLOCKER", key),
        (known & c("prov").isNotNull() & ~c("prov.parent_key").eqNullSafe(parent), "IDENTITY_PARENT_MISMATCH", "BLOCKER", key),
        (el & (kind != "DOCUMENT_ROOT") & ~F.coalesce(allowed, F.lit(False)) & ~(note & parent.isNull()), "HIERARCHY_EDGE_UNEXPECTED", "BLOCKER", F.concat(F.coalesce(parent_type, F.lit("")), F.lit(">"), kind)),
        (el & note & (blank | c("content_role").eqNullSafe("NORMATIVE") | ~status.eqNullSafe("NOT_APPLICABLE") | parent.isNull()), "NOTE_INVALID", "BLOCKER", none),
        (el & note & c("note_first") & c("repeated_notes"), "REPEATED_NOTE_TEXT_IN_SOURCE", "INFO", none),
        (el & (status == "REVOKED") & ~c("proven"), "REVOKED_WITHOUT_TEXTUAL_EVIDENCE", "BLOCKER", none),
        (el & (kind == "ARTICLE") & twin_first & (c("twins") > 1) & key.isNotNull() & old, "HISTORICAL_OCCURRENCES_RECONCILED", "INFO", F.lit("SAME_LEGAL_DEVICE_HISTORICAL_REDACTION")),
        (el & (kind == "ARTICLE") & twin_first & (c("twins") > 1) & key.isNotNull() & ~old, "DUPLICATE_ARTICLE_STRUCTURAL_KEY", "BLOCKER", F.when(c("twin_places") < c("twins"), "PARSER_DUPLICATION").otherwise("STRUCTURAL_AMBIGUITY")),
        (c("tag") == 3, "IGNORED_BLOCK_DIAGNOSED", F.when(ignored.isin("PARSER_MISSED_STRUCTURE", "HISTORICAL_RUBRIC_MODEL_GAP"), "BLOCKER").when(ignored == "REQUIRES_REVIEW", "WARNING").otherwise("INFO"), ignored),
    ]
    counted = F.concat_ws(",", F.when(c("struck_open") > 0, F.concat(F.lit("FULL_STRIKE_WITHOUT_DECISIVE_MARKER="), "struck_open")), F.when(c("open") > c("struck_open"), F.concat(F.lit("UNCLASSIFIED_STATUS_PATTERN="), c("open") - c("struck_open"))))
    top = el & (c("key_no") == 1)
    of_document = [
        (known & c("prov").isNotNull() & (status == "CURRENT") & (c("current_no") == 1) & (c("currents") > 1), "MULTIPLE_CURRENT_PER_VERSION_PROVISION", "BLOCKER", key),
        (top & (c("ordered") == 0), "DOCUMENT_ORDER_INVALID", "BLOCKER", none),
        (top & (c("lost") > 0), "PROVENANCE_INVALID", "BLOCKER", c("lost").cast("string")),
        (top & (c("open") > 0), "UNRESOLVED_PRESERVED", "WARNING", counted),
    ]

    def listed(rules: list) -> Column:
        made = [F.when(cond, F.struct(F.lit(code).alias("code"), (F.lit(s) if isinstance(s, str) else s).alias("severity"), detail.alias("detail"))) for cond, code, s, detail in rules]
        return F.filter(F.array(*made).cast(FOUND), lambda f: f.isNotNull())

    at_row = lambda fs, own: F.transform(fs, lambda f: F.struct(F.lit(own).alias("own"), f["code"].alias("code"), f["severity"].alias("severity"), f["detail"].alias("detail")))
    f = x.filter("tag in (1, 3)").withColumn("f", F.explode(F.concat(at_row(listed(of_row), True), at_row(listed(of_document), False))))
    mine = lambda name: F.when(c("f.own"), c(name)).alias(name if name != "pos" else "block")
    found = f.select("doc_id", mine("pos"), mine("element_type"), mine("label"), "f.code", "f.severity", "f.detail")
    return found.unionByName(text_alignment(rows))
