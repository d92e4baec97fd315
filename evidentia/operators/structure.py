"""HTML pages to blocks, blocks to a hierarchy of provisions, with windows in place of a cursor."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import key_token, normalize_presentation
from evidentia.sources.scratch import cut, spread


class _Blocks(HTMLParser):
    """Paragraphs in document order with anchors, links, table and strike state. A new ``<p>`` ends an open one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: dict | None = None
        self.tables = self.strikes = self.skip = 0

    def close_block(self) -> None:
        if self.open is not None:
            self.rows.append(self.open)
            self.open = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "p":
            self.close_block()
            self.open = {"text": [], "struck": [], "in_table": self.tables > 0, "anchors": [], "hrefs": []}
        elif tag == "table":
            self.tables += 1
        elif tag in ("strike", "s", "del"):
            self.strikes += 1
        if self.open is not None:
            self.open["anchors"] += [x for x in (a.get("name"), a.get("id")) if x and tag in ("a", "p")]
            if tag == "a" and a.get("href"):
                self.open["hrefs"].append(a["href"])

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "p":
            self.close_block()
        elif tag == "table":
            self.tables = max(0, self.tables - 1)
        elif tag in ("strike", "s", "del"):
            self.strikes = max(0, self.strikes - 1)

    def handle_data(self, data):
        if self.open is not None and not self.skip:
            self.open["text"].append(data)
            if data.strip():
                self.open["struck"].append(self.strikes > 0)


#: A tag that the plain reader takes: lower case, values in double quotes, nothing to decode.
_PLAIN_TAG = re.compile(r'(/?)(html|head|body|p|a|table|thead|tbody|tr|td|th|strike|s|del|script|style|b|i|u|em|strong|span|div|font|center|h[1-6]|ul|ol|li|br|hr)((?: [a-z]+="[^"<>&]*")*)')
_ATTRIBUTE = re.compile(r' ([a-z]+)="([^"]*)"')
_STRUCK = ("strike", "s", "del")


def _plain_blocks(page: str, known: dict) -> list[tuple] | None:
    """What ``_Blocks`` finds in a page of plain tags without character references, or None where the page has anything else. ``known`` keeps tags that were read."""
    if "&" in page:
        return None
    pieces = page.split("<")
    rows, block, raw = [], None, None
    tables = strikes = skip = 0
    for i, piece in enumerate(pieces):
        if i:
            inside, closed, data = piece.partition(">")
            if not closed:
                return None
            tag = known.get(inside)
            if tag is None:
                m = _PLAIN_TAG.fullmatch(inside)
                if not m or (m[1] and m[3]):
                    return None
                a = dict(_ATTRIBUTE.findall(m[3]))
                if len(known) > 50_000:
                    known.clear()
                known[inside] = tag = (m[1] + m[2], [x for x in (a.get("name"), a.get("id")) if x and m[2] in ("a", "p")], a.get("href") if m[2] == "a" else None)
            name, anchors, href = tag
            if raw and name != raw:
                return None
            if name == "p":
                block = ([], [], tables > 0, [], anchors.copy())
                rows.append(block)
            else:
                if name[0] == "/":
                    if name == "/p":
                        block = None
                    elif name == "/table":
                        tables = max(0, tables - 1)
                    elif name[1:] in _STRUCK:
                        strikes = max(0, strikes - 1)
                    elif name in ("/script", "/style"):
                        skip, raw = max(0, skip - 1), None
                else:
                    if name == "table":
                        tables += 1
                    elif name in _STRUCK:
                        strikes += 1
                    elif name in ("script", "style"):
                        skip, raw = skip + 1, "/" + name
                    if block is not None:
                        if anchors:
                            block[4].extend(anchors)
                        if href:
                            block[1].append(href)
        else:
            data = piece
        if data and block is not None and not skip:
            block[0].append(data)
            if not data.isspace():
                block[3].append(strikes > 0)
    return None if raw else [(" ".join("".join(t).split()), in_table, any(st), bool(st) and all(st), anchors, hrefs) for t, hrefs, in_table, st, anchors in rows]


def _parsed_blocks(page: str) -> list[tuple]:
    r = _Blocks()
    r.feed(page)
    r.close()
    r.close_block()
    return [(" ".join("".join(b["text"]).split()), b["in_table"], any(b["struck"]), bool(b["struck"]) and all(b["struck"]), b["anchors"], b["hrefs"]) for b in r.rows]


#: Columns of a block, and how many blocks are handed on at once.
_BLOCK_COLUMNS = {"text": "string", "in_table": "boolean", "any_struck": "boolean", "fully_struck": "boolean", "anchors": "array<string>", "hrefs": "array<string>"}
_BLOCKS_AT_ONCE = 20_000


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html", only: tuple = tuple(_BLOCK_COLUMNS)) -> DataFrame:
    """One row per paragraph: key, block, and of text, in_table, any_struck, fully_struck, anchors, hrefs those in ``only``. Null pages have none.

    Pages of plain tags are cut at their tags; all others, among them those with character references, comments or unknown
    tags, go through the standard library's parser, with the same result.
    """
    kind = pages.schema[key].dataType.simpleString()
    arrow = {"string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    places = [list(_BLOCK_COLUMNS).index(c) for c in only]
    types = [arrow[_BLOCK_COLUMNS[c]] for c in only]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}

        def made(keys: pa.Array, at: list, number: list, rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(_BLOCK_COLUMNS)
            cols = [pa.array(columns[i], t) for i, t in zip(places, types, strict=True)]
            return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), *cols], names=[key, "block", *only])

        for batch in batches:
            at, number, rows = [], [], []
            for i, page in enumerate(batch.column(1).to_pylist()):
                found = _plain_blocks(page or "", known)
                if found is None:
                    found = _parsed_blocks(page)
                at += [i] * len(found)
                number += range(len(found))
                rows += found
                if len(rows) >= _BLOCKS_AT_ONCE:
                    yield made(batch.column(0), at, number, rows)
                    at, number, rows = [], [], []
            if rows:
                yield made(batch.column(0), at, number, rows)

    schema = ", ".join([f"`{key}` {kind}", "block int", *(f"{c} {_BLOCK_COLUMNS[c]}" for c in only)])
    return pages.select(F.col(key).alias("k"), F.col(html).alias("page")).mapInArrow(run, schema)


def html_blocks_regex(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """The same for simple pages, without Python: what stands between ``<p…>`` and the next ``</p>``, tags stripped."""
    found = F.regexp_extract_all(html, F.lit(r"(?s)<p(?: [^>]*)?>(.*?)</p>"), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("block", "inner")).select(key, "block", F.trim(F.regexp_replace(F.regexp_replace("inner", "<[^>]*>", ""), r"\s+", " ")).alias("text"))


def page_metrics(pages: DataFrame, html: str = "html") -> DataFrame:
    """Counts of tags, a premature close of ``</html>``, and what comes behind it."""
    low = F.lower(html)
    at = F.locate("</html>", low)
    tail = F.when(at > 0, F.substring(F.col(html), at + 7, F.length(html))).otherwise(F.lit(""))
    tags = {"n_p": "<p[ >]", "n_a": "<a[ >]", "n_href": "href=", "n_strike": "<(strike|s|del)[ >]", "n_table": "<table[ >]", "n_script": "<script[ >]"}
    return pages.select("page_id", *(F.regexp_count(low, F.lit(p)).cast("long").alias(n) for n, p in tags.items()), (at > 0).alias("has_close"), F.length(F.regexp_replace(tail, r"\s", "")).cast("long").alias("tail_length"))


def segment(blocks: DataFrame, sentinels: list[str]) -> tuple[DataFrame, DataFrame]:
    """Blocks with the region they're in (number of the last sentinel at or before them), and documents rejected.

    Each sentinel must match exactly one block of a document, in the given order.
    """
    hit = [F.col("text").rlike(s) for s in sentinels]
    stats = blocks.groupBy("doc_id").agg(*(x for i, h in enumerate(hit) for x in (F.count_if(h).alias(f"n{i}"), F.min(F.when(h, F.col("pos"))).alias(f"p{i}"))))
    missing = F.coalesce(*(F.when(F.col(f"n{i}") == 0, F.lit(f"MISSING_{i}")) for i in range(len(hit))), *(F.when(F.col(f"n{i}") > 1, F.lit(f"DUPLICATE_{i}")) for i in range(len(hit))), *(F.when(F.col(f"p{i}") < F.col(f"p{i - 1}"), F.lit(f"ORDER_{i}")) for i in range(1, len(hit))), F.lit(None).cast("string"))
    stats = stats.withColumn("reason", missing)
    good = stats.filter("reason is null").select("doc_id", *(f"p{i}" for i in range(len(hit))))
    region = sum(((F.col("pos") >= F.col(f"p{i}")).cast("int") for i in range(len(hit))), F.lit(0))
    return blocks.join(good, "doc_id").select(*blocks.columns, region.alias("region")), stats.filter("reason is not null").select("doc_id", "reason")


# The grammar of a flat law, first match wins.
FLAT_GRAMMAR = (
    ("CHAPTER", r"(?iu)^CAPÍTULO\s+([IVXLCDM]+(?:-[A-Z])?)(?:\s+(.*))?$"),
    ("ARTICLE", r"(?iu)^Art\.\s*(\d+(?:-[A-Z])?)[ºo°.]*\s+(.*)$"),
    ("PARAGRAPH", r"(?iu)^§\s*(\d+(?:-[A-Z])?)[ºo°.]*\s+(.*)$"),
    ("SOLE_PARAGRAPH", r"(?iu)^(Parágrafo\s+único)\.?\s*(.*)$"),
    ("INCISO", r"^([IVXLCDM]+)\s*[-–]\s+(.*)$"),
)


def classify_blocks(blocks: DataFrame, grammar: tuple = FLAT_GRAMMAR, text: str = "text") -> DataFrame:
    """Adds class, label and rest by the first pattern that matches; class TEXT where none does, BLANK without text."""
    t = F.col(text)
    kind = label = rest = None
    for name, pattern in grammar:
        hit = t.rlike(pattern)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        label = F.when(hit, F.regexp_extract(t, pattern, 1)) if label is None else label.when(hit, F.regexp_extract(t, pattern, 1))
        rest = F.when(hit, F.regexp_extract(t, pattern, 2)) if rest is None else rest.when(hit, F.regexp_extract(t, pattern, 2))
    return blocks.withColumns({"class": F.when(F.trim(t) == "", "BLANK").otherwise(kind.otherwise("TEXT")), "label": label, "rest": rest.otherwise(t)})


def _last(c: Column, w) -> Column:
    return F.last(c, ignorenulls=True).over(w)


def merge_heading_lines(classified: DataFrame) -> DataFrame:
    """Chapters with their title: their own rest, or the plain lines up to the next structural line if they have none."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    structural = ~F.col("class").isin("TEXT", "BLANK")
    g = classified.withColumn("island", F.sum(structural.cast("int")).over(w)).withColumn("is_head", F.col("class") == "CHAPTER")
    h = g.groupBy("doc_id", "island").agg(F.max(F.when(F.col("is_head"), F.col("label"))).alias("label"), F.max(F.when(F.col("is_head"), F.col("rest"))).alias("rest"), F.min("pos").alias("pos"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("class") == "TEXT", F.struct("pos", "text")))), lambda x: x["text"]), " ").alias("below"))
    return h.filter("label is not null").select("doc_id", "pos", "label", F.when(F.trim("rest") != "", F.trim("rest")).otherwise(F.col("below")).alias("title"))


def flat_hierarchy(classified: DataFrame) -> DataFrame:
    """Provisions of flat laws: doc_id, document_order, stable_key, parent_key, provision_type, number_label, text.

    What a sequential parser carries along is the last value before a row. A chapter ends the current
    article; an article is a container and its opening text; paragraphs hang on the article, incisos on
    the last opening text or paragraph. Rows without a place are left to :func:`unsupported_blocks`.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    c = classified.withColumns({
        "ch_pos": _last(F.when(F.col("class") == "CHAPTER", F.col("pos")), w),
        "ch": _last(F.when(F.col("class") == "CHAPTER", F.concat(F.lit("chapter:"), F.lower("label"))), w),
        "art_pos": _last(F.when(F.col("class") == "ARTICLE", F.col("pos")), w),
        "art": _last(F.when(F.col("class") == "ARTICLE", F.concat(F.lit("article:"), F.col("label"))), w),
    })
    in_art = F.col("art").isNotNull() & (F.col("ch_pos").isNull() | (F.col("art_pos") > F.col("ch_pos")))
    c = c.withColumn("art", F.when(in_art, F.col("art")))
    para = F.when(F.col("class") == "PARAGRAPH", F.concat(F.col("art"), F.lit("/paragraph:"), F.col("label"))).when(F.col("class") == "SOLE_PARAGRAPH", F.concat(F.col("art"), F.lit("/paragraph:unique"))).when(F.col("class") == "ARTICLE", F.concat(F.lit("article:"), F.col("label"), F.lit("/caput")))
    c = c.withColumns({"own_parent": para}).withColumns({"host": _last(F.col("own_parent"), w), "host_pos": _last(F.when(F.col("own_parent").isNotNull(), F.col("pos")), w)})
    host = F.when(F.col("ch_pos").isNull() | (F.col("host_pos") > F.col("ch_pos")), F.col("host"))
    top = F.coalesce("ch", F.lit("root"))
    row = lambda n, key, parent, kind, label, text: F.struct(F.lit(n).alias("sub"), key.alias("stable_key"), parent.alias("parent_key"), F.lit(kind).alias("provision_type"), label.alias("number_label"), text.alias("text"))
    none = F.lit(None).cast("string")
    made = (
        F.when(F.col("class") == "CHAPTER", F.array(row(0, F.col("ch"), F.lit("root"), "CHAPTER", F.col("label"), F.col("rest"))))
        .when(F.col("class") == "ARTICLE", F.array(row(0, F.col("art"), top, "ARTICLE", F.col("label"), none), row(1, F.concat(F.col("art"), F.lit("/caput")), F.col("art"), "CAPUT", none, F.col("rest"))))
        .when(F.col("class").isin("PARAGRAPH", "SOLE_PARAGRAPH") & F.col("art").isNotNull(), F.array(row(0, F.col("own_parent"), F.col("art"), "PARAGRAPH", F.when(F.col("class") == "PARAGRAPH", F.col("label")).otherwise("UNIQUE"), F.col("rest"))))
        .when((F.col("class") == "INCISO") & host.isNotNull(), F.array(row(0, F.concat(host, F.lit("/inciso:"), F.lower("label")), host, "INCISO", F.col("label"), F.col("rest"))))
    )
    p = c.select("doc_id", "pos", F.explode(made).alias("r")).select("doc_id", "pos", "r.*")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "sub"))
    return p.select("doc_id", order.alias("document_order"), "pos", "stable_key", "parent_key", "provision_type", "number_label", normalize_presentation(F.col("text")).alias("text"))


def unsupported_blocks(classified: DataFrame) -> DataFrame:
    """Why blocks have no place: text in the body, a paragraph without article, an inciso without host, repeated keys are left to the audit."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    c = classified.withColumns({
        "ch_pos": F.coalesce(_last(F.when(F.col("class") == "CHAPTER", F.col("pos")), w), F.lit(-1)),
        "art_pos": F.coalesce(_last(F.when(F.col("class") == "ARTICLE", F.col("pos")), w), F.lit(-1)),
        "par_pos": F.coalesce(_last(F.when(F.col("class").isin("ARTICLE", "PARAGRAPH", "SOLE_PARAGRAPH"), F.col("pos")), w), F.lit(-1)),
        "before": _last(F.when(~F.col("class").isin("TEXT", "BLANK"), F.struct(F.col("class").alias("c"), (F.trim("rest") == "").alias("bare"))), w),
    })
    in_art = F.col("art_pos") > F.col("ch_pos")
    reason = (
        F.when((F.col("class") == "TEXT") & F.col("before").isNotNull() & ~((F.col("before.c") == "CHAPTER") & F.col("before.bare")), "UNMATCHED_TEXT")
        .when(F.col("class").isin("PARAGRAPH", "SOLE_PARAGRAPH") & ~in_art, "PARAGRAPH_WITHOUT_ARTICLE")
        .when((F.col("class") == "INCISO") & ~(F.col("par_pos") > F.col("ch_pos")), "INCISO_WITHOUT_PARENT")
    )
    return c.select("doc_id", "pos", "class", reason.alias("reason")).filter("reason is not null")


def coverage(classified: DataFrame, provisions: DataFrame) -> DataFrame:
    """Each block is consumed by a key or ignored for a reason, never both."""
    used = provisions.groupBy("doc_id", "pos").agg(F.min("stable_key").alias("consumed_by"))
    reason = F.when(F.col("consumed_by").isNull(), F.when(F.col("class") == "BLANK", "EMPTY").when(F.col("class") == "TEXT", "TEXT").otherwise("NO_PLACE"))
    return classified.select("doc_id", "pos", "class").join(used, ["doc_id", "pos"], "left").withColumn("ignored_reason", reason)


# Levels of a deep hierarchy from the top, and the levels that open a clean slate below them.
DEEP_LEVELS = ("TITLE", "CHAPTER", "SECTION", "SUBSECTION", "ARTICLE", "PARAGRAPH", "INCISO", "ALINEA", "ITEM")
HEADINGS = ("TITLE", "CHAPTER", "SECTION", "SUBSECTION")


def deep_hierarchy(elements: DataFrame) -> DataFrame:
    """Path, parent and order of classified elements (doc_id, pos, element_type, label).

    Headings clear lower headings only, not the current article; an article clears what is below it, a
    paragraph clears inciso and alínea, an inciso clears alínea. An article hangs on the lowest open
    heading, a paragraph on the article, an inciso on paragraph or article, an alínea on the inciso, an
    item on the alínea.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    kind, token = F.col("element_type"), key_token(F.col("label"))
    e = elements.withColumn("step", F.concat(kind, F.lit(":"), token))
    cols = {}
    for level in DEEP_LEVELS:
        cols[f"{level}_pos"] = _last(F.when(kind == level, F.col("pos")), w)
        cols[f"{level}_step"] = _last(F.when(kind == level, F.col("step")), w)
    e = e.withColumns(cols)

    def alive(level: str) -> Column:
        above = DEEP_LEVELS[: DEEP_LEVELS.index(level)]
        above = [x for x in above if x in HEADINGS] if level in HEADINGS else [x for x in above if x not in HEADINGS]
        late = F.lit(True)
        for x in above:
            late = late & (F.col(f"{x}_pos").isNull() | (F.col(f"{level}_pos") > F.col(f"{x}_pos")))
        return F.when(F.col(f"{level}_pos").isNotNull() & late, F.col(f"{level}_step"))

    steps = [alive(x) for x in DEEP_LEVELS]
    depth = {x: i for i, x in enumerate(DEEP_LEVELS)}
    path = None
    for level in DEEP_LEVELS:
        own = F.concat_ws("/", F.lit("@root"), *steps[: depth[level] + 1])
        path = F.when(kind == level, own) if path is None else path.when(kind == level, own)
    e = e.withColumn("path", path)
    parent = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    order = F.row_number().over(w)
    orphan = ((kind == "PARAGRAPH") & ~F.col("path").contains("/ARTICLE:")) | ((kind == "INCISO") & ~F.col("path").contains("/ARTICLE:")) | ((kind == "ALINEA") & ~F.col("path").contains("/INCISO:")) | ((kind == "ITEM") & ~F.col("path").contains("/ALINEA:"))
    return e.select(*elements.columns, order.alias("document_order"), F.col("path").alias("identity_key"), parent.alias("parent_key"), orphan.alias("orphan"))


def heading_lookahead(blocks: DataFrame) -> DataFrame:
    """Notes, then rubric lines, right behind a heading attach to it: doc_id, pos, heading_pos, role (NOTE, RUBRIC or EXTRA_RUBRIC)."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    b = blocks.withColumn("heading_pos", _last(F.when(F.col("class") == "HEADING", F.col("pos")), w)).filter("heading_pos is not null")
    v = Window.partitionBy("doc_id", "heading_pos").orderBy("pos")
    b = b.filter(F.col("class") != "HEADING").withColumn("others", F.sum((F.col("class") != "NOTE").cast("int")).over(v)).withColumn("ends", F.sum((~F.col("class").isin("NOTE", "RUBRIC")).cast("int")).over(v))
    b = b.withColumn("late", F.sum(((F.col("class") == "NOTE") & (F.col("others") > 0)).cast("int")).over(v)).withColumn("rubrics", F.sum((F.col("class") == "RUBRIC").cast("int")).over(v))
    role = F.when((F.col("class") == "NOTE") & (F.col("others") == 0), "NOTE").when((F.col("class") == "RUBRIC") & (F.col("ends") == 0) & (F.col("late") == 0), F.when(F.col("rubrics") == 1, "RUBRIC").otherwise("EXTRA_RUBRIC"))
    return b.select("doc_id", "pos", "heading_pos", role.alias("role")).filter("role is not null")


NOTE = r"\(((?:Redação|Incluído|Revogado|Vide|Vetado)[^()]*)\)"


def split_notes(df: DataFrame, text: str = "text", pattern: str = NOTE) -> tuple[DataFrame, DataFrame]:
    """Texts without their editorial notes, and the notes with position and role."""
    notes = df.select("doc_id", "pos", F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("note_no", "note"))
    role = F.when(F.col("note").rlike("^Redação"), "AMENDMENT").when(F.col("note").rlike("^Incluído"), "INCLUSION").when(F.col("note").rlike("^Revogado"), "REVOCATION").when(F.col("note").rlike("^Vetado"), "VETO").otherwise("REFERENCE")
    return df.withColumn(text, normalize_presentation(F.regexp_replace(text, pattern, ""))), notes.withColumn("role", role)


def text_status(df: DataFrame) -> DataFrame:
    """REVOKED by its note, HISTORICAL struck with a marker, UNRESOLVED struck without one, else CURRENT; VETOED by its text."""
    t = F.col("text")
    s = F.when(t.rlike(r"\(Revogado"), "REVOKED").when(t.rlike(r"(?i)\(vetado\)"), "VETOED").when(F.col("struck") & t.rlike(r"\((Redação|Incluído)"), "HISTORICAL").when(F.col("struck"), "UNRESOLVED").otherwise("CURRENT")
    return df.withColumn("text_status", s)


def distinct_provisions(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One identity row per key, the first by order, and keys whose type, label or parent differ."""
    g = elements.groupBy("doc_id", "identity_key").agg(F.min_by(F.struct("element_type", "label", "parent_key"), "document_order").alias("f"), F.count_distinct(F.struct(*(F.coalesce(F.col(c), F.lit("")) for c in ("element_type", "label", "parent_key")))).alias("kinds"), F.count("*").alias("occurrences"))
    return g.select("doc_id", "identity_key", "f.*", "occurrences"), g.filter("kinds > 1").select("doc_id", "identity_key", "kinds")


def demote_current_collisions(elements: DataFrame, exempt: tuple = ("ARTICLE", "CAPUT")) -> DataFrame:
    """Of several CURRENT rows of a key only the last stays CURRENT; earlier ones are UNRESOLVED."""
    cur = F.col("text_status") == "CURRENT"
    later = F.row_number().over(Window.partitionBy("doc_id", "identity_key", "text_status").orderBy(F.desc("document_order")))
    return elements.withColumn("later", later).withColumn("text_status", F.when(cur & (F.col("later") > 1) & ~F.col("element_type").isin(*exempt), "UNRESOLVED").otherwise(F.col("text_status"))).drop("later")


def document_order(elements: DataFrame, by: tuple = ("pos",)) -> DataFrame:
    return elements.withColumn("document_order", F.row_number().over(Window.partitionBy("doc_id").orderBy(*by)))


def resolve_parents(elements: DataFrame) -> DataFrame:
    """Adds parent_order, the parent's place in the same version; null for a root or a parent that's missing.

    The elements are written once; both sides are dealt out in as many partitions as their rows ask for.
    """
    elements = cut(elements)
    rows = elements.count()
    p = spread(elements.select(F.col("version").alias("p_v"), F.col("key").alias("p_k"), F.col("document_order").alias("parent_order")), rows, "p_v", "p_k")
    return spread(elements, rows, "version", "parent_key").join(p, (F.col("version") == F.col("p_v")) & (F.col("parent_key") == F.col("p_k")), "left").drop("p_v", "p_k")


def ancestors(elements: DataFrame, path: str = "path") -> DataFrame:
    """Each node with the list of its ancestors' paths and its depth, from the path alone."""
    steps = F.split(path, "/")
    up = F.filter(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/")), lambda p: p != F.col(path))
    return elements.withColumns({"ancestors": up, "depth": F.size(steps) - 1})


def ancestors_of_keys(elements: DataFrame, by: str = "doc_id", key: str = "key", parent: str = "parent_key", most_depth: int = 64) -> tuple[DataFrame, DataFrame]:
    """Each node with its ancestors from the root down and its depth, from (key, parent) alone, and the nodes that have none because their parents run in a circle.

    Pointers are doubled: after round n a node knows its next 2^n ancestors, so a tree of depth d takes log2(d) + 1 joins,
    each over a written table, dealt out in as many partitions as the nodes ask for.
    A parent that is no node ends the way like a root, and does not count. A node whose way is longer than
    ``most_depth`` is taken to run in a circle. Keys are told apart within ``by``; nodes of a null key have no place.
    """
    nodes = cut(elements.filter(F.col(key).isNotNull()).select(F.struct(F.col(by).alias("by")).alias("d"), F.col(key).alias("k"), F.col(parent).alias("p")))
    rows = nodes.count()
    nodes = spread(nodes, rows, "d", "k")
    known = spread(nodes.select(F.col("d").alias("kd"), F.col("k").alias("kk")).distinct(), rows, "kd", "kk")
    nodes = spread(nodes.groupBy("d", "k").agg(F.min("p").alias("p")), rows, "d", "p")
    up = nodes.join(known, (F.col("d") == F.col("kd")) & (F.col("p") == F.col("kk")), "left").select("d", "k", F.when(F.col("kk").isNotNull(), F.array("kk")).otherwise(F.array().cast(elements.select(F.array(key)).schema[0].dataType)).alias("up"), F.col("kk").alias("top"))
    for _ in range(max(1, (most_depth - 1).bit_length())):
        up = cut(up)
        if up.filter("top is not null").isEmpty():
            break
        next_ = spread(up.select(F.col("d").alias("nd"), F.col("k").alias("nk"), F.col("up").alias("more"), F.col("top").alias("next_top")), rows, "nd", "nk")
        j = spread(up, rows, "d", "top").join(next_, (F.col("d") == F.col("nd")) & (F.col("top") == F.col("nk")), "left")
        up = j.select("d", "k", F.when(F.col("more").isNull(), F.col("up")).otherwise(F.concat("up", "more")).alias("up"), F.col("next_top").alias("top"))
    ended = up.filter("top is null").select(F.col("d.by").alias(by), F.col("k").alias(key), F.reverse("up").alias("ancestors"), F.size("up").alias("depth"))
    return ended, up.filter("top is not null").select(F.col("d.by").alias(by), F.col("k").alias(key))


def validate_tree(elements: DataFrame) -> DataFrame:
    """Violations (doc_id, rule, n): root not first, gaps and repeats in the order, blank texts, unlabelled numbered types, articles without exactly one opening."""
    first, order, kind = F.min_by("provision_type", "document_order"), F.col("document_order"), F.col("provision_type")
    gaps = F.greatest(F.max(order) - F.count("*"), F.count("*") - F.count_distinct(order))
    g = elements.groupBy("doc_id").agg((first != "ROOT").cast("long").alias("ROOT_NOT_FIRST"), gaps.alias("ORDER_GAP"), F.count_if(F.col("text").isNull() & ~kind.isin("ROOT", "ARTICLE")).alias("BLANK_TEXT"), F.count_if(F.col("number_label").isNull() & kind.isin("ARTICLE", "INCISO", "PARAGRAPH")).alias("NO_LABEL"))
    openings = elements.filter(kind.isin("ARTICLE", "CAPUT")).groupBy("doc_id", F.when(kind == "ARTICLE", F.col("stable_key")).otherwise(F.col("parent_key")).alias("article"))
    openings = openings.agg((F.count_if(kind == "ARTICLE") != F.count_if(kind == "CAPUT")).alias("odd")).groupBy("doc_id").agg(F.count_if("odd").alias("CAPUT_COUNT"))
    rules = ["ROOT_NOT_FIRST", "ORDER_GAP", "BLANK_TEXT", "NO_LABEL", "CAPUT_COUNT"]
    return g.join(openings, "doc_id", "left").na.fill(0, ["CAPUT_COUNT"]).unpivot(["doc_id"], rules, "rule", "n").filter("n <> 0")


def article_projection(elements: DataFrame, labels: list[str]) -> DataFrame:
    """Chosen articles with the number of descendants of each type: doc_id, article, element_type, n."""
    chosen = elements.filter((F.col("element_type") == "ARTICLE") & F.col("label").isin(*labels)).select("doc_id", F.col("identity_key").alias("article"), "label")
    below = elements.filter(F.col("identity_key").contains("/ARTICLE:")).select("doc_id", "element_type", F.regexp_extract("identity_key", r"^(.*?/ARTICLE:[^/]+)", 1).alias("article"), "identity_key")
    return chosen.distinct().join(below.filter("identity_key != article"), ["doc_id", "article"]).groupBy("doc_id", "article", "element_type").agg(F.count("*").alias("n"))
