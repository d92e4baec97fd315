"""Audits: rules as violation counts, structure counters, findings and the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITY = {"BLOCKER": 0, "ERROR": 1, "WARNING": 2, "INFO": 3}


def corpus_audit(snapshots: DataFrame, provisions: DataFrame, units: DataFrame, links: DataFrame) -> DataFrame:
    """Named boolean checks per version (version, check, ok), each from one aggregate.

    ``snapshots``: version, raw_bytes, sha256, byte_length; ``provisions``: version, key, parent_key, document_order, text,
    content_hash; ``units``: version, unit_key, text, content_hash; ``links``: version, unit_key, stable_key.
    """
    all_of = lambda c: F.min(F.coalesce(c, F.lit(False)).cast("int")) == 1
    one = lambda c: F.count_distinct(c) == F.count("*")
    s = snapshots.groupBy("version").agg(all_of(F.sha2("raw_bytes", 256) == F.col("sha256")).alias("snapshot_hash"), all_of(F.octet_length("raw_bytes") == F.col("byte_length")).alias("snapshot_length"))
    p = provisions.groupBy("version").agg(one("key").alias("unique_keys"), one("document_order").alias("unique_orders"), (F.max("document_order") - F.min("document_order") + 1 == F.count("*")).alias("contiguous_order"), all_of(F.sha2(F.coalesce("text", F.lit("")), 256) == F.col("content_hash")).alias("provision_hashes"), all_of(F.coalesce(F.col("parent_key") != F.col("key"), F.lit(True))).alias("no_self_parent"))
    u = units.groupBy("version").agg(one("unit_key").alias("unique_units"), all_of(F.sha2("text", 256) == F.col("content_hash")).alias("unit_hashes"), all_of(F.col("text").rlike(r"\S")).alias("unit_text"))
    keys = provisions.select("version", F.col("key").alias("k")).distinct()
    lost = lambda df, c: df.filter(F.col(c).isNotNull()).join(keys.withColumnRenamed("k", c), ["version", c], "left_anti").groupBy("version").agg(F.count("*").alias("lost"))
    versions = provisions.select("version").distinct()
    parents = versions.join(lost(provisions, "parent_key"), "version", "left").select("version", F.col("lost").isNull().alias("known_parents"))
    linked = versions.join(lost(links, "stable_key"), "version", "left").select("version", F.col("lost").isNull().alias("known_links"))
    out = None
    for t in (s, p, u, parents, linked):
        names = t.columns[1:]
        long = t.select("version", *(F.col(n).cast("boolean").alias(n) for n in names)).unpivot(["version"], names, "check", "ok")
        out = long if out is None else out.unionByName(long)
    return out


def version_audit(versions: DataFrame, provisions: DataFrame, units: DataFrame, links: DataFrame, lines: DataFrame, coverage: DataFrame, parsed: DataFrame, projected: DataFrame) -> DataFrame:
    """Checks of stored versions against their identity, their links and what is derived again from their bytes: version, check, ok.

    ``versions``: version, identity, version_hash; ``provisions``: version, pos_start, pos_end; ``units``: version, unit_key;
    ``links``: version, unit_key, provision_version; ``lines`` and ``coverage``, a row a line; ``parsed`` and ``projected``, the
    provisions and units derived again (see ``law.reproject``, ``law.reparse_difference`` says which rows differ). A null
    place or hash fails its check; a version without rows has none to fail, rows of unknown versions are not looked at.
    """
    per = lambda df, **n: df.groupBy("version").agg(*(c.alias(k) for k, c in n.items()))
    rows = F.count("*")
    sound = (F.col("pos_start") >= 0) & (F.col("pos_end") >= F.col("pos_start"))
    u, k = units.select("version", "unit_key").distinct(), links.select("version", "unit_key").distinct()
    loose = u.join(k, ["version", "unit_key"], "left_anti").union(k.join(u, ["version", "unit_key"], "left_anti"))
    counts = (
        per(provisions, stored=rows, misplaced=F.count_if(~F.coalesce(sound, F.lit(False)))), per(units, stored_units=rows), per(loose, loose=rows),
        per(links, crossed=F.count_if(~F.col("provision_version").eqNullSafe(F.col("version")))), per(lines, lines=rows), per(coverage, covered=rows),
        per(parsed, parsed=rows), per(projected, projected=rows),
    )
    v = versions.select("version", F.coalesce(F.sha2("identity", 256) == F.col("version_hash"), F.lit(False)).alias("version_hash"))
    for df in counts:
        v = v.join(df, "version", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    checks = {
        "version_hash": F.col("version_hash"), "source_locators": n("misplaced") == 0, "all_units_linked": n("loose") == 0, "links_same_version": n("crossed") == 0,
        "coverage": n("covered") == n("lines"), "materialized_provisions": n("stored") == n("parsed"), "materialized_units": n("stored_units") == n("projected"),
    }
    return v.select("version", *(c.alias(k) for k, c in checks.items())).unpivot(["version"], list(checks), "check", "ok")


def trace_unit(units: DataFrame, links: DataFrame, provisions: DataFrame, versions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Unit to its first linked provision, version, snapshot and source."""
    first = links.groupBy("version", "unit_key").agg(F.min_by("stable_key", "position").alias("key"))
    return units.join(first, ["version", "unit_key"]).join(provisions.select("version", "key", "document_order"), ["version", "key"]).join(versions, "version").join(snapshots, "snapshot_id")


def constraint_report(table: DataFrame, checks: dict | None = None, unique: dict | None = None, foreign: dict | None = None) -> DataFrame:
    """rule, kind, violations for CHECK predicates, UNIQUE column lists and FOREIGN keys (columns, other table). A null predicate holds, as in SQL."""
    rows = []
    if checks:
        g = table.agg(*(F.count_if(~F.coalesce(F.expr(e), F.lit(True))).alias(n) for n, e in checks.items()))
        rows.append(g.unpivot([], list(checks), "rule", "violations").withColumn("kind", F.lit("CHECK")))
    for name, cols in (unique or {}).items():
        rows.append(table.groupBy(*cols).count().filter("count > 1").agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations", F.lit("UNIQUE").alias("kind")))
    for name, (cols, other, theirs) in (foreign or {}).items():
        k = other.select(*(F.col(t).alias(c) for c, t in zip(cols, theirs, strict=True))).distinct()
        held = table.select(*cols).dropna()
        rows.append(held.join(k, cols, "left_anti").agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations", F.lit("FOREIGN").alias("kind")))
    out = rows[0].select("rule", "kind", "violations")
    for r in rows[1:]:
        out = out.union(r.select("rule", "kind", "violations"))
    return out


def structure_counters(elements: DataFrame) -> DataFrame:
    """(counter, a, b, n): elements by type, status by type, parent-child type pairs and depths, in one pass of grouping sets."""
    e = elements.withColumn("parent_type", F.regexp_extract("parent_key", r"([A-Z]+):[^/]*$", 1)).withColumn("depth", (F.size(F.split("identity_key", "/")) - 1).cast("string"))
    g = e.groupingSets([["element_type"], ["element_type", "text_status"], ["parent_type", "element_type"], ["depth"]], "element_type", "text_status", "parent_type", "depth").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    name = {0b0111: ("TYPE", "element_type", None), 0b0011: ("STATUS", "element_type", "text_status"), 0b0101: ("EDGE", "parent_type", "element_type"), 0b1110: ("DEPTH", "depth", None)}
    pick = lambda i: F.coalesce(*(F.when(F.col("gid") == k, F.lit(v[0]) if i == 0 else F.col(v[i]) if v[i] else F.lit(None).cast("string")) for k, v in name.items()))
    return g.select(pick(0).alias("counter"), pick(1).alias("a"), pick(2).alias("b"), "n")


def act_counters(elements: DataFrame) -> DataFrame:
    """(doc_id, counter, a, n) of each act's elements as :func:`deep.parse_act` gives them, in one pass; rows stay where their document is.

    NOTE_PARENT: notes by the type they hang on (NONE without parent); NOTE_ARTICLE: by the article they are in (NO_ARTICLE);
    ROLE: elements by content role; DUPLICATE_KEY: keys met several times, with their occurrences; ODD_LABEL: articles whose label is
    no plain number. Nulls are groups of their own.
    """
    parent = F.when(F.col("parent_key") == "@root", "DOCUMENT_ROOT").otherwise(F.regexp_extract("parent_key", r"([A-Z_]+):[^/]*$", 1))
    inside = F.regexp_extract("parent_key", "/ARTICLE:([^/]+)", 1)
    note, article = F.col("element_type") == "NOTE", F.col("element_type") == "ARTICLE"
    tags = {
        "NOTE_PARENT": F.when(note, F.coalesce(parent, F.lit("NONE"))), "NOTE_ARTICLE": F.when(note, F.when(F.coalesce(inside, F.lit("")) == "", "NO_ARTICLE").otherwise(inside)),
        "ROLE": F.coalesce("content_role", F.lit("NONE")), "DUPLICATE_KEY": F.col("identity_key"), "ODD_LABEL": F.when(article & ~F.coalesce(F.col("label").rlike("^[0-9]+$"), F.lit(False)), F.coalesce("label", F.lit("NONE"))),
    }
    e = elements.select("doc_id", F.explode(F.array(*(F.struct(F.lit(n).alias("counter"), c.alias("a")) for n, c in tags.items()))).alias("t")).filter("t.a is not null")
    g = e.groupBy("doc_id", "t.counter", "t.a").agg(F.count("*").alias("n"))
    return g.filter((F.col("counter") != "DUPLICATE_KEY") | (F.col("n") > 1))


def deepest_path(elements: DataFrame, path: str = "identity_key") -> DataFrame:
    depth = F.size(F.split(path, "/")) - 1
    return elements.groupBy("doc_id").agg(F.max_by(F.struct(F.col(path).alias("p"), depth.alias("d")), F.struct(depth, -F.col("document_order"))).alias("m")).select("doc_id", F.col("m.p").alias("deepest_path"), F.col("m.d").alias("depth"))


def duplicate_groups(elements: DataFrame) -> DataFrame:
    """Repeated keys: HISTORICAL_REDACTION (one CURRENT, others not), PARSER_DUPLICATION (same text), else AMBIGUITY."""
    g = elements.groupBy("doc_id", "identity_key").agg(F.count("*").alias("n"), F.count_if(F.col("text_status") == "CURRENT").alias("current"), F.count_distinct(F.coalesce("text", F.lit(""))).alias("texts")).filter("n > 1")
    return g.withColumn("kind", F.when((F.col("current") == 1), "HISTORICAL_REDACTION").when(F.col("texts") == 1, "PARSER_DUPLICATION").otherwise("AMBIGUITY"))


def finding(df: DataFrame, code: str, severity: str, where: str = "pos") -> DataFrame:
    return df.select("doc_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(where).cast("long").alias("block"))


def findings(elements: DataFrame, edges: list[tuple[str, str]]) -> DataFrame:
    """Findings with a common schema: orphans, parent-child types outside the allowed edges, blank texts. Whole acts: ``act_audit``."""
    e = elements.withColumn("parent_type", F.regexp_extract("parent_key", r"([A-Z]+):[^/]*$", 1))
    allowed = F.lit(False)
    for a, b in edges:
        allowed = allowed | ((F.col("parent_type") == a) & (F.col("element_type") == b))
    out = finding(e.filter("orphan"), "ORPHAN", "BLOCKER")
    out = out.union(finding(e.filter(~allowed & ~F.col("orphan")), "HIERARCHY_EDGE", "ERROR"))
    out = out.union(finding(e.filter(~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))), "BLANK_TEXT", "WARNING"))
    return out


def diagnose_unclassified(blocks: DataFrame) -> DataFrame:
    """Kind and severity of blocks nothing matched, by a ladder of patterns."""
    t = F.col("text")
    kind = F.when(~t.rlike(r"\S"), "EMPTY").when(t.rlike(r"^\s*\("), "NOTE_LIKE").when(t.rlike(r"^\s*\d+[.)-]"), "NUMBERED").when(t.rlike(r"^[^a-zà-ÿ]*[A-ZÀ-Þ][^a-zà-ÿ]*$"), "HEADING_LIKE").when(t.rlike(r"[.;:]\s*$"), "SENTENCE").otherwise("FRAGMENT")
    b = blocks.withColumn("kind", kind)
    return b.withColumn("severity", F.when(F.col("kind").isin("NUMBERED", "HEADING_LIKE"), "ERROR").when(F.col("kind") == "EMPTY", "INFO").otherwise("WARNING"))


def unresolved_causes(elements: DataFrame) -> DataFrame:
    cause = F.when(F.col("struck"), "STRUCK_WITHOUT_MARKER").otherwise("COLLISION")
    return elements.filter(F.col("text_status") == "UNRESOLVED").groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


def strike_matrix(elements: DataFrame, statuses: list[str]) -> DataFrame:
    return elements.groupBy("struck").agg(*(F.count_if(F.col("text_status") == s).alias(s.lower()) for s in statuses))


def block_reuse(elements: DataFrame) -> DataFrame:
    """Blocks that gave several elements, with their types; ``unusual`` unless they are an article and its opening."""
    g = elements.groupBy("doc_id", "pos").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("provision_type")), "+").alias("types")).filter("n > 1")
    return g.withColumn("unusual", F.col("types") != "ARTICLE+CAPUT")


def coverage_summary(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count("consumed_by").alias("consumed"), F.count("ignored_reason").alias("ignored"), F.round(F.count("consumed_by") / F.count("*"), 6).alias("ratio"), F.count_if(F.col("ignored_reason") == "EMPTY").alias("empty"))


def gate(found: DataFrame) -> DataFrame:
    """BLOCKED if a document has a BLOCKER."""
    return found.groupBy("doc_id").agg(F.when(F.max((F.col("severity") == "BLOCKER").cast("int")) == 1, "BLOCKED").otherwise("PASSED").alias("status"), F.count("*").alias("findings"))


def by_severity(found: DataFrame) -> DataFrame:
    order = F.create_map(*(x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))))
    return found.orderBy(F.element_at(order, F.col("severity")), "doc_id", "code", "block")
