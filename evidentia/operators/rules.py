"""The corpus tables' rules as violation counts: within rows, over keys, between tables and versions, and between two states of a table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEX = "length({0}) = 64 and {0} rlike '^[0-9a-f]{{64}}$'"


class Rules(NamedTuple):
    """Rules of one table. ``foreign``: name to (columns, table, its columns); ``frozen``: name of the rule that rows stay as they are."""

    key: tuple[str, ...]
    required: tuple[str, ...]
    checks: dict[str, str]
    unique: dict[str, tuple[str, ...]]
    foreign: dict[str, tuple[tuple[str, ...], str, tuple[str, ...]]]
    frozen: str | None = None


# Names and contents of the corpus tables' rules.
CATALOGUE = {
    "sources": Rules(("id",), ("authority_code", "official_url", "name"), {}, {"uq_sources_authority_url": ("authority_code", "official_url")}, {}),
    "source_snapshots": Rules(
        ("id",), ("source_id", "sha256", "raw_bytes", "byte_length"),
        {"ck_source_snapshots_sha256_hex": HEX.format("sha256"), "ck_source_snapshots_byte_length": "byte_length = octet_length(raw_bytes)"},
        {"uq_snapshots_source_sha": ("source_id", "sha256")}, {"fk_snapshots_source": (("source_id",), "sources", ("id",))}, "trg_source_snapshots_immutable",
    ),
    "legal_acts": Rules(("id",), ("act_code", "jurisdiction", "act_type", "number", "year", "title"), {"ck_legal_acts_year_positive": "year >= 1"}, {"uq_legal_acts_act_code": ("act_code",)}, {}),
    "act_versions": Rules(
        ("id",), ("legal_act_id", "source_snapshot_id", "parser_name", "parser_version", "projection_name", "projection_version", "version_hash"),
        {"ck_act_versions_hash_hex": HEX.format("version_hash")},
        {"uq_act_versions_natural_identity": ("legal_act_id", "source_snapshot_id", "parser_name", "parser_version", "projection_name", "projection_version"), "uq_act_versions_version_hash": ("version_hash",)},
        {"fk_act_versions_legal_act": (("legal_act_id",), "legal_acts", ("id",)), "fk_act_versions_snapshot": (("source_snapshot_id",), "source_snapshots", ("id",))},
    ),
    "provisions": Rules(
        ("id",), ("act_version_id", "stable_key", "provision_type", "document_order", "paragraph_start", "paragraph_end", "content_hash", "legal_status"),
        {
            "ck_provisions_type": "provision_type in ('DOCUMENT_ROOT', 'CHAPTER', 'ARTICLE', 'CAPUT', 'PARAGRAPH', 'INCISO')",
            "ck_provisions_status": "legal_status in ('IN_FORCE', 'VETOED')",
            "ck_provisions_order_positive": "document_order >= 1",
            "ck_provisions_content_hash_hex": HEX.format("content_hash"),
            "ck_provisions_source_locator": "paragraph_start >= 0 and paragraph_end >= paragraph_start",
            "ck_provisions_no_self_parent": "parent_id <> id",
        },
        {"uq_provisions_stable_key": ("act_version_id", "stable_key"), "uq_provisions_document_order": ("act_version_id", "document_order")},
        {"fk_provisions_act_version": (("act_version_id",), "act_versions", ("id",)), "fk_provisions_parent_same_version": (("parent_id", "act_version_id"), "provisions", ("id", "act_version_id"))},
    ),
    "search_units": Rules(
        ("id",), ("act_version_id", "unit_key", "search_text", "content_hash"),
        {"ck_search_units_text_nonempty": "trim(search_text) <> ''", "ck_search_units_content_hash_hex": HEX.format("content_hash")},
        {"uq_search_units_unit_key": ("act_version_id", "unit_key")}, {"fk_search_units_act_version": (("act_version_id",), "act_versions", ("id",))},
    ),
    "search_unit_provisions": Rules(
        ("search_unit_id", "provision_id"), ("position",), {"ck_search_unit_provisions_position": "position >= 0"}, {"uq_search_unit_provisions_position": ("search_unit_id", "position")},
        {"fk_search_unit_provisions_provision": (("provision_id",), "provisions", ("id",)), "fk_search_unit_provisions_search_unit": (("search_unit_id",), "search_units", ("id",))},
    ),
}
SAME_VERSION = "trg_search_unit_provision_same_version"


def changed_rows(before: DataFrame, after: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows of ``before`` that ``after`` no longer has as they were: key and change (UPDATED, DELETED).

    Only keys and row hashes are shuffled. New rows and new columns are no change, nor is another order of rows; of repeated
    keys it is enough that one row of ``after`` equals. Null keys equal each other.
    """
    columns = sorted(before.columns)
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    b = before.select(*key, digest.alias("b_hash")).distinct()
    a = after.select(*(F.col(k).alias(f"a_{k}") for k in key), digest.alias("a_hash")).groupBy(*(f"a_{k}" for k in key)).agg(F.collect_set("a_hash").alias("a_hashes"))
    same_key = F.lit(True)
    for k in key:
        same_key = same_key & F.col(k).eqNullSafe(F.col(f"a_{k}"))
    j = b.join(a, same_key, "left")
    return j.filter(~F.coalesce(F.array_contains("a_hashes", F.col("b_hash")), F.lit(False))).select(*key, F.when(F.col("a_hashes").isNull(), "DELETED").otherwise("UPDATED").alias("change"))


def cross_version_links(links: DataFrame, units: DataFrame, provisions: DataFrame) -> DataFrame:
    """Links whose unit and provision are of different versions; an absent one has the null version, which equals only itself."""
    u = units.select(F.col("id").alias("search_unit_id"), F.col("act_version_id").alias("unit_version")).distinct()
    p = provisions.select(F.col("id").alias("provision_id"), F.col("act_version_id").alias("provision_version")).distinct()
    x = links.join(u, "search_unit_id", "left").join(p, "provision_id", "left")
    return x.filter(~F.col("unit_version").eqNullSafe(F.col("provision_version"))).select("search_unit_id", "provision_id", "unit_version", "provision_version")


def catalogue_report(tables: dict[str, DataFrame], before: dict[str, DataFrame] | None = None, catalogue: dict[str, Rules] = CATALOGUE) -> DataFrame:
    """table, rule, kind, violations of all rules of the given tables.

    CHECK counts rows (a null predicate holds), NOT_NULL null values, PRIMARY and UNIQUE keys met more than once (with no
    null in them), FOREIGN rows whose key, if it has no null, is absent, IMMUTABLE rows of the earlier state changed or gone, and
    SAME_VERSION links across versions, checked once all tables are there. Row rules of a table are one aggregate. Rules to
    tables that aren't given are left out; tables need their named columns only.
    """
    out = []

    def add(df: DataFrame, table: str, rule: str, kind: str) -> None:
        out.append(df.agg(F.count("*").alias("violations")).select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), "violations"))

    for name, df in tables.items():
        r = catalogue[name]
        present = [c for c in (*r.key, *r.required) if c in df.columns]
        of_row: dict[str, Column] = {f"NOT_NULL {c}": F.count_if(F.col(c).isNull()) for c in present}
        of_row |= {f"CHECK {n}": F.count_if(~F.coalesce(F.expr(e), F.lit(True))) for n, e in r.checks.items()}
        if of_row:
            g = df.agg(*(c.alias(n) for n, c in of_row.items())).unpivot([], list(of_row), "rule", "violations")
            out.append(g.select(F.lit(name).alias("table"), F.substring_index("rule", " ", -1).alias("rule"), F.substring_index("rule", " ", 1).alias("kind"), "violations"))
        for rule, cols in {f"pk_{name}": r.key, **r.unique}.items():
            add(df.select(*cols).dropna().groupBy(*cols).count().filter("count > 1"), name, rule, "PRIMARY" if rule == f"pk_{name}" else "UNIQUE")
        for rule, (cols, other, theirs) in r.foreign.items():
            if other in tables:
                known = tables[other].select(*(F.col(t).alias(c) for c, t in zip(cols, theirs, strict=True))).distinct()
                add(df.select(*cols).dropna().join(known, list(cols), "left_anti"), name, rule, "FOREIGN")
        if r.frozen and before and name in before:
            add(changed_rows(before[name], df, r.key), name, r.frozen, "IMMUTABLE")
    if {"search_unit_provisions", "search_units", "provisions"} <= tables.keys():
        add(cross_version_links(tables["search_unit_provisions"], tables["search_units"], tables["provisions"]), "search_unit_provisions", SAME_VERSION, "SAME_VERSION")
    report = out[0]
    for x in out[1:]:
        report = report.union(x)
    return report
