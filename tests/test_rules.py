"""Rules between two states of a table, across versions, and on tables that break none."""

from evidentia.operators import rules


def test_changed_rows(spark):
    before = spark.createDataFrame([(1, "a", b"x"), (2, "b", None), (3, "c", b"z"), (4, "d", b"w"), (None, "e", b"v"), (4, "d", b"w")], "id int, name string, raw binary")
    after = spark.createDataFrame([("a", 1, b"x", 9), ("b", 2, b"", 9), ("d", 4, b"w", 9), ("d", 4, b"other", 9), ("e", None, b"v", 9), ("n", 7, b"n", 9)], "name string, id int, raw binary, more int")
    got = sorted((r.id, r.change) for r in rules.changed_rows(before, after, ("id",)).collect())
    assert got == [(2, "UPDATED"), (3, "DELETED")]
    assert rules.changed_rows(before, after.limit(0), ("id",)).count() == 5  # the repeated row is one
    assert rules.changed_rows(before.limit(0), after, ("id",)).count() == 0


def test_cross_version(spark):
    links = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (1, 99), (9, 99)], "search_unit_id int, provision_id int")
    units = spark.createDataFrame([(1, "v"), (2, "w"), (3, None)], "id int, act_version_id string")
    provisions = spark.createDataFrame([(10, "v"), (10, "v")], "id int, act_version_id string")
    got = sorted((r.search_unit_id, r.provision_id) for r in rules.cross_version_links(links, units, provisions).collect())
    assert got == [(1, 99), (2, 10), (3, 10)]


def test_catalogue_names_every_rule_and_empty_tables_break_none(spark):
    columns = {n: {*r.key, *r.required, *(c for cs in r.unique.values() for c in cs), *(c for cs, *_ in r.foreign.values() for c in cs)} for n, r in rules.CATALOGUE.items()}
    columns["provisions"] |= {"parent_id"}
    tables = {n: spark.createDataFrame([], ", ".join(f"{c} string" for c in sorted(cs))) for n, cs in columns.items()}
    report = rules.catalogue_report(tables, tables).collect()
    expected = sum(len({*r.key, *r.required}) + 1 + len(r.checks) + len(r.unique) + len(r.foreign) + bool(r.frozen) for r in rules.CATALOGUE.values()) + 1
    assert len(report) == len({(r.table, r.rule, r.kind) for r in report}) == expected
    assert all(r.violations == 0 for r in report)
