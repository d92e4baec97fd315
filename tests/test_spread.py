"""Tables by document are dealt out as their rows ask, and stay so through acts and their counters."""

import re

import pytest

from evidentia.operators import audit, deep, structure
from evidentia.plans import structures
from evidentia.sources import scratch


@pytest.mark.parametrize("made", [structures.deep_rows, lambda s, d: deep.parse_act(structures.act_lines(s, d)).elements, lambda s, d: audit.act_counters(deep.parse_act(structures.act_lines(s, d)).elements)])
def test_one_partitioning_by_document(spark, sf, monkeypatch, made):
    monkeypatch.setattr(scratch, "SPREAD_ROWS", 200)
    plan = made(spark, sf)._jdf.queryExecution().executedPlan().toString()
    by = re.findall(r"Exchange hashpartitioning\(\w+#\d+L?, (\d+)\)", plan)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert by and set(by) == {str(-(-lines // 200))} and "Exchange hashpartitioning" in plan
    assert len(re.findall("Exchange hashpartitioning", plan)) == len(by)


@pytest.mark.parametrize("made", [
    lambda s: structure.resolve_parents(s.range(1000).selectExpr("id % 7 as version", "id as key", "id - 7 as parent_key", "id as document_order")),
    lambda s: structure.ancestors_of_keys(s.range(1000).selectExpr("if(id % 7 = 0, null, id % 7) as doc_id", "id as key", "if(id % 3 = 0, id - 7, null) as parent_key"), most_depth=1)[0],
])
def test_joins_on_keys_in_as_many_partitions_as_rows_ask(spark, monkeypatch, made):
    monkeypatch.setattr(scratch, "SPREAD_ROWS", 20)
    out = made(spark)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert {int(n) for n in re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\), REPARTITION", plan)} <= {50}
    assert "ENSURE_REQUIREMENTS" not in plan and out.count() == 1000


def test_ancestors_within_a_null_document(spark):
    rows = spark.createDataFrame([(None, "a", None), (None, "b", "a"), (None, "c", "b"), (1, "c", "b"), (1, "x", "x")], "doc_id long, key string, parent_key string")
    ended, circle = structure.ancestors_of_keys(rows)
    assert sorted((r.doc_id or 0, r.key, r.ancestors) for r in ended.collect()) == [(0, "a", []), (0, "b", ["a"]), (0, "c", ["a", "b"]), (1, "c", [])]
    assert [(r.doc_id, r.key) for r in circle.collect()] == [(1, "x")]
