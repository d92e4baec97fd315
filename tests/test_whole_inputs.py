"""Queries of whole passages and all orders leave out no question and no order."""

import __spark_entry__ as entry
from evidentia.plans.inputs import whole_questions


def test_questions_are_whole_passages(spark, sf):
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    rows = whole_questions(spark, sf).collect()
    assert len(rows) == 4 * len(texts) and all(r.question == texts[r.item_id] for r in rows)


def test_all_orders_are_traced_and_ranked(spark, sf):
    orders = sorted(r.o_orderkey for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect())
    assert sorted(r.o_orderkey for r in entry.queries()["F15_search_context"](spark, sf).collect()) == orders
    assert sorted(r.id for r in entry.queries()["F17_rank_of"](spark, sf).collect()) == orders
