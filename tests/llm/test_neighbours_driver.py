"""What the nearest-neighbour search sends to the driver does not grow with the table."""

import re

from pyspark.sql import functions as F

from evidentia.llm import neighbours


def test_what_cells_are_asked_is_not_broadcast(spark):
    """The planner takes it for as large as the queries, which are few."""
    v = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos(F.col("id") * 3), F.sin(F.col("id") * 7)).alias("embedding"))
    found = neighbours.nearest(v, F.col("vec_id") % 10 == 0, k=3, trees=2, share=1.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInPandas compare"):]
    assert re.search(r"\w+Join", below)[0] == "SortMergeJoin"
    assert found.count() == 120


def test_tasks_send_few_entries(spark):
    entries = spark.range(20_000, numPartitions=40).select(F.xxhash64("id").alias("entry")).cache()
    every = sorted(r.entry for r in entries.collect())
    for last, want in ((False, every[:300]), (True, every[:-301:-1])):
        got = neighbours.by_hash(entries, 20_000, 300, last)
        assert [r.entry for r in got.collect()] == want
        looked_at = got._jdf.queryExecution().optimizedPlan().toString()
        bound = int(re.search(r"entry#\d+L? [<>]=? (-?\d+)", looked_at)[1])
        assert sum(e >= bound if last else e < bound for e in every) < 900
    assert neighbours.by_hash(entries.limit(200).coalesce(1), 200, 300).count() == 200


def test_hashes_that_are_not_uniform_lose_no_entry(spark):
    entries = spark.range(5_000).select((F.col("id") + 2**62).alias("entry"))
    assert [r.entry - 2**62 for r in neighbours.by_hash(entries, 5_000, 100).collect()] == list(range(100))
