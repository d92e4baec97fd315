"""Stored postings, nearest vectors, ancestors of keys."""

import numpy as np
import pytest

from evidentia.operators import index, retrieve, structure
from evidentia.plans.inputs import stored_index, units, vectors, whole_questions
from evidentia.sources.scratch import scratch

UNITS = [("v1", "a", "red green red blue"), ("v1", "b", "green"), ("v2", "a", "red stone"), ("v2", "c", "blue blue"), ("v3", "d", None), ("v3", "e", "")]


def lists(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_versions_come_and_go(spark):
    u = spark.createDataFrame(UNITS, "version string, unit_key string, text string")
    name = "test_versions_come_and_go"
    index.store_index(u.filter("version = 'v1'"), name, scratch(spark), buckets=4)
    index.store_index(u.filter("version != 'v1'"), name, scratch(spark) + "/unused", buckets=4)
    want = lists(index.build_postings(u), "version", "term", "unit_key", "tf")
    p, df, sizes = index.stored(spark, name)
    assert lists(p, "version", "term", "unit_key", "tf") == want
    assert lists(df, "version", "term", "df") == lists(index.document_frequency(index.build_postings(u)), "version", "term", "df")
    assert lists(sizes, "version", "n_units") == [("v1", 2), ("v2", 2), ("v3", 2)]
    with pytest.raises(ValueError, match="v2"):
        index.store_index(u.filter("version = 'v2'"), name, "unused", buckets=4)
    index.withdraw_version(spark, name, "v2")
    p, df, sizes = index.stored(spark, name)
    assert {r.version for x in (p, df) for r in x.collect()} == {"v1"} and lists(sizes, "version") == [("v1",), ("v3",)]
    index.store_index(u.filter("version = 'v2'"), name, "unused", buckets=4)
    assert lists(index.stored(spark, name)[0], "version", "term", "unit_key", "tf") == want


def test_no_posting_is_shuffled(spark, sf):
    """The only exchanges are of questions and of what they match; also where nothing is small enough to broadcast."""
    postings, df, sizes = stored_index(spark, sf)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (retrieve.search_strict(whole_questions(spark, sf), postings), retrieve.search_weighted_coverage(whole_questions(spark, sf), postings, index.idf_weights(df, sizes), sizes)):
            found.collect()
            plan = found._jdf.queryExecution().executedPlan().toString()
            plan = plan[plan.index("Final Plan") : plan.index("Initial Plan")] if "Initial Plan" in plan else plan
            lines = plan.split("\n")
            depth = lambda x: len(x) - len(x.lstrip(" :+-"))
            scans = [i for i, x in enumerate(lines) if "SelectedBucketsCount" in x]
            assert scans
            for i in scans:
                level, up = depth(lines[i]), i
                while "Join" not in lines[up]:
                    up -= 1
                    if depth(lines[up]) < level:  # an ancestor of the scan
                        level = depth(lines[up])
                        assert "Exchange" not in lines[up] and "QueryStage" not in lines[up]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def exact(v, k=10):
    rows = [(r.id, r.vector) for r in v.collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([w for _, w in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return {int(q): [int(ids[i]) for i in np.lexsort((ids, -np.round(x[ids == q][0] @ x.T, 6)))[:k]] for q in ids if q % 50 == 0}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.question_id, r["rank"])):
        out.setdefault(r.question_id, []).append(r.id)
    return out


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1", "made"])
def test_recall_of_near_search(spark, sf, size):
    if size == "made":
        rng = np.random.default_rng(2)
        x = rng.normal(size=(400, 32))[rng.integers(0, 400, 20_000)] + 0.25 * rng.normal(size=(20_000, 32))
        v = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(x)], "id long, vector array<double>").repartition(8)
        options = {}
    else:
        v, options = vectors(spark, sf.rpartition("/")[0] + f"/{size}"), {"tables": 24, "probes": 16}
    q = v.filter("id % 50 = 0").selectExpr("id as question_id", "vector")
    want, got = exact(v), found(retrieve.vector_search_near(q, v, **options))
    recall = sum(len(set(w) & set(got.get(i, []))) for i, w in want.items()) / sum(map(len, want.values()))
    assert recall >= 0.9, recall
    if size != "made":
        assert found(retrieve.vector_search(q, v)) == want


def test_vectors_of_all_kinds(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "ROW_BLOCK", 3)
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 2)
    rows = [(i, [1.0, float(i)]) for i in range(8)] + [(100 + i, [1.0, 1.0]) for i in range(30)] + [(50, None), (51, [0.0, 0.0]), (52, [1.0, None]), (53, [float("nan"), 1.0]), (54, [1.0]), (55, [float("inf"), 1.0])]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 1.0]), (2, [2.0]), (3, None), (4, [0.0, 1.0]), (5, [1.0, 0.0])], "question_id long, vector array<double>")
    want = {1: [1, *range(100, 109)], 2: [54], 4: [7, 6, 5, 4, 3, 2, 1, 100, 101, 102], 5: [0, 1, *range(100, 108)]}
    assert found(retrieve.vector_search(q, v)) == want
    assert found(retrieve.vector_search_near(q, v, planes=1, tables=4, probes=2, salt_rows=5)) == want
    for f in (retrieve.vector_search, retrieve.vector_search_near):
        assert f(q.limit(0), v).collect() == [] == f(q, v.limit(0)).collect()


def test_ancestors_of_keys(spark):
    chain = [(1, f"n{i}", f"n{i - 1}" if i else None) for i in range(21)]
    other = [(1, "x", "lost"), (1, "y", "x"), (1, "a", "b"), (1, "b", "a"), (1, "c", "a"), (1, "self", "self"), (2, "n1", None), (2, "n2", "n1"), (None, "k", None), (None, "m", "k"), (2, None, "n1"), (2, "n2", "n1")]
    e = spark.createDataFrame(chain + other, "doc_id int, key string, parent_key string")
    ended, circles = structure.ancestors_of_keys(e)
    got = {(r.doc_id, r.key): (r.depth, list(r.ancestors)) for r in ended.collect()}
    want = {(1, f"n{i}"): (i, [f"n{j}" for j in range(i)]) for i in range(21)}
    want |= {(1, "x"): (0, []), (1, "y"): (1, ["x"]), (2, "n1"): (0, []), (2, "n2"): (1, ["n1"]), (None, "k"): (0, []), (None, "m"): (1, ["k"])}
    assert got == want and ended.count() == len(want)
    assert {(r.doc_id, r.key) for r in circles.collect()} == {(1, "a"), (1, "b"), (1, "c"), (1, "self")}
    assert all(x.count() == 0 for x in structure.ancestors_of_keys(e.limit(0)))


def test_strict_search_by_rarest_terms(spark):
    units_ = spark.createDataFrame([("v", str(i), t) for i, t in enumerate(["alpha bravo charlie", "alpha bravo", "bravo x alpha y charlie alpha", "charlie", "delta"])], "version string, unit_key string, text string")
    q = spark.createDataFrame([(1, "v", "alpha charlie"), (2, "v", "alpha missing"), (3, "v", ""), (4, "w", "alpha"), (5, "v", "bravo")], "question_id int, version string, question string")
    p = index.build_postings(units_)
    plain, pruned = (lists(retrieve.search_strict(q, p, frequencies=f), "question_id", "unit_key", "score", "rank") for f in (None, index.document_frequency(p)))
    assert plain == pruned and {r[0] for r in plain} == {1, 5}
