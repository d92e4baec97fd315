"""Places, hash trees and percentiles over groups of which one holds most rows."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from evidentia.operators import evaluate, ranks


def rows():
    rnd = random.Random(6)
    out = [("hot", rnd.choice([None, 1.5, rnd.random()]), i) for i in range(3000)] + [("same", 7.0, i) for i in range(500)] + [(None, float(i), i) for i in range(5)] + [("one", 1.0, 0)]
    return rnd.sample(out, len(out))


def test_places(spark):
    df = spark.createDataFrame(rows(), "k string, v double, i int")
    got = {}
    r = ranks.ranked(df, ["k"], ["v"], parts=9)
    for x in r.collect():
        got.setdefault(x.k, []).append((x.n, x.v))
    for k, places in got.items():
        places.sort()
        assert [n for n, _ in places] == list(range(1, len(places) + 1))
        assert [v for _, v in places] == sorted((v for kk, v, _ in rows() if kk == k), key=lambda v: (v is not None, v or 0))
    assert sorted(r.columns) == ["i", "k", "n", "v"]
    own = ranks.cut(df.repartitionByRange(9, "k", "v", F.rand(11)).withColumn("p", F.spark_partition_id()))
    assert own.groupBy("p").count().agg({"count": "max"}).first()[0] < 1500  # no task gets the hot group
    assert ranks.ranked(df.limit(0), ["k"], ["v"]).collect() == []


def test_hash_tree(spark):
    df = spark.createDataFrame(rows(), "k string, v double, i int")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for fan in (4, 1000):
        want = {}
        for k in ("hot", "same", None, "one"):
            own = sorted(((i, sha(json.dumps({"i": i}, separators=(",", ":")))) for kk, _, i in rows() if kk == k))
            level = dict(enumerate((h for _, h in own), 1))
            while True:
                groups = {}
                for n, h in level.items():
                    groups.setdefault(n // fan, []).append(h)
                level = {c: sha("\n".join(hs)) for c, hs in groups.items()}
                if len(level) <= fan:
                    break
            want[k] = sha("\n".join(level.values()))
        assert {r.k: r.fingerprint for r in ranks.fingerprint(df.repartition(7), "k", ["i"], ["i"], fan).collect()} == want


def test_hash_of_chunks_in_one_step(spark):
    """Of more than fan * fan rows, too, ``levels=1`` hashes the chunks' hashes at once, as the SQL of B10_fingerprint_all does."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    n, fan = 100, 4
    df = spark.range(n).selectExpr("'all' as k", "id as i").repartition(5)
    h = [sha(json.dumps({"i": i}, separators=(",", ":"))) for i in range(n)]
    chunks = [sha("\n".join(h[j - 1] for j in range(max(1, c * fan), min(n, c * fan + fan - 1) + 1))) for c in range(n // fan + 1)]
    assert [r.fingerprint for r in ranks.fingerprint(df, "k", ["i"], ["i"], fan, levels=1).collect()] == [sha("\n".join(chunks))]


def test_percentiles(spark):
    df = spark.createDataFrame(rows(), "k string, v double, i int")
    for r in evaluate.latency_summary(df, "k", "v").collect():
        v = sorted(x for k, x, _ in rows() if k == r.k and x is not None)
        n = len(v)
        assert (r.n, r.p95, r.maximum) == (n, round(v[max(1, int(n * 0.95)) - 1], 6), v[-1])
        assert abs(r.p50 - (v[(n + 1) // 2 - 1] + v[(n + 2) // 2 - 1]) / 2) < 1e-6 and abs(r.total - sum(v)) < 1e-3
    assert evaluate.latency_summary(df.filter("v is null"), "k", "v").collect() == []
