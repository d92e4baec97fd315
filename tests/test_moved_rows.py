"""What retrieval moves: postings once, texts of candidates only, hits of units that can still match."""

from evidentia.operators import index, retrieve


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_of_unique_units_are_not_shuffled(spark):
    rows = [("v", "1", "Beta alpha beta, betas gamma"), ("v", "2", ""), ("v", "3", None), ("w", "1", "alpha"), (None, "4", "x yy zeta")]
    u = spark.createDataFrame(rows, "version string, unit_key string, text string")
    want = {("v", "beta", "1", (0, 2, 3), 3), ("v", "alpha", "1", (1,), 1), ("v", "gamma", "1", (4,), 1), ("w", "alpha", "1", (0,), 1), (None, "zeta", "4", (0,), 1)}
    got = index.build_postings(u)
    assert got.columns == ["version", "term", "unit_key", "positions", "tf"] and "Exchange" not in plan(got)
    seen = lambda p: sorted(((r.version, r.term, r.unit_key, tuple(r.positions), r.tf) for r in p.collect()), key=str)
    assert seen(got) == sorted(want, key=str)
    twice = seen(index.build_postings(u.union(u.filter("version = 'w'"))))
    assert twice == sorted(want - {("w", "alpha", "1", (0,), 1)} | {("w", "alpha", "1", (0, 0), 2)}, key=str)


def kept(monkeypatch):
    out, real = [], retrieve.likely
    monkeypatch.setattr(retrieve, "likely", lambda rows, col, keys: (out.append((rows.count(), (x := real(rows, col, keys)).count())), x)[1])
    return out


def test_hybrid_search_moves_texts_of_candidates(spark, monkeypatch):
    calls = kept(monkeypatch)
    q = spark.createDataFrame([(1, "v", "alpha bravo")], "question_id long, version string, question string")
    qv = spark.createDataFrame([(1, [1.0, 0.0])], "question_id long, vector array<double>")
    v = spark.createDataFrame([(2, [1.0, 0.0])], "id long, vector array<double>")
    texts = {0: "alpha opening", 1: "alpha bravo", 2: "bravo", **{k: "delta" for k in range(3, 500)}}
    units = spark.createDataFrame([("v", str(k), x) for k, x in texts.items()], "version string, unit_key string, text string")
    elements = spark.createDataFrame([(k, 0 if k else None, x, "ITEM" if k else "ARTICLE", f"@root/ARTICLE:1/INCISO:{k}" if k else "@root/ARTICLE:1/@caput") for k, x in texts.items()], "key long, parent_key long, text string, element_type string, path string")
    rows = {r.id: r for r in retrieve.hybrid_search(q, qv, index.build_postings(units), v, elements, 10).collect()}
    assert set(rows) == {0, 1, 2} and {i for i, r in rows.items() if r.contextual_score > r.boosted} == {2}
    assert [n for n, _ in calls[1:]] == [500, 500] and calls[1][1] == 3 and calls[2][1] == 1


def test_strict_search_joins_only_units_with_the_rarest_term(spark, monkeypatch):
    calls = kept(monkeypatch)
    units = spark.createDataFrame([("v", str(i), "alpha bravo" + (" charlie" if i % 100 == 0 else "")) for i in range(300)], "version string, unit_key string, text string")
    q = spark.createDataFrame([(1, "v", "alpha bravo charlie")], "question_id int, version string, question string")
    p = index.build_postings(units)
    got = retrieve.search_strict(q, p, frequencies=index.document_frequency(p))
    assert {r.unit_key for r in got.collect()} == {"0", "100", "200"}
    assert calls == [(603, 9)]


def test_buckets_follow_the_text(spark, monkeypatch, sf):
    from evidentia.plans import inputs

    asked = []
    monkeypatch.setattr(inputs.index, "store_index", lambda *a, **k: asked.append(k["buckets"]))
    monkeypatch.setattr(inputs.index, "stored", lambda *a: None)
    monkeypatch.setattr(inputs, "BUCKET_BYTES", 1000)
    monkeypatch.setattr(inputs.hashlib, "md5", lambda b: type("H", (), {"hexdigest": lambda self: "not_there_before"})())
    inputs.stored_index(spark, sf)
    assert asked and asked[0] > 100
