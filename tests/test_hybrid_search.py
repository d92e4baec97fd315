"""hybrid_search has all its steps: parent text and openings change the order, as by hand."""

from evidentia.operators import index, retrieve

TEXTS = {
    1: "alpha filler",  # the opening of article 1
    2: "beta gamma delta epsilon",  # only together with its parent it has every word of the question
    3: "beta gamma delta epsilon",  # the same without a parent
    4: "unrelated words here",
}


def test_hybrid_search_by_hand(spark):
    q = spark.createDataFrame([(1, "v", "alpha beta gamma delta epsilon")], "question_id long, version string, question string")
    qv = spark.createDataFrame([(1, [1.0, 0.0])], "question_id long, vector array<double>")
    v = spark.createDataFrame([(3, [1.0, 0.0]), (2, [0.9, 0.1]), (4, [0.5, 0.5]), (1, [0.0, 1.0])], "id long, vector array<double>")
    units = spark.createDataFrame([("v", str(k), x) for k, x in TEXTS.items()], "version string, unit_key string, text string")
    el = [(1, None, TEXTS[1], "ARTICLE", "@root/ARTICLE:1/@caput"), (2, 1, TEXTS[2], "ITEM", "@root/ARTICLE:1/INCISO:1"), (3, None, TEXTS[3], "ITEM", "@root/ARTICLE:2/INCISO:1"), (4, None, TEXTS[4], "ITEM", "@root/ARTICLE:3/INCISO:1")]
    elements = spark.createDataFrame(el, "key long, parent_key long, text string, element_type string, path string")
    rows = sorted(retrieve.hybrid_search(q, qv, index.build_postings(units), v, elements, 3).collect(), key=lambda r: r["rank"])
    # lexical 2, 3, 1 (ties by key); vectors 3, 2, 4, 1
    two, three = 1 / 61 + 1 / 62 + 0.04, 1 / 62 + 1 / 61
    want = [(2, two), (1, two * 0.999), (3, three)]
    assert [r.id for r in rows] == [i for i, _ in want]
    assert all(abs(r.score - x) < 1e-8 for r, (_, x) in zip(rows, want, strict=True))
