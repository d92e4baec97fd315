"""Truth tables of single operators on hand-written rows."""

from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import audit, corpus, evaluate, evidence, index, retrieve, structure, verify
from evidentia.sources import io


def one(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_text_functions(spark):
    d = one(spark, [("  A  b , c ;d .",)], "t string")
    r = d.select(text.normalize_presentation(F.col("t")).alias("p"), text.normalize_matching(F.col("t")).alias("m")).first()
    assert r.p == "A b, c;d." and r.m == "a b , c ;d ."
    d = one(spark, [("Ações e ações das Leis legais",), (None,)], "t string")
    got = [r.f for r in d.select(text.fold_tokens(F.col("t"), stop=("das",)).alias("f")).collect()]
    assert got == [["acoe", "leis", "legai"], []]


def test_decode_is_strict(spark):
    d = one(spark, [(b"caf\xc3\xa9",), (b"\xff",), (None,)], "b binary")
    assert [(r.r.text, r.r.error) for r in d.select(text.decode_strict(F.col("b")).alias("r")).collect()] == [("café", None), (None, "UnicodeDecodeError"), (None, "NO_BYTES")]


def units(spark, *texts):
    return one(spark, [("v", f"u{i}", t) for i, t in enumerate(texts)], "version string, unit_key string, text string")


def coverage(spark, question, *texts, version="v"):
    u = units(spark, *texts)
    p, n = index.build_postings(u), index.corpus_size(u)
    q = one(spark, [("q", version, question)], "question_id string, version string, question string")
    r = retrieve.search_weighted_coverage(q, p, index.idf_weights(index.document_frequency(p), n), n).collect()
    return [x.unit_key for x in sorted(r, key=lambda x: x.rank)]


def test_coverage_ordering_laws(spark):
    assert coverage(spark, "alpha beta", "alpha", "alpha beta", "gamma") == ["u1", "u0"]  # by coverage
    assert coverage(spark, "alpha beta", "beta", "alpha", "alpha x", "alpha y")[0] == "u0"  # rare terms weigh more
    assert coverage(spark, "alpha beta", "alpha alpha alpha", "alpha beta") == ["u1", "u0"]  # repeats are no coverage
    assert coverage(spark, "alpha", "alpha", "alpha alpha") == ["u1", "u0"]  # then density
    assert coverage(spark, "alpha", "alpha", "alpha") == ["u0", "u1"]  # then key
    assert coverage(spark, "", "alpha") == [] and coverage(spark, "alpha", "alpha", version="w") == []


def test_strict_needs_every_term(spark):
    p = index.build_postings(units(spark, "alpha gap beta", "alpha beta", "alpha"))
    q = one(spark, [("q", "v", "alpha beta")], "question_id string, version string, question string")
    got = {r.unit_key: r.score for r in retrieve.search_strict(q, p).collect()}
    assert got == {"u0": 0.05, "u1": 0.1}


def test_fusion_and_reserve(spark):
    s = "question_id int, id string, rank int"
    f = retrieve.reciprocal_rank_fusion([one(spark, [(1, "a", 1), (1, "b", 2)], s), one(spark, [(1, "b", 1)], s)])
    assert [r.id for r in f.orderBy("rank").collect()] == ["b", "a"]
    prim = one(spark, [(1, "a", 1.0, 1)], "question_id int, id string, score double, rank int")
    promo = one(spark, [(1, "a", 9.0), (1, "x", 2.0), (1, "y", 3.0), (1, "z", 1.0)], "question_id int, id string, score double")
    assert [(r.id, r["rank"]) for r in retrieve.structural_reserve(prim, promo, 2).orderBy("rank").collect()] == [("a", 1), ("y", 2), ("x", 3)]


def test_assembly_first_occurrence_and_cap(spark):
    p = [("v", "p1", None, 1, "t"), ("v", "p2", None, 50, "t")] + [("v", f"c{i}", "p1", 1 + i, "t" if i != 2 else " ") for i in range(1, 12)]
    p = one(spark, p, "version string, key string, parent_key string, document_order int, text string")
    c = one(spark, [("q", "v", "c3", 2), ("q", "v", "p1", 1), ("q", "v", "p2", 3)], "question_id string, version string, key string, rank int")
    got = [r.key for r in evidence.assemble_evidence(c, p, 3, 5).orderBy("position").collect()]
    assert got == ["p1", "c1", "c3", "c4", "p2"]


def test_selection_is_greedy(spark):
    rows = [("q", i, i, i, "alpha beta gamma delta", t, None) for i, t in enumerate(["alpha beta", "alpha beta", "gamma delta", "none"])]
    d = one(spark, rows, "question_id string, id int, provision int, position int, question string, text string, parent_text string")
    assert [r.id for r in evidence.select_evidence(d).orderBy("pick").collect()] == [0, 2]


def test_attribution_thresholds(spark):
    cl = one(spark, [("q", 1, 0, "alpha beta gamma"), ("q", 2, 0, "nothing shared")], "question_id string, claim_no int, clause_no int, clause string")
    ev = one(spark, [("q", "A", "alpha beta"), ("q", "B", "gamma only"), ("q", "C", "far away")], "question_id string, code string, text string")
    got = {r.claim_no: r for r in verify.attribute_claims(cl, ev).collect()}
    assert got[1].codes == ["A", "B"][: len(got[1].codes)] and got[1].reason is None and got[2].reason == "NO_EVIDENCE" and got[2].codes == []


def test_citations_unknown_before_outside(spark):
    a = one(spark, [("q1", ["x", "out"]), ("q2", ["out"]), ("q3", ["in"]), ("q4", [])], "question_id string, citations array<string>")
    e = one(spark, [("q1", "in"), ("q3", "in")], "question_id string, key string")
    k = one(spark, [("in",), ("out",)], "key string")
    got = {r.question_id: (r.status, r["keys"]) for r in verify.validate_citations(a, e, k).collect()}
    assert got["q1"] == ("INVALID_CITATION", ["x"]) and got["q2"] == ("OUT_OF_EVIDENCE", ["out"]) and got["q3"] == got["q4"] == ("VALID", [])


LAW = ["CAPÍTULO I", "DO NOME", "Art. 1º Abre :", "I - um;", "II - dois.", "§ 1º Par.", "I - três", "CAPÍTULO II OUTRO", "§ 9º Solto", "Art. 2º Fim ."]


def test_flat_law(spark):
    b = structure.classify_blocks(one(spark, [(1, i, t) for i, t in enumerate(LAW)], "doc_id int, pos int, text string"))
    got = [(r.stable_key, r.parent_key, r.text) for r in structure.flat_hierarchy(b).orderBy("document_order").collect()]
    assert got == [
        ("chapter:i", "root", ""), ("article:1", "chapter:i", None), ("article:1/caput", "article:1", "Abre:"), ("article:1/caput/inciso:i", "article:1/caput", "um;"), ("article:1/caput/inciso:ii", "article:1/caput", "dois."),
        ("article:1/paragraph:1", "article:1", "Par."), ("article:1/paragraph:1/inciso:i", "article:1/paragraph:1", "três"), ("chapter:ii", "root", "OUTRO"), ("article:2", "chapter:ii", None), ("article:2/caput", "article:2", "Fim."),
    ]
    assert [(r.pos, r.reason) for r in structure.unsupported_blocks(b).collect()] == [(8, "PARAGRAPH_WITHOUT_ARTICLE")]
    assert {r.label: r.title for r in structure.merge_heading_lines(b).collect()} == {"I": "DO NOME", "II": "OUTRO"}
    cov = structure.coverage(b, structure.flat_hierarchy(b))
    assert cov.filter("(consumed_by is null) = (ignored_reason is null)").count() == 0


def test_row_order_does_not_matter(spark):
    rows = [(1, i, t) for i, t in enumerate(LAW)]
    a, b = (structure.flat_hierarchy(structure.classify_blocks(one(spark, r, "doc_id int, pos int, text string"))).orderBy("document_order").collect() for r in (rows, rows[::-1]))
    assert a == b


def test_grammar_of_lines(spark):
    lines = {
        "I – texto": ("INCISO", "I", "texto"), "DCM - x": ("INCISO", "DCM", "x"), "i - x": ("TEXT", None, "i - x"), "capítulo D": ("CHAPTER", "D", ""), "CAPÍTULO II-A  Do nome": ("CHAPTER", "II-A", "Do nome"),
        "art. 3 x": ("ARTICLE", "3", "x"), "Art. 5-A. O texto": ("ARTICLE", "5-A", "O texto"), "Art.  1º  abre": ("ARTICLE", "1", "abre"), "Artigo 1": ("TEXT", None, "Artigo 1"),
        "§2o y": ("PARAGRAPH", "2", "y"), "PARÁGRAFO ÚNICO. z": ("SOLE_PARAGRAPH", "PARÁGRAFO ÚNICO", "z"), "  ": ("BLANK", None, "  "),
    }
    got = structure.classify_blocks(one(spark, [(1, i, x) for i, x in enumerate(lines)], "doc_id int, pos int, text string")).collect()
    assert {r.text: (r["class"], r.label, r.rest) for r in got} == lines


def test_html_blocks(spark):
    page = '<p>one<p name="x">two <a href="/l" name="n">link</a></p><table><p><strike>old</strike></p></table><script>"</p>"</script>'
    got = structure.html_blocks(one(spark, [(1, page), (2, None)], "page_id int, html string")).collect()
    assert [(r.text, r.in_table, r.fully_struck, r.anchors, r.hrefs) for r in got] == [("one", False, False, [], []), ("two link", False, False, ["x", "n"], ["/l"]), ("old", True, True, [], [])]


def test_materialize_is_idempotent(spark, tmp_path):
    p = one(spark, [("v1", "a", "t"), ("v2", "b", "t")], "version string, key string, text string")
    path = f"file://{tmp_path}/p"
    for _ in range(2):
        corpus.write_version(p, path)
    assert spark.read.parquet(path).count() == 2 and corpus.materialize(p, p).count() == 0


def test_write_once_refuses(spark, tmp_path):
    import pytest

    io.write_once(spark.range(3), f"file://{tmp_path}/x")
    with pytest.raises(Exception, match="(?i)already.exists"):
        io.write_once(spark.range(3), f"file://{tmp_path}/x")


def test_corrupt_response_fails(spark, tmp_path):
    import pytest

    (tmp_path / "r.jsonl").write_text('{"case_id": "1", "raw_response": "x"}\n\n{broken\n')
    with pytest.raises(Exception):
        io.read_responses(spark, f"file://{tmp_path}/r.jsonl").collect()


def test_stability_is_null_aware(spark):
    r = one(spark, [(1, "ANSWER", True, ["a", "b"]), (1, "ANSWER", True, ["b", "a"]), (2, None, None, []), (2, "ABSTAIN", None, [])], "case_id int, decision string, covered boolean, citations array<string>")
    got = {x.case_id: (x.decision_stable, x.coverage_stable, x.citation_sets) for x in evaluate.stability(r).collect()}
    assert got == {1: (True, True, 1), 2: (False, None, 1)}


def test_gate_and_constraints(spark):
    f = one(spark, [(1, "A", "BLOCKER", 1), (2, "B", "WARNING", 1)], "doc_id int, code string, severity string, block long")
    assert {r.doc_id: r.status for r in audit.gate(f).collect()} == {1: "BLOCKED", 2: "PASSED"}
    t = one(spark, [(1, 5, None), (1, None, 2)], "a int, b int, c int")
    got = {r.rule: r.violations for r in audit.constraint_report(t, {"ck": "b > 9"}, {"uq": ["a"]}, {"fk": (["c"], t, ["a"])}).collect()}
    assert got == {"ck": 1, "uq": 1, "fk": 1}


def test_vector_plan_and_topk_plan(spark):
    u = units(spark, "alpha beta", "alpha")
    q = one(spark, [("q", "v", "alpha")], "question_id string, version string, question string")
    plan = retrieve.search_relaxed_or(q, index.build_postings(u))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan


def test_validate_tree_counts_openings_by_article_and_repeated_orders(spark):
    from pyspark.sql import functions as F

    rows = [("root", None, "ROOT", 1), ("a1", "root", "ARTICLE", 2), ("a1/caput", "a1", "CAPUT", 3), ("a1/caput", "a1", "CAPUT", 3), ("a2", "root", "ARTICLE", 5)]
    d = spark.createDataFrame([(1, *r, "1", "x") for r in rows], "doc_id long, stable_key string, parent_key string, provision_type string, document_order long, number_label string, text string")
    got = {r.rule: r.n for r in structure.validate_tree(d).collect()}
    assert got == {"CAPUT_COUNT": 2, "ORDER_GAP": 1}


def test_vector_search_leaves_unusable_vectors_out(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "question_id long, vector array<double>")
    v = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [0.0, 1.0])], "id long, vector array<double>")
    assert [(r.question_id, r.id) for r in sorted(retrieve.vector_search(q, v).collect(), key=lambda r: -r.score)] == [(1, 1), (1, 5)]


def test_latency_of_repeated_values(spark):
    d = spark.createDataFrame([("a", float(i % 5)) for i in range(100)] + [("b", 3.0), ("b", 4.0), (None, 1.0), ("b", None)], "k string, latency_ms double")
    got = {r.k: (r.n, r.p50, r.p95, r.maximum) for r in evaluate.latency_summary(d, "k").collect()}
    assert got == {"a": (100, 2.0, 4.0, 4.0), "b": (2, 3.5, 3.0, 4.0), None: (1, 1.0, 1.0, 1.0)}
