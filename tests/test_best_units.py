"""Questions meet units in slabs: the same as every question against every unit, with one row moved for a posting, however many ask for it."""

import math
import random

from evidentia.operators import index, retrieve


def tables(spark):
    rnd = random.Random(4)
    words = ["alpha", "bravo", "charl", "delta", "echoo", "foxtr", "golff"]
    units = [(rnd.choice("vw"), f"u{i}", " ".join(rnd.choices(words, [9, 7, 5, 3, 2, 1, 1], k=rnd.randint(1, 6)))) for i in range(80)]
    units += [("v", "ü1", "alpha alpha"), ("v", "z", "alpha alpha"), ("w", "u1", "bravo alpha"), ("v", "none", None)]
    questions = [(i, rnd.choice("vwx"), " ".join(rnd.sample(words, rnd.randint(1, 5)))) for i in range(12)] + [(90, "v", ""), (91, "v", "alpha bravo"), (92, "v", "missing alpha")]
    return units, questions, spark.createDataFrame(units, "version string, unit_key string, text string"), spark.createDataFrame(questions, "question_id int, version string, question string")


def best(rows, k=3):
    rows = sorted(rows)[:k]
    return [r[-1] for r in rows]


def test_every_question_against_every_unit(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "SLAB_POSTINGS", 20)
    monkeypatch.setattr(retrieve, "QUESTION_BLOCK", 4)
    units, questions, u, q = tables(spark)
    p, sizes = index.build_postings(u), index.corpus_size(u)
    w = index.idf_weights(index.document_frequency(p), sizes)
    got = {}
    for name, df in (("or", retrieve.search_relaxed_or(q, p, 3)), ("cover", retrieve.search_weighted_coverage(q, p, w, sizes, 3)), ("lexical", retrieve.lexical_search(q, p, 3))):
        for r in sorted(df.collect(), key=lambda r: r["rank"]):
            got.setdefault((name, r.question_id), []).append(r.unit_key)
    want = {}
    for i, version, question in questions:
        terms = list(dict.fromkeys(question.split()))
        docs, keys = [(k, (x or "").split()) for v, k, x in units if v == version], {}
        for k, ws in docs:
            keys.setdefault(k, []).append(ws)
        df = {t: sum(t in ws for _, ws in docs) for t in terms}
        weight = {t: math.log((len(docs) + 1) / (df[t] + 1)) for t in terms}
        rows = {"or": [], "cover": [], "lexical": []}
        for k, (ws,) in keys.items():
            hit, tf = [t for t in terms if t in ws], sum(x in terms for x in ws)
            if not hit:
                continue
            places = sum(ws[a : a + len(terms)] == terms for a in range(len(ws))) if len(terms) > 1 else tf
            rows["or"].append((-tf, k))
            rows["cover"].append((-round(sum(weight[t] for t in hit) / sum(weight.values()), 6), -len(hit), -tf, k))
            rows["lexical"].append((-round(tf * 0.1 + 2 * places, 6), k))
        want |= {(n, i): best(r) for n, r in rows.items() if r}
    assert got == want


def test_one_row_moves_for_a_posting(spark):
    _, questions, u, q = tables(spark)
    p = index.build_postings(u)
    terms = q.selectExpr("question_id", "version", "explode(array_distinct(split(question, ' '))) as term")
    plan = retrieve.best_units(terms, p, 3, False)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "groupBy" not in plan and "hashpartitioning(question_id" not in plan
