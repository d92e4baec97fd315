"""Clauses with their places against a splitter on Python's patterns, places in acts, and answers down to their documents."""

import random
import re

from evidentia.operators import verify


def by_hand(text, predicate, splitters, protected):
    gap = " ,;\t\n"

    def spans(pattern):
        out, at = [], 0
        for m in [*re.finditer(pattern, text), None]:
            raw = text[at : m.start() if m else len(text)]
            if raw.strip(gap):
                start = at + len(raw) - len(raw.lstrip(gap))
                out.append((start + 1, len(raw.strip(gap)), raw.strip(gap)))
            at = m.end() if m else at
        return out

    whole = text.strip() or text
    result = [(text.find(whole) + 1, len(whole), whole)]
    if re.search(protected, text.lower()):
        return result
    for s in splitters:
        parts = spans(s)
        if len(parts) > 1 and all(len(re.findall(r"[^\W\d_]+", p)) >= 2 and re.search(predicate, p.lower()) for _, _, p in parts):
            return parts
    return result


def test_clauses_have_their_places(spark):
    rnd = random.Random(5)
    words = ["it is", "they can pay", "and", ";", "; ;", ",", " , and", "but", "unless", "ça was há", "x", "  ", "\n", "\t", "the"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))) for _ in range(400)] + ["", " ", "a; ", "; it is;they can pay;"]
    texts.append("it is so; " * 3000 + "it is")
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, claim string").repartition(4)
    got = {}
    for r in verify.split_clauses(df).collect():
        got.setdefault(r.id, []).append((r.clause_no, r.start, r.length, r.clause))
    assert len(got) == len(texts)
    for i, x in enumerate(texts):
        parts = sorted(got[i])
        assert [p[1:] for p in parts] == by_hand(x, verify.PREDICATE, verify.SPLITTERS, verify.PROTECTED), x
        assert [p[0] for p in parts] == list(range(len(parts)))
        assert all(x[s - 1 : s - 1 + n] == c for _, s, n, c in parts)
    assert verify.split_clauses(spark.createDataFrame([(1, None)], "id int, claim string")).collect()[0].clause is None


def test_places(spark):
    claims = spark.createDataFrame([(1, i, x, m) for i, (x, m) in enumerate([("art. 5º, inciso II", "E"), ("art. 5 alínea c", "E"), (None, "E"), ("art. 9", "EBCG_V2"), ("art. 9", "E"), ("art. 5", "E")])], "question_id int, claim_no int, claim string, mode string")
    cited = spark.createDataFrame([(1, 0, "a/article:5/inciso:ii", "x"), (1, 1, "ARTICLE:5/INCISO:II", "x"), (1, 2, None, None), (1, 3, None, "art. 9"), (1, 4, None, "art. 9")], "question_id int, claim_no int, identity_key string, snapshot_text string")
    got = {r.claim_no: (r.places, r.locator_ok) for r in verify.locator_groups(claims, cited).collect()}
    assert got == {0: (1, True), 1: (1, False), 2: (0, True), 3: (1, True), 4: (1, False), 5: (1, False)}


def test_chain_of_empty_tables(spark):
    answers = spark.createDataFrame([(1, "EV001", False), (2, None, None), (3, "EV001", True)], "question_id int, answer string, abstain boolean")
    claims = spark.createDataFrame([], "question_id int, claim_code string, claim string, codes array<string>")
    items = spark.createDataFrame([], "question_id int, code string, validated boolean, snapshot_text string, stored_text string, source_url string, stored_url string")
    got = sorted((r.question_id, r.error, r.code) for r in verify.answer_chain_check(answers, claims, items).collect())
    assert got == [(1, "NO_CLAIMS", None), (1, "UNKNOWN_IN_ANSWER", "EV001"), (2, "NO_CLAIMS", None)]
    assert verify.answer_chain_check(answers.limit(0), claims, items).count() == 0
