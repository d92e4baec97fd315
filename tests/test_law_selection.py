"""Whole laws from lines and bytes; selection of evidence in rounds."""

import pytest

from evidentia.functions.text import fold_tokens
from evidentia.operators import evidence, law

HEAD = ["menu", "LEI Nº 1, DE 2000.", "", "Ementa.", "Art. 3º quoted in the preamble"]
BODY = ["CAPÍTULO I", "DO NOME", "", "E OUTRO", "Art. 1º Texto  do artigo ;", "I - primeiro", "§ 1o Um.", "II – segundo", "Parágrafo único. (VETADO).", "capítulo ii-a DAS COISAS", "art. 2-b. Dois."]
TAIL = ["Brasília, 2000.", "menu"]


def parsed(spark, *docs):
    rows = [(d, i, t) for d, lines in enumerate(docs, 1) for i, t in enumerate(lines)]
    return law.parse_law(spark.createDataFrame(rows, "doc_id int, pos int, text string"))


def test_provisions_of_a_law(spark):
    p, coverage, rejected = parsed(spark, HEAD + BODY + TAIL)
    assert rejected.collect() == []
    got = [tuple(r) for r in p.orderBy("document_order").select("stable_key", "parent_key", "provision_type", "number_label", "text", "status", "pos_start", "pos_end").collect()]
    assert got == [
        ("PREAMBLE", None, "DOCUMENT_ROOT", None, "LEI Nº 1, DE 2000.\nEmenta.\nArt. 3º quoted in the preamble", "IN_FORCE", 1, 4),
        ("CHAPTER:I", "PREAMBLE", "CHAPTER", "I", "CAPÍTULO I\nDO NOME\nE OUTRO", "IN_FORCE", 5, 8),
        ("ARTICLE:1", "CHAPTER:I", "ARTICLE", "1", None, "IN_FORCE", 9, 9),
        ("ARTICLE:1/CAPUT", "ARTICLE:1", "CAPUT", None, "Art. 1º Texto do artigo;", "IN_FORCE", 9, 9),
        ("ARTICLE:1/CAPUT/INCISO:I", "ARTICLE:1/CAPUT", "INCISO", "I", "I - primeiro", "IN_FORCE", 10, 10),
        ("ARTICLE:1/PARAGRAPH:1", "ARTICLE:1", "PARAGRAPH", "1", "§ 1o Um.", "IN_FORCE", 11, 11),
        ("ARTICLE:1/PARAGRAPH:1/INCISO:II", "ARTICLE:1/PARAGRAPH:1", "INCISO", "II", "II – segundo", "IN_FORCE", 12, 12),
        ("ARTICLE:1/PARAGRAPH:UNIQUE", "ARTICLE:1", "PARAGRAPH", "UNIQUE", "Parágrafo único. (VETADO).", "VETOED", 13, 13),
        ("CHAPTER:II-A", "PREAMBLE", "CHAPTER", "II-A", "capítulo ii-a DAS COISAS", "IN_FORCE", 14, 14),
        ("ARTICLE:2-B", "CHAPTER:II-A", "ARTICLE", "2-B", None, "IN_FORCE", 15, 15),
        ("ARTICLE:2-B/CAPUT", "ARTICLE:2-B", "CAPUT", None, "art. 2-b. Dois.", "IN_FORCE", 15, 15),
    ]
    c = [tuple(r) for r in coverage.orderBy("pos").select("consumed_by", "ignored_reason").collect()]
    assert len(c) == len(HEAD + BODY + TAIL) and all((a is None) != (b is None) for a, b in c)
    assert [b for _, b in c] == ["CHROME", None, "EMPTY", None, None, None, None, "EMPTY"] + [None] * 8 + ["CHROME"] * 2


def test_a_title_goes_on_behind_the_last_structural_line(spark):
    p, coverage, _ = parsed(spark, ["LEI Nº 1", "CAPÍTULO I", "ÚLTIMO", "NOME"])
    assert p.filter("provision_type = 'CHAPTER'").first().text == "CAPÍTULO I\nÚLTIMO\nNOME"
    assert coverage.filter("consumed_by is null").count() == 0


@pytest.mark.parametrize(
    "lines,pos,reason",
    [
        (BODY, -1, "NO_PREAMBLE"),
        (HEAD, -1, "NO_PREAMBLE"),
        (["CAPÍTULO I A", "LEI Nº 1", "Art. 1º x"], -1, "NO_PREAMBLE"),
        (["", None], -1, "NO_PREAMBLE"),
        (HEAD + ["CAPÍTULO I GERAL", "Texto sem classe.", "Art. 1º Texto."], 6, "UNMATCHED_TEXT"),
        (HEAD + ["CAPÍTULO I GERAL", "§ 1º Texto.", "solto", "Art. 1º Texto."], 6, "PARAGRAPH_WITHOUT_ARTICLE"),
        (HEAD + BODY + ["CAPÍTULO III Z", "I - inciso"], 17, "INCISO_WITHOUT_PARENT"),
    ],
)
def test_documents_fail_closed(spark, lines, pos, reason):
    p, coverage, rejected = parsed(spark, lines, HEAD + BODY)
    assert [(r.doc_id, r.pos, r.reason, r.text) for r in rejected.collect()] == [(1, pos, reason, lines[pos] if pos >= 0 else None)]
    assert {r.doc_id for r in p.collect()} == {2} == {r.doc_id for r in coverage.collect()}


def page(lines):
    return "<html><body>" + "".join(f'<p><a name="a{i}"></a>{x}</p>' for i, x in enumerate(lines)) + "</body></html>"


def test_reprojection_from_bytes(spark):
    good = page(HEAD + BODY + TAIL)
    raw = [(1, (good + "<script>A</script><p>x</p>").encode("windows-1252")), (2, (good + "<script>B</script>").encode("windows-1252")), (3, good.encode("windows-1252") + b"\x81"), (4, None), (5, page(BODY).encode("windows-1252")), (6, b"")]
    d = law.reproject(spark.createDataFrame(raw, "doc_id int, raw_bytes binary"))
    rows = {k: [tuple(r)[1:] for r in d.provisions.filter(f"doc_id = {k}").orderBy("document_order").drop("version").collect()] for k in (1, 2)}
    assert rows[1] == rows[2] and len(rows[1]) == 11 and rows[1][0][9 - 1] == 4 and rows[1][0][9] == "a1"
    assert {(r.doc_id, r.stage, r.reason) for r in d.rejected.collect()} == {(3, "DECODE", "UnicodeDecodeError"), (4, "DECODE", "NO_BYTES"), (5, "STRUCTURE", "NO_PREAMBLE")}
    assert d.units.filter("doc_id = 1").count() == 9 and d.units.select("doc_id", "version").distinct().count() == 2
    assert law.reparse_difference(d.provisions, d.provisions).collect() == []
    lost = law.reparse_difference(d.provisions.filter("document_order != 3").union(d.provisions.filter("document_order = 4")), d.provisions).collect()
    assert {(r.document_order, r.change, r.n) for r in lost} == {(3, "NEW", 1), (4, "MISSING_NOW", 1)}


def greedy(question, cands, limit):
    """The rule step by step, over token sets; ``cands`` in order of position."""
    q, out, covered, left = question, [], set(), list(range(len(cands)))
    shared = [q & t for t, _ in cands]
    base = [0.65 * len(s) / len(q) + 0.20 / (i + 1) + (0.15 if p else 0.0) for i, (s, (_, p)) in enumerate(zip(shared, cands, strict=True))]
    least = 1 if len(q) <= 3 else max(1, (max(map(len, shared)) + 1) // 2)
    left = [i for i in left if len(shared[i]) >= least]
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    while left and len(out) < limit:
        options = []
        for i in left:
            m, r = len(shared[i] - covered) / len(q), max((jac(cands[i][0], cands[j][0]) for j, *_ in out), default=0.0)
            if not out:
                options.append((base[i], -i, 0.0, 0.0))
            elif not (m == 0 and (base[i] < 0.30 or r >= 0.85)):
                options.append((0.45 * base[i] + 0.40 * m + 0.15 * (1.0 - r), -i, m, r))
        if not options:
            break
        f, i, m, r = max(options)
        out.append((-i, round(base[-i], 6), round(m, 6), round(r, 6), round(f, 6)))
        covered |= shared[-i]
        left.remove(-i)
    return out


CASES = {
    "strong without new coverage": ("alpha bravo charlie delta", [("alpha bravo charlie delta", True), ("alpha bravo charlie delta echo", True), ("alpha bravo", False)]),
    "weak with new coverage": ("alpha bravo charlie delta foxtrot golf hotel india", [("alpha bravo charlie delta xray", False), ("yankee zulu alpha", False), ("hotel india whisky victor", False), ("foxtrot golf tango", False)]),
    "redundant": ("alpha bravo", [("alpha bravo", True), ("alpha bravo", True), ("alpha", True)]),
    "many": ("alpha bravo charlie", [(f"alpha word{chr(97 + i % 26)}{chr(97 + i // 26)}xyz" + (" bravo" if i % 7 == 0 else ""), i % 2 == 0) for i in range(300)]),
    "none": ("alpha", [("bravo", False)]),
}


def test_selection_in_rounds(spark):
    rows = [(name, i, f"p{i}", i, q, text, "" if parent else None) for name, (q, cs) in CASES.items() for i, (text, parent) in enumerate(cs)]
    rows += [("redundant", 9, "p0", 9, "alpha bravo", "alpha bravo charlie", None)]  # a provision met before
    df = spark.createDataFrame(rows, "question_id string, id int, provision string, position int, question string, text string, parent_text string")
    tokens = {r.x: frozenset(r.t) for r in df.selectExpr("explode(array(question, text)) as x").distinct().select("x", fold_tokens("x").alias("t")).collect()}
    for limit in (1, 3, 5):
        got = {}
        for r in evidence.select_evidence(df.repartition(3), limit).orderBy("question_id", "pick").collect():
            got.setdefault(r.question_id, []).append((r.id, r.base, r.marginal, r.redundancy, r.final))
        want = {name: greedy(tokens[q], [(tokens[t], p) for t, p in cs], limit) for name, (q, cs) in CASES.items()}
        assert got == {k: v for k, v in want.items() if v}
    assert [i for i, *_ in want["strong without new coverage"]][:2] == [0, 1]
    assert any(b < 0.30 for _, b, *_ in want["weak with new coverage"][1:])
    assert evidence.select_evidence(df.limit(0)).collect() == []
