"""Deep acts against a parser that goes line by line."""

import random
import re
from collections import Counter

from evidentia.operators import deep

LEVEL = {"TÍTULO": "TITLE", "CAPÍTULO": "CHAPTER", "SEÇÃO": "SECTION", "SUBSEÇÃO": "SUBSECTION"}
NOTE = re.compile(deep.NOTE.replace("(?iu)", ""), re.I)


def status(t, struck):
    if re.search("Revogad[oa]", t, re.I):
        return "REVOKED"
    return ("HISTORICAL" if re.search("Redação dada|Incluído", t, re.I) else "UNRESOLVED") if struck else "CURRENT"


def role(t):
    return "AMENDMENT_NOTE" if re.search("Emenda Constitucional|Revogad|Incluído|Redação dada", t, re.I) else "REFERENCE_NOTE" if re.search("Vide|Regulamento", t, re.I) else "EDITORIAL_NOTE"


def by_hand(lines):
    """Elements in tree order and ignored lines, or the reason of rejection."""
    root = dict(type="DOCUMENT_ROOT", label=None, text="root", status="CURRENT", role="NORMATIVE", key="@root", kids=[])
    at, ignored, i = {}, [], 0
    matching = lambda t: re.sub(r"\s+", " ", t).strip().lower()
    is_note = lambda t: bool(NOTE.fullmatch(t.strip()) or re.search("Este texto não substitui|Vigência", t, re.I))

    def node(parent, type_, label, text, st):
        n = dict(type=type_, label=label, text=text.strip(), status=st, role="NORMATIVE", key=f"{parent['key']}/{type_}:{label.upper() if label else '@' + type_.lower()}", kids=[])
        parent["kids"].append(n)
        return n

    def note(parent, text):
        parent["kids"].append(dict(type="NOTE", label=None, text=text.strip(), status="NOT_APPLICABLE", role=role(text), key=None, kids=[]))

    def attach(level, label, text, st):
        order = list(LEVEL.values())
        k = order.index(level)
        at[level] = node(next((at[x] for x in reversed(order[:k]) if at.get(x)), root), level, label, text, st)
        for lower in order[k + 1 :]:
            at[lower] = None

    while i < len(lines):
        t, struck = lines[i]
        t = t or ""
        if matching(t) == "preâmbulo":
            nxt = lines[i + 1] if i + 1 < len(lines) else lines[i]
            node(root, "PREAMBLE", None, (nxt[0] or "").strip() or t.strip(), status(nxt[0] or "", nxt[1]))
            i += 2
            continue
        m = re.fullmatch(r"(TÍTULO|CAPÍTULO|SEÇÃO|SUBSEÇÃO)\s+([IVXLCDM]+(?:-[A-Z])?)", matching(t).upper())
        if m:
            j, notes, rubrics = i + 1, [], []
            while j < len(lines) and is_note(lines[j][0] or ""):
                notes.append(lines[j][0])
                j += 1
            while j < len(lines) and re.match(r"(?:do|da|dos|das)\s+", matching(lines[j][0] or "")):
                rubrics.append(lines[j])
                j += 1
            attach(LEVEL[m[1]], m[2], t.strip() + (f"\n{rubrics[0][0].strip()}" if rubrics else ""), status(*(rubrics[0] if rubrics else (t, struck))))
            for n in notes:
                note(at[LEVEL[m[1]]], n)
            for r in rubrics[1:]:
                attach(LEVEL[m[1]], m[2], r[0], status(*r))
            i = j
            continue
        clean = lambda s: re.sub(r"\s*-\s*", "-", re.sub("[º°.]", "", s.strip())).upper()
        kinds = [("ARTICLE", r"\s*Art\.\s*(\d+[º°.]?(?:\s*-\s*[A-Z])?)\s*(.*)", re.I), ("SOLE", r"\s*Parágrafo\s+único[.:]?\s*()(.*)", re.I), ("PARAGRAPH", r"\s*§\s*(\d+[º°.]?(?:\s*-\s*[A-Z])?)\s*(.*)", re.I), ("INCISO", r"\s*([IVXLCDM]+(?:-?[A-Z])?)(?:\s*[-–—]\s*|\s+)(\S.*)", 0), ("ALINEA", r"\s*([a-z])\s*\)\s*(.*)", re.I)]
        if at.get("ALINEA"):
            kinds.append(("ITEM", r"\s*(\d+)\s*[.)-]\s*(.*)", 0))
        kind, m = next(((k, m) for k, p, f in kinds if (m := re.fullmatch(p, t, f | re.S))), (None, None))
        if kind:
            rest = NOTE.sub("", m[2]).strip() or t.strip()
            found = NOTE.findall(m[2])
            st = status(t, struck)
            if kind == "ARTICLE":
                parent = next((at[x] for x in reversed(LEVEL.values()) if at.get(x)), root)
                a = at["ARTICLE"] = node(parent, "ARTICLE", clean(m[1]), t[: m.start(2)], st)
                at["PARAGRAPH"] = at["INCISO"] = at["ALINEA"] = None
                n = node(a, "CAPUT", None, rest, st)
            else:
                label = {"SOLE": "único", "PARAGRAPH": clean(m[1]), "INCISO": m[1].upper()}.get(kind, m[1])
                kind = "PARAGRAPH" if kind == "SOLE" else kind
                parent = {"PARAGRAPH": at.get("ARTICLE"), "INCISO": at.get("PARAGRAPH") or at.get("ARTICLE"), "ALINEA": at.get("INCISO"), "ITEM": at.get("ALINEA")}[kind]
                if parent is None:
                    return i, f"{kind}_WITHOUT_PARENT"
                n = node(parent, kind, label, rest, st)
                at[kind] = n
                for lower in {"PARAGRAPH": ("INCISO", "ALINEA"), "INCISO": ("ALINEA",)}.get(kind, ()):
                    at[lower] = None
            for x in found:
                note(n, x)
        elif is_note(t):
            note(next((at[x] for x in ("ALINEA", "INCISO", "PARAGRAPH", "ARTICLE", "SUBSECTION", "SECTION", "CHAPTER", "TITLE") if at.get(x)), root), t)
        else:
            ignored.append((i, "UNCLASSIFIED" if t.strip() else "EMPTY"))
        i += 1
    out, kinds, parents = [], {}, {}

    def walk(n, parent):
        out.append(n)
        if n["key"]:
            kinds.setdefault(n["key"], set()).add((n["type"], n["label"] or "", parent))
        parents[id(n)] = parent
        for x in n["kids"]:
            walk(x, n["key"])

    walk(root, None)
    if any(len(k) > 1 for k in kinds.values()):
        return -1, "IDENTITY_COLLISION"
    seen = Counter()
    for n in reversed(out):
        if n["key"] and n["status"] == "CURRENT" and n["type"] not in ("ARTICLE", "CAPUT"):
            seen[n["key"]] += 1
            if seen[n["key"]] > 1:
                n["status"] = "UNRESOLVED"
    return [(k, n["type"], n["label"], n["text"], n["status"], n["role"], n["key"], parents[id(n)]) for k, n in enumerate(out, 1)], ignored


PARTS = ["TÍTULO I", "TÍTULO II", "Capítulo  I", "CAPÍTULO II-A", "SEÇÃO I", "Subseção II", "DOS DIREITOS", "da ordem", "Art. 1º Texto um.", "Art. 2o-A  Dois (Vide Lei 3).", "art. 3º - B (Vide Lei 9) (Vigência)", "§ 1º Um.", "§ 2º - A (Incluído pela Emenda Constitucional nº 1) Dois.", "Parágrafo único. Só.", "I - primeiro", "II – segundo (Regulamento)", "IV-A quarto", "a) alínea", "b) outra (Vide ADI 1)", "1. item", "2) item dois", "(Vide Emenda Constitucional nº 4)", "Este texto não substitui o publicado", "(Revogado)", "da Vigência", "texto solto", "", "  ", None, "PREÂMBULO", "Nós, representantes", "Revogada a norma"]
GOOD = ["TÍTULO I", "(Vide Lei 1)", "DOS PRINCÍPIOS", "da alternativa", "Art. 1º Texto.", "§ 1º Um.", "I - primeiro", "a) alínea", "1. item"]


def test_against_line_by_line(spark):
    rnd = random.Random(8)
    docs = [GOOD, [], ["Art. 1º", "1. no item"], ["PREÂMBULO"], ["PREÂMBULO", "Nós", "Art. 1º x"], ["A) b"]]
    for _ in range(300):
        lines = [rnd.choice(PARTS) for _ in range(rnd.randint(0, 9))]
        docs.append((GOOD[: rnd.randint(0, 9)] if rnd.random() < 0.8 else []) + lines)
    docs = [[(t, rnd.random() < 0.2) for t in d] for d in docs]
    rows = [(d, i, t, s) for d, lines in enumerate(docs) for i, (t, s) in enumerate(lines)]
    a = deep.parse_act(spark.createDataFrame(rows, "doc_id int, pos int, text string, struck boolean").repartition(3))
    got, rejected, ignored = {}, {r.doc_id: (r.pos, r.reason) for r in a.rejected.collect()}, {}
    for r in a.elements.orderBy("doc_id", "document_order").collect():
        got.setdefault(r.doc_id, []).append((r.document_order, r.element_type, r.label, r.text, r.text_status, r.content_role, r.identity_key, r.parent_key))
    for r in a.coverage.orderBy("doc_id", "pos").collect():
        ignored.setdefault(r.doc_id, [])
        if r.ignored_reason:
            assert r.consumed_as is None
            ignored[r.doc_id].append((r.pos, r.ignored_reason))
    kinds = Counter()
    for d, lines in enumerate(docs):
        if not lines:
            assert d not in got and d not in rejected
            continue
        want = by_hand(lines)
        if isinstance(want[0], int):
            assert rejected.get(d) == want and d not in got, (d, lines)
            kinds[want[1]] += 1
        else:
            assert got.get(d) == want[0], (d, lines)
            assert ignored[d] == want[1], (d, lines)
            kinds["good"] += 1
    assert kinds["good"] > 80 and len(kinds) >= 4
