import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import negatives, spelling


def brute_negatives(rows, positives=5, negatives_=10):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    one = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], list(r[2]))):
        one.setdefault(r[0], (r[1], [int(np.floor(256 * float(x))) for x in r[2]]))
    out = []
    for a, (label, x) in one.items():
        if a % 100:
            continue
        s = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, m) for i, (m, y) in one.items() if i != a and len(y) == len(x))
        for ps, pos, _ in [t for t in s if t[2] == label][:positives]:
            own = [t for t in s if t[2] != label and 30 * -ps <= 100 * -t[0] <= 90 * -ps][:negatives_]
            out += [(a, pos, k, n, -ps, -ns) for k, (ns, n, _) in enumerate(own, 1)]
    return sorted(out)


def test_packed_products_are_exact():
    rng = np.random.default_rng(3)
    for scale in (1, 150, 40_000, 2**30, 2**70):
        rows, anchors = (np.floor(rng.normal(size=(n, 9)) * scale) for n in (23, 7))
        got = negatives.Packed(rows, np.abs(anchors).sum(axis=1).max()).products(anchors)
        want = [[min(max(sum(int(p) * int(q) for p, q in zip(a, r, strict=True)), negatives.LEAST), negatives.MOST) for r in rows] for a in anchors]
        assert got.tolist() == want
    assert negatives.Packed(np.zeros((3, 4)), 0.0).products(np.zeros((2, 4))).tolist() == [[0] * 3] * 2
    assert negatives.Packed(np.ones((5, 4)), 6.0).fields > 1


@pytest.mark.parametrize("slab,step", [(4096, 512), (37, 3)])
def test_hard_negatives(spark, monkeypatch, slab, step):
    monkeypatch.setattr(negatives, "SLAB_ROWS", slab)
    monkeypatch.setattr(negatives, "STEP_ANCHORS", step)
    monkeypatch.setattr(negatives, "STEP_ROWS", 4 * step)
    monkeypatch.setattr(negatives, "CELL_ANCHORS", 2 if slab < 100 else 65_536)
    rng = np.random.default_rng(5)
    rows = [(i, int(min(rng.integers(0, 6), 3)), rng.normal(size=6).round(1).tolist()) for i in range(-100, 420)]
    rows += [(i, 1, [0.5] * 6) for i in range(500, 560)] + [(700 + i, 2, [0.25] * 6) for i in range(40)]
    rows += [rows[3], (500, 0, [9.0] * 6), (800, None, [1.0] * 6), (801, 1, None), (None, 1, [1.0] * 6), (802, 1, [float("nan")] * 6), (803, 1, [None] + [1.0] * 5), (900, 1, [1.0]), (901, 1, [2.0]), (902, 2, [1.0]), (1000, 1, []), (1001, 5, [float("inf")] * 6)]
    v = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "vec", "anchor", "kind", "cell", "slot", "score", "rank", "low")})
    got = sorted(map(tuple, negatives.hard_negatives(v.repartition(5), F.col("vec_id") % 100 == 0).collect()))
    assert got == brute_negatives(rows) and len(got) > 50
    assert negatives.hard_negatives(v.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert negatives.hard_negatives(v, F.lit(False)).collect() == []


def brute_variants(docs, least=5, every=199, ratio=5):
    c = Counter()
    for id_, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(x.lower() if x < "\x80" else x for x in run)
            h = zlib.crc32(f"{'null' if id_ is None else id_}:{low}".encode())
            if h % every == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            c[low] += 1
    words = {w: n for w, n in c.items() if n >= least and len(w) >= 6}
    by = {}
    for w in words:
        for i in range(len(w)):
            by.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for (x, y), group in by.items():
        group = group | ({x + y} & words.keys())
        for u, v in combinations(group, 2):
            near[u].add(v)
            near[v].add(u)
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


def made_documents():
    rnd = random.Random(4)
    base = ["".join(rnd.choices("abé÷z", k=rnd.randint(5, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaabaaa", "aabbaab", "prefix" + "x" * 300, "prefix" + "x" * 299, "prefix" + "x" * 300 + "y"]
    docs = []
    for i in range(150):
        words = []
        for _ in range(rnd.randint(0, 60)):
            w = rnd.choice(base[: 1 + int(len(base) * rnd.random() ** 3)])
            if rnd.random() < 0.4:
                k = rnd.randrange(len(w))
                w = rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice("abé") + w[k:], w[:k] + rnd.choice("abé") + w[k + 1 :]])
            words.append(w.upper() if rnd.random() < 0.1 else w)
        docs.append((i if i % 20 else None, rnd.choice([" ", ", ", "1"]).join(words)))
    return docs + [docs[5], docs[5], (7, None), (8, ""), (9, "9 !"), (10, "long enough " * 20_000), (11, "x" * 5_000 + " ") ] + [(12 + i, "x" * 5_000 + " " + "x" * 4_999) for i in range(6)]


@pytest.mark.parametrize("most", [2_000, 3])
def test_spelling_variants(spark, most):
    docs = made_documents()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "id", "key", "lo", "hi", "size", "form", "root")})
    got = sorted(map(tuple, spelling.group_variants(d.repartition(4), every=19, most=most).collect()))
    want = brute_variants(docs, every=19)
    assert got == want and sum(r[1] is not None for r in want) > 20 and max(r[4] for r in want) > 5


def test_spelling_of_given_documents(spark, sf):
    d = spark.read.parquet(sf.rpartition("/")[0] + "/sf0.01/documents.parquet")
    got = sorted(map(tuple, spelling.group_variants(d).collect()))
    assert got == brute_variants([(r.doc_id, r.text) for r in d.collect()]) and any(r[1] for r in got)


def test_no_words(spark, empty):
    assert spelling.group_variants(empty).collect() == []
    assert spelling.group_variants(empty.sparkSession.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")).collect() == []


def test_long_texts_are_read_match_by_match(spark, monkeypatch):
    docs = made_documents()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(spelling, "LONG_TEXT", 10)
    monkeypatch.setattr(spelling, "HELD", 5)
    assert sorted(map(tuple, spelling.vocabulary(d).collect())) == [(r[0], r[3]) for r in brute_variants(docs)]
