import re
from collections import Counter

import pytest
import xxhash

from evidentia.llm import graph, queries, simhash


def brute(texts, k=3):
    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    return out


def roots(prints, ids, budget=3):
    only = sorted(set(prints))
    up = {p: p for p in only}

    def find(p):
        while up[p] != p:
            p = up[p]
        return p

    for i, a in enumerate(only):
        for b in only[i + 1 :]:
            if (a ^ b).bit_count() <= budget:
                up[find(b)] = find(a)
    low = {}
    for p, d in zip(prints, ids, strict=True):
        if d is not None:
            low[find(p)] = min(d, low.get(find(p), d))
    return [low.get(find(p)) for p in prints]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_simhash_query(which, request):
    d = request.getfixturevalue(which)
    rows = d.select("doc_id", "text").collect()
    prints = brute([r.text for r in rows])
    want = Counter(zip([r.doc_id for r in rows], [f"{p:016x}" for p in prints], roots(prints, [r.doc_id for r in rows]), strict=True))
    reader = type("R", (), {"read": type("P", (), {"parquet": staticmethod(lambda _: d)})})
    assert Counter(map(tuple, queries.op2_simhash(reader, "x").collect())) == want


@pytest.mark.parametrize("n", [1, 3000])
def test_trie_links_are_all_pairs(spark, n):
    import random

    rnd = random.Random(n)
    base = [rnd.getrandbits(64) for _ in range(n)]
    near = [b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(0, 5))) for b in base for _ in range(2)]
    near += [base[0] ^ i for i in range(64)]  # a dense cluster
    signed = [x - 2**64 if x >> 63 else x for x in {*base, *near}]
    got = {tuple(r) for r in simhash.trie_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    import numpy as np

    a = np.array(sorted(signed), dtype=np.int64)
    want = set()
    for i in range(len(a)):
        d = np.bitwise_count((a[i + 1 :] ^ a[i]).view(np.uint64))
        want |= {(int(a[i]), int(x)) for x in a[i + 1 :][d <= 3]}
    assert got == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 7), (7, 9), (9, 5), (3, 3), (200, 100)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 200: 100, 5: 5, 7: 5, 9: 5}


def test_keep_one(odd, empty):
    kept = simhash.keep_one(odd)
    rows = kept.select("doc_id", "text").collect()
    assert kept.columns == odd.columns
    # each distinct text with words stays once, under its smallest id; those without words are one group
    assert Counter((r.text or "").strip() for r in rows) == Counter({(r.text or "").strip() for r in odd.collect()})
    assert simhash.keep_one(empty).count() == 0
