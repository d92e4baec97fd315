import random

from evidentia.llm import simhash


def brute_groups(texts, similarity=0.8):
    """Groups of texts whose sets of five words reach the similarity, by comparing all pairs."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up, n_links = list(range(len(texts))), 0

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared >= similarity * (len(a) + len(sets[j]) - shared):
                up[find(i)] = find(j)
                n_links += 1
    return [find(i) for i in range(len(texts))], n_links


def test_keep_one_reaches_jaccard_080(spark):
    rnd = random.Random(5)
    texts = []
    for i in range(120):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(60, 400))]
        texts.append(" ".join(words))
        for share in (0.01, 0.02, 0.03, 0.05):  # of words changed: similarities from about 0.95 to under 0.7
            texts.append(" ".join(f"n{rnd.randrange(5000)}" if rnd.random() < share else w for w in words))
    texts += [texts[0]] * 40 + [texts[0] + f" end{i}" for i in range(80)] + ["", " ", None]  # one large group
    group, _ = brute_groups(texts)
    rnd.shuffle(order := list(range(len(texts))))
    docs = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    want = {}
    for i, g in enumerate(group):
        want[g] = min(i, want.get(g, i))
    assert set(want.values()) <= set(kept)  # nothing is lost that has no near copy before it
    assert len(kept) <= 1.02 * len(want)  # the 3-bit budget keeps about 1.5 times as many


def test_keep_one_of_given_documents(spark, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    group, n_links = brute_groups([t for _, t in rows])
    want = {}
    for (i, _), g in zip(rows, group, strict=True):
        want.setdefault(g, i)
    assert n_links and sorted(want.values()) == sorted(r.doc_id for r in simhash.keep_one(docs).collect())


def test_texts_meet_where_a_part_differs_in_one_bit(spark):
    """All pairs of values of a part within one bit meet, and no others: held against brute force, with a crowded node."""
    rnd = random.Random(9)
    centre = rnd.getrandbits(64)
    prints = [rnd.getrandbits(64) for _ in range(400)] + [centre ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(200)] + [centre] * 3
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    depth, parts = 16, 3
    met = simhash._meetings(spark.createDataFrame(list(enumerate([[x] for x in signed])), "v long, x array<long>"), depth, parts).collect()
    nodes, got = {}, set()
    for r in met:
        nodes.setdefault(r.node, []).append((r.v, r.side))
    for node, members in nodes.items():
        got |= {(u, v) for u, su in members for v, sv in members if u < v and (node >= 0 or su != sv)}
    cut = lambda x, i: x >> (i * depth) & 0xFFFF
    want = {(u, v) for v in range(len(prints)) for u in range(v) if any((cut(prints[u], i) ^ cut(prints[v], i)).bit_count() <= 1 for i in range(parts))}
    assert got == want and len(want) > 1000
