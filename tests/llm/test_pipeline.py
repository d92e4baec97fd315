import re
from collections import Counter

import numpy as np

import corpus_pipeline
from evidentia.llm import langid, store
from test_mixing_packing_binary import PATTERNS, brute_ids, crc
from test_near_dedup import brute_groups


def test_stages_keep_columns_and_values(spark, odd):
    """Clashing columns come through all stages with their values; rows change in their text only."""
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = store.written(stage(spark, docs, ""), name)
        assert out.columns == docs.columns
        rest = [c for c in docs.columns if c != "text"]
        assert {tuple(r) for r in out.select(rest).collect()} <= {tuple(r) for r in docs.select(rest).collect()}
        assert all(r[c] == "x" for r in out.collect() for c in odd.columns[5:])
        if name == "language_id":
            assert {r.text for r in docs.collect()} - {r.text for r in out.collect()} >= {None, "", "  \t\n "}
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    want = brute_ids("word_bpe_49k.json", 1, [r.text for r in docs.collect()])
    assert sum(r.length for r in packed) == sum(map(len, want))


def test_empty_table(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == empty.columns and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0


def live_masked(rows):
    """Base spans of values that fewer than three owners have, and long mixed tokens of one owner, masked: by regular expressions in Python."""
    found, owners = [], {}
    for r in rows:
        t, own = r.text or "", []
        for k, p, g, least in PATTERNS:
            own += [(m.start(), m.end(), k, m[g]) for m in p.finditer(t) if len(m[g]) >= least]
        base = list(own)
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t):
            if all(re.search(x, m[0]) for x in ("[0-9]", "[a-z]", "[A-Z]")) and not any(a < m.end() and m.start() < b for a, b, *_ in base):
                own.append((m.start(), m.end(), "owned", m[0]))
        found.append(own)
        for *_, v in own:
            owners.setdefault(v, set()).add(r.source)
    out = []
    for r, own in zip(rows, found, strict=True):
        cover = np.zeros(len(r.text or ""), dtype=bool)
        starts = set()
        for a, b, k, v in sorted(own):
            if len(owners[v]) < 3 and (k != "owned" or len(owners[v]) == 1):
                if not cover[a]:
                    starts.add(a)
                cover[a:b] = True
        out.append("".join("<SECRET>" if i in starts else "" if cover[i] else c for i, c in enumerate(r.text)) if r.text is not None else None)
    return out


def test_pipeline_by_hand(spark, sf):
    """Each stage against a version without Spark: accuracy and rejected texts, all pairs, patterns, rates, and the tokenizer."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = store.written(corpus_pipeline.known_languages(spark, docs, sf), "known")
    left, out = {r.doc_id: r for r in known.collect()}, {r.doc_id: r for r in docs.collect()}
    gone = [r for i, r in out.items() if i not in left]
    assert all(not r.text or sum(c.isalpha() for c in r.text) < 0.7 * len(r.text.replace(" ", "")) or len(r.text) < 400 for r in gone) and len(gone) < 0.2 * len(out)
    model = langid.fit(docs)
    assert set(left) == {i for i, r in out.items() if model.predict(r.text)[0] != "und" and model.predict(r.text)[2] >= 0.02}
    rows = sorted(left.values(), key=lambda r: r.doc_id)
    first = {}
    for r, g in zip(rows, brute_groups([r.text for r in rows])[0], strict=True):
        first.setdefault(g, r.doc_id)
    one = store.written(corpus_pipeline.one_of_each_group(spark, known, sf), "one")
    assert Counter(r.doc_id for r in one.collect()) == Counter(first.values())
    rows = sorted(one.collect(), key=lambda r: r.doc_id)
    masked = store.written(corpus_pipeline.masked_secrets(spark, one, sf), "masked")
    assert {r.doc_id: r.text for r in masked.collect()} == {r.doc_id: t for r, t in zip(rows, live_masked(rows), strict=True)}
    mixed = store.written(corpus_pipeline.mixed_sources(spark, masked, sf), "mixed")
    n = Counter(r.doc_id for r in mixed.collect())
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = Counter()
    for r in masked.collect():
        size[r.source] += words(r.text)
    order = sorted(size, key=lambda s: (s is None, s))
    weight, target, free = {s: i % 3 + 1 for i, s in enumerate(order)}, {}, sum(size.values())
    open_ = set(size)
    while over := [s for s in open_ if free * weight[s] / sum(weight[x] for x in open_) > 3 * size[s]]:
        target |= {s: 3 * size[s] for s in over}
        open_ -= set(over)
        free = sum(size.values()) - sum(target.values())
    target |= {s: free * weight[s] / sum(weight[x] for x in open_) for s in open_}
    assert all(int(target[r.source] / size[r.source]) <= n[r.doc_id] <= int(target[r.source] / size[r.source]) + 1 for r in masked.collect() if size[r.source])
    packed = corpus_pipeline.packed_sequences(spark, mixed, sf).collect()
    src = mixed.collect()
    want = Counter()
    for r, ids in zip(src, brute_ids("word_bpe_49k.json", 1, [r.text for r in src]), strict=True):
        want.update((r.doc_id, i, at, len(ids[at : at + 4096]), crc(ids[at : at + 4096])) for i, at in enumerate(range(0, len(ids), 4096)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
