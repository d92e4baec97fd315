import numpy as np
import pandas as pd
import pytest

from evidentia.llm import scoring


def test_slices_hold_all_ngrams_once():
    texts = ["a b a b c", "", "b", "c a b a"]
    found = scoring.hashed(texts, 3)
    words = [scoring.word_hashes(t.encode(), {}) for t in texts]
    got = [scoring._in_slice(np.concatenate(words), [len(w) for w in words], 3, k) for k in range(scoring.SLICES)]
    assert sorted(np.concatenate(got).tolist()) == sorted(x for f in found for g in f for x in g.tolist())


def test_only_one_slice_of_ngrams_is_shuffled_at_once(spark, docs, monkeypatch):
    """Tables that are written hold counts by block; no table and no plan holds rows of all n-grams."""
    seen, put = [], scoring.written
    monkeypatch.setattr(scoring, "written", lambda df, name: seen.append(put(df, name)) or seen[-1])
    out = scoring.score(docs, block_bytes=50_000)
    blocks, slices = seen[0], seen[1:]
    assert len(slices) == scoring.SLICES and all(s.count() <= blocks.count() for s in slices)
    assert "gram" not in out._jdf.queryExecution().executedPlan().toString()


def test_counts_of_other_ngrams_fail():
    found = scoring.hashed(["a b a"], 2)
    every = np.unique(np.concatenate([g for f in found for g in f]))
    rows = []
    for k in range(scoring.SLICES):
        mine = every[every % np.uint64(scoring.SLICES) == k].view(np.int64)
        rows += [(k, np.arange(len(mine)), np.bitwise_xor.reduce(mine))] if len(mine) else []
    ok = pd.DataFrame(rows, columns=["k", "rest", "mark"])
    assert (scoring._aligned(found, ok)["rest"] > 0).all()
    for bad in (ok.assign(mark=ok["mark"] ^ 1), ok.iloc[1:], ok.assign(rest=[np.append(r, 1) for r in ok["rest"]])):
        with pytest.raises(ValueError):
            scoring._aligned(found, bad)
