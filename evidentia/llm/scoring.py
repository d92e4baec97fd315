"""Stupid-backoff language-model scores from n-gram counts of the corpus itself."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.mixing import word_count
from evidentia.llm.store import written

#: UTF-8 bytes of text that one block of documents holds, about.
BLOCK_BYTES = 4_000_000
#: N-grams are counted in so many slices, one after the other, and only one slice's rows are on disk.
SLICES = 8


def word_hashes(text: bytes, memo: dict[bytes, int]) -> np.ndarray:
    """XXH64 of a text's words (A-Z lower-cased, split at ASCII white space)."""
    out = []
    for w in text.lower().split():
        h = memo.get(w)
        if h is None:
            h = memo[w] = xxhash.xxh64_intdigest(w, 0)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def joined(h: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Hashes of n-grams one word longer."""
    with np.errstate(over="ignore"):
        x = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + following
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(27))


def grams(h: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to ``order``, hashes of the n-grams that end at each word from the n-th on."""
    out = [joined(np.zeros(len(h), dtype=np.uint64), h)]
    for _ in range(1, order):
        out.append(joined(out[-1][:-1], h[len(h) - len(out[-1]) + 1 :]) if len(out[-1]) > 1 else out[-1][:0])
    return out


def score(docs: DataFrame, order: int = 3, backoff: float = 0.4, id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, backed_off, logprob and mean_logprob.

    The model is the rest of the corpus: counts come from all documents, and a document's own n-grams are
    taken off before it is scored, so that copies of it elsewhere, but not itself, make it likely. A word w
    after context h has count(h w) / count(h) if the rest of the corpus has h w, else ``backoff`` times
    the score with the context one word shorter; at last (count(w) or 1) / all words. Unlike a held-out
    model nothing is cut, so no n-gram is lost. Logarithms are natural; a document without words scores 0.

    Documents are dealt into blocks by hash, and each block's n-grams become rows (block, gram, own), so that a
    frequent n-gram costs one row per block, not one per occurrence. These rows, several times the input, are counted in
    ``SLICES`` slices by hash: a slice's rows are partitioned by n-gram, summed by a window, and go back to their block,
    which keeps one row of a slice, the counts from elsewhere in the order of its n-grams; what was shuffled is then removed. At
    last a block's counts meet its texts and are summed by document. The number of blocks follows the input, so that a block
    stays within a few MB; a single text longer than a block makes a block of its own size. N-grams are told
    apart by 64 bits of hash. A block that gets counts of n-grams it does not hold fails, so rows dealt out in two ways, as after a
    retry over unordered input, never give a silent wrong score. Null text is empty; rows repeated whole count as often as they stand, and each is
    scored against the others; ids may be null or repeat; an empty table gives an empty one; other columns are not
    looked at.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sums = d.agg(F.sum(F.octet_length("text")), F.sum(word_count(F.col("text")))).first()
    total, words = sums[0] or 0, sums[1] or 0
    id_type = d.schema["doc_id"].dataType.simpleString()
    block = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(max(1, math.ceil(total / block_bytes))))  # rows repeated whole are dealt out too
    texts = d.select(block.alias("block"), F.col("doc_id").cast("string").alias("id"), "text")

    def coded(pdf: pd.DataFrame) -> pd.DataFrame:
        """A block in one row: the words of each text, the distinct words' hashes, and where in these each word is."""
        memo: dict[bytes, int] = {}
        found = [word_hashes(t.encode(), memo) for t in pdf["text"]]
        vocabulary, at = np.unique(np.concatenate(found), return_inverse=True)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "lengths": [np.array([len(x) for x in found], dtype=np.int32)], "vocabulary": [vocabulary.view(np.int64)], "words": [at.astype(np.int32)]})

    blocks = written(texts.groupBy("block").applyInPandas(coded, "block long, lengths array<int>, vocabulary array<long>, words array<int>"), "blocks")
    elsewhere = reduce(DataFrame.union, [written(_slice(blocks, k, order), "slice") for k in range(SLICES)])

    def summed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = hashed(left["text"], order)
        return _scored(left, _aligned(found, right), words, order, backoff, found)

    out = texts.groupBy("block").cogroup(elsewhere.groupBy("b")).applyInPandas(summed, "doc_id string, n_words long, backed_off long, logprob double, mean_logprob double")
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))


def _slice(blocks: DataFrame, k: int, order: int) -> DataFrame:
    """b, k, rest and mark of each block with n-grams of slice ``k``: their counts in other blocks, in the order of their hashes, and these hashes' XOR."""

    def exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The blocks' distinct n-grams of all orders with their counts in the block."""
        for pdf in batches:
            for block, lengths, vocabulary, at in zip(pdf["block"], pdf["lengths"], pdf["vocabulary"], pdf["words"], strict=True):
                gram, own = np.unique(_in_slice(np.asarray(vocabulary, np.int64).view(np.uint64)[at], lengths, order, k), return_counts=True)
                yield pd.DataFrame({"block": block, "gram": gram.view(np.int64), "own": own})

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        gram = pdf["gram"].to_numpy(np.int64).view(np.uint64)
        rest = pdf["rest"].to_numpy(np.int64)[np.argsort(gram)]
        return pd.DataFrame({"b": [pdf["block"].iloc[0]], "k": [k], "rest": [rest], "mark": [np.bitwise_xor.reduce(gram.view(np.int64))]})

    ngrams = blocks.mapInPandas(exploded, "block long, gram long, own long")
    rest = F.sum("own").over(Window.partitionBy("gram")) - F.col("own")
    return ngrams.select("block", "gram", rest.alias("rest")).groupBy("block").applyInPandas(packed, "b long, k long, rest array<long>, mark long")


def _in_slice(h: np.ndarray, lengths: np.ndarray, order: int, k: int) -> np.ndarray:
    """The n-grams of slice ``k`` of texts that stand one after the other, repeats included; none goes over a text's end."""
    lengths = np.asarray(lengths, np.int64)
    place = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.concatenate([g[(place[len(h) - len(g) :] >= n) & (g % np.uint64(SLICES) == k)] for n, g in enumerate(grams(h, order))])


def _aligned(found: list[list[np.ndarray]], slices: pd.DataFrame) -> pd.DataFrame:
    """gram and rest of a block's n-grams that other blocks have, from the rows of :func:`_slice`, which must be of the same n-grams."""
    every = np.unique(np.concatenate([g for f in found for g in f] or [np.zeros(0, dtype=np.uint64)]))
    given = {k: (np.asarray(rest, np.int64), mark) for k, rest, mark in zip(slices["k"], slices["rest"], slices["mark"], strict=True)}
    rests = np.zeros(len(every), dtype=np.int64)
    for k in range(SLICES):
        mine = np.flatnonzero(every % np.uint64(SLICES) == k)
        rest, mark = given.get(k, (rests[:0], 0))
        if len(rest) != len(mine) or np.bitwise_xor.reduce(every[mine].view(np.int64)) != mark:
            raise ValueError("counts of n-grams that their block does not hold: rows were dealt out differently when they were counted")
        rests[mine] = rest
    seen = rests > 0
    return pd.DataFrame({"gram": every[seen].view(np.int64), "rest": rests[seen]})


def hashed(texts: Iterable[str], order: int) -> list[list[np.ndarray]]:
    memo: dict[bytes, int] = {}
    return [grams(word_hashes(t.encode(), memo), order) for t in texts]


def _scored(block: pd.DataFrame, elsewhere: pd.DataFrame, words: int, order: int, backoff: float, found: list[list[np.ndarray]] | None = None) -> pd.DataFrame:
    """Scores of a block's documents from its own n-grams (``found``, if they are known) and their counts in other blocks."""
    found = hashed(block["text"], order) if found is None else found
    every, count = np.unique(np.concatenate([g for f in found for g in f] or [np.zeros(0, dtype=np.uint64)]), return_counts=True)
    gram = elsewhere["gram"].to_numpy(np.int64).view(np.uint64)
    at = np.searchsorted(every, gram)
    if len(gram) and (at.max() >= len(every) or (every[at] != gram).any()):
        raise ValueError("counts of n-grams that their block does not hold: rows were dealt out differently when they were counted")
    count[at] += elsewhere["rest"].to_numpy(np.int64)
    rows = []
    for doc, f in zip(block["id"], found, strict=True):
        w, left = len(f[0]), []
        for g in f:  # counts without the document's own
            _, at, mine = np.unique(g, return_inverse=True, return_counts=True)
            left.append(count[np.searchsorted(every, g)] - mine[at])
        log, done, backs = np.zeros(w), np.zeros(w, dtype=bool), 0
        for n in range(order - 1, 0, -1):
            seen = np.zeros(w, dtype=bool)
            seen[n:] = left[n] > 0
            seen &= ~done
            at = np.flatnonzero(seen)
            log[at] += np.log(left[n][at - n]) - np.log(left[n - 1][at - n])
            done |= seen
            behind = ~done
            behind[:n] = False  # too few words before: the shorter context is no backing off
            log[behind] += math.log(backoff)
            backs += int(behind.sum())
        log[~done] += np.log(np.maximum(1, left[0][~done]) / max(1, words - w))
        s = float(log.sum())
        rows.append((doc, w, backs, s, s / w if w else 0.0))
    return pd.DataFrame(rows, columns=["doc_id", "n_words", "backed_off", "logprob", "mean_logprob"])
