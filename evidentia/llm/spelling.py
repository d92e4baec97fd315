"""Spelling variants: words that one edit makes equal, by composing acceptors of the vocabulary with a one-edit transducer."""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.store import written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Words that a task counts before it hands them on, and characters beyond which a text is read match by match.
HELD, LONG_TEXT = 200_000, 1_000_000
#: Words of a partition beyond which it is split.
PARTITION_WORDS = 2_000
#: Least code points of a word, half of which any single edit leaves in place at one end.
SHORTEST, END = 6, 3
NO_END = 1 << 30


def _words(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """(word, n) of a task's documents, each document's distinct runs looked at once."""
    held: Counter = Counter()
    low: dict[str, tuple[str, bytes]] = {}

    def handed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        held.clear()
        low.clear()
        return out

    for b in batches:
        for id_, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
            if not text:
                continue
            before = zlib.crc32(f"{'null' if id_ is None else id_}:".encode())
            runs = Counter(RUN.findall(text) if len(text) <= LONG_TEXT else (m[0] for m in RUN.finditer(text)))
            for run, n in runs.items():
                if len(run) < SHORTEST:
                    continue
                if run not in low:
                    low[run] = (w := run.translate(LOWER)), w.encode()
                word, raw = low[run]
                h = zlib.crc32(raw, before)
                if h % every == 0:
                    i = h % len(word)
                    word = word[:i] + word[i + 1 :]
                    if len(word) < SHORTEST:
                        continue
                held[word] += n
            if len(held) > HELD or len(low) > HELD:
                yield handed()
    yield handed()


def vocabulary(docs: DataFrame, least: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of at least six code points with ``n`` of at least ``least`` occurrences; counts are summed by task first, so a frequent word costs a row a task.

    In runs whose crc32 with their document's id is divisible by ``every`` one code point is deleted.
    """
    d = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    counted = d.mapInArrow(lambda batches: _words(batches, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class Acceptor:
    """Minimal acyclic acceptor of sorted distinct words: ``arcs`` by letter and ``final`` of each state."""

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        path, last = [0], ""

        def settle(depth: int) -> None:
            for d in range(len(path) - 1, depth, -1):
                s = path.pop()
                key = (self.final[s], *self.arcs[s].items())
                same = known.setdefault(key, s)
                if same != s:
                    self.arcs[path[-1]][last[d - 1]] = same

        for w in words:
            depth = next((i for i, (a, b) in enumerate(zip(last, w, strict=False)) if a != b), min(len(last), len(w)))
            settle(depth)
            for c in w[depth:]:
                self.arcs[path[-1]][c] = len(self.arcs)
                path.append(len(self.arcs))
                self.arcs.append({})
                self.final.append(False)
            self.final[path[-1]] = True
            last = w
        settle(0)


class Composition:
    """Acceptor, one-edit transducer and acceptor again, composed while they are walked.

    Before the edit both sides are in one state; after it, a pair of states accepts what both accept. Pairs that accept
    nothing in common are remembered and not entered. An edit stands where the words first differ, so a pair has one path.
    """

    def __init__(self, words: list[str]) -> None:
        self.a = Acceptor(words)
        self.met: dict[tuple[int, int], bool] = {}

    def meet(self, p: int, q: int) -> bool:
        if p == q:
            return True
        key = (p, q) if p < q else (q, p)
        if (known := self.met.get(key)) is not None:
            return known
        a, b = self.a.arcs[p], self.a.arcs[q]
        if not (out := self.a.final[p] and self.a.final[q]):
            for c, r in a.items():
                if c in b and self.meet(r, b[c]):
                    out = True
                    break
        self.met[key] = out
        return out

    def common(self, p: int, q: int) -> Iterator[str]:
        """What both states accept."""
        if not self.meet(p, q):
            return
        todo, path = [(p, q, 0, "")], []
        while todo:
            p, q, depth, c = todo.pop()
            if depth:
                del path[depth - 1 :]
                path.append(c)
            if self.a.final[p] and self.a.final[q]:
                yield "".join(path)
            b = self.a.arcs[q]
            todo += [(r, b[c], depth + 1, c) for c, r in self.a.arcs[p].items() if c in b and self.meet(r, b[c])]

    def pairs(self, until: int) -> Iterator[tuple[str, str]]:
        """Accepted pairs whose words first differ before position ``until``; of an insertion the shorter word comes first."""
        arcs, final, todo = self.a.arcs, self.a.final, [(0, "")]
        while todo:
            p, x = todo.pop()
            out = list(arcs[p].items())
            for i, (a, r) in enumerate(out):
                for b, s in out[i + 1 :]:
                    for y in self.common(r, s):
                        yield x + a + y, x + b + y
                if final[p] and final[r]:
                    yield x, x + a
                for b, s in out:
                    if b != a and b in arcs[r]:
                        for y in self.common(arcs[r][b], s):
                            yield x + b + y, x + a + b + y
            if len(x) + 1 < until:
                todo += [(r, x + a) for a, r in out]


def _first_keys(words: DataFrame) -> DataFrame:
    """Each word in the partitions of its first and of its last letters: an edit leaves one of the two in place."""
    part = lambda lo, hi, key: F.struct(F.lit(0).alias("size"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), key.alias("key"))
    both = F.array(part(END, NO_END, F.left("word", F.lit(END))), part(0, END, F.right("word", F.lit(END))))
    return words.select("word", "n", F.explode(both).alias("p")).select("word", "n", "p.*")


def _split(rows: DataFrame) -> DataFrame:
    """Rows of full partitions in partitions of half the positions: words that first differ at lo to hi share what stands before lo and what stands behind hi.

    The letters behind hi depend on the shorter word's length, so from here on each word is in partitions of its
    own length (``size``) and, as the longer word, of one less.
    """
    own = F.length("word")
    sizes = F.when(F.col("size") > 0, F.array("size")).otherwise(F.filter(F.array(own, own - 1), lambda s: s >= SHORTEST))
    r = rows.withColumn("size", F.explode(sizes)).withColumn("hi", F.least(F.col("hi"), F.col("size") + 1))
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    r = r.withColumn("half", F.explode(F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi")))))
    lo, hi = F.col("half.lo"), F.col("half.hi")
    key = F.concat(F.left("word", lo), F.lit("\n"), F.right("word", F.greatest(F.col("size") - hi, F.lit(0))))
    return r.select("word", "n", "size", lo.alias("lo"), hi.alias("hi"), key.alias("key")).filter("lo < hi")


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, best n, best word) of each partition; a pair is met in one partition only."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("size", "lo", "hi", "key", "word", "n")), strict=True)

    def best(found: dict, word: str, other: str, n: int) -> None:
        if (f := found.get(word)) is None:
            found[word] = [1, n, other]
        else:
            f[0] += 1
            if n > f[1] or n == f[1] and other < f[2]:
                f[1:] = n, other

    found: dict[str, list] = {}
    out = lambda: pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), *(pa.array([f[i] for f in found.values()], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string())))], names=["word", "n_near", "best_n", "best"])
    for (size, lo, hi, key), group in groupby(rows(), key=lambda r: r[:4]):
        words = {r[4]: r[5] for r in group}
        if len(words) < 2:
            continue
        tail = len(key) - lo if size == 0 else len(key) - lo - 1
        head, end = (key[:lo], key[lo + (size > 0) :]) if tail else (key[:lo], "")
        middle = sorted(w[lo : len(w) - tail] for w in words)
        sys.setrecursionlimit(max(10_000, 2 * max(map(len, middle)) + 1_000))
        for u, v in Composition(middle).pairs(hi - lo):
            if size and len(u) + lo + tail != size:
                continue
            u, v = head + u + end, head + v + end
            best(found, u, v, words[v])
            best(found, v, u, words[u])
        if len(found) > HELD:
            yield out()
            found = {}
    yield out()


def near_words(words: DataFrame, most: int = PARTITION_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have a near one: how many, and the near word of largest n (ties: smallest by code point).

    Partitions of over ``most`` words are split by position until none is left or until a single position is, where
    only letters differ and so no more words than pairs of letters can meet.
    """
    rows, done, on = _first_keys(words), [], ["size", "lo", "hi", "key"]
    while True:
        full = rows.groupBy(*on).agg(F.count("*").alias("words")).filter((F.col("words") > most) & (F.col("hi") - F.col("lo") > 1))
        full = written(full.drop("words"), "full")
        if full.isEmpty():
            break
        done.append(rows.join(full, on, "left_anti"))
        rows = _split(rows.join(full, on, "left_semi"))
    for d in done:
        rows = rows.unionByName(d)
    parts = max(16, min(20_000, words.count() // 10_000))
    met = rows.repartition(parts, *on).sortWithinPartitions(*on).mapInArrow(_near, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("best")))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("f")).select("word", "n_near", (-F.col("f.n")).alias("best_n"), F.col("f.best").alias("best"))


def roots(forms: DataFrame, ratio: int, largest: int) -> DataFrame:
    """(word, root) of (word, form) by doubling: a form has ``ratio`` times its word's n, so chains are short and the number of rounds is known."""
    steps = math.log(max(largest, ratio), ratio) + 1
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(steps)))):
        next_ = out.select(F.col("word").alias("w_"), F.col("root").alias("r_"))
        out = written(out.join(next_, F.col("root") == F.col("w_"), "left").select("word", F.coalesce("r_", "root").alias("root")), "roots")
    return out


def group_variants(docs: DataFrame, least: int = 5, every: int = 199, ratio: int = 5, most: int = PARTITION_WORDS, **names: str) -> DataFrame:
    """Each word of the vocabulary with its form (the near word of largest n, if that is ``ratio`` times its own or more), root, n, n_near and form_n.

    Near words differ by one inserted, deleted or replaced code point. Null and empty texts have no words, a null
    id counts as ``null``, rows repeated whole count each, texts and words may be of any length; ties go to the word
    that is smallest by code point; an empty table gives an empty one; other columns are not looked at.
    """
    words = written(vocabulary(docs, least, every, **names), "words")
    near = written(near_words(words, most), "near")
    all_ = words.join(near.withColumnRenamed("word", "w_"), F.col("word") == F.col("w_"), "left").drop("w_")
    is_form: Column = F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False))
    all_ = all_.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    all_ = written(all_, "forms")
    largest = all_.agg(F.max("form_n")).first()[0] or 1
    root = roots(all_.filter("form is not null"), ratio, largest).withColumnRenamed("word", "w_")
    return all_.join(root, F.col("word") == F.col("w_"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
