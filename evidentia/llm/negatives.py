"""Hard negatives by exact integer products, several candidates in one multiplication (Kronecker packing)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.store import written

#: Rows that pass by the anchors of a cell; beyond ``MOST_SLABS`` slabs of rows, slabs grow instead.
SLAB_ROWS, MOST_SLABS = 4_096, 4_096
#: Anchors of a cell, which stay in memory with their best answers.
CELL_ANCHORS = 65_536
#: Rows and anchors whose products are held at once.
STEP_ROWS, STEP_ANCHORS = 4_096, 512
#: Bits of the wide integer: what a double holds exactly, so that the matrix product may be the machine's own.
WIDE = 53
LEAST, MOST = -(2**63) + 1, 2**63 - 1


class Packed:
    """Rows of whole numbers, several to one wide integer, to be multiplied by anchors whose absolute components sum to ``weight`` at most.

    Components are biased to be no less than zero and stand in fields that no sum can leave; what one
    multiplication per anchor component adds up is unpacked to every row's exact product.
    """

    def __init__(self, rows: np.ndarray, weight: float) -> None:
        self.n, self.bias = len(rows), max(0.0, -rows.min(initial=0.0))
        bound = max(weight, 1.0) * (rows.max(initial=0.0) + self.bias)
        self.rows, self.fields = rows, 0
        if bound < 2.0 ** (WIDE - 2):
            self.width = int(bound).bit_length() + 2
            self.fields = WIDE // self.width
            each = -(-self.n // self.fields)
            biased = np.zeros((each * self.fields, rows.shape[1]))
            biased[: self.n] = rows + self.bias
            self.wide = sum(biased[j * each : (j + 1) * each] * 2.0 ** (j * self.width) for j in range(self.fields)).T

    def products(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products (anchor, row), exact; those that leave the range of a long are set to its end."""
        if not self.fields:  # Python's integers are as wide as it takes
            exact = np.vectorize(int, otypes=[object])
            return np.clip(exact(anchors) @ exact(self.rows).T, LEAST, MOST).astype(np.int64)
        left, out = anchors @ self.wide, []
        for j in reversed(range(self.fields)):
            field = np.rint(left / 2.0 ** (j * self.width))
            left -= field * 2.0 ** (j * self.width)
            out.append(field)
        scores = np.concatenate(out[::-1], axis=1)[:, : self.n] - self.bias * anchors.sum(axis=1)[:, None]
        return scores.astype(np.int64)


class Best:
    """The first ``k`` (score descending, id ascending) of each slot, over all rows that passed by."""

    def __init__(self, slots: int, k: int) -> None:
        self.k, self.floor = k, np.full(slots, LEAST - 1)
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        s = np.where(allowed & (scores >= self.floor[slots][:, None]), scores, LEAST - 1)
        if s.shape[1] > self.k:
            s = np.where(s >= np.partition(s, -self.k, axis=1)[:, -self.k, None], s, LEAST - 1)
        a, c = np.nonzero(s >= LEAST)
        if not len(a):
            return
        slot, score, id_ = (np.concatenate(x) for x in ((self.slot, slots[a]), (self.score, s[a, c]), (self.id, ids[c])))
        order = np.lexsort((id_, -score, slot))
        first = np.searchsorted(slot[order], slot[order])
        order = order[np.arange(len(order)) - first < self.k]
        self.slot, self.score, self.id = slot[order], score[order], id_[order]
        full = np.flatnonzero(np.bincount(self.slot, minlength=len(self.floor)) == self.k)
        self.floor[full] = self.score[np.searchsorted(self.slot, full, side="right") - 1]


def matrices(vectors: pa.Array, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and whole-number matrix of the vectors of each length."""
    sizes, flat = vectors.value_lengths().to_numpy(), np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return {int(d): (at := np.flatnonzero(sizes == d), flat[starts[at][:, None] + np.arange(d)]) for d in np.unique(sizes)}


class Cell:
    """Anchors of one cell, by length of vector; rows pass by once.

    Without bands an anchor's answers are its first rows of the same label; with them, the first rows of another label
    in each of its bands of scores. Each step of anchors keeps its own answers, so taking rows in never sorts those of others.
    """

    def __init__(self, k: int, slots: int, scale: float) -> None:
        self.k, self.per, self.scale, self.by_size = k, slots, scale, {}

    def anchors(self, b: pa.RecordBatch) -> None:
        ids, labels = b.column("id").to_numpy(), b.column("label").to_pylist()
        low, high = (b.column(c).to_pylist() for c in ("low", "high"))
        for d, (at, x) in matrices(b.column("vec"), self.scale).items():
            old = self.by_size.get(d)
            new = [ids[at], [labels[i] for i in at], x, [low[i] for i in at], [high[i] for i in at]]
            self.by_size[d] = new if old is None else [np.concatenate([o, n]) if isinstance(o, np.ndarray) else o + n for o, n in zip(old, new, strict=True)]

    def ready(self) -> None:
        for d, (ids, labels, x, low, high) in self.by_size.items():
            codes = {v: i for i, v in enumerate(dict.fromkeys(labels))}
            band = np.full((2, len(ids), self.per), MOST)
            band[1] = LEAST
            for i, (lo, hi) in enumerate(zip(low, high, strict=True)):
                if lo:
                    band[0, i, : len(lo)], band[1, i, : len(hi)] = lo, hi
            self.by_size[d] = (ids, codes, np.array([codes[v] for v in labels]), x, np.abs(x).sum(axis=1).max(initial=0.0), band, [Best(min(STEP_ANCHORS, len(ids) - s) * self.per, self.k) for s in range(0, len(ids), STEP_ANCHORS)])

    def rows(self, b: pa.RecordBatch, banded: bool) -> None:
        ids, labels = b.column("id").to_numpy(), b.column("label").to_pylist()
        for d, (at, x) in matrices(b.column("vec"), self.scale).items():
            if d not in self.by_size:
                continue
            a_ids, codes, a_label, a, weight, band, best = self.by_size[d]
            label = np.array([codes.get(labels[i], -1) for i in at])
            for r in range(0, len(at), STEP_ROWS):
                own, packed, row_ids = label[r : r + STEP_ROWS], Packed(x[r : r + STEP_ROWS], weight), ids[at][r : r + STEP_ROWS]
                for s, own_best in enumerate(best):
                    cut = slice(s * STEP_ANCHORS, (s + 1) * STEP_ANCHORS)
                    scores = packed.products(a[cut])
                    slots = np.arange(len(scores)) * self.per
                    same = a_label[cut][:, None] == own[None, :]
                    if not banded:
                        own_best.add(slots, scores, row_ids, same & (a_ids[cut][:, None] != row_ids[None, :]))
                        continue
                    for p in range(self.per):
                        lo, hi = band[:, cut, p]
                        own_best.add(slots + p, scores, row_ids, ~same & (scores >= lo[:, None]) & (scores <= hi[:, None]))

    def answers(self) -> Iterator[pa.RecordBatch]:
        for ids, *_, parts in self.by_size.values():
            for s, best in enumerate(parts):
                out = [ids[s * STEP_ANCHORS + best.slot // self.per], best.slot % self.per, best.id, best.score]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in out], names=["anchor", "slot", "other", "score"])


def _by_cell(vectors: DataFrame, anchors: DataFrame, n: int, n_anchors: int, k: int, slots: int, scale: float) -> DataFrame:
    """(anchor, slot, other, score): the first ``k`` of each anchor and slot in each cell, a slab of rows before a group of anchors."""
    slabs, groups = min(MOST_SLABS, -(-n // SLAB_ROWS) or 1), -(-n_anchors // CELL_ANCHORS) or 1
    banded = "low" in anchors.columns
    none = F.lit(None).cast("array<long>")
    place = lambda salt, of: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(of))
    up_to = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    a = anchors.select("id", "label", "vec", *(("low", "high") if banded else (none.alias("low"), none.alias("high"))), place(1, groups).alias("g"), up_to(slabs).alias("s"))
    r = vectors.select("id", "label", "vec", none.alias("low"), none.alias("high"), up_to(groups).alias("g"), place(0, slabs).alias("s"))
    both = a.withColumn("kind", F.lit(0)).unionByName(r.withColumn("kind", F.lit(1))).withColumn("cell", F.col("g") * slabs + F.col("s")).drop("g", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell, waiting = None, None, True
        for b in batches:
            keys = list(zip(b.column("cell").to_pylist(), b.column("kind").to_pylist(), strict=True))
            start = 0
            for (c, kind), run_ in groupby(keys):
                part = b.slice(start, size := len(list(run_)))
                start += size
                if c != at:
                    if cell is not None and not waiting:
                        yield from cell.answers()
                    at, cell, waiting = c, Cell(k, slots, scale), True
                if kind == 0:
                    cell.anchors(part)
                    continue
                if waiting:
                    cell.ready()
                    waiting = False
                cell.rows(part, banded)
        if cell is not None and not waiting:
            yield from cell.answers()

    dealt = both.repartition(min(slabs * groups * 2, 20_000), "cell").sortWithinPartitions("cell", "kind")
    return dealt.mapInArrow(run, "anchor long, slot long, other long, score long")


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """For each anchor and each of its ``positives`` first rows of the same label, the ``negatives`` first rows of another label whose score lies from ``low`` to ``high`` per cent of the positive's.

    A score is the integer inner product of floor(``scale`` * x); higher scores come first, ties by smaller id. All
    products are exact. Anchors meet all rows in blocks: a cell is a group of anchors, which stay in memory with
    their best answers, and a slab of rows, which pass by; labels do not deal rows out, so a hot one makes no
    difference, and each cell hands over its best answers only.

    Rows with a null id, label or vector, or any null or non-finite component take no part; nor do vectors of
    other lengths meet. An id counts once: of its rows, the least (label, vector). Scores beyond a long are
    set to its end. Other columns are not looked at; an empty table, or one without anchors, gives an empty one.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    v = v.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull())
    v = v.filter(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    v = written(v.groupBy("id").agg(F.min(F.struct("label", "vec", "anchor")).alias("r")).select("id", "r.*"), "vectors")
    anchors = v.filter("anchor")
    n, n_anchors = v.agg(F.count("*"), F.count_if("anchor")).first()
    best = lambda df, k, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "other"))).filter(F.col("rank") <= k)
    p = best(_by_cell(v, anchors, n, n_anchors, positives, 1, scale), positives, "anchor")
    p = written(p.select("anchor", (F.col("rank") - 1).cast("long").alias("slot"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # low * positive <= 100 * negative <= high * positive, in whole numbers that stay in range; no positive below zero has such a row
    bands = p.filter("positive_score >= 0").withColumns({
        "lo": F.expr(f"{low} * (positive_score div 100) + ({low} * (positive_score % 100) + 99) div 100"),
        "hi": F.expr(f"{high} * (positive_score div 100) + ({high} * (positive_score % 100)) div 100"),
    })
    bands = bands.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "lo", "hi"))).alias("b"))
    # scores sink with the slot, so slots with a band come first and keep their numbers
    wanted = anchors.drop("anchor").join(bands.select(F.col("anchor").alias("id"), F.col("b.lo").alias("low"), F.col("b.hi").alias("high")), "id")
    found = best(_by_cell(v, wanted, n, n_anchors, negatives, positives, scale), negatives, "anchor", "slot")
    out = found.join(p, ["anchor", "slot"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
