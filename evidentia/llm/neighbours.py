"""Approximate nearest neighbours by a forest of random-projection trees and exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.store import written

#: Entries that are compared at once: leaves are grouped into cells of about so many, larger leaves are dealt out by salt.
LEAF_ROWS = 16_000
#: Queries that are compared with a cell at once.
QUERY_ROWS = 4_000


@dataclass
class Forest:
    """Complete binary trees in arrays: node i has children 2i+1 and 2i+2; leaves are numbered from 0."""

    depth: int
    normals: list[np.ndarray]
    cuts: list[np.ndarray]

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (np.einsum("ij,ij->i", x, self.normals[tree][at]) > self.cuts[tree][at])
        return at - len(self.cuts[tree])

    def search(self, q: np.ndarray, counts: list[np.ndarray], used: int, enough: float) -> Iterator[tuple[int, int, int]]:
        """Leaves of the first ``used`` trees in the order of one queue by margin, until they hold ``enough`` entries, with the entries so far."""
        queue, held, inner = [(-np.inf, t, 0) for t in range(used)], 0, len(self.cuts[0])
        margins = [self.normals[t] @ q - self.cuts[t] for t in range(used)]
        while queue and held < enough:
            bound, t, node = heapq.heappop(queue)
            m = margins[t]
            while node < inner:
                near, far = (2 * node + 2, 2 * node + 1) if m[node] > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (max(bound, abs(m[node])), t, far))
                node = near
            if n := counts[t][node - inner]:
                held += n
                yield t, node - inner, held


def grow(sample: np.ndarray, depth: int, trees: int, seed: int) -> Forest:
    rng, inner, dim = np.random.default_rng(seed), 2**depth - 1, sample.shape[1]
    normals, cuts = [], []
    for _ in range(trees):
        n, c, at = np.zeros((inner, dim)), np.zeros(inner), np.zeros(len(sample), dtype=np.int64)
        for node in range(inner):
            own = np.flatnonzero(at == node)
            v = sample[rng.choice(own, 2, replace=False)] if len(own) > 1 else rng.normal(size=(2, dim))
            v = v[0] - v[1]
            n[node] = v / (np.linalg.norm(v) or 1.0)
            side = sample[own] @ n[node]
            c[node] = np.median(side) if len(own) else 0.0
            at[own] = 2 * node + 1 + (side > c[node])
        normals.append(n)
        cuts.append(c)
    return Forest(depth, normals, cuts)


def usable(vec: Column) -> Column:
    """Not null, not zero, all components finite."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok & F.exists(vec, lambda x: x != 0), F.lit(False))


def tuned(forest: Forest, counts: list[np.ndarray], n: int, asked: np.ndarray, near: list[np.ndarray], recall: float) -> tuple[int, float]:
    """The number of trees and the budget (a share of all entries) that find ``recall`` of the tuning queries' true neighbours at the least cost.

    A neighbour is found once the queue has come to its leaf in one of the trees, so the budget is a
    quantile of what the neighbours need. No budget is above all entries of one tree, which is an exact search.
    """
    best, used = (1, 1.0), 1
    while used <= len(forest.normals):
        need = []
        for q, x in zip(asked, near, strict=True):
            at = np.full((used, len(counts[0])), np.inf)
            for t, leaf, held in forest.search(q, counts, used, np.inf):
                at[t, leaf] = held
            if len(x):
                need.append(np.min([at[t, forest.leaves(x, t)] for t in range(used)], axis=0))
        share = float(np.quantile(np.concatenate(need), recall)) / n if need else 1.0
        if share < best[1]:
            best = (used, share)
        used *= 2
    return best


def by_hash(entries: DataFrame, n: int, rows: int, last: bool = False) -> DataFrame:
    """The ``rows`` of the ``n`` entries whose hash is smallest, or largest.

    Hashes are uniform, so about twice as many are left by a bound on the hash; only these are put in order. Without it each
    task would send the driver so many of its own.
    """
    share, found = 2 * rows / max(1, n), entries
    while share < 1:
        width = int(share * 2**64)
        found = entries.filter(F.col("entry") >= 2**63 - width if last else F.col("entry") < width - 2**63)
        if found.count() >= rows:
            break
        share, found = 2 * share, entries
    return found.orderBy(F.desc("entry") if last else "entry").limit(rows)


def _closest(x: np.ndarray, low: np.ndarray, second: np.ndarray, q_id: int, q: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the ``k`` nearest of those whose rough squared distance is finite, and their distances; ties go to the smaller id."""
    here = np.flatnonzero(np.isfinite(rough))
    here = here[(low[here] != q_id) | (second[here] >= 0)]
    if len(here) > k:
        d = rough[here]
        here = here[d <= np.partition(d, k - 1)[k - 1] + 1e-9 * (1 + float(q @ q))]
    exact = np.sqrt(((x[here] - q) ** 2).sum(axis=1))
    order = np.lexsort((np.where(low[here] == q_id, second[here], low[here]), exact))[:k]
    return here[order], exact[order]


def nearest(vectors: DataFrame, queries: Column, k: int = 10, trees: int = 8, leaf: int = 100, sample_rows: int = 20_000, tune: int = 200, recall: float = 0.94, share: float | None = None, seed: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each row where ``queries`` holds.

    Equal vectors are one index entry that keeps its ``k + 1`` smallest ids, all that any answer can
    need, so a vector that a third of all rows share is one entry. The forest is grown on at most
    ``sample_rows`` entries, chosen by hash, and sent to the tasks (at most 2^10 normals a tree); every entry is
    indexed. A query searches leaves of all trees through one queue until they hold ``share`` times the number
    of entries; those entries are compared exactly, in double precision. Unless ``share`` is given, it and the
    number of trees are the cheapest that find ``recall`` of the true neighbours of ``tune`` entries, which
    one pass over all entries finds: clustered vectors need few leaves, directions without structure
    most of them. A budget of all entries of one tree (``share=1, trees=1``) is the exact way.

    Leaves are grouped into cells; a query meets a cell once, whichever of its leaves it searches, and each
    meeting gives its ``k`` nearest. Ties go to the smaller id. Unusable vectors take no part, nor do those of
    another length than the most frequent one (the longest, if tied). A null id takes no part; an id that
    stands at several vectors is as many candidates, and the query's own id is none. Rows repeated whole are
    one. An empty table, or one without usable vectors, gives an empty one; other columns are not looked at.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks")).filter(F.col("id").isNotNull() & usable(F.col("vec")))
    v = written(v, "vectors")
    dims = v.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dims:
        return empty
    v = v.filter(F.size("vec") == dims[0]["dim"])
    first = v.select("id", "vec").distinct().withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("r") <= k + 1)
    entries = written(first.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("entry", F.xxhash64("vec")), "entries")
    n = entries.count()
    sample = by_hash(entries, n, sample_rows).select("vec").toPandas()
    depth = max(0, min(10, int(np.log2(max(1, n / leaf))), int(np.log2(max(1, len(sample) / 8)))))
    forest = grow(np.array(sample["vec"].tolist()), depth, trees, seed)
    shared = spark.sparkContext.broadcast(forest)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((trees, 2**depth), dtype=np.int64)
        for pdf in batches:
            x = np.array(pdf["vec"].tolist(), dtype=np.float64)
            for t in range(trees) if len(x) else ():
                held[t] += np.bincount(shared.value.leaves(x, t), minlength=2**depth)
        t, at = np.nonzero(held)
        yield pd.DataFrame({"tree": t.astype(np.int32), "leaf": at, "n": held[t, at]})

    counts = [np.zeros(2**depth, dtype=np.int64) for _ in range(trees)]
    for r in entries.select("vec").mapInPandas(counted, "tree int, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():  # trees * 2^depth rows at most
        counts[r["tree"]][r["leaf"]] = r["n"]
    used = trees
    if share is None:
        asked = by_hash(entries, n, tune, last=True).select("entry", "vec").toPandas()
        used, share = tuned(forest, counts, n, np.array(asked["vec"].tolist()), _true_neighbours(entries, asked, k), recall)
    cells, salts, size = [], [], max(1, LEAF_ROWS)
    for t in range(used):
        cells.append(np.zeros(2**depth, dtype=np.int64))
        at = size
        for i, c in enumerate(counts[t]):
            if at + c > size:
                salts.append(1)
                at = 0
            at += c
            cells[t][i] = len(salts) - 1
            salts[-1] = max(salts[-1], -(-int(c) // size))
    routes = spark.sparkContext.broadcast((counts, cells, np.array(salts)))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, cells, salts = routes.value
        for pdf in batches:
            x = np.array(pdf["vec"].tolist(), dtype=np.float64)
            for t in range(used) if len(x) else ():
                at = shared.value.leaves(x, t)
                cell = cells[t][at]
                yield pd.DataFrame({"cell": cell, "salt": pdf["entry"].to_numpy() % salts[cell], "leaf": at, "entry": pdf["entry"], "ids": pdf["ids"], "vec": [row.tobytes() for row in x]})

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["ids"].tolist()
        low = np.array([i[0] for i in ids], dtype=np.int64).tobytes()
        second = np.array([i[1] if len(i) > 1 else -(2**63) for i in ids], dtype=np.int64).tobytes()
        row = (pdf["cell"].iloc[0], pdf["leaf"].to_numpy(np.int64).tobytes(), pdf["entry"].to_numpy(np.int64).tobytes(), low, second, b"".join(pdf["vec"]))
        return pd.DataFrame([row], columns=["cell", "leaf", "entry", "low", "second", "vec"])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, cells, _ = routes.value
        for pdf in batches:
            rows = []
            for i, q in zip(pdf["id"], pdf["vec"], strict=True):
                own: dict[int, list[int]] = {}
                for t, x, _ in shared.value.search(np.asarray(q), counts, used, max(k + 1, n * share)):
                    own.setdefault(int(cells[t][x]), []).append(x)
                rows += [(c, i, np.asarray(q).tobytes(), np.array(x, dtype=np.int64).tobytes()) for c, x in own.items()]
            yield pd.DataFrame(rows, columns=["q_cell", "query_id", "q", "leaves"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The nearest entries of a cell for each query that searches some of its leaves."""
        for pdf in batches:
            for row in pdf.to_dict("records"):
                at, entry, low, second = (np.frombuffer(row[c], np.int64) for c in ("leaf", "entry", "low", "second"))
                x = np.frombuffer(row["vec"], np.float64).reshape(len(at), -1)
                squares, out = (x * x).sum(axis=1), []
                for base in range(0, len(row["asked"]), 200):
                    part = row["asked"][base : base + 200]
                    q = np.array([np.frombuffer(p["q"], np.float64) for p in part])
                    rough = squares - 2 * (q @ x.T) + (q * q).sum(axis=1)[:, None]
                    for p, own, d in zip(part, q, rough, strict=True):
                        seen = np.zeros(2**depth, dtype=bool)
                        seen[np.frombuffer(p["leaves"], np.int64)] = True
                        here, exact = _closest(x, low, second, p["query_id"], own, np.where(seen[at], d, np.inf), k)
                        out.append(pd.DataFrame({"query_id": p["query_id"], "entry": entry[here], "score": exact}))
                if out:
                    yield pd.concat(out)

    blocks = entries.mapInPandas(placed, "cell long, salt long, leaf long, entry long, ids array<long>, vec binary").groupBy("cell", "salt")
    blocks = written(blocks.applyInPandas(packed, "cell long, leaf binary, entry binary, low binary, second binary, vec binary"), "blocks")
    queries_ = written(v.filter("asks").select("id", "vec").distinct(), "queries")
    groups = max(1, -(-queries_.count() // QUERY_ROWS))
    parts = max(len(salts), 2)
    wanted = queries_.repartition(max(groups, spark.sparkContext.defaultParallelism), "id").mapInPandas(route, "q_cell long, query_id long, q binary, leaves binary").repartition(parts, "q_cell")
    wanted = wanted.groupBy("q_cell", F.pmod(F.xxhash64("query_id", "q"), F.lit(groups)).alias("part")).agg(F.collect_list(F.struct("query_id", "q", "leaves")).alias("asked"))
    # the planner takes what is asked for as large as the queries; it is queries times cells, and must not go through the driver
    met = blocks.repartition(parts, "cell").hint("merge").join(wanted, F.col("cell") == F.col("q_cell")).drop("cell", "q_cell", "part")
    found = met.mapInPandas(compare, "query_id long, entry long, score double").groupBy("query_id", "entry", "score").agg(F.lit(1).alias("one"))
    ids = entries.select(F.col("entry").alias("e"), "ids")
    each = found.join(ids, F.col("entry") == F.col("e")).select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id != query_id")
    best = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def _true_neighbours(entries: DataFrame, asked: pd.DataFrame, k: int) -> list[np.ndarray]:
    """The vectors of the ``k`` nearest other entries of each of these few entries, by one pass over all."""
    q, own = np.array(asked["vec"].tolist()), asked["entry"].to_numpy(np.int64)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list[tuple[float, np.ndarray]]] = [[] for _ in own]
        for pdf in batches:
            x, entry = np.array(pdf["vec"].tolist(), dtype=np.float64), pdf["entry"].to_numpy(np.int64)
            if len(x):
                d = (x * x).sum(axis=1) - 2 * (q @ x.T) + (q * q).sum(axis=1)[:, None]
                d[own[:, None] == entry] = np.inf
                for i, row in enumerate(d):
                    here = np.argpartition(row, k)[:k] if len(row) > k else np.arange(len(row))
                    best[i] = sorted([*best[i], *((row[j], x[j]) for j in here if np.isfinite(row[j]))], key=lambda p: p[0])[:k]
        yield pd.DataFrame([(i, d, x) for i, own_best in enumerate(best) for d, x in own_best], columns=["i", "d", "x"])

    rows = entries.select("entry", "vec").mapInPandas(scan, "i int, d double, x array<double>")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("d"))).filter(F.col("r") <= k).select("i", "x").collect()
    near: list[list] = [[] for _ in own]
    for r in rows:
        near[r["i"]].append(r["x"])
    return [np.array(x).reshape(len(x), -1) for x in near]
