"""Ranked retrieval over postings and vectors, and the fusion of rankings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import fold_tokens, key_prefix
from evidentia.operators.index import top_k
from evidentia.sources.scratch import cut, likely


def query_terms(questions: DataFrame, stop: tuple = (), **shape) -> DataFrame:
    """Questions with their distinct terms, the OR form (the raw text if there are none), and whether they are short (3 terms or fewer)."""
    t = fold_tokens(F.col("question"), stop=stop, **shape)
    q = questions.withColumn("terms", t)
    return q.withColumns({"or_query": F.when(F.size("terms") == 0, F.col("question")).otherwise(F.array_join("terms", " | ")), "is_short": F.size("terms") <= 3})


def matches(questions: DataFrame, postings: DataFrame, **shape) -> DataFrame:
    """(question_id, version, unit_key, slot, tf, positions) of the postings of each question's terms; joined on (version, term), so only these move."""
    q = questions.select("question_id", "version", fold_tokens(F.col("question"), **shape).alias("terms"))
    q = q.select("question_id", "version", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("slot", "term"))
    return q.join(postings, ["version", "term"])


#: Postings of a slab and questions of a block; a block of questions passes by a slab of units in one task.
SLAB_POSTINGS, QUESTION_BLOCK = 400_000, 4_096


def _number(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, its rows told apart by a number."""
    return cut(df.withColumn(name, F.monotonically_increasing_id()))


def best_units(terms: DataFrame, postings: DataFrame, k: int, weighted: bool, whole: bool = False) -> DataFrame:
    """Of each question the ``k`` best units of each slab (question_id, unit_key, matched, w, tf): matched terms, their weights, their occurrences.

    ``terms``: question_id, version, term and, if ``weighted``, weight and total. Best is by the rounded share of weight, matched terms and
    occurrences if ``weighted``, else by occurrences; ties by unit_key. With ``whole`` all units that match ``total`` terms come as well. Every posting of a term that is asked for moves once, to the
    slab of its unit, where all its questions meet it: what a question and a unit have in common is added up there and never a row,
    so that what is shuffled grows with the postings and not with questions times units.
    """
    ids = _number(terms.select(F.col("question_id").alias("id_")).distinct(), "q_")
    asked = _number(terms.select(F.col("version").alias("version"), "term").distinct(), "t_")
    w = (F.col(c).cast("double") if c in terms.columns else F.lit(0.0).alias(c) for c in ("weight", "total"))
    q = cut(terms.join(ids, F.col("question_id").eqNullSafe(F.col("id_"))).join(asked, ["version", "term"]).select("q_", "t_", *w))
    slabs, groups = -(-postings.count() // SLAB_POSTINGS) or 1, -(-ids.count() // QUESTION_BLOCK) or 1
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    p = postings.select("version", "term", "unit_key", "tf").join(asked, ["version", "term"])
    p = p.select(up_to(groups).alias("g"), F.pmod(F.xxhash64("unit_key"), F.lit(slabs)).cast("int").alias("s"), F.lit(1).alias("kind"), F.lit(-1).cast("long").alias("q"), F.col("t_").alias("t"), F.col("tf").cast("double").alias("a"), F.lit(0.0).alias("b"), "unit_key")
    q = q.select(F.pmod(F.xxhash64("q_"), F.lit(groups)).cast("int").alias("g"), up_to(slabs).alias("s"), F.lit(0).alias("kind"), F.col("q_").alias("q"), F.col("t_").alias("t"), F.col("weight").alias("a"), F.col("total").alias("b"), F.lit("").alias("unit_key"))
    both = q.unionByName(p).select((F.col("g") * F.lit(slabs).cast("long") + F.col("s")).alias("cell"), "kind", "q", "t", "a", "b", "unit_key")

    def score(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ask, has = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
        if not len(ask) or not len(has):
            return
        codes, names = pd.factorize(has["unit_key"].to_numpy(dtype=object), sort=False)
        order = sorted(range(len(names)), key=names.__getitem__)
        place = np.empty(len(names), dtype=np.int64)
        place[order] = np.arange(len(names))
        unit, names = place[codes], np.asarray(names, dtype=object)[order]
        term, inverse = np.unique(has["t"].to_numpy(), return_inverse=True)
        tf, n = has["a"].to_numpy(), len(names)
        ask = ask[ask["t"].isin(term)].sort_values("q", kind="stable")
        qs, first = np.unique(ask["q"].to_numpy(), return_index=True)
        step = max(1, 2_000_000 // n)
        for i in range(0, len(qs), step):
            block = ask.iloc[first[i] : first[i + step] if i + step < len(qs) else None]
            own = np.argsort(block["t"].to_numpy(), kind="stable")
            bt, bq = np.searchsorted(term, block["t"].to_numpy()[own]), np.searchsorted(qs[i : i + step], block["q"].to_numpy()[own])
            weight, m = block["a"].to_numpy()[own], len(qs[i : i + step])
            begin, end = np.searchsorted(bt, np.arange(len(term))), np.searchsorted(bt, np.arange(len(term)), side="right")
            matched, got, occ = np.zeros(m * n), np.zeros(m * n), np.zeros(m * n)
            for a in range(0, len(unit), 50_000):  # postings at a time, so that their hits stay few
                t = inverse[a : a + 50_000]
                many = (end - begin)[t]
                row = np.repeat(np.arange(len(t)), many)
                hit = np.repeat(begin[t] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(len(row))
                cell = bq[hit] * n + unit[a : a + 50_000][row]
                matched += np.bincount(cell, minlength=m * n)
                occ += np.bincount(cell, tf[a : a + 50_000][row], m * n)
                if weighted:
                    got += np.bincount(cell, weight[hit], m * n)
            total = np.zeros(m)
            total[bq] = block["b"].to_numpy()[own]
            for j in range(m):
                at = slice(j * n, j * n + n)
                u = np.flatnonzero(matched[at])
                every = u[matched[at][u] >= total[j]] if whole else u[:0]
                share = np.floor(got[at][u] / total[j] * 1e6 + 0.5) if weighted and total[j] else np.zeros(len(u))
                lead = share if weighted and total[j] else occ[at][u] if not weighted else matched[at][u]
                if len(u) > k:  # all that tie with the k-th in the first measure stay for the others
                    stay = lead >= np.partition(lead, -k)[-k]
                    u, share = u[stay], share[stay]
                keys = (u, -occ[at][u], -matched[at][u], -share) if weighted else (u, -occ[at][u])
                u = np.union1d(u[np.lexsort(keys)[:k]], every)
                yield pd.DataFrame({"q": qs[i + j], "unit_key": names[u], "matched": matched[at][u].astype(np.int64), "w": got[at][u], "tf": occ[at][u].astype(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for pdf in batches:
            for cell, part in pdf.groupby("cell", sort=False):
                if cell != at and held:
                    yield from score(pd.concat(held))
                    held = []
                at = cell
                held.append(part)
        if held:
            yield from score(pd.concat(held))

    found = both.repartition(min(20_000, max(slabs * groups, 8)), "cell").sortWithinPartitions("cell", "kind").mapInPandas(run, "q long, unit_key string, matched long, w double, tf long")
    return found.join(ids, F.col("q") == F.col("q_")).select(F.col("id_").alias("question_id"), "unit_key", "matched", "w", "tf")


def search_relaxed_or(questions: DataFrame, postings: DataFrame, limit: int = 10, **shape) -> DataFrame:
    """Any term matches; score is 0.1 per occurrence (each is a cover of its own)."""
    q = questions.select("question_id", "version", F.explode(fold_tokens(F.col("question"), **shape)).alias("term"))
    m = best_units(q, postings, limit, False).select("question_id", "unit_key", F.round(F.col("tf") * 0.1, 6).alias("score"))
    return top_k(m, "question_id", [F.desc("score"), "unit_key"], limit)


def search_strict(questions: DataFrame, postings: DataFrame, limit: int = 10, frequencies: DataFrame | None = None, **shape) -> DataFrame:
    """All terms match; each minimal cover adds 0.1 / (1 + positions in it that match nothing).

    With ``frequencies`` (version, term, df) only units that have a question's rarest term are looked at further, and only their
    postings are joined with questions; a question with a term that no unit has is over at once. The result is the same. Occurrences of a unit's matched terms are walked in order inside one row: the latest position of each
    term gives the cover that ends at an occurrence, which is minimal if its left end has moved on.
    """
    may = None
    if frequencies is not None:
        q = questions.select("question_id", "version", F.explode(fold_tokens(F.col("question"), **shape)).alias("term"))
        q = q.join(frequencies.select("version", "term", "df"), ["version", "term"], "left")
        rare = q.groupBy("question_id", "version").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.min(F.coalesce("df", F.lit(0))).alias("least")).filter("least > 0")
        may = cut(rare.join(postings.select("version", "term", "unit_key"), ["version", "term"]).select("question_id", "unit_key"))
        postings = likely(postings, "unit_key", may.select("unit_key"))
    m = matches(questions, postings, **shape)
    if may is not None:
        m = m.join(may, ["question_id", "unit_key"], "left_semi")
    g = m.groupBy("question_id", "unit_key").agg(F.first("n_terms").alias("n_terms"), F.count("*").alias("found"), F.array_sort(F.flatten(F.collect_list(F.transform("positions", lambda p: F.struct(p.alias("p"), F.col("slot").alias("s")))))).alias("hits")).filter("found = n_terms")
    none = F.struct(F.lit(-1).alias("p"), F.lit(-1).alias("n"))
    g = g.withColumn("blank", F.array_repeat(none, F.col("n_terms")))

    def step(acc, h):
        here = F.struct(h["p"].alias("p"), acc["n"].alias("n"))
        at = F.transform(acc["at"], lambda x, i: F.when(i == h["s"], here).otherwise(x))
        first = F.array_min(at)  # the latest place of each term: the leftmost opens the cover
        left = first["p"]
        whole = (left >= 0) & (left > acc["left"])
        noise = (h["p"] - left) - (acc["n"] - first["n"])
        score = acc["score"] + F.when(whole, F.lit(0.1) / (F.lit(1.0) + noise)).otherwise(F.lit(0.0))
        return F.struct(at.alias("at"), F.greatest(acc["left"], left).alias("left"), (acc["n"] + 1).alias("n"), score.alias("score"))

    start = F.struct(F.col("blank").alias("at"), F.lit(-1).alias("left"), F.lit(0).alias("n"), F.lit(0.0).alias("score"))
    g = g.withColumn("score", F.round(F.aggregate("hits", start, step, lambda a: a["score"]), 6))
    return top_k(g.select("question_id", "unit_key", "score"), "question_id", [F.desc("score"), "unit_key"], limit)


def search_weighted_coverage(questions: DataFrame, postings: DataFrame, weights: DataFrame, sizes: DataFrame, limit: int = 10, **shape) -> DataFrame:
    """Units with any term, by idf-weighted coverage, plain coverage, density and key.

    Terms that no unit has count in both denominators with df 0; a zero denominator makes the weighted
    value null for the whole question. Only (question, term) rows and the postings of their terms are shuffled (:func:`best_units`).
    """
    q = questions.select("question_id", "version", F.explode(fold_tokens(F.col("question"), **shape)).alias("term"))
    q = q.join(sizes.select("version", "n_units"), "version", "left").join(weights.select("version", "term", "weight"), ["version", "term"], "left")
    q = q.withColumn("weight", F.coalesce("weight", F.log(F.coalesce("n_units", F.lit(0)) + 1.0)))
    totals = q.groupBy("question_id").agg(F.count("*").alias("n_terms"), F.sum("weight").alias("total"))
    q = cut(q.join(totals, "question_id"))
    m = best_units(q, postings, limit, True).join(q.select("question_id", "n_terms", "total").distinct(), "question_id")
    m = m.select("question_id", "unit_key", F.round(F.when(F.col("total") != 0, F.col("w") / F.col("total")), 6).alias("weighted_coverage"), F.round(F.col("matched") / F.col("n_terms"), 6).alias("coverage"), F.round(F.col("tf") * 0.1, 6).alias("score"))
    return top_k(m, "question_id", [F.desc("weighted_coverage"), F.desc("coverage"), F.desc("score"), "unit_key"], limit)


def lexical_search(questions: DataFrame, postings: DataFrame, limit: int = 200, stop: tuple = (), **shape) -> DataFrame:
    """OR score plus 20 times the phrase score (0.1 per place where all terms stand in a row).

    A phrase only stands in a unit that has all terms: those are scored by their positions. Of the others the best by
    occurrences are enough, as a phrase only adds to a score.
    """
    q = cut(questions.select("question_id", "version", F.explode(fold_tokens(F.col("question"), stop=stop, **shape)).alias("term")))
    n = cut(q.groupBy("question_id").agg(F.count("*").alias("n")))
    plain = cut(best_units(q.join(n, "question_id").withColumnRenamed("n", "total"), postings, limit, False, whole=True).join(n, "question_id"))
    full = plain.filter("n > 1 and matched >= n").select("question_id", "unit_key")
    plain = plain.select("question_id", "unit_key", F.round(F.col("tf") * 0.1 + 2.0 * F.when(F.col("n") > 1, 0).otherwise(F.col("tf")), 6).alias("score"))
    t = questions.select("question_id", "version", fold_tokens(F.col("question"), stop=stop, **shape).alias("terms"))
    t = t.select("question_id", "version", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("slot", "term"))
    held = likely(postings.select("version", "term", "unit_key", "tf", "positions"), "unit_key", full.select("unit_key"))
    m = full.join(t, "question_id").join(held, ["version", "term", "unit_key"])
    one = m.groupBy("question_id", "unit_key").agg(F.sum("tf").alias("tf"), F.flatten(F.collect_list(F.transform("positions", lambda p: p - F.col("slot")))).alias("bases"), F.first("n_terms").alias("n"))
    run = lambda a, b: F.when(b == a["at"], a["run"] + 1).otherwise(F.lit(1))
    step = lambda a, b: F.struct(b.alias("at"), run(a, b).alias("run"), (a["hits"] + (run(a, b) == F.col("n")).cast("int")).alias("hits"))
    start = F.struct(F.lit(-(2**31)).alias("at"), F.lit(0).alias("run"), F.lit(0).alias("hits"))
    phrases = F.aggregate(F.array_sort("bases"), start, step, lambda a: a["hits"])
    s = one.select("question_id", "unit_key", F.round(F.col("tf") * 0.1 + 2.0 * F.when(F.col("n") > 1, phrases).otherwise(F.col("tf")), 6).alias("score"))
    s = plain.unionByName(s).groupBy("question_id", "unit_key").agg(F.max("score").alias("score"))
    return top_k(s, "question_id", [F.desc("score"), "unit_key"], limit)


#: Rows and queries of a block; a block of rows passes by a block of queries in one task.
ROW_BLOCK, QUERY_BLOCK, MOST_SLABS = 8_192, 16_384, 4_096


def unit_vectors(df: DataFrame, key: str) -> DataFrame:
    """(id, dim, vector) of the rows whose vector can be compared: not null, all components finite, not zero; scaled to length one."""
    v = F.col("vector")
    ok = v.isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    d = df.select(F.col(key).cast("long").alias("id"), F.transform("vector", lambda x: x.cast("double")).alias("vector")).filter(ok)
    d = d.withColumn("norm", norm).filter((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    return d.select("id", F.size("vector").alias("dim"), F.transform("vector", lambda x: x / F.col("norm")).alias("vector"))


def _best_of_cells(both: DataFrame, k: int, parts: int) -> DataFrame:
    """Of rows (cell, kind, id, vector), kind 0 queries before kind 1 rows: each query's ``k`` best rows in its cell, which stream past it."""

    def best(scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if scores.shape[1] > k:  # all that tie with the k-th stay for the order by id
            least = np.partition(scores, -k, axis=1)[:, -k, None]
            q, r = np.nonzero(scores >= least)
        else:
            q, r = np.nonzero(np.ones_like(scores, dtype=bool))
        s, i = scores[q, r], ids[q, r]
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top_s, top_i = np.full((len(scores), k), -np.inf), np.full((len(scores), k), np.iinfo(np.int64).max)
        first = place < k
        top_s[q[first], place[first]], top_i[q[first], place[first]] = s[first], i[first]
        return top_s, top_i

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, asked, found = None, [], [], None

        def answers() -> Iterator[pd.DataFrame]:
            if found is not None:
                q, c = np.nonzero(found[0] > -np.inf)
                yield pd.DataFrame({"question_id": np.concatenate(ids)[q], "id": found[1][q, c], "score": found[0][q, c]})

        for pdf in batches:
            for (cell, kind), part in pdf.groupby(["cell", "kind"], sort=False):
                if cell != at:
                    yield from answers()
                    at, ids, asked, found = cell, [], [], None
                x = np.array(part["vector"].tolist(), dtype=np.float64)
                if kind == 0:
                    ids.append(part["id"].to_numpy())
                    asked.append(x)
                elif asked:
                    q = np.concatenate(asked)
                    if found is None:
                        found = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
                    for s in range(0, len(q), 1_000):
                        cut = slice(s, s + 1_000)
                        scores = np.round(q[cut] @ x.T, 6)
                        own = np.broadcast_to(part["id"].to_numpy(), scores.shape)
                        found[0][cut], found[1][cut] = best(np.concatenate([found[0][cut], scores], axis=1), np.concatenate([found[1][cut], own], axis=1))
        yield from answers()

    return both.repartition(parts, "cell").sortWithinPartitions("cell", "kind").mapInPandas(run, "question_id long, id long, score double")


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """Exact cosine nearest rows: blocks of queries meet slabs of vectors, each task keeps the best ``k`` of each of its queries.

    ``queries``: question_id, vector; ``vectors``: id, vector, ids as longs. The query set is stated by the caller. Neither
    side goes through the driver or is held whole: a block of queries stays in a task while a slab of vectors passes by, and
    only the best of each are shuffled again. Vectors that are null, zero or hold nulls, NaN or infinities take no
    part, vectors of other lengths do not meet; without queries or vectors the result is empty.
    """
    q, v = unit_vectors(queries, "question_id"), unit_vectors(vectors, "id")
    n_q, n_v = queries.count(), vectors.count()
    groups, slabs = -(-n_q // QUERY_BLOCK) or 1, min(MOST_SLABS, -(-n_v // ROW_BLOCK) or 1)
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select("*", F.pmod(F.xxhash64("id"), F.lit(groups)).alias("g"), up_to(slabs).alias("s"), F.lit(0).alias("kind"))
    v = v.select("*", up_to(groups).alias("g"), F.pmod(F.xxhash64("id"), F.lit(slabs)).alias("s"), F.lit(1).alias("kind"))
    both = q.unionByName(v).select(((F.col("dim") * groups + F.col("g")) * slabs + F.col("s")).alias("cell"), "kind", "id", "vector")
    return top_k(_best_of_cells(both, k, min(20_000, 2 * groups * slabs)), "question_id", [F.desc("score"), "id"], k)


def plane_codes(df: DataFrame, tables: int, planes: int, probes: int, seed: int) -> DataFrame:
    """(id, dim, vector, cell) of unit vectors: in each table the side of ``planes`` random hyperplanes, and as many cells as ``probes`` asks for, nearest first.

    Further cells flip the plane that the vector is closest to, then the second closest, then both, and so on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        normals: dict[int, np.ndarray] = {}
        for pdf in batches:
            for dim, part in pdf.groupby("dim", sort=False):
                if dim not in normals:
                    normals[dim] = np.random.default_rng(seed).normal(size=(tables, planes, dim))
                x = np.array(part["vector"].tolist(), dtype=np.float64)
                for t in range(tables):
                    side = x @ normals[dim][t].T
                    bits, near = (side > 0).astype(np.int64), np.argsort(np.abs(side), axis=1)
                    code = bits @ (1 << np.arange(planes))
                    for p in range(probes):
                        flips = sum((np.int64(1) << near[:, j] for j in range(planes) if p >> j & 1), np.zeros(len(x), np.int64))
                        yield pd.DataFrame({"id": part["id"].to_numpy(), "dim": dim, "vector": part["vector"].to_numpy(), "cell": ((np.int64(dim) * tables + t) << planes) + (code ^ flips)})

    return df.mapInPandas(run, "id long, dim int, vector array<double>, cell long")


def vector_search_near(queries: DataFrame, vectors: DataFrame, k: int = 10, tables: int = 12, planes: int | None = None, probes: int = 4, salt_rows: int = 50_000, seed: int = 5) -> DataFrame:
    """Approximate form of :func:`vector_search`: candidates share a cell of random hyperplanes in one of ``tables``, and are compared exactly.

    The number of ``planes`` follows the table (some hundred rows a cell), so that a query meets a share of the rows that
    shrinks as they grow. A cell with over ``salt_rows`` rows, say of copies, is dealt out over several tasks,
    each with the cell's queries. Recall depends on how the vectors lie: structureless ones need more tables or probes; it
    is to be measured against the exact form.
    """
    q, v = unit_vectors(queries, "question_id"), unit_vectors(vectors, "id")
    n = vectors.count()
    planes = planes or max(1, min(40, (n // 256).bit_length()))
    coded = plane_codes(v, tables, planes, 1, seed)
    asked = plane_codes(q, tables, planes, min(probes, 1 << planes), seed)
    sizes = coded.groupBy("cell").agg(F.ceil(F.count("*") / salt_rows).cast("int").alias("salts")).filter("salts > 1")
    salted = lambda d, salt: d.join(sizes, "cell", "left").withColumn("salt", salt).select(F.xxhash64("cell", "salt").alias("cell"), "id", "vector")
    asked = salted(asked, F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).withColumn("kind", F.lit(0))
    coded = salted(coded, F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int")).withColumn("kind", F.lit(1))
    met = _best_of_cells(asked.unionByName(coded), k, max(16, min(20_000, n * tables // 50_000)))
    return top_k(met.distinct(), "question_id", [F.desc("score"), "id"], k)


def reciprocal_rank_fusion(channels: list[DataFrame], k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) over channels (question_id, id, rank); one shuffle for any number of channels."""
    every = None
    for i, c in enumerate(channels):
        c = c.select("question_id", "id", *(F.when(F.lit(i == j), F.col("rank")).cast("int").alias(f"rank_{j}") for j in range(len(channels))))
        every = c if every is None else every.unionByName(c)
    g = every.groupBy("question_id", "id").agg(*(F.min(f"rank_{j}").alias(f"rank_{j}") for j in range(len(channels))))
    score = sum((F.coalesce(1.0 / (F.col(f"rank_{j}") + k), F.lit(0.0)) for j in range(len(channels))), F.lit(0.0))
    g = g.withColumn("rrf_score", F.round(score, 9))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("rrf_score"), "id")))


def short_query_boost(fused: DataFrame, lexical: str = "rank_0", vector: str = "rank_1") -> DataFrame:
    """For short queries: +0.05 (21 - r) / 20 for lexical rank r up to 20, -0.01 for rows only vectors found."""
    r = F.col(lexical)
    add = F.when(r <= 20, (21 - r) * 0.05 / 20).when(r.isNull() & F.col(vector).isNotNull(), -0.01).otherwise(0.0)
    return fused.withColumn("boosted", F.round(F.col("rrf_score") + F.when(F.col("is_short"), add).otherwise(0.0), 9))


def attach_parent_text(cands: DataFrame, elements: DataFrame) -> DataFrame:
    parent = elements.select(F.col("key").alias("p_key"), F.col("text").alias("parent_text"))
    return cands.join(elements.select(F.col("key").alias("id"), "parent_key"), "id", "left").join(parent, F.col("parent_key") == F.col("p_key"), "left").drop("p_key")


#: Types of elements that are read together with their parent.
DEEP = ("ALINEA", "ITEM")


def parent_union_boost(cands: DataFrame, deep: tuple = DEEP) -> DataFrame:
    """+0.04 where parent and child together have every question token and the child alone hasn't (deep types)."""
    q, own = fold_tokens(F.col("question"), plural=False), fold_tokens(F.col("text"), plural=False)
    both = F.array_union(own, fold_tokens(F.col("parent_text"), plural=False))
    hit = F.col("element_type").isin(*deep) & (F.size(q) > 0) & (F.size(F.array_except(q, both)) == 0) & (F.size(F.array_except(q, own)) > 0)
    return cands.withColumn("contextual_score", F.round(F.col("rrf_score") + F.when(hit, 0.04).otherwise(0.0), 9))


def promote_caput(cands: DataFrame, limit: int) -> DataFrame:
    """The opening text of a top candidate's article rises to 0.999 of that score if a rank of its own is 30 or better."""
    order = [F.desc("score"), "id"]
    ranked = cands.withColumn("row", F.row_number().over(Window.partitionBy("question_id").orderBy(*order)))
    seeds = ranked.filter(F.col("row") <= limit).select("question_id", key_prefix(F.col("path")).alias("c_path"), "score").filter("c_path is not null").groupBy("question_id", "c_path").agg(F.max("score").alias("seed")).withColumnRenamed("question_id", "c_q")
    j = ranked.join(seeds, (F.col("question_id") == F.col("c_q")) & (F.col("path") == F.col("c_path")), "left")
    near = F.least("rank_0", "rank_1") <= 30
    j = j.withColumn("score", F.when(F.col("seed").isNotNull() & near, F.greatest("score", F.round(F.col("seed") * 0.999, 9))).otherwise(F.col("score")))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).drop("c_q", "c_path", "seed", "row")


def hybrid_search(questions: DataFrame, question_vectors: DataFrame, postings: DataFrame, vectors: DataFrame, elements: DataFrame, limit: int = 10, depth: int = 200) -> DataFrame:
    """Lexical and vector channels of ``depth`` each, fused, boosted for short questions, by parent text and for openings of articles; best ``limit`` (at least ten for short questions).

    ``questions``: question_id (long), version, question; ``question_vectors``: question_id, vector; ``vectors``: id (long),
    vector; ``elements``: key (long), parent_key, text, element_type, path. Units of ``postings`` are ids as text.
    """
    lex = lexical_search(questions, postings, depth).select("question_id", F.col("unit_key").cast("long").alias("id"), "rank")
    vec = vector_search(question_vectors, vectors, depth).select("question_id", "id", "rank")
    asked = query_terms(questions).select("question_id", "question", "is_short")
    x = cut(short_query_boost(reciprocal_rank_fusion([lex, vec]).drop("rank").join(asked, "question_id")).drop("question"))
    # whole texts move only for candidates, their number is that of the questions; of a candidate's text, the question's tokens that it lacks go on
    own = likely(elements.select(F.col("key").alias("id"), "parent_key", "text", "element_type", "path"), "id", x.select("id"))
    x = x.join(asked.select("question_id", "question"), "question_id").join(own, "id", "left")
    lacks = F.array_except(fold_tokens(F.col("question"), plural=False), fold_tokens(F.col("text"), plural=False))
    x = cut(x.withColumn("lacks", F.when(F.col("element_type").isin(*DEEP), lacks)).drop("question", "text"))
    open_ = x.filter(F.size("lacks") > 0).select("question_id", "id", F.col("parent_key").alias("p_key"), "lacks")
    parents = likely(elements.select(F.col("key").alias("p_key"), F.col("text").alias("parent_text")), "p_key", open_.select("p_key"))
    hit = open_.join(parents, "p_key").filter(F.size(F.array_except("lacks", fold_tokens(F.col("parent_text"), plural=False))) == 0)
    x = x.join(hit.select("question_id", "id", F.lit(0.04).alias("add")).distinct(), ["question_id", "id"], "left")
    x = cut(x.withColumn("contextual_score", F.round(F.col("boosted") + F.coalesce("add", F.lit(0.0)), 9)).drop("lacks", "parent_key", "add").withColumn("score", F.col("contextual_score")))
    most = F.when(F.col("is_short"), max(10, limit)).otherwise(limit)
    return promote_caput(x, limit).filter(F.col("rank") <= most).select("question_id", "id", "rank_0", "rank_1", "boosted", "contextual_score", "score", "rank")


def expand_children(found: DataFrame, tree: DataFrame, most: int = 8, factor: float = 0.85, k: int = 10) -> DataFrame:
    """Children of found parents, unless a parent has more than ``most``; an only grandchild (an article's sole opening) stands for its child."""
    kids = tree.select(F.col("parent").alias("id"), "child", "child_order", F.count("*").over(Window.partitionBy("parent")).alias("n")).filter(F.col("n") <= most)
    sole = tree.groupBy(F.col("parent").alias("s_parent")).agg(F.count("*").alias("s_n"), F.min("child").alias("s_child")).filter("s_n = 1")
    e = found.join(kids, "id").join(sole, F.col("child") == F.col("s_parent"), "left")
    e = e.select("question_id", F.col("id").alias("parent"), F.coalesce("s_child", "child").alias("id"), F.round(F.col("score") * factor, 9).alias("score"), F.col("rank").alias("parent_rank"), "child_order")
    return top_k(e, "question_id", ["parent_rank", "child_order", "id"], k)


def structural_reserve(primary: DataFrame, promos: DataFrame, k: int) -> DataFrame:
    """The primary list as it is, then up to ``k`` promoted items that aren't in it, by score and id."""
    new = promos.join(primary.select("question_id", "id"), ["question_id", "id"], "left_anti")
    new = top_k(new.select("question_id", "id", "score"), "question_id", [F.desc("score"), "id"], k, "place")
    n = primary.groupBy("question_id").agg(F.max("rank").alias("last"))
    new = new.join(n, "question_id", "left").select("question_id", "id", "score", (F.coalesce("last", F.lit(0)) + F.col("place")).cast("int").alias("rank"), F.lit(True).alias("reserved"))
    return primary.select("question_id", "id", "score", "rank", F.lit(False).alias("reserved")).unionByName(new)


def search_context(wanted: DataFrame, versions: DataFrame, acts: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Provenance of each wanted version, and the versions that are missing."""
    full = versions.join(acts, "act").join(snapshots, "snapshot_id")
    return wanted.join(full, "version"), wanted.join(versions, "version", "left_anti")


def corpus_keys(provisions: DataFrame) -> DataFrame:
    return provisions.select("version", "stable_key").distinct()


def rank_of(cands: DataFrame, targets: DataFrame, channels: list[str]) -> DataFrame:
    """Rank of each target in each channel, null where it's absent; channels are named, so pivoting needs no extra pass."""
    c = cands.groupBy("question_id", "id").agg(*(F.min(F.when(F.col("channel") == x, F.col("rank"))).alias(f"{x}_rank") for x in channels))
    return targets.join(c, ["question_id", "id"], "left")
