"""SimHash fingerprints and a binary-trie self-join within a Hamming budget."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.graph import components
from evidentia.llm.store import marked, row_key, written

#: Shingles whose bits are counted at once.
BLOCK = 50_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The signed 64-bit SimHash of a text's word shingles, repeats included; zero if it has no words.

    A-Z are lower-cased; words are runs of anything but ASCII white space; a text of fewer words is one
    shingle. A bit is set if it is set in over half of the shingles' XXH64 (seed 42).
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    ends = ends[min(shingle, len(words)) - 1 :]
    hash64, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([hash64(joined[a:b], 42) for a, b in zip(starts[at : min(at + BLOCK, n)].tolist(), ends[at : at + BLOCK].tolist(), strict=False)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", keyed: bool = False) -> DataFrame:
    """``doc_id, fp`` of each row, and the ``key`` of its id and text, if asked for."""
    id_type = docs.schema[id_col].dataType

    @F.pandas_udf(T.LongType())
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in text], dtype="int64")

    return docs.select(F.col(id_col).cast(id_type).alias("doc_id"), fp("text").alias("fp"), *([row_key(id_col).alias("key")] if keyed else []))


def _prefix(key: str, depth: int, bits: int) -> Column:
    return F.shiftrightunsigned(F.col(key), bits - depth) if depth < bits else F.col(key)


def trie_walk(keyed: DataFrame, depths: list[int], bits: int, above: int, budget: int) -> DataFrame:
    """Pairs (tree, fa, fb) of different ``fp`` of one tree that differ in at most ``above`` bits of their key's first half and ``budget`` of all.

    ``keyed`` has tree, key (of ``bits`` bits) and fp (the same bits in an order that all of a tree share), each once. Each binary trie is joined with itself: pairs
    of nodes go down together, add up their differing bits and are pruned once these exceed what is allowed. ``depths`` are the levels that are
    looked at; down to the first one, in the first half, is one step that lists a node's neighbours by bit mask. Chains without branches are skipped: a node with one
    fingerprint below is compared whole, so most pairs end early. A node has at most 2^step children, whatever the skew.
    """

    def nodes(depth: int) -> DataFrame:
        if depth == bits:  # keys are distinct
            return keyed.select("tree", F.col("key").alias("node"), F.lit(1).cast("long").alias("n"), "fp")
        return keyed.groupBy("tree", _prefix("key", depth, bits).alias("node")).agg(F.count("*").alias("n"), F.min("fp").alias("fp"))

    top, half = depths[0], bits // 2
    masks = [sum(1 << i for i in places) for k in range(min(above, top) + 1) for places in itertools.combinations(range(top), k)]
    first = written(nodes(top), "nodes")
    near = first.select("tree", F.col("node").alias("a"), F.col("n").alias("na"), F.col("fp").alias("fa"), F.explode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("mask")).withColumn("b", F.col("a").bitwiseXOR(F.col("mask"))).filter("a <= b").withColumn("d", F.bit_count("mask"))
    front = near.join(first.select("tree", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("fp").alias("fb")), ["tree", "b"]).select("tree", "a", "b", "d", "na", "nb", "fa", "fb")
    done = []
    for depth, below in zip(depths, [*depths[1:], None], strict=True):
        alone = (F.col("na") == 1) & (F.col("nb") == 1)
        front = written(front.filter(~alone | ((F.col("a") != F.col("b")) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= budget))), "front")
        done.append(front.filter(alone & (F.col("a") != F.col("b"))).select("tree", "fa", "fb"))
        front = front.filter(~alone)
        if below is None or front.isEmpty():
            break
        kids = nodes(below).withColumn("up", F.shiftrightunsigned("node", below - depth))
        if below < bits:
            kids = written(kids, "nodes")
        kid = lambda s: kids.select("tree", F.col("up").alias(s), F.col("node").alias(f"{s}2"), F.col("n").alias(f"n{s}2"), F.col("fp").alias(f"f{s}2"))  # noqa: B023, E731
        down = front.select("tree", "a", "b", "d").join(kid("a"), ["tree", "a"]).join(kid("b"), ["tree", "b"])
        low_bits = F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")).bitwiseAND(F.lit((1 << (below - depth)) - 1)))
        down = down.withColumn("d2", F.col("d") + low_bits).filter((F.col("d2") <= (above if below <= half else budget)) & ((F.col("a") != F.col("b")) | (F.col("a2") <= F.col("b2"))))
        front = down.select("tree", F.col("a2").alias("a"), F.col("b2").alias("b"), F.col("d2").alias("d"), F.col("na2").alias("na"), F.col("nb2").alias("nb"), F.col("fa2").alias("fa"), F.col("fb2").alias("fb"))
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out.distinct()


def trie_links(prints: DataFrame, budget: int = 3) -> DataFrame:
    """Pairs (u, v), u < v, of distinct fingerprints (``fp``) that differ in at most ``budget`` bits.

    Two binary tries, one from each half of the bits, are joined with themselves by :func:`trie_walk`, which in a
    trie's first half allows ``budget // 2`` (pairs within the budget keep to that in one half at least). The
    first levels, as many as make about twice as many nodes as there are fingerprints, are one step, so that below it a pair of nodes has about one pair of children.
    """
    p = prints.select("fp").distinct()
    keyed = written(p.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("tree"), F.col("fp").alias("key")), F.struct(F.lit(1).alias("tree"), F.expr("shiftleft(fp, 32) | shiftrightunsigned(fp, 32)").alias("key")))).alias("x")).select("fp", "x.*"), "trie")
    top = min(30, max(8, (keyed.count() // 2).bit_length() + 1))
    out = trie_walk(keyed, [*range(top, 32, 4), 32, 40, 48, 56, 64], 64, budget // 2, budget)
    return out.select(F.least("fa", "fb").alias("u"), F.greatest("fa", "fb").alias("v")).distinct()


def rooted(prints: DataFrame, budget: int = 3) -> DataFrame:
    """fp, low (smallest doc_id) and root (smallest fingerprint that links reach) of each distinct fingerprint."""
    vertex = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(trie_links(vertex, budget))
    return vertex.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 3, id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest id that links reach).

    Documents of one fingerprint are one vertex, however many they are, so copies are never paired.
    Texts without words, null among them, share fingerprint zero and are linked like any other. A null id
    is no component's name unless all its ids are null. Rows repeated whole give equal rows.
    """
    prints = written(with_fingerprints(docs, shingle, id_col), "fingerprints")
    root = rooted(prints, budget)
    low = root.groupBy("root").agg(F.min("low").alias("component_id"))
    named = written(root.join(low, "root").select(F.col("fp").alias("v_fp"), "component_id"), "vertices")
    return prints.join(named, F.col("fp") == F.col("v_fp")).select("doc_id", "fp", "component_id")


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct XXH64 (seed 42, signed) of a text's word shingles, cut as in ``fingerprint``; none if it has no words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.int64)
    n, hash64 = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hash64(b" ".join(words[i : i + shingle]), 42) for i in range(n)), np.uint64, n)).view(np.int64)


def long_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """A SimHash of ``words`` times 64 bits over a set of hashes: each is mixed anew (splitmix64) for each word."""
    h, step = hashes.view(np.uint64), np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(h), 255):  # so many that their bits add up in one byte
        z = h[at : at + 255, None] + step
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        counts += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(h), bitorder="little").view("<i8")


def plan(n: int, similarity: float = 0.8, miss: float = 0.02) -> tuple[int, int]:
    """Bits of a part (an even number) and number of parts for ``n`` texts, where texts meet if they differ in one bit of a part at most.

    A part has so many bits that chance meetings in it grow with the texts and not with their square; there are as many parts as
    it takes for a pair of that similarity to meet in none with a probability of ``miss`` at most.
    """
    depth, p = max(12, (n.bit_length() + 8) // 2 * 2), _differ(similarity)
    return depth, max(1, math.ceil(math.log(miss) / math.log1p(-((1 - p) ** depth * (1 + depth * p / (1 - p))))))


def with_prints(docs: DataFrame, depth: int, parts: int, shingle: int = 5, id_col: str = "doc_id") -> DataFrame:
    """One row per distinct text: v (a number), first (the smallest row that has it) and x (its fingerprint, whole words of 64 bits)."""
    words = max(4, math.ceil(parts / (64 // depth)))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def bits(text: pd.Series) -> pd.Series:
        return pd.Series([long_fingerprint(shingle_hashes(t, shingle), words) for t in text])

    first = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("doc_id"), row_key(id_col).alias("key"))
    same = F.when(F.col("text").isNull(), F.lit(b"")).otherwise(F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    rows = docs.select(same.alias("same"), first.alias("first"), bits("text").alias("x")).groupBy("same").agg(F.min("first").alias("first"), F.first("x").alias("x"))
    return written(rows.select(F.monotonically_increasing_id().alias("v"), "first", "x"), "prints")


def _cut(x: str, depth: int, parts: int) -> Column:
    """A fingerprint's parts, each with its number above its bits."""
    each = 64 // depth
    return F.expr(f"transform(sequence(0L, {parts - 1}L), i -> shiftleft(i, {depth}) | (shiftrightunsigned({x}[int(i div {each})], int(i % {each}) * {depth}) & {(1 << depth) - 1}L))")


def _similar(pairs: DataFrame, docs: DataFrame, prints: DataFrame, words: int, shingle: int, similarity: float, id_col: str) -> DataFrame:
    """Those of the pairs (u, v) whose shingle sets have at least that Jaccard similarity; sets are compared in full.

    Before that, 256 bits and then all bits must differ in no more places than ``_most`` allows.
    """

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def hashed(text: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t, shingle) for t in text])

    ends = [prints.select(F.col("v").alias(s), *(F.col("x")[i].alias(f"{s}{i}") for i in range(4))) for s in "uv"]
    near = sum((F.bit_count(F.col(f"u{i}").bitwiseXOR(F.col(f"v{i}"))) for i in range(4)), F.lit(0)) <= _most(256, similarity)
    pairs = written(pairs.distinct().join(ends[0], "u").join(ends[1], "v").filter(near).select("u", "v"), "pairs")
    differ = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    whole = pairs.join(prints.select(F.col("v").alias("u"), F.col("x").alias("a")), "u").join(prints.select("v", F.col("x").alias("b")), "v")
    pairs = written(whole.filter(differ <= _most(64 * words, similarity)).select("u", "v"), "pairs")
    need = written(pairs.select(F.explode(F.array("u", "v")).alias("v")).distinct().join(prints, "v").select("v", F.col("first.key").alias("key_")), "need")
    texts = marked(docs.select(row_key(id_col).alias("key_"), "text"), "key_", need.select("key_")).filter("likely_").join(need, "key_")
    held = written(texts.select("v", hashed("text").alias("shingles")).dropDuplicates(["v"]), "shingles")
    both = pairs.join(held.select(F.col("v").alias("u"), F.col("shingles").alias("a")), "u").join(held.select("v", F.col("shingles").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return written(both.filter(shared >= similarity * (F.size("a") + F.size("b") - shared)).select("u", "v"), "links")


def _differ(similarity: float) -> float:
    """Share of the bits in which two sets of that Jaccard similarity and equal size differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def _most(bits: int, similarity: float) -> int:
    """Bits that differ at most, at five standard deviations over the mean, in two sets of that similarity and equal size."""
    p = _differ(similarity)
    return int(bits * p + 5 * (bits * p * (1 - p)) ** 0.5)


def _to_ends(members: DataFrame) -> DataFrame:
    """Pairs (u, v) of each text (node, v, root) with the smallest and the largest of its node, where they are of different groups."""
    end = F.struct("v", "root")
    x = members.join(members.groupBy("node").agg(F.min(end).alias("low"), F.max(end).alias("high")), "node")
    pair = lambda a, b: F.struct(a["v"].alias("u"), a["root"].alias("u_root"), b["v"].alias("v"), b["root"].alias("v_root"))
    return x.select(F.explode(F.array(pair(F.col("low"), end), pair(end, F.col("high")))).alias("x")).select("x.*").filter("u < v and u_root != v_root").select("u", "v")


def _meetings(prints: DataFrame, depth: int, parts: int) -> DataFrame:
    """Where texts meet: (v, node, side). A node is one part's value that several texts share, or (negative, with two sides) two values of a part that differ in one bit.

    Each part has two binary tries, one from each half of its bits, walked with a budget of no bit in the first half and one in all:
    a value has at most ``depth`` others at one bit, so meetings grow with the texts, however large a group of near copies is.
    """
    at = prints.select("v", F.explode(_cut("x", depth, parts)).alias("code"))
    values = written(at.groupBy("code").agg(F.count("*").alias("n")), "values")
    part, value, half = F.shiftright("code", depth), F.col("code").bitwiseAND(F.lit((1 << depth) - 1)), depth // 2
    turned = F.expr(f"shiftleft(fp & {(1 << half) - 1}L, {half}) | shiftrightunsigned(fp, {half})")
    both = values.select(part.alias("part"), value.alias("fp")).select("part", "fp", F.explode(F.array(F.struct(F.lit(0).alias("from"), F.col("fp").alias("key")), F.struct(F.lit(1).alias("from"), turned.alias("key")))).alias("x"))
    keyed = both.select((F.col("part") * 2 + F.col("x.from")).alias("tree"), "x.key", "fp")  # two rows from each of the written values
    pairs = trie_walk(keyed, [half, half + half // 2, depth], depth, 0, 1).select(F.shiftright("tree", 1).alias("part"), F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b")).distinct()
    code = lambda c: F.shiftleft("part", depth).bitwiseOR(F.col(c))
    pairs = written(pairs.select(code("a").alias("a"), code("b").alias("b"), (-1 - F.monotonically_increasing_id()).alias("node")), "pairs")
    sides = pairs.select("node", F.explode(F.array(F.struct(F.col("a").alias("code"), F.lit(0).alias("side")), F.struct(F.col("b").alias("code"), F.lit(1).alias("side")))).alias("x"))
    where = values.filter("n > 1").select("code", F.col("code").alias("node"), F.lit(0).alias("side")).union(sides.select("x.code", "node", "x.side"))
    return written(at.join(where, "code").select("v", "node", "side"), "meetings")


def similar_links(docs: DataFrame, prints: DataFrame, depth: int, parts: int, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """Links (u, v) between rows of ``with_prints``: all are of that Jaccard similarity, and their components are those of all such pairs that meet in a part.

    A long fingerprint is cut into parts of ``depth`` bits, each joined with itself through binary tries with a budget of
    one bit (:func:`_meetings`). First each text of a node is compared with the node's smallest and
    largest one, which joins large groups by few comparisons, in an eighth of the nodes at first, then in the others where the two
    are not yet of one group; then texts of one node are compared if they
    are still in different groups, where up to 1024 bits are held against each other before a pair becomes a row. Nodes that are one group are done, so copies are never paired with each other.
    """
    words = max(4, math.ceil(parts / (64 // depth)))
    at = _meetings(prints, depth, parts)
    early = F.pmod(F.xxhash64("node"), F.lit(8)) == 0
    ends = _to_ends(at.filter(early).withColumn("root", F.col("v")))
    links = _similar(ends, docs, prints, words, shingle, similarity, id_col)
    roots = components(links).select(F.col("node").alias("v"), "root")
    ends = _to_ends(at.filter(~early).join(roots, "v", "left").withColumn("root", F.coalesce("root", "v")))
    links = links.union(_similar(ends, docs, prints, words, shingle, similarity, id_col))
    roots = components(links).select(F.col("node").alias("v"), "root")
    many = at.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    group = many.groupBy("node", "root").agg(F.count("*").alias("m"))
    most = group.groupBy("node").agg(F.max(F.struct("m", "root")).alias("most"), F.count("*").alias("groups"), F.sum("m").alias("n")).filter("groups > 1 and n > 2").select("node", F.col("most.root").alias("main"))
    first = range(min(16, words))
    open_ = written(many.join(most, "node").join(prints.select("v", *(F.col("x")[i].alias(f"f{i}") for i in first)), "v"), "open")
    a = open_.filter("root != main").select("node", F.col("v").alias("u"), F.col("side").alias("su"), F.col("root").alias("ru"), *(F.col(f"f{i}").alias(f"g{i}") for i in first))
    differ = sum((F.bit_count(F.col(f"g{i}").bitwiseXOR(F.col(f"f{i}"))) for i in first), F.lit(0))
    apart = (F.col("ru") != F.col("root")) & ((F.col("root") == F.col("main")) | (F.col("u") < F.col("v"))) & ((F.col("node") >= 0) | (F.col("su") != F.col("side")))
    rest = a.join(open_, "node").filter(apart & (differ <= _most(64 * len(first), similarity))).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return links.union(_similar(rest, docs, prints, words, shingle, similarity, id_col))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """One document of each group of near copies: the one with its smallest id (null ids last, ties by a hash of the text).

    Near copies have word shingles of at least that Jaccard similarity; groups are what they link. Columns
    stay as they are, whatever they are called. Rows repeated whole are one; ids may repeat or be null without
    any loss, as rows are told apart by id and text. All documents without words, null and empty ones among
    them, are one group; texts may be of any length; an empty table gives an empty one. Texts are shuffled
    only for pairs that are compared and for rows repeated whole.
    """
    depth, parts = plan(docs.count(), similarity)
    prints = with_prints(docs, depth, parts, shingle, id_col)
    roots = components(similar_links(docs, prints, depth, parts, shingle, similarity, id_col))
    grouped = prints.select("v", "first").join(roots, F.col("v") == F.col("node"), "left")
    kept = written(grouped.groupBy(F.coalesce("root", "v").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.key").alias("k_")), "kept")
    names = {f"in{i}_": c for i, c in enumerate(docs.columns)}
    rows = docs.select(row_key(id_col).alias("key_"), *(F.col(c).alias(i) for i, c in names.items()))
    every = docs.select(row_key(id_col).alias("a_")).groupBy("a_").agg(F.count("*").alias("n"))
    other = written(every.join(kept, F.col("a_") == F.col("k_"), "left").filter("k_ is null or n > 1").select("a_", F.col("k_").isNull().alias("gone")), "other")
    rows = marked(rows, "key_", other.select("a_"))
    gone = other.filter("gone").select("a_")
    rest = rows.filter("likely_").join(gone, F.col("key_") == F.col("a_"), "left_anti").dropDuplicates(["key_"])
    out = rows.filter("not likely_").union(rest)
    return out.select(*(F.col(i).alias(c) for i, c in names.items()))
