"""Repeated byte strings by interval expansion on a Burrows-Wheeler transform, and their removal."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.store import written

#: Bytes of an anchor at first, start positions looked at together, bytes of contexts in a bucket, and contexts of
#: one anchor beyond which its strings are dealt out anew by wider anchors.
ANCHOR, SEGMENT, BUCKET_BYTES, MOST_CONTEXTS = 64, 1 << 20, 1_000_000, 512
#: Rows that a task hands over at once.
ROWS = 20_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)


#: Bits of a position where position and sort key share one number; longer arrays are sorted by index.
_PLACE = 21


def ordered(key: np.ndarray, bits: int) -> np.ndarray:
    """Positions in the order of keys of so many bits, ties by position. Numbers that carry their position sort many times faster than an index."""
    if len(key) <= 1 << _PLACE and bits <= 63 - _PLACE:
        return np.sort(key << _PLACE | np.arange(len(key))) & ((1 << _PLACE) - 1)
    return np.argsort(key, kind="stable")


def suffix_order(x: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``x`` in the order of their suffixes' first ``depth`` symbols (at least), by doubling."""
    n, known = len(x), 4
    wide = np.concatenate([x.astype(np.int64) + 1, np.zeros(known, dtype=np.int64)])
    key, bits = np.zeros(n, dtype=np.int64), 9 * known
    for i in range(known):  # nine bits hold a symbol: four symbols at once to begin with
        key = key * 512 + wide[i : i + n]
    while True:
        order = ordered(key, bits)
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if known >= depth or new[-1] == n - 1:
            return order
        ahead = np.zeros(n, dtype=np.int64)
        if known < n:
            ahead[: n - known] = rank[known:] + 1
        half = int(new[-1] + 1).bit_length()
        key, bits = rank << half | ahead, 2 * half
        known *= 2


def repeated_starts(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part, the starts of its ``length``-byte strings that start anywhere else in the parts.

    Backward extension goes breadth first over intervals of the transform: the intervals of strings of
    ``k`` symbols give those of ``k + 1``, and the right end of one that is met for the first time has a
    common prefix of ``k`` with its neighbour. So common prefixes come out by increasing value, and the
    search stops at ``length``: ends not met by then share at least ``length`` symbols. An interval
    whose end is known goes no further, so all levels together do no more than the text's length. Parts are
    set apart by a symbol that no string is extended over.
    """
    x = np.concatenate([np.concatenate([[0], np.frombuffer(p, np.uint8).astype(np.int64) + 1]) for p in parts] + [[0]])
    n = len(x)
    order = suffix_order(x, length + 1)
    before = x[order - 1]  # the transform; position 0 wraps to the last separator
    to = np.empty(n, dtype=np.int64)
    to[np.argsort(before.astype(np.uint16), kind="stable")] = np.arange(n)  # from a row to that of its suffix with the symbol before
    prefix = np.full(n + 1, -1, dtype=np.int64)
    prefix[0] = prefix[n] = 0
    low, high = np.array([0]), np.array([n])
    for level in range(length):
        size = high - low
        row = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        own = np.repeat(np.arange(len(low)), size)
        c = before[row]
        if level:  # only the string of no symbols is extended by a separator
            row, own, c = row[c > 0], own[c > 0], c[c > 0]
        if not len(row):
            break
        key = own << 9 | c
        by = ordered(key, 9 + len(low).bit_length())
        new = np.append(True, key[by][1:] != key[by][:-1])
        first, last = by[new], by[np.append(new[1:], True)]
        low, high = to[row[first]], to[row[last]] + 1
        fresh = prefix[high] < 0
        low, high = low[fresh], high[fresh]
        prefix[high] = level
    far = prefix < 0
    hit = np.zeros(n, dtype=bool)
    hit[order[far[:n] | far[1:]]] = True
    out, at = [], 1
    for p in parts:
        own = np.flatnonzero(hit[at : at + max(0, len(p) - length + 1)])
        out.append(own)
        at += len(p) + 1
    return out


def anchored(data: bytes, length: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of starts whose ``length``-byte strings have the same anchor: first start, last start, anchor position.

    A string's anchor is the place in it whose ``width`` bytes have the smallest hash, the first if tied,
    so equal strings have equal anchors wherever they stand.
    """
    w = length - width + 1
    for base in range(0, max(0, len(data) - length + 1), SEGMENT):
        x = _BYTES[np.frombuffer(data, np.uint8, count=min(SEGMENT + length - 1, len(data) - base), offset=base)]
        n = len(x)
        with np.errstate(over="ignore"):
            powers = np.full(n, _BASE, dtype=np.uint64)
            powers[0] = 1
            np.multiply.accumulate(powers, out=powers)
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(x * powers, dtype=np.uint64)])
            powers[:] = _INVERSE
            powers[0] = 1
            np.multiply.accumulate(powers, out=powers)
            h = (sums[width:] - sums[:-width]) * powers[: n - width + 1]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        key = (h & ~np.uint64(0x1FFFFF)) | np.arange(len(h), dtype=np.uint64)
        grid = np.full(-(-len(key) // w) * w, ~np.uint64(0))
        grid[: len(key)] = key
        ahead = np.minimum.accumulate(grid.reshape(-1, w), axis=1).ravel()
        behind = np.minimum.accumulate(grid.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = len(key) - w + 1
        at = (np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts]) & np.uint64(0x1FFFFF)).astype(np.int64)
        cut = np.flatnonzero(at[1:] != at[:-1]) + 1
        first = np.concatenate([[0], cut])
        yield first + base, np.append(cut - 1, starts - 1) + base, at[first] + base


def _key(data: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


def runs(starts: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.append(cut, len(starts) - 1)].tolist(), strict=True)) if len(starts) else []


def widths(length: int) -> list[int]:
    """Widths of anchors, each halfway from the last to whole strings, and at last those."""
    out = [min(ANCHOR, length)]
    while length - out[-1] > 50:
        out.append((out[-1] + length) // 2)
    return [w for w in out if w < length] + [length]


def repeats(units: DataFrame, length: int, steps: list[int]) -> DataFrame:
    """key, th, from, to: runs of starts whose strings start anywhere else too, for units of key, th, n (copies) and data.

    Anchors of the first width in ``steps`` met once are dropped after a count that is summed map-side. Of
    the rest, strings of a context (all bytes of the strings with one anchor) met twice are repeated, however many
    copies there are. Where one anchor has several contexts, each distinct context is read once, and buckets
    of whole anchors are searched by interval expansion. Contexts of an anchor with over ``MOST_CONTEXTS``
    of them become units of their own, dealt out by the next width; at last an anchor is a whole string.
    """
    width, *wider = steps

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, out = ["key", "th", "n", "anchor", "ctx", "lo", "hi"], []
        for pdf in batches:
            for key, th, n, data in zip(pdf["key"], pdf["th"], pdf["n"], pdf["data"], strict=True):
                for lo, hi, at in anchored(data, length, width):
                    out += [(key, th, n, _key(data[p : p + width]), _key(data[a : b + length]), a, b) for a, b, p in zip(lo.tolist(), hi.tolist(), at.tolist(), strict=True)]
                if len(out) > ROWS:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    every = written(units.mapInPandas(places, "key string, th long, n long, anchor long, ctx long, lo long, hi long"), "all-places")
    often = written(every.groupBy("anchor").agg(F.sum("n").alias("c")).filter("c > 1").select(F.col("anchor").alias("a")), "anchors")
    rows = written(every.join(often, F.col("anchor") == F.col("a"), "left_semi"), "places")
    ctxs = written(rows.groupBy("anchor", "ctx").agg(F.sum("n").alias("n"), F.min(F.struct("key", "th", "lo", "hi")).alias("rep")), "contexts")
    whole = ctxs.filter("n > 1").select("anchor", "ctx", F.lit(None).cast("array<struct<from:bigint,to:bigint>>").alias("part"))
    if wider:
        part = _searched(units, ctxs, length, wider).groupBy("anchor", "ctx").agg(F.collect_list(F.struct("from", "to")).alias("part"))
        whole = whole.union(part.select("anchor", "ctx", "part"))
    hits = whole.withColumnsRenamed({"anchor": "h_anchor", "ctx": "h_ctx"})
    covered = rows.join(hits, (F.col("anchor") == F.col("h_anchor")) & (F.col("ctx") == F.col("h_ctx")))
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("from"), (F.col("hi") - F.col("lo")).alias("to")))
    return covered.select("key", "th", "lo", F.explode(F.coalesce("part", all_of)).alias("s")).select("key", "th", (F.col("lo") + F.col("s.from")).alias("from"), (F.col("lo") + F.col("s.to")).alias("to"))


def _searched(units: DataFrame, ctxs: DataFrame, length: int, wider: list[int]) -> DataFrame:
    """anchor, ctx, from, to: repeated starts inside contexts that occur once, of anchors with several contexts."""
    count = ctxs.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1").withColumnRenamed("anchor", "a")
    count = written(count, "mixed")
    hot = count.filter(F.col("m") > MOST_CONTEXTS)
    on = F.col("anchor") == F.col("a")
    large = ctxs.join(hot, on).select("anchor", "ctx", "n", F.lit(True).alias("hot"), "rep.*")  # few anchors: their contexts are not brought together
    rest = ctxs.join(hot, on, "left_anti").join(count.filter(F.col("m") <= MOST_CONTEXTS), on).select("anchor", "ctx", "n", F.lit(False).alias("hot"), "rep.*")
    reads = large.union(rest).groupBy("key", "th").agg(F.collect_list(F.struct("anchor", "ctx", "n", "hot", "lo", "hi")).alias("reads"))
    reads = reads.withColumnsRenamed({"key": "r_key", "th": "r_th"})

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for data, own in zip(pdf["data"], pdf["reads"], strict=True):
                out += [(r["anchor"], r["ctx"], r["n"], r["hot"], data[r["lo"] : r["hi"] + length]) for r in own]
                if len(out) > ROWS:
                    yield pd.DataFrame(out, columns=["anchor", "ctx", "n", "hot", "data"])
                    out = []
            yield pd.DataFrame(out, columns=["anchor", "ctx", "n", "hot", "data"])

    texts = units.join(reads, F.col("key").eqNullSafe(F.col("r_key")) & (F.col("th") == F.col("r_th"))).select("data", "reads")
    texts = written(texts.mapInPandas(contexts, "anchor long, ctx long, n long, hot boolean, data binary").dropDuplicates(["anchor", "ctx"]), "context-bytes")
    n_buckets = max(1, -(-(texts.filter("not hot").agg(F.sum(F.octet_length("data"))).first()[0] or 0) // BUCKET_BYTES))

    def expand(pdf: pd.DataFrame) -> pd.DataFrame:
        found = repeated_starts(pdf["data"].tolist(), length)
        return pd.DataFrame([(a, c, a0, b0) for a, c, n, s in zip(pdf["anchor"], pdf["ctx"], pdf["n"], found, strict=True) if n == 1 for a0, b0 in runs(s)], columns=["anchor", "ctx", "from", "to"])

    bucket = F.pmod(F.xxhash64("anchor"), F.lit(n_buckets))
    found = texts.filter("not hot").withColumn("bucket", bucket).groupBy("bucket").applyInPandas(expand, "anchor long, ctx long, from long, to long")
    if hot.isEmpty():
        return found
    more = repeats(texts.filter("hot").select(F.col("anchor").cast("string").alias("key"), F.col("ctx").alias("th"), "n", "data"), length, wider)
    more = more.select(F.col("key").cast("long").alias("anchor"), F.col("th").alias("ctx"), "from", "to")
    return found.union(more.join(texts.filter("hot and n = 1").select(F.col("anchor").alias("a"), F.col("ctx").alias("c")), (F.col("anchor") == F.col("a")) & (F.col("ctx") == F.col("c")), "left_semi"))


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the bytes left, if asked for) of each row.

    Every byte goes that is covered by a ``length``-byte string which also starts anywhere else, in the same
    text or another; strings are judged on the input. Null text is empty. Rows repeated whole are each
    other's copies; ids may be null or repeat. An empty table gives an empty one; texts may be of any length;
    other columns are not looked at.

    A corpus has no single transform: strings are first dealt out by anchor, so that equal ones meet, and
    buckets of about ``BUCKET_BYTES`` are then searched (see ``repeats``).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("data"))
    id_type = d.schema["doc_id"].dataType.simpleString()
    keyed = d.select(F.col("doc_id").cast("string").alias("key"), "th", F.lit(1).cast("long").alias("n"), "data")
    covered = repeats(keyed, length, widths(length))
    gone = covered.groupBy("key", "th").agg(F.array_sort(F.collect_set(F.struct("from", (F.col("to") + length).alias("to")))).alias("gone")).withColumnsRenamed({"key": "x_key", "th": "x_th"})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, data, gone in zip(pdf["key"], pdf["data"], pdf["gone"], strict=True):
                kept, at, spans, end = [], 0, 0, -1
                for r in gone if gone is not None else ():
                    if r["from"] > end:
                        spans += 1
                        kept.append(data[at : r["from"]])
                    end = max(end, r["to"])
                    at = end
                kept = b"".join([*kept, data[at:]])
                out.append((key, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()) + ((kept,) if keep_text else ()))
            yield pd.DataFrame(out, columns=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
    out = keyed.join(gone, F.col("key").eqNullSafe(F.col("x_key")) & (F.col("th") == F.col("x_th")), "left").select("key", "data", "gone")
    out = out.mapInPandas(cut, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))
