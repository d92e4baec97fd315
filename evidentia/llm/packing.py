"""Best-two-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.store import written
from evidentia.llm.token_ids import encoder

#: Pieces that one task numbers at most, about, and the least number of salted groups that the pieces of a length are dealt into.
GROUP_ROWS, LEAST_SALTS = 500_000, 64


def pieces(docs: DataFrame, limit: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and the ids as bytes, if asked for).

    A document's ids end with ``end_id``; only those longer than ``limit`` are cut, however long the text.
    Null text is empty; ids may be null or repeat; an empty table gives an empty one; other columns are not looked at.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if keep_ids:
        schema = schema.add("ids", T.BinaryType())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, False)
        for batch in batches:
            ids, end = encode(batch.column("text"))
            ids, end = np.insert(ids, end, end_id), end + np.arange(1, len(end) + 1)
            size = np.diff(end, prepend=0)
            n = -(-size // limit)
            own = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * limit
            length = np.minimum(limit, size[own] - start)
            at, data = (end - size)[own] + start, memoryview(ids)
            cols = [batch.column("k").take(pa.array(own)), piece.astype(np.int32), start, length, [zlib.crc32(data[a : a + m]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]]
            if keep_ids:
                cols.append([bytes(data[a : a + m]) for a, m in zip(at.tolist(), length.tolist(), strict=True)])
            kinds = [batch.column("k").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names=schema.names)

    return docs.select(F.col(id_col).alias("k"), "text").mapInArrow(cut, schema)


def best_two_fit(counts: np.ndarray, limit: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins for ``counts[length]`` pieces of each length: (lengths with their number in a bin, bins alike).

    A bin is filled greedily, largest fitting piece first. Then its smallest piece goes back if two
    unpacked pieces fill the widened gap more tightly. As long as counts allow, the next bins come out the
    same, so they are made at once; the work depends on the number of lengths, not of pieces.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    bins = []
    lengths = np.arange(limit + 1)
    while left.any():
        free = left.copy()
        fits = np.maximum.accumulate(np.where(free > 0, lengths, 0))  # largest free length up to x
        gap, own = limit, {}

        def take(x: int, n: int) -> None:
            own[x] = own.get(x, 0) + n
            free[x] -= n
            if free[x] == 0:
                top = x
                while top <= limit and fits[top] == x:
                    top += 1
                fits[x:top] = fits[x - 1]

        while (x := int(fits[gap])) > 0:
            n = min(int(free[x]), gap // x)
            take(x, n)
            gap -= n * x
        small = min(own)
        if gap > 0 and (len(own) > 1 or own[small] > 1):
            wide = gap + small
            first = np.flatnonzero(free[: wide + 1] > 0)
            first = first[first * 2 <= wide]  # the smaller of the two
            if len(first):
                second = fits[wide - first]
                second = np.where((second == first) & (free[first] < 2), fits[np.maximum(first - 1, 0)], second)
                both = np.where(second > 0, first + second, 0)
                k = int(both.argmax())
                if both[k] > small:
                    own[small] -= 1
                    own = {x: n for x, n in own.items() if n}
                    for x in (int(first[k]), int(second[k])):
                        own[x] = own.get(x, 0) + 1
        times = min(int(left[x]) // n for x, n in own.items())
        for x, n in own.items():
            left[x] -= n * times
        bins.append((sorted(own.items(), reverse=True), times))
    return bins


def plan_slots(bins: list, limit: int) -> dict[str, np.ndarray]:
    """Where the pieces of a length go, by their rank: rows sorted by length * 2^40 + first rank."""
    rows, seq, used = [], 0, np.zeros(limit + 1, dtype=np.int64)
    for own, times in bins:
        at = 0
        for x, n in own:
            rows.append(((x << 40) + used[x], seq, n, at))
            used[x] += n * times
            at += n * x
        seq += times
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 4).T
    return dict(zip(("key", "seq", "n", "at"), cols, strict=True))


def pack(parts: DataFrame, limit: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to pieces of 1 to ``limit`` tokens.

    Only the histogram of lengths, at most ``limit`` rows whatever the input, comes to the driver, where
    best-two-fit plans the bins. Pieces then get a rank among those of their length (salted groups, whose
    sizes are summed up first) and find their place in the plan by rank. An empty table gives an empty one.
    """
    schema = parts.schema
    counts = np.zeros(limit + 1, dtype=np.int64)
    for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r["length"]] = r["n"]
    salts = max(LEAST_SALTS, -(-int(counts.max()) // GROUP_ROWS))
    parts = parts.withColumn("salt_", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)))
    parts = written(parts, "salted")  # so that a row's group, which its number decides, is found once for all
    sizes = written(parts.groupBy("length", "salt_").agg(F.count("*").alias("n")), "lengths")
    slots = plan_slots(best_two_fit(counts, limit), limit)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt_").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "salt_", F.coalesce(before, F.lit(0)).alias("before_"))
    within = Window.partitionBy("length", "salt_").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = parts.withColumn("rank_", F.row_number().over(within) - 1).join(sizes, ["length", "salt_"])

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        x, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        key = (x << 40) + r
        i = np.searchsorted(slots["key"], key, side="right") - 1
        k = key - slots["key"][i]
        return pd.DataFrame({"sequence_id": slots["seq"][i] + k // slots["n"][i], "offset": slots["at"][i] + k % slots["n"][i] * x})

    placed = ranked.withColumn("p_", place("length", F.col("before_") + F.col("rank_")))
    return placed.select(*schema.names, "p_.sequence_id", "p_.offset")


def pack_documents(docs: DataFrame, limit: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, id_col: str = "doc_id") -> DataFrame:
    """Pieces of all documents with their places; ids are found once, and a narrow table of pieces is kept."""
    return pack(written(pieces(docs, limit, tokenizer, end_id, id_col), "pieces"), limit)
