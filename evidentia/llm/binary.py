"""Shards of raw token ids with a minimal perfect hash index for keyed access."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.store import shared_dir, written
from evidentia.llm.token_ids import encoder

#: Ids of a shard, about; a shard is one row of binary columns, so a task holds a few MB of it.
SHARD_IDS = 1_000_000
#: Bits that share one stored count of the set bits before them.
RANK_BITS = 512
#: Shards up to this number are named in the scan's filter when keys are looked up; more are joined.
FEW_SHARDS = 1_000
SHARD = "part int, shard int, low bigint, high bigint, n_docs int, n_ids bigint, payload binary, keys binary, starts binary, level_ends binary, bits binary, ranks binary, marks binary, slots binary"
NULL_KEY = -(2**63)


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) of x for a seed."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return x ^ (x >> np.uint64(31))


def build_index(keys: np.ndarray, gamma: float = 2.0) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """A minimal perfect hash of distinct 64-bit keys: ``bits`` of all levels, ``level_ends`` and ``ranks``, and each key's slot.

    At each level the keys that are alone at their hashed bit set it; the rest go to the next level.
    A key's slot is the number of set bits before its own, for which ``ranks`` holds a count every
    ``RANK_BITS`` bits. Levels begin at such a boundary.
    """
    levels, rest = [], np.arange(len(keys))
    while len(rest):
        n = -(-max(8, int(len(rest) * gamma) + 1) // RANK_BITS) * RANK_BITS
        h = (mix64(keys[rest], len(levels)) % np.uint64(n)).astype(np.int64)
        alone = np.bincount(h, minlength=n)[h] == 1
        bits = np.zeros(n, dtype=bool)
        bits[h[alone]] = True
        levels.append(bits)
        rest = rest[~alone]
    every = np.concatenate([np.zeros(0, dtype=bool), *levels])
    counts = every.reshape(-1, RANK_BITS).sum(axis=1)
    index = {
        "level_ends": np.cumsum([len(b) for b in levels], dtype="<i8"),
        "bits": np.packbits(every, bitorder="little").view("<u8"),
        "ranks": (np.cumsum(counts) - counts).astype("<u4"),
    }
    return index, find_slots(index, keys)


def find_slots(index: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slots of keys, -1 where no level has a set bit for them. A key costs the same whatever the index holds: a few levels on average, and one block of bits."""
    slot, rest, low = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), 0
    words = index["bits"]
    for i, end in enumerate(index["level_ends"].tolist()):
        if not len(rest):
            break
        p = low + (mix64(keys[rest], i) % np.uint64(end - low)).astype(np.int64)
        low = end
        hit = (words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
        q = p[hit]
        block = words.reshape(-1, RANK_BITS // 64)[q // RANK_BITS]
        inner = q // 64 % (RANK_BITS // 64)
        before = np.bitwise_count(block) * (np.arange(RANK_BITS // 64) < inner[:, None])
        own = words[q >> 6] & ((np.uint64(1) << (q & 63).astype(np.uint64)) - np.uint64(1))
        slot[rest[hit]] = index["ranks"][q // RANK_BITS] + before.sum(axis=1, dtype=np.int64) + np.bitwise_count(own)
        rest = rest[~hit]
    return slot


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys, 1_000) >> np.uint64(32)).astype("<u4")


def write_ids(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, id_col: str = "doc_id", shard_ids: int = SHARD_IDS, width: int = 2) -> None:
    """Shards of ids in ascending key order: payloads of ``width`` bytes an id, and their index.

    Documents are dealt out by ranges of key, start of text and row number, so that rows which repeat a key
    spread over tasks, sorted, and encoded where they are written: only text is shuffled. Null keys come
    first, under the smallest long; null text is empty; rows that repeat a key follow each other, by the
    start of their text. A text may be of any length; it makes a shard of its own size. An empty table
    gives no shard; other columns are not looked at. An id that ``width`` bytes can't hold is an error.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, no, part, keys, ids, ends, size = encoder(tokenizer, True), 0, 0, [], [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            x, e = run(batch.column("text"))
            x, e = np.insert(x, e, end_id), e + np.arange(1, len(e) + 1)
            k, at, low = batch.column("k").to_numpy(), 0, 0
            while at < len(k):
                cut = min(len(k), int(np.searchsorted(e, low + shard_ids - size)) + 1)
                keys.append(k[at:cut])
                ids.append(x[low : e[cut - 1]])
                ends.append(e[at:cut] - low + size)
                size += len(ids[-1])
                at, low = cut, e[cut - 1]
                if size >= shard_ids:
                    yield shard(part, no, keys, ids, ends)
                    no, keys, ids, ends, size = no + 1, [], [], [], 0
        if keys:
            yield shard(part, no, keys, ids, ends)

    def shard(part: int, no: int, keys: list, ids: list, ends: list) -> pa.RecordBatch:
        key, x, end = (np.concatenate(c) for c in (keys, ids, ends))
        if x.max() >= 1 << 8 * width:
            raise ValueError(f"ids of up to {x.max()} do not fit {width} bytes")
        only, first = np.unique(key, return_index=True)
        index, slot = build_index(only.astype(np.uint64))
        order = np.empty(len(only), dtype="<u4")
        order[slot] = first
        row = (part, no, key[0], key[-1], len(key), len(x), x.astype(f"<u{width}"), key.astype("<i8"), np.append(0, end).astype("<u4"), index["level_ends"], index["bits"], index["ranks"], fingerprints(only.astype(np.uint64)[np.argsort(slot)]), order)
        names = [c.split()[0] for c in SHARD.split(", ")]
        kinds = [{"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in SHARD.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes() if isinstance(v, np.ndarray) else int(v)], t) for v, t in zip(row, kinds, strict=True)], names=names)

    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY)).alias("k"), "text")
    d = d.repartitionByRange("k", F.substring("text", 1, 64), F.monotonically_increasing_id()).sortWithinPartitions("k", "text")
    d.select("k", "text", F.spark_partition_id().alias("part")).mapInArrow(encode, SHARD).write.parquet(path)


def opened(row) -> dict:
    """A shard's arrays, without copying any. ``slots`` leads from a slot to the document's place in the shard."""
    kinds = {"keys": "<i8", "starts": "<u4", "level_ends": "<i8", "bits": "<u8", "ranks": "<u4", "marks": "<u4", "slots": "<u4", "payload": f"<u{len(row['payload']) // max(1, row['n_ids'])}"}
    return {k: np.frombuffer(row[k], dtype=t) for k, t in kinds.items()}


def places(shard: dict, keys: np.ndarray) -> np.ndarray:
    """Places of keys in an opened shard by hash, -1 where the stored fingerprint tells that a key is not in it."""
    slot = find_slots(shard, keys.astype(np.uint64))
    ok = slot >= 0
    ok[ok] = shard["marks"][slot[ok]] == fingerprints(keys[ok].astype(np.uint64))
    return np.where(ok, shard["slots"][np.maximum(slot, 0)].astype(np.int64), -1)


def shard_starts(spark, path: str) -> DataFrame:
    """part, shard and the ids before it: sums by part first, so no task sees more than the shards of a part or one row per part."""
    shards = spark.read.parquet(path).select("part", "shard", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("part_start"))
    return shards.withColumn("in_part", before(Window.partitionBy("part").orderBy("shard"))).join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("in_part")).alias("shard_start"))


def read_ids(spark, path: str) -> DataFrame:
    """Each document of the files: doc_id, start, n_tokens, ids_crc32, found through the index.

    A shard's keys are looked up by hash; rows that repeat a key are read after the first, in their order.
    Files without a shard give no row; a very long document is one shard, which one task reads.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                s = opened(row)
                n = np.arange(len(s["keys"]))
                again = n - np.maximum.accumulate(np.where(np.append(True, s["keys"][1:] != s["keys"][:-1]), n, 0))
                at = places(s, s["keys"]) + again
                ids, start, end = memoryview(s["payload"].astype("<u4")), s["starts"][at].astype(np.int64), s["starts"][at + 1].astype(np.int64)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                yield pd.DataFrame({"part": row["part"], "shard": row["shard"], "key": s["keys"], "at": start, "n_tokens": end - start, "ids_crc32": crc})

    rows = spark.read.parquet(path).mapInPandas(read, "part int, shard int, key long, at long, n_tokens long, ids_crc32 long")
    starts = shard_starts(spark, path)
    return rows.join(starts, ["part", "shard"]).select(F.when(F.col("key") != NULL_KEY, F.col("key")).alias("doc_id"), (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark, path: str, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """Ids of the given keys: key and ``ids`` (null where no shard has it; the first in file order where a key repeats).

    A key's part is found among the parts' ranges (one row per writing task), its shard among the ranges of
    the part's shards, and its place in the shard by hash. Only shards that a key leads to are joined to the
    payloads; if they are few, the scan is told their names, so that it reads no other payload. Null is a
    key like any other; repeated keys are one; an empty table of keys gives an empty one.
    """
    shards = spark.read.parquet(path)
    spans = shards.select("part", "shard", "low", "high")
    parts = sorted((r["high"], r["part"]) for r in spans.groupBy("part").agg(F.max("high").alias("high")).collect())
    highs, numbers = np.array([x for x, _ in parts], dtype=np.int64), np.array([n for _, n in parts], dtype=np.int64)

    @F.pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        i = np.searchsorted(highs, key.to_numpy(np.int64))  # the first part that does not end before the key
        return pd.Series(np.append(numbers, -1)[i], dtype="int32")

    k = written(keys.select(F.coalesce(F.col(key_col).cast("long"), F.lit(NULL_KEY)).alias("key")).distinct(), "keys")
    ranges = spans.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("shard", "low", "high"))).alias("ranges"))
    first = F.try_element_at(F.filter("ranges", lambda r: (r["low"] <= F.col("key")) & (F.col("key") <= r["high"])), F.lit(1))
    wanted = k.withColumn("part", part_of("key")).join(ranges, "part").withColumn("shard", first["shard"]).filter("shard is not null")
    wanted = written(wanted.groupBy("part", "shard").agg(F.collect_list("key").alias("wanted")), "wanted")
    named = wanted.select("part", "shard").limit(FEW_SHARDS + 1).collect()
    if len(named) <= FEW_SHARDS:
        shards = shards.filter(F.col("part").isin(sorted({r["part"] for r in named})) & F.col("shard").isin(sorted({r["shard"] for r in named})))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                s, want = opened(row), np.array(row["wanted"], dtype=np.int64)
                found = [(int(key), s["payload"][s["starts"][i] : s["starts"][i + 1]].tolist()) for key, i in zip(want, places(s, want), strict=True) if i >= 0]
                yield pd.DataFrame(found, columns=["key", "ids"])

    got = shards.join(wanted, ["part", "shard"]).mapInPandas(find, "key long, ids array<int>")
    return k.join(got.withColumnRenamed("key", "got_key"), F.col("key") == F.col("got_key"), "left").select(F.when(F.col("key") != NULL_KEY, F.col("key")).alias(key_col), "ids")


def token_table(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes the files (to the shared folder, if no path is given) and reads them back.

    Nulls, empty and very long texts, ties and repeated rows are as in ``write_ids``; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    if path is None:
        path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, path, **options)
    return read_ids(spark, path)
