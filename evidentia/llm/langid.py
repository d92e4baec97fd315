"""Language identification by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERS = (2, 3, 4)
#: Characters of a long text that are looked at together.
BLOCK = 200_000
UND = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashes of a text's character n-grams, repeats included, by block and order.

    Text is lower-cased; each run of anything but letters is one space, also before and after the text.
    Nothing is given for a text without letters.
    """
    c = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")
    letter = _letters()[c]
    if not letter.any():
        return
    c = np.concatenate([[32], np.where(letter, c, 32), [32]]).astype(np.uint64)
    c = c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))]
    with np.errstate(over="ignore"):
        for at in range(0, len(c), BLOCK):
            x = c[at : at + BLOCK + max(ORDERS) - 1]
            h = x[:BLOCK]
            for n in range(2, max(ORDERS) + 1):
                here = x[n - 1 : n - 1 + BLOCK]
                h = h[: len(here)] * np.uint64(0x100000001B3) + here
                if n in ORDERS and len(h):
                    g = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
                    yield g ^ (g >> np.uint64(32))


@dataclass
class Model:
    """Each table's ``slot`` has a bit for each of its languages; a gram is in a language if all its slots have the bit.

    Up to eight languages share one table of bytes; more take a table of 64-bit words for every 64 of them.
    """

    languages: list[str]
    tables: list[np.ndarray]
    probes: int
    false_rate: np.ndarray

    def masks(self, h: np.ndarray) -> list[np.ndarray]:
        size, step = np.uint64(len(self.tables[0]) - 1), (h >> np.uint64(32)) | np.uint64(1)
        with np.errstate(over="ignore"):
            at = [((h + np.uint64(i) * step) & size).astype(np.int64) for i in range(self.probes)]
        return [functools.reduce(np.bitwise_and, (table[x] for x in at)) for table in self.tables]

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """Grams of each language, corrected for false positives, and all grams."""
        hits, total = np.zeros(len(self.languages)), 0
        for h in grams(text):
            total += len(h)
            for first, m in enumerate(self.masks(h)):
                width = 8 * m.dtype.itemsize
                seen = np.bincount(m, minlength=256) if width == 8 else None
                for i in range(min(width, len(hits) - first * width)):
                    hits[first * width + i] += seen[(np.arange(256) >> i & 1) == 1].sum() if seen is not None else np.count_nonzero(m >> m.dtype.type(i) & m.dtype.type(1))
        return np.maximum(0, (hits - self.false_rate * total) / (1 - self.false_rate)), total

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, its share of the languages' counts, and its share of all grams; ties go to the first code."""
        if not self.languages or not text:
            return UND, 0.0, 0.0
        c, total = self.counts(text)
        if not total:
            return UND, 0.0, 0.0
        k = int(c.argmax())
        return self.languages[k], float(c[k] / c.sum()) if c.sum() > 0 else 0.0, float(c[k] / total)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by ``folds``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, per_language: int = 4_000, keep: int = 60_000, dominance: float = 0.5, least: int = 3, slots: int = 2**21, probes: int = 3, id_col: str = "doc_id") -> Model:
    """Filters from the texts of labelled rows outside the held-out fold.

    The sample is bounded: about ``per_language`` whole documents of each language, by hash. Every language
    that a label names is learned. A gram goes to every language where its frequency is at least
    ``dominance`` times its highest; each language keeps its ``keep`` most frequent ones. Only those rows,
    bounded by these parameters and the number of languages, come to the driver.
    """
    rows = docs.filter(~held_out(id_col) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.col(id_col).alias("id"), "text")
    sizes = [(r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    if not sizes:
        return Model([], [np.zeros(slots, dtype=np.uint8)], probes, np.zeros(0))
    share = F.create_map(*(x for lang, n in sizes for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(1_000_003)) / 1_000_003.0
    sample = rows.filter(part < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0))).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, own in pdf.groupby("lang"):
                found = [h for t in own["text"] for h in grams(t)]
                if found:
                    g, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": g.view(np.int64), "n": n})

    n = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    total = F.sum("n").over(Window.partitionBy("lang"))
    p = n.withColumn("p", F.col("n") / total)
    best = p.groupBy("gram").agg(F.collect_list(F.struct("lang", "p", "n")).alias("all"), F.max("p").alias("top"))
    chosen = best.select("gram", F.explode(F.filter("all", lambda x: x["p"] >= dominance * F.col("top"))).alias("x")).select("gram", "x.*")
    chosen = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= keep)
    languages = sorted(lang for lang, _ in sizes)
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    width = 8 * kind().itemsize
    tables = [np.zeros(slots, dtype=kind) for _ in range(0, len(languages), width)]
    got = chosen.select("lang", "gram").toPandas()
    size = np.uint64(slots - 1)
    with np.errstate(over="ignore"):
        for i, lang in enumerate(languages):
            h = got.loc[got["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64)
            for k in range(probes):
                at = ((h + np.uint64(k) * ((h >> np.uint64(32)) | np.uint64(1))) & size).astype(np.int64)
                np.bitwise_or.at(tables[i // width], at, kind(1 << i % width))
    fill = np.array([np.count_nonzero(tables[i // width] >> kind(i % width) & kind(1)) / slots for i in range(len(languages))])
    return Model(languages, tables, probes, fill**probes)


def _identified(docs: DataFrame, model: Model | None, id_col: str, options: dict) -> tuple[DataFrame, dict[str, str]]:
    """The columns of ``identify`` beside those of ``docs`` under names of their own, and what they were called."""
    model = model or fit(docs, id_col=id_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size, one for every 64 languages
    names = {f"in{i}_": c for i, c in enumerate(docs.columns)}

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("coverage", T.DoubleType())]))
    def run(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in text], columns=["lang_pred", "score", "coverage"])

    return docs.select(*(F.col(c).alias(i) for i, c in names.items()), held_out(id_col).alias("held_out"), run("text").alias("guess_")).select(*names, "held_out", "guess_.*"), names


ADDED = ("held_out", "lang_pred", "score", "coverage")


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with held_out, lang_pred, score and coverage (columns of ``docs`` of these names are left out).

    A prediction looks at all grams of the whole text, however long, and at nothing else. Null, empty and
    letterless texts are ``und`` with score 0; so is everything if no row has a label. Ties go to the first
    language code; rows repeated whole have equal results; an empty table gives an empty one.
    """
    out, names = _identified(docs, model, id_col, options)
    return out.select(*(F.col(i).alias(c) for i, c in names.items() if c not in ADDED), *ADDED)


def keep_known(docs: DataFrame, least_coverage: float = 0.02, model: Model | None = None, id_col: str = "doc_id", **options) -> DataFrame:
    """Documents of a known language, columns as they are: those not ``und`` and with at least ``least_coverage`` of their grams in it."""
    out, names = _identified(docs, model, id_col, options)
    return out.filter((F.col("lang_pred") != UND) & (F.col("coverage") >= least_coverage)).select(*(F.col(i).alias(c) for i, c in names.items()))
