"""Media columns: interleaved sequences of text and media references, whose payloads are found by digest."""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.store import row_key, written

WIDTH = 576
SIGN = b"\x89PNG\r\n\x1a\n"
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


def padded(data: bytes) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of the width."""
    return data + b"\xff" * (-len(data) % WIDTH if data else WIDTH)


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey PNG, 576 samples wide, of a payload of whole rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line starts with filter type 0
    lines[:, 1:] = rows
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return SIGN + part(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + part(b"IEND", b"")


def from_png(stored: bytes) -> bytes:
    """The samples of a PNG as ``to_png`` writes it."""
    at, data, width = len(SIGN), [], 0
    while at < len(stored):
        n, kind = struct.unpack_from(">I4s", stored, at)
        body = stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise ValueError("PNG chunk is damaged")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples and a 64-bit hash of how 8 x 8 block means compare with their median."""
    x = np.frombuffer(payload, np.uint8)
    n = np.bincount(x, minlength=256) / len(x)
    values = np.arange(256)
    mean = float((n * values).sum())
    rows = x.reshape(-1, WIDTH)
    cuts = [len(rows) * i // 8 for i in range(9)]
    blocks = np.array([rows[a : max(b, a + 1)].reshape(-1, 8, WIDTH // 8).mean(axis=(0, 2)) for a, b in zip(np.minimum(cuts[:-1], len(rows) - 1), cuts[1:], strict=True)])
    bits = np.packbits((blocks > np.median(blocks)).ravel()).tobytes().hex()
    p = n[n > 0]
    return f"{mean:.6f}:{float((n * (values - mean) ** 2).sum()) ** 0.5:.6f}:{float(-(p * np.log2(p)).sum()):.6f}:{bits}"


class _Reader(HTMLParser):
    """Text and images of a page in their order; a figure's caption goes to the images of that figure."""

    SKIPPED = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figures: list[dict] = []  # open figures: their own media and captions
        self.skip, self.verbatim = 0, False

    def flush(self) -> None:
        text = "".join(self.text)
        self.text = []
        if not self.verbatim:
            text = text.strip()
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def end_caption(self) -> None:
        if self.caption is not None:
            self.figures[-1]["captions"].append("".join(self.caption).strip())
            self.caption = None

    def end_figure(self) -> None:
        """The caption goes to the figure's media, wherever it stood; without media it is text."""
        self.end_caption()
        self.flush()
        figure = self.figures.pop()
        caption = " ".join(c for c in figure["captions"] if c)
        if figure["media"]:
            for x in figure["media"] if figure["captions"] else []:
                x["caption"] = caption
        elif caption:
            self.items.append({"kind": "text", "text": caption, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED:
            self.skip += 1
        elif tag in ("img", "audio", "video", "source"):
            a = dict(attrs)
            src = a.get("data-digest") or a.get("src") or ""
            self.flush()
            item = {"kind": "media", "text": None, "digest": src.removeprefix("sha256:") or None, "caption": a.get("alt")}
            self.items.append(item)
            if self.figures:
                self.figures[-1]["media"].append(item)
        elif tag == "figure":
            if self.figures:
                self.end_caption()
            self.flush()
            self.figures.append({"media": [], "captions": []})
        elif tag == "figcaption":
            self.flush()
            if self.figures:
                self.end_caption()
                self.caption = []
        elif tag == "pre":
            self.flush()
            self.verbatim = True

    def handle_endtag(self, tag):
        if tag in self.SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
        elif tag == "figure" and self.figures:
            self.end_figure()
        elif tag == "pre":
            self.flush()
            self.verbatim = False
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "tr"):
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            (self.text if self.caption is None else self.caption).append(data)

    def close(self):
        super().close()
        while self.figures:
            self.end_figure()
        self.flush()


def sequence(page: str | None) -> list[dict]:
    """A page as ordered structs of text and media references; null and broken pages give what can be read.

    Text is stripped but for ``pre``, whose text is kept as it stands. A caption outside a figure is text.
    """
    r = _Reader()
    r.feed(page or "")
    r.close()
    return [{"position": i, **x} for i, x in enumerate(r.items)]


def laid_out(text: str, digest: str, caption: str) -> str:
    """A page of the whole text, line by line, around one media reference; a single line is cut at a space behind its middle."""
    lines = text.splitlines(keepends=True)
    if len(lines) == 1 and (cut := text.find(" ", len(text) // 2)) > 0:
        lines = [text[:cut], text[cut:]]
    parts = [f"<pre>{html.escape(x)}</pre>" for x in lines]
    half = -(-len(parts) // 2)
    figure = f'<figure><figcaption>{html.escape(caption)}</figcaption><img src="sha256:{digest}" alt=""></figure>'
    return "".join(["<article>", *parts[:half], figure, *parts[half:], "</article>"])


def _parsed(page: pd.Series) -> pd.Series:
    return page.map(sequence)


def resolve(pages: DataFrame, media: DataFrame, page_col: str = "html") -> DataFrame:
    """One row per item of each page's sequence, media references with the columns of ``media`` for their digest.

    ``media`` has one row per digest; those of null digest are not found. References without a payload keep nulls
    there. Positions and captions stay with their items. Null and empty pages give no item, repeated rows each their
    own items, an empty table an empty one; columns beside ``page_col`` must not be called like an item's fields or
    like columns of ``media``. Items without a digest are dealt out by their content, so that they do not meet in one task.
    """
    parse = F.pandas_udf(_parsed, SEQUENCE)
    keep = [c for c in pages.columns if c != page_col]
    items = pages.select(*keep, F.explode(parse(page_col)).alias("i")).select(*keep, "i.*")
    items = items.withColumn("m_part", F.when(F.col("digest").isNull(), F.xxhash64("position", "text")).otherwise(F.lit(0)))
    payloads = media.withColumnRenamed("digest", "m_digest").withColumn("m_zero", F.lit(0).cast("long"))
    return items.join(payloads, (F.col("digest") == F.col("m_digest")) & (F.col("m_part") == F.col("m_zero")), "left").drop("m_digest", "m_part", "m_zero")


STORED = "media_key binary, n_bytes long, stored binary, digest string, position int, caption string, n_items int, text_crc32 long"


def store(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each text's payload as PNG, and the reference to it in the sequence that the document's page is parsed into.

    The page holds the whole text; ``text_crc32`` is of the sequence's text items put together again, ``digest``,
    ``position`` and ``caption`` are as parsed. Texts are read once, pages are not kept, and nothing is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                data = (text or "").encode()
                png = to_png(padded(data))
                items = sequence(laid_out(text or "", hashlib.sha256(png).hexdigest(), f"{len(data)} bytes"))
                whole = "".join(x["text"] for x in items if x["kind"] == "text")
                crc = zlib.crc32(whole.encode())
                rows.extend((key, len(data), png, x["digest"], x["position"], x["caption"], len(items), crc) for x in items if x["kind"] == "media")
            yield pd.DataFrame(rows, columns=["media_key", "n_bytes", "stored", "digest", "position", "caption", "n_items", "text_crc32"])

    return docs.select(row_key(id_col).alias("key"), "text").mapInPandas(run, STORED)


def read_back(stored: DataFrame) -> DataFrame:
    """From the stored bytes alone: their digest, payload and media sizes, the payload's hashes, and the feature."""
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for png in pdf["stored"]:
                x = from_png(png)
                rows.append((hashlib.sha256(png).hexdigest(), len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-32:]), len(png), feature(x)))
            yield pd.DataFrame(rows, columns=names)

    return stored.select("stored").mapInPandas(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string")


def document_media(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: its padded text stored as media, found through its page's reference, and read back.

    The media table is written where texts are read; only digests and figures are shuffled. Null text
    is empty, which is one row of 255s; very long texts are whole; equal texts have equal values, and equal rows
    equal results; an empty table gives an empty one; other columns are not looked at.
    """
    stored = written(store(docs, id_col), "media")
    figures = written(read_back(stored).dropDuplicates(["digest"]), "figures")
    references = stored.drop("stored").dropDuplicates(["media_key"])
    found = references.join(figures, "digest", "left")
    ids = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col).alias("media_key"))
    out = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.col("digest").alias("media_sha256"), "feature", "position", "caption", "n_items", "text_crc32"]
    return ids.join(found, "media_key").select(*out)
