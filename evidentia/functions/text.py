"""Column functions: hashing, text projections, token sets, labels and request predicates."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accented letters and what they fold to, and the word endings that matter.
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñ"
FOLDED = "aaaaaeeeeiiiiooooouuuucn"


def content_hash(c: Column) -> Column:
    """SHA-256 of UTF-8 text; null hashes as empty."""
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def normalize_presentation(c: Column) -> Column:
    """White space collapsed, none before ``, . ; :``, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"\s+([,.;:])", "$1"))


def normalize_matching(c: Column) -> Column:
    """For comparison: no-break spaces are spaces, white space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.translate(c, " ", " "), r"\s+", " ")))


def normalize_text(c: Column) -> Column:
    """NFC, one kind of line end, no-break spaces as spaces, runs of blanks collapsed.

    Text that is ASCII already skips the Arrow function that composes characters.
    """
    def nfc(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFC")

    composed = F.when(F.octet_length(c) == F.length(c), c).otherwise(F.pandas_udf(nfc, "string")(c))
    return F.trim(F.regexp_replace(F.translate(F.regexp_replace(composed, "\r\n?", "\n"), " ", " "), "[ \\t]+", " "))


def fold(c: Column) -> Column:
    return F.translate(F.lower(c), ACCENTED, FOLDED)


def fold_terms(c: Column, min_len: int = 3, stop: Sequence[str] = (), plural: bool = True, stem: int = 6) -> Column:
    """All terms in order, repeats kept: letters only, stop words out, accents folded, final s of words over 4 cut, prefix stem.

    Done on the whole text, without a function per word: folding maps letters to letters, so words stay
    apart, and one pattern takes each word's stem (what stands before a final s, if that is within the
    stem, else its first letters) and runs over the rest.
    """
    low = F.lower(F.coalesce(c, F.lit("")))
    if stop:
        low = F.regexp_replace(low, rf"(?<!\p{{L}})(?:{'|'.join(sorted(stop))})(?!\p{{L}})", " ")
    most = stem or ""
    cut = rf"\p{{L}}{{4,{stem - 1 if stem else ''}}}(?=s(?!\p{{L}}))|" if plural else ""
    return F.regexp_extract_all(F.translate(low, ACCENTED, FOLDED), F.lit(rf"({cut}\p{{L}}{{{min_len},{most}}})\p{{L}}*"), F.lit(1))


def fold_tokens(c: Column, min_len: int = 3, stop: Sequence[str] = (), plural: bool = True, stem: int = 6) -> Column:
    """The set of :func:`fold_terms`, in order of first occurrence."""
    return F.array_distinct(fold_terms(c, min_len, stop, plural, stem))


def canonical_hash(**fields: Column) -> Column:
    """SHA-256 of compact JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))), 256)


def cut_after_html_close(c: Column) -> tuple[Column, Column]:
    """Text through the first ``</html>``, and whether there is one."""
    at = F.locate("</html>", F.lower(c))
    return F.when(at > 0, F.substring(c, F.lit(1), at + 6)).otherwise(c), at > 0


def key_token(label: Column) -> Column:
    """A number label as a key: upper case, ordinal signs and outer punctuation gone, blanks as dashes."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(label)), "[ºª°.]", ""), r"\s+", "-")


def key_prefix(path: Column, kind: str = "ARTICLE") -> Column:
    """A path through its first step of ``kind``, with the opening text's key appended; null without one."""
    found = F.regexp_extract(path, rf"^(.*?/{kind}:[^/]+)", 1)
    return F.when(found != "", F.concat(found, F.lit("/@caput")))


def citation_label(act: Column, kind: Column, number: Column, key: Column) -> Column:
    return F.concat_ws(", ", act, F.concat_ws(" ", F.lower(kind), F.coalesce(number, key)))


def check_integrity(df: DataFrame, raw: str = "raw_bytes") -> DataFrame:
    """Adds sha_ok and length_ok: recomputed hash and length equal the stored ones; null bytes fail."""
    return df.withColumns({"sha_ok": F.coalesce(F.sha2(raw, 256) == F.col("sha256"), F.lit(False)), "length_ok": F.coalesce(F.octet_length(raw) == F.col("byte_length"), F.lit(False))})


def decode_strict(raw: Column, charset: str = "utf-8") -> Column:
    """``struct(text, error)``: malformed input is an error row and is never replaced."""
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for b in s:
            try:
                out.append((None if b is None else bytes(b).decode(charset), "NO_BYTES" if b is None else None))
            except (UnicodeDecodeError, LookupError) as e:
                out.append((None, type(e).__name__))
        return pd.DataFrame(out, columns=["text", "error"])

    return F.pandas_udf(run, "text string, error string")(raw)


def valid_request(df: DataFrame, modes: Sequence[str]) -> DataFrame:
    """Adds ``reject``: the first rule a request breaks, or null."""
    c = F.col
    rule = (
        F.when(F.coalesce(F.trim("question"), F.lit("")) == "", "BLANK_QUESTION")
        .when(~F.coalesce(c("version_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)), "BAD_VERSION")
        .when(~F.coalesce(c("limit").between(1, 100), F.lit(False)), "BAD_LIMIT")
        .when(~F.coalesce(c("mode").isin(*modes), F.lit(False)), "BAD_MODE")
    )
    return df.withColumn("reject", rule)


def apply_filters(df: DataFrame, act: str | None = None, types: Sequence[str] | None = None, status: str | None = "CURRENT", role: str | None = "NORMATIVE") -> DataFrame:
    """Optional equality and IN filters that reach the scan."""
    for name, value in (("act", act), ("text_status", status), ("content_role", role)):
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df.filter(F.col("element_type").isin(*types)) if types is not None else df


def resolve_links(df: DataFrame, base: str, link: str) -> DataFrame:
    """Adds ``absolute``: the link resolved against the page's address (RFC 3986)."""
    def run(b: pd.Series, x: pd.Series) -> pd.Series:
        from urllib.parse import urljoin

        def one(u, v):
            try:
                return urljoin(u or "", v) if v is not None else None
            except ValueError:
                return None

        return pd.Series([one(u, v) for u, v in zip(b, x, strict=True)], dtype=object)

    whole = F.col(link).rlike("^[a-z][a-z0-9+.-]*://[^/]+(/|$)") & ~F.col(link).contains("/.")
    return df.withColumn("absolute", F.when(whole, F.col(link)).otherwise(F.pandas_udf(run, "string")(F.col(base), F.col(link))))
