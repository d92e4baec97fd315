"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.store import row_key, written

#: Kinds in their listed order: pattern, group that holds the value, least length of that group. Of the
#: runs of hex digits and AKIA codes only those long enough can match; a short assigned value uses up its text.
KINDS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: The method's own kind: long tokens of mixed letters and digits, kept only where the corpus shows one owner.
OWNED = ("owned", r"[A-Za-z0-9+/_=-]{20,}", 0, 20)


HIT = "struct<order:int,kind:string,no:int,gap:int,size:int,value:string>"
#: Code points of a piece of text that is rebuilt at once.
PIECE = 1_000


def hits(text: Column, found: Column, order: int, kind: str, pattern: str, group: int) -> Column:
    """Array of a pattern's leftmost non-overlapping matches: order, kind, number, code points before it since the last one, its own code points, value."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"))
    value = (lambda h: h) if group == 0 else lambda h: F.regexp_extract(h, pattern, group)
    each = F.transform(F.slice(zipped, F.lit(1), F.size(found)), lambda x, i: F.struct(F.lit(order).alias("order"), F.lit(kind).alias("kind"), i.alias("no"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), value(x["hit"]).alias("value")))
    return F.when(F.size(found) > 0, each).otherwise(F.array().cast(f"array<{HIT}>"))


def candidates(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per candidate of each distinct (id, text): key, order, kind, start, end, value hash.

    Spark gives matches and the text between them but no offsets: matches become rows with their number, and
    offsets are running sums of lengths over a text's rows, so the work is linear in a text's matches.
    """
    kinds = [*KINDS, OWNED]
    d = docs.select(row_key(id_col).alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    d = d.select("*", *(F.regexp_extract_all("t", F.lit(k[1]), F.lit(0)).alias(f"found{i}") for i, k in enumerate(kinds)))
    every = F.concat(*(hits(F.col("t"), F.col(f"found{i}"), i, *k[:3]) for i, k in enumerate(kinds)))
    d = d.select("key", F.explode(every).alias("s")).select("key", "s.*")
    d = d.groupBy("key", "order", "no").agg(*(F.first(c).alias(c) for c in ("kind", "gap", "size", "value")))
    d = d.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("key", "order").orderBy("no")))
    d = d.withColumn("start", F.col("end") - F.col("size"))
    least = F.element_at(F.array(*(F.lit(k[3]) for k in kinds)), F.col("order") + 1)
    is_owned = F.col("kind") == OWNED[0]
    looks = F.col("value").rlike("[0-9]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]")
    d = d.filter((F.length("value") >= least) & (~is_owned | looks))
    by_key = Window.partitionBy("key")
    ended = F.max(F.when(~is_owned, F.col("end"))).over(by_key.orderBy("start", "order"))
    next_ = F.min(F.when(~is_owned, F.col("start"))).over(by_key.orderBy(F.desc("start"), F.desc("order")))
    d = d.withColumns({"ended": ended, "next_": next_})
    apart = (F.coalesce("ended", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next_") >= F.col("end"), F.lit(True)))
    return d.filter(~is_owned | apart).select("key", "order", "kind", "start", "end", F.xxhash64("value").alias("hash"))


def ownership(found: DataFrame, docs: DataFrame, id_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """Distinct owners and repositories of each value hash, over all rows of ``docs``, also those that share id and text.

    Distinct (hash, owner, repository) come first, so a value that a third of all rows holds is summed map-side.
    """
    holders = docs.select(row_key(id_col).alias("h_key"), F.col(owner_col).alias("owner"), F.col(id_col).alias("repository")).distinct()
    each = found.select("key", "hash").distinct().join(holders, F.col("key") == F.col("h_key")).groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = each.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def judged(docs: DataFrame, max_owners: int = 1, min_copied: int = 3, id_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """One row per span of each distinct (id, text): the columns of ``candidates`` with owners, repositories and ``verdict``.

    The verdict is ``example`` where the corpus shows its value with ``min_copied`` owners or more, else
    ``live``. Base kinds (assign, access, hex) always stay; ``owned`` spans, long mixed tokens apart from
    base spans, are added only where at most ``max_owners`` owners hold their value. Null and empty text
    have no spans; a null owner is one owner, a null id one repository; rows repeated whole count once, but all owners
    and repositories of an id and text count; a text may be of any length.
    """
    found = written(candidates(docs, id_col), "candidates")
    seen = found.join(ownership(found, docs, id_col, owner_col), "hash").filter((F.col("kind") != OWNED[0]) | (F.col("owners") <= max_owners))
    return seen.withColumn("verdict", F.when(F.col("owners") >= min_copied, "example").otherwise("live"))


def scan(docs: DataFrame, **options) -> DataFrame:
    """Spans of each distinct (id, text) that has any: key and ``spans``, sorted by start and kind."""
    span = F.struct("start", "order", "kind", "end", "owners", "repositories", "verdict")
    return judged(docs, **options).groupBy("key").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def told(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: counts by kind and verdict, base_sha256 and spans; no text is shuffled.

    Only the id, the text and the owner are looked at; an empty table gives an empty one.
    """
    id_col = options.get("id_col", "doc_id")
    by_key = scan(docs, **options).withColumnRenamed("key", "span_key")
    ids = docs.select(id_col, row_key(id_col).alias("key"))
    d = ids.join(by_key, F.col("key") == F.col("span_key"), "left").withColumn("spans", F.coalesce("spans", F.array().cast(by_key.schema["spans"].dataType)))
    n = lambda field, value: F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != OWNED[0])
    return d.select(
        id_col,
        *(n("kind", k).alias(f"n_{k}") for k, *_ in KINDS),
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
        n("kind", OWNED[0]).alias("n_owned"),
        n("verdict", "live").alias("n_live"),
        n("verdict", "example").alias("n_example"),
    )


def redact(docs: DataFrame, mark: str = "<SECRET>", **options) -> DataFrame:
    """Documents with the live spans of their text replaced by ``mark``; widely copied examples stay.

    Overlapping spans are replaced together. All rows and columns are kept, whatever the columns are called;
    null and empty texts stay as they are, rows repeated whole are all replaced, an empty table stays empty.
    Texts with live spans are cut into pieces of ``PIECE`` code points, and each piece is rebuilt for
    itself, so that the work is linear in a text's length and spans.
    """
    id_col = options.get("id_col", "doc_id")
    names = {f"in{i}_": c for i, c in enumerate(docs.columns)}
    by_key = Window.partitionBy("key").orderBy("start", "end")
    live = judged(docs, **options).filter("verdict = 'live'").select("key", "start", "end")
    live = live.withColumn("before", F.max("end").over(by_key.rowsBetween(Window.unboundedPreceding, -1)))
    live = live.withColumn("island", F.sum(F.coalesce((F.col("start") >= F.col("before")).cast("int"), F.lit(1))).over(by_key))
    live = written(live.groupBy("key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")), "live")
    spread = live.select("key", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / PIECE), F.floor((F.col("end") - 1) / PIECE))).alias("piece"))
    at = F.col("piece") * PIECE
    cut = F.struct(F.greatest(F.col("start") - at, F.lit(0)).alias("a"), F.least(F.col("end") - at, F.lit(PIECE)).alias("b"), (F.col("start") >= at).alias("first"))
    cuts = spread.groupBy("key", "piece").agg(F.sort_array(F.collect_list(cut)).alias("cuts")).withColumnsRenamed({"key": "c_key", "piece": "c_piece"})
    hold = docs.select(row_key(id_col).alias("key"), "text").join(live.select(F.col("key").alias("l_key")).distinct(), F.col("key") == F.col("l_key"), "left_semi").dropDuplicates(["key"])
    pieces = hold.select("key", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("piece", "x"))
    pieces = pieces.join(cuts, (F.col("key") == F.col("c_key")) & (F.col("piece") == F.col("c_piece")), "left")
    none = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        kept = F.substring(F.col("x"), (acc["at"] + 1).cast("int"), (s["a"] - acc["at"]).cast("int"))
        return F.struct(s["b"].alias("at"), F.concat(acc["out"], kept, F.when(s["first"], F.lit(mark)).otherwise("")).alias("out"))

    clean = F.aggregate("cuts", none, step, lambda acc: F.concat(acc["out"], F.substring(F.col("x"), (acc["at"] + 1).cast("int"), F.lit(PIECE))))
    clean = pieces.select(F.col("key").alias("new_key"), "piece", F.coalesce(clean, "x").alias("x")).groupBy("new_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "x"))), lambda p: p["x"]), "").alias("new_text"))
    d = docs.select(row_key(id_col).alias("row_key_"), *(F.col(c).alias(i) for i, c in names.items())).join(written(clean, "clean"), F.col("row_key_") == F.col("new_key"), "left")
    return d.select(*((F.coalesce("new_text", i) if c == "text" else F.col(i)).alias(c) for i, c in names.items()))
