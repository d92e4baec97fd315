"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.store import written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text (runs of anything but space and tab to carriage return); null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """``weight`` 1, 2, ... ``cycle``, repeating, for sources by code point, null last.

    One task sorts one row per source, here and in ``source_targets``: meant for up to some millions of sources.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    return sources.withColumn("weight", ((F.row_number().over(order) - 1) % cycle + 1).cast("double"))


def source_targets(sources: DataFrame, max_repeats: int = 3) -> DataFrame:
    """Targets by weight, none above ``max_repeats`` times its source's size.

    ``sources`` has one row per source: source, source_size, weight. The excess over a cap is shared
    again by weight until no source is above its cap. In order of cap / weight the capped sources come
    first, so running sums over this one-row-per-source table find them without a loop. Sources of
    size zero get target zero; if all weights are zero or null, all targets are zero.
    """
    s = sources.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    order = Window.orderBy(F.try_divide("cap", "weight").asc_nulls_last(), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(every).cast("double"))
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("capped", (F.col("weight") > 0) & (F.col("cap") * F.col("rest") <= F.col("weight") * (F.col("total") - F.col("before"))))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0.0)))
    s = s.withColumn("open", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.coalesce(F.try_divide(F.col("left") * F.col("weight"), F.col("open")), F.lit(0.0)))
    return s.select("source", "source_size", "weight", target.alias("target"))


def draw(seed: int, *keys: Column) -> Column:
    """A number from 0 to 1 (exclusive) by MD5 of seed and keys; the same in each run."""
    parts = [F.coalesce(k.cast("string"), F.lit("null")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


#: Tasks that rows of one id and text are dealt out over to be numbered.
SALTS = 64


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``no_``: 1 for rows whose (id_, digest_) stand once, else 1, 2, ... among their equals.

    Rows that have equals are written once with the salt that deals them out; what is numbered inside a salt and what
    is counted to put the salts one after the other is that table, so both see the same salts however the
    rows came. Which of the equals gets which number makes no difference.
    """
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    again = rows.groupBy("id_", "digest_").agg(F.count("*").alias("n_")).filter("n_ > 1")
    again = written(again.select(F.col("id_").alias("a_id"), F.col("digest_").alias("a_digest")), "repeated")
    on = same("id_", "a_id") & same("digest_", "a_digest")
    if again.isEmpty():
        return rows.withColumn("no_", F.lit(1).cast("long"))
    once = rows.join(again, on, "left_anti").withColumn("no_", F.lit(1).cast("long"))
    salted = again.withColumn("a_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    more = rows.withColumn("salt_", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    more = written(more.join(salted, on & (F.col("salt_") == F.col("a_salt")), "left_semi"), "repeats")
    more = more.withColumn("at_", F.row_number().over(Window.partitionBy("id_", "digest_", "salt_").orderBy("salt_")))
    held = more.groupBy("id_", "digest_", "salt_").agg(F.count("*").alias("n_"))
    before = F.sum("n_").over(Window.partitionBy("id_", "digest_").orderBy("salt_").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select(F.col("id_").alias("h_id"), F.col("digest_").alias("h_digest"), F.col("salt_").alias("h_salt"), F.coalesce(before, F.lit(0)).alias("before_"))
    more = more.join(held, same("id_", "h_id") & same("digest_", "h_digest") & (F.col("salt_") == F.col("h_salt")))
    return once.unionByName(more.withColumn("no_", F.col("before_") + F.col("at_")).select(once.columns))


def _mixed(docs: DataFrame, weights: DataFrame | None, max_repeats: int, seed: int, id_col: str) -> tuple[DataFrame, dict[str, str]]:
    """The columns of ``mix`` beside those of ``docs`` under names of their own, and what they were called."""
    names = {f"in{i}_": c for i, c in enumerate(docs.columns)}
    col = {c: F.col(i) for i, c in names.items()}
    sized = docs.toDF(*names).select(*names, word_count(col["text"]).alias("size"), col["source"].alias("d_source"), col[id_col].alias("id_"), F.md5(col["text"]).alias("digest_"))
    sources = sized.groupBy(F.col("d_source").alias("source")).agg(F.sum("size").alias("source_size"))
    if weights is None:
        sources = ranked_weights(sources)
    else:
        w = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("weight")).dropDuplicates(["w_source"])
        sources = sources.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source")
    targets = written(source_targets(sources, max_repeats).select(F.col("source").alias("t_source"), "source_size", "target"), "targets")
    out = _numbered(sized).join(targets, F.col("d_source").eqNullSafe(F.col("t_source")), "left").drop("t_source", "d_source")
    out = out.withColumn("rate", F.least(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)), F.lit(float(max_repeats))))
    out = out.withColumn("copies", (F.floor("rate") + (draw(seed, F.col("id_"), F.col("digest_"), F.col("no_")) < F.col("rate") - F.floor("rate")).cast("long")).cast("int"))
    return out.withColumn("taken", F.col("size") * F.col("copies")), names


ADDED = ("size", "source_size", "target", "rate", "copies", "taken")


def mix(docs: DataFrame, weights: DataFrame | None = None, max_repeats: int = 3, seed: int = 7, id_col: str = "doc_id") -> DataFrame:
    """Each document with its size, source_size, target, rate, copies and taken words.

    Sizes are summed per source (map-side first, so a hot source costs one row per task); a source's
    rate is target / size; a document is emitted floor(rate) times plus one Bernoulli copy whose
    probability is the fraction, drawn from a hash of seed, id, text and, where rows agree in both, a
    number among them: rows repeated whole, or without an id, are drawn each for itself. The table of targets
    has one row per source; it is written, so that Spark broadcasts it only while its known size is under the
    threshold and sort-merge joins it otherwise. Null text has size 0, as have empty ones; texts may be of any
    length; null source is a source; an empty table gives an empty one. Columns of ``docs`` that clash with
    the added names are left out here; ``emit`` keeps them.
    """
    out, names = _mixed(docs, weights, max_repeats, seed, id_col)
    return out.select(*(F.col(i).alias(c) for i, c in names.items() if c not in ADDED), *ADDED)


def emit(docs: DataFrame, weights: DataFrame | None = None, max_repeats: int = 3, seed: int = 7, id_col: str = "doc_id") -> DataFrame:
    """The mixture itself: every document as often as its copies in ``mix`` say, with the columns of ``docs`` as they are."""
    out, names = _mixed(docs, weights, max_repeats, seed, id_col)
    out = out.filter("copies > 0").select(*names, F.explode(F.sequence(F.lit(1), "copies")).alias("copy_"))
    return out.select(*(F.col(i).alias(c) for i, c in names.items()))
