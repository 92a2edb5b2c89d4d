"""Mixing sources to target weights, by distributed prefix sums in a hash-random order.

DataFrame functions only. Each document gets a 60-bit random key from its id; equal ranges of the
key are the range partitions, so a source of any size is spread evenly and no sampling is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, words_column

KEY_BITS = 60
ROWS_PER_RANGE = 20_000


def random_key(key: Column, text: Column) -> Column:
    """Sixty bits of md5 of the key as text, or of the text where the key is null: the same on every run and in any SQL engine."""
    of_text = F.concat(F.lit("-"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), of_text)), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], total_percent: int, max_epochs: int) -> DataFrame:
    """(src, source_size) -> with target: weights by code point order (null last), capped and reshared.

    Sharing by weight and moving what is above a cap to the others ends where every source has
    min(cap, level * weight). Going through the sources by cap / weight, the level is what is
    left after the caps below over the weights not below. The table has one row per source.
    """
    everything = Window.orderBy("is_null", "src")
    w = sizes.withColumn("is_null", F.col("src") == "").withColumn("place", F.row_number().over(everything) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * max_epochs)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    w = w.withColumn("budget", F.sum("source_size").over(whole) * total_percent / 100.0)
    w = w.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("weight_left"))
    w = w.withColumn("level", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("level").alias("level")))).over(whole)["level"])
    share = F.col("level") * F.col("weight")
    return w.select("src", "source_size", F.when(share < F.col("cap"), share).otherwise(F.col("cap").cast("double")).alias("target"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), total_percent: int = 150, max_epochs: int = 2, carry: list[str] | None = None) -> DataFrame:
    """How many words the mix takes of every document; one row per row of docs.

    Columns: doc_id, size, source_size, target, taken, then those named in carry. A source is taken whole as often as its
    target has room, then documents in random order until the budget is exactly used; the one at
    the cut is taken in part. Null text has size 0 and is never taken; a null source is a source
    of its own, sorted last; rows with equal ids are ordered by size, and equal rows are
    interchangeable; null ids are drawn by their texts; whole texts are counted, however long; an empty
    table gives an empty result; extra columns are ignored.
    """
    carried = [F.col(c).alias(f"carried {c}") for c in carry or []]
    src = F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    size = F.size(words_column(F.col(text_col))).cast("long")
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), src.alias("src"), random_key(F.col(id_col), F.col(text_col)).alias("key"), *carried), "mix-rows")
    ranges = max(1, -(-rows.count() // ROWS_PER_RANGE))
    width = (1 << KEY_BITS) // ranges + 1
    rows = rows.withColumn("range", F.floor(F.col("key") / F.lit(width)).cast("int"))
    sums = materialize(rows.groupBy("src", "range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    targets = source_targets(sums.groupBy("src").agg(F.sum("range_size").alias("source_size")), list(weights), total_percent, max_epochs)
    earlier = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("range_before", F.coalesce(F.sum("range_size").over(earlier), F.lit(0))).join(targets, "src").drop("range_size")
    inside = Window.partitionBy("src", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(materialize(offsets, "mix-offsets"), ["src", "range"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = (F.floor(F.col("target") + 0.5) - epochs * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("range_before") - F.col("before")))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("size") * epochs + part).cast("long").alias("taken"), *(F.col(f"carried {c}").alias(c) for c in carry or []))


def mixed_rows(docs: DataFrame, columns: list[str], *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mix itself: a row of the given columns for each time a document is taken, with fewer words where it is cut.

    Documents of which nothing is taken are left out, so texts without a word are.
    """
    rest = [c for c in columns if c != id_col]
    taken = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, carry=rest, **settings).where("taken > 0")
    copies = F.floor(F.col("taken") / F.col("size")).cast("int")
    left = (F.col("taken") % F.col("size")).cast("int")
    whole = F.array_repeat(F.lit(None).cast("int"), copies)
    each = taken.withColumn("some", F.explode(F.when(left > 0, F.concat(whole, F.array(left))).otherwise(whole)))
    text = F.when(F.col("some").isNull(), F.col(text_col)).otherwise(F.array_join(F.slice(words_column(F.col(text_col)), F.lit(1), F.coalesce("some", F.lit(0))), " "))
    return each.withColumn(text_col, text).withColumnRenamed("doc_id", id_col).select(*columns)
