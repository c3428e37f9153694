"""Mixing sources to target weights by capped water-filling; DataFrame operations only.

A source's target is its weight's share of what is wanted, but at most max_epochs times its size; what is
above is dealt again by weight until no source is above. With the sources in the order of
size over weight, that is a running sum: a source is clamped if what the clamped ones before it
leave, dealt by weight, would lift it above its cap.

Of each source, every document is taken as many whole times as the target allows, and the rest of the
target is a fractional repetition: the first documents in a seeded order up to the target, the last
of which is taken in part (parts=True) or as a whole if more than half of it fits (parts=False).
The running sum in that order is over slices of the order for each source, as many as the rows ask for (about SLICE rows in each if one
source has all), so that a source with most of the rows is dealt over many tasks.

Cases: a null text has no words; null is a source of its own, after the others; sources without words
have the target 0; repeated rows are taken each for itself; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import WORD, packed
from newsloom.session import materialize

SLICE = 1 << 15


def word_count(text: Column) -> Column:
    """Words in text, 0 for null: each becomes one character, and these are counted."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, WORD, "x"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def water_fill(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """sizes (source, source_size), with target. Weights repeat over the sources by code point, null last.

    share: what is wanted of all sizes, as a fraction. There is one row for each source.
    """
    up, down = share
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    w = sizes.withColumn("weight", weight.cast("decimal(38,0)")).withColumn("cap", (F.col("source_size") * max_epochs).cast("decimal(38,0)"))
    order = [(F.col("cap").cast("double") / F.col("weight").cast("double")).asc(), F.col("source").asc_nulls_last()]
    before, after, every = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    w = w.withColumn("wanted", F.sum("source_size").over(every) * up)
    w = w.withColumn("left", F.expr("cast(wanted as decimal(38,0))") - down * F.coalesce(F.sum("cap").over(before), F.lit(0)))
    w = w.withColumn("weights", F.sum("weight").over(after))
    d = lambda c: F.col(c).cast("double")
    w = w.withColumn("clamped", d("left") * d("weight") >= d("cap") * down * d("weights"))
    # The first source that is not clamped has the level of all that follow.
    free = F.min(F.when(~F.col("clamped"), F.struct(*order_key(order), "left", "weights"))).over(every)
    w = w.withColumn("free", free)
    target = F.col("free.left").cast("double") * d("weight") / (F.col("free.weights").cast("double") * down)
    return w.select("source", "source_size", F.when(F.col("clamped"), d("cap")).otherwise(F.least(target, d("cap"))).alias("target"))


def order_key(order: list[Column]) -> list[Column]:
    """The order of water_fill as columns that compare alike in a struct."""
    return [(F.col("cap").cast("double") / F.col("weight").cast("double")).alias("ratio"), F.col("source").isNull().alias("last"), F.col("source").alias("name")]


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), max_epochs: int = 2, seed: int = 42, parts: bool = True, id_column: str = "doc_id") -> DataFrame:
    """(id, size, source_size, target, taken, key) for each document; key names it among docs with one id."""
    text = F.col("text")
    thin = docs.select(F.col(id_column).alias("id"), "source", word_count(text).alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))).alias("order"), F.xxhash64("text").alias("key"))
    thin = materialize(thin.withColumn("name", F.coalesce("source", F.lit(""))).withColumn("none", F.isnull("source")), "sizes")
    rows = thin.count()
    digits = next(d for d in range(33) if 16**d * SLICE >= rows)
    thin = thin.withColumn("bucket", F.substring("order", 1, digits))  # the order is even over its first digits

    slices = thin.groupBy("name", "none", "bucket").agg(F.sum("size").alias("bucket_size"))
    sizes = slices.groupBy(F.when(~F.col("none"), F.col("name")).alias("source")).agg(F.sum("bucket_size").alias("source_size"))
    targets = water_fill(sizes, weights, share, max_epochs).withColumn("name", F.coalesce("source", F.lit(""))).withColumn("none", F.isnull("source")).drop("source")
    earlier = Window.partitionBy("name", "none").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).join(targets, ["name", "none"])

    within = Window.partitionBy("name", "none", "bucket").orderBy("order", "size", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = thin.join(slices.drop("bucket_size"), ["name", "none", "bucket"]).withColumn("before", F.col("before") + F.sum("size").over(within) - F.col("size"))
    rows = rows.withColumn("cut", F.floor(F.col("target") + 0.5)).withColumn("whole", F.when(F.col("source_size") > 0, F.expr("cut div source_size")).otherwise(F.lit(0)))
    rest = F.col("cut") - F.col("whole") * F.col("source_size") - F.col("before")
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest)) if parts else F.when(2 * rest > F.col("size"), F.col("size")).otherwise(F.lit(0))
    return rows.select(F.col("id").alias(id_column), "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"), "key", (F.col("whole") + (part > 0).cast("long")).alias("copies"))


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """docs as the mix takes them: a row as often as it is taken, each time as a whole. Rows repeated with their id and text share what they are taken."""
    names = ["none", "id", "key"]
    copies = mix(docs, parts=False, id_column=id_column, **options).select(F.isnull(id_column).alias("none"), F.coalesce(F.col(id_column), F.lit(0)).alias("id"), "key", "copies")
    copies = copies.groupBy(*names).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    rows = packed(docs, id_column).join(copies, names).withColumn("number", F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(0))))
    times = F.floor(F.col("copies") / F.col("rows")) + (F.col("number") <= F.col("copies") % F.col("rows")).cast("long")
    return rows.withColumn("times", times).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
