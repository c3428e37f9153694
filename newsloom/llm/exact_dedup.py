"""Exact deduplication by sorting contents; DataFrame operations only.

A sampled range partitioning over bounded sort keys (the first characters and a hash of the text)
puts equal texts side by side, each partition is sorted externally with the full text as the last
key, and the neighbouring rows are compared over the full text, which gives runs of equal texts. A run tells the
identifier that stays and the size of the group.

A text with more than 1/HOT_SHARE of all rows would make one task too large. There are fewer than
HOT_SHARE such texts, so their hashes are a table of proven size; their rows alone also get a salt
of the identifier in the sort key, and the at most SALTS runs of such a text are united by its SHA-256, in a table of at most
HOT_SHARE rows.

Cases: a null text is empty; empty texts are equal; a null identifier is smaller than any other; rows
repeated with the same identifier are one group of which one row stays; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import text_or_empty
from newsloom.session import materialize

HOT_SHARE, HOT_LEAST, SALTS = 2048, 1000, 256


def hot_texts(docs: DataFrame, text: Column) -> DataFrame:
    """(hot): the hashes of texts with so many rows; at most HOT_SHARE of them."""
    least = max(HOT_LEAST, docs.count() // HOT_SHARE)
    hot = docs.groupBy(F.xxhash64(text).alias("hot")).count().where(F.col("count") > least).select("hot")
    return F.broadcast(materialize(hot, "hot"))


def sorted_runs(rows: DataFrame, hot: DataFrame, largest: bool) -> tuple[DataFrame, list[Column]]:
    """rows (id, text, ...) with salt (null: not hot), in ranges of their sort key; and what the rows of a run have in common."""
    keyed = rows.withColumn("hash", F.xxhash64("text")).join(hot, F.col("hash") == F.col("hot"), "left")
    keyed = keyed.withColumn("salt", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(SALTS)))).drop("hot")
    keyed = keyed.withColumn("start", F.substring("text", 1, 32)).repartitionByRange("start", "hash", "salt")
    return keyed, [F.col(c) for c in ("start", "hash", "salt", "text")]


def order(largest: bool) -> Column:
    """Of a run, the row that stays comes first."""
    return F.col("id").desc_nulls_last() if largest else F.col("id").asc_nulls_first()


def best(largest: bool, of: str) -> Column:
    """The identifier that stays, of several."""
    found = (F.max if largest else F.min)(F.struct(F.col(of).isNotNull().alias("some"), F.col(of).alias("id")))
    return found["id"]


def duplicate_groups(docs: DataFrame, text: Column | None = None, id_column: str = "doc_id", largest: bool = True) -> DataFrame:
    """One row for each document: (id, keep_id, group_size, kept, text_sha256).

    text is the normalised text; by default the text itself. largest: the largest identifier stays,
    else the smallest.
    """
    text = text_or_empty() if text is None else text
    runs, same = sorted_runs(docs.select(F.col(id_column).alias("id"), text.alias("text")), hot_texts(docs, text), largest)
    by, whole = Window.partitionBy(*same), (Window.unboundedPreceding, Window.unboundedFollowing)
    ordered = by.orderBy(order(largest))
    thin = runs.select(
        "id",
        F.unhex(F.sha2("text", 256)).alias("sha"),
        F.col("salt").isNotNull().alias("salted"),
        F.row_number().over(ordered).alias("rank"),
        F.first("id").over(ordered.rowsBetween(*whole)).alias("keep_id"),
        F.count("*").over(ordered.rowsBetween(*whole)).alias("group_size"),
    )
    thin = materialize(thin, "runs")
    united = thin.where("salted and rank = 1").groupBy(F.col("sha").alias("of")).agg(best(largest, "keep_id").alias("united_id"), F.sum("group_size").alias("united_size"))
    rows = thin.join(F.broadcast(united), F.col("salted") & (F.col("sha") == F.col("of")), "left")
    keep = F.when(F.col("united_size").isNull(), F.col("keep_id")).otherwise(F.col("united_id"))
    return rows.select(
        F.col("id").alias(id_column),
        keep.alias("keep_id"),
        F.coalesce("united_size", "group_size").alias("group_size"),
        (F.col("id").eqNullSafe(keep) & (F.col("rank") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, text: Column | None = None, id_column: str = "doc_id", largest: bool = True) -> DataFrame:
    """docs without the rows whose text another row keeps; the text is shuffled once.

    The first row of a run stays. Only a hot text has several runs, and the table that says which
    of them has the row that stays has at most HOT_SHARE rows.
    """
    plain = text is None
    text = text_or_empty() if plain else text
    hot = hot_texts(docs, text)
    winners = docs.select(F.col(id_column).alias("id"), text.alias("text")).withColumn("hot", F.xxhash64("text")).join(hot, "hot")
    winners = winners.groupBy(F.sha2("text", 256).alias("sha")).agg(best(largest, "id").alias("winner"))
    # The text itself is taken out of the row, and put back behind.
    others = [F.col(f"`{c}`") for c in docs.columns if not (plain and c == "text")]
    rows = docs.select(F.struct(*others).alias("row"), F.col(id_column).alias("id"), text.alias("text"), F.isnull("text").alias("null") if plain else F.lit(False).alias("null"))
    runs, same = sorted_runs(rows, hot, largest)
    heads = runs.withColumn("rank", F.row_number().over(Window.partitionBy(*same).orderBy(order(largest)))).where("rank = 1")
    heads = heads.withColumn("key", F.when(F.col("salt").isNotNull(), F.sha2("text", 256)))
    kept = heads.join(F.broadcast(winners), F.col("key") == F.col("sha"), "left").where(F.col("salt").isNull() | F.col("id").eqNullSafe(F.col("winner")))
    own = F.when(~F.col("null"), F.col("text"))
    return kept.select(*(own.alias(c) if plain and c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
