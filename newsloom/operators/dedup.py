"""Keep-first deduplication, insert decisions and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import strip
from newsloom.session import materialize


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; order should end in something unique."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def deduplicate(df: DataFrame, position: str = "pos", url: str = "url", text: str = "clean_text") -> DataFrame:
    """One row for each raw URL (rows without one all stay), then one for each text.

    position is the rows' order. After the first step rows with a URL come before those without.
    """
    if url in df.columns:
        has = F.coalesce(strip(F.col(url)) != "", F.lit(False))
        # Rows without a URL are keys of their own, by their position.
        marked = df.withColumn("_has", has).withColumn("_key", F.when(has, F.col(url))).withColumn("_own", F.when(~has, F.col(position)))
        df = keep_first(marked, ["_key", "_own"], [F.col(position)]).drop("_key", "_own")
        order = [F.desc("_has"), F.col(position)]
    else:
        df, order = df.withColumn("_has", F.lit(True)), [F.col(position)]
    return keep_first(df, [text], order).drop("_has")


def insert_status(batch: DataFrame, existing: DataFrame | dict[str, DataFrame], position: str = "pos") -> DataFrame:
    """batch with status CREATED, DUPLICATE_URL or DUPLICATE_CONTENT, as if inserted row by row.

    existing has the stored rows, or for each of url and content_hash a table of the stored values, as existence.known gives them.
    A row repeats an existing URL or content hash, or one of an earlier row of the batch that was created. A row is refused by its URL first.
    In each round the rows that are the first undecided ones of their URL and of their hash are created, and the others of these URLs and
    hashes are refused; refused rows store nothing, so the next round is without them. Each round is a written table; there are as many as
    the longest chain of rows that each refuse the next asks for. First rows are minima, combined before the shuffle, and all joins are with tables of one
    row for each URL or hash, so that one that very many rows have can be split. A null URL or hash is one like any other.
    """
    known = lambda c: (existing[c] if isinstance(existing, dict) else existing).select(F.col(c).alias("k")).distinct().withColumn("known", F.lit(True))
    n = materialize(batch.select(F.struct("*").alias("row"), "url", "content_hash", F.struct(F.col(position).alias("pos"), F.monotonically_increasing_id().alias("n")).alias("at")), "batch")
    rows = n
    for c in ("url", "content_hash"):
        rows = rows.join(known(c), F.col(c).eqNullSafe(F.col("k")), "left").withColumn(f"old_{c}", F.col("known").isNotNull()).drop("k", "known")
    rows = materialize(rows, "rows")
    left, created = rows.where("not old_url and not old_content_hash").select("at", "url", "content_hash"), []
    while True:
        first = left
        for c in ("url", "content_hash"):
            least = left.groupBy(F.col(c).alias("k")).agg(F.min("at").alias("least"))
            first = first.join(least, F.col(c).eqNullSafe(F.col("k"))).where("at = least").drop("k", "least")
        created.append(materialize(first, "created"))
        for c in ("url", "content_hash"):
            left = left.join(created[-1].select(F.col(c).alias("k")), F.col(c).eqNullSafe(F.col("k")), "left_anti")
        left = materialize(left, "left")
        if left.isEmpty():
            break
    new = reduce(DataFrame.unionAll, created)
    # At most one row of a URL is created.
    rows = rows.join(new.select(F.col("url").alias("k"), F.col("at").alias("made")), F.col("url").eqNullSafe(F.col("k")), "left")
    by_url = F.col("old_url") | F.coalesce(F.col("made") < F.col("at"), F.lit(False))
    status = F.when(F.coalesce(F.col("made") == F.col("at"), F.lit(False)), "CREATED").when(by_url, "DUPLICATE_URL").otherwise("DUPLICATE_CONTENT")
    return rows.select("row.*", status.alias("status"))


def upsert(existing: DataFrame, changes: DataFrame, keys: list[str], order: str, keep: list[str] = ("id", "created_at")) -> DataFrame:
    """existing with changes by key: the last of changes in order wins; the columns keep stay as they are."""
    last = keep_first(changes, keys, [F.desc(order)]).drop(order)
    kept = [c for c in keep if c in existing.columns]
    old = existing.select(*keys, *(F.col(c).alias(f"_{c}") for c in kept))
    updated = last.join(old, keys, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in kept else F.col(c) for c in existing.columns))
    return existing.join(last.select(*keys), keys, "left_anti").select(*existing.columns).unionByName(updated)


def not_existing(batch: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of batch without a match in existing."""
    return batch.join(existing.select(*keys).distinct(), keys, "left_anti")
