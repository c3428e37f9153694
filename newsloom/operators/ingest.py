"""From feed items to stored articles: addresses, duplicates, content, categories, and counts of what happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.urls import content_hash, normalize_url
from newsloom.operators import existence
from newsloom.operators.dedup import insert_status
from newsloom.operators.filters import in_crawl_range

# Feeds that are read by default.
FEEDS = [
    ("vnexpress", "https://vnexpress.net/rss/tin-moi-nhat.rss", "VnExpress", True),
    ("tuoitre", "https://tuoitre.vn/home.rss", "Tuổi Trẻ", True),
    ("thanhnien", "https://thanhnien.vn/rss/home.rss", "Thanh Niên", True),
]
STATUSES = ("OK", "UNKNOWN")


def feeds(spark: SparkSession, rows: list[tuple] = FEEDS) -> DataFrame:
    return spark.createDataFrame(rows, "name string, url string, source string, enabled boolean")


def resolve_feeds(table: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Enabled feeds, of the names that are asked for if any. ValueError for a name that there isn't."""
    if names:
        wanted = sorted({n.strip().lower() for n in names if n.strip()})
        asked = table.sparkSession.createDataFrame([(n,) for n in wanted], "name string")
        if unknown := [r[0] for r in asked.join(table, "name", "left_anti").orderBy("name").collect()]:
            raise ValueError(f"Unknown sources: {unknown}")
        table = table.join(asked, "name")
    return table.where("enabled").orderBy("name")


def candidates(items: DataFrame, existing: DataFrame | str, from_date: str | None = None, to_date: str | None = None) -> DataFrame:
    """Items within the dates with a normalised address that neither their address nor their feed text has stored.

    existing has the stored rows, or is the path of their existence index.
    """
    day = F.col("published_at").cast("date")
    fresh = items.where(in_crawl_range(day, from_date, to_date)).withColumn("url", normalize_url(F.col("url"))).withColumn("content_hash", content_hash(F.col("title"), F.col("content")))
    have = existence.known(fresh, existing) if isinstance(existing, str) else {c: existing.select(c).distinct() for c in existence.COLUMNS}
    return fresh.join(have["url"], "url", "left_anti").join(have["content_hash"], "content_hash", "left_anti")


def resolve_content(rows: DataFrame, full: Column, feed: str = "content") -> DataFrame:
    """rows with content and content_source: the page's text where there is one, else the feed's."""
    has = F.coalesce(F.length(F.trim(full)) > 0, F.lit(False))
    return rows.withColumn("content_source", F.when(has, "fulltext").otherwise("rss_fallback")).withColumn("content", F.when(has, full).otherwise(F.col(feed)))


def decide(batch: DataFrame, existing: DataFrame | dict[str, DataFrame], position: str = "pos") -> DataFrame:
    """batch (url, title, content, pos) with content_hash and insert status."""
    return insert_status(batch.withColumn("content_hash", content_hash(F.col("title"), F.col("content"))), existing, position)


def check_predictions(batch: DataFrame, predictions: DataFrame, key: str = "id") -> None:
    """ValueError unless each row of batch has one prediction, with a label unless its status is UNKNOWN."""
    if not batch.select(key).exceptAll(predictions.select(key)).isEmpty() or not predictions.select(key).exceptAll(batch.select(key)).isEmpty():
        raise ValueError("predictions are not for the same rows")
    bad = ~F.col("status").isin(*STATUSES) | ((F.col("status") == "OK") & F.col("label").isNull())
    if not predictions.where(F.coalesce(bad, F.lit(True))).isEmpty():
        raise ValueError("predictions without a status or a label")


def check_requests(batch: DataFrame, text: str = "text", most_chars: int = 20_000, most_items: int = 100) -> None:
    """ValueError unless there are 1 to most_items texts to predict, each of 1 to most_chars characters."""
    n = batch.limit(most_items + 1).count()
    if not 1 <= n <= most_items:
        raise ValueError(f"between 1 and {most_items} items are predicted at once")
    if not batch.where(~F.coalesce(F.length(text).between(1, most_chars), F.lit(False))).isEmpty():
        raise ValueError(f"a text must have between 1 and {most_chars} characters")


def article_counts() -> list[Column]:
    """Counts of a crawl's articles. There is a row for each article of the feeds that were read, with fate (DATE, KNOWN, then SKIPPED, or a status of
    insert_status) and content_source, null where the article was not fetched. All that got that far were predicted."""
    fate, source = F.col("fate"), F.col("content_source")
    tried = ~fate.isin("DATE", "KNOWN")
    return [
        F.count("*").alias("articles_parsed"),
        F.count_if(fate == "DATE").alias("articles_date_filtered"),
        F.count_if(fate == "SKIPPED").alias("articles_skipped"),
        F.count_if((fate == "KNOWN") | fate.startswith("DUPLICATE")).alias("articles_duplicate"),
        F.count_if(tried).alias("articles_predicted"),
        F.count_if(fate == "CREATED").alias("articles_created"),
        F.count_if(tried & (source == "fulltext")).alias("articles_fulltext_fetched"),
        F.count_if(tried & (source == "rss_fallback")).alias("articles_fulltext_fallback"),
    ]


ARTICLE_COUNTS = (
    "articles_parsed", "articles_date_filtered", "articles_skipped", "articles_duplicate", "articles_predicted", "articles_created", "articles_fulltext_fetched", "articles_fulltext_fallback",
)


def feed_counts(feeds: DataFrame) -> DataFrame:
    """One row of counts of feeds (ok), of which each has a row."""
    return feeds.agg(F.count("*").alias("feeds_total"), F.count_if("ok").alias("feeds_success"), F.count_if(~F.col("ok")).alias("feeds_failed"))


def crawl_counters(feeds: DataFrame, items: DataFrame) -> DataFrame:
    """One row of counts of a crawl: feed_counts and article_counts."""
    return feed_counts(feeds).crossJoin(items.agg(*article_counts()))


def write_counted(items: DataFrame, path: str, kept: Column, drop: tuple[str, ...] = ()) -> dict[str, int]:
    """Write the items that are kept to path, without the columns drop, and count all items (article_counts) in the same job. A table that is there is replaced."""
    seen = Observation()
    items.observe(seen, *article_counts()).where(kept).drop(*drop).write.mode("overwrite").parquet(path)
    return {**dict.fromkeys(ARTICLE_COUNTS, 0), **seen.get}


def counters(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """What write_counted has counted, as a row."""
    return spark.createDataFrame([tuple(counts[c] for c in ARTICLE_COUNTS)], ", ".join(f"{c} long" for c in ARTICLE_COUNTS))


def crawl_stats(decided: DataFrame) -> DataFrame:
    """One row of counts of what became of a batch."""
    of = lambda c, v: F.count_if(F.col(c) == v)
    return decided.agg(
        F.count("*").alias("total"),
        of("status", "CREATED").alias("created"),
        of("status", "DUPLICATE_URL").alias("duplicate_url"),
        of("status", "DUPLICATE_CONTENT").alias("duplicate_content"),
        of("content_source", "fulltext").alias("fulltext"),
        of("content_source", "rss_fallback").alias("rss_fallback"),
    )
