"""Descriptive analytics over news."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.filters import Filters, effective_day, effective_time, few_values, published_between, within

RECENT = ["id", "title", "url", "source", "category", "content_source", "decision_score", "published_at", "crawled_at"]


def summary(news: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """One row, from one pass over the table."""
    return filters.apply(news).agg(
        F.count("*").alias("total_articles"),
        F.count_distinct("category").alias("total_categories"),
        F.count_distinct("source").alias("total_sources"),
        F.count_if(F.col("content_source") == "fulltext").alias("fulltext_articles"),
        F.count_if(F.col("content_source") == "rss_fallback").alias("rss_fallback_articles"),
        F.max("crawled_at").alias("latest_crawled_at"),
    )


def by_column(news: DataFrame, column: str, filters: Filters = Filters()) -> DataFrame:
    """Articles for each value, most first."""
    return filters.apply(news).groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column)


def categories(news: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Articles for each category with their percentage, half-even to two places."""
    counts = filters.apply(news).groupBy("category").agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("total"))  # one row
    share = F.when(F.col("total") > 0, F.bround(F.col("count") / F.col("total") * 100, 2)).otherwise(0.0)
    return counts.crossJoin(F.broadcast(total)).select("category", "count", share.alias("percentage")).orderBy(F.desc("count"), "category")


def daily(news: DataFrame, filters: Filters = Filters()) -> DataFrame:
    return filters.apply(news).groupBy(effective_day().alias("day")).agg(F.count("*").alias("count")).orderBy("day")


def daily_categories(news: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """(day, category, count), the long form of trend_by_category."""
    return filters.apply(news).groupBy(effective_day().alias("day"), "category").agg(F.count("*").alias("count"))


def trend_by_category(news: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """A row for each day: a map from category to count, and the day's total."""
    each = F.collect_list(F.struct(F.coalesce("category", F.lit("")), "count"))
    return daily_categories(news, filters).groupBy("day").agg(F.map_from_entries(each).alias("categories"), F.sum("count").alias("total")).orderBy("day")


def trend_table(trend: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """trend_by_category as a table with a column for each category, 0 where a day has none."""
    names = columns or few_values(trend.select(F.explode(F.map_keys("categories"))))
    return trend.select("day", *(F.coalesce(F.col("categories")[n], F.lit(0)).alias(n) for n in names), "total")


def recent(news: DataFrame, filters: Filters = Filters(), limit: int = 20) -> DataFrame:
    """The latest articles; ties by identifier."""
    return filters.apply(news).orderBy(effective_time().desc(), "id").limit(within(limit, 1, 100, "limit")).select(*RECENT)


def page(news: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page in the order of crawling, latest first."""
    return news.orderBy(F.desc("crawled_at"), F.desc("id")).offset(offset).limit(limit)


def latest(news: DataFrame, category: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """The last published ones, of a category if one is given; undated ones come last."""
    chosen = news.where(F.col("category") == category) if category else news
    return chosen.orderBy(F.desc_nulls_last("published_at"), F.desc("crawled_at"), F.desc("id")).offset(offset).limit(limit)


def published(news: DataFrame, start: str, end: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Published in a half-open range, earliest first."""
    rows = published_between(news, start, end).orderBy("published_at", "id").offset(offset)
    return rows.limit(limit) if limit is not None else rows


def category_counts(news: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    rows = published_between(news, start, end) if start and end else news
    return rows.groupBy("category").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "category")


def lookup(news: DataFrame, column: str, value) -> DataFrame:
    """At most one article by url, content_hash or id."""
    return news.where(F.col(column) == value).limit(1)


def search(news: DataFrame, text: str = "", page_number: int = 1, page_size: int = 10, category: str | None = None, source: str | None = None, content_source: str | None = None) -> DataFrame:
    """A page of the articles whose title, category or source holds text, in any case."""
    rows = Filters(category=category, source=source, content_source=content_source).apply(news)
    if text.strip():
        every = F.lower(F.concat_ws("\n", "title", "category", "source"))
        rows = rows.where(F.contains(every, F.lit(text.strip().lower())))
    return rows.orderBy(effective_time().desc(), "id").offset((page_number - 1) * page_size).limit(page_size)


def explore(news: DataFrame, text: str, recent_rows: int = 30, page_size: int = 10) -> DataFrame:
    """search() among the latest articles only, as a click on a keyword asks."""
    return search(recent(news, limit=recent_rows), text, page_size=page_size)


def health(news: DataFrame) -> DataFrame:
    """One row that says 1."""
    return news.sparkSession.sql("SELECT 1 AS ok")
