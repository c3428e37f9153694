"""Keyword roll-ups and trends relative to the latest day of the filtered articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import scores
from newsloom.operators.filters import Filters, effective_day, within

#: Scores are summed as decimals, so that the order of the rows doesn't matter.
SUM = "decimal(38,9)"


def occurrences(keywords: DataFrame, news: DataFrame, filters: Filters) -> DataFrame:
    """Keywords with their article's day, of the articles that pass the filters."""
    kept = filters.apply(news).select(F.col("id").alias("news_id"), effective_day().alias("article_day"))
    return keywords.join(kept, "news_id")


def roll_up(keywords: DataFrame, news: DataFrame, filters: Filters = Filters(), keyword: str | None = None, min_articles: int = 1, limit: int = 20) -> DataFrame:
    """Keywords by articles, frequency and score, of dated articles. % and _ in keyword match as in LIKE."""
    rows = occurrences(keywords, news, filters.only_dated())
    if keyword:
        rows = rows.where(F.col("keyword").ilike(f"%{keyword}%"))
    return (
        rows.groupBy("keyword")
        .agg(F.max("display_keyword").alias("display_keyword"), F.count_distinct("news_id").alias("article_count"), F.sum("frequency").alias("total_frequency"), F.sum(F.col("final_score").cast(SUM)).cast("double").alias("total_score"))
        .where(F.col("article_count") >= within(min_articles, 1, 100, "min_articles"))
        .orderBy(F.desc("article_count"), F.desc("total_frequency"), F.desc("total_score"), "keyword")
        .limit(within(limit, 1, 100, "limit"))
    )


def base(keywords: DataFrame, news: DataFrame, filters: Filters = Filters(), keyword: str | None = None) -> DataFrame:
    """Distinct (keyword, news_id, frequency, final_score, article_day), with the largest display form."""
    rows = occurrences(keywords, news, filters)
    if keyword:
        rows = rows.where(F.lower("keyword").like(f"%{keyword.lower()}%"))
    return rows.groupBy("keyword", "news_id", "frequency", "final_score", "article_day").agg(F.max("display_keyword").alias("display_keyword"))


def aggregate(rows: DataFrame, recent_days: int = 3, previous_days: int = 3, min_articles: int = 2) -> DataFrame:
    """Counts for each keyword within windows of days before the anchor, the latest day of all rows.

    age_days is the age of the keyword's oldest article.
    """
    recent_days, previous_days = within(recent_days, 2, 14, "recent_days"), within(previous_days, 2, 14, "previous_days")
    anchor = rows.agg(F.max("article_day").alias("anchor_day"))  # one row
    recent = lambda age: age <= recent_days - 1
    previous = lambda age: (age > recent_days - 1) & (age <= recent_days + previous_days - 1)
    # One row for each keyword and article first, so that articles are counted without keeping sets of them.
    each = rows.groupBy("keyword", "news_id").agg(
        F.max("display_keyword").alias("display_keyword"),
        F.sum("frequency").alias("frequency"),
        F.sum(F.col("final_score").cast(SUM)).alias("strength"),
        F.collect_set("article_day").alias("days"),
    )
    ages = F.transform("days", lambda d: F.datediff("anchor_day", d))
    return (
        each.crossJoin(F.broadcast(anchor))
        .withColumn("ages", ages)
        .groupBy("keyword")
        .agg(
            F.max("display_keyword").alias("display_keyword"),
            F.count("*").alias("total_articles"),
            F.sum("frequency").alias("total_frequency"),
            F.sum("strength").cast("double").alias("keyword_strength"),
            F.count_if(F.exists("ages", recent)).alias("recent_articles"),
            F.count_if(F.exists("ages", previous)).alias("previous_articles"),
            F.max(F.array_max("ages")).cast("long").alias("age_days"),
            F.max("anchor_day").alias("anchor_day"),
        )
        .where(F.col("total_articles") >= within(min_articles, 1, 100, "min_articles"))
    )


def score(aggregated: DataFrame) -> DataFrame:
    """aggregated with its scores; strength is relative to the strongest keyword."""
    most = aggregated.agg(F.max("keyword_strength").alias("most"))  # one row
    recent, previous = F.col("recent_articles"), F.col("previous_articles")
    rows = aggregated.crossJoin(F.broadcast(most)).withColumns(
        {
            "strength_score": scores.strength_score(F.col("keyword_strength"), F.col("most")),
            "momentum_score": scores.momentum_score(recent, previous),
            "recency_score": scores.recency_score(F.col("age_days")),
            "growth_percent": scores.growth_percent(recent, previous),
            "growth_label": scores.growth_label(recent, previous),
        }
    )
    return rows.drop("most").withColumn("trend_score", scores.trend_score(F.col("strength_score"), F.col("momentum_score"), F.col("recency_score")))


def trends(keywords: DataFrame, news: DataFrame, filters: Filters = Filters(), keyword: str | None = None, recent_days: int = 3, previous_days: int = 3, min_articles: int = 2) -> DataFrame:
    """Every keyword of at least min_articles articles, scored."""
    return score(aggregate(base(keywords, news, filters, keyword), recent_days, previous_days, min_articles))


def top_trends(scored: DataFrame, limit: int = 20) -> DataFrame:
    """The best trends; ties by keyword."""
    return scored.orderBy(*map(F.desc, ("trend_score", "recent_articles", "total_articles", "keyword_strength")), "keyword").limit(within(limit, 1, 100, "limit"))
