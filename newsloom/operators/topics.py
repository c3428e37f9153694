"""Hot topics: components of the graph of keywords that share articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import scores
from newsloom.operators.filters import Filters, within
from newsloom.operators.graph import connected_components
from newsloom.operators.trends import occurrences, trends
from newsloom.session import materialize


def relations(keywords: DataFrame, news: DataFrame, trending: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Distinct (keyword, news_id) of trending keywords in dated articles."""
    rows = occurrences(keywords, news, filters.only_dated())
    return rows.join(trending.select("keyword"), "keyword", "left_semi").select("keyword", "news_id").distinct()


def edges(relations: DataFrame, min_overlap: int = 2, min_jaccard: float = 0.20) -> DataFrame:
    """(left, right, overlap, jaccard) of keywords that share articles.

    Pairs are made within an article only, and an article has at most as many keywords as are
    stored for one; so there are no more pairs than that bound times the rows.
    """
    relations = materialize(relations, "relations")  # read three times
    sizes = relations.groupBy("keyword").agg(F.count("*").alias("size"))
    left, right = relations.select(F.col("keyword").alias("left"), "news_id"), relations.select(F.col("keyword").alias("right"), "news_id")
    pairs = left.join(right, "news_id").where("left < right").groupBy("left", "right").agg(F.count("*").alias("overlap")).where(F.col("overlap") >= min_overlap)
    sized = pairs.join(sizes.select(F.col("keyword").alias("left"), F.col("size").alias("n_left")), "left").join(sizes.select(F.col("keyword").alias("right"), F.col("size").alias("n_right")), "right")
    sized = sized.withColumn("jaccard", scores.jaccard(F.col("overlap"), F.col("n_left"), F.col("n_right")))
    return sized.where(F.col("jaccard") >= min_jaccard).select("left", "right", "overlap", "jaccard")


def topics(components: DataFrame, scored: DataFrame, min_keywords: int = 2) -> DataFrame:
    """A row for each component of at least min_keywords trending keywords. Its keywords are one array: a topic has no more than there are trending keywords."""
    members = components.select(F.col("node").alias("keyword"), "component").join(scored.select("keyword", "display_keyword", "trend_score", "total_articles"), "keyword")
    best = F.struct((-F.col("trend_score")).alias("a"), (-F.col("total_articles")).alias("b"), F.col("keyword").alias("keyword"), F.col("display_keyword").alias("display"))
    rows = members.groupBy("component").agg(
        F.sort_array(F.collect_list(best)).alias("ranked"),
        F.count("*").alias("keyword_count"),
        F.max("trend_score").alias("max_trend_score"),
        F.avg("trend_score").alias("topic_strength"),
        F.max("total_articles").alias("article_volume"),
    )
    return rows.where(F.col("keyword_count") >= min_keywords).select(
        F.col("ranked")[0]["display"].alias("label"), F.transform("ranked", lambda r: r["keyword"]).alias("keywords"), "keyword_count", "max_trend_score", "topic_strength", "article_volume"
    )


def rank_topics(rows: DataFrame, limit: int = 10) -> DataFrame:
    return rows.orderBy(F.desc("topic_strength"), F.desc("keyword_count"), F.desc("article_volume"), "label").limit(within(limit, 1, 50, "limit"))


def hot_topics(keywords: DataFrame, news: DataFrame, filters: Filters = Filters(), recent_days: int = 3, previous_days: int = 3, min_articles: int = 2, limit: int = 10) -> DataFrame:
    """The strongest topics among the trending keywords."""
    scored = materialize(trends(keywords, news, filters, None, recent_days, previous_days, min_articles), "trends")
    found = connected_components(edges(relations(keywords, news, scored, filters)))
    return rank_topics(topics(found, scored), limit)
