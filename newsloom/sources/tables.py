"""The views that the queries read, from plain tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import scores
from newsloom.operators import grams
from newsloom.session import is_written, materialize, release, written

#: Where stored tables are, by application, folder and parameters.
_stored: dict[tuple, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as news: the language as category, times made of the identifier."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("https://news.example/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.substring_index("text", ".", 1).alias("title"),
        F.col("text").alias("content"),
        F.when(F.col("n_chars") >= 500, "fulltext").otherwise("rss_fallback").alias("content_source"),
        "source",
        F.col("lang").alias("category"),
        (F.col("n_chars").cast("double") / 1000).alias("decision_score"),
        F.expr("CASE WHEN doc_id % 10 = 0 THEN NULL ELSE timestampadd(HOUR, cast(doc_id * 7 % 720 as int), timestamp_ntz'2024-01-01 00:00:00') END").alias("published_at"),
        F.expr("timestampadd(HOUR, cast(doc_id % 48 as int), timestamp_ntz'2024-01-31 00:00:00')").alias("crawled_at"),
    )


def make_keyword_occurrences(spark: SparkSession, sf_dir: str, per_article: int = 10) -> DataFrame:
    """The best keywords of each document by TF-IDF, of tokens of at least five characters.

    Blocks of documents get their tokens' document frequencies (operators/grams.py) and hand on only what can be among a document's best, so that neither a
    join nor a window has a row for each token.
    """
    d = read(spark, sf_dir, "documents")
    n, buckets = d.count(), grams.buckets_of(d, "text")
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.length(w) >= 5)
    blocks = materialize(grams.packed_blocks(grams.dealt(d, buckets, "doc_id", "text", {grams.WRITTEN: words})), "blocks")

    def best(block: grams.Block, sums: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        (_, at, gram, first), df = block.levels()[0], sums[0]
        pair, tf = np.unique(block.doc[at] * len(first) + gram, return_counts=True)
        kept = df[pair % max(1, len(first))] <= 0.9 * n
        pair, tf = pair[kept], tf[kept]
        doc, gram = pair // max(1, len(first)), pair % max(1, len(first))
        score = (1 + np.log(tf)) * (np.log((1.0 + n) / (1.0 + df[gram])) + 1)
        order = np.lexsort((gram, -score, doc))
        doc, gram, tf, score = doc[order], gram[order], tf[order], score[order]
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        sizes = np.diff([*starts, len(doc)])
        least = np.repeat(score[starts + np.minimum(sizes, per_article) - 1], sizes) if len(doc) else score
        # Scores are rounded to 9 places before they are ranked. Of equal scores, only the first keywords can be among the best.
        like = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(score, prepend=-1) != 0))
        place = np.arange(len(doc)) - np.repeat(like, np.diff([*like, len(doc)]))
        kept = (score >= least - 1e-8) & (place < per_article)
        gram = gram[kept]
        yield from grams.in_pieces([block.ids.take(pa.array(doc[kept])), block.spelt(1, first).take(pa.array(gram)), pa.array(tf[kept]), pa.array(df[gram])], ["news_id", "keyword", "frequency", "df"])

    found = grams.met(blocks, [grams.WRITTEN], buckets, ["df"], best, f"news_id {dict(d.dtypes)['doc_id']}, keyword string, frequency long, df long", longest=1)
    scored = found.withColumn("final_score", F.round(scores.tf(F.col("frequency")) * scores.idf(F.lit(n), F.col("df")), 9))
    rank = F.row_number().over(Window.partitionBy("news_id").orderBy(F.desc("final_score"), "keyword"))
    rows = scored.withColumn("rank", rank).where(F.col("rank") <= per_article)
    out = materialize(rows.select("news_id", "keyword", F.col("keyword").alias("display_keyword"), "frequency", "final_score"), "keyword-occurrences")
    release(blocks)
    return out


def keyword_occurrences(spark: SparkSession, sf_dir: str, per_article: int = 10) -> DataFrame:
    """The stored table of keywords: made once for an application and what is in a folder, and read by every query after. Documents that were written anew make a new one."""
    key = spark.sparkContext.applicationId, sf_dir, per_article, written(spark, f"{sf_dir}/documents.parquet")
    if key not in _stored or not is_written(spark, _stored[key]):
        _stored[key] = make_keyword_occurrences(spark, sf_dir, per_article).scratch
    return spark.read.parquet(_stored[key])


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ground_truth, prediction, margin, correct), made of the identifier."""
    d = read(spark, sf_dir, "documents")
    following = F.create_map(*(F.lit(x) for x in ("en", "de", "de", "fr", "fr", "es", "es", "en")))
    p = d.select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("ground_truth"), F.when(F.col("doc_id") % 7 == 0, following[F.col("lang")]).otherwise(F.col("lang")).alias("prediction"), F.expr("(doc_id * 37 % 100) / cast(100 as double)").alias("margin"))
    return p.withColumn("correct", F.col("ground_truth") == F.col("prediction"))
