"""Readers and writers of files, and the cache of tokenised texts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from newsloom.functions.pages import decode_bytes, parse_feed
from newsloom.functions.text import STOPWORDS, strip, tokens

ITEM = "url string, title string, content string, published_at timestamp"
TEXT_COLUMNS = "id string, title string, content string, label string, url string"


def read_csv(spark: SparkSession, path: str, schema: str = TEXT_COLUMNS) -> DataFrame:
    """A CSV with a header, quoted line breaks and perhaps a byte order mark; columns by name, missing ones are left out."""
    options = {"header": True, "multiLine": True, "escape": '"', "encoding": "UTF-8"}
    head = [c.lstrip("﻿") for c in spark.read.options(**options).csv(path).columns]
    raw = spark.read.options(**options).csv(path).toDF(*head)
    kinds = dict(f.strip().split(" ", 1) for f in schema.split(","))
    return raw.select(*(F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in head))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_splits(df: DataFrame, path: str) -> None:
    """Parquet by split, so that a reader of one split reads no other."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def replace(df: DataFrame, path: str) -> None:
    """The table at path becomes df."""
    df.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str, **jdbc: str) -> DataFrame:
    """Parquet, or a database table if jdbc options are given."""
    return spark.read.format("jdbc").options(**jdbc).load() if jdbc else spark.read.parquet(path)


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """(path, data) of landed feed files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("data"))


def feed_items(files: DataFrame, source: str | None = None) -> DataFrame:
    """Items of feeds in column data (bytes, or a string); a feed that is no XML has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [i for d in b["data"] for i in parse_feed(d if isinstance(d, str) else decode_bytes(d))]
            out = pd.DataFrame(rows, columns=["url", "title", "content", "published_at"])
            yield out.assign(published_at=pd.to_datetime(out.published_at, utc=True, errors="coerce"))

    return files.select("data").mapInPandas(run, ITEM).withColumn("source", F.lit(source))


#: Bytes of a response that is read, at most.
MOST_BYTES = 10 << 20


def fetch(rows: DataFrame, get: Callable[[str], str | tuple], retries: int = 3, backoff: float = 1.0, longest: float = 8.0, most_chars: int | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """rows (with url) and page: what get(url) gives, whole unless most_chars is given; null where it fails to the end, or is larger than most_bytes.

    get runs on the executors. It raises on failure, or gives the page, or (status, page) or (status, page, seconds to wait). 429 and 5xx are
    tried again, other statuses from 400 on are not. Failures are waited after: as long as asked for (also by an exception's retry_after), else the waits
    double up to longest.
    """

    def attempt(url: str) -> tuple[int, str | None, float | None]:
        try:
            found = get(url)
        except Exception as e:
            return 599, None, getattr(e, "retry_after", None)
        return (*found, None)[:3] if isinstance(found, tuple) else (200, found, None)

    def one(url: str) -> str | None:
        for n in range(retries + 1):
            status, page, wait = attempt(url)
            if status < 400:
                size = 0 if page is None else len(page.encode() if isinstance(page, str) else page)
                return None if page is None or size > most_bytes else (page if isinstance(page, str) else decode_bytes(page))[:most_chars]
            if status != 429 and status < 500:
                return None
            if n < retries:
                time.sleep(min(longest, backoff * 2**n) if wait is None else wait)
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(page=[one(u) if u else None for u in b["url"]])

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("page", StringType())]))


def read_stopwords(spark: SparkSession, path: str, lines: bool = True, most: int = 100_000) -> list[str]:
    """Stopwords of a text file in lower case: one a line, without those that begin with # (lines), or all that white space separates.

    A file without any gives the extractor's own list in the second form, none in the first. ValueError for more than most words.
    """
    text = F.regexp_replace("value", "^\ufeff", "")
    word = spark.read.text(path).select((strip(text) if lines else F.explode(F.split(text, r"(?U)\s+"))).alias("w"))
    word = word.where((F.col("w") != "") & ~(F.lit(lines) & F.col("w").startswith("#"))).select(F.lower("w").alias("w")).distinct()
    found = sorted(r.w for r in word.limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"{path} has more than {most} words")
    return found if found or lines else list(STOPWORDS)


def write_token_cache(docs: DataFrame, path: str, version: str, id_column: str = "id", text: str = "text") -> None:
    """Tokens of each text as a JSON array, stamped with a version."""
    docs.select(id_column, F.to_json(tokens(F.coalesce(text, F.lit("")))).alias("tokenized_raw"), F.lit(version).alias("cache_version")).write.mode("overwrite").parquet(path)


def read_token_cache(docs: DataFrame, path: str, version: str, id_column: str = "id") -> DataFrame:
    """docs with their cached tokens. ValueError if the cache has another version, other identifiers or a null."""
    cache = docs.sparkSession.read.parquet(path)
    if not cache.where((F.col("cache_version") != version) | F.col("tokenized_raw").isNull()).isEmpty():
        raise ValueError("the token cache has another version, or nulls")
    for a, b in ((docs, cache), (cache, docs)):
        if not a.join(b.select(id_column), id_column, "left_anti").isEmpty():
            raise ValueError("the token cache has other documents")
    return docs.join(cache.select(id_column, F.from_json("tokenized_raw", "array<string>").alias("tokens")), id_column, "left")
