"""Substring search through an inverted index of trigrams, instead of a scan of all values.

The index is a stored table (bucket, gram, key), a folder for each bucket of grams, sorted by gram; a key is a value's hash, so that a value's trigrams
don't repeat the value. A search reads the buckets of the trigrams that its pattern fixes, takes the keys that have all of them, and verifies the pattern on the rows with these;
values that share a key are told apart there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import scratch_path

SIZE, BUCKETS = 3, 64


def grams(text: Column) -> Column:
    """The different runs of SIZE characters of text, in lower case; none if it is shorter."""
    chars = F.split(F.lower(text), "")  # a run is put together of its neighbours; a substring would be looked for from the text's start
    size, runs = F.length(F.lower(text)), chars
    for k in range(1, SIZE):
        runs = F.zip_with(runs, F.slice(chars, k + 1, size), lambda a, b: F.concat(a, b))
    return F.when(size >= SIZE, F.array_distinct(F.slice(runs, 1, size - SIZE + 1))).otherwise(F.array().cast("array<string>"))


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build(values: DataFrame, column: str, path: str | None = None) -> str:
    """Write the index of the different values of a column (nulls have none); the path that it is at."""
    path = path or scratch_path(values.sparkSession, "trigrams")
    rows = values.select(F.col(column).alias("value")).where("value is not null").distinct().withColumn("key", F.xxhash64("value"))
    rows = rows.select(F.explode(grams(F.col("value"))).alias("gram"), "key").withColumn("bucket", bucket(F.col("gram")))
    # By a rebalance, Spark splits the bucket of a common gram into several tasks and files; a search reads all of a bucket's.
    rows = rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "gram")
    rows.write.partitionBy("bucket").mode("overwrite").parquet(path)
    return path


def fixed_grams(spark: SparkSession, pattern: str) -> list[tuple[int, str]]:
    """(bucket, gram) of the trigrams that every match of a LIKE pattern has: those between its wildcards. A backslash takes the next character as it is."""
    parts, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            parts[-1] += pattern[at]
        elif c in "%_":
            parts.append("")
        else:
            parts[-1] += c
        at += 1
    found = spark.createDataFrame([(p,) for p in parts], "p string").select(F.explode(grams(F.col("p"))).alias("gram")).distinct()
    return sorted((r[0], r[1]) for r in found.select(bucket(F.col("gram")), "gram").collect())


def candidates(spark: SparkSession, path: str, wanted: list[tuple[int, str]]) -> DataFrame:
    """(key): keys of values with all wanted grams, among others whose grams are so between values of one key; only their buckets are read."""
    schema = "gram string, key long, bucket int"
    rows = spark.read.schema(schema).parquet(path).where(F.col("bucket").isin(sorted({b for b, _ in wanted})) & F.col("gram").isin([g for _, g in wanted]))
    return rows.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") >= len(wanted)).select("key")


def search(values: DataFrame, column: str, pattern: str, path: str) -> DataFrame:
    """The rows of values whose column is like pattern, in any case; by the index at path. A pattern that fixes no trigram scans."""
    like = F.col(column).ilike(pattern)
    wanted = fixed_grams(values.sparkSession, pattern)
    if not wanted:
        return values.where(like)
    found = candidates(values.sparkSession, path, wanted).withColumnRenamed("key", "_key")
    return values.join(found, F.xxhash64(column) == F.col("_key"), "left_semi").where(like)
