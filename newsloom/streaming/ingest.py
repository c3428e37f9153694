"""Continuous ingest: items arrive as files, late repeats are dropped within a watermark, each batch is decided and stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.functions.urls import content_hash, normalize_url
from newsloom.operators import existence
from newsloom.operators.dedup import insert_status
from newsloom.operators.ingest import counters, write_counted
from newsloom.session import list_path, materialize, scratch_scope

SCHEMA = "url string, title string, content string, source string, published_at timestamp"
STORED = SCHEMA + ", content_hash string, batch long"


def read_items(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def unique_items(items: DataFrame, late: str = "1 day") -> DataFrame:
    """Items with a normalised address, the first of each address within the watermark."""
    return items.withColumn("url", normalize_url(F.col("url"))).withWatermark("published_at", late).dropDuplicatesWithinWatermark(["url"])


def store_batches(path: str, index: str | None = None, status: str | None = None) -> Callable[[DataFrame, int], None]:
    """What a stream does with each batch: new articles are stored under the batch's number, so a batch that is repeated replaces itself.

    What is stored is looked up in the existence index (at path-known unless index is given), so a batch reads no history but the folders that its keys
    need. A table without an index gets one. What became of a batch's articles is counted in the job that writes them; the counts are a row for each batch at
    path-status unless status is given. ValueError where batches of a later number are stored, which another checkpoint has written.
    """
    index = index or f"{path.rstrip('/')}-known"
    status = status or f"{path.rstrip('/')}-status"

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with scratch_scope(spark):
            numbers = [int(n.removeprefix("batch=")) for n in list_path(spark, path) if n.startswith("batch=")]
            if max(numbers, default=-1) > number:
                raise ValueError(f"{path} has batch {max(numbers)}, so batch {number} is another stream's")
            if any(n < number for n in numbers) and not existence.runs(spark, index):
                stored = spark.read.schema(STORED).parquet(path).where(F.col("batch") < number)
                existence.append(stored, index, number - 1, first=0)
            existence.merge(spark, index, number)
            rows = batch.withColumn("pos", F.struct("published_at", "url")).withColumn("content_hash", content_hash(F.col("title"), F.col("content")))
            rows = materialize(rows, "items")  # a batch is computed once
            decided = insert_status(rows, existence.known(rows, index, number)).withColumnRenamed("status", "fate").withColumn("content_source", F.lit("rss_fallback"))
            counts = write_counted(decided, f"{path}/batch={number}", F.col("fate") == "CREATED", drop=("fate", "pos", "content_source"))
            counters(spark, counts).write.mode("overwrite").parquet(f"{status}/batch={number}")
            existence.append(spark.read.schema(STORED).parquet(f"{path}/batch={number}"), index, number)

    return store


def run(items: DataFrame, path: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Start the ingest: every so many seconds, or once over what there is."""
    w = unique_items(items).writeStream.foreachBatch(store_batches(path)).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and values for each type and window; for streams and tables alike."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value")
