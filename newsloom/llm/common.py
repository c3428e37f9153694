"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import bounded_batches  # noqa: F401

#: Words of the contracts: runs without the ASCII space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def packed(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(row, none, id, key): docs' rows as structs, so that no name of theirs clashes, with what names a document: its id, and its text's hash."""
    return docs.select(F.struct("*").alias("row"), F.isnull(id_column).alias("none"), F.coalesce(F.col(id_column), F.lit(0)).alias("id"), F.xxhash64("text").alias("key"))


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores, whichever df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
