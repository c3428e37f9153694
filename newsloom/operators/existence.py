"""Which addresses and contents are stored already, without reading all that is stored.

The index of a table is a folder of runs, each named by the batches that it covers. A run has its keys (kind, key, hash) in folders by the first
bits of the hash, as many as keep a folder at CAPACITY keys, and a Bloom filter of them, a table of words (slot, bits) in the same folders: a key's word is
named by the first bits of its hash and has four bits set by the last ones. A batch reads the words of the folders that its keys fall in, and then the keys
of the folders that have a key which its word lets through. Before every FANOUT-th batch the runs of the last FANOUT become one, as digits carry, so there
are fewer than FANOUT runs for each power of FANOUT that the batches reach, and a key is written once for each power.

A run counts once its words are written, and replaces the narrower runs within it; a writer that dies leaves the old ones. A null is a key like any other.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import is_written, list_path, materialize, remove_path

COLUMNS = ("url", "content_hash")
#: Keys in a folder, runs that become one, and bits of the hash that name folders at most (beyond them folders grow).
CAPACITY, FANOUT, MOST_DEPTH = 1 << 20, 8, 12
KEY, WORD = "kind string, key string, hash long, bucket int", "slot long, bits long, bucket int"


class Run(NamedTuple):
    """Batches first to last, in 2^depth folders of keys and 2^size words."""

    first: int
    last: int
    depth: int
    size: int

    def path(self, root: str) -> str:
        return f"{root}/{'-'.join(map(str, self))}"


def _prefix(bits: int) -> Column:
    """The first bits of the hash, as a number."""
    return F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long")


def _mask() -> Column:
    """The four bits of a key in its word, from the 24 last of its hash."""
    return F.expr(" | ".join(f"shiftleft(1L, cast(shiftright(hash, {6 * i}) & 63 AS int))" for i in range(4)))


def keys_of(rows: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(kind, key, hash): the different values of the columns."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("key")) for c in columns)))
    return rows.select(each.alias("k")).select("k.*").distinct().withColumn("hash", F.xxhash64("kind", "key"))


def _named(spark: SparkSession, root: str) -> list[Run]:
    """All runs at root, also those that are not whole."""
    return [Run(*map(int, name.split("-"))) for name in list_path(spark, root)]


def runs(spark: SparkSession, root: str) -> list[Run]:
    """The runs that count, in order."""
    whole = [r for r in _named(spark, root) if is_written(spark, f"{r.path(root)}/words")]
    wider = lambda a, b: b.first <= a.first and a.last <= b.last and b[:2] != a[:2]
    return sorted(r for r in whole if not any(wider(r, q) for q in whole))


def _write(keys: DataFrame, root: str, first: int, last: int, capacity: int) -> None:
    spark = keys.sparkSession
    n = keys.count()
    for old in _named(spark, root):
        if old[:2] == (first, last):
            remove_path(spark, old.path(root))
    if not n:
        return
    depth = min(MOST_DEPTH, ((n - 1) // capacity).bit_length())
    run = Run(first, last, depth, max(depth, ((n - 1) // 4).bit_length()))  # two to four keys a word
    # By a rebalance, a large folder is made by several tasks.
    placed = keys.select("kind", "key", "hash", _prefix(depth).cast("int").alias("bucket")).hint("rebalance", F.col("bucket"))
    placed.sortWithinPartitions("bucket", "hash").write.partitionBy("bucket").parquet(f"{run.path(root)}/keys")
    words = spark.read.schema(KEY).parquet(f"{run.path(root)}/keys").groupBy("bucket", _prefix(run.size).alias("slot")).agg(F.bit_or(_mask()).alias("bits"))
    words.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "slot").write.partitionBy("bucket").parquet(f"{run.path(root)}/words")


def append(rows: DataFrame, root: str, number: int, first: int | None = None, columns: tuple[str, ...] = COLUMNS, capacity: int = CAPACITY) -> None:
    """Add the keys of rows as batch number (or as batches first to number). A batch that is repeated replaces itself. ValueError if later ones are there."""
    first = number if first is None else first
    if later := [r for r in runs(rows.sparkSession, root) if r.last >= first and r[:2] != (first, number)]:
        raise ValueError(f"batches to {later[-1].last} are in the index, so {first} can't be added")
    keys = materialize(keys_of(rows, columns), "index-keys")
    _write(keys, root, first, number, capacity)
    remove_path(rows.sparkSession, keys.scratch)


def merge(spark: SparkSession, root: str, number: int, fanout: int = FANOUT, capacity: int = CAPACITY) -> None:
    """Before batch number: the runs of the last fanout batches, or of the last power of it that divides number, become one. Narrower runs are deleted."""
    span = 1
    while number and number % (span * fanout) == 0:
        span *= fanout
    inside = [r for r in runs(spark, root) if number - span <= r.first and r.last < number]
    if len(inside) > 1:
        parts = [spark.read.schema(KEY).parquet(f"{r.path(root)}/keys").drop("bucket") for r in inside]
        _write(reduce(DataFrame.unionAll, parts), root, number - span, number - 1, capacity)
    counting = runs(spark, root)
    for r in _named(spark, root):
        if r not in counting and r.last < number:
            remove_path(spark, r.path(root))


def _read(spark: SparkSession, path: str, schema: str, buckets: list[int], depth: int) -> DataFrame:
    df = spark.read.schema(schema).parquet(path)
    return df if len(buckets) == 1 << depth else df.where(F.col("bucket").isin(buckets))


def known(batch: DataFrame, root: str, number: int | None = None, columns: tuple[str, ...] = COLUMNS) -> dict[str, DataFrame]:
    """For each column the values of batch that the index has, in one column of its name: of batches before number, or of all.

    The driver sees the numbers of folders only, at most 2^MOST_DEPTH for each run.
    """
    spark = batch.sparkSession
    past = [r for r in runs(spark, root) if number is None or r.last < number]
    keys = materialize(keys_of(batch, columns), "batch-keys")
    if not past:
        return {c: keys.where("false").select(F.col("key").alias(c)) for c in columns}
    most = max(r.depth for r in past)
    touched = {r[0] for r in keys.select(_prefix(most)).distinct().collect()}
    let_through = []
    for i, r in enumerate(past):
        words = _read(spark, f"{r.path(root)}/words", WORD, sorted({t >> (most - r.depth) for t in touched}), r.depth)
        asked = keys.withColumn("slot", _prefix(r.size)).withColumn("mask", _mask())
        let_through.append(words.join(asked, "slot").where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select(F.lit(i).alias("run"), "bucket", "kind", "key", "hash"))
    suspects = materialize(reduce(DataFrame.unionAll, let_through), "suspects")
    folders: dict[int, list[int]] = {}
    for i, b in suspects.select("run", "bucket").distinct().collect():
        folders.setdefault(i, []).append(b)
    found = [keys.where("false").select("kind", "key")]
    for i, buckets in folders.items():
        stored = _read(spark, f"{past[i].path(root)}/keys", KEY, sorted(buckets), past[i].depth).select("hash", "kind", F.col("key").alias("stored"))
        asked = suspects.where(F.col("run") == i).select("kind", "key", "hash")
        found.append(asked.join(stored, ["hash", "kind"]).where(F.col("key").eqNullSafe(F.col("stored"))).select("kind", "key"))
    have = materialize(reduce(DataFrame.unionAll, found).distinct(), "known")
    return {c: have.where(F.col("kind") == c).select(F.col("key").alias(c)) for c in columns}
