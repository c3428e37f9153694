"""Near-duplicate groups by SimHash, searched with pivot distance tables.

A fingerprint has 64 bits by majority over the XXH64 of the word shingles. Documents with one
fingerprint are one class, so the search is over distinct fingerprints.

The table holds each fingerprint's Hamming distances to many reference fingerprints (pivots): zero,
and for each of BLOCKS blocks of bits the one with just these bits set. By the triangle inequality, fingerprints
within radius differ by at most radius in every distance, and in what any two distances tell together: the
distances to zero and to a block's pivot give the block's count of set bits, and the blocks' counts
differ by at most radius in total. So if the blocks are dealt into groups, the counts agree in all but
radius of them at least, and only fingerprints that agree in some such choice of groups need be
compared: an equi-join over choices of groups. There are four groups, or eight for so many fingerprints that
choices of two of four would be crowded. Of the pairs it meets, those whose largest difference of
distances is above radius are discarded, and the Hamming distance verifies the rest.

A choice of groups that more than `crowd` fingerprints share would make too many pairs. Its fingerprints
are linked in another exact way: two fingerprints within 2 bits have a point within 1 bit of both, so
each names the 65 points around it, and those that name one point are linked in a star. No point has
more than 65 of them.

Cases: a null text has no words, and no words give the fingerprint zero, which links like any other;
fewer words than a shingle are one shingle; null identifiers belong to their group, whose id is the
least that is not null; repeated rows are in one class; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import bounded_batches, packed
from newsloom.operators.graph import connected_components
from newsloom.session import materialize

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LANES = np.uint64(0x0101010101010101)
BLOCKS, RADIUS = 32, 2


def shingle_hashes(text: str, words: int = 3, seed: int = 42) -> np.ndarray:
    """The XXH64 of each shingle of text, repeats included."""
    tokens = text.encode().translate(LOWER).split()
    if not tokens:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(b" ".join(tokens), seed)], np.uint64)
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    return np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(tokens) - words + 1)


def simhash(hashes: np.ndarray) -> int:
    """The bits that are set in over half of hashes, as a signed 64-bit integer.

    Eight counters of a byte share a word; they are emptied before they can overflow.
    """
    n = len(hashes)
    if not n:
        return 0
    starts = np.arange(0, n, 255)
    bits = np.empty((8, 8), np.int64)
    for i in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(i)) & LANES, starts)
        bits[:, i] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    set_ = (2 * bits > n).reshape(64)
    return int(np.packbits(set_, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_column: str = "doc_id") -> DataFrame:
    """(id, key, fp) for each document; key tells texts with one id apart."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.fromiter((simhash(shingle_hashes(t or "", words, seed)) for t in map(pa.StringScalar.as_py, b.column("text"))), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), pa.array(out)], ["id", "key", "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.xxhash64("text").alias("key"), "text").mapInArrow(run, f"id {kind}, key long, fp long")


def pivots() -> list[int]:
    """The reference fingerprints, as signed integers: zero, and one for each block."""
    width = 64 // BLOCKS
    masks = [((1 << width) - 1) << (width * b) for b in range(BLOCKS)]
    return [0] + [m - (1 << 64) if m >> 63 else m for m in masks]


def distance_table(fps: DataFrame) -> DataFrame:
    """fps (fp) with distances, the Hamming distance to each pivot."""
    return fps.select("fp", F.array(*(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte") for p in pivots())).alias("distances"))


def choices(groups: int) -> Column:
    """For each choice of all but RADIUS of groups: its number, and the blocks' counts in these groups.

    A block's count of set bits is half of the distance to zero plus the width less the distance to its pivot.
    """
    width, per = 64 // BLOCKS, BLOCKS // groups
    zero = F.col("distances")[0]
    count = [((zero + F.lit(width) - F.col("distances")[b + 1]) / 2).cast("long") for b in range(BLOCKS)]
    packed = []
    for g in range(groups):
        group = F.lit(0).cast("long")
        for c in count[g * per : (g + 1) * per]:
            group = group * (width + 1) + c
        packed.append(group)
    size = (width + 1) ** per
    keys = []
    for n, chosen in enumerate(combinations(range(groups), groups - RADIUS)):
        key = F.lit(n).cast("long")
        for g in chosen:
            key = key * size + packed[g]
        keys.append(key)
    return F.array(*keys)


def near_pairs(fps: DataFrame, crowd: int = 256, groups: int | None = None) -> DataFrame:
    """(left, right): links between distinct fingerprints within RADIUS bits, enough of them to join all that are linked."""
    # Two of four groups tell 2^24 kinds of fingerprints apart, six of eight 2^36.
    groups = groups or (4 if fps.count() < 1 << 28 else 8)
    spread = materialize(distance_table(fps).withColumn("choice", F.explode(choices(groups))), "pivots")
    counts = materialize(spread.groupBy("choice").count().where("count > 1"), "choices")
    few = spread.join(counts.where(F.col("count") <= crowd).select("choice"), "choice")
    a, b = few.alias("a"), few.alias("b")
    furthest = F.array_max(F.zip_with("a.distances", "b.distances", lambda x, y: F.abs(x - y)))
    met = (F.col("a.choice") == F.col("b.choice")) & (F.col("a.fp") < F.col("b.fp"))
    verified = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS
    pairs = a.join(b, met & (furthest <= RADIUS) & verified).select(F.col("a.fp").alias("left"), F.col("b.fp").alias("right"))

    crowded = spread.join(counts.where(F.col("count") > crowd).select("choice"), "choice", "left_semi").select("fp").distinct()
    bits = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    points = crowded.withColumn("point", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(x)) for x in bits))))
    stars = points.groupBy("point").agg(F.min("fp").alias("left"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return pairs.unionAll(stars.select("left", F.explode("all").alias("right")).where("left <> right"))


def components(docs: DataFrame, words: int = 3, seed: int = 42, id_column: str = "doc_id") -> DataFrame:
    """(id, key, fp, component_id) for each document."""
    prints = materialize(fingerprints(docs, words, seed, id_column), "fingerprints")
    return grouped(prints, lambda p: near_pairs(p.select("fp").distinct()))


def grouped(prints: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, key, fp, component_id) for each of prints, whose fps links(prints) joins."""
    classes = materialize(prints.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    labels = connected_components(links(prints))
    labelled = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    of = materialize(labelled.join(least, "component").select("fp", "component_id"), "of")  # plain tables: Spark can split a hot fingerprint's partition
    return prints.join(of, "fp").select("id", "key", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, id_column: str = "doc_id") -> DataFrame:
    """(id, fingerprint, component_id): the least id that is reachable, for each document."""
    return components(docs, words, seed, id_column).select(F.col("id").alias(id_column), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, id_column: str = "doc_id") -> DataFrame:
    """docs with one document of each group, that with the least id (and then the least text hash)."""
    return drop_groups(docs, components(docs, words, seed, id_column), id_column)


def drop_groups(docs: DataFrame, groups: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """docs with one document of each of groups (id, key, component_id); of rows repeated with its id and text one.

    Only identifiers and hashes of the documents that go are joined.
    """
    found = materialize(groups.groupBy("id", "key", "component_id").agg(F.count("*").alias("n")), "components")
    least = found.groupBy("component_id").agg(F.min(F.struct(F.isnull("id").alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "key")).alias("stays"))
    found = found.select(F.isnull("id").alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "key", "component_id", "n").join(least.withColumnRenamed("component_id", "of"), F.col("component_id").eqNullSafe(F.col("of")))
    names = ["none", "id", "key"]
    found = materialize(found.select(*names, "n", (F.struct(*names) == F.col("stays")).alias("stays")), "fates")
    rows = packed(docs, id_column).join(found.where("not stays").select(*names), names, "left_anti")
    again = found.where("stays and n > 1").select(*names)
    if not again.isEmpty():
        rows = rows.join(again, names, "left_anti").unionByName(rows.join(again, names, "left_semi").dropDuplicates(names))
    return rows.select("row.*")
