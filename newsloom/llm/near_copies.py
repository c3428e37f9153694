"""Near copies: all documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and what these link.

It is simhash's search on unfolded fingerprints. A 64-bit SimHash can't decide such pairs (at 0.8 the mean distance is about ten
bits, and no radius that holds all can be joined), so a fingerprint here has a bit for each of the 2^64 shingle hashes, and is
kept as the sorted list of its set bits. The Hamming distance of two is what their sets don't share, and
sets of a and b shingles are similar if it is at most (a + b) / 9.

The pivot distance table has the distances to the fingerprint zero (the number of shingles) and to one for each of PIVOTS
blocks of the bits (all of the block's set), less that one's own bits. By the triangle inequality these differ no more than two fingerprints do,
so pairs with a larger difference are discarded. Then folds are compared, FOLD words with the parities of that many bits' worth of
blocks: their Hamming distance is no more than that of the fingerprints either. The rest are verified by the intersection of their sets.

Pairs are met at their rare shingles (a prefix filter, which misses none): all fingerprints' bits are put in one order, those
that are common in a sample of the documents last; two similar sets share one of the first n // 5 + 1 bits of both.
How common a shingle is decides how many pairs are met, never which are found.

The fingerprints that share a bit are compared with a leader first, the one that shares most of its first bits with others, which joins a large group of
copies of one document without its square of pairs. Bits whose fingerprints are in one component then have nothing left to
find, and a leader that has met all of a bit's fingerprints is done there. If more pairs are left than grow with the corpus, the bits that a
fingerprint has alone are counted, which tells how much it can share with any other: those that can't reach the similarity go, and
further leaders follow as long as they join something. Then the pairs of different components that are left, and that their
distances allow, are verified. Documents with one set are one class.

Cases: a null text has no words, and texts without words are copies of each other; fewer words than a shingle are one shingle;
nulls and repeated rows are as in simhash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import bounded_batches
from newsloom.llm.simhash import drop_groups, grouped, shingle_hashes
from newsloom.operators.graph import connected_components
from newsloom.session import materialize, release

#: One in SAMPLE documents is counted; the COMMON commonest shingles go last, by their counts.
SAMPLE, COMMON, PIVOTS, FOLD = 16, 1 << 16, 8, 8
#: Further leaders follow while there are more than PAIRS pairs for each shared bit of a fingerprint; lists of at most FEW fingerprints (24 bytes each) are broadcast.
PAIRS, FEW = 8, 1 << 20


def lists(arrays: list[np.ndarray], kind: type) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, kind), *arrays]).astype(kind)))


def set_bits(text: str | None, words: int) -> tuple[int, np.ndarray]:
    """(a name of the set, the sorted hashes of its shingles)"""
    bits = np.unique(shingle_hashes(text or "", words).view(np.int64))
    return xxhash.xxh64_intdigest(bits.tobytes()) - (1 << 63), bits


def tables(docs: DataFrame, words: int = 5, common: tuple[np.ndarray, np.ndarray] | None = None, id_column: str = "doc_id") -> DataFrame:
    """(id, key, fp, n, pivots, fold, first) for each document: fp names its set, n and pivots are its distances, first are its rarest bits."""
    bounded_batches(docs.sparkSession)
    known, often = common if common and len(common[0]) else (np.array([0], np.int64), np.array([0], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, n, pivots, folds, first = [], [], [], [], []
            for text in map(pa.StringScalar.as_py, b.column("text")):
                fp, bits = set_bits(text, words)
                at = np.minimum(np.searchsorted(known, bits), len(known) - 1)
                order = np.argsort(np.where(known[at] == bits, often[at], 0), kind="stable")
                fps.append(fp)
                n.append(len(bits))
                pivots.append(len(bits) - 2 * np.bincount(bits & (PIVOTS - 1), minlength=PIVOTS))
                odd = np.bincount((bits >> 8) & (64 * FOLD - 1), minlength=64 * FOLD) & 1
                folds.append(np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8"))
                first.append(bits[order[: len(bits) // 5 + 1]])
            columns = [b.column("id"), b.column("key"), pa.array(fps, pa.int64()), pa.array(n, pa.int64()), lists(pivots, np.int32), lists(folds, np.int64), lists(first, np.int64)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "fp", "n", "pivots", "fold", "first"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64("text").alias("key"), "text")
    return rows.mapInArrow(run, f"id {kind}, key long, fp long, n long, pivots array<int>, fold array<long>, first array<long>")


def bits_of(texts: DataFrame, words: int) -> DataFrame:
    """texts (fp, text) to (fp, bits), where fp is the name of the text's set."""
    bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [set_bits(t, words) for t in map(pa.StringScalar.as_py, b.column("text"))]
            same = [i for i, (fp, own) in enumerate(zip(b.column("fp").to_pylist(), found, strict=True)) if fp == own[0]]
            yield pa.RecordBatch.from_arrays([b.column("fp").take(pa.array(same, pa.int32())), lists([found[i][1] for i in same], np.int64)], ["fp", "bits"])

    return texts.select("fp", "text").mapInArrow(run, "fp long, bits array<long>")


def common_shingles(docs: DataFrame, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of a sample of docs, and how often they occur in it."""
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([lists([set_bits(t, words)[1] for t in map(pa.StringScalar.as_py, b.column("text"))], np.int64)], ["bits"])

    found = sample.mapInArrow(run, "bits array<long>").select(F.explode("bits").alias("h")).groupBy("h").count().where("count > 1")
    found = sorted((r["h"], r["count"]) for r in found.orderBy(F.desc("count"), "h").limit(COMMON).collect())
    return np.array([h for h, _ in found], np.int64), np.array([c for _, c in found], np.int64)


def alike(a: Column, b: Column, differ: Column) -> Column:
    """Whether sets of a and b shingles that differ in so many have a similarity of 0.8 or more, in integers."""
    return differ * 9 <= a + b


def near(left: str, right: str) -> Column:
    """Whether the distances of two rows of the table, what they can share, and their folds allow the similarity."""
    c = lambda side, name: F.col(f"{side}.{name}")
    n, m = c(left, "n"), c(right, "n")
    furthest = F.greatest(F.abs(n - m), *(F.abs(c(left, "pivots")[i] - c(right, "pivots")[i]) for i in range(PIVOTS)))
    most = F.least(n - c(left, "own"), m - c(right, "own"))  # bits in common
    folds = reduce(Column.__add__, (F.bit_count(c(left, "fold")[i].bitwiseXOR(c(right, "fold")[i])) for i in range(FOLD)))
    return alike(n, m, furthest) & (most * 9 >= (n + m) * 4) & alike(n, m, folds)


def tagged(df: DataFrame, end: str) -> DataFrame:
    """df's columns as a struct of that name, beside what it is of."""
    return df.select(F.col("fp").alias(f"{end}_fp"), F.struct(*df.columns).alias(end))


class Search:
    """The tables of a search: rows (h, fp, rank), the first bits that fingerprints share, and sets, what is known of each fingerprint.

    rank grows with how many of a fingerprint's first bits are shared; the highest rank leads. It ends in bits of the fingerprint's name.
    """

    def __init__(self, prints: DataFrame, docs: DataFrame, words: int, id_column: str):
        self.docs, self.words, self.id_column = docs, words, id_column
        first = prints.select("fp", F.explode("first").alias("h"))
        several = materialize(first.groupBy("h").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("h"), "several")
        rows = materialize(first.join(several, "h").distinct(), "shared")
        weights = rows.groupBy("fp").agg(F.count("*").alias("k"))
        row = F.min(F.struct(F.isnull("id").alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "key")).alias("row")
        sets = prints.groupBy("fp").agg(*(F.first(c).alias(c) for c in ("n", "pivots", "fold")), row).join(weights, "fp")
        share = F.floor(F.col("k") * 127 / (F.floor(F.col("n") / 5) + 1))
        rank = F.shiftleft(share, 56).bitwiseOR(F.col("fp").bitwiseAND(F.lit((1 << 56) - 1)))
        self.sets = materialize(sets.select("fp", "n", "pivots", "fold", "row", rank.alias("rank"), F.lit(0).cast("long").alias("own"), F.col("fp").alias("component")), "sets")
        self.rows = materialize(rows.join(self.sets.select("fp", "rank"), "fp").select("h", "fp", "rank"), "rows")
        self.most, self.links = PAIRS * self.rows.count(), None
        release(several, rows)

    def bits(self, fps: DataFrame) -> DataFrame:
        """(fp, bits) of some fps, made again from their documents' texts."""
        wanted = materialize(self.sets.join(fps, "fp", "left_semi").select("fp", "row.*"), "wanted")
        n = wanted.count()
        few = F.broadcast(wanted) if n <= FEW else wanted
        texts = self.docs.select(F.isnull(self.id_column).alias("none"), F.coalesce(F.col(self.id_column), F.lit(0)).alias("id"), F.xxhash64("text").alias("key"), "text")
        found = materialize(bits_of(texts.join(few, ["none", "id", "key"]), self.words), "bits")
        release(wanted)
        if found.count() > n:  # some rows are repeated
            once = materialize(found.dropDuplicates(["fp"]), "bits")
            release(found)
            return once
        return found

    def verify(self, pairs: DataFrame) -> bool:
        """Add those of pairs (left, right) that are similar to the links; whether there are any."""
        pairs = materialize(pairs.distinct(), "met")
        bits = self.bits(pairs.select(F.explode(F.array("left", "right")).alias("fp")).distinct())
        # A list of pairs that may be broadcast spares the bits a shuffle: only those of each pair's right end, and of the left ends, are moved.
        few = F.broadcast if pairs.count() <= FEW else lambda df: df
        found = bits.select(F.col("fp").alias("right"), F.col("bits").alias("b_right")).join(few(pairs), "right")
        lefts = bits.join(few(pairs.select(F.col("left").alias("fp")).distinct()), "fp", "left_semi")
        found = found.join(lefts.select(F.col("fp").alias("left"), F.col("bits").alias("b_left")), "left")
        a, b = F.size("b_left"), F.size("b_right")
        found = materialize(found.where(alike(a, b, a + b - F.size(F.array_intersect("b_left", "b_right")) * 2)).select("left", "right"), "similar")
        release(pairs, bits)
        self.links = found if self.links is None else self.links.unionAll(found)
        return not found.isEmpty()

    def lead(self) -> bool:
        """Compare each bit's leader with its other fingerprints; whether some are similar. The leaders are done then."""
        lead = materialize(self.rows.groupBy("h").agg(F.max("rank").alias("top")), "leaders")
        others = self.rows.join(lead, "h").where("rank < top")
        met = others.select("top", "fp").distinct().join(tagged(self.sets, "r"), F.col("fp") == F.col("r_fp"))
        met = met.join(tagged(self.sets, "l"), F.col("top") == F.col("l.rank")).where((F.col("r.component") != F.col("l.component")) & near("r", "l"))
        found = self.verify(met.select(F.col("l.fp").alias("left"), F.col("r.fp").alias("right")))
        labels = connected_components(self.links)
        old = self.sets, self.rows
        sets = self.sets.drop("component").join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
        self.sets = materialize(sets, "sets")
        self.rows = materialize(others.select("h", "fp", "rank"), "others")
        release(*old, lead, labels)
        self.apart()
        return found

    def apart(self) -> None:
        """Only bits whose fingerprints are in several components are left in rows."""
        rows, old = self.rows.join(self.sets.select("fp", "component"), "fp"), self.rows
        several = rows.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("h")
        several = materialize(several, "several")
        self.rows = materialize(old.join(several, "h"), "apart")
        release(old, several)

    def pairs_left(self) -> int:
        """Pairs that share a bit and are in different components."""
        n = F.col("n").cast("double")
        each = self.rows.join(self.sets.select("fp", "component"), "fp").groupBy("h", "component").agg(F.count("*").alias("n"))
        each = each.groupBy("h").agg(F.sum(n).alias("n"), F.sum(n * n).alias("inside"))
        return int(each.agg(F.sum((n * n - F.col("inside")) / 2)).first()[0] or 0)

    def sort_out(self) -> None:
        """Count the bits that a fingerprint alone has; without those that have too many for any partner of a size that shares a bit with them."""
        all_bits = self.bits(self.rows.select("fp").distinct())
        own = all_bits.select("fp", F.explode("bits").alias("b")).groupBy("b").agg(F.count("*").alias("k"), F.min("fp").alias("fp"))
        own = materialize(own.where("k = 1").groupBy("fp").agg(F.count("*").alias("alone")), "own")
        old = self.sets, self.rows
        self.sets = materialize(self.sets.join(own, "fp", "left").withColumn("own", F.coalesce("alone", "own")).drop("alone"), "sets")
        rows = self.rows.join(self.sets.select("fp", "n", "own"), "fp")
        least = materialize(rows.groupBy("h").agg(F.min("n").alias("least")), "least")
        most = F.col("n") - F.col("own")
        able = most * 9 >= (F.col("n") + F.greatest("least", F.ceil(F.col("n") * 4 / 5))) * 4
        self.rows = materialize(rows.join(least, "h").where(able).select("h", "fp", "rank"), "able")
        release(*old, all_bits, own, least)
        self.apart()

    def rest(self) -> None:
        """Compare all pairs of different components that are left."""
        known = self.sets.select("fp", "n", "pivots", "fold", "own", "component")
        rows = materialize(self.rows.select("h", "fp").join(known, "fp"), "known")
        a, b = rows.alias("a"), rows.alias("b")
        apart = (F.col("a.h") == F.col("b.h")) & (F.col("a.fp") < F.col("b.fp")) & (F.col("a.component") != F.col("b.component"))
        self.verify(a.join(b, apart & near("a", "b")).select(F.col("a.fp").alias("left"), F.col("b.fp").alias("right")))
        release(rows)


def similar_pairs(prints: DataFrame, docs: DataFrame, words: int = 5, id_column: str = "doc_id") -> DataFrame:
    """(left, right): links between distinct sets of a similarity of 0.8 or more, enough of them to join all that are linked."""
    search = Search(prints, docs, words, id_column)
    found, turn = search.lead(), 0
    while search.pairs_left() > search.most and (found or not turn):
        if not turn:
            search.sort_out()
        found, turn = search.lead(), turn + 1
    search.rest()
    release(search.rows, search.sets)
    return search.links


def components(docs: DataFrame, words: int = 5, id_column: str = "doc_id") -> DataFrame:
    """(id, key, fp, component_id) for each document."""
    prints = materialize(tables(docs, words, common_shingles(docs, words), id_column), "tables")
    return grouped(prints, lambda p: similar_pairs(p, docs, words, id_column))


def drop_near_copies(docs: DataFrame, words: int = 5, id_column: str = "doc_id") -> DataFrame:
    """docs with one document of each group, that with the least id (and then the least text hash)."""
    return drop_groups(docs, components(docs, words, id_column), id_column)
