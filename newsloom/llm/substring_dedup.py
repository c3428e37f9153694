"""Removal of passages that an earlier document has, by level-wise doubling.

The lengths are s, 2 s, 4 s and that of a window (8, 16, 32 and 50 words). At the first, only anchors of a document take part: for each window,
the run of s words in it whose hash is least (the first of equals). Equal windows have
equal anchors at equal places, so every repeated window has a repeated anchor, and a document has
an anchor for about every 22nd word. Runs that two documents share survive, and they alone are extended to twice their length within the windows
that they stand for: to the right where the window has room for it, else to the left, so that equal windows extend alike.
A run's hash is composed of those of its halves, down to the blocks of s words around the anchor. At the window's length the windows around the
surviving runs are read from the texts and compared by 128-bit hashes. A longer
repeat removes no further word, so the doubling ends there, or earlier where no candidate survives.

Documents with the same words are one class, of which only the one with the smallest identifier is searched;
in the others every window repeats it. Thus a large group of copies costs a row for each copy, and
the text of a document is shuffled at most once, that of one with survivors twice.

Cases: a null text has no words; a document with fewer words than a window loses none; a null identifier
counts as larger than any other; of rows with equal identifiers none is smaller, so they don't remove from each other;
an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import bounded_batches
from newsloom.session import materialize, release

#: Odd multipliers of the two polynomial hashes; any would do.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
NO_ID = (1 << 63) - 1


class WordHashes(dict):
    """XXH64 of words, remembered up to a bound."""

    def __init__(self, seed: int, most: int = 1 << 19):
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.empty(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            self.up, self.down = np.cumprod(np.full(size, self.base)), np.cumprod(np.full(size, self.inverse))
        return self.up[:n], self.down[:n]


def run_hashes(words: np.ndarray, length: int, powers: Powers) -> np.ndarray:
    """A hash of each run of length words, from running sums."""
    n = len(words)
    up, down = powers.upto(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up, out=sums[1:])
    mixed = (sums[length:] - sums[:-length]) * down[: n - length + 1]
    return mixed ^ (mixed >> np.uint64(29))


def window_anchors(runs: np.ndarray, span: int) -> np.ndarray:
    """For each window, the place of its anchor: the first least of span runs in a row."""
    best = np.arange(len(runs) - span + 1)
    least = runs[: len(best)].copy()
    for i in range(1, span):
        other = runs[i : i + len(best)]
        less = other < least
        np.copyto(least, other, where=less)
        np.copyto(best, np.arange(i, i + len(best)), where=less)
    return best


class Hasher:
    """What a task keeps while it hashes documents."""

    def __init__(self, length: int):
        self.length, self.block = length, block_words(length)
        self.first, self.second = WordHashes(1), WordHashes(2)
        self.powers = tuple(map(Powers, BASES))

    def anchors(self, tokens: list[bytes]) -> list[np.ndarray]:
        """The places of the anchors; the least and the largest place that each has in its windows; hashes of the seven blocks around each, 0 where there is none."""
        s = self.block
        runs = run_hashes(np.array([self.first[w] for w in tokens], np.uint64), s, self.powers[0])
        of = window_anchors(runs, self.length - s + 1)
        start = np.flatnonzero(np.diff(of, prepend=-1))  # the first window of each anchor; places never go back
        at, end = of[start], np.append(start[1:], len(of)) - 1
        padded = np.concatenate([np.zeros(3 * s, np.uint64), runs, np.zeros(4 * s, np.uint64)])
        return [at, at - end, at - start, *(padded[at + k * s].view(np.int64) for k in range(7))]

    def windows(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each window."""
        a = np.array([self.first[w] for w in tokens], np.uint64)
        b = np.array([self.second[w] for w in tokens], np.uint64)
        return run_hashes(a, self.length, self.powers[0]), run_hashes(b, self.length, self.powers[1])


def block_words(length: int) -> int:
    """The largest block with which runs of four blocks around an anchor fit into a window on one side or the other."""
    if length < 5:
        raise ValueError("windows have at least five words")
    return (length + 1) // 6


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column of arrays."""
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(kind.to_pandas_dtype()), kind))


def sha(tokens: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(tokens)).digest()


#: What scan() tells of anchors: lists of so many columns.
ANCHOR = ["place", "low", "high", *(f"b{k}" for k in range(7))]


def scan(docs: DataFrame, length: int) -> DataFrame:
    """(id, n_words, sha, a list for each of ANCHOR) for each document; the lists are empty for documents without a window."""
    kinds = [pa.int32()] * 3 + [pa.int64()] * 7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher(length)
        for b in batches:
            n, digests, found = [], [], [[] for _ in ANCHOR]
            for text in map(pa.StringScalar.as_py, b.column("text")):
                tokens = (text or "").encode().split()
                n.append(len(tokens))
                digests.append(sha(tokens))
                for column, values in zip(found, h.anchors(tokens) if len(tokens) >= length else [np.empty(0, np.int64)] * len(ANCHOR), strict=True):
                    column.append(values)
            columns = [b.column("id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), *(lists(c, k) for c, k in zip(found, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "sha", *ANCHOR])

    return docs.mapInArrow(run, "id long, n_words long, sha binary, " + ", ".join(f"{c} array<{'int' if k < 3 else 'long'}>" for k, c in enumerate(ANCHOR)))


def extend(rows: DataFrame, length: int) -> DataFrame:
    """rows (id, key, runs, text) to (id, sha, text, starts, h1, h2): the windows that have a place of one of runs (place, low, high) between low and high.

    A row whose text has other words than key (the start of their sha) says gives none: another row has its identifier.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher(length)
        for b in batches:
            keep, shas, starts, first, second = [], [], [], [], []
            for i, (text, key, runs) in enumerate(zip(map(pa.StringScalar.as_py, b.column("text")), b.column("key").to_pylist(), b.column("runs"), strict=True)):
                tokens = (text or "").encode().split()
                digest = sha(tokens)
                if int.from_bytes(digest[:8], "big", signed=True) != key:
                    continue
                place, low, high = (runs.values.field(c).to_numpy() for c in ("place", "low", "high"))
                chosen = np.unique(np.concatenate([np.arange(p - z, p - a + 1) for p, a, z in zip(place, low, high, strict=True)]))
                one, two = h.windows(tokens)
                keep.append(i)
                shas.append(digest)
                starts.append(chosen)
                first.append(one[chosen].view(np.int64))
                second.append(two[chosen].view(np.int64))
            b = b.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(shas, pa.binary()), b.column("text"), lists(starts, pa.int32()), lists(first, pa.int64()), lists(second, pa.int64())], ["id", "sha", "text", "starts", "h1", "h2"])

    return rows.mapInArrow(run, "id long, sha binary, text string, starts array<int>, h1 array<long>, h2 array<long>")


def doubled(runs: DataFrame, level: int, length: int) -> DataFrame:
    """runs of the level before, extended to twice their length: hash, and side, whether they start at their anchor (0), or one (1) or more (2) blocks before.

    A run stands for the windows in which its anchor's place is between low and high; those with room to the right extend to the right.
    """
    s, b = block_words(length), [F.col(f"b{k}") for k in range(7)]
    room = length - s * (2 << (level - 2))  # the largest place with room for a run that starts there
    right = F.col("side") == 0
    to_right = F.xxhash64(b[3], b[4]) if level == 2 else F.xxhash64("hash", F.xxhash64(b[5], b[6]))
    to_left = F.xxhash64(b[2], b[3]) if level == 2 else F.xxhash64(F.when(right, F.xxhash64(b[1], b[2])).otherwise(F.xxhash64(b[0], b[1])), "hash")
    a = F.when(right & (F.col("low") <= room), F.struct(F.col("low").alias("low"), F.least("high", F.lit(room)).alias("high"), F.lit(0).alias("side"), to_right.alias("hash")))
    z = F.when(~right | (F.col("high") > room), F.struct(F.when(right, F.greatest("low", F.lit(room + 1))).otherwise(F.col("low")).alias("low"), F.col("high"), F.when(right, F.lit(level - 1)).otherwise(F.lit(2)).alias("side"), to_left.alias("hash")))
    return runs.select("id", "key", "place", F.explode(F.array(a, z)).alias("x"), *b).where("x is not null").select("id", "key", "place", "x.*", *b)


def surviving(runs: DataFrame, name: str) -> DataFrame:
    """runs whose hash a document with another identifier has too."""
    shared = materialize(runs.groupBy("hash").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("hash"), "shared")
    out = materialize(runs.join(shared, "hash"), name)
    release(shared)
    return out


def cut(rows: DataFrame, length: int) -> DataFrame:
    """rows (sha, text, starts) to (sha, n_removed, kept_sha), without the words of the windows at starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, kept = [], []
            for text, starts in zip(map(pa.StringScalar.as_py, b.column("text")), b.column("starts"), strict=True):
                tokens = (text or "").encode().split()
                at = starts.values.to_numpy()
                edge = np.zeros(len(tokens) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                stays = np.cumsum(edge[:-1]) == 0
                removed.append(len(tokens) - int(stays.sum()))
                kept.append(sha([tokens[i] for i in np.flatnonzero(stays)]))
            yield pa.RecordBatch.from_arrays([b.column("sha"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["sha", "n_removed", "kept_sha"])

    return rows.mapInArrow(run, "sha binary, n_removed long, kept_sha binary")


def remove_repeats(docs: DataFrame, length: int = 50, id_column: str = "doc_id") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) for each document."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"), "text")
    found = materialize(scan(texts, length).withColumn("row", F.monotonically_increasing_id()), "anchors")
    # Copies: the first of each class is searched.
    # Tables that are joined with hot keys are written first: Spark splits the partitions of a join of plain tables only.
    whole = found.where(F.col("n_words") >= length)
    classes = whole.groupBy("sha").agg(F.min(F.struct("id", "row")).alias("least"))
    classes = materialize(classes.select("sha", F.col("least.id").alias("first"), F.col("least.row").alias("chosen")), "classes")
    first = whole.join(classes, "sha").where("row = chosen")
    key = F.conv(F.hex(F.substring("sha", 1, 8)), 16, -10).cast("long").alias("key")
    runs = materialize(first.select("id", key, F.explode(F.arrays_zip(*ANCHOR)).alias("a")).select("id", "key", "a.*"), "runs")
    for level in (1, 2, 3):
        longer = runs.withColumns({"hash": F.col("b3"), "side": F.lit(0)}) if level == 1 else doubled(runs, level, length)
        runs, old = surviving(longer, f"level{level}"), runs
        release(old)
    survivors = runs.groupBy("key", "id").agg(F.collect_list(F.struct("place", "low", "high")).alias("runs"))
    # By identifier alone the texts come with one shuffle; the hash of the words tells rows with one identifier apart.
    windows = materialize(extend(texts.join(survivors, "id").select("id", "key", "runs", "text"), length), "windows")
    release(runs)

    each = windows.select("id", "sha", F.explode(F.arrays_zip("starts", "h1", "h2")).alias("w")).select("id", "sha", F.col("w.starts").alias("start"), F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"))
    repeated = materialize(each.groupBy("h1", "h2").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").drop("high"), "repeated")
    starts = each.join(repeated, ["h1", "h2"]).where("id > low").groupBy("sha").agg(F.collect_set("start").alias("starts"))
    changed = cut(windows.select("sha", "text").dropDuplicates(["sha"]).join(starts, "sha").select("sha", "text", "starts"), length)

    of = materialize(classes.drop("chosen").join(changed, "sha", "left"), "of")
    release(classes, windows, repeated)
    rows = found.select("id", "n_words", "sha").join(of, "sha", "left")
    copy = F.col("id") > F.col("first")  # null: no window
    return rows.select(
        F.when(F.col("id") < NO_ID, F.col("id")).alias(id_column),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.lower(F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.hex(F.coalesce("kept_sha", "sha")))).alias("kept_sha256"),
    )
