"""Phrase collocation mining: phrases of 2 to 4 words that are frequent in a language, by how much more often their parts stand together than apart.

Words are counted per language and those with MIN_COUNT or more become numbers (a dictionary, numbered in the order of language and word). Pieces break
at punctuation and at all rarer words, which no frequent phrase holds. A task packs the n-grams of a block of text into fixed-width
keys (two numbers in a long; three or four in 16 bytes, big-endian, unused numbers 0), radix sorts them digit by digit and counts their runs, so that a block gives a row for each n-gram that it has. These are
range-partitioned by key, sorted, and the runs of all blocks are counted: a bigram's long is a sort key that Spark sorts by radix.

Longer phrases are counted after the bigrams, since a frequent phrase has frequent bigrams alone: each block is told which of its bigrams are, and that is done in
the pass that counts them. Nothing is broadcast and no task sees a vocabulary other than that of its own block.

A candidate meets the counts of its parts by their keys; phrases are spelt out for those that can be among a language's first, ties included.

Cases: a null text has no words; a null language is `und`; repeated rows count each; a language without candidates has no rows; an empty table gives none; other columns are ignored.
Words are bytes of UTF-8 without space, tab and the breaks, so all other characters, control characters included, belong to them. There can be at most 2^31 - 1 frequent words (ValueError).
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import bounded_batches
from newsloom.session import materialize, release

MIN_COUNT, LONGEST, BEST, WITHIN = 30, 4, 2000, 80
#: Words, and different words, in a block of a task's text; rows that go back to Spark at once, and frequent bigrams that a task holds.
BLOCK, VOCABULARY = 1 << 20, 1 << 18
ROWS, HELD = 1 << 15, 1 << 18

#: Capitals to lower case, breaks to line feeds, tabs to spaces. The byte 0xFF is in no UTF-8 text: it stands for a break among the words.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
BREAK = b"\xff"


class Codes(dict):
    """Words to numbers in the order in which they come; a break is 0."""

    def __init__(self):
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def blocks(docs: DataFrame) -> DataFrame:
    """(block, lang, words, counts, codes): texts of one language as numbers of 4 bytes; words and counts are by number, from 1."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, open_blocks = TaskContext.get().partitionId(), 0, {}

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal made
            known, codes = open_blocks.pop(lang)
            codes, made = np.frombuffer(codes, np.uint32), made + 1
            counts = np.bincount(codes, minlength=len(known))[1:].astype(np.int64)
            columns = [pa.array([task << 31 | made - 1]), pa.array([lang]), pa.array([list(known)[1:]], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64())), pa.array([codes.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["block", "lang", "words", "counts", "codes"])

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), map(pa.BinaryScalar.as_py, b.column("text")), strict=True):
                known, codes = open_blocks.setdefault(lang, (Codes(), array("I")))
                codes.extend(map(known.__getitem__, text.translate(TABLE).replace(b"\n", b" \xff ").split()))
                codes.append(0)
                if len(codes) >= BLOCK or len(known) >= VOCABULARY:
                    yield closed(lang)
        for lang in list(open_blocks):
            yield closed(lang)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "block long, lang string, words array<binary>, counts array<long>, codes binary")


def dictionary(entries: DataFrame, least: int) -> DataFrame:
    """entries (lang, word, c) to (id, lang, word, f): words with a count of least or more, numbered from 1 in the order of language and word."""
    spark = entries.sparkSession
    counts = materialize(entries.groupBy("lang", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= least), "words")
    ranged = counts.repartitionByRange("lang", "word").sortWithinPartitions("lang", "word")
    rows = materialize(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "numbered")  # the partition's number, and that of the row in it
    sizes = sorted((r["part"], r["count"]) for r in rows.groupBy("part").count().collect())  # one row for each partition
    starts = np.cumsum([1, *(n for _, n in sizes)]).tolist()
    if starts[-1] > 1 << 31:
        raise ValueError("more than 2^31 - 1 frequent words")
    offsets = spark.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts, strict=False)], "part long, start long")
    ids = (F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("id")
    out = materialize(rows.join(F.broadcast(offsets), "part").select(ids, "lang", "word", "f"), "dictionary")
    release(counts, rows)
    return out


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The order of rows of words by 16-bit digits: a stable sort by each, the least significant first. Digits that are all alike are skipped."""
    order = None
    for w in reversed(words):
        for shift in (0, 16):
            d = (w >> shift).astype(np.uint16)
            if len(d) and (d != d[0]).any():
                order = np.argsort(d, kind="stable") if order is None else order[np.argsort(d[order], kind="stable")]  # numpy sorts 16-bit integers by radix
    return np.arange(len(words[0])) if order is None else order


def pieces(columns: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names)
    return (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS))


def runs(words: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """n-grams, as arrays of their first, second ... words, to the different ones in order, and their counts."""
    order = radix_order(words)
    words = [w[order] for w in words]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([w[1:] != w[:-1] for w in words])
    at = np.flatnonzero(new)
    return [w[at] for w in words], np.diff(at, append=len(order))


def numbered(blocks: DataFrame, entries: DataFrame, words: DataFrame) -> DataFrame:
    """(block, ids): each block as numbers of the dictionary, 0 for breaks and rarer words."""
    found = entries.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list("at").alias("at"), F.collect_list("id").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                codes = np.frombuffer(b.column("codes")[i].as_py(), np.uint32)
                of = np.zeros(int(codes.max(initial=0)) + 1, np.uint32)
                of[b.column("at")[i].values.to_numpy() + 1] = b.column("id")[i].values.to_numpy()
                yield pa.RecordBatch.from_arrays([b.column("block").slice(i, 1), pa.array([of[codes].tobytes()], pa.binary())], ["block", "ids"])

    return blocks.select("block", "codes").join(found, "block").mapInArrow(run, "block long, ids binary")


def bigrams(encoded: DataFrame) -> DataFrame:
    """(key, block, c): the bigrams of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, ids in zip(b.column("block").to_pylist(), b.column("ids"), strict=True):
                x = np.frombuffer(ids.as_py(), np.uint32)
                at = np.flatnonzero((x[:-1] > 0) & (x[1:] > 0))
                (first, second), counts = runs([x[at], x[at + 1]])
                keys = first.astype(np.int64) << 32 | second
                yield from pieces([pa.array(keys), pa.array(np.full(len(keys), block)), pa.array(counts)], ["key", "block", "c"])

    return encoded.mapInArrow(run, "key long, block long, c long")


def frequent_bigrams(found: DataFrame, least: int) -> DataFrame:
    """(key, f) for each bigram of least or more, and rows (block, keys): each block's frequent bigrams, packed, as many rows as there are ranges and HELD bigrams of a range.

    The rows of a bigram follow each other. At most least of them are held until it is known to be frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def counts(keys, f) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(f, pa.int64()), pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.binary())], ["key", "f", "block", "keys"])

        def packed() -> pa.RecordBatch:
            keys, blocks = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(blocks, kind="stable")
            keys, blocks = keys[order], blocks[order]
            starts = np.flatnonzero(np.diff(blocks, prepend=-1))
            rows = [k.tobytes() for k in np.split(keys, starts[1:])]
            return pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()), pa.array(blocks[starts]), pa.array(rows, pa.binary())], ["key", "f", "block", "keys"])

        last, total, waiting = None, 0, np.empty(0, np.int64)  # of the run that the next batch may go on with
        for b in batches:
            keys, blocks, n = (b.column(c).to_numpy() for c in ("key", "block", "c"))
            if not len(keys):
                continue
            starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
            ends, sums, first = np.append(starts[1:], len(keys)), np.add.reduceat(n, starts), int(keys[0])
            if last != first:
                if total >= least:
                    yield counts([last], [total])
                total, waiting = 0, waiting[:0]
            sums[0] += total  # the first run goes on with what came before
            often = sums >= least
            if often[0] and len(waiting):
                held.append((np.full(len(waiting), first), waiting))
            rows = np.repeat(often, ends - starts)
            held.append((keys[rows], blocks[rows]))
            done = often.copy()
            done[-1] = False
            yield counts(keys[starts[done]], sums[done])
            if often[-1]:
                waiting = waiting[:0]
            else:
                waiting = np.append(waiting if len(starts) == 1 else waiting[:0], blocks[starts[-1] :])
            last, total = int(keys[-1]), int(sums[-1])
            if sum(len(k) for k, _ in held) >= HELD:
                yield packed()
        if total >= least:
            yield counts([last], [total])
        if any(len(k) for k, _ in held):
            yield packed()

    return found.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, "key long, f long, block long, keys binary")


def longer(encoded: DataFrame, often: DataFrame) -> DataFrame:
    """(key, c): for each block its phrases of three and four words of which all bigrams are frequent; often (block, keys) has these."""
    lists = often.groupBy("block").agg(F.collect_list("keys").alias("keys"))  # bigrams of one block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x, keys = np.frombuffer(b.column("ids")[i].as_py(), np.uint32), np.sort(np.frombuffer(b"".join(b.column("keys")[i].as_py()), np.int64))
                pairs = x[:-1].astype(np.int64) << 32 | x[1:]
                ok = keys[np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)] == pairs
                for n in (3, 4):
                    at = np.flatnonzero(np.logical_and.reduce([ok[k : len(ok) - n + 2 + k] for k in range(n - 1)]))
                    words, counts = runs([x[at + k] for k in range(n)])
                    wide = np.zeros((len(counts), LONGEST), ">u4")
                    for k, w in enumerate(words):
                        wide[:, k] = w
                    offsets = pa.py_buffer(np.arange(0, 16 * len(counts) + 1, 16, dtype=np.int32))
                    packed = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, offsets, pa.py_buffer(wide.tobytes())])
                    yield from pieces([packed, pa.array(counts)], ["key", "c"])

    return encoded.join(lists, "block").select("ids", "keys").mapInArrow(run, "key binary, c long")


def key_of(ids: list[Column]) -> Column:
    """A phrase's key of 16 bytes."""
    return F.unhex(F.concat(*(F.lpad(F.hex(i), 8, "0") for i in ids), F.lit("00000000" * (LONGEST - len(ids)))))


def part(start: Column | int, size: Column | int) -> Column:
    """The key of so many words of a key from start on."""
    start, size = (F.lit(v) if isinstance(v, int) else v for v in (start, size))
    return F.unhex(F.rpad(F.substring(F.hex("key"), start * 8 + 1, size * 8), 32, "0"))


def words_in(key: Column) -> Column:
    """How many numbers a key has."""
    first_zero = [F.substring(F.hex(key), 8 * k + 1, 8) == "00000000" for k in (1, 2, 3)]
    return F.when(first_zero[0], 1).when(first_zero[1], 2).when(first_zero[2], 3).otherwise(4)


def phrase_counts(docs: DataFrame, least: int = MIN_COUNT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, f) of all words and phrases with least or more occurrences; the dictionary (id, lang, word, f); and (lang, n), the words of each language."""
    made = materialize(blocks(docs), "blocks")
    entries = made.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "e")).select("block", "lang", "at", F.col("e.words").alias("word"), F.col("e.counts").alias("c"))
    # The word that stands for a break has no entry: words are numbered from 1.
    totals = made.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)).alias("n"))
    totals = materialize(totals, "totals")
    words = dictionary(entries, least)
    encoded = materialize(numbered(made, entries, words), "encoded")
    release(made)
    found = materialize(bigrams(encoded), "bigrams")  # the ranges are sampled from it
    often = materialize(frequent_bigrams(found, least), "frequent")
    release(found)
    long = materialize(longer(encoded, often.where("block is not null").select("block", "keys")), "longer")
    release(encoded)
    # A range has whole runs, so its keys are counted where they are.
    many = long.repartitionByRange("key").sortWithinPartitions("key").groupBy("key").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    pairs = often.where("key is not null").select(key_of([F.shiftright("key", 32), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))]).alias("key"), "f")
    every = materialize(words.select(key_of([F.col("id")]).alias("key"), "f").unionAll(pairs).unionAll(many), "counts")
    release(often, long)
    return every, words, totals


def collocations(docs: DataFrame, least: int = MIN_COUNT, best: int = BEST, within: int = WITHIN) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score, count and phrase.

    The score is the share of a phrase's occurrences in those of its parts, in millionths, at the cut that makes it least. A phrase that stands within % of the time in a longer one goes.
    """
    counts, words, totals = phrase_counts(docs, least)
    sized = counts.withColumn("size", words_in(F.col("key"))).where("size > 1")
    # Each cut meets the counts of both parts.
    cuts = sized.select("key", "f", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = materialize(cuts.select("key", F.col("f").alias("a"), "k", part(0, F.col("k")).alias("head"), part(F.col("k"), F.col("size") - F.col("k")).alias("tail")), "cuts")
    cuts = cuts.join(counts.select(F.col("key").alias("head"), F.col("f").alias("l")), "head").join(counts.select(F.col("key").alias("tail"), F.col("f").alias("r")), "tail")
    score = F.expr("cast(a as decimal(20,0)) * 2000000 div (l + r)")
    scored = cuts.withColumn("score", score).groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # What stands in longer phrases, and how often in the commonest of these.
    inner = [(3, 0, 2), (3, 1, 2), (4, 0, 2), (4, 1, 2), (4, 2, 2), (4, 0, 3), (4, 1, 3)]
    inside = F.explode(F.array(*(F.when(F.col("size") == n, part(at, m)) for n, at, m in inner)))
    longest = sized.where("size > 2").select("f", inside.alias("key")).where("key is not null").groupBy("key").agg(F.max("f").alias("longer"))
    kept = scored.join(longest, "key", "left").where(F.coalesce(F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * within, F.lit(True)))
    kept = kept.select("key", "a", "cut.score", "cut.l", "cut.r")
    # The first word tells the language. Of each language those are spelt out that can be among its first.
    first = F.conv(F.substring(F.hex("key"), 1, 8), 16, 10).cast("long")
    kept = materialize(kept.withColumn("id", first), "candidates")
    kept = kept.join(words.select("id", "lang"), "id").drop("id")
    order = [F.desc("score"), F.desc("a")]
    kept = materialize(kept.withColumn("_rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_rank") <= best).drop("_rank"), "first")
    letters = kept.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), words_in(F.col("key")) - 1), lambda k: F.conv(F.substring(F.hex("key"), k * 8 + 1, F.lit(8)), 16, 10).cast("long"))).alias("at", "id"))
    spelt = letters.join(words.select("id", "word"), "id").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("w"))
    rows = kept.join(spelt.select("key", F.array_join("w.word", " ").alias("phrase")), "key").join(totals, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    rows = rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= best)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
