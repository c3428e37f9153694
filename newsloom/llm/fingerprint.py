"""Context-triggered piecewise hashing of documents.

A rolling hash over seven bytes ends a chunk wherever its value is one less than a multiple of the block size, so
chunks depend on the text near them alone, and an edit changes the chunks around it only. Each chunk gives
a letter; the letters at a block size and at twice that are the fingerprint. Two fingerprints
are alike by the edit distance of their letters at a block size that both have.

Texts are put in the order of identifiers by a sampled range partitioning, so that every document meets its successor with one
shuffle of the texts. The first and the last document of each range are written beside the results, under the number of
the range, and the last ones are joined with the first ones of the next range that has any.

Cases: a null text is empty; an empty text has no letters, and is like another empty text only; null identifiers come
last; rows with one identifier are in the order of their texts' XXH64 (Spark's, signed); the successor of the last document is the
first; of a single document, itself; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import bounded_batches, text_or_empty
from newsloom.session import materialize

LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
LEAST, MOST, REACH = 3, 64, 7
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = [np.cumprod(np.full(1 << 16, BASE)), np.cumprod(np.full(1 << 16, INVERSE))]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            _powers[k] = np.cumprod(np.full(2 * len(_powers[k]), base))
    return _powers[0][:n], _powers[1][:n]


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of each byte and the six before it, zeros before the start."""
    x = data.astype(np.uint32) + np.uint32(1)
    out = x.copy()
    for j in range(1, REACH):
        out[j:] += x[:-j] * np.uint32(0x85EBCA6B * (2 * j + 1) & 0xFFFFFFFF)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0xC2B2AE35)
    out ^= out >> np.uint32(13)
    return out


class Signature:
    """A fingerprint: its block size, the letters there and at twice the size."""

    __slots__ = ("block", "one", "two")

    def __init__(self, block: int, one: bytes, two: bytes):
        self.block, self.one, self.two = block, one, two

    def __str__(self) -> str:
        return f"{self.block}:{self.one.decode()}:{self.two.decode()}"


def letters(data_powers: np.ndarray, down: np.ndarray, ends: np.ndarray, most: int) -> bytes:
    """A letter for each chunk; the chunks beyond most - 1 are one. ends: the place behind each chunk's last byte."""
    n = len(data_powers)
    starts = np.concatenate([[0], ends])
    starts = starts[starts < n][:most]
    sums = np.add.reduceat(data_powers, starts) * down[starts]
    mixed = (sums ^ (sums >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return LETTERS[(mixed >> np.uint64(58)).astype(np.int64)].tobytes()


def signature(data: bytes, hashes: np.ndarray | None = None) -> Signature:
    """The fingerprint of data. The block size is the smallest by which its expected letters fit, halved while they are too few."""
    n = len(data)
    if not n:
        return Signature(LEAST, b"", b"")
    x = np.frombuffer(data, np.uint8)
    hashes = rolling(x) if hashes is None else hashes
    block = LEAST
    while block * MOST < n:
        block *= 2
    # The larger sizes' places are among those of the smaller ones.
    at = np.flatnonzero(hashes % np.uint32(block) == block - 1)
    while block > LEAST and len(at) < MOST // 2 - 1:
        block //= 2
        at = np.flatnonzero(hashes % np.uint32(block) == block - 1)
    up, down = powers(n)
    values = (x.astype(np.uint64) + np.uint64(1)) * up
    two = at[hashes[at] % np.uint32(2 * block) == 2 * block - 1]
    return Signature(block, letters(values, down, at + 1, MOST), letters(values, down, two + 1, MOST // 2))


def edit_distances(pairs: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Edit distance of each pair of strings of 1 to 64 letters, all pairs at once, a column of the table a step in bits."""
    n = len(pairs)
    if not n:
        return np.empty(0, np.int64)
    size_a = np.array([len(a) for a, _ in pairs])
    size_b = np.array([len(b) for _, b in pairs])
    a = np.frombuffer(b"".join(x.ljust(MOST, b"\0") for x, _ in pairs), np.uint8).reshape(n, MOST)
    b = np.frombuffer(b"".join(x.ljust(MOST, b"\1") for _, x in pairs), np.uint8).reshape(n, MOST)
    one = np.uint64(1)
    weights = one << np.arange(MOST, dtype=np.uint64)
    masks = np.zeros((n, 128), np.uint64)
    rows = np.arange(n)
    for i in range(int(size_a.max())):
        masks[rows, a[:, i]] |= weights[i]
    plus, minus = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    top = one << (size_a - 1).astype(np.uint64)
    score = size_a.astype(np.int64)
    for j in range(int(size_b.max())):
        eq = masks[rows, b[:, j]]
        live = j < size_b
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus), plus & xh
        score += np.where(live, ((ph & top) != 0).astype(np.int64) - ((mh & top) != 0).astype(np.int64), 0)
        ph, mh = (ph << one) | one, mh << one
        new_plus, new_minus = mh | ~(xv | ph), ph & xv
        plus, minus = np.where(live, new_plus, plus), np.where(live, new_minus, minus)
    return score


def likeness(pairs: list[tuple[Signature, Signature]]) -> np.ndarray:
    """How alike each pair is, from 0 to 1: the best over the block sizes that both have of 1 - distance / longer length."""
    out = np.zeros(len(pairs))
    todo, where = [], []
    for i, (a, b) in enumerate(pairs):
        if a.block == b.block and a.one == b.one and a.two == b.two:
            out[i] = 1.0
            continue
        same = {a.block: a.one, 2 * a.block: a.two}
        for block, text in ((b.block, b.one), (2 * b.block, b.two)):
            if same.get(block) and text:
                todo.append((same[block], text))
                where.append(i)
    if todo:
        longest = np.array([max(len(a), len(b)) for a, b in todo])
        np.maximum.at(out, np.array(where), 1 - edit_distances(todo) / longest)
    return out


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as much of the start of following."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


RESULT = "id long, n_chars long, edited_sha256 binary, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(rows: list[tuple[int | None, str, Signature, str, Signature]]) -> list[pa.Array]:
    """RESULT of (id, text, its signature, the successor's text, its signature)."""
    changed = [edited(text, following).encode() for _, text, _, following, _ in rows]
    signs = [signature(c) for c in changed]
    near = likeness([(r[2], s) for r, s in zip(rows, signs, strict=True)]), likeness([(r[2], r[4]) for r in rows])
    return [
        pa.array([r[0] for r in rows], pa.int64()),
        pa.array([len(r[1]) for r in rows], pa.int64()),
        pa.array([hashlib.sha256(c).digest() for c in changed], pa.binary()),
        pa.array([str(r[2]) for r in rows], pa.string()),
        pa.array([str(s) for s in signs], pa.string()),
        *(pa.array(n, pa.float64()) for n in near),
    ]


def walk(sorted_ranges: DataFrame) -> DataFrame:
    """(part, id, text) in order, to RESULT of each document but a range's last; and each range's first and last document, with part, head and text."""
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results(rows: list[tuple]) -> pa.RecordBatch:
            nothing = [pa.nulls(len(rows), t) for t in (pa.int32(), pa.bool_(), pa.string())]
            return pa.RecordBatch.from_arrays([*compared(rows), *nothing], [*names, "part", "head", "text"])

        def border(part: int, head: bool, i: int | None, text: str) -> pa.RecordBatch:
            row = {n: [None] for n in names} | {"id": [i], "part": [part], "head": [head], "text": [text]}
            return pa.RecordBatch.from_pydict(row, schema=results([]).schema)

        held, part, ready = None, None, []
        for b in batches:
            for part, i, text in zip(*(b.column(c).to_pylist() for c in ("part", "id", "text")), strict=True):
                sign = signature(text.encode())
                if held is None:
                    yield border(part, True, i, text)
                else:
                    ready.append((*held, text, sign))
                held = (i, text, sign)
                if len(ready) >= 1000:
                    yield results(ready)
                    ready = []
        if ready:
            yield results(ready)
        if held is not None:
            yield border(part, False, held[0], held[1])

    return sorted_ranges.mapInArrow(run, f"{RESULT}, part int, head boolean, text string")


def compare_borders(rows: DataFrame) -> DataFrame:
    """(id, text, following) to RESULT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("id", "text", "following")), strict=True)
            yield pa.RecordBatch.from_arrays(compared([(i, t, signature(t.encode()), f, signature(f.encode())) for i, t, f in rows]), [f.split()[0] for f in RESULT.split(", ")])

    return rows.mapInArrow(run, RESULT)


def compare_successors(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each document."""
    bounded_batches(docs.sparkSession)
    order = ["none", "id", "key"]
    keyed = docs.select(F.isnull(id_column).alias("none"), F.col(id_column).cast("long").alias("id"), F.xxhash64(text_or_empty()).alias("key"), text_or_empty().alias("text"))
    ranges = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "id", "text")
    walked = materialize(walk(ranges), "walked")

    heads = walked.where("head").select("part", F.col("text").alias("following"))
    parts = heads.select("part")  # a number for each range
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))
    last = walked.where("not head").select("part", "id", "text").join(parts.select("part", following.alias("next")), "part")
    borders = compare_borders(last.join(heads.withColumnRenamed("part", "next"), "next").select("id", "text", "following"))
    rows = walked.where("part is null").drop("part", "head", "text").unionAll(borders)
    return rows.withColumn("edited_sha256", F.lower(F.hex("edited_sha256"))).withColumnRenamed("id", id_column)
