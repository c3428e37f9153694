"""N-grams of 1 to 5 words, counted in blocks of documents.

Documents are dealt by identifier and taken in blocks of some 2^18 words, whose words are numbered. A block's different n-grams are sorted numbers,
so a block has each once, with its count and the number of its documents; these go, packed by a hash of the n-gram's first STEM words, to the task that adds up all blocks' (`summed`), which spells them out
or sends each block the sums of its own (`met`). So an n-gram is shuffled once for a block, without a row of its own, and no task has more than its share of the hashes:
there are as many tasks as the text needs.

What is packed together (`packed_grams`) has its words spelt once. Up to STEM words, an n-gram is their numbers; a longer one stands with the one it goes on from, and is the number of its last word alone.

`met` asks by length, in ROUNDS: a longer n-gram is sent only if all its parts of the length before are in another block too. Whatever holds a part that no other block has is in no other block either,
so its sums are the block's own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from newsloom.functions.text import is_blank
from newsloom.session import bounded_batches, materialize

LONGEST = 5
#: Words of a block; characters of text for a task that makes blocks, and for one that adds up; rows that go back to Spark at once, and bytes of packed n-grams.
WORDS, DEALT, ADDED, ROWS, BYTES = 1 << 18, 1 << 23, 1 << 22, 1 << 15, 1 << 22
#: Words of a block whose n-grams are sent once only. The rows of the shuffle are blocks times tasks that add up, so larger blocks and fewer tasks keep them few.
ADDED_WORDS = 3 << 18
#: Words by which n-grams are dealt to the tasks that add up; longer ones go where their first words go.
STEM = 3
#: Lengths that are asked about together, the least and the most.
ROUNDS = ((1, 2), (3, 3), (4, LONGEST))
#: Sequences of a block: words in lower case, as written (a document's null stands for the first), of the title. SHOWN has the first one's words as they look.
LOW, WRITTEN, TITLE, SHOWN = "low", "written", "title", "shown"

Batches = Iterator[pa.RecordBatch]


def in_order(numbers: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of numbers below most, and the numbers in it. Numbers are sorted with their places in the low bits where both fit."""
    bits = len(numbers).bit_length()
    if most << bits <= 1 << 63:
        packed = np.sort(numbers << bits | np.arange(len(numbers)))
        return packed & (1 << bits) - 1, packed >> bits
    order = np.argsort(numbers, kind="stable")
    return order, numbers[order]


def changes(numbers: np.ndarray) -> np.ndarray:
    """Which numbers differ from the one before; the first does."""
    out = np.ones(len(numbers), bool)
    np.not_equal(numbers[1:], numbers[:-1], out=out[1:])
    return out


def joined_words(words: pa.Array, columns: list[np.ndarray], lengths: np.ndarray | None = None) -> pa.Array:
    """The words of each row's numbers, or its first ones if lengths are given, joined by spaces."""
    parts = [words.take(pa.array(c, mask=None if lengths is None else lengths <= k)) for k, c in enumerate(columns)]
    return pc.binary_join_element_wise(*parts, " ", null_handling="skip") if len(parts) > 1 else parts[0]


class Level(NamedTuple):
    """Different n-grams of n words, in their order: the number of each one's first word, second word and so on, the first row that is of it, and for those longer than a stem which one of a word less it goes on from (else None)."""

    n: int
    columns: list[np.ndarray]
    first: np.ndarray
    before: np.ndarray | None


def outline(levels: list[Level]) -> np.ndarray:
    """The order of all levels' n-grams in which each is followed by those that go on from it, so that neighbours have words in common."""
    sizes: list[np.ndarray] = []
    for level, longer in zip(levels[::-1], [None, *levels[:0:-1]], strict=True):
        below = np.bincount(longer.before, sizes[-1], len(level.first)).astype(np.int64) if longer and longer.before is not None else 0
        sizes.append(below + np.ones(len(level.first), np.int64))
    places, start = [], 0
    for level, size in zip(levels, sizes[::-1], strict=True):
        place = np.cumsum(size) - size
        if level.before is None:
            places.append(place + start)
            start += size.sum()
        else:
            new = changes(level.before)
            places.append(places[-1][level.before] + 1 + place - place[new][np.cumsum(new) - 1])
    order = np.empty(start, np.int64)
    order[np.concatenate(places)] = np.arange(start)
    return order


class Block:
    """Documents' sequences of words as numbers: code, kind, row, doc and pos (in its row) of each place, and the number of the word that is shown there. words are sorted."""

    longest = LONGEST
    FIELDS = ("code", "kind", "row", "doc", "pos", "shown")

    def __init__(self, ids: pa.Array, words: pa.Array, kinds: list[str], **fields: np.ndarray):
        self.ids, self.words, self.kinds = ids, words, kinds
        self.docs = len(ids)
        self.code, self.kind, self.row, self.doc, self.pos, self.shown = (fields[k].astype(np.int64) for k in self.FIELDS)
        self.made_levels, self.made_counts = [], []

    @classmethod
    def made(cls, ids: pa.Array, doc: np.ndarray, sequences: dict[str, pa.Array]) -> Block:
        if WRITTEN in sequences and SHOWN in sequences:
            sequences = sequences | {WRITTEN: pc.if_else(pc.is_valid(sequences[WRITTEN]), sequences[WRITTEN], sequences[SHOWN])}
        flat = [v.flatten() for v in sequences.values()]
        sizes = dict(zip(sequences, (np.asarray(pc.fill_null(pc.list_value_length(v), 0)) for v in sequences.values()), strict=True))
        coded = pa.concat_arrays(flat).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        codes = dict(zip(sequences, np.split(rank[coded.indices.to_numpy()], np.cumsum([len(v) for v in flat])[:-1]), strict=True))
        shown = codes.pop(SHOWN, np.empty(0, np.int64))
        kinds = list(codes)
        of = np.concatenate([sizes[k] for k in kinds])
        row = np.repeat(np.arange(len(of)), of)
        code = np.concatenate([codes[k] for k in kinds])
        pos = np.arange(len(code)) - np.repeat(np.cumsum(of) - of, of)
        kind = np.repeat(np.arange(len(kinds)), [len(codes[k]) for k in kinds])
        return cls(ids, coded.dictionary.take(pa.array(order)), kinds, code=code, kind=kind, row=row, doc=np.tile(doc, len(kinds))[row], pos=pos, shown=shown)

    def packed(self) -> bytes:
        arrays = [self.words, *(pa.array(getattr(self, k).astype(np.int32)) for k in self.FIELDS)]
        out = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(a)], a) for a in arrays], ["words", *self.FIELDS])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, out.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(out)
        return sink.getvalue().to_pybytes()

    @classmethod
    def unpacked(cls, ids: pa.Array, kinds: list[str], data: bytes) -> Block:
        t = pa.ipc.open_stream(data).read_next_batch()
        return cls(ids, t.column("words").flatten(), kinds, **{k: t.column(k).flatten().to_numpy() for k in cls.FIELDS})

    def of(self, kind: str) -> np.ndarray:
        """Which places are of a kind; none if the block has no such sequence."""
        return self.kind == self.kinds.index(kind) if kind in self.kinds else np.zeros(len(self.kind), bool)

    def levels(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(n, at, gram, first) for each n: the places where an n-gram starts, its number there, and a place of each of the different ones, which are in the order of their words."""
        while len(self.made_levels) < self.longest:
            self.add_level()
        return self.made_levels[: self.longest]

    def add_level(self) -> None:
        """The next level, of the last one's places and numbers. No generator holds them: it and its block would hold each other, and stay until a full collection of garbage, which arrays don't bring about."""
        n, at, gram, different = 1, np.arange(len(self.code)), np.zeros(len(self.code), np.int64), 1
        if self.made_levels:
            n, at, gram, first = self.made_levels[-1]
            n, different = n + 1, len(first)
            kept = at + n - 1 < len(self.code)
            kept[kept] = self.row[at[kept]] == self.row[at[kept] + n - 1]
            at, gram = at[kept], gram[kept]
        gram, first, counts = self.numbered(gram * len(self.words) + self.code[at + n - 1], different * len(self.words), at, self.of(LOW), self.of(WRITTEN))
        self.made_counts.append(counts)
        self.made_levels.append((n, at, gram, first))

    def numbered(self, keys: np.ndarray, most: int, at: np.ndarray, low: np.ndarray, written: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the different keys, all below most, is at each place; a place of each; and what counts() tells of it."""
        order, keys = in_order(keys, most)
        new = changes(keys)
        number, places, gram = np.cumsum(new) - 1, at[order], np.empty(len(at), np.int64)
        gram[order] = number
        first = places[new]
        has = written[places]
        pair, doc = number[has], self.doc[places[has]]  # of an n-gram's places, a document's stand together
        sums = number[low[places]], pair[changes(pair) | changes(doc)]
        return gram, first, np.stack([np.bincount(x, minlength=len(first)) for x in sums])

    def spelt(self, n: int, places: np.ndarray, code: np.ndarray | None = None) -> pa.Array:
        """The n words from each place, joined by spaces."""
        code = self.code if code is None else code
        return joined_words(self.words, [code[places + k] for k in range(n)])

    def spelt_each(self, lengths: np.ndarray, places: np.ndarray, code: np.ndarray | None = None) -> pa.Array:
        """As many words from each place as its length says."""
        code = self.code if code is None else code
        return joined_words(self.words, [code[np.minimum(places + k, len(code) - 1)] for k in range(LONGEST)], lengths)

    def asked(self, buckets: int, least: int, most: int, shared: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Places of n-grams of least to most words, by n; their numbers among all n-grams; their buckets. shared tells of each shorter n-gram whether another block has it: n-grams with a part that none has are left out.

        A bucket is a hash of an n-gram's first words, the same in all blocks.
        """
        stem = stem_of(least, most)
        known = pd.util.hash_array(self.words.to_numpy(zero_copy_only=False), categorize=False) if len(self.words) else np.empty(0, np.uint64)
        places, numbers, hashes, start = [], [], [], 0
        common, hashed = np.zeros(len(self.code), bool), np.zeros(len(self.code), np.uint64)
        for n, at, gram, first in self.levels():
            if n == least - 1:
                common[at] = shared[start : start + len(first)][gram]
            if n <= stem:  # of the n words from each place
                hashed = (hashed[: len(self.code) - n + 1] ^ known[self.code[n - 1 :]]) * np.uint64(0x9E3779B97F4A7C15)
                hashed ^= hashed >> np.uint64(29)
            if least <= n <= most:
                kept = np.flatnonzero(np.all([common[first + j] for j in range(n - least + 2)], axis=0)) if least > 1 else np.arange(len(first))
                places.append(first[kept])
                numbers.append(start + kept)
                hashes.append(hashed[first[kept]])
            start += len(first)
        return places, np.concatenate(numbers), (np.concatenate(hashes) % np.uint64(buckets)).astype(np.int64)

    def counts(self) -> np.ndarray:
        """(2, n-grams): how often each stands in lower case, and how many documents have it as written."""
        return np.concatenate(self.made_counts[: len(self.levels())], axis=1)


def stem_of(least: int, most: int) -> int:
    """How many first words of n-grams of least to most words, sent together, tell their bucket."""
    return min(max(least, STEM), most)


def plane(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Whole numbers in as few bytes as the largest needs, first the low byte of each, then the next."""
    kind = np.min_scalar_type(int(numbers.max(initial=0)))
    return kind.str.encode().ljust(4), numbers.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()


def unplaned(kind: bytes, n: int, data: bytes, at: int) -> tuple[np.ndarray, int]:
    """The n numbers from a place of data, and the place behind them."""
    own = np.dtype(kind.decode().strip())
    end = at + n * own.itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, end - at, at).reshape(own.itemsize, n).T).view(own).ravel(), end


def squeezed(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    """Arrays of one length, and bytes after them, compressed."""
    parts = [plane(a) for a in arrays]
    body = b"".join(k for k, _ in parts) + b"".join(b for _, b in parts) + tail
    return len(arrays[0]).to_bytes(4, "little") + len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def opened(data: bytes, k: int) -> tuple[list[np.ndarray], bytes]:
    n, size = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:12], "little")
    body = pa.decompress(data[12:], size, "zstd", asbytes=True)
    out, at = [], 4 * k
    for j in range(k):
        a, at = unplaned(body[4 * j : 4 * j + 4], n, body, at)
        out.append(a.astype(np.int64))
    return out, body[at:]


def laid(arrays: list[np.ndarray]) -> bytes:
    """Arrays of any lengths, one after the other."""
    return b"".join(kind + len(a).to_bytes(4, "little") + body for a in arrays for kind, body in [plane(a)])


def lifted(data: bytes, k: int) -> tuple[list[np.ndarray], bytes]:
    """The first k arrays of laid(), and what is behind them."""
    out, at = [], 0
    for _ in range(k):
        a, at = unplaned(data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little"), data, at + 8)
        out.append(a)
    return out, data[at:]


def ranked(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the different keys, all below most, each one is, in their order, and the first place of each."""
    order, keys = in_order(keys, most)
    new = changes(keys)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def buckets_of(docs: DataFrame, text: str) -> int:
    """How many tasks add up; it grows with the text. Little text is spread over some 24."""
    size = docs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    return 1 + max(size // ADDED, min(24, 4 * size // ADDED))


def tasks_of(buckets: int) -> int:
    """How many tasks make blocks; with little text, as many as add up."""
    return min(buckets, max(24, 1 + buckets * ADDED // DEALT))


def dealt(docs: DataFrame, buckets: int, id_column: str, text: str, sequences: dict[str, Column]) -> DataFrame:
    """(id, sequences ...) of documents that aren't blank, dealt by identifier and in its order."""
    bounded_batches(docs.sparkSession)
    t = docs.where(~is_blank(F.col(text))).repartition(tasks_of(buckets), id_column).sortWithinPartitions(id_column)
    return t.select(F.col(id_column).alias("id"), *(c.alias(k) for k, c in sequences.items()))


def in_blocks(batches: Batches, names: list[str], most: int = 0) -> Iterator[tuple[int, Block]]:
    """Blocks of some WORDS or most words, with how many rows they are of, of rows (id, sequences ...); rows of one identifier stand together and stay so."""
    most = most or WORDS

    def closed(held: list[pa.RecordBatch]) -> tuple[int, Block]:
        t = pa.Table.from_batches(held).combine_chunks()
        column = lambda k: t.column(k).combine_chunks()
        ids = t.column("id").to_pylist()
        new = np.array([i > 0 and ids[i] != ids[i - 1] for i in range(len(ids))], np.int64)
        return len(ids), Block.made(column("id").take(pa.array(np.flatnonzero(np.r_[1, new[1:]]))), np.cumsum(new), {k: column(k) for k in names})

    held, words, last = [], 0, None
    for b in batches:
        sizes = sum(np.asarray(pc.fill_null(pc.list_value_length(b.column(k)), 0)) for k in names)
        start = 0
        for i, (own, size) in enumerate(zip(b.column("id").to_pylist(), sizes.tolist(), strict=True)):
            if words >= most and own != last:
                held.append(b.slice(start, i - start))
                yield closed([h for h in held if h.num_rows])
                held, words, start = [], 0, i
            words, last = words + size, own
        held.append(b.slice(start))
    held = [h for h in held if h.num_rows]
    if held:
        yield closed(held)


def in_pieces(columns: list, names: list[str]) -> Batches:
    whole = pa.RecordBatch.from_arrays(columns, names)
    return (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS))


def packed_blocks(rows: DataFrame) -> DataFrame:
    """(block, documents, words, ids, data) of dealt rows; words are those of the first sequence."""
    names = [c for c in rows.columns if c != "id"]

    def run(batches: Batches) -> Batches:
        task = TaskContext.get().partitionId()
        for at, (documents, b) in enumerate(in_blocks(batches, names)):
            columns = [pa.array([task << 31 | at]), pa.array([documents]), pa.array([int((b.kind == 0).sum())]), pa.ListArray.from_arrays([0, len(b.ids)], b.ids), pa.array([b.packed()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "documents", "words", "ids", "data"])

    return rows.mapInArrow(run, f"block long, documents long, words long, ids array<{dict(rows.dtypes)['id']}>, data binary")


def unpacked(b: pa.RecordBatch, names: list[str]) -> Iterator[Block]:
    kinds = [k for k in names if k != SHOWN]
    for i in range(b.num_rows):
        yield Block.unpacked(b.column("ids")[i].values, kinds, b.column("data")[i].as_py())


def told(block: Block, buckets: int, asked: list[str], rounds: list[tuple[int, int]], found: list[dict]) -> tuple[list[np.ndarray], np.ndarray]:
    """What was asked of a block's n-grams, and whether another block has them, after some rounds; found are the rows that came back. Who was not asked about has the block's own sums."""
    block.longest = rounds[-1][1]
    own = dict(zip(("count", "df"), block.counts(), strict=True))
    out, shared = [own.get(a, np.ones(len(own["count"]), np.int64)).copy() for a in asked], np.zeros(len(own["count"]), bool)
    for turn, (least, most) in enumerate(rounds):
        _, numbers, bucket = block.asked(buckets, least, most, shared)
        came = sorted((f for f in found if f["turn"] == turn), key=lambda f: f["bucket"])
        if len(numbers):
            numbers = numbers[np.argsort(bucket, kind="stable")]
            *sums, other = np.concatenate([np.stack(opened(f["sums"], len(asked) + 1)[0]) for f in came], axis=1)
            for o, own_sums in zip(out, sums, strict=True):
                o[numbers] = own_sums
            shared[numbers] = other > 0
    return out, shared


class Sorted(NamedTuple):
    """A block's n-grams of n words to be sent, by bucket and then in the order of their words: where each bucket's start; their counts; the numbers of the words that are sent of them; for those longer than a
    stem, to how many each of one word less leads (else None)."""

    cuts: list[int]
    counts: np.ndarray
    codes: list[np.ndarray]
    more: np.ndarray | None


def by_bucket(block: Block, places: list[np.ndarray], numbers: np.ndarray, bucket: np.ndarray, buckets: int, counts: np.ndarray, least: int, most: int) -> list[Sorted]:
    """What asked() told, sorted. A longer n-gram that is asked about has its first words asked about too."""
    stem, out, start, before, total = stem_of(least, most), [], 0, None, 0
    for n, at, gram, first in block.levels():
        if n >= least:
            own = slice(start, start + len(places[n - least]))
            order, held = in_order(bucket[own], buckets)
            place, number = places[n - least][order], numbers[own][order]
            start = own.stop
            cuts = np.searchsorted(held, np.arange(buckets + 1)).tolist()
            more = np.bincount(before[place], minlength=sum(out[-1].cuts[-1:])) if n > stem else None
            out.append(Sorted(cuts, counts[:, number], [block.code[place + k] for k in (range(n) if n <= stem else [n - 1])], more))
            if stem <= n < most:  # at each place, where its n-gram now is
                row = np.empty(len(first), np.int64)
                row[number - total] = np.arange(len(number))
                before = np.empty(len(block.code), np.int64)
                before[at] = row[gram]
        total += len(first)
    return out


def packed_grams(words: pa.Array, levels: list[Sorted], bucket: int, lookup: np.ndarray) -> bytes:
    """One bucket's n-grams: last word and counts of each, then how many there are of each length, the letters of each of the words, the other words of a stem (the first as the difference to the one before) or where longer ones belong, and the words. lookup is scratch."""
    cut = [(x.cuts[bucket], x.cuts[bucket + 1]) for x in levels]
    known = np.sort(np.concatenate([c[a:z] for (a, z), x in zip(cut, levels, strict=True) for c in x.codes]))
    known = known[changes(known)]
    lookup[known] = np.arange(len(known))
    spelt = words.take(pa.array(known))
    offsets = np.frombuffer(spelt.buffers()[1], np.int32, len(known) + 1)
    lead = []
    for j, ((a, z), x) in enumerate(zip(cut, levels, strict=True)):
        if x.more is not None:
            lead.append(x.more[slice(*cut[j - 1])])
        elif len(x.codes) > 1:
            lead += [np.diff(lookup[x.codes[0][a:z]], prepend=0), *(lookup[c[a:z]] for c in x.codes[1:-1])]
    last = np.concatenate([lookup[x.codes[-1][a:z]] for (a, z), x in zip(cut, levels, strict=True)])
    counts = np.concatenate([x.counts[:, a:z] for (a, z), x in zip(cut, levels, strict=True)], axis=1)
    text = spelt.buffers()[2]
    return squeezed(last, *counts, tail=laid([np.array([z - a for a, z in cut]), np.diff(offsets), *lead]) + (text.to_pybytes()[: offsets[-1]] if text else b""))


def sent(rows: DataFrame, names: list[str], buckets: int, asked: list[str], rounds: list[tuple[int, int]], known: list[str] | None = None) -> DataFrame:
    """(block, bucket, data) of dealt rows, or of packed blocks (with found, if there were rounds before), dealt by bucket: a block's n-grams of the last round in the bucket, with what is asked of "count" and "df"."""
    is_packed, has_found, which = "data" in rows.columns, "found" in rows.columns, [("count", "df").index(a) for a in asked]
    least, most = rounds[-1]

    def blocks(batches: Batches) -> Iterator[tuple[int, Block, list[dict]]]:
        if not is_packed:
            yield from ((0, b, []) for _, b in in_blocks(batches, names, ADDED_WORDS))
            return
        for b in batches:
            yield from zip(b.column("block").to_pylist(), unpacked(b, names), b.column("found").to_pylist() if has_found else [[]] * b.num_rows, strict=True)

    def packed(block: int, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        has, data = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([block] * len(has), pa.int64()), pa.array(has, pa.int32()), pa.array(data, pa.binary())], ["block", "bucket", "data"])

    def run(batches: Batches) -> Batches:
        for block, b, found in blocks(batches):
            shared = told(b, buckets, known, rounds[:-1], found)[1] if has_found else np.empty(0, bool)
            b.longest = most
            places, numbers, bucket = b.asked(buckets, least, most, shared)
            if not len(numbers):
                continue
            levels = by_bucket(b, places, numbers, bucket, buckets, b.counts()[which], least, most)
            lookup = np.empty(len(b.words), np.int64)
            held, size = [], 0
            for k in np.unique(bucket).tolist():
                held.append((k, packed_grams(b.words, levels, k, lookup)))
                size += len(held[-1][1])
                if size >= BYTES:
                    yield packed(block, held)
                    held, size = [], 0
            if held:
                yield packed(block, held)

    return rows.mapInArrow(run, "block long, bucket int, data binary").repartitionById(buckets, F.col("bucket"))


def gathered(batches: Batches, k: int, least: int, most: int) -> tuple[list[tuple[int, int, int]], pa.Array, list[Level], np.ndarray, list[np.ndarray]]:
    """(parts, words, levels, codes, sums) of what came to a task: each part's block, bucket and length; the words, sorted; the different n-grams by length; which one of all of them each row is, and their sums."""
    rows = sorted(((blk, bkt, data) for b in batches for blk, bkt, data in zip(b.column("block").to_pylist(), b.column("bucket").to_pylist(), b.column("data").to_pylist(), strict=True)), key=lambda r: r[:2])
    lengths, stem = range(least, most + 1), stem_of(least, most)
    parts, numbers, listed, held, own = [], [], [], [], []  # held: of each row, its parts' sizes by length and the arrays of lead()
    while rows:
        blk, bkt, data = rows.pop()
        arrays, tail = opened(data, 1 + k)
        (sizes, letters, *lead), text = lifted(tail, 2 + sum(n - 1 if n <= stem else 1 for n in lengths))
        parts.append((blk, bkt, len(arrays[0])))
        numbers.append(np.stack(arrays))
        held.append((sizes.tolist(), lead))
        offsets = np.concatenate([[0], np.cumsum(letters, dtype=np.int64)])
        listed.append(pa.LargeStringArray.from_buffers(len(letters), pa.py_buffer(offsets.tobytes()), pa.py_buffer(text)))
    for a in (parts, numbers, listed, held):
        a.reverse()
    if not parts:
        return [], pa.array([], pa.large_string()), [], np.empty(0, np.int64), [np.empty(0, np.int64)] * k
    shift = np.cumsum([0, *map(len, listed)]).tolist()
    coded = pa.concat_arrays(listed).dictionary_encode()
    listed.clear()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    words, rank = coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]
    numbers = np.concatenate(numbers, axis=1)
    codes, levels, ends, at, start = np.empty(numbers.shape[1], np.int64), [], np.cumsum([0, *(p[2] for p in parts)]), 0, 0
    begin = ends[:-1].copy()
    number, different = np.empty(0, np.int64), 0
    for n in lengths:
        size = np.array([s[n - least] for s, _ in held], np.int64)
        place = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)  # of this length's rows among all
        begin += size
        by = lambda j: rank[np.concatenate([(np.cumsum(lead[j], dtype=np.int64) if j == at else lead[j]) + np.int64(x) for (_, lead), x in zip(held, shift, strict=False)])]  # noqa: B023, E731
        last = rank[numbers[0][place] + np.repeat(np.array(shift[:-1]), size)]
        if n <= stem:
            columns = [*(by(at + j) for j in range(n - 1)), last]
            at += n - 1
            number, first = ranked(columns[0], len(words))
            for c in columns[1:]:
                number, first = ranked(number * len(words) + c, len(first) * len(words))
            columns, parent = [c[first].astype(np.int32) for c in columns], None
        else:
            more = np.concatenate([lead[at] for _, lead in held]).astype(np.int64)
            at += 1
            before = np.repeat(number, more)
            number, first = ranked(before * len(words) + last, different * len(words))
            parent = before[first]
            columns = [*(c[parent] for c in columns), last[first].astype(np.int32)]
        codes[place] = number + start
        different = len(first)
        levels.append(Level(n, columns, place[first], parent))
        start += different
    return parts, words, levels, codes, [np.bincount(codes, weights=v, minlength=start).astype(np.int64) for v in numbers[1:]]


def summed(rows: DataFrame, buckets: int, asked: str, longest: int = LONGEST, lengths: bool = True) -> DataFrame:
    """(n, gram, asked) of the whole corpus; without n if lengths aren't wanted."""
    schema = f"{'n int, ' * lengths}gram string, {asked} long"

    def run(batches: Batches) -> Batches:
        _, words, levels, _, (sums,) = gathered(batches, 1, 1, longest)
        if not levels:
            return
        words, order = words.cast(pa.string()), outline(levels)
        order = order[sums[order] > 0]
        length = np.repeat(np.arange(1, longest + 1, dtype=np.int32), [len(x.first) for x in levels])
        columns = [np.concatenate([x.columns[k] if k < x.n else np.zeros(len(x.first), np.int32) for x in levels]) for k in range(longest)]
        for at in range(0, len(order), ROWS):
            piece = order[at : at + ROWS]
            gram = joined_words(words, [c[piece] for c in columns], length[piece])
            yield pa.RecordBatch.from_pydict(({"n": pa.array(length[piece])} if lengths else {}) | {"gram": gram, asked: pa.array(sums[piece])})

    return sent(rows, [c for c in rows.columns if c != "id"], buckets, [asked], [(1, longest)]).mapInArrow(run, schema)


def met(blocks: DataFrame, names: list[str], buckets: int, asked: list[str], then: Callable[[Block, list[np.ndarray]], Batches], schema: str, longest: int = LONGEST) -> DataFrame:
    """What then makes of each block and what was asked of its n-grams, in the order of levels(), over the corpus. "own" asks which n-grams are a block's own: each is of the first block that has it."""
    counted = [a for a in asked if a != "own"]
    rounds = [(least, min(most, longest)) for least, most in ROUNDS if least <= longest]
    tasks = tasks_of(buckets)

    def back(batches: Batches, turn: tuple[int, int]) -> Batches:
        parts, _, levels, codes, sums = gathered(batches, len(counted), *turn)
        own = np.zeros(len(codes), np.int64)
        for level in levels:
            own[level.first] = 1
        known = dict(zip(counted, (s[codes] for s in sums), strict=True)) | {"own": own}
        several = (np.bincount(codes) > 1)[codes].astype(np.int64)
        at = 0
        for blk, bkt, size in parts:
            yield pa.RecordBatch.from_arrays([pa.array([blk]), pa.array([bkt], pa.int32()), pa.array([squeezed(*(known[a][at : at + size] for a in asked), several[at : at + size])], pa.binary())], ["block", "bucket", "sums"])
            at += size

    def run(batches: Batches) -> Batches:
        for b in batches:
            for block, found in zip(unpacked(b, names), b.column("found").to_pylist(), strict=True):
                yield from then(block, told(block, buckets, asked, rounds, found)[0])

    def joined(returned: list[DataFrame]) -> DataFrame:
        rows = reduce(DataFrame.unionAll, (r.withColumn("turn", F.lit(turn)) for turn, r in enumerate(returned)))
        found = rows.repartition(tasks, "block").groupBy("block").agg(F.collect_list(F.struct("turn", "bucket", "sums")).alias("found"))  # a block has at most its n-grams
        return blocks.repartition(tasks, "block").join(found.hint("shuffle_merge"), "block").select("block", "ids", "data", "found")

    returned: list[DataFrame] = []
    for turn in range(len(rounds)):
        asking = sent(joined(returned) if returned else blocks, names, buckets, counted, rounds[: turn + 1], asked)
        returned.append(materialize(asking.mapInArrow(partial(back, turn=rounds[turn]), "block long, bucket int, sums binary"), "sums"))  # which frees the disk of its shuffle
    return joined(returned).select("ids", "data", "found").mapInArrow(run, schema)
