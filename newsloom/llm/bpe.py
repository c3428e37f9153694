"""BPE encoding as a streaming transducer with bounded lookahead, and incremental decoding.

Text is fed in pieces. It is cut into chunks without white space, these into words, and a word is a run of symbols that
the transducer reads. Nothing is merged: the encoding of symbols is the one row of tokens of which each two neighbours stay two where
they meet (`Merges.beside` undoes their merges to see), which is found from left to right. How far the right context
of a token can reach is computed from the merge list (`sufficient_lookahead`): tokens that end at least that far from the end of what was read can't change
any more and are given out, so the memory is bounded by the lookahead, whatever the length of the word. The ids of short chunks and
words, as the transducer gave them, are remembered in tables of bounded size.

Decoding is a state machine that takes token bytes one after the other and gives out text as soon as it
is whole, with U+FFFD for bytes that are no UTF-8. The encoder feeds it as it goes.

Letters and digits are those of Unicode 16, lower case is that of Unicode 17, as in the tokenizers library: Python's tables (15.1), and
what later versions added, as fixed values. Every code point is encoded as the library does.

Cases: a null text is empty; an empty text has no ids; strings of special tokens in a text become these tokens;
control characters that are no white space are words; characters that compose with those before them are held until one
comes that doesn't; repeated rows are encoded each for itself; other columns are ignored.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import json
import os
import re
import sys
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import bounded_batches

#: White space of Unicode, which is that of str.split() but for the four ASCII separators.
SPACE = "\t-\r \x85\xa0  -     　"
SPACES = re.compile(f"[{SPACE}]+")
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Letters and digits that Unicode 16 added, as ranges, and lower-case forms that Unicode 16 and 17 added.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_DIGITS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEW_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Characters of a chunk that is remembered, chunks that are, and characters of a piece.
SHORT, REMEMBERED, PIECE = 64, 1 << 18, 1 << 16


def ranges(inside: Callable[[str], bool], more: list[tuple[int, int]]) -> str:
    """The characters that are inside, and more, as ranges of a character class."""
    out, start = [f"\\U{a:08x}-\\U{b:08x}" for a, b in more], None
    for c in range(sys.maxunicode + 2):
        if c <= sys.maxunicode and inside(chr(c)):
            start = c if start is None else start
        elif start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(1)
def classes() -> tuple[str, str]:
    """Letters and digits, as ranges."""
    return ranges(str.isalpha, NEW_LETTERS), ranges(lambda c: unicodedata.category(c)[0] == "N", NEW_DIGITS)


@lru_cache(1)
def composing() -> frozenset[str]:
    """Characters that may compose with one before them, though they are no marks: those behind the first of a decomposition, and Hangul's."""
    out = {chr(c) for a, b in ((0x1161, 0x1176), (0x11A8, 0x11C3)) for c in range(a, b)}
    for c in map(chr, range(sys.maxunicode + 1)):
        d = unicodedata.decomposition(c)
        if d and d[0] != "<":
            out.update(chr(int(x, 16)) for x in d.split()[1:])
    return frozenset(out)


def settled(text: str) -> int:
    """How much of text can be composed before what follows is known: up to the last character that no mark or part can be."""
    for i in range(len(text) - 1, -1, -1):
        if text[i] < "\x80" or (not unicodedata.combining(text[i]) and text[i] not in composing()):
            return i
    return 0


def folded(text: str) -> str:
    """Composed, in lower case, each character for itself (of which only a sigma at a word's end knows better)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return (text.lower() if "\u03a3" not in text else "".join(map(str.lower, text))).translate(NEW_LOWER)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, n = [], 256
    for b in range(256):
        letters.append(chr(b if b in plain else n))
        n += b not in plain
    return letters


def sufficient_lookahead(merges: list[tuple[str, str]], symbols: dict[str, int]) -> int:
    """Symbols to the right of a token's end beyond which nothing can change the token.

    A token t at the end of what is known is lost if it merges with a token w on its right, before t's own
    use in a larger token. Whether that happens depends on w: on its symbols, and on whether a part
    at w's end is lost in the same way to a merge of a lower rank. reach[m] is that extent for the merge m; ranks
    fall along such a chain, so one pass in the order of the ranks finds it.
    """
    rank = {pair: i for i, pair in enumerate(merges)}
    made = {}  # the merge that makes a token first
    for i, (a, b) in enumerate(merges):
        made.setdefault(a + b, i)
    by_left: dict[str, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))  # ranks, largest reach so far

    @lru_cache(None)
    def ends(token: str) -> tuple[tuple[str, int], ...]:
        """The tokens at the end of token's derivation, each with the rank by which it is used up."""
        out, limit = [(token, len(merges))], len(merges)
        while token in made:
            limit = made[token]
            token = merges[limit][1]
            out.append((token, limit))
        return tuple(out)

    length = lambda t: symbols.get(t) or len(t.removesuffix("</w>"))
    most = 0
    for m, (t, w) in enumerate(merges):
        beyond = 0
        for end, limit in ends(w):
            ranks, reach = by_left[end]
            if k := bisect_left(ranks, min(limit, m)):
                beyond = max(beyond, reach[k - 1])
        far = length(w) + beyond
        ranks, reach = by_left[t]
        ranks.append(m)
        reach.append(max(far, reach[-1] if reach else 0))
        most = max(most, far)
    assert len(rank) == len(merges)
    return most + 1


class Memory:
    """What is known of at most so many keys, in two generations: when the new one is full it becomes the old one, of which what is asked for again moves back."""

    def __init__(self, most: int = 0):
        self.new, self.old, self.most = {}, {}, (most or REMEMBERED) // 2

    def find(self, key):
        """What is known of a key that isn't among the new ones."""
        found = self.old.get(key)
        return found if found is None else self.keep(key, found)

    def keep(self, key, value):
        if len(self.new) >= self.most:
            self.new, self.old = {}, self.new
        self.new[key] = value
        return value


#: The lookahead of vocabulary files that this process has read.
_lookaheads: dict[tuple[str, float], int] = {}


class Merges:
    """A merge list, and how its tokens come about."""

    def __init__(self, merges: list[tuple[str, str]], symbols: list[str]):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        #: Each token that merging its own symbols gives: the rank of its last merge and the two parts; a symbol has none.
        self.made: dict[str, tuple[int, str, str] | None] = dict.fromkeys(symbols)
        for i, (a, b) in enumerate(merges):
            # Merging has one outcome, so of several merges that spell a token at most one is its own.
            if a in self.made and b in self.made and a + b not in self.made and not self.crossed(a, b, i):
                self.made[a + b] = (i, a, b)
        self.same = {t: t for t in self.made}  # one string for each token, however often it is met
        self.pairs = Memory()

    def crossed(self, a: str, b: str, rank: int | None = None) -> bool:
        """Whether a merge joins a's end to b's start before both are whole and used up; rank: that of their own merge, which isn't one.

        Backwards in time, of the two tokens at the border the one made last is undone, of equals the right one. What stands
        there merges if its rank comes before those by which the left (an equal merge there is further left, so it comes first)
        and the right are used up.
        """
        never = len(self.rank)
        left = right = never if rank is None else rank
        while True:
            r = self.rank.get((a, b), never)
            if r < left and r <= right:
                return True
            x, y = self.made[a], self.made[b]
            if y is not None and (x is None or x[0] <= y[0]):
                right, b, _ = y
            elif x is not None:
                left, _, a = x
            else:
                return False

    def beside(self, pair: tuple[str, str]) -> bool:
        """Whether two tokens stay two where they meet."""
        stay = self.pairs.new.get(pair)
        if stay is None:
            stay = self.pairs.find(pair)
        return self.pairs.keep(pair, not self.crossed(*pair)) if stay is None else stay


class Sizes(dict):
    """For the first three symbols of a text, the sizes of the tokens that may begin there, longest first."""

    def __init__(self, tokens: Iterable[str], end: str):
        self.of = defaultdict(set)
        for t in tokens:
            symbols = t.removesuffix(end) if end else t
            self.of[symbols[:3]].add(len(symbols))

    def __missing__(self, key: str) -> tuple[int, ...]:
        found = set().union(*(self.of.get(key[:i], ()) for i in range(1, len(key) + 1)))
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[key] = tuple(sorted(found, reverse=True))
        return out


class Word:
    """The transducer: symbols of one word in, tokens out as soon as they are stable.

    It holds the symbols behind the last token that it gave out, at most twice the lookahead and a token.
    """

    def __init__(self, merges: Merges, end: str, lookahead: int, sizes: Sizes):
        self.merges, self.end, self.lookahead, self.fitting = merges, end, lookahead, sizes
        self.held = ""
        self.before: str | None = None  # the token given out last
        self.most = 0

    def tokens(self, ending: str = "") -> list[str]:
        """The encoding of what is held, behind the token before: the one row of tokens of which all neighbours stand beside each other.

        From left to right the longest token that fits is taken; where none fits, the one before is taken shorter. A place is reached by
        one row of tokens only, so one from which nothing fits is never tried again.
        """
        held, same, beside, known, fitting = self.held, self.merges.same.get, self.merges.beside, self.merges.pairs.new.get, self.fitting
        n, at, k, left = len(held), 0, 0, self.before
        out, path, dead = [], [], set()
        while at < n:
            sizes = fitting[held[at : at + 3]]
            while k < len(sizes):
                end = at + sizes[k]
                k += 1
                if end > n or end in dead:
                    continue
                token = same(held[at:end] if end < n else held[at:] + ending)
                if token:
                    if left is None:
                        stay = True
                    elif (stay := known((left, token))) is None:
                        stay = beside((left, token))
                    if stay:
                        path.append((at, k, left))
                        out.append(token)
                        at, k, left = end, 0, token
                        break
            else:
                dead.add(at)
                at, k, left = path.pop()
                out.pop()
        return out

    def push(self, symbols: str) -> Iterator[str]:
        """Read symbols of which the word's last may be one; the tokens that they make stable."""
        for start in range(0, len(symbols), self.lookahead):
            self.held += symbols[start : start + self.lookahead]
            self.most = max(self.most, len(self.held))
            stable, given = len(self.held) - self.lookahead - 1, 0  # the last symbol may get the ending
            if stable <= 0:
                continue
            for token in self.tokens():
                if given + len(token) > stable:
                    break
                given += len(token)
                self.before = token
                yield token
            self.held = self.held[given:]

    def finish(self) -> list[str]:
        """The tokens that are left at the word's end; after it the next word may come."""
        out = self.tokens(self.end) if self.held else []
        self.held, self.before = "", None
        return out


class Encoder:
    """What a vocabulary file of lower-cased word BPE with an ending for the last symbol of a word says."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.letters = byte_letters()
        self.merges = Merges(merges, [x for c in self.letters for x in dict.fromkeys((c, c + self.end))])
        self.sizes = Sizes(self.merges.made, self.end)
        known = path, os.path.getmtime(path)
        if known not in _lookaheads:
            _lookaheads[known] = sufficient_lookahead(merges, {x: 1 for c in self.letters for x in (c, c + self.end)})
        self.lookahead = _lookaheads[known]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        letter, digit = classes()
        for name, inside in (("[\\p{L}]", f"[{letter}]"), ("[\\p{N}]", f"[{digit}]"), ("\\p{L}", letter), ("\\p{N}", digit), ("\\s", SPACE)):
            pattern = pattern.replace(name, inside)
        self.words = re.compile(pattern)
        #: What a word that goes on can go on with, for the kind of its first character.
        self.runs = (re.compile(f"[{letter}]+"), re.compile(f"[^{SPACE}{letter}{digit}]+"))
        self.codes = {t: i.to_bytes(4, "little") for t, i in self.vocab.items()}
        self.bytes_to_letters = str.maketrans({chr(b): c for b, c in enumerate(self.letters)})
        self.chunks, self.known, self.whole = Memory(2 * REMEMBERED), Memory(), self.word()

    def word(self) -> Word:
        return Word(self.merges, self.end, self.lookahead, self.sizes)

    def symbols(self, text: str) -> str:
        """A letter for each byte of text; that of a printable ASCII character is itself."""
        return text if text.isascii() and text.isprintable() else text.encode().decode("latin-1").translate(self.bytes_to_letters)

    def word_ids(self, word: str) -> bytes:
        """The ids of a whole short word."""
        ids = self.known.new.get(word) or self.known.find(word)
        if ids is None:
            self.whole.held = self.symbols(word)  # shorter than the lookahead
            ids = self.known.keep(word, b"".join([self.codes[t] for t in self.whole.finish()]))
        return ids

    def chunk_ids(self, chunk: str) -> bytes:
        """The ids of a whole short chunk without white space."""
        ids = self.chunks.new.get(chunk) or self.chunks.find(chunk)
        if ids is None:
            text = folded(chunk)
            if text.isalpha():  # what most chunks are
                ids = self.word_ids(text)
            elif text[-1] in ",.;:!?" and text[:-1].isalpha():
                ids = self.word_ids(text[:-1]) + self.word_ids(text[-1])
            else:
                ids = b"".join(map(self.word_ids, self.words.findall(text)))
            self.chunks.keep(chunk, ids)
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text, each as a little-endian unsigned 32-bit integer."""
        t = Transducer(self)
        return b"".join([*(t.feed(text[at : at + PIECE]) for at in range(0, len(text), PIECE)), t.finish()])


class Chunk:
    """A long chunk, read in pieces: composed, folded, split into words, and these fed to the transducer as they come."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.word = encoder, encoder.word()
        self.raw = self.text = ""  # not composed yet; not split yet
        self.run: re.Pattern | None = None  # what goes on with the open word

    def feed(self, raw: str) -> bytes:
        raw = self.raw + raw
        n = settled(raw)
        self.raw = raw[n:]
        return self.split(folded(raw[:n]), False)

    def finish(self) -> bytes:
        raw, self.raw = self.raw, ""
        return self.split(folded(raw), True)

    def split(self, text: str, whole: bool) -> bytes:
        """The ids that text adds. Unless it is whole, its last word may go on, and three characters tell what a word at an apostrophe is."""
        e, out = self.encoder, []
        text, at = self.text + text, 0
        push = lambda part: out.extend([e.codes[t] for t in self.word.push(e.symbols(part))])
        if self.run:
            if more := self.run.match(text):
                push(more[0])
                at = more.end()
            if at == len(text) and not whole:
                self.text = ""
                return b"".join(out)
            out.extend([e.codes[t] for t in self.word.finish()])
            self.run = None
        while at < len(text):
            if not whole and len(text) - at < 3:
                break
            w = e.words.match(text, at)
            at = w.end()
            if at < len(text) or whole or not (run := next((r for r in e.runs if r.fullmatch(w[0])), None)):
                out.append(e.word_ids(w[0]) if len(w[0]) <= SHORT else b"".join([e.codes[t] for t in (*self.word.push(e.symbols(w[0])), *self.word.finish())]))
            else:
                push(w[0])
                self.run = run
        self.text = text[at:]
        return b"".join(out)


class Transducer:
    """Ids of a text that comes in pieces; what it holds is bounded, whatever the lengths of the text, its chunks and words."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.tail = ""  # the start of what may be a special token
        self.held = ""  # a short chunk that may go on
        self.open: Chunk | None = None  # a long chunk that may go on; then none is held

    def feed(self, piece: str) -> bytes:
        text, special = self.tail + piece, self.encoder.special
        widest = min(len(text), max(map(len, special), default=1) - 1)
        n = next((n for n in range(widest, 0, -1) if any(n < len(s) and s.startswith(text[-n:]) for s in special)), 0)
        self.tail = text[len(text) - n :]
        return self.parts(text[: len(text) - n])

    def finish(self) -> bytes:
        """The ids that are left at the text's end."""
        tail, self.tail = self.tail, ""
        return self.parts(tail) + self.close()

    def parts(self, text: str) -> bytes:
        special = self.encoder.special
        if not any(s in text for s in special):
            return self.plain(text)
        out = []
        for part in self.encoder.specials.split(text):
            out.append(self.close() + special[part].to_bytes(4, "little") if part in special else self.plain(part))
        return b"".join(out)

    def plain(self, text: str) -> bytes:
        """The ids of a piece without special tokens, but for those of a chunk that may go on."""
        out, last = [], ""
        if self.open:
            space = SPACES.search(text)
            out.append(self.open.feed(text[: space.start()] if space else text))
            if not space:
                return out[0]
            out.append(self.close())
            text = text[space.end() :]
        text, self.held = self.held + text, ""
        text = text.lower() if text.isascii() else text  # fewer different chunks
        chunks = SPACES.split(text) if SEPARATORS.search(text) else text.split()
        if chunks and not SPACES.match(text, len(text) - 1):
            last = chunks.pop()
        known, encoder = self.encoder.chunks, self.encoder
        for c in chunks:
            out.append(known.new.get(c) or (encoder.chunk_ids(c) if len(c) <= SHORT else self.long(c)))
        if len(last) <= SHORT:
            self.held = last
        else:
            self.open = Chunk(self.encoder)
            out.append(self.open.feed(last))
        return b"".join(out)

    def long(self, chunk: str) -> bytes:
        c = Chunk(self.encoder)
        return c.feed(chunk) + c.finish()

    def close(self) -> bytes:
        """The ids that are left of the last chunk, which is whole."""
        if self.open:
            out, self.open = self.open.finish(), None
            return out
        held, self.held = self.held, ""
        return self.encoder.chunk_ids(held) if held else b""


class ByteToText:
    """Text from bytes that come in pieces; holds at most the three bytes of an unfinished character."""

    def __init__(self):
        self.decoder = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self.decoder.decode(data)

    def finish(self) -> str:
        return self.decoder.decode(b"", final=True)


class Decoder:
    """Ids to text. The vocabulary has no decoder of its own: then tokens are joined by spaces, as they are written."""

    def __init__(self, encoder: Encoder):
        names = {i: t for t, i in {**encoder.vocab, **encoder.special}.items()}
        self.names = {i: t.encode() for i, t in names.items()}
        back = {c: b for b, c in enumerate(encoder.letters)}
        self.bytes = {i: bytes(back[c] for c in t.removesuffix(encoder.end)) + (b" " if t.endswith(encoder.end) else b"") for t, i in encoder.vocab.items() if t not in encoder.special}
        self.bytes |= {i: t.encode() for t, i in encoder.special.items()}

    def joined(self, ids: bytes) -> Iterator[str]:
        """Pieces of the library's text of ids, token by token."""
        machine = ByteToText()
        space = b""
        for i in memoryview(ids).cast("I"):
            yield machine.feed(space + self.names[i])
            space = b" "
        yield machine.finish()

    def plain(self, ids: bytes) -> Iterator[str]:
        """Pieces of readable text of ids: token bytes, and a space after each word."""
        machine = ByteToText()
        for i in memoryview(ids).cast("I"):
            yield machine.feed(self.bytes[i])
        yield machine.finish()


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) for each document."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)  # not kept for the next task: workers that wait should be small
        names = Decoder(encoder).names
        names = [names[i] for i in range(len(names))] if max(names, default=-1) + 1 == len(names) else names
        gc.disable()  # nothing here makes cycles, and the memories are large to walk through
        for b in batches:
            n, digest, decoded, all_ids = [], [], [], []
            for text in map(pa.StringScalar.as_py, b.column("text")):
                text, transducer, machine = text or "", Transducer(encoder), ByteToText()
                forth, back, count, kept = hashlib.sha256(), hashlib.sha256(), 0, []
                for at in range(0, len(text) + 1, PIECE):  # one piece more than whole ones, which ends the text
                    data = transducer.feed(text[at : at + PIECE])
                    data += transducer.finish() if at + PIECE > len(text) else b""
                    view = memoryview(data).cast("I")
                    forth.update(data)
                    words = b" ".join(map(names.__getitem__, view))
                    back.update(machine.feed(b" " + words if count and words else words).encode())
                    count += len(view)
                    if ids:
                        kept.extend(view)
                back.update(machine.finish().encode())
                n.append(count)
                digest.append(forth.hexdigest())
                decoded.append(back.hexdigest())
                all_ids.append(kept)
            columns = [b.column("id"), pa.array(n, pa.int64()), pa.array(digest), pa.array(decoded)] + [pa.array(all_ids, pa.list_(pa.int32()))] * ids
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])
        gc.enable()

    out = docs.select(F.col(id_column).alias("id"), "text").mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
    return out.withColumnRenamed("id", id_column)
