"""Licence scans: Aho-Corasick over normalised words, and a parser of licence expressions.

One automaton finds notice phrases and the identifier tag as runs of whole words in the lower-cased text. Where
it finds the tag, the expression behind it is read from the text and put in order by a shunting-yard parser
(with binds before and, and before or), and evaluated: to the licences it names, and to whether some choice that it
leaves is permissive throughout.

Cases: a null text is empty; an empty text has no words, no labels and score 0; phrases that overlap
all count; an expression that can't be parsed gives the labels of the licences it names and nothing else;
repeated rows are scanned each for itself; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import bounded_batches

#: Phrases of the contract and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Further notice phrases: fixed values, from the texts of the licences.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"

#: What identifiers begin with, longest first, and their labels; whether their licences are permissive: fixed values.
FAMILIES = [
    ("cc-by-nc", "cc-by-nc", False), ("cc-by-sa", "cc-by-sa", False), ("cc-by-nd", "cc-by-nd", False), ("unlicense", "unlicense", True),
    ("apache-2", "apache-2", True), ("apache-1", "apache-1", True), ("agpl", "agpl", False), ("lgpl", "lgpl", False), ("cc-by", "cc-by", True),
    ("gpl", "gpl", False), ("mit", "mit", True), ("bsd", "bsd", True), ("isc", "isc", True), ("mpl", "mpl", False), ("epl", "epl", False), ("bsl", "bsl", True),
    ("cc0", "cc0", True), ("zlib", "zlib", True), ("0bsd", "bsd", True),
]

#: To a space: what is no word; A-Z to a-z. Bytes above ASCII belong to words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
EXPRESSION = re.compile(rb"(?<![a-z0-9\x80-\xff])spdx-license-identifier:[ \t]*([a-z0-9.+() \t-]*)")
BINDS = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str]:
    """The expression's tokens in postfix order; ValueError where it is none.

    Only an operator or the end may follow a licence, so prose behind an expression ends it.
    """
    out, held, want = [], [], True
    for token in re.findall(r"[()]|[^()\s]+", expression):
        if token in BINDS:
            if want:
                raise ValueError("an operator without a left side")
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[token]:
                out.append(held.pop())
            held.append(token)
            want = True
        elif token == "(":
            if not want:
                break
            held.append(token)
        elif token == ")":
            if want:
                raise ValueError("nothing before a closing bracket")
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ValueError("a closing bracket too many")
            held.pop()
        elif want:
            out.append(token)
            want = False
        else:
            break
    if want:
        raise ValueError("an expression without an end")
    while held:
        if held[-1] == "(":
            raise ValueError("an opening bracket too many")
        out.append(held.pop())
    return out


def family(identifier: str) -> tuple[str, bool] | None:
    """(label, permissive) of a licence identifier, None for others."""
    return next(((label, free) for start, label, free in FAMILIES if identifier == start or identifier.startswith((f"{start}-", f"{start}+", f"{start}."))), None)


@lru_cache(4096)
def evaluate(expression: str) -> tuple[frozenset[str], bool | None]:
    """(labels, permissive): and needs both sides permissive, or one side; an exception is a label of its own and leaves its licence as it is.

    permissive is None where the expression is none, or names a licence that is not known.
    """
    try:
        order = postfix(expression)
    except ValueError:
        named = (family(t) for t in re.findall(r"[^()\s]+", expression))
        return frozenset(f[0] for f in named if f), None
    stack: list[tuple[frozenset[str], bool | None]] = []
    for token in order:
        if token not in BINDS:
            known = family(token)
            stack.append((frozenset([known[0]]), known[1]) if known else (frozenset([token] if "exception" in token else []), None))
            continue
        (b, free_b), (a, free_a) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((a | b, free_a))
        elif token == "and":
            stack.append((a | b, False if False in (free_a, free_b) else None if None in (free_a, free_b) else True))
        else:
            stack.append((a | b, True if True in (free_a, free_b) else None if None in (free_a, free_b) else False))
    return stack[0]


class Scanner:
    """The automaton, over words between single spaces."""

    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        for phrase, label in {**NOTICES, **BASE, TAG: None}.items():
            self.automaton.add_word(f" {phrase} ", (label, phrase in BASE, phrase.count(" ") + 1, len(phrase) + 2))
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, permissive, score)"""
        data = text.encode()
        tokens = data.translate(FOLD).split()
        # A letter for each byte: the automaton sees ASCII phrases only.
        joined = f" {b' '.join(tokens).decode('latin-1')} "
        base, others, starts, tagged = set(), set(), [], False
        spaces: list[int] = []
        for end, (label, is_base, _, size) in self.automaton.iter(joined):
            if label is None:
                tagged = True
                continue
            if not is_base:
                others.add(label)
                continue
            base.add(label)
            if not spaces:
                spaces = [m.start() for m in re.finditer(" ", joined)]
            starts.append(bisect_right(spaces, end - size + 1) - 1)
        verdicts = []
        if tagged:
            for m in EXPRESSION.finditer(data.translate(LOWER)):
                labels, free = evaluate(m[1].decode().strip())
                others |= labels
                verdicts.append(free)
        permissive = None if not verdicts or None in verdicts else all(verdicts)
        # Each kind of evidence leaves less doubt: a tag most, then a phrase of the contract, then another notice.
        doubt = (0.1 if verdicts else 1.0) * 0.5 ** len(starts) * 0.7 ** len(others - base)
        return len(tokens), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | others)), permissive, 1.0 - doubt


def scan_documents(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """What Scanner.scan finds in each document, with its id."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "permissive", "score"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.bool_(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            rows = [scanner.scan(t or "") for t in map(pa.StringScalar.as_py, b.column("text"))]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns], ["id", *names])

    out = docs.select(F.col(id_column).alias("id"), "text").mapInArrow(run, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, permissive boolean, score double")
    return out.withColumnRenamed("id", id_column)
