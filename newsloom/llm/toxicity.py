"""Toxicity by a chain of linear classifiers.

The categories are predicted in turn: each is a logistic regression over the words of a document and over the
probabilities of the categories before it. In training, these probabilities are out-of-fold: each labelled
document's come from a model that was fitted without its fold, so later models learn how far
earlier ones can be trusted on documents they haven't seen.

What a document has of a feature is the number of its distinct words with it; features are lower-cased words and
their beginnings. So a word's contribution is one number for each category, and scoring a text is a
sum over its distinct words; its length has a weight of its own.

The model is fitted on the driver, on at most SAMPLE labelled documents of each class of each category, picked by a
seeded hash of the identifier: this bound is a parameter, and holds for fitting alone. Every document is scored,
over its whole text. The model (at most FEATURES features for each category) is broadcast.

Cases: a null text is empty and is scored from its length alone; documents without labels are scored only;
several labels of one document: the largest of each category; a category of which the labels
have one class only is predicted as the share of that class, so without toxic labels nothing is rejected; null labels
count as none; empty tables give none; repeated rows are scored each for itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from newsloom.llm.common import bounded_batches, fresh

SAMPLE, FEATURES, FOLDS, SEED = 1500, 4096, 4, 42
PREFIXES = (4, 5, 6)
#: Features are numbered by a checksum; so many numbers leave the chosen ones apart.
SPACE = 1 << 22
TOKEN = re.compile(r"[^\W\d_]+")


@lru_cache(1 << 14)
def features_of(word: str) -> tuple[int, ...]:
    """Numbers of a word's features: itself, and its beginnings."""
    return (crc32(word.encode()) % SPACE, *(crc32(f"{word[:n]}*".encode()) % SPACE for n in PREFIXES if len(word) > n))


def distinct_words(text: str) -> set[str]:
    return set(TOKEN.findall(text.lower()))


def length_feature(n: int) -> float:
    return float(np.log1p(n)) / 5.0


class Linear:
    """A logistic regression: weights by feature, of the length, of earlier probabilities, and an intercept."""

    def __init__(self, weights: dict[int, float], length: float, earlier: list[float], intercept: float):
        self.weights, self.length, self.earlier, self.intercept = weights, length, earlier, intercept

    def word(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features_of(word))

    def probability(self, words_sum: float, n: int, earlier: list[float]) -> float:
        z = words_sum + self.length * length_feature(n) + self.intercept + sum(w * p for w, p in zip(self.earlier, earlier, strict=True))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))


def counted_features(words: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """A document's features in order, and how many of its words have each."""
    return np.unique(np.fromiter((f for w in words for f in features_of(w)), np.int32), return_counts=True)


class Design:
    """Training documents as flat arrays: (row, feature, count) of each feature that a row has, and the rows' lengths."""

    def __init__(self, row: np.ndarray, feature: np.ndarray, count: np.ndarray, length: np.ndarray):
        self.n, self.row, self.feature, self.count, self.length = len(length), row, feature, count, length

    @staticmethod
    def of_words(rows: list[set[str]]) -> Design:
        found = [counted_features(words) for words in rows]
        sizes = [len(f) for f, _ in found]
        join = lambda i, kind: np.concatenate([x[i] for x in found] or [[]]).astype(kind)
        return Design(np.repeat(np.arange(len(rows), dtype=np.int32), sizes), join(0, np.int32), join(1, np.float32), np.array([length_feature(len(w)) for w in rows]))

    @staticmethod
    def of_table(t: pa.Table) -> Design:
        """From lists of features and counts, and numbers of words."""
        flat = lambda c, kind: np.concatenate([x.flatten().to_numpy() for x in t.column(c).chunks] or [[]]).astype(kind)
        sizes = np.array(pc.list_value_length(t.column("features")).to_pylist(), np.int64)
        return Design(np.repeat(np.arange(t.num_rows, dtype=np.int32), sizes), flat("features", np.int32), flat("counts", np.float32), np.array([length_feature(n) for n in t.column("n").to_pylist()]))

    def part(self, inside: np.ndarray) -> Design:
        """The documents where inside is true."""
        keep = inside[self.row]
        return Design((np.cumsum(inside) - 1).astype(np.int32)[self.row[keep]], self.feature[keep], self.count[keep], self.length[inside])

    def probabilities(self, model: Linear, earlier: np.ndarray) -> np.ndarray:
        """What model.probability gives for each document."""
        weights = np.zeros(SPACE, np.float32)
        weights[list(model.weights)] = list(model.weights.values())
        z = np.bincount(self.row, self.count * weights[self.feature], self.n) + model.length * self.length + model.intercept
        return 1 / (1 + np.exp(-np.clip(z + earlier @ np.array(model.earlier).reshape(earlier.shape[1]), -40, 40)))

    def chosen(self, y: np.ndarray, most: int, least: float = 12.0) -> np.ndarray:
        """The features that tell the classes apart best, by chi-square over documents, and at least so much."""
        n, ones = float(len(y)), float(y.sum())
        k = np.bincount(self.feature, minlength=SPACE).astype(np.float64)
        pos = np.bincount(self.feature[y[self.row] == 1], minlength=SPACE)
        able = np.flatnonzero((k >= 3) & (k < n))
        delta = pos[able] * n - k[able] * ones
        score = n * delta**2 / (k[able] * (n - k[able]) * ones * (n - ones))
        able, score = able[score >= least], score[score >= least]
        return np.sort(able[np.lexsort((able, -score))[:most]])


def fit(design: Design, y: np.ndarray, earlier: np.ndarray, most: int = FEATURES, rounds: int = 300, ridge: float = 1e-4) -> Linear:
    """A logistic regression by gradient steps with a rate for each weight; both classes weigh alike."""
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 1e-3) / (len(y) + 2e-3) if len(y) else 1e-3
        return Linear({}, 0.0, [0.0] * earlier.shape[1], float(np.log(share / (1 - share))))
    chosen = design.chosen(y, most)
    is_chosen = np.zeros(SPACE, bool)
    is_chosen[chosen] = True
    keep = is_chosen[design.feature]
    cols, at, counts = np.searchsorted(chosen, design.feature[keep]), design.row[keep], design.count[keep]
    dense = np.column_stack([design.length, earlier, np.ones(design.n)])
    w, v = np.zeros(len(chosen)), np.zeros(dense.shape[1])
    gw, gv = np.full(len(chosen), 1e-8), np.full(dense.shape[1], 1e-8)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    for _ in range(rounds):
        z = dense @ v + np.bincount(at, counts * w[cols], design.n)
        err = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        dw, dv = np.bincount(cols, counts * err[at], len(chosen)) + ridge * w, dense.T @ err + ridge * v
        gw += dw * dw
        gv += dv * dv
        w -= 0.3 * dw / np.sqrt(gw)
        v -= 0.3 * dv / np.sqrt(gv)
    return Linear({int(f): float(x) for f, x in zip(chosen, w, strict=True)}, float(v[0]), [float(x) for x in v[1:-1]], float(v[-1]))


def fit_chain(design: Design, labels: np.ndarray, folds: int = FOLDS) -> list[Linear]:
    """A model for each column of labels; each sees out-of-fold probabilities of those before it."""
    chain, earlier = [], np.empty((design.n, 0))
    fold = np.arange(design.n) % folds
    for k in range(labels.shape[1]):
        y = labels[:, k]
        chain.append(fit(design, y, earlier))
        if k + 1 < labels.shape[1]:
            out = np.zeros(design.n)
            for f in range(folds):
                part = fit(design.part(fold != f), y[fold != f], earlier[fold != f])
                out[fold == f] = design.part(fold == f).probabilities(part, earlier[fold == f])
            earlier = np.column_stack([earlier, out])
    return chain


def training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int, id_column: str) -> DataFrame:
    """(features, counts, n, labels...) of at most sample documents of each class of each category; features are made on the executors."""
    each = labels.where(F.col(id_column).isNotNull()).groupBy(id_column).agg(*(F.max(c.cast("int")).alias(k) for k, c in categories.items())).dropna()
    each = each.withColumn("order", F.xxhash64(F.col(id_column), F.lit(SEED)))
    picked = None
    for k in categories:
        for value in (0, 1):
            some = each.where(F.col(k) == value).orderBy("order", id_column).limit(sample)
            picked = some if picked is None else picked.unionAll(some)
    picked = picked.distinct().drop("order")  # at most 2 * sample * categories rows
    picked = docs.select(id_column, "text").join(F.broadcast(picked), id_column).where("text is not null")
    picked = picked.select("text", F.xxhash64(id_column, F.lit(SEED + 1)).alias("first"), F.xxhash64("text").alias("second"), *categories)

    names = list(categories)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [distinct_words(t) for t in map(pa.StringScalar.as_py, b.column("text"))]
            found = [counted_features(w) for w in words]
            rest = [b.column(c) for c in ("first", "second", *names)]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32())), pa.array([len(w) for w in words], pa.int32()), *rest], ["features", "counts", "n", "first", "second", *names])

    schema = "features array<int>, counts array<int>, n int, first long, second long, " + ", ".join(f"{k} int" for k in categories)
    return picked.mapInArrow(run, schema).orderBy("first", "second").drop("first", "second")


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = SAMPLE, id_column: str = "doc_id") -> list[Linear]:
    bounded_batches(docs.sparkSession)
    t = training_rows(docs, labels, categories, sample, id_column).toArrow()
    y = np.column_stack([np.array(t.column(k).to_pylist(), np.int64) for k in categories])
    return fit_chain(Design.of_table(t), y)


def score_documents(docs: DataFrame, chain: list[Linear], names: list[str], keep: bool = False, id_column: str = "doc_id") -> DataFrame:
    """A column of probabilities for each category, named by names, beside the id, or beside all columns of docs (keep=True)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    wanted = docs if keep else docs.select(F.col(id_column), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        parts: dict[str, tuple[float, ...] | None] = {}

        def part(word: str):
            if len(parts) >= 1 << 18:
                parts.clear()
            each = tuple(m.word(word) for m in models)
            parts[word] = each = each if any(each) else None
            return each

        for b in batches:
            found: list[list[float]] = [[] for _ in models]
            for text in map(pa.StringScalar.as_py, b.column("text")):
                words = distinct_words(text or "")
                sums = [0.0] * len(models)
                for w in words:
                    each = parts[w] if w in parts else part(w)
                    if each:
                        for k, x in enumerate(each):
                            sums[k] += x
                earlier: list[float] = []
                for k, m in enumerate(models):
                    earlier.append(m.probability(sums[k], len(words), earlier))
                    found[k].append(round(earlier[-1], 9))
            columns = [b.column(i) for i in range(b.num_columns)] if keep else [b.column(id_column)]
            own = b.schema.names if keep else [id_column]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, found)], [*own, *names])

    own = wanted.schema.fields if keep else [wanted.schema[id_column]]
    return wanted.mapInArrow(run, StructType([*own, *(StructField(n, DoubleType()) for n in names)]))


def categories() -> dict[str, Column]:
    """The chain of the queries, from general to particular: bad writing, then toxic writing."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE, id_column: str = "doc_id") -> DataFrame:
    """(id, low_quality_probability, toxic_probability, toxic) for each document."""
    chain = train(docs, labels, categories(), sample, id_column)
    return score_documents(docs, chain, [f"{k}_probability" for k in categories()], id_column=id_column).withColumn("toxic", F.col("toxic_probability") >= threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE, id_column: str = "doc_id") -> DataFrame:
    """docs without those that are toxic."""
    chain = train(docs, labels, categories(), sample, id_column)
    names = dict(zip(categories(), (fresh(docs, f"{k}_probability") for k in categories()), strict=True))
    scored = score_documents(docs, chain, list(names.values()), True, id_column)
    return scored.where(F.col(names["toxic"]) < threshold).drop(*names.values())
