"""Scores of trends, keywords and sets, as Column expressions over doubles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def momentum(recent: Column, previous: Column) -> Column:
    """Growth of the logarithm of counts, never below 0."""
    return F.greatest(F.lit(0.0), F.log1p(recent.cast("double")) - F.log1p(previous.cast("double")))


def momentum_score(recent: Column, previous: Column) -> Column:
    return 1.0 - F.exp(-momentum(recent, previous))


def recency_score(age_days: Column) -> Column:
    return F.exp(-F.greatest(age_days, F.lit(0)).cast("double") / 3.0)


def strength_score(value: Column, most: Column) -> Column:
    return F.when((value <= 0) | (most <= 0), 0.0).otherwise(F.least(F.lit(1.0), F.log1p(value) / F.log1p(most)))


def trend_score(strength: Column, momentum: Column, recency: Column) -> Column:
    return 0.45 * strength + 0.35 * momentum + 0.20 * recency


def growth_percent(recent: Column, previous: Column) -> Column:
    """In percent of the previous count; null where that is 0."""
    return F.when(previous > 0, (recent - previous).cast("double") / previous * 100.0)


def growth_label(recent: Column, previous: Column) -> Column:
    return F.when(previous == 0, "NEW").otherwise(F.format_string("%+.1f%%", growth_percent(recent, previous)))


def jaccard(common: Column, left: Column, right: Column) -> Column:
    """Of the sizes of two sets and of their intersection; 0 where one is empty."""
    return F.when((left == 0) | (right == 0), 0.0).otherwise(common.cast("double") / (left + right - common))


def idf(documents: Column, with_term: Column) -> Column:
    """Smooth inverse document frequency."""
    return F.log((1.0 + documents) / (1.0 + with_term)) + 1.0


def tf(count: Column) -> Column:
    """Sublinear term frequency."""
    return 1.0 + F.log(count.cast("double"))


def pmi(count: Column, total: Column, unigrams: list[Column] | Column, tokens: Column) -> Column:
    """Pointwise mutual information in bits, of an n-gram's count and its words' counts (a list, or an array column); 0 where a count is."""
    log2 = lambda x: F.log2(x.cast("double"))
    if isinstance(unigrams, list):
        parts = reduce(lambda a, b: a + b, (log2(u) - log2(tokens) for u in unigrams))
    else:
        parts = F.aggregate(unigrams, F.lit(0.0), lambda acc, u: acc + log2(u) - log2(tokens))
    return F.coalesce(F.when((count > 0) & (total > 0), log2(count) - log2(total) - parts), F.lit(0.0))


def association_boost(pmi_: Column, count: Column, total: Column) -> Column:
    """Between .76 and 1.24 by normalised PMI, damped for n-grams seen fewer than three times."""
    p = F.greatest(count.cast("double") / total, F.lit(1e-12))
    npmi = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), pmi_ / F.greatest(-F.log2(p), F.lit(1e-9))))
    reliable = F.least(F.lit(1.0), F.sqrt(F.greatest(count, F.lit(0)).cast("double") / 3.0))
    return F.greatest(F.lit(0.76), F.least(F.lit(1.24), 1.0 + 0.24 * F.tanh(npmi * 2.0) * reliable))


def phrase_quality(size: Column, inner_stopwords: Column, entity_like: Column) -> Column:
    """Between .45 and 1.20: longer phrases and names gain a little, stopwords inside cost."""
    length = F.when(size == 2, 1.02).when(size == 3, 1.04).when(size == 4, 1.05).when(size == 5, 1.06).otherwise(1.0)
    inner = F.when(inner_stopwords > 0, F.greatest(F.lit(0.78), 1.0 - 0.07 * inner_stopwords)).otherwise(1.0)
    return F.greatest(F.lit(0.45), F.least(inner * length * F.when(entity_like, 1.06).otherwise(1.0), F.lit(1.20)))


def frequency_boost(count: Column) -> Column:
    return F.when(count <= 0, 1.0).otherwise(F.least(F.lit(1.24), 1.0 + 0.08 * F.log1p(count.cast("double"))))


def phrase_weight(size: Column) -> Column:
    return F.when(size == 1, 0.55).when(size == 3, 1.06).when(size == 4, 1.12).when(size == 5, 1.15).otherwise(1.0)
