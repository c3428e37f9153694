"""Filters that the analytics share. A missing or empty value filters nothing."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def effective_time() -> Column:
    return F.coalesce("published_at", "crawled_at")


def effective_day() -> Column:
    """The day of an article, in the session's time zone."""
    return effective_time().cast("date")


@dataclass(frozen=True)
class Filters:
    """from_date and to_date are inclusive; dated keeps only articles with a publication time."""

    from_date: str | dt.date | None = None
    to_date: str | dt.date | None = None
    category: str | None = None
    source: str | None = None
    content_source: str | None = None
    dated: bool = False

    def apply(self, news: DataFrame) -> DataFrame:
        """news, filtered by conditions that reach the scan where they are on plain columns."""
        conditions = [F.col(c) == v for c in ("category", "source", "content_source") if (v := getattr(self, c))]
        if self.dated:
            conditions.append(F.col("published_at").isNotNull())
        if self.from_date:
            conditions.append(effective_day() >= F.lit(parse_day(self.from_date)))
        if self.to_date:
            conditions.append(effective_day() <= F.lit(parse_day(self.to_date)))
        return news.where(reduce(lambda a, b: a & b, conditions)) if conditions else news

    def only_dated(self) -> Filters:
        return replace(self, dated=True)


def parse_day(value: str | dt.date) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value.strip())


def check_days(from_date: str | None, to_date: str | None) -> tuple[dt.date | None, dt.date | None]:
    """Both as dates; ValueError where one is no ISO date, or they are in the wrong order."""
    a, b = (parse_day(d) if d else None for d in (from_date, to_date))
    if a and b and a > b:
        raise ValueError("from_date must not be after to_date")
    return a, b


def within(value: int, least: int, most: int, name: str) -> int:
    """value; ValueError outside of its bounds."""
    if not least <= value <= most:
        raise ValueError(f"{name} must be from {least} to {most}")
    return value


def in_crawl_range(day: Column, from_date: str | None, to_date: str | None) -> Column:
    """Inclusive; without bounds all rows, with one no row without a day."""
    a, b = check_days(from_date, to_date)
    conditions = [day >= F.lit(a)] * bool(a) + [day <= F.lit(b)] * bool(b)
    return F.coalesce(reduce(lambda x, y: x & y, conditions), F.lit(False)) if conditions else F.lit(True)


def published_between(news: DataFrame, start: str, end: str) -> DataFrame:
    """Published from start up to, but without, end."""
    t = F.col("published_at")
    return news.where((t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(end).cast("timestamp_ntz")))


def few_values(df: DataFrame, most: int = 1000) -> list:
    """The distinct values of df's one column, in order, for the driver. ValueError if there are more than most."""
    found = [r[0] for r in df.distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} different values")
    return sorted(v for v in found if v is not None)
