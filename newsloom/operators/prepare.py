"""Dataset preparation: checks, cleaning, and splits that keep the classes' shares."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import clean_text, join_text
from newsloom.operators.dedup import deduplicate

REQUIRED = ("id", "title", "content", "label")
SLICE, MOST_CLASSES = 1 << 16, 10_000

# Categories of an external corpus and ours.
CATEGORIES = {
    "Giải trí": "Giải trí", "Kinh doanh": "Kinh doanh", "Thể thao": "Thể thao", "Thời sự": "Thời sự", "Giáo dục": "Giáo dục",
    "Khoa học công nghệ": "Khoa học", "Đời sống": "Đời sống", "Xe": "Xe", "Sức khỏe": "Sức khỏe", "Thế giới": "Thế giới", "Pháp luật": "Pháp luật",
}


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in mapping.items() if a in df.columns})


def validate_schema(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> None:
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"the table lacks {', '.join(missing)}")


def fill_missing(df: DataFrame) -> DataFrame:
    """Without rows that lack a label; a missing title or content is empty."""
    return df.dropna(subset=["label"]).fillna("", subset=["title", "content"])


def add_clean_text(df: DataFrame) -> DataFrame:
    """With title and content cleaned each for itself, and both joined as text and clean_text. Markup that one of them leaves open ends with it."""
    df = df.withColumns({c: clean_text(F.col(c)) for c in ("title", "content")}).withColumn("text", join_text(F.col("title"), F.col("content")))
    return df.withColumn("clean_text", F.col("text"))


def drop_blank(df: DataFrame, column: str = "clean_text") -> DataFrame:
    return df.where(F.trim(column) != "")


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("count"))


def too_small(df: DataFrame, least: int = 3, label: str = "label") -> DataFrame:
    return class_counts(df, label).where(F.col("count") < least)


def check_class_min_samples(df: DataFrame, min_required: int = 3, label: str = "label") -> None:
    if bad := too_small(df, min_required, label).orderBy(label).limit(20).collect():
        raise ValueError(f"fewer than {min_required} rows in: " + "; ".join(f"{r[0]} has {r[1]}" for r in bad))


def validate_split_arguments(test_size: float, val_size: float) -> None:
    if not (0 < test_size < 1 and 0 < val_size < 1):
        raise ValueError("a share for testing or validation is not between 0 and 1")
    if test_size + val_size >= 1:
        raise ValueError("the shares for testing and validation leave nothing to train on")


def quotas(counts: dict, total: int) -> dict:
    """total dealt to classes by their counts, whole numbers, by largest remainder."""
    n = sum(counts.values())
    exact = {k: total * c / n for k, c in counts.items()}
    out = {k: math.floor(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], str(k)))[: total - sum(out.values())]:
        out[k] += 1
    return out


def stratified_split(df: DataFrame, test_size: float = 0.15, val_size: float = 0.15, seed: int = 42, label: str = "label", id_column: str = "id") -> DataFrame:
    """df with split: train, validation or test. The held-out part is rounded up, then halved likewise.

    Rows are ranked by a seeded hash within their class. A rank is that of the row in its slice of the class (about SLICE rows, by the first digits of the hash)
    after the rows of the slices before, so a class may be as large as it likes. The driver holds the classes' counts, at most MOST_CLASSES.
    """
    validate_split_arguments(test_size, val_size)
    counts = {r[0]: r[1] for r in class_counts(df, label).limit(MOST_CLASSES + 1).collect()}
    if len(counts) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    n = sum(counts.values())
    held = math.ceil(round(n * (test_size + val_size), 9))
    out = quotas(counts, held) if n else {}
    test = quotas(out, math.ceil(round(held * test_size / (test_size + val_size), 9))) if held else {}
    cut = df.sparkSession.createDataFrame([(k, int(test.get(k, 0)), int(out[k])) for k in counts] or [], f"of {dict(df.dtypes)[label]}, test int, held int")
    digits = next(d for d in range(33) if 16**d * SLICE >= n)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))))
    rows = df.select(F.struct("*").alias("row"), F.col(label).alias("class"), order.alias("order")).withColumn("slice", F.substring("order", 1, digits))
    before = F.sum("size").over(Window.partitionBy("class").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = rows.groupBy("class", "slice").agg(F.count("*").alias("size")).withColumn("before", F.coalesce(before, F.lit(0)))
    slices = slices.join(F.broadcast(cut), F.col("class").eqNullSafe(F.col("of"))).select(F.col("of").alias("c"), F.col("slice").alias("s"), "before", "test", "held")
    rank = F.row_number().over(Window.partitionBy("class", "slice").orderBy("order")) + F.col("before")
    rows = rows.join(slices, F.col("class").eqNullSafe(F.col("c")) & (F.col("slice") == F.col("s"))).withColumn("rank", rank)
    return rows.select("row.*", F.when(F.col("rank") <= F.col("test"), "test").when(F.col("rank") <= F.col("held"), "validation").otherwise("train").alias("split"))


def split_table(df: DataFrame, label: str = "label") -> DataFrame:
    """Counts of each class by split, and the training share in percent."""
    t = df.groupBy(label).pivot("split", ["train", "validation", "test"]).count().fillna(0, subset=["train", "validation", "test"])
    total = F.col("train") + F.col("validation") + F.col("test")
    return t.withColumn("total", total).withColumn("train_pct", F.bround(F.col("train") / total * 100, 2))


def imbalance(df: DataFrame, label: str = "label") -> DataFrame:
    """The largest class over the smallest."""
    return class_counts(df, label).agg((F.max("count") / F.min("count")).alias("ratio"))


def text_stats(df: DataFrame, column: str) -> DataFrame:
    """Characters and words of a column: mean, median, least and most."""
    size = df.select(F.length(column).alias("chars"), F.size(F.filter(F.split(column, r"\s+"), lambda w: w != "")).alias("words"))
    one = lambda c: [F.round(F.avg(c), 6).alias(f"{c}_mean"), F.expr(f"percentile({c}, 0.5D)").alias(f"{c}_median"), F.min(c).cast("long").alias(f"{c}_min"), F.max(c).cast("long").alias(f"{c}_max")]
    return size.agg(*one("chars"), *one("words"))


def remap(df: DataFrame, column: str, mapping: dict[str, str] = CATEGORIES) -> DataFrame:
    """Rows whose column is a key of mapping, with its value instead."""
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return df.where(F.col(column).isin(*mapping)).withColumn(column, table[F.col(column)])


def sample_per_class(df: DataFrame, label: str, per_class: int = 500, seed: int = 42, id_column: str = "id", order: list[Column] | None = None) -> DataFrame:
    """At most per_class rows of each class, by a seeded order, in that order."""
    by = order or [F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")))]
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*by, id_column))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= per_class).drop("_rank")


def require_labels(df: DataFrame, column: str = "human_category") -> None:
    """ValueError where a row has none."""
    if df.where(F.coalesce(F.trim(column), F.lit("")) == "").limit(1).count():
        raise ValueError(f"{column} is empty for some rows")


def disjoint(a: DataFrame, b: DataFrame, column: str = "id") -> bool:
    return a.select(column).intersect(b.select(column)).isEmpty()


def prepare(raw: DataFrame, mapping: dict[str, str] | None = None, min_required: int = 3, **split) -> DataFrame:
    """Raw rows (with pos, their order) to clean, unique rows with a split."""
    df = rename(raw, mapping or {})
    validate_schema(df)
    df = deduplicate(drop_blank(add_clean_text(fill_missing(df))))
    check_class_min_samples(df, min_required)
    return stratified_split(df, **split)


def metadata(raw: DataFrame, split: DataFrame, version: str, label: str = "label") -> DataFrame:
    """One row that describes a prepared dataset."""
    before = raw.agg(F.count("*").alias("raw_rows"))
    after = split.agg(
        F.count("*").alias("kept_rows"),
        F.sort_array(F.collect_set(label)).alias("categories"),
        *(F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in ("train", "validation", "test")),
    )
    return before.crossJoin(after).withColumn("version", F.lit(version))
