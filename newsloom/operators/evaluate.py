"""Quality of predictions: rows have ground_truth, prediction, margin and correct."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import margin_bucket, margin_buckets
from newsloom.operators.filters import few_values
from newsloom.session import materialize, release

THRESHOLDS = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30)


def ratio(a, b):
    """a / b, 0 where b is."""
    return F.when(b == 0, 0.0).otherwise(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)))


def accuracy(p: DataFrame) -> DataFrame:
    n, good = F.count("*"), F.count_if("correct")
    return p.agg(n.alias("total"), good.alias("correct"), (n - good).alias("errors"), F.round(ratio(good, n), 9).alias("accuracy"))


def per_class(p: DataFrame, only_true: bool = False) -> DataFrame:
    """Precision, recall, F1 and support of each label that is true or predicted (or only true)."""
    sides = p.select(F.explode(F.array(F.struct(F.col("ground_truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), F.col("correct").cast("int").alias("tp")), F.struct(F.col("prediction").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp")))).alias("s"))
    c = sides.groupBy("s.label").agg(F.sum("s.tp").alias("tp"), F.sum("s.p").alias("predicted"), F.sum("s.t").alias("support"))
    if only_true:
        c = c.where("support > 0")
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("label", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round("f1", 9).alias("f1"), "support")


def averages(classes: DataFrame) -> DataFrame:
    """Macro and weighted averages over classes, as two rows."""
    names = ("precision", "recall", "f1")
    macro = classes.agg(F.lit("macro avg").alias("average"), *(F.round(F.avg(c), 6).alias(c) for c in names), F.sum("support").alias("support"))
    weighted = classes.agg(F.lit("weighted avg").alias("average"), *(F.round(ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")), 6).alias(c) for c in names), F.sum("support").alias("support"))
    return macro.unionByName(weighted)


def confusion(p: DataFrame) -> DataFrame:
    """(ground_truth, prediction, count), the long form."""
    return p.groupBy("ground_truth", "prediction").agg(F.count("*").alias("count"))


def confusion_matrix(p: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """A row for each true label and a column for each; labels by default are all there are, in order."""
    names = labels or few_values(p.select("ground_truth").union(p.select("prediction")))
    have = p.groupBy("ground_truth").pivot("prediction", names).count()
    rows = p.sparkSession.createDataFrame([(n,) for n in names], "ground_truth string")
    return rows.join(have, "ground_truth", "left").fillna(0, subset=names)


def confusion_pairs(p: DataFrame) -> DataFrame:
    """Errors by pair, with their share of the true class's errors."""
    e = p.where(~F.col("correct")).groupBy("ground_truth", "prediction").agg(F.count("*").alias("count"))
    share = F.col("count") / F.sum("count").over(Window.partitionBy("ground_truth"))
    return e.withColumn("error_rate_within_class", F.round(share, 9)).orderBy(F.desc("count"), "ground_truth", "prediction")


def margin_stats(p: DataFrame, empty: bool = True, dash: str = "–") -> DataFrame:
    """Each margin bucket's totals; buckets without rows as zeros, or left out (empty=False)."""
    s = p.groupBy(margin_bucket(F.col("margin"), dash).alias("bucket")).agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"))
    names = p.sparkSession.createDataFrame(list(enumerate(margin_buckets(dash))), "position int, bucket string")
    s = names.join(s, "bucket", "left" if empty else "inner").fillna(0, subset=["total", "correct"])
    bad = F.col("total") - F.col("correct")
    return s.select("position", "bucket", "total", "correct", bad.alias("errors"), F.round(ratio(F.col("correct"), F.col("total")), 9).alias("accuracy"), F.round(ratio(bad, F.col("total")), 9).alias("error_rate")).orderBy("position")


def bucket_shares(p: DataFrame) -> DataFrame:
    """Each bucket's rows and percentage of all."""
    s = margin_stats(p).select("bucket", "total")
    return s.crossJoin(s.agg(F.sum("total").alias("n"))).select("bucket", "total", F.round(ratio(F.col("total") * 100, F.col("n")), 6).alias("percent"))


def medians(df: DataFrame, group: str, value: str, cells: int = 1024) -> DataFrame:
    """(group, median): exact medians of doubles, by selection. Nulls and NaN don't count; a group without values has no row.

    The values of a group between the bounds that its middle is known to have are dealt to cells of one width and counted; the cell
    that has the middle gives the next bounds, until they are one value. A pass keeps a row for each cell and group; five or six passes narrow down any doubles, and most take two or three.
    The bounds are a row for each of the two middles of each group: groups are classes, at most 10,000 of them (ValueError).
    """
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    ends = rows.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    found = materialize(ends.select("g", "low", "high", F.posexplode(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2"))).alias("which", "rank")), "bounds")
    if found.count() > 20_000:
        raise ValueError("medians are for at most 10,000 groups")
    while not found.where("low < high").isEmpty():
        bounds = F.broadcast(found.withColumnRenamed("g", "of"))
        inside = rows.join(bounds, F.col("g").eqNullSafe(F.col("of")) & F.col("v").between(F.col("low"), F.col("high")))
        # Halves, as the difference of two doubles can be infinite.
        width = F.col("high") / 2 - F.col("low") / 2
        cell = F.when((width > 0) & (width < float("inf")), F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / width * cells), F.lit(cells - 1))).otherwise((F.col("v") > F.col("low")).cast("long") + (F.col("v") == F.col("high")).cast("long"))
        each = inside.groupBy("g", "which", "rank", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.sum("n").over(Window.partitionBy("g", "which").orderBy("cell")) - F.col("n")
        each = each.withColumn("before", before).where("rank >= before and rank < before + n")
        found, old = materialize(each.select("g", "low", "high", "which", (F.col("rank") - F.col("before")).alias("rank")), "bounds"), found
        release(old)
    return found.groupBy(F.col("g").alias(group)).agg(F.avg("low").alias("median"))


def per_class_margin(p: DataFrame) -> DataFrame:
    """Each true class's accuracy and margins."""
    each = p.groupBy("ground_truth").agg(
        F.count("*").alias("total"), F.count_if("correct").alias("correct"), F.count_if(~F.col("correct")).alias("errors"),
        F.round(F.avg(F.col("correct").cast("double")), 9).alias("accuracy"), F.round(F.avg("margin"), 9).alias("avg_margin"),
    )
    middle = medians(p, "ground_truth", "margin").select(F.col("ground_truth").alias("of"), F.round("median", 9).alias("median_margin"))
    return each.join(middle, F.col("ground_truth").eqNullSafe(F.col("of")), "left").drop("of")


def thresholds(p: DataFrame, at: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """What refusing predictions below each margin would do; one pass, a fixed handful of rows."""
    t = p.sparkSession.createDataFrame([(float(x),) for x in at], "threshold double")
    low = F.col("margin") < F.col("threshold")
    r = p.crossJoin(F.broadcast(t)).groupBy("threshold").agg(F.count_if(low).alias("unknown"), F.count_if(~low).alias("remaining"), F.count_if(~low & F.col("correct")).alias("good"), F.count_if(low & ~F.col("correct")).alias("errors_caught"))
    return r.select("threshold", "unknown", "remaining", F.round(ratio(F.col("good"), F.col("remaining")), 9).alias("remaining_accuracy"), "errors_caught").orderBy("threshold")


def below(p: DataFrame, at: tuple[float, ...] = (0.10, 0.20, 0.30, 0.50)) -> DataFrame:
    """Rows with a margin below each threshold, and their percentage."""
    t = p.sparkSession.createDataFrame([(float(x),) for x in at], "threshold double")
    r = p.crossJoin(F.broadcast(t)).groupBy("threshold").agg(F.count_if(F.col("margin") < F.col("threshold")).alias("count"), F.count("*").alias("n"))
    return r.select("threshold", "count", F.round(ratio(F.col("count") * 100, F.col("n")), 6).alias("percent")).orderBy("threshold")


def least_certain(p: DataFrame, limit: int = 100, wrong: bool = False) -> DataFrame:
    """The predictions with the lowest margins, or only the wrong ones."""
    return (p.where(~F.col("correct")) if wrong else p).orderBy("margin", "id").limit(limit)


def mismatches(p: DataFrame, stored: str, computed: str) -> DataFrame:
    """Rows whose stored category is another one than the computed."""
    return p.where(~F.col(stored).eqNullSafe(F.col(computed)))


def score_drift(p: DataFrame, stored: str, computed: str, tolerance: float = 1e-6) -> DataFrame:
    return p.where(F.abs(F.col(stored) - F.col(computed)) > tolerance)


def ablation(results: DataFrame, stage: str = "stage", metric: str = "macro_f1") -> DataFrame:
    """results (a row for each stage) with the change from the stage before, and whether a row is the best."""
    delta = F.col(metric) - F.lag(metric).over(Window.orderBy(stage))
    best = results.agg(F.max_by(stage, F.struct(metric, F.col(stage))).alias("best"))
    return results.withColumn("delta", F.round(delta, 9)).crossJoin(best).withColumn("is_best", F.col(stage) == F.col("best")).drop("best")


def extremes(classes: DataFrame) -> DataFrame:
    """The strongest and the weakest class by F1."""
    return classes.agg(F.max_by("label", F.struct("f1", "label")).alias("strongest"), F.max("f1").alias("strongest_f1"), F.min_by("label", F.struct("f1", "label")).alias("weakest"), F.min("f1").alias("weakest_f1"))


def diagonal(p: DataFrame) -> DataFrame:
    """What lies on the diagonal of the confusion matrix, and off it."""
    on = F.col("ground_truth") == F.col("prediction")
    return p.agg(F.count_if(on).alias("diagonal"), F.count_if(~on).alias("off_diagonal"))


def labelling_sheet(rows: DataFrame, columns: tuple[str, ...] = ("human_category", "label_note")) -> DataFrame:
    """rows with empty columns to fill in, where they lack them."""
    return rows.withColumns({c: F.lit("") for c in columns if c not in rows.columns})
