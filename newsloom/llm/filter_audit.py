"""How filters interact: what each of five filters removes in every order of them, per part of the documents.

A document is its mask, a bit for each filter that it fails. Of each part there are three histograms over the 32 masks: of all
documents, of those labelled good and of those labelled toxic. The histograms of many parts are stacked as the rows of one matrix and multiplied by
integer matrices of 32 masks by 600 outcomes (120 orders of 5 steps): kept after a step, removed by it,
redundant (its filter fails, but an earlier one has removed the document) and unique (no other filter fails).

Filter E, a text that a smaller identifier has too, needs no join of the texts: documents are counted by the SHA-256 of the text and
part, with the counts at the least identifier; of a text, all rows fail but those of the least identifier of all parts. Copies combine before the shuffle.

Cases: a null text is empty and fails A alone (E too if it is a copy); a null part is the empty string; a null identifier is larger than any other, and has no
labels; rows repeated with their identifier are documents of their own that none of them fails E for; a document is good or toxic if any of its labels says so; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import WORD, text_or_empty
from newsloom.session import materialize

FILTERS, STEPS, PARTS = "ABCDE", 5, 64
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def content_mask(text: Column) -> Column:
    """The bits of A to D for a text: too short, too repetitive, too many capitals, special characters."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, capitals = F.size(words), F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = {"A": n < 100, "B": F.size(F.array_distinct(words)) * 100 < n * 80, "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 10, "D": text.rlike(r"[#$%&*|]")}
    return sum((F.when(c, bit(k)).otherwise(0) for k, c in fails.items()), F.lit(0))


def incidence() -> dict[str, np.ndarray]:
    """Matrices of MASKS by 600: whether a document of a mask counts for an outcome of a step of an order, the orders one after the other."""
    masks, letters = np.arange(MASKS)[:, None], np.array([bit(x) for o in ORDERS for x in o])
    before = np.array([sum(bit(x) for x in o[:s]) for o in ORDERS for s in range(STEPS)])
    fails, gone = masks & letters > 0, masks & before > 0
    found = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique": masks == letters}
    return {k: m.astype(np.int64) for k, m in found.items()}


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang", id_column: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part and mask."""
    of = labels.where(f"{id_column} is not null").groupBy(F.col(id_column).alias("id"))
    of = materialize(of.agg(*(F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0))).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic")))), "labels")
    text = text_or_empty()
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(part, F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("sha"), content_mask(text).alias("mask"))
    rows = materialize(rows, "masks")  # plain tables: Spark can split what a repeated identifier has
    known = rows.where("id is not null").join(of, "id", "left").select(*rows.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    rows = known.unionAll(rows.where("id is null").withColumns({"good": F.lit(0).cast("long"), "toxic": F.lit(0).cast("long")}))

    # All rows of a text have one mask of A to D. A text's rows with one identifier pass or fail E together.
    counts = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    each = rows.withColumn("n", F.lit(1).cast("long")).groupBy("sha", "part", "id", "mask").agg(*counts)
    first = F.struct(F.isnull("id").alias("none"), "id", "n", "good", "toxic")
    each = each.groupBy("sha", "part", "mask").agg(*counts, F.min(first).alias("first"))
    least = F.min(F.struct("first.none", "first.id")).over(Window.partitionBy("sha"))  # a row for each part
    each = each.withColumn("passes", F.struct("first.none", "first.id").eqNullSafe(least))
    stay = [F.when(F.col("passes"), F.col(f"first.{c}")).otherwise(0).alias(c) for c in ("n", "good", "toxic")]
    go = [(F.col(c) - F.when(F.col("passes"), F.col(f"first.{c}")).otherwise(0)).alias(c) for c in ("n", "good", "toxic")]
    two = F.explode(F.array(F.struct("part", "mask", *stay), F.struct("part", F.col("mask").bitwiseOR(F.lit(bit("E"))).alias("mask"), *go)))
    return each.select(two.alias("x")).select("x.*").where("n > 0").groupBy("part", "mask").agg(*counts)


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", id_column: str = "doc_id") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows for each part."""
    histograms = masks(docs, labels, part, id_column).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("h"))  # at most 32 of a part
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, outcomes = incidence(), len(ORDERS) * STEPS
        letter = np.array([FILTERS.index(x) for o in ORDERS for x in o])
        for whole in batches:
            for at in range(0, whole.num_rows, PARTS):
                b = whole.slice(at, PARTS)
                stacked = np.zeros((3, b.num_rows, MASKS), np.int64)
                for i, h in enumerate(b.column("h").to_pylist()):
                    for x in h:
                        stacked[:, i, x["mask"]] = x["n"], x["good"], x["toxic"]
                every, good, toxic = stacked
                removed = every @ m["removed"]
                totals = np.stack([removed[:, letter == k].sum(axis=1) for k in range(len(FILTERS))], axis=1)
                found = [every @ m["kept"], removed, every @ m["redundant"], every @ m["unique"], good @ m["removed"], toxic @ m["removed"], totals[:, letter]]
                parts = b.column("part").take(pa.array(np.repeat(np.arange(b.num_rows), outcomes)))
                orders, steps = [o for o in ORDERS for _ in range(STEPS)] * b.num_rows, np.tile(np.arange(1, STEPS + 1, dtype=np.int32), b.num_rows * len(ORDERS))
                yield pa.RecordBatch.from_arrays([parts, pa.array(orders), pa.array(steps), *(pa.array(f.ravel()) for f in found)], ["part", "filter_order", "step", *names])

    return histograms.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in names))
