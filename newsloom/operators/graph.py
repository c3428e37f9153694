"""Connected components of an edge list, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import materialize, release


def connected_components(edges: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """(node, component) for each node on an edge; component is the least node reachable.

    Each round replaces every node by the least of its neighbours and itself and keeps the edges
    that still join two nodes, so components at least halve; rounds grow with the logarithm of
    the longest chain. The minimum is combined before the shuffle, so a node with very many
    edges stays cheap. Each round is a written table, so that lineage stays short.
    Edges with a null end are ignored; loops give a node of its own component.
    """
    e = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null")
    e = materialize(e.distinct(), "edges")
    labels = None
    while True:
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        step = materialize(step, "step")
        old_labels, old_edges = labels, e
        if labels is None:
            labels = materialize(step.select(F.col("n").alias("node"), F.col("m").alias("component")), "labels")
        else:
            labels = materialize(
                labels.join(step, labels.component == step.n, "left").select("node", F.coalesce("m", "component").alias("component")),
                "labels",
            )
        e = materialize(
            e.join(step.select(F.col("n").alias("a"), F.col("m").alias("ma")), "a")
            .join(step.select(F.col("n").alias("b"), F.col("m").alias("mb")), "b")
            .where("ma <> mb")
            .select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b"))
            .distinct(),
            "edges",
        )
        release(old_labels, old_edges, step)
        if e.isEmpty():
            release(e)
            return labels
