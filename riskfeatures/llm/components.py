"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def components(links: DataFrame) -> DataFrame:
    """``links`` has long columns ``a`` and ``b``; returns ``node`` and ``comp`` (the
    component's smallest node) for every node that occurs.

    Each round hooks every node to its smallest neighbour, jumps twice along the
    hooks and contracts the edges; the edges shrink until none is left.  Minima
    are pre-aggregated, edges and labels stay distributed, and every round's
    result is a written table, so a lost executor costs one round at most.
    """
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        near = hook = stored(near, "hooks")
        for _ in range(2):
            up = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
            hook = hook.join(up, "to").select("node", F.col("next").alias("to"))
        hook = stored(hook, "hooks")
        if labels is None:
            now = stored(hook.withColumnRenamed("to", "comp"), "labels")
        else:
            now = stored(labels.join(hook.withColumnRenamed("node", "comp"), "comp", "left").select(
                "node", F.coalesce("to", "comp").alias("comp")), "labels")
            forget(labels)
        ab = edges.join(hook.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(
            hook.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        rest = stored(ab.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct(), "edges")
        forget(edges, near, hook)
        labels, edges = now, rest
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
