"""Connected components of a graph given as pairs, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.storage import stored

#: Pointer jumps of a round; they fold chains, so that the number of rounds stays small.
JUMPS = 3


def components(pairs: DataFrame) -> DataFrame:
    """``v`` and ``label``, the smallest vertex of its component, for every vertex of ``pairs`` (``a``, ``b``: long).

    Each round points every vertex at its smallest neighbour, follows the pointers a few steps, and merges each vertex
    into the one it points at. A round at least removes every vertex that isn't the smallest among its neighbours.
    """
    edges = stored(pairs.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("to")), "up")
        for _ in range(JUMPS):
            further = up.select(F.col("v").alias("to"), F.col("to").alias("next"))
            up = up.join(further, "to").select("v", F.col("next").alias("to"))
        up = stored(up, "up")
        if labels is None:
            labels = up.select("v", F.col("to").alias("label"))
        else:
            step = up.select(F.col("v").alias("label"), "to")
            labels = labels.join(step, "label", "left").select("v", F.coalesce("to", "label").alias("label"))
        labels = stored(labels, "labels")
        a = up.select(F.col("v").alias("a"), F.col("to").alias("to_a"))
        b = up.select(F.col("v").alias("b"), F.col("to").alias("to_b"))
        edges = stored(
            edges.join(a, "a").join(b, "b").filter("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(),
            "edges",
        )
    return labels if labels is not None else edges.select(F.col("a").alias("v"), F.col("b").alias("label"))
