"""Connected components of an edge table, by contraction and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (node, label): label is the smallest node that can be reached.

    Each round every node takes its smallest neighbour (or itself) as its parent, parents are followed to their roots,
    and edges are redrawn between roots. Rounds grow with the logarithm of the longest path; nodes and edges stay in
    tables, none is collected.
    """
    edges = materialise(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = materialise(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root"), F.lit(True).alias("moved")), "parents")
        while True:
            up = parents.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
            nearer = materialise(parents.join(up, F.col("root") == F.col("__n")).select("node", F.col("__r").alias("root"), (F.col("__r") != F.col("root")).alias("moved")), "parents")
            discard(parents)
            parents = nearer
            if not parents.filter("moved").limit(1).count():
                break
        up = parents.select(F.col("node").alias("__n"), "root")
        named = materialise(labels.join(up, F.col("label") == F.col("__n"), "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        a = up.select(F.col("__n").alias("a"), F.col("root").alias("ra"))
        b = up.select(F.col("__n").alias("b"), F.col("root").alias("rb"))
        drawn = materialise(edges.join(a, "a").join(b, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        discard(labels, edges, parents)
        labels, edges = named, drawn
    return labels
