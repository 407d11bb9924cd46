"""Connected components of an edge table."""
from pyspark.sql import functions as F

from .store import discard, stored


def components(edges):
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Each round every node takes its smallest neighbour's label and the edges are contracted.  Nodes should be hashes:
    then labels fall by a constant factor a round, whatever the shape of the graph.
    """
    edges = stored(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = None
    while True:
        parent = stored(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "parents")
        if labels is None:
            step = stored(parent.select(F.col("a").alias("node"), F.col("p").alias("root")), "labels")
        else:
            moved = parent.select(F.col("a").alias("root"), "p")
            step = stored(labels.join(moved, "root", "left").select("node", F.coalesce("p", "root").alias("root")), "labels")
            discard(labels)
        labels = step
        left, right = parent.select("a", F.col("p").alias("pa")), parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        contracted = stored(edges.join(left, "a").join(right, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
        discard(edges, parent)
        edges = contracted
        if edges.isEmpty():
            discard(edges)
            return labels
