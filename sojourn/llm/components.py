"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm.scratch import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); the component is its smallest node.

    Alternating stars: in turn every node hands its larger neighbours, and then itself and its smaller ones, to the smallest
    node it knows. The number of rounds grows with the logarithm of the longest path, a node's neighbours are
    only ever folded to their minimum, and each round is written.
    """
    a, b = F.col("a"), F.col("b")
    now = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "edges")
    while True:
        both = now.select("a", "b").unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(b.alias("a"), F.col("m").alias("b"))
        large = written(large.filter("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(b == F.col("m"), a).otherwise(b).alias("a"), F.col("m").alias("b"))
        new = written(small.filter("a <> b").distinct(), "small-star")
        # Done when every node has one edge, to a node that has none to a smaller one.
        changed = new.exceptAll(now).limit(1).count() + now.exceptAll(new).limit(1).count()
        now = new
        if not changed:
            break
    roots = now.select(b.alias("node"), b.alias("component")).distinct()
    return now.select(a.alias("node"), b.alias("component")).unionByName(roots)
