"""Connected components of an edge table by distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillshift.sources.shared import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), ``root`` being the least node it reaches.

    Every round hangs each node's neighbours on the least of them, then each node's smaller
    neighbours likewise; the number of rounds grows with the logarithm of the longest path, and
    the loop runs until nothing moves.  Minima are combined before the shuffle; nulls are dropped.
    """
    a, b = edges.columns
    pairs = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi is not null and lo is not null")
    nodes = checkpointed(pairs.select(F.explode(F.array("hi", "lo")).alias("node")).distinct())
    held, before = checkpointed(pairs.filter("hi <> lo").distinct()), None
    while True:
        both = held.unionByName(held.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        wide = both.filter("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        under = wide.groupBy("hi").agg(F.min("lo").alias("m"))
        near = wide.join(under, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        held = checkpointed(near.select("e.hi", "e.lo").filter("hi <> lo").distinct())
        now = held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    roots = held.groupBy("hi").agg(F.min("lo").alias("root"))
    return nodes.join(roots, nodes["node"] == roots["hi"], "left").select("node", F.coalesce("root", "node").alias("root"))
