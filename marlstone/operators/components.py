"""Connected components of an edge table, by contraction over joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources.scratch import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of edges (u, v) reaches.

    In each round every node that has a neighbour before it, in the order of a hash,
    is merged into the first of them, and edges get the names of the merged nodes; it
    ends when no edge is left, after about log n rounds. The hash changes with every
    second round: a star is merged in two rounds of one hash, and a path shrinks by half
    in a round. Minima are added up before the shuffle, and joins are of written
    tables, so that a node of very many edges is split as a skewed key.
    A null node has no edges; an empty table gives an empty result.
    """
    links = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links, merged = materialise(links, "links"), []
    while not links.isEmpty():
        rank = lambda c, salt=len(merged) // 2: F.struct(F.xxhash64(c, F.lit(salt)).alias("h"), F.col(c).alias("node"))
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.min(rank("v")).alias("first")).where(F.col("first") < rank("u"))
        first = materialise(first.select(F.col("u").alias("node"), F.col("first.node").alias("into")), "merged")
        merged.append(first)
        for end in ("u", "v"):
            links = links.join(first.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("into", end)).drop("into")
        links = materialise(links.where("u <> v"), "links")
    if not merged:
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = merged.pop()
    while merged:
        first, later = merged.pop(), roots.select(F.col("node").alias("into"), F.col("into").alias("last"))
        roots = first.join(later, "into", "left").select("node", F.coalesce("last", "into").alias("into")).unionByName(roots)
    # A node that is merged in several rounds, a root with its own one among them, ends in the same root.
    roots = materialise(roots.where("node <> into").groupBy("node").agg(F.min("into").alias("into")), "roots")
    least = roots.groupBy("into").agg(F.min("node").alias("least")).select("into", F.least("into", "least").alias("component"))
    least = materialise(least, "least")
    return roots.join(least, "into").select("node", "component").unionByName(least.select(F.col("into").alias("node"), "component"))
