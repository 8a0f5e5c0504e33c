"""Subtrees of a graph of broader terms, from seeds downwards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources.scratch import materialise


def descend(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node, depth): each seed, and every node from which edges (child, parent) lead to it, with the least number of edges.

    A round goes one edge down from the nodes that were new in the last one, and an anti-join
    with all rounds before leaves out what is known: cycles end there. Rounds are written
    tables, as many as the deepest subtree has levels. Null ends and null seeds have no row;
    a seed without edges is its own subtree.
    """
    links = edges.select("child", "parent").where("child IS NOT NULL AND parent IS NOT NULL AND child <> parent").distinct()
    frontier = materialise(seeds.select("seed").where("seed IS NOT NULL").distinct().select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")), "subtree-0")
    reached, links = frontier, materialise(links, "subtree-links")
    depth = 0
    while True:
        depth += 1
        below = frontier.join(links, F.col("node") == F.col("parent")).select("seed", F.col("child").alias("node")).distinct()
        frontier = materialise(below.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)), f"subtree-{depth}")
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)


def occupation_graph(edges: DataFrame, seeds: DataFrame, kind: str | int, skills: DataFrame, labels: DataFrame, dropped: Sequence = ()) -> DataFrame:
    """(node, label, related, skills): the merged subtrees of all seeds, one row for each node.

    edges: (child, parent); ``related`` are a node's parents that are themselves of ``kind``, in its
    subtree; they have rows too. skills: (node, skill), blank ones and bare ids (Q...) left out; labels: (node, label), the
    id where there is none. A node has a row if a parent or a skill counts for it, or if it is such a
    parent. ``dropped`` nodes (classes of organisations) have no row and are nobody's relation,
    though subtrees go on below them. Lists are sorted, without repeats and without the node itself.
    """
    inside = descend(edges, seeds).select("node").distinct()
    roles = descend(edges, edges.sparkSession.createDataFrame([(kind,)], ["seed"])).select(F.col("node").alias("parent"))
    keep = lambda df, c: df.where(~F.col(c).isin(*dropped)) if dropped else df
    pairs = edges.select("child", "parent").distinct().join(inside.withColumnRenamed("node", "child"), "child").join(roles, "parent", "left_semi")
    pairs = keep(keep(pairs, "child"), "parent")
    named = keep(skills, "node").where("trim(skill) <> '' AND NOT startswith(trim(skill), 'Q')").join(inside, "node", "left_semi").select("node", F.trim("skill").alias("skill"))
    rows = pairs.select(F.col("child").alias("node"), F.when(F.col("child") != F.col("parent"), F.col("parent")).alias("related"), F.lit(None).cast("string").alias("skill"))
    rows = rows.unionByName(pairs.select(F.col("parent").alias("node")), allowMissingColumns=True).unionByName(named, allowMissingColumns=True)
    merged = rows.groupBy("node").agg(F.sort_array(F.collect_set("related")).alias("related"), F.sort_array(F.collect_set("skill")).alias("skills"))
    known = labels.where("label <> ''").groupBy("node").agg(F.min("label").alias("label"))
    return merged.join(known, "node", "left").select("node", F.coalesce("label", F.col("node").cast("string")).alias("label"), "related", "skills")
