"""Connected components by repeated contraction: every step is a shuffle on small rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.workspace import Workspace


def components(work: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is one node of its component.

    Each round sends every node to its smallest neighbour and renames the edges by
    it. Edges whose ends met drop out, so a star ends in one round and a chain
    halves. Self loops and repeated edges are allowed. No edges: no rows.
    """
    edges = work.keep(f"{name}-edges-0", edges.where("a <> b"))
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        level = len(maps)
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = work.keep(
            f"{name}-map-{level}", both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root"))
        )
        maps.append(nearest)
        left, right = (nearest.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root")) for k in ("a", "b"))
        renamed = edges.join(left, "a").join(right, "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        edges = work.keep(f"{name}-edges-{level + 1}", renamed.where("a <> b"))
        work.drop(f"{name}-edges-{level}")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = maps[-1]
    for nearest in reversed(maps[:-1]):
        later = found.select(F.col("node").alias("root"), F.col("root").alias("later"))
        found = nearest.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    found = work.keep(f"{name}-roots", found)
    for level in range(len(maps)):
        work.drop(f"{name}-map-{level}")
    work.drop(f"{name}-edges-{len(maps)}")
    return found
