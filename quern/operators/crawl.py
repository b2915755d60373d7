"""Breadth-first reach over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources import write_and_read


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth): what is reached from START (node) over EDGES (src, dst) within DEPTH steps, at its least depth.

    One join per step of the new nodes with the edges; nodes seen before are taken out, so cycles end. Nothing is collected.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    seen = start.where("node is not null").select("node", F.lit(0).alias("depth")).distinct()
    front = seen
    for k in range(1, depth + 1):
        new = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node"), F.lit(k).alias("depth")).distinct()
        front = write_and_read(new.join(seen.select("node"), "node", "left_anti"), f"front{k}")
        seen = seen.unionByName(front)
    return seen
