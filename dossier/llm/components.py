"""Connected components by alternating large and small stars, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import materialize


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v. Large star: each node's larger neighbours go to its smallest neighbour; small star: its smaller neighbours and itself do."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.withColumn("m", F.least("u", "m"))
        out = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, component (its smallest reachable node) for each node of links (u, v) that is not its component's smallest.

    A round joins nodes to minima of their neighbours only, so a hub of any size is a key with one row
    on one side, which adaptive execution can split. Each round's edges are cut off in the shared folder.
    """
    edges = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    state = _state(edges)
    for _ in range(most_rounds):
        if edges.groupBy("u").count().where("count > 1").isEmpty() and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break  # each node has one parent, and parents have none
        edges = materialize(_stars(_stars(edges, True), False), "edges")
        if (now := _state(edges)) == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
