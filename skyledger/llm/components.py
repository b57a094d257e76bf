"""Connected components of a graph of numbered nodes, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``u, v``); one root per component.

    Each round maps every node to that of itself and its neighbours which comes first in an order
    drawn anew per round, then maps both ends of all edges and drops loops and copies. Mapping along
    edges neither joins nor splits components, and a random order shrinks paths and stars alike by a
    constant share, so the rounds grow with the logarithm of the number of nodes. A node's
    neighbours are only ever reduced to one, in the task that reads them, never gathered.
    """
    spark = edges.sparkSession
    edges = stored(edges.select("u", "v").where("u <> v"), "edges")
    maps = []
    while edges.head(1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        place = lambda node: F.struct(F.xxhash64(node, F.lit(len(maps))), node.alias("node"))
        first = both.groupBy("u").agg(F.min(place(F.col("v"))).alias("near"))
        step = first.select("u", F.least("near", place(F.col("u")))["node"].alias("to"))
        maps.append(stored(step, "contraction"))
        left = maps[-1].select("u", F.col("to").alias("u_to"))
        right = maps[-1].select(F.col("u").alias("v"), F.col("to").alias("v_to"))
        moved = edges.join(left, "u").join(right, "v").where("u_to <> v_to")
        ends = moved.select(F.least("u_to", "v_to").alias("u"), F.greatest("u_to", "v_to").alias("v"))
        edges = stored(ends.distinct(), "edges")
    if not maps:
        return spark.createDataFrame([], "node long, root long")
    roots = maps[0].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for step in maps[1:]:
        moved = roots.join(step.select(F.col("u").alias("root"), "to"), "root", "left")
        roots = moved.select("node", F.coalesce("to", "root").alias("root"))
    return roots
