"""Connected components by alternating large-star and small-star steps; state is cut with checkpoint()."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, comp) for every end of an edge; comp is the smallest node of its component.

    `edges` has integer columns u, v. Nodes without an edge are absent. An empty table gives an empty table.
    """
    shared_dir(edges.sparkSession)
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct().checkpoint()
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        # large star: larger neighbours go to the least one around u
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and u itself go to the least one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = small.checkpoint()
        # stars only: a node that points at another one does so once and is pointed at by none
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("out")), F.struct(F.col("v").alias("x"), F.lit(0).alias("out")))).alias("e")).select("e.*")
        if not ends.groupBy("x").agg(F.sum("out").alias("out"), F.min("out").alias("low")).where("out > 1 or (out > 0 and low = 0)").agg(F.count(F.lit(1))).first()[0]:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # a star has converged: every node points at the least one
    nodes = now.select("u", "v").groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "node")
    tops = now.select(F.col("v").alias("node")).distinct().join(nodes, "node", "left_anti").select("node", F.col("node").alias("comp"))
    return nodes.unionByName(tops)
