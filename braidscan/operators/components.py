"""Connected components of an undirected edge table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidscan.runtime import Scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that an edge names.

    Each round every node takes the smallest label among its neighbours' (a combining
    aggregate, so hubs are harmless), hooks its old root there, and then follows labels
    twice; chains hence shorten exponentially. Rounds go on until no label moves and are cut
    by tables in the shared folder, of which the last two stay. Null ends and self-loops: a null end drops the edge, a self-loop keeps its node.
    """
    scratch = Scratch(edges.sparkSession, "components")
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).dropna()
    both = scratch.put(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = scratch.put(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("c")), "labels0")
    k = 0
    while True:
        k += 1
        heard = (
            both.join(labels.select(F.col("node").alias("v"), F.col("c").alias("cv")), "v")
            .groupBy("u")
            .agg(F.min("cv").alias("m"))
            .join(labels.select(F.col("node").alias("u"), "c"), "u")
        )
        step = heard.select("u", "c", F.least("c", "m").alias("m"))
        # A root takes the smallest label that any of its nodes has heard of.
        hooks = step.groupBy(F.col("c").alias("root")).agg(F.min("m").alias("to"))
        hooked = step.join(hooks, step["c"] == hooks["root"]).select(F.col("u").alias("node"), F.least("m", "to").alias("c"), F.col("c").alias("was"))
        hooked = scratch.put(hooked, f"hooked{k}")
        jump = hooked.select(F.col("node").alias("c"), F.col("c").alias("c2"))
        fresh = hooked.join(jump, "c", "left").select("node", F.coalesce("c2", "c").alias("c"), "was")
        fresh = fresh.join(hooked.select(F.col("node").alias("c"), F.col("c").alias("c3")), "c", "left")
        labels = scratch.put(fresh.select("node", F.coalesce("c3", "c").alias("c"), "was"), f"labels{k}")
        if labels.filter("c <> was").isEmpty():
            return labels.select("node", F.col("c").alias("component"))
        scratch.drop(f"hooked{k}")
        scratch.drop(f"labels{k - 1}")
