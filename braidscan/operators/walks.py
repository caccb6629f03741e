"""Signed random walk with restart: two scores for each node of a signed graph, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidscan.runtime import Scratch

#: Restart probability; how far an enemy's enemy is trusted, and an enemy's friend distrusted.
RESTART, BETA, GAMMA = 0.15, 0.6, 0.9


def signed_walk(edges: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """edges (i, j, sign), seeds (node) -> (node, plus, minus) after so many rounds from a restart spread over the seeds.

    A walker at i takes an edge with probability |sign| / sum of |sign| at i; a negative edge turns it over.
    """
    scratch = Scratch(edges.sparkSession, "walk")
    out = edges.groupBy("i").agg(F.sum(F.abs("sign")).alias("total"))
    e = scratch.put(edges.join(out, "i").select("i", "j", "sign", (F.abs("sign") / F.col("total")).alias("w")), "edges")
    count = seeds.select("node").distinct().agg(F.count("*").alias("n_seeds"))  # one row
    start = scratch.put(seeds.select("node").distinct().crossJoin(F.broadcast(count)).select("node", (1.0 / F.col("n_seeds")).alias("q")), "start")
    state = start.select("node", F.col("q").alias("plus"), F.lit(0.0).alias("minus"))
    good, c = F.col("sign") > 0, 1 - RESTART
    for k in range(rounds):
        flow = e.join(state.withColumnRenamed("node", "i"), "i").groupBy(F.col("j").alias("node")).agg(
            F.sum(F.col("w") * F.when(good, F.col("plus") + (1 - GAMMA) * F.col("minus")).otherwise(BETA * F.col("minus"))).alias("p"),
            F.sum(F.col("w") * F.when(good, GAMMA * F.col("minus")).otherwise(F.col("plus") + (1 - BETA) * F.col("minus"))).alias("m"),
        )
        nxt = flow.join(start, "node", "full_outer")
        plus = c * F.coalesce("p", F.lit(0.0)) + RESTART * F.coalesce("q", F.lit(0.0))
        state = scratch.put(nxt.select("node", plus.alias("plus"), (c * F.coalesce("m", F.lit(0.0))).alias("minus")), f"state{k}")
    return state
