"""Call-graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidscan.runtime import Scratch


def _check_rounds(done: int, most: int | None, what: str) -> None:
    if most is not None and done > most:
        raise RuntimeError(f"{what} did not end within {most} rounds")


def contract(edges: DataFrame, small: DataFrame, max_depth: int | None = None) -> DataFrame:
    """edges (src, dst, dist) with nodes of `small` (name) bridged: distances add up along filtered nodes.

    Direct edges stay a multiset, bridged ones are distinct. A path takes each filtered node once, so paths
    through filtered cycles end by themselves; with max_depth, paths over more filtered nodes are left out.
    """
    keep_dst = edges.join(small.select(F.col("name").alias("dst")), "dst", "left_anti").select("src", "dst", "dist")
    keep_src = lambda e: e.join(small.select(F.col("name").alias("src")), "src", "left_anti").select("src", "dst", "dist")
    into = keep_src(edges.join(small.select(F.col("name").alias("dst")), "dst", "left_semi").select("src", "dst", "dist")).distinct()
    scratch = Scratch(edges.sparkSession, "contract")
    inner = edges.join(small.select(F.col("name").alias("src")), "src", "left_semi").select(F.col("src").alias("mid"), F.col("dst").alias("nxt"), F.col("dist").alias("d2")).distinct()
    inner = scratch.put(inner, "inner")
    cyclic = _cyclic(inner, small, scratch)
    out, front = keep_src(keep_dst), scratch.put(into.withColumn("path", F.array().cast("array<string>")), "front0")
    bridged, k = None, 0
    while max_depth is None or k < max_depth:
        k += 1
        # Only nodes on filtered cycles are remembered; elsewhere a path cannot come back.
        on_cycle = cyclic.select(F.col("name").alias("mid"), F.lit(True).alias("loops"))
        step = front.join(inner, front["dst"] == inner["mid"]).filter(~F.array_contains("path", F.col("mid")))
        step = step.join(on_cycle, "mid", "left").withColumn("path", F.when(F.col("loops"), F.array_sort(F.array_append("path", F.col("mid")))).otherwise(F.col("path")))
        step = step.select("src", F.col("nxt").alias("dst"), (F.col("dist") + F.col("d2")).alias("dist"), "path").distinct()
        step = scratch.put(step, f"step{k}")
        if step.isEmpty():
            break
        done = step.join(small.select(F.col("name").alias("dst")), "dst", "left_anti").select("src", "dst", "dist")
        bridged = done if bridged is None else bridged.unionByName(done)
        front = step.join(small.select(F.col("name").alias("dst")), "dst", "left_semi").select("src", "dst", "dist", "path")
    return out if bridged is None else out.unionByName(bridged.distinct())


def _cyclic(inner: DataFrame, small: DataFrame, scratch: Scratch) -> DataFrame:
    """(name): a superset of the filtered nodes on cycles of filtered nodes: what is left when sinks and sources are peeled off."""
    e = inner.join(small.select(F.col("name").alias("nxt")), "nxt", "left_semi").select(F.col("mid").alias("a"), F.col("nxt").alias("b")).distinct()
    left, k, n = scratch.put(e, "peel0"), 0, -1
    while True:
        now = left.count()
        if now == n or now == 0:
            return left.select(F.col("a").alias("name")).unionByName(left.select(F.col("b").alias("name"))).distinct()
        n, k = now, k + 1
        starts, ends = left.select(F.col("a").alias("b")).distinct(), left.select(F.col("b").alias("a")).distinct()
        left = scratch.put(left.join(starts, "b", "left_semi").join(ends, "a", "left_semi").select("a", "b"), f"peel{k}")


def reachable(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(src, dst, depth): every node reachable in one step or more, at its least depth; goes on until nothing new is met.

    With max_rounds, an error if that is not enough.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    e = scratch.put(edges.select("src", "dst").distinct(), "edges")
    known = scratch.put(e.select("src", "dst", F.lit(1).alias("depth")), "known1")
    front, parts, k = known, 1, 1
    while True:
        k += 1
        nxt = front.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        fresh = scratch.put(nxt.join(known.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("depth", F.lit(k)), f"fresh{k}")
        if fresh.isEmpty():
            return known
        _check_rounds(k, max_rounds, "reachability")
        known, front, parts = known.unionByName(fresh), fresh, parts + 1
        if parts == 8:  # lest the plan grow with the depth
            known, parts = scratch.put(known, f"known{k}"), 1


def adjacent(functions: DataFrame) -> DataFrame:
    """Edges both ways between functions that follow each other by position."""
    w = Window.partitionBy("lib").orderBy("pos")
    pairs = functions.select("lib", F.lag("name").over(w).alias("src"), F.col("name").alias("dst")).filter("src is not null")
    return pairs.unionByName(pairs.select("lib", F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("dist", F.lit(1).cast("long"))


def betweenness(edges: DataFrame) -> DataFrame:
    """(graph, node, betweenness) of directed unweighted graphs, a graph at a time (accumulation over shortest paths)."""
    import pandas as pd

    def run(pdf):
        nxt: dict = {}
        for s, t in zip(pdf["src"], pdf["dst"]):
            nxt.setdefault(s, set()).add(t)
        nodes = sorted(set(pdf["src"]) | set(pdf["dst"]))
        total = dict.fromkeys(nodes, 0.0)
        for s in nodes:
            paths, depth, before, order, queue = {s: 1.0}, {s: 0}, {}, [], [s]
            for v in queue:
                order.append(v)
                for w in sorted(nxt.get(v, ())):
                    if w not in depth:
                        depth[w] = depth[v] + 1
                        queue.append(w)
                    if depth[w] == depth[v] + 1:
                        paths[w] = paths.get(w, 0.0) + paths[v]
                        before.setdefault(w, []).append(v)
            share = dict.fromkeys(order, 0.0)
            for w in reversed(order):
                for v in before.get(w, ()):
                    share[v] += paths[v] / paths[w] * (1 + share[w])
                if w != s:
                    total[w] += share[w]
        return pd.DataFrame({"graph": pdf["graph"].iloc[0], "node": nodes, "betweenness": [total[n] for n in nodes]})

    return edges.groupBy("graph").applyInPandas(run, "graph string, node string, betweenness double")
