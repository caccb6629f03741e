"""Evidence fusion over long-form tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidscan.functions.vectors import close
from braidscan.runtime import Scratch

#: The logarithm that stands for zero, so that a zero can be taken out of a product again.
NOTHING = -1e8


def rank_prior(cand: DataFrame, sure: float = 0.99) -> DataFrame:
    """(q, func, lib, prior) with the option None last: a softmax of ranks by similarity, sure matches ten higher.

    A candidate's rank grows by one for each earlier candidate that opened a new similarity below `sure`.
    """
    w = Window.partitionBy("q").orderBy("sim", "func", "lib")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    prev = F.lag("sim").over(w)
    a = cand.withColumn("opens", ((F.col("sim") <= sure) & (prev.isNull() | ~close(F.col("sim"), prev))).cast("int"))
    r = a.withColumn("r", 1 + F.coalesce(F.sum("opens").over(before), F.lit(0)) + F.when(F.col("sim") > sure, 10).otherwise(0)).withColumn("last", F.row_number().over(Window.partitionBy("q").orderBy(F.col("sim").desc(), F.col("func").desc(), F.col("lib").desc())))
    none = r.filter("last = 1").select("q", F.lit("None").alias("func"), F.lit("None").alias("lib"), F.when(F.col("sim") < sure, F.col("r")).otherwise(F.lit(1)).alias("r"))
    u = r.select("q", "func", "lib", "r").unionByName(none)
    return u.select("q", "func", "lib", (F.exp("r") / F.sum(F.exp("r")).over(Window.partitionBy("q"))).alias("prior"))


def string_evidence(pairs: DataFrame, strict: bool = False) -> DataFrame:
    """pairs (q, c, a, b: string sets) -> shared, differ and the exponent of the influence.

    By default the differing set includes the shared strings (the union); strict takes the symmetric difference.
    """
    shared = F.size(F.array_intersect("a", "b")).cast("long")
    union = F.size(F.array_union("a", "b")).cast("long")
    differ = union - shared if strict else union
    return pairs.select("q", "c", shared.alias("shared"), differ.alias("differ"), (shared - differ).alias("exponent"))


def _log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(NOTHING))


def _rows(lists: pa.Array) -> tuple[np.ndarray, ...]:
    """The row of each struct in a column of lists, and the structs' fields."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), n), *(x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())


def _log_sum(group: np.ndarray, n: int, x: np.ndarray) -> np.ndarray:
    """The logarithm of each group's sum of exponentials, shifted by its largest."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, group, x)
    return top + np.log(np.bincount(group, np.exp(x - top[group]), n))


def _exchange(batch: pa.RecordBatch, damping: float) -> list[pa.Array]:
    """The new messages to both ends of a batch of factors, as lists of (o, l) whose exponentials sum to one."""
    row, i, j, pot = _rows(batch["cells"])
    own = {x: (_rows(batch[f"held_{x}"]), _rows(batch[f"to_{x}"])) for x in "ab"}
    names = np.unique(np.concatenate([i, j, *(part[1] for both in own.values() for part in both)]))
    code = lambda r, o: r * max(len(names), 1) + np.searchsorted(names, o)
    at, known, sent, before = {"a": code(row, i), "b": code(row, j)}, {}, {}, {}
    for x, (held, old) in own.items():
        options = code(*held[:2])
        order = np.argsort(options)
        pos = np.searchsorted(options, at[x], sorter=order)
        hit = order[np.minimum(pos, len(order) - 1)] if len(order) else np.zeros(len(row), int)
        known[x] = (options[hit] == at[x]) if len(order) else np.zeros(len(row), bool)
        before[x] = np.zeros(len(row))  # every message is one before the first round
        if len(old[0]):
            ends = code(*old[:2])  # sorted, as they were written below
            back = np.minimum(np.searchsorted(ends, at[x]), len(ends) - 1)
            before[x] = np.where(ends[back] == at[x], old[2][back], 0.0)
        sent[x] = (held[2][hit] - before[x]) if len(order) else before[x]
    out = []
    for x, other in (("a", "b"), ("b", "a")):
        hears = known[other]
        ends, first, group = np.unique(at[x][hears], return_index=True, return_inverse=True)
        new, r = _log_sum(group, len(ends), (pot + sent[other])[hears]), ends // max(len(names), 1)
        new -= _log_sum(r, batch.num_rows, new)[r]
        if damping:
            new = np.logaddexp(new + np.log1p(-damping), before[x][hears][first] + np.log(damping))
        pairs = pa.StructArray.from_arrays([pa.array(names[ends % max(len(names), 1)], pa.int64()), pa.array(new, pa.float64())], ["o", "l"])
        out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(r, np.arange(batch.num_rows + 1)), pa.int32()), pairs))
    return out


def propagate(opt: DataFrame, factors: DataFrame, rounds: int, damping: float = 0.0) -> DataFrame:
    """Synchronous belief propagation: opt (v, o, pr), factors (fid, a, b, i, j, pot) -> (v, o, m) marginals.

    Messages are logarithms throughout, so that variables of many factors underflow nowhere; a factor's
    potentials and messages are one row. Every round is cut by a table in the shared folder.
    """
    scratch = Scratch(opt.sparkSession, "belief")
    prior = scratch.put(opt, "options").select("v", F.col("o").cast("long").alias("o"), _log(F.col("pr")).alias("l"))
    cell = F.struct(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), _log(F.col("pot")).alias("l"))
    none = F.lit(None).cast("array<struct<o:long,l:double>>")
    state = scratch.put(factors.groupBy("fid", "a", "b").agg(F.collect_list(cell).alias("cells")), "round0").withColumns({"to_a": none, "to_b": none})
    schema = state.schema

    def held(messages):
        ends = [messages.select(F.col(x).alias("v"), F.inline(f"to_{x}")) for x in "ab"]
        heard = ends[0].unionByName(ends[1]).withColumn("known", F.lit(False))
        x = prior.withColumn("known", F.lit(True)).unionByName(heard).groupBy("v", "o").agg(F.sum("l").alias("l"), F.max("known").alias("known"))
        return x.filter("known").drop("known")

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*(b[c] for c in ("fid", "a", "b", "cells")), *_exchange(b, damping)], ["fid", "a", "b", "cells", "to_a", "to_b"])

    for t in range(1, rounds + 1):
        ends = held(state) if t > 1 else prior
        lists = scratch.put(ends.groupBy("v").agg(F.collect_list(F.struct("o", "l")).alias("held")), f"held{t}")
        met = state
        for x in "ab":
            met = met.join(lists.select(F.col("v").alias(x), F.col("held").alias(f"held_{x}")), x)
        state = scratch.put(met.select("fid", "a", "b", "cells", "to_a", "to_b", "held_a", "held_b").mapInArrow(run, schema), f"round{t}")
        scratch.drop(f"round{t - 1}")
    end = held(state) if rounds else prior
    w = Window.partitionBy("v")
    x = end.withColumn("x", F.exp(F.col("l") - F.max("l").over(w)))
    return x.select("v", "o", (F.col("x") / F.sum("x").over(w)).alias("m"))


def max_exclusive(messages: DataFrame) -> DataFrame:
    """(fid, v, m1): the strongest variable of a factor takes it, unless none reaches one half."""
    w = Window.partitionBy("fid")
    x = messages.withColumn("top", F.max("m1").over(w)).withColumn("n", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.col("m1").desc(), "v")))
    return x.select("fid", "v", F.when(F.col("n") == 1, 0.4).when(F.col("top") < 0.5, 0.1).when(F.col("rn") == 1, 0.999).otherwise(0.001).alias("m1"))
