"""Exact nearest neighbours, blocked in Arrow: queries travel in blocks, the library never shuffles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries broadcast at a time.
BLOCK = 4096

#: Values of queries by library rows that a task holds at a time.
CELLS = 1 << 20


def _each(measure: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """Distances of every query row to every library row, a query at a time."""
    return lambda q, x: np.stack([measure(x, row) for row in q])


#: (queries, rows) -> values; the last two and the cosine distance are better when smaller.
MEASURES = {
    "ip": lambda q, x: q @ x.T,
    "cosine": lambda q, x: 1.0 - q @ x.T,
    "euclid": _each(lambda x, row: np.sqrt(((x - row) ** 2).sum(1))),
    "manhattan": _each(lambda x, row: np.abs(x - row).sum(1)),
}


def _best(n: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k smallest values of each row of v, NaN last; ties to the smaller n of their columns."""
    if k < v.shape[1]:
        # With fewer than k numbers in a row the bound is NaN, and nothing is above it.
        row, at = np.nonzero(~(v > np.partition(v, k - 1, axis=1)[:, k - 1 : k]))
    else:
        row, at = np.divmod(np.arange(v.size), max(v.shape[1], 1))
    order = np.lexsort((n[at], v[row, at], row))
    row, at = row[order], at[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], at[first]


def _blocks(queries: DataFrame, library: DataFrame, measure: str, k: int | None, digits: int | None, skip_own: bool) -> DataFrame:
    """(q, n, x): the k best rows of each library batch for each query, or all of them."""
    spark = queries.sparkSession
    schema = pa.schema([("q", pa.int64()), ("n", pa.int64()), ("x", pa.float64())])
    sign = -1.0 if measure == "ip" else 1.0

    def search(rows):
        held = spark.sparkContext.broadcast((np.array([r["q"] for r in rows]), np.array([r["v"] for r in rows], np.float64)))

        def run(batches):
            ids, mat = held.value
            for b in batches:
                if not b.num_rows:
                    continue
                n = b.column(0).to_numpy()
                x = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                step = max(1, CELLS // len(n))
                for top in range(0, len(ids), step):
                    own = ids[top : top + step]
                    s = MEASURES[measure](mat[top : top + step], x)
                    s = s if digits is None else np.round(s, digits)
                    row, at = np.divmod(np.arange(s.size), len(n)) if k is None else _best(n, sign * s, k + skip_own)
                    q, s = own[row], s[row, at]
                    other = q != n[at] if skip_own else np.ones(len(q), bool)
                    yield pa.RecordBatch.from_arrays([pa.array(q[other]), pa.array(n[at][other]), pa.array(s[other])], schema=schema)

        return library.select(F.col("n").cast("long"), "v").mapInArrow(run, "q long, n long, x double")

    out, rows = None, []
    for r in queries.select(F.col("q").cast("long").alias("q"), "v").toLocalIterator():
        rows.append(r)
        if len(rows) == BLOCK:
            part, rows = search(rows), []
            out = part if out is None else out.unionByName(part)
    if rows or out is None:
        part = search(rows) if rows else spark.createDataFrame([], "q long, n long, x double")
        out = part if out is None else out.unionByName(part)
    return out


def _ranked(found: DataFrame, order: list, k: int) -> DataFrame:
    return found.withColumn("rk", F.row_number().over(Window.partitionBy("q").orderBy(*order)).cast("long")).filter(F.col("rk") <= k)


def exact_topk(queries: DataFrame, library: DataFrame, k: int, skip_own: bool = False) -> DataFrame:
    """queries (q, v), library (n, v) -> (q, n, ip, rk); ties to smaller n. With skip_own a query's own row (n = q) is no candidate."""
    found = _blocks(queries, library, "ip", k, None, skip_own).withColumnRenamed("x", "ip")
    return _ranked(found, [F.col("ip").desc(), "n"], k)


def nearest_by(queries: DataFrame, library: DataFrame, k: int, measure: str, digits: int = 6, skip_own: bool = True) -> DataFrame:
    """(q, n, dist, rk) by a distance of MEASURES, rounded before it is ranked; ties to smaller n."""
    found = _blocks(queries, library, measure, k, digits, skip_own).withColumnRenamed("x", "dist")
    return _ranked(found, ["dist", "n"], k)


def products(queries: DataFrame, library: DataFrame, digits: int = 6, skip_own: bool = True) -> DataFrame:
    """(q, n, ip) for every query and library row, in blocks."""
    return _blocks(queries, library, "ip", None, digits, skip_own).withColumnRenamed("x", "ip")
