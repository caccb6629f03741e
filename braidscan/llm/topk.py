"""Exact top-k by inner product over a pivot-distance index.

One more component turns inner products into distances: with M the largest norm, a vector x
is lifted to (x, sqrt(M^2 - |x|^2)) and a query q to (q, 0), so nearest means highest product.
Lifted vectors are keyed by (nearest pivot, distance to it) and range-partitioned in that
order; runs of one pivot's rows are rings, sorted annuli of bounded size. A query opens its
nearest rings first; the k-th best product found there gives a radius, and by the triangle
inequality only rings whose gap to the query's own pivot distance is within it are read
afterwards. Inside a ring the same holds for finer annuli.

Queries never pass through the driver: they meet rings in blocks, by a shuffle on (ring, block).
What travels to all tasks is the pivots, a bounded sample and a row for each ring (RINGS at most,
besides one for each partition and pivot).

Defined cases
  null vectors, null or non-finite components   take no part
  null vec_id, vectors without components       take no part
  vectors of different lengths                  searched among equals
  repeated vec_id                               each row is a candidate of its own, equal ones too; rows with the
                                                query's id are its own; a repeated query is answered once, by the first row written
  very large components                         products beyond 2^53 are formed from whole numbers, pair by pair; a score
                                                beyond a long is given as the largest or smallest long, ranked by its true value
  ties                                          smaller vec_id first
  empty table, extra columns                    empty result; ignored
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidscan.runtime import Scratch

#: Pivots; rows of the bounded sample they and the first radius come from; queries of a block; rows of an annulus inside a ring.
PIVOTS, SAMPLE, BLOCK, ANNULUS = 32, 2048, 4096, 512
#: Rings at most; rows of a ring at least; rings that a query opens first.
RINGS, RING_ROWS, FIRST = 16384, 4096, 2
#: Squared norms below this have products that doubles hold exactly.
TAME = float(1 << 46)
SCALE = 256
_NONE = np.iinfo(np.int64).min


def sound(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, x, dim, square): vectors that take part, with the squared norm of their whole components."""
    x = F.col("embedding")
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(x.isNotNull() & F.col("vec_id").isNotNull() & (F.size(x) > 0) & fit)
    x = x.cast("array<double>")
    square = F.aggregate(x, F.lit(0.0), lambda s, c: s + F.pow(F.abs(c) * SCALE + 1, F.lit(2.0)))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), F.size(x).alias("dim"), square.alias("square"))


def whole(x: float) -> int:
    """floor(SCALE * x) exactly, for any finite x."""
    return int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE)


def _matrix(column, n: int) -> np.ndarray:
    """Whole components as doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.floor(flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, n) * SCALE)


class Pivots:
    """Far-apart sample rows, lifted."""

    def __init__(self, sample: np.ndarray, top: float):
        self.top = top
        lifted = self.lift(sample)
        chosen = [0]
        gap = ((lifted - lifted[0]) ** 2).sum(1)
        while len(chosen) < min(PIVOTS, len(lifted)):
            chosen.append(int(np.argmax(gap)))
            gap = np.minimum(gap, ((lifted - lifted[chosen[-1]]) ** 2).sum(1))
        self.points = lifted[chosen]

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.sqrt(np.maximum(0, self.top - (x * x).sum(1)))[:, None]), axis=1)

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        sq = (lifted**2).sum(1)[:, None] + (self.points**2).sum(1)[None] - 2 * lifted @ self.points.T
        return np.sqrt(np.maximum(0, sq))

    def of_queries(self, v: np.ndarray) -> np.ndarray:
        return self.distances(np.concatenate((v, np.zeros((len(v), 1))), axis=1))

    def radius(self, v: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """How far from a query a row may lie that reaches its floor; wide enough for all rounding in the distances."""
        size = (v * v).sum(1) + self.top
        r = np.sqrt(np.maximum(0, size - 2.0 * floor.astype(np.float64))) + 1e-6 * np.sqrt(size) + 1e-6
        return np.where(floor == _NONE, np.inf, r)


class Best:
    """The k best rows so far of each query of a block."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.v, self.floor, self.k = ids, v, floor.copy(), k
        self.score = np.full((len(ids), k), _NONE)
        self.vec, self.row = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)

    def offer(self, who: np.ndarray, vec: np.ndarray, row: np.ndarray, v: np.ndarray) -> None:
        """Rows in the order of (vec_id, row) to some of the queries."""
        s = (self.v[who] @ v.T).astype(np.int64)
        s[self.ids[who][:, None] == vec[None]] = _NONE
        top = np.argsort(-s, axis=1, kind="stable")[:, : self.k] if _NONE not in s else np.argsort(-np.maximum(s, _NONE + 1), axis=1, kind="stable")[:, : self.k]
        score = np.concatenate((self.score[who], np.take_along_axis(s, top, 1)), axis=1)
        vecs, rows = np.concatenate((self.vec[who], vec[top]), axis=1), np.concatenate((self.row[who], row[top]), axis=1)
        order = np.lexsort((rows, vecs, -np.maximum(score, _NONE + 1)), axis=1)[:, : self.k]
        self.score[who], self.vec[who], self.row[who] = (np.take_along_axis(a, order, 1) for a in (score, vecs, rows))
        self.floor[who] = np.maximum(self.floor[who], self.score[who][:, -1])

    def expand(self, pivots: Pivots, pivot: int, dist: np.ndarray, vec: np.ndarray, row: np.ndarray, v: np.ndarray) -> None:
        """Annuli of a ring, each query's nearest first, as far as its radius goes."""
        order = np.lexsort((row, dist))
        dist, vec, row, v = dist[order], vec[order], row[order], v[order]
        cuts = np.arange(0, len(dist), ANNULUS)
        lo, hi = dist[cuts], dist[np.minimum(cuts + ANNULUS, len(dist)) - 1]
        parts = []
        for c in cuts:
            at = c + np.lexsort((row[c : c + ANNULUS], vec[c : c + ANNULUS]))
            parts.append((vec[at], row[at], v[at]))
        own = pivots.of_queries(self.v)[:, pivot][:, None]
        gap = np.maximum(0, np.maximum(lo[None] - own, own - hi[None]))
        near = np.argsort(gap, axis=1, kind="stable")
        for step in range(len(cuts)):
            ring = near[:, step]
            open_ = gap[np.arange(len(ring)), ring] <= pivots.radius(self.v, self.floor)
            if not open_.any():
                break
            for r in np.unique(ring[open_]):
                self.offer(np.flatnonzero(open_ & (ring == r)), *parts[r])

    def rows(self) -> pa.Table:
        held = self.score != _NONE
        return pa.table({"query_id": np.repeat(self.ids, held.sum(1)), "vec_id": self.vec[held], "row": self.row[held], "score": self.score[held], "beyond": pa.nulls(int(held.sum()), pa.string())})


_FOUND = "query_id long, vec_id long, row long, score long, beyond string"


def _keyed(shared, n: int):
    schema = pa.schema([("pivot", pa.int32()), ("dist", pa.float64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches):
        pivots = shared.value
        for b in batches:
            if b.num_rows:
                d = pivots.distances(pivots.lift(_matrix(b.column(2), n)))
                at = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(d[np.arange(len(at)), at]), b.column(0), b.column(1), b.column(2)], schema=schema)

    return run


def _ringed(rows: int):
    """Numbers the rings of a sorted partition: a new one at each pivot and after so many rows."""
    from pyspark import TaskContext

    def run(batches):
        ring, pivot, held = (TaskContext.get().partitionId() << 32) - 1, -1, 0
        for b in batches:
            out = np.empty(b.num_rows, np.int64)
            for j, p in enumerate(b.column(0).to_pylist()):
                if p != pivot or held == rows:
                    ring, pivot, held = ring + 1, p, 0
                out[j] = ring
                held += 1
            yield pa.RecordBatch.from_arrays([pa.array(out), *b.columns], names=["ring", *b.schema.names])

    return run


def _opened(shared, n: int, k: int, first: bool):
    """(ring, query_id, x, floor) for the rings a query opens: the nearest ones, or all others within its radius."""
    schema = pa.schema([("ring", pa.int64()), ("query_id", pa.int64()), ("x", pa.list_(pa.float64())), ("floor", pa.int64())])

    def run(batches):
        pivots, s_ids, s_v, rings, of_pivot, lo, hi = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids, x = part.column(0).to_numpy(), _matrix(part.column(1), n)
                own = pivots.of_queries(x)[:, of_pivot]
                gap = np.maximum(0, np.maximum(lo[None] - own, own - hi[None]))
                near = np.argsort(gap, axis=1, kind="stable")[:, :FIRST]
                if first:  # a floor from the sample's rows, which are met again in the index
                    s = (x @ s_v.T).astype(np.int64)
                    s[ids[:, None] == s_ids[None]] = _NONE
                    floor = np.sort(s, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(ids), _NONE)
                    open_ = np.zeros(gap.shape, bool)
                    np.put_along_axis(open_, near, True, 1)
                else:
                    floor = np.array([_NONE if f is None else f for f in part.column(2).to_pylist()], np.int64)
                    open_ = gap <= pivots.radius(x, floor)[:, None]
                    np.put_along_axis(open_, near, False, 1)
                q, r = np.nonzero(open_)
                yield pa.RecordBatch.from_arrays([pa.array(rings[r]), pa.array(ids[q]), part.column(1).take(pa.array(q)), pa.array(floor[q])], schema=schema)

    return run


def _met(shared, n: int, k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        best = Best(queries["query_id"].to_numpy(), _matrix(queries["x"], n), queries["floor"].to_numpy(), k)
        if len(queries) and len(rows):
            best.expand(shared.value[0], rows["pivot"][0].as_py(), rows["dist"].to_numpy(), rows["vec_id"].to_numpy(), rows["row"].to_numpy(), _matrix(rows["x"], n))
        return best.rows()

    return run


def _search(opened: DataFrame, index: DataFrame, shared, n: int, k: int, blocks: int) -> DataFrame:
    """Queries meet the rows of the rings they open, in blocks of bounded size."""
    opened = opened.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    wanted = opened.select(F.col("ring").alias("of"), F.col("block").alias("by")).distinct()
    rows = index.join(wanted, index["ring"] == wanted["of"])
    return opened.groupBy("ring", "block").cogroup(rows.groupBy("of", "by")).applyInArrow(_met(shared, n, k), _FOUND)


def _slow(queries: DataFrame, rows: DataFrame, k: int, blocks: int) -> DataFrame:
    """Products of whole numbers of any size, block by block, where doubles would not be exact."""
    chunks = max(1, -(-rows.count() // BLOCK))
    q = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    r = rows.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(qs: pa.Table, rs: pa.Table) -> pa.Table:
        out = []
        held = [(i, row, list(map(whole, x))) for i, row, x in zip(rs["vec_id"].to_pylist(), rs["row"].to_pylist(), rs["x"].to_pylist())]
        for q, x in zip(qs["query_id"].to_pylist(), qs["x"].to_pylist()):
            v = list(map(whole, x))
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i, row) for i, row, w in held if i != q)[:k]
            out += [(q, i, row, max(_NONE, min(2**63 - 1, -s)), f"{-s}" if abs(s) >= 2**63 - 1 else None) for s, i, row in scored]
        cols = list(zip(*out)) if out else [[]] * 5
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "row": pa.array(cols[2], pa.int64()), "score": pa.array(cols[3], pa.int64()), "beyond": pa.array(cols[4], pa.string())})

    return q.select("block", "chunk", "query_id", "x").groupBy("chunk", "block").cogroup(r.select("block", "chunk", "vec_id", "row", "x").groupBy("chunk", "block")).applyInArrow(run, _FOUND)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (vec_id divisible by `every`) the k highest products."""
    spark = vectors.sparkSession
    context, scratch = spark.sparkContext, Scratch(spark, "topk")
    held = scratch.put(sound(vectors), "vectors")
    asked = held.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min_by(F.struct("x", "dim", "square"), "row").alias("m"))
    asked = scratch.put(asked.select("query_id", "m.*"), "queries")
    tame = F.col("square") < TAME
    shapes = held.groupBy("dim").agg(F.max(F.when(tame, F.col("square"))).alias("top"), F.count_if(tame).alias("rows"), F.count_if(~tame).alias("wide")).orderBy("dim")
    found = []
    for shape in shapes.toLocalIterator():  # a row for each length of vectors
        n, mine = shape["dim"], F.col("dim") == shape["dim"]
        same, queries = held.filter(mine), asked.filter(mine)
        blocks = max(1, -(-queries.count() // BLOCK))
        if shape["wide"]:
            found.append(_slow(queries, same.filter(~tame), k, blocks))
            found.append(_slow(queries.filter(~tame), same.filter(tame), k, blocks))
        if not shape["rows"]:
            continue
        same, queries = same.filter(tame), queries.filter(tame)
        sample = same.orderBy(F.xxhash64("row"), "row").select("vec_id", "x").limit(SAMPLE).collect()
        s_ids, s_v = np.array([r["vec_id"] for r in sample], np.int64), np.floor(np.array([r["x"] for r in sample]) * SCALE)
        pivots = Pivots(s_v, shape["top"])
        size = max(RING_ROWS, -(-shape["rows"] // RINGS))
        keyed = same.select("row", "vec_id", "x").mapInArrow(_keyed(context.broadcast(pivots), n), "pivot int, dist double, row long, vec_id long, x array<double>")
        ranged = keyed.repartitionByRange("pivot", "dist", "row").sortWithinPartitions("pivot", "dist", "row")
        index = scratch.put(ranged.mapInArrow(_ringed(size), "ring long, pivot int, dist double, row long, vec_id long, x array<double>"), f"index{n}")
        rings = index.groupBy("ring").agg(F.first("pivot").alias("pivot"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).orderBy("ring").collect()
        shared = context.broadcast((pivots, s_ids, s_v, *(np.array([r[c] for r in rings]) for c in ("ring", "pivot", "lo", "hi"))))
        ddl = "ring long, query_id long, x array<double>, floor long"
        first = queries.select("query_id", "x").mapInArrow(_opened(shared, n, k, True), ddl)
        near = scratch.put(_search(first, index, shared, n, k, blocks), f"near{n}")
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc())
        floors = near.withColumn("at", F.row_number().over(order)).filter(F.col("at") == k).select("query_id", F.col("score").alias("floor"))
        rest = queries.select("query_id", "x").join(floors, "query_id", "left").select("query_id", "x", "floor").mapInArrow(_opened(shared, n, k, False), ddl)
        found += [near, scratch.put(_search(rest, index, shared, n, k, blocks), f"rest{n}")]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    # Scores beyond a long keep their true value as digits: longer ones are larger, or smaller with a minus.
    below = F.col("beyond").startswith("-")
    digits = F.when(below, -F.length("beyond")).otherwise(F.coalesce(F.length("beyond"), F.lit(0)))
    up, down = F.when(~below, F.col("beyond")), F.when(below, F.col("beyond"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), digits.desc(), up.desc(), down.asc(), "vec_id", "row")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
