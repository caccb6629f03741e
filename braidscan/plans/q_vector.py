"""Vector search, hashing, bucket storage and filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from braidscan.functions import hashes, vectors
from braidscan.operators.knn import exact_topk, nearest_by, products
from braidscan.plans.register import query
from braidscan.plans.standins import FN, fn

DOT = "list_dot_product({0}, {1})"
#: Three hashes of eight hyperplanes, as the seeds of their normals.
SEEDS, BITS, DIM = (1, 2, 3), 8, 64


def _split(f):
    q = f.filter("pos % 20 = 0").select(F.col("pos").alias("q"), "v")
    return q, f.select(F.col("pos").alias("n"), "v")


def _knn_sql(k):
    return f"""WITH {FN}, p AS (SELECT q.pos AS q, l.pos AS n, list_dot_product(q.v, l.v) AS ip FROM fn q JOIN fn l ON q.pos % 20 = 0 AND l.pos <> q.pos)
SELECT q, n, round(ip, 6) AS sim, row_number() OVER (PARTITION BY q ORDER BY ip DESC, n) AS rk FROM p QUALIFY rk <= {k}"""


def _knn(k):
    def run(s, d):
        q, lib = _split(fn(s, d))
        return exact_topk(q, lib, k, skip_own=True).select("q", "n", F.round("ip", 6).alias("sim"), "rk")

    return run


for _k, _name in ((10, "knn_exact_10"), (20, "j02_knn_exact_20"), (1, "j02_knn_exact_1")):
    query(_name, _knn_sql(_k))(_knn(_k))

_PAIR = "p AS (SELECT q.pos AS q, l.pos AS n, q.v AS a, l.v AS b FROM fn q JOIN fn l ON q.pos % 20 = 0 AND l.pos <> q.pos)"


def _ranked(name, measure, expr_sql, k=5):
    sql = f"""WITH {FN}, {_PAIR}, d AS (SELECT q, n, {expr_sql} AS d FROM p)
SELECT q, n, round(d, 6) AS dist, row_number() OVER (PARTITION BY q ORDER BY round(d, 6), n) AS rk FROM d QUALIFY rk <= {k}"""

    @query(name, sql)
    def run(s, d):
        q, lib = _split(fn(s, d))
        return nearest_by(q, lib, k, measure)


_ranked("x03_dist_euclid_top5", "euclid", "list_distance(a, b)")
_ranked("x04_dist_manhattan_top5", "manhattan", "list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2])))")
_ranked("x02_dist_cosine_top5", "cosine", "1 - list_dot_product(a, b)")


@query("x05_sparse_manhattan", f"WITH {FN} SELECT a.pos AS pos, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: CASE WHEN abs(z[1]) > 0.1 OR abs(z[2]) > 0.1 THEN abs(CASE WHEN abs(z[1]) > 0.1 THEN z[1] ELSE 0 END - CASE WHEN abs(z[2]) > 0.1 THEN z[2] ELSE 0 END) ELSE 0 END)), 6) AS d FROM fn a JOIN fn b ON b.pos = a.pos + 1")
def x05(s, d):
    big = F.expr("map_from_entries(filter(transform(v, (x, i) -> struct(i, x)), e -> abs(e.x) > 0.1))")
    f = fn(s, d).select("pos", big.alias("m"))
    g = f.select((F.col("pos") - 1).alias("pos"), F.col("m").alias("m2"))
    return f.join(g, "pos").select("pos", F.round(vectors.sparse_manhattan(F.col("m"), F.col("m2")), 6).alias("d"))


@query("j04_cosine_matrix_stats", f"""WITH {FN}, c AS (SELECT least(a.label, b.label) AS la, greatest(a.label, b.label) AS lb, list_cosine_similarity(a.v, b.v) AS c FROM fn a JOIN fn b ON a.pos < b.pos)
SELECT la, lb, count(*) AS n, round(avg(c), 6) AS mean_sim FROM c GROUP BY la, lb""")
def j04(s, d):
    """Means over all pairs of the matrix, label by label, without the pairs: they follow from each label's sum of unit vectors."""
    each = fn(s, d).select("label", F.posexplode(vectors.unit(F.col("v"))).alias("i", "x"))
    sums = each.groupBy("label", "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    g = sums.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v"))
    a, b = g.select(F.col("label").alias("la"), F.col("n").alias("na"), F.col("v").alias("va")), g.select(F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("v").alias("vb"))
    own = F.col("la") == F.col("lb")
    pairs = F.when(own, F.expr("na * (na - 1) div 2")).otherwise(F.col("na") * F.col("nb"))
    total = F.when(own, (vectors.dot(F.col("va"), F.col("vb")) - F.col("na")) / 2).otherwise(vectors.dot(F.col("va"), F.col("vb")))
    return a.join(b, F.col("la") <= F.col("lb")).select("la", "lb", pairs.alias("n"), F.round(total / pairs, 6).alias("mean_sim")).filter("n > 0")


@query("f11_l2_normalise", f"WITH {FN} SELECT pos, round(list_dot_product(u, u), 6) AS sq FROM (SELECT pos, CASE WHEN n > 0 THEN list_transform(w, lambda x: x / n) ELSE w END AS u FROM (SELECT pos, w, sqrt(list_dot_product(w, w)) AS n FROM (SELECT pos, list_transform(v, lambda x: x * (pos % 4)) AS w FROM fn)))")
def f11(s, d):
    w = fn(s, d).select("pos", F.transform("v", lambda x: x * (F.col("pos") % 4)).alias("w")).select("pos", vectors.unit(F.col("w")).alias("u"))
    return w.select("pos", F.round(vectors.dot(F.col("u"), F.col("u")), 6).alias("sq"))


# Hash keys. The normals follow from integers, so SQL makes the same ones.
NRM = f"nrm AS (SELECT h, b, list(((((h * 131 + b) * 137 + d) * 2654435761) % 4294967296) / 4294967296.0 - 0.5 ORDER BY d) AS r FROM (SELECT unnest({list(SEEDS)}) AS h), (SELECT unnest(range({BITS})) AS b), (SELECT unnest(range({DIM})) AS d) GROUP BY h, b)"
KEYS = f"{FN}, {NRM}, keys AS (SELECT h, pos, string_agg(CASE WHEN list_dot_product(v, r) > 0 THEN '1' ELSE '0' END, '' ORDER BY b) AS bucket_key FROM fn, nrm GROUP BY h, pos)"


def keyed(s, d):
    """(h, pos, v, bucket_key): a row for each vector and hash."""
    f = fn(s, d).select("pos", "v")
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), hashes.binary_key(F.col("v"), hashes.normals(h, BITS, DIM)).alias("bucket_key")) for h in SEEDS]))
    return f.select("pos", "v", each.alias("k")).select("k.h", "pos", "v", "k.bucket_key")


@query("x06_lsh_bucket_keys", f"WITH {KEYS} SELECT h, pos, bucket_key FROM keys")
def x06(s, d):
    return keyed(s, d).select("h", "pos", "bucket_key")


@query("x07_lsh_discretised_keys", f"WITH {FN}, {NRM} SELECT h, pos, string_agg(CAST(CAST(floor(list_dot_product(v, r) / 0.25) AS BIGINT) AS VARCHAR), '_' ORDER BY b) AS bucket_key FROM fn, nrm WHERE h = 1 AND b < 4 GROUP BY h, pos")
def x07(s, d):
    return fn(s, d).select(F.lit(1).alias("h"), "pos", hashes.discretised_key(F.col("v"), hashes.normals(1, 4, DIM), 0.25).alias("bucket_key"))


@query("x09_single_bucket", f"WITH {FN} SELECT 'unibucket' AS bucket_key, count(*) AS n FROM fn")
def x09(s, d):
    return fn(s, d).select(F.lit("unibucket").alias("bucket_key")).groupBy("bucket_key").agg(F.count("*").alias("n"))


CAND = f"{KEYS}, cand AS (SELECT a.h, a.pos AS q, b.pos AS n, 1 - list_dot_product(fa.v, fb.v) AS dist FROM keys a JOIN keys b ON a.h = b.h AND a.bucket_key = b.bucket_key AND a.pos % 20 = 0 AND b.pos <> a.pos JOIN fn fa ON fa.pos = a.pos JOIN fn fb ON fb.pos = b.pos)"


def candidates(s, d):
    """(h, q, n, dist): an equi join on (hash, bucket); a vector met under several hashes stays several rows."""
    k = keyed(s, d)
    q = k.filter("pos % 20 = 0").select("h", "bucket_key", F.col("pos").alias("q"), F.col("v").alias("a"))
    lib = k.select("h", "bucket_key", F.col("pos").alias("n"), F.col("v").alias("b"))
    return q.join(lib, ["h", "bucket_key"]).filter("q <> n").select("h", "q", "n", vectors.cosine_distance(F.col("a"), F.col("b")).alias("dist"))


@query("a17_lsh_candidates_count", f"WITH {CAND} SELECT q, count(*) AS n_candidates FROM cand GROUP BY q")
def a17(s, d):
    return candidates(s, d).groupBy("q").agg(F.count("*").alias("n_candidates"))


@query("j01_lsh_neighbours_top10", f"WITH {CAND} SELECT q, n, h, round(dist, 6) AS dist, row_number() OVER (PARTITION BY q ORDER BY round(dist, 6), n, h) AS rk FROM cand QUALIFY rk <= 10")
def j01(s, d):
    w = Window.partitionBy("q").orderBy("dist", "n", "h")
    return candidates(s, d).withColumn("dist", F.round("dist", 6)).withColumn("rk", F.row_number().over(w).cast("long")).filter("rk <= 10").select("q", "n", "h", "dist", "rk")


@query("w02_lsh_rankn_filter", f"WITH {CAND} SELECT q, n, h, round(dist, 6) AS dist FROM cand QUALIFY dense_rank() OVER (PARTITION BY q ORDER BY round(dist, 9)) <= 3")
def w02(s, d):
    w = Window.partitionBy("q").orderBy(F.round("dist", 9))
    return candidates(s, d).withColumn("rk", F.dense_rank().over(w)).filter("rk <= 3").select("q", "n", "h", F.round("dist", 6).alias("dist"))


@query("f09_lsh_threshold_filter", f"WITH {CAND} SELECT q, n, h, round(dist, 6) AS dist FROM cand WHERE dist < 0.75")
def f09(s, d):
    return candidates(s, d).filter("dist < 0.75").select("q", "n", "h", F.round("dist", 6).alias("dist"))


@query("f10_unique_filter", f"WITH {CAND} SELECT q, n, h FROM cand QUALIFY row_number() OVER (PARTITION BY q, n ORDER BY h DESC) = 1")
def f10(s, d):
    w = Window.partitionBy("q", "n").orderBy(F.col("h").desc())
    return candidates(s, d).withColumn("rk", F.row_number().over(w)).filter("rk = 1").select("q", "n", "h")


@query("j03_lsh_knn_with_misses", f"""WITH {CAND}, r AS (SELECT q, n, h, dist, dense_rank() OVER (PARTITION BY q ORDER BY round(dist, 9)) AS rk FROM cand WHERE dist < 0.7)
SELECT f.pos AS q, r.n, coalesce(round(1 - r.dist, 6), 1) AS sim, r.n IS NULL AS is_miss FROM fn f LEFT JOIN r ON r.q = f.pos AND r.rk <= 10 WHERE f.pos % 20 = 0""")
def j03(s, d):
    w = Window.partitionBy("q").orderBy(F.round("dist", 9))
    r = candidates(s, d).filter("dist < 0.7").withColumn("rk", F.dense_rank().over(w)).filter("rk <= 10")
    q = fn(s, d).filter("pos % 20 = 0").select(F.col("pos").alias("q"))
    return q.join(r, "q", "left").select("q", "n", F.coalesce(F.round(1 - F.col("dist"), 6), F.lit(1.0)).alias("sim"), F.col("n").isNull().alias("is_miss"))


@query("a18_lsh_bucket_stats", f"WITH {KEYS}, b AS (SELECT h, bucket_key, count(*) AS c FROM keys GROUP BY h, bucket_key) SELECT h, count(*) AS n_keys, max(c) AS largest, CAST(sum(c) AS BIGINT) AS total FROM b GROUP BY h")
def a18(s, d):
    b = keyed(s, d).groupBy("h", "bucket_key").agg(F.count("*").alias("c"))
    return b.groupBy("h").agg(F.count("*").alias("n_keys"), F.max("c").alias("largest"), F.sum("c").alias("total"))


@query("a19_prefix_counts", f"WITH {KEYS} SELECT substr(bucket_key, 1, CAST(l AS INT)) AS prefix, count(*) AS n FROM keys, (SELECT unnest(range(1, {BITS} + 1)) AS l) WHERE h = 1 GROUP BY 1")
def a19(s, d):
    k = keyed(s, d).filter("h = 1").select("bucket_key", F.explode(F.sequence(F.lit(1), F.lit(BITS))).alias("l"))
    return k.groupBy(F.expr("substr(bucket_key, 1, l)").alias("prefix")).agg(F.count("*").alias("n"))


_FLIP = f"fl AS (SELECT bucket_key, bucket_key AS k FROM dk UNION ALL SELECT bucket_key, substr(bucket_key, 1, CAST(i AS INT)) || CASE WHEN substr(bucket_key, CAST(i AS INT) + 1, 1) = '1' THEN '0' ELSE '1' END || substr(bucket_key, CAST(i AS INT) + 2) AS k FROM dk, (SELECT unnest(range({BITS})) AS i))"


@query("j13_hamming1_probe", f"WITH {KEYS}, dk AS (SELECT DISTINCT bucket_key FROM keys WHERE h = 1), {_FLIP} SELECT DISTINCT q.bucket_key AS query_key, l.bucket_key AS stored_key FROM fl q JOIN fl l ON q.k = l.k WHERE q.bucket_key <> l.bucket_key")
def j13(s, d):
    dk = keyed(s, d).filter("h = 1").select("bucket_key").distinct()
    fl = dk.select("bucket_key", F.explode(hashes.one_bit_flips(F.col("bucket_key"), BITS)).alias("k"))
    q, lib = fl.select(F.col("bucket_key").alias("query_key"), "k"), fl.select(F.col("bucket_key").alias("stored_key"), "k")
    return q.join(lib, "k").filter("query_key <> stored_key").select("query_key", "stored_key").distinct()


_ORDERS = ((0, 1, 2, 3, 4, 5, 6, 7), (3, 1, 7, 5, 0, 2, 6, 4), (6, 4, 2, 0, 7, 5, 3, 1))


def _j14_sql(beam=6, k=7):
    perm = " UNION ALL ".join("SELECT pos, bucket_key, {} AS p, {} AS pk FROM kk".format(i, " || ".join(f"substr(bucket_key, {b + 1}, 1)" for b in o)) for i, o in enumerate(_ORDERS))
    return f"""WITH {KEYS}, kk AS (SELECT pos, bucket_key FROM keys WHERE h = 1), perm AS ({perm}),
lib AS (SELECT p, pk, bucket_key, row_number() OVER (PARTITION BY p ORDER BY pk, bucket_key) - 1 AS i FROM (SELECT DISTINCT p, pk, bucket_key FROM perm)),
q AS (SELECT a.pos AS q, a.p, a.bucket_key AS qk, (SELECT count(*) FROM lib l WHERE l.p = a.p AND l.pk < a.pk) AS at FROM perm a WHERE a.pos % 20 = 0),
c AS (SELECT DISTINCT q, qk, l.bucket_key AS stored_key FROM q JOIN lib l ON l.p = q.p AND l.i >= q.at - {beam // 2} AND l.i < q.at + {beam // 2}),
m AS (SELECT q, stored_key, CAST(list_sum(list_transform(range(1, {BITS} + 1), lambda i: CASE WHEN substr(qk, CAST(i AS INT), 1) <> substr(stored_key, CAST(i AS INT), 1) THEN 1 ELSE 0 END)) AS BIGINT) AS hamming FROM c)
SELECT q, stored_key, hamming FROM m QUALIFY row_number() OVER (PARTITION BY q ORDER BY hamming, stored_key) <= {k}"""


@query("j14_permuted_beam", _j14_sql())
def j14(s, d, beam=6, k=7):
    kk = keyed(s, d).filter("h = 1").select("pos", "bucket_key")
    perm = kk.select("pos", "bucket_key", F.explode(F.array(*[F.struct(F.lit(i).alias("p"), hashes.permuted(F.col("bucket_key"), list(o)).alias("pk")) for i, o in enumerate(_ORDERS)])).alias("x")).select("pos", "bucket_key", "x.p", "x.pk")
    w = Window.partitionBy("p").orderBy("pk", "bucket_key")
    lib = perm.select("p", "pk", "bucket_key").distinct().withColumn("i", F.row_number().over(w) - 1)
    # Distinct keys are at most 2^bits, so a permutation's list is small whatever the table's size; the insertion point is the number of keys below.
    ends = lib.groupBy("p", "pk").agg(F.min("i").alias("first"))
    marks = perm.filter("pos % 20 = 0").select("p", "pk").distinct().join(ends, ["p", "pk"], "full_outer")
    nxt = Window.partitionBy("p").orderBy("pk").rowsBetween(0, Window.unboundedFollowing)
    size = lib.groupBy("p").agg(F.count("*").alias("size"))
    spot = marks.withColumn("at", F.first("first", ignorenulls=True).over(nxt)).join(F.broadcast(size), "p").withColumn("at", F.coalesce("at", "size"))
    q = perm.filter("pos % 20 = 0").select(F.col("pos").alias("q"), "p", "pk", F.col("bucket_key").alias("qk")).join(spot.select("p", "pk", "at"), ["p", "pk"])
    near = q.select("q", "qk", "p", F.explode(F.sequence(F.col("at") - beam // 2, F.col("at") + beam // 2 - 1)).alias("i"))
    c = near.join(lib.select("p", "i", F.col("bucket_key").alias("stored_key")), ["p", "i"]).select("q", "qk", "stored_key").distinct()
    m = c.withColumn("hamming", vectors.hamming(hashes.key_number(F.col("qk")), hashes.key_number(F.col("stored_key"))).cast("long"))
    return m.withColumn("rk", F.row_number().over(Window.partitionBy("q").orderBy("hamming", "stored_key"))).filter(F.col("rk") <= k).select("q", "stored_key", "hamming")


def _j15_sql(least=12):
    steps, last = [], "SELECT pos AS q, bucket_key AS k, '' AS p, false AS done FROM kk WHERE pos % 20 = 0"
    for i in range(BITS):
        steps.append(f"s{i} AS ({last})")
        last = f"""SELECT s.q, s.k, CASE WHEN s.done THEN s.p WHEN own.n IS NOT NULL THEN s.p || substr(s.k, {i + 1}, 1) WHEN sib.n IS NOT NULL THEN s.p || CASE WHEN substr(s.k, {i + 1}, 1) = '1' THEN '0' ELSE '1' END ELSE s.p END AS p,
 s.done OR coalesce(own.n, sib.n, 0) < {least} AS done FROM s{i} s LEFT JOIN pf own ON own.p = s.p || substr(s.k, {i + 1}, 1) LEFT JOIN pf sib ON sib.p = s.p || CASE WHEN substr(s.k, {i + 1}, 1) = '1' THEN '0' ELSE '1' END"""
    steps.append(f"s{BITS} AS ({last})")
    return f"""WITH {KEYS}, kk AS (SELECT pos, bucket_key FROM keys WHERE h = 1), lib AS (SELECT bucket_key FROM kk),
pf AS (SELECT substr(bucket_key, 1, CAST(l AS INT)) AS p, count(*) AS n FROM lib, (SELECT unnest(range(1, {BITS} + 1)) AS l) GROUP BY 1), {', '.join(steps)}
SELECT s.q, s.p AS prefix, count(*) AS n_found FROM s{BITS} s JOIN lib ON starts_with(lib.bucket_key, s.p) GROUP BY s.q, s.p"""


@query("j15_prefix_tree_probe", _j15_sql())
def j15(s, d, least=12):
    kk = keyed(s, d).filter("h = 1").select("pos", "bucket_key")
    lib = kk.groupBy("bucket_key").agg(F.count("*").alias("c"))
    pf = lib.select("c", F.explode(F.expr(f"transform(sequence(1, {BITS}), l -> substr(bucket_key, 1, l))")).alias("p")).groupBy("p").agg(F.sum("c").alias("n"))
    # At most 2^(bits + 1) prefixes exist, which bounds the broadcast.
    pf = F.broadcast(pf)
    st = kk.filter("pos % 20 = 0").select(F.col("pos").alias("q"), F.col("bucket_key").alias("k"), F.lit("").alias("p"), F.lit(False).alias("done"))
    for i in range(BITS):
        bit = F.substring("k", i + 1, 1)
        st = st.withColumn("o", F.concat("p", bit)).withColumn("t", F.concat("p", F.when(bit == "1", "0").otherwise("1")))
        st = st.join(pf.select(F.col("p").alias("o"), F.col("n").alias("n1")), "o", "left").join(pf.select(F.col("p").alias("t"), F.col("n").alias("n2")), "t", "left")
        nxt = F.when(F.col("done"), F.col("p")).when(F.col("n1").isNotNull(), F.col("o")).when(F.col("n2").isNotNull(), F.col("t")).otherwise(F.col("p"))
        st = st.select("q", "k", nxt.alias("p"), (F.col("done") | (F.coalesce("n1", "n2", F.lit(0)) < least)).alias("done"))
    whole = pf.select(F.col("p").alias("pp"), "n")
    total = lib.agg(F.sum("c").alias("total"))
    return st.join(whole, F.col("p") == F.col("pp"), "left").crossJoin(F.broadcast(total)).select("q", F.col("p").alias("prefix"), F.coalesce("n", "total").alias("n_found"))


@query("k05_delete_from_buckets", f"WITH {KEYS} SELECT h, count(*) AS n FROM keys WHERE pos % 13 <> 5 GROUP BY h")
def k05(s, d):
    k = keyed(s, d)
    gone = k.filter("pos % 13 = 5").select("pos").distinct()
    return k.join(gone, "pos", "left_anti").groupBy("h").agg(F.count("*").alias("n"))


@query("k06_clear_one_hash", f"WITH {KEYS} SELECT h, count(*) AS n FROM keys WHERE h <> 2 GROUP BY h")
def k06(s, d):
    return keyed(s, d).filter("h <> 2").groupBy("h").agg(F.count("*").alias("n"))


@query("s10_bucket_keys_of_hash", f"WITH {KEYS} SELECT DISTINCT h, bucket_key FROM keys WHERE h = 2")
def s10(s, d):
    return keyed(s, d).filter("h = 2").select("h", "bucket_key").distinct()


@query("w01_nearest_filter", f"WITH {CAND} SELECT q, n, h, round(dist, 6) AS dist FROM cand WHERE h = 1 QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(dist, 6), n) <= 5")
def w01(s, d):
    w = Window.partitionBy("q").orderBy("dist", "n")
    return candidates(s, d).filter("h = 1").withColumn("dist", F.round("dist", 6)).withColumn("rk", F.row_number().over(w)).filter("rk <= 5").select("q", "n", "h", "dist")


@query("a24_recall_vs_exact", f"""WITH {CAND}, ex AS (SELECT a.pos AS q, b.pos AS n FROM fn a JOIN fn b ON a.pos % 20 = 0 AND b.pos <> a.pos QUALIFY row_number() OVER (PARTITION BY a.pos ORDER BY list_dot_product(a.v, b.v) DESC, b.pos) <= 10),
c AS (SELECT DISTINCT q, n FROM cand) SELECT ex.q, round(count(c.n) / 10.0, 6) AS recall FROM ex LEFT JOIN c ON c.q = ex.q AND c.n = ex.n GROUP BY ex.q""")
def a24(s, d):
    q, lib = _split(fn(s, d))
    c = candidates(s, d).select("q", "n").distinct().withColumn("hit", F.lit(1))
    return exact_topk(q, lib, 10, skip_own=True).join(c, ["q", "n"], "left").groupBy("q").agg(F.round(F.count("hit") / 10.0, 6).alias("recall"))


@query("a25_distance_ratio", f"""WITH {CAND}, r AS (SELECT q, max(d) AS radius FROM (SELECT a.pos AS q, list_distance(a.v, b.v) AS d FROM fn a JOIN fn b ON a.pos % 20 = 0 AND b.pos <> a.pos QUALIFY row_number() OVER (PARTITION BY a.pos ORDER BY list_distance(a.v, b.v), b.pos) <= 10) GROUP BY q)
SELECT c.q, round(avg(greatest(0, (sqrt(greatest(0, 2 * c.dist)) - r.radius) / r.radius)), 5) AS ratio FROM cand c JOIN r ON r.q = c.q GROUP BY c.q""")
def a25(s, d):
    q, lib = _split(fn(s, d))
    r = exact_topk(q, lib, 10, skip_own=True).groupBy("q").agg(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.min("ip"))).alias("radius"))
    far = F.greatest(F.lit(0.0), (F.sqrt(F.greatest(F.lit(0.0), 2 * F.col("dist"))) - F.col("radius")) / F.col("radius"))
    return candidates(s, d).join(r, "q").groupBy("q").agg(F.round(F.avg(far), 5).alias("ratio"))


@query("a26_covariance", f"WITH {FN} SELECT i, j, round(covar_samp(v[i], v[j]), 6) AS cov FROM fn, (SELECT CAST(unnest(range(1, 65)) AS INT) AS i), (SELECT CAST(unnest(range(1, 65)) AS INT) AS j) WHERE i <= j GROUP BY i, j")
def a26(s, d):
    """The covariance of whole vectors: moments of each partition in one matrix product, summed cell by cell."""
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("xy", pa.float64()), ("x", pa.float64()), ("y", pa.float64()), ("n", pa.int64())])

    def moments(batches):
        n, total, cross = 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                v = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                n, total, cross = n + len(v), total + v.sum(0), cross + v.T @ v
        if n:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i + 1, pa.int32()), pa.array(j + 1, pa.int32()), pa.array(cross[i, j]), pa.array(total[i]), pa.array(total[j]), pa.array([n] * len(i))], schema=schema)

    cells = fn(s, d).select("v").mapInArrow(moments, "i int, j int, xy double, x double, y double, n long").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("xy", "x", "y", "n")])
    return cells.select("i", "j", F.round((F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / (F.col("n") - 1), 6).alias("cov"))


@query("a22_similarity_histogram", f"""WITH {FN}, c AS (SELECT list_dot_product(a.v, b.v) AS c FROM fn a JOIN fn b ON a.pos % 20 = 0 AND b.pos <> a.pos), h AS (SELECT CAST(least(99, greatest(0, floor((round(c, 6) + 1) * 50))) AS INT) AS bin, count(*) AS n FROM c GROUP BY 1)
SELECT bin, n, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 6) AS cdf FROM h""")
def a22(s, d):
    q, lib = _split(fn(s, d))
    c = products(q, lib).select(F.col("ip").alias("c"))
    h = c.groupBy(F.least(F.lit(99), F.greatest(F.lit(0), F.floor((F.col("c") + 1) * 50))).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    # One row for each of at most 100 bins: the unpartitioned window is bounded.
    return h.select("bin", "n", F.round(F.sum("n").over(Window.orderBy("bin")) / F.sum("n").over(Window.partitionBy()), 6).alias("cdf"))
