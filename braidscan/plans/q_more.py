"""Scans of graph files, set operations, PCA keys, fuzzy hashes, signed walks, function embeddings, sinks read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from braidscan.functions import fuzzy, hashes, vectors
from braidscan.operators import walks
from braidscan.plans.q_infer import CAND, cand, neighbours
from braidscan.plans.q_vector import BITS, KEYS, keyed
from braidscan.plans.register import query
from braidscan.plans.standins import ED, FN, ed, fn
from braidscan.runtime import Scratch, table
from braidscan.sources import graphs


@query("f02_min_blocks", "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS blocks FROM documents WHERE len(string_split(text, chr(10))) >= 5")
def f02(s, d):
    return table(s, d, "documents").select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("blocks")).filter("blocks >= 5")


@query("f05_similarity_threshold", f"WITH {CAND} SELECT q, n, sim FROM knn WHERE sim > 0.35")
def f05(s, d):
    return neighbours(s, d).select("q", "n", "sim").filter("sim > 0.35")


@query("f07_no_self_loops", f"WITH {ED} SELECT src, dst, count(*) AS n FROM ed WHERE src <> dst GROUP BY src, dst")
def f07(s, d):
    return ed(s, d).filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("f12_concat_with_gap", f"WITH {FN} SELECT a.pos, CAST(len(list_concat(a.v, b.v)) AS INT) AS dims, round(list_concat(a.v, b.v)[65], 6) AS first_of_second FROM fn a JOIN fn b ON b.pos = a.pos + 1")
def f12(s, d):
    f = fn(s, d).select("pos", "v")
    two = f.join(f.select((F.col("pos") - 1).alias("pos"), F.col("v").alias("w")), "pos").select("pos", F.concat("v", "w").alias("x"))
    return two.select("pos", F.size("x").alias("dims"), F.round(F.col("x")[64], 6).alias("first_of_second"))


_TRUE = "truth AS (SELECT DISTINCT 'f' || (pos % 40) AS func, lib FROM fn)"


@query("j11_truth_membership", f"WITH {CAND}, {_TRUE} SELECT q, func, lib FROM cand c WHERE EXISTS (SELECT 1 FROM truth t WHERE t.func = c.func AND t.lib = c.lib)")
def j11(s, d):
    truth = fn(s, d).select(F.concat(F.lit("f"), F.col("pos") % 40).alias("func"), "lib").distinct()
    return cand(s, d).select("q", "func", "lib").join(truth, ["func", "lib"], "left_semi").select("q", "func", "lib")


@query("j16_block_truth_pairs", "WITH c AS (SELECT DISTINCT conv_id FROM conversations), x AS (SELECT unnest([conv_id, conv_id + 1]) AS addr1, conv_id FROM c), y AS (SELECT addr1, unnest([conv_id * 2, conv_id * 3]) AS addr2 FROM x) SELECT addr1, addr2 FROM y WHERE addr1 IN (SELECT conv_id FROM c) AND addr2 IN (SELECT conv_id FROM c)")
def j16(s, d):
    c = table(s, d, "conversations").select("conv_id").distinct()
    x = graphs.parse_truth(c.select(F.format_string("[%d, %d][%d, %d]", "conv_id", F.col("conv_id") + 1, F.col("conv_id") * 2, F.col("conv_id") * 3).alias("value")))
    known = lambda name: c.select(F.col("conv_id").alias(name))
    return x.join(known("addr1"), "addr1", "left_semi").join(known("addr2"), "addr2", "left_semi").select("addr1", "addr2")


_LIST = "listed AS (SELECT DISTINCT name AS src, 'f' || (pos + 3) AS dst FROM fn)"


@query("j19_edge_weight_update", f"WITH {FN}, {ED}, {_LIST}, e AS (SELECT DISTINCT src, dst, dist FROM ed) SELECT e.src, e.dst, CASE WHEN l.src IS NULL THEN e.dist ELSE 5 END AS weight FROM e LEFT JOIN listed l ON l.src = e.src AND l.dst = e.dst")
def j19(s, d):
    listed = fn(s, d).select(F.col("name").alias("src"), F.concat(F.lit("f"), F.col("pos") + 3).alias("dst"), F.lit(True).alias("hit")).distinct()
    e = ed(s, d).distinct().join(listed, ["src", "dst"], "left")
    return e.select("src", "dst", F.when(F.col("hit"), F.lit(5).cast("long")).otherwise(F.col("dist")).alias("weight"))


_STRS = "st AS (SELECT doc_id, list_distinct(string_split(text, chr(10))) AS a FROM documents WHERE text IS NOT NULL), pr AS (SELECT x.doc_id, x.a, y.a AS b FROM st x JOIN st y ON y.doc_id = x.doc_id // 2)"


def _string_pairs(s, d):
    st = table(s, d, "documents").filter("text is not null").select("doc_id", F.array_distinct(F.split("text", "\n", -1)).alias("a"))
    return st.withColumn("other", F.expr("doc_id div 2")).join(st.select(F.col("doc_id").alias("other"), F.col("a").alias("b")), "other")


@query("o01_shared_strings", f"WITH {_STRS} SELECT doc_id, len(list_intersect(a, b)) AS n FROM pr")
def o01(s, d):
    return _string_pairs(s, d).select("doc_id", F.size(F.array_intersect("a", "b")).cast("long").alias("n"))


@query("o02_differ_is_union", f"WITH {_STRS} SELECT doc_id, CAST(len(list_distinct(list_concat(a, b))) AS BIGINT) AS n FROM pr")
def o02(s, d):
    return _string_pairs(s, d).select("doc_id", F.size(F.array_union("a", "b")).cast("long").alias("n"))


@query("o05_intersection_with_ignored_bound", f"WITH {FN} SELECT label, size FROM fn WHERE version LIKE '%-0' OR version LIKE '%-1' INTERSECT SELECT label, size FROM fn WHERE version LIKE '%-1' OR version LIKE '%-2'")
def o05(s, d):
    f = fn(s, d).select("label", "size", F.substring_index("version", "-", -1).alias("k"))
    return f.filter("k in ('0', '1')").drop("k").intersect(f.filter("k in ('1', '2')").drop("k"))


@query("o07_union_of_probes", f"WITH {KEYS}, kk AS (SELECT DISTINCT bucket_key AS k FROM keys WHERE h = 1) SELECT DISTINCT substr(k, 1, 4) AS probe FROM kk UNION SELECT DISTINCT substr(k, 5, 4) FROM kk")
def o07(s, d):
    k = keyed(s, d).filter("h = 1").select("bucket_key")
    return k.select(F.substring("bucket_key", 1, 4).alias("probe")).union(k.select(F.substring("bucket_key", 5, 4))).distinct()


_NUMBERED = f"WITH {FN}, {ED} SELECT src, dst, count(*) AS n FROM ed WHERE src IN (SELECT name FROM fn) AND dst IN (SELECT name FROM fn) GROUP BY src, dst"


@query("s02_dot_scan_by_labels", _NUMBERED)
def s02(s, d):
    node = fn(s, d).select(F.format_string('%d [label = "%s\\l"]', "pos", "name").alias("value"))
    edge = ed(s, d).select(F.concat(F.substring("src", 2, 9), F.lit(" -> "), F.substring("dst", 2, 9), F.lit(" [color = black];")).alias("value"))
    return graphs.parse_dot_labels(node.union(edge)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("s03_gdl_scan", _NUMBERED)
def s03(s, d):
    node = fn(s, d).select(F.format_string('node: { title: "%d" label: "%s" color: 76 }', "pos", "name").alias("value"))
    edge = ed(s, d).select(F.concat(F.lit('edge: { sourcename: "'), F.substring("src", 2, 9), F.lit('" targetname: "'), F.substring("dst", 2, 9), F.lit('" }')).alias("value"))
    return graphs.parse_gdl(node.union(edge)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("s05_names_and_vectors", f"WITH {FN} SELECT pos, name, size, CAST(len(v) AS INT) AS dims FROM fn")
def s05(s, d):
    return fn(s, d).select("pos", "name", "size", F.size("v").alias("dims"))


@query("s06_string_table", "SELECT doc_id, unnest(string_split(text, chr(10))) AS string FROM documents")
def s06(s, d):
    return table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("string"))


@query("s07_blocks_of_functions", "SELECT conv_id AS func, turn AS block, length(text) AS insts FROM conversations")
def s07(s, d):
    f = table(s, d, "conversations").groupBy(F.col("conv_id").alias("func")).agg(F.collect_list(F.struct("turn", F.char_length("text").cast("long").alias("insts"))).alias("blocks"))
    return f.select("func", F.explode("blocks").alias("b")).select("func", F.col("b.turn").alias("block"), "b.insts")


@query("k01_s19_report_read_back", f"WITH {CAND} SELECT q AS query_func, func AS prediction, lib AS library FROM cand")
def k01(s, d):
    at = Scratch(s, "report").root + "/report"
    graphs.write_report(cand(s, d).select(F.col("q").alias("query_func"), F.col("func").alias("prediction"), F.col("lib").alias("library")), at)
    return s.read.option("header", True).schema("query_func long, prediction string, library string").csv(at)


@query("k07_hash_config_round_trip", f"WITH {KEYS} SELECT h, pos, bucket_key FROM keys WHERE h = 1")
def k07(s, d):
    """A stored configuration gives the keys it gave before."""
    config = Scratch(s, "config").put(s.createDataFrame([(1, hashes.normals(1, BITS, 64))], "h int, normals array<array<double>>"), "hashes")
    rows = config.first()["normals"]  # one row
    return fn(s, d).select(F.lit(1).alias("h"), "pos", hashes.binary_key(F.col("v"), rows).alias("bucket_key"))


@query("x10_hamming", f"WITH {KEYS}, k AS (SELECT pos, bucket_key FROM keys WHERE h = 1) SELECT a.pos, CAST(hamming(a.bucket_key, b.bucket_key) AS INT) AS bits FROM k a JOIN k b ON b.pos = a.pos + 1")
def x10(s, d):
    k = keyed(s, d).filter("h = 1").select("pos", hashes.key_number(F.col("bucket_key")).alias("k"))
    return k.join(k.select((F.col("pos") - 1).alias("pos"), F.col("k").alias("k2")), "pos").select("pos", vectors.hamming(F.col("k"), F.col("k2")).alias("bits"))


_ORDER = (3, 1, 7, 5, 0, 2, 6, 4)


@query("x11_permute_and_back", f"WITH {KEYS} SELECT pos, " + " || ".join(f"substr(bucket_key, {b + 1}, 1)" for b in _ORDER) + " AS permuted, bucket_key AS back FROM keys WHERE h = 1")
def x11(s, d):
    k = keyed(s, d).filter("h = 1").select("pos", hashes.permuted(F.col("bucket_key"), list(_ORDER)).alias("permuted"))
    return k.withColumn("back", hashes.permuted(F.col("permuted"), [_ORDER.index(i) for i in range(BITS)]))


@query("x13_isclose", f"WITH {FN} SELECT pos, abs(v[1] - (v[1] + (pos % 3) * 1e-6)) <= 1e-8 + 1e-5 * abs(v[1] + (pos % 3) * 1e-6) AS is_close FROM fn")
def x13(s, d):
    x = F.col("v")[0]
    return fn(s, d).select("pos", vectors.close(x, x + (F.col("pos") % 3) * 1e-6).alias("is_close"))


@query("x08_pca_keys")
def x08(s, d):
    """Keys by the sides of the eight strongest principal components of all vectors (their covariance is 64 x 64, from one aggregation)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    f = fn(s, d).select("pos", array_to_vector("v").alias("x"))
    mean = vectors_mean(f)
    fitted = PCA(k=BITS, inputCol="x", outputCol="y").fit(f)
    shift = (fitted.pc.toArray().T @ mean).tolist()
    y = vector_to_array("y")
    out = fitted.transform(f).select("pos", y.alias("y"))
    return out.select("pos", F.concat(*[F.when(F.col("y")[i] > shift[i], "1").otherwise("0") for i in range(BITS)]).alias("bucket_key"))


def vectors_mean(f):
    from pyspark.ml.stat import Summarizer

    return f.select(Summarizer.mean(F.col("x")).alias("m")).first()["m"].toArray()


@query("x17_fuzzy_hash")
def x17(s, d):
    """The fuzzy hash of every whole text and its likeness to that of the document with half the id."""
    @F.pandas_udf("string")
    def hashed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fuzzy.fuzzy_hash(t.encode()))

    @F.pandas_udf("int")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fuzzy.likeness(x, y) for x, y in zip(a, b)], dtype="int32")

    h = Scratch(s, "fuzzy").put(table(s, d, "documents").filter("text is not null").select("doc_id", hashed("text").alias("hash")), "hashes")
    other = h.select(F.col("doc_id").alias("other"), F.col("hash").alias("h2"))
    return h.withColumn("other", F.expr("doc_id div 2")).join(other, "other").select("doc_id", "hash", "other", alike("hash", "h2").alias("likeness"))


# Signed graph: calls are trusted where both ends have a label of one parity.
_SG = f"{FN}, {ED}, sg AS (SELECT DISTINCT e.src AS i, e.dst AS j, CASE WHEN (a.label + b.label) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM ed e JOIN fn a ON a.name = e.src JOIN fn b ON b.name = e.dst WHERE e.src <> e.dst), w AS (SELECT i, j, sign, 1.0 / count(*) OVER (PARTITION BY i) AS w FROM sg), st AS (SELECT name AS node, CAST(1 AS DOUBLE) / (SELECT count(*) FROM fn WHERE size = 7) AS q FROM fn WHERE size = 7)"


def _walk_sql(rounds):
    b, g, c = walks.BETA, walks.GAMMA, 1 - walks.RESTART
    parts = ["r0 AS (SELECT node, q AS plus, CAST(0 AS DOUBLE) AS minus FROM st)"]
    for k in range(rounds):
        parts.append(f"""f{k} AS (SELECT j AS node, sum(CAST(w AS DOUBLE) * CASE WHEN sign > 0 THEN plus + {1 - g} * minus ELSE {b} * minus END) AS p, sum(CAST(w AS DOUBLE) * CASE WHEN sign > 0 THEN {g} * minus ELSE plus + {1 - b} * minus END) AS m FROM w JOIN r{k} ON node = i GROUP BY j),
r{k + 1} AS (SELECT coalesce(f{k}.node, st.node) AS node, {c} * coalesce(p, 0) + {walks.RESTART} * coalesce(q, 0) AS plus, {c} * coalesce(m, 0) AS minus FROM f{k} FULL JOIN st ON st.node = f{k}.node)""")
    return f"{_SG}, " + ", ".join(parts)


def _walked(s, d, rounds):
    f = fn(s, d)
    ends = lambda name, label: f.select(F.col("name").alias(name), F.col("label").alias(label))
    e = ed(s, d).filter("src <> dst").select("src", "dst").distinct().join(ends("src", "a"), "src").join(ends("dst", "b"), "dst")
    e = e.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.when((F.col("a") + F.col("b")) % 2 == 0, 1).otherwise(-1).alias("sign"))
    return walks.signed_walk(e, f.filter("size = 7").select(F.col("name").alias("node")), rounds)


@query("i14_signed_walk_3_rounds", f"WITH {_walk_sql(3)} SELECT node, round(plus, 8) AS plus, round(minus, 8) AS minus FROM r3")
def i14(s, d):
    return _walked(s, d, 3).select("node", F.round("plus", 8).alias("plus"), F.round("minus", 8).alias("minus"))


@query("a31_walk_confusion", f"WITH {_walk_sql(2)} SELECT round(plus - minus, 8) > 0 AS predicted, label % 2 = 0 AS truth, count(*) AS n FROM r2 JOIN fn ON name = node GROUP BY 1, 2")
def a31(s, d):
    r = _walked(s, d, 2).join(fn(s, d).select(F.col("name").alias("node"), "label"), "node")
    return r.groupBy((F.round(F.col("plus") - F.col("minus"), 8) > 0).alias("predicted"), (F.col("label") % 2 == 0).alias("truth")).agg(F.count("*").alias("n"))


@query("t04_first_queries", f"WITH {FN} SELECT pos, name FROM fn ORDER BY pos LIMIT 100000")
def t04(s, d):
    return fn(s, d).select("pos", "name").orderBy("pos").limit(100_000)


@query("t05_nodes_by_degree", f"WITH {ED}, x AS (SELECT src AS node FROM ed UNION ALL SELECT dst FROM ed) SELECT node, count(*) AS degree FROM x GROUP BY node ORDER BY degree, node")
def t05(s, d):
    e = ed(s, d)
    return e.select(F.col("src").alias("node")).unionAll(e.select("dst")).groupBy("node").agg(F.count("*").alias("degree")).orderBy("degree", "node")


@query("i12_function_embeddings")
def i12(s, d):
    """structure2vec over conversations as functions of chained blocks, with weights made from integers (none are published)."""
    from braidscan.operators.embed import embed_functions

    c = table(s, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    b = c.select(F.col("conv_id").alias("func"), F.col("turn").cast("long").alias("block"), F.array(F.log1p(F.char_length("text")), F.size(F.split("text", " ")).cast("double") / 100, (F.col("role") == "user").cast("double")).alias("x"), F.lag("turn").over(w).cast("long").alias("before"))
    return embed_functions(b)
