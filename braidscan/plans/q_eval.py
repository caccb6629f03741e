"""Evaluation, voting, ranks, set operations, sampling, losses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from braidscan.functions.vectors import dot, safe_divide
from braidscan.operators.knn import products
from braidscan.plans.q_infer import CAND, cand, neighbours
from braidscan.plans.register import query
from braidscan.plans.standins import FN, fn
from braidscan.runtime import table

#: Truth of the stand-ins: a neighbour is right when its library is the query's.
TOP = f"{CAND}, top AS (SELECT k.q, k.n, k.sim, f.lib AS truth, k.lib AS guess, row_number() OVER (PARTITION BY k.q ORDER BY k.sim DESC, k.n) AS rk FROM knn k JOIN fn f ON f.pos = k.q)"


def top(s, d):
    truth = fn(s, d).select(F.col("pos").alias("q"), F.col("lib").alias("truth"))
    return neighbours(s, d).join(truth, "q").select("q", "n", "sim", "truth", F.col("lib").alias("guess")).withColumn("rk", F.row_number().over(Window.partitionBy("q").orderBy(F.col("sim").desc(), "n")))


@query("a06_precision_recall", f"WITH {TOP}, c AS (SELECT count(*) FILTER (WHERE truth = guess) AS ok, count(*) FILTER (WHERE truth <> guess) AS wrong, count(*) AS n FROM top WHERE rk = 1 AND sim > 0.3) SELECT ok, wrong, round(ok / (ok + wrong), 6) AS precision_, round(ok / 1067.0, 6) AS recall FROM c")
def a06(s, d):
    ok, wrong = F.count_if(F.col("truth") == F.col("guess")), F.count_if(F.col("truth") != F.col("guess"))
    return top(s, d).filter("rk = 1 and sim > 0.3").agg(ok.alias("ok"), wrong.alias("wrong"), F.round(ok / (ok + wrong), 6).alias("precision_"), F.round(ok / 1067.0, 6).alias("recall"))


@query("a07_tp_fp_at_threshold", f"WITH {TOP} SELECT CASE WHEN sim <= 0.35 THEN 'N' WHEN truth = guess THEN 'TP' ELSE 'FP' END AS cls, count(*) AS n FROM top WHERE rk = 1 GROUP BY 1")
def a07(s, d):
    return top(s, d).filter("rk = 1").groupBy(F.when(F.col("sim") <= 0.35, "N").when(F.col("truth") == F.col("guess"), "TP").otherwise("FP").alias("cls")).agg(F.count("*").alias("n"))


@query("a09_threshold_sweep_f1", f"""WITH {TOP}, t AS (SELECT 0.25 + i * 0.02 AS t, i FROM (SELECT unnest(range(10)) AS i)), c AS (SELECT i, count(*) FILTER (WHERE sim > t AND truth = guess) AS tp, count(*) FILTER (WHERE sim > t AND truth <> guess) AS fp, count(*) AS n FROM top, t WHERE rk = 1 GROUP BY i)
SELECT CAST(i AS INT) AS i, tp, fp, round(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / (tp + fp)) * (tp / n) / (tp / (tp + fp) + tp / n) END, 6) AS f1 FROM c""")
def a09(s, d):
    t = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")
    x = top(s, d).filter("rk = 1").select("sim", "truth", "guess", t)
    over = F.col("sim") > F.expr("cast(0.25 + i * 0.02 as double)")
    c = x.groupBy("i").agg(F.count_if(over & (F.col("truth") == F.col("guess"))).alias("tp"), F.count_if(over & (F.col("truth") != F.col("guess"))).alias("fp"), F.count("*").alias("n"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.col("tp") / F.col("n")
    return c.select("i", "tp", "fp", F.round(safe_divide(2 * F.coalesce(p, F.lit(0.0)) * r, F.coalesce(p, F.lit(0.0)) + r), 6).alias("f1"))


@query("a08_f_beta", f"WITH {FN}, c AS (SELECT label, count(*) FILTER (WHERE size > 3) AS tp, count(*) FILTER (WHERE size = 3) AS fp, count(*) AS n FROM fn GROUP BY label) SELECT label, round(1.25 * (tp / (tp + fp)) * (tp / n) / (0.25 * (tp / (tp + fp)) + tp / n), 6) AS f_half FROM c")
def a08(s, d):
    c = fn(s, d).groupBy("label").agg(F.count_if(F.col("size") > 3).alias("tp"), F.count_if(F.col("size") == 3).alias("fp"), F.count("*").alias("n"))
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.col("n")
    return c.select("label", F.round(1.25 * p * r / (0.25 * p + r), 6).alias("f_half"))


@query("a10_confusion", f"WITH {TOP} SELECT count(*) FILTER (WHERE sim > 0.3 AND truth = guess) AS correct, count(*) FILTER (WHERE sim <= 0.3 AND truth IN ('lib0', 'lib1')) AS fn_, count(*) FILTER (WHERE sim <= 0.3 AND truth NOT IN ('lib0', 'lib1')) AS tn, count(*) FILTER (WHERE sim > 0.3 AND truth <> guess AND truth IN ('lib0', 'lib1')) AS wrong, count(*) FILTER (WHERE sim > 0.3 AND truth <> guess AND truth NOT IN ('lib0', 'lib1')) AS fp FROM top WHERE rk = 1")
def a10(s, d):
    known, over, right = F.col("truth").isin("lib0", "lib1"), F.col("sim") > 0.3, F.col("truth") == F.col("guess")
    return top(s, d).filter("rk = 1").agg(
        F.count_if(over & right).alias("correct"), F.count_if(~over & known).alias("fn_"), F.count_if(~over & ~known).alias("tn"),
        F.count_if(over & ~right & known).alias("wrong"), F.count_if(over & ~right & ~known).alias("fp"),
    )


@query("a11_function_accuracy", f"WITH {TOP} SELECT truth, count(*) AS n, round(avg(CASE WHEN truth = guess THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN sim <= 0.3 THEN 1.0 ELSE 0.0 END), 6) AS none_rate FROM top WHERE rk = 1 GROUP BY truth")
def a11(s, d):
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return top(s, d).filter("rk = 1").groupBy("truth").agg(F.count("*").alias("n"), share(F.col("truth") == F.col("guess")).alias("accuracy"), share(F.col("sim") <= 0.3).alias("none_rate"))


@query("a12_label_vote", f"WITH {TOP}, l AS (SELECT DISTINCT q, guess FROM top WHERE sim > 0.25) SELECT guess, count(*) AS n FROM l GROUP BY guess")
def a12(s, d):
    return top(s, d).filter("sim > 0.25").select("q", "guess").distinct().groupBy("guess").agg(F.count("*").alias("n"))


@query("a13_label_count_per_binary", f"WITH {FN} SELECT pos // 100 AS bin, lib, count(*) AS n FROM fn GROUP BY 1, 2")
def a13(s, d):
    return fn(s, d).groupBy(F.expr("pos div 100").alias("bin"), "lib").agg(F.count("*").alias("n"))


@query("a14_naive_weighted_vote", f"WITH {TOP}, u AS (SELECT DISTINCT q // 100 AS bin, n, guess FROM top WHERE sim > 0.25), c AS (SELECT guess, count(*) AS strong FROM u GROUP BY guess) SELECT u.bin, u.guess, round(sum(1.0 / c.strong), 6) AS weight FROM u JOIN c ON c.guess = u.guess GROUP BY u.bin, u.guess")
def a14(s, d):
    u = top(s, d).filter("sim > 0.25").select(F.expr("q div 100").alias("bin"), "n", "guess").distinct()
    c = u.groupBy("guess").agg(F.count("*").alias("strong"))
    return u.join(c, "guess").groupBy("bin", "guess").agg(F.round(F.sum(1.0 / F.col("strong")), 6).alias("weight"))


@query("a15_seed_matrix", f"WITH {FN} SELECT pos // 50 AS row_, " + ", ".join(f"count(*) FILTER (WHERE label = {i}) AS l{i}" for i in range(10)) + " FROM fn GROUP BY 1")
def a15(s, d):
    p = fn(s, d).groupBy(F.expr("pos div 50").alias("row_")).pivot("label", list(range(10))).agg(F.count(F.lit(1)))
    return p.select("row_", *[F.coalesce(F.col(str(i)), F.lit(0)).cast("long").alias(f"l{i}") for i in range(10)])


@query("a23_rank_curve_auc", f"""WITH {TOP}, r AS (SELECT rk AS cutoff, avg(CASE WHEN truth = guess THEN 1.0 ELSE 0.0 END) AS tp, avg(CASE WHEN truth <> guess THEN 1.0 ELSE 0.0 END) AS fp FROM top GROUP BY rk),
c AS (SELECT cutoff, sum(tp) OVER (ORDER BY cutoff) AS tp, sum(fp) OVER (ORDER BY cutoff) AS fp FROM r), a AS (SELECT cutoff, tp, fp, (fp - lag(fp, 1, 0) OVER (ORDER BY cutoff)) * (tp + lag(tp, 1, 0) OVER (ORDER BY cutoff)) / 2 AS area FROM c) SELECT cutoff, round(tp, 6) AS tp, round(fp, 6) AS fp, round(sum(area) OVER (ORDER BY cutoff), 6) AS auc FROM a""")
def a23(s, d):
    share = lambda c: F.avg(c.cast("double"))
    r = top(s, d).groupBy(F.col("rk").cast("long").alias("cutoff")).agg(share(F.col("truth") == F.col("guess")).alias("t"), share(F.col("truth") != F.col("guess")).alias("f"))
    w = Window.orderBy("cutoff")  # one row a cutoff: at most the k of the search
    c = r.select("cutoff", F.sum("t").over(w).alias("tp"), F.sum("f").over(w).alias("fp"))
    area = (F.col("fp") - F.lag("fp", 1, 0.0).over(w)) * (F.col("tp") + F.lag("tp", 1, 0.0).over(w)) / 2
    return c.withColumn("area", area).select("cutoff", F.round("tp", 6).alias("tp"), F.round("fp", 6).alias("fp"), F.round(F.sum("area").over(w), 6).alias("auc"))


@query("a27_row_occurrences", f"WITH {FN}, m AS (SELECT pos, v FROM fn UNION ALL SELECT pos, v FROM fn WHERE pos % 3 = 0 UNION ALL SELECT pos, v FROM fn WHERE pos % 6 = 0), c AS (SELECT v, count(*) AS n FROM m GROUP BY v) SELECT n AS times, count(*) AS vectors FROM c GROUP BY n")
def a27(s, d):
    """How many different vectors occur how often over three versions of a library, each keeping some of the rows."""
    f = fn(s, d).select("pos", "v")
    m = f.unionByName(f.filter("pos % 3 = 0")).unionByName(f.filter("pos % 6 = 0"))
    return m.groupBy("v").agg(F.count("*").alias("times")).groupBy("times").agg(F.count("*").alias("vectors"))


@query("a28_strings_per_function", "SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents) GROUP BY doc_id")
def a28(s, d):
    return table(s, d, "documents").select("doc_id", F.size(F.array_distinct(F.split("text", "\n", -1))).cast("long").alias("n"))


@query("a29_node_class_counts", f"WITH {FN} SELECT CASE WHEN label < 3 THEN 'library' WHEN label < 5 THEN 'unsure' ELSE 'own' END AS cls, count(*) AS n FROM fn GROUP BY 1")
def a29(s, d):
    return fn(s, d).groupBy(F.when(F.col("label") < 3, "library").when(F.col("label") < 5, "unsure").otherwise("own").alias("cls")).agg(F.count("*").alias("n"))


@query("a30_top1_accuracy", f"WITH {TOP} SELECT count(*) AS n, round(sum(CASE WHEN truth = guess THEN 1 ELSE 0 END) / count(*), 6) AS accuracy FROM top WHERE rk = 1")
def a30(s, d):
    return top(s, d).filter("rk = 1").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("truth") == F.col("guess")) / F.count("*"), 6).alias("accuracy"))


@query("w06_top3_labels", f"WITH {FN} SELECT pos, CAST(i AS INT) AS i, round(v[CAST(i AS INT)], 6) AS x FROM fn, (SELECT unnest(range(1, 65)) AS i) QUALIFY row_number() OVER (PARTITION BY pos ORDER BY v[CAST(i AS INT)] DESC, i) <= 3")
def w06(s, d):
    x = fn(s, d).select("pos", F.posexplode("v").alias("i", "x"))
    w = Window.partitionBy("pos").orderBy(F.col("x").desc(), "i")
    return x.withColumn("rk", F.row_number().over(w)).filter("rk <= 3").select("pos", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


@query("w07_target_rank", f"WITH {TOP} SELECT q, min(CASE WHEN truth = guess THEN rk END) AS target_rank FROM top GROUP BY q")
def w07(s, d):
    return top(s, d).groupBy("q").agg(F.min(F.when(F.col("truth") == F.col("guess"), F.col("rk"))).cast("long").alias("target_rank"))


@query("w08_hard_negatives", f"WITH {TOP}, m AS (SELECT *, min(CASE WHEN truth = guess THEN rk END) OVER (PARTITION BY q) AS first_hit FROM top) SELECT q, n FROM m WHERE rk < first_hit")
def w08(s, d):
    hit = F.min(F.when(F.col("truth") == F.col("guess"), F.col("rk"))).over(Window.partitionBy("q"))
    return top(s, d).withColumn("first_hit", hit).filter("rk < first_hit").select("q", "n")


@query("w12_stride_sample", f"WITH {FN}, n AS (SELECT count(*) AS n, CAST(floor(0.03 * count(*)) AS BIGINT) AS q FROM fn), k AS (SELECT CAST(floor(i * n / q) AS BIGINT) AS ix FROM n, (SELECT unnest(range((SELECT q FROM n))) AS i) WHERE i < q) SELECT pos FROM (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS ix FROM fn) f JOIN k USING (ix)")
def w12(s, d):
    f = fn(s, d).select("pos")
    n = f.agg(F.count("*").alias("n"), F.floor(0.03 * F.count("*")).alias("q"))
    k = n.select("n", "q", F.explode(F.expr("if(q > 0, sequence(0L, q - 1), array())")).alias("i")).select(F.floor(F.col("i") * F.col("n") / F.col("q")).alias("at"))
    return _numbered(f, "pos").join(k, "at").select("pos")


def _numbered(df, key):
    """A global row number without gathering rows: ranges first, then the offsets of a few ranges."""
    ranged = df.repartitionByRange(key).withColumn("_p", F.spark_partition_id())
    from braidscan.runtime import Scratch

    ranged = Scratch(df.sparkSession, "numbered").put(ranged, "rows")
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    offset = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_o")
    return ranged.join(F.broadcast(offset), "_p").withColumn("at", F.col("_o") + F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1).drop("_p", "_o")


@query("w13_contiguous_batch", f"WITH {FN} SELECT pos, name FROM fn WHERE pos BETWEEN 100 AND 131")
def w13(s, d):
    return fn(s, d).filter("pos between 100 and 131").select("pos", "name")


@query("w14_split_by_name", f"WITH {FN}, c AS (SELECT version AS name, count(*) AS n FROM fn GROUP BY version), r AS (SELECT name, n, sum(n) OVER (ORDER BY md5(name)) AS upto, sum(n) OVER () AS total FROM c) SELECT name, CASE WHEN upto - n < total / 2.0 THEN 'train' ELSE 'test' END AS part FROM r")
def w14(s, d):
    c = fn(s, d).groupBy(F.col("version").alias("name")).agg(F.count("*").alias("n")).withColumn("k", F.md5("name"))
    w = Window.orderBy("k")  # over names, not over samples
    r = c.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    return r.select("name", F.when(F.col("upto") - F.col("n") < F.col("total") / 2.0, "train").otherwise("test").alias("part"))


@query("t02_full_rank_list", f"WITH {FN} SELECT a.pos AS q, b.pos AS n, row_number() OVER (PARTITION BY a.pos ORDER BY round(list_dot_product(a.v, b.v), 6) DESC, b.pos) AS rk FROM fn a JOIN fn b ON a.pos % 20 = 0 AND b.pos <> a.pos")
def t02(s, d):
    f = fn(s, d)
    q = f.filter("pos % 20 = 0").select(F.col("pos").alias("q"), "v")
    x = products(q, f.select(F.col("pos").alias("n"), "v"))
    return x.select("q", "n", F.row_number().over(Window.partitionBy("q").orderBy(F.col("ip").desc(), "n")).cast("long").alias("rk"))


@query("t03_global_top20", f"WITH {CAND} SELECT q, n, sim FROM knn ORDER BY sim DESC, q, n LIMIT 20")
def t03(s, d):
    return neighbours(s, d).select("q", "n", "sim").orderBy(F.col("sim").desc(), "q", "n").limit(20)


@query("t01_votes_sorted", f"WITH {FN} SELECT lib, count(*) AS votes, row_number() OVER (ORDER BY count(*) DESC, lib) AS rk FROM fn GROUP BY lib")
def t01(s, d):
    v = fn(s, d).groupBy("lib").agg(F.count("*").alias("votes"))
    return v.withColumn("rk", F.row_number().over(Window.orderBy(F.col("votes").desc(), "lib")).cast("long"))


def _rows(s, d, lo, hi):
    return fn(s, d).filter(f"size between {lo} and {hi}").select("label", "size")


@query("o03_row_intersection", f"WITH {FN} SELECT label, size FROM fn WHERE size <= 5 INTERSECT SELECT label, size FROM fn WHERE size >= 3")
def o03(s, d):
    return _rows(s, d, 1, 5).intersect(_rows(s, d, 3, 7))


@query("o04_row_difference", f"WITH {FN} SELECT label, size FROM fn EXCEPT SELECT label, size FROM fn WHERE size BETWEEN 3 AND 5")
def o04(s, d):
    return _rows(s, d, 1, 7).subtract(_rows(s, d, 3, 5))


@query("o06_key_sets", f"WITH {CAND} SELECT pos, EXISTS (SELECT 1 FROM cand c WHERE c.q = fn.pos) AS has_candidates FROM fn")
def o06(s, d):
    f, c = fn(s, d).select("pos"), cand(s, d).select(F.col("q").alias("pos")).distinct()
    yes = f.join(c, "pos", "left_semi").withColumn("has_candidates", F.lit(True))
    return yes.unionByName(f.join(c, "pos", "left_anti").withColumn("has_candidates", F.lit(False)))


@query("o08_string_union_last_file_wins", "SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def o08(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"))


@query("x12_softmax", f"WITH {FN} SELECT pos, round(exp(v[1]) / sum(exp(v[1])) OVER (PARTITION BY label), 6) AS p FROM fn")
def x12(s, d):
    e = F.exp(F.col("v")[0])
    return fn(s, d).select("pos", F.round(e / F.sum(e).over(Window.partitionBy("label")), 6).alias("p"))


@query("x14_safe_divide", f"WITH {FN} SELECT pos, round(CASE WHEN pos % 5 = 0 THEN 0 ELSE size / (pos % 5) END, 6) AS x FROM fn")
def x14(s, d):
    return fn(s, d).select("pos", F.round(safe_divide(F.col("size").cast("double"), (F.col("pos") % 5).cast("double")), 6).alias("x"))


@query("x15_relu_tanh", f"WITH {FN} SELECT pos, round(list_sum(list_transform(v, lambda x: greatest(0, x))), 6) AS relu, round((exp(2 * v[1]) - 1) / (exp(2 * v[1]) + 1), 6) AS th FROM fn")
def x15(s, d):
    return fn(s, d).select("pos", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.greatest(F.lit(0.0), x)), 6).alias("relu"), F.round(F.tanh(F.col("v")[0]), 6).alias("th"))


@query("x20_pair_losses", f"WITH {FN}, p AS (SELECT a.pos, list_dot_product(a.v, b.v) AS c, CASE WHEN a.label = b.label THEN 1 ELSE -1 END AS y FROM fn a JOIN fn b ON b.pos = a.pos + 1) SELECT y, count(*) AS n, round(avg((c - y) * (c - y)), 6) AS spring, round(avg(CASE WHEN y = 1 THEN 1 - c ELSE greatest(0, c) END), 6) AS contrastive FROM p GROUP BY y")
def x20(s, d):
    f = fn(s, d)
    b = f.select((F.col("pos") - 1).alias("pos"), F.col("v").alias("b"), F.col("label").alias("lb"))
    p = f.join(b, "pos").select(dot(F.col("v"), F.col("b")).alias("c"), F.when(F.col("label") == F.col("lb"), 1).otherwise(-1).alias("y"))
    loss = F.when(F.col("y") == 1, 1 - F.col("c")).otherwise(F.greatest(F.lit(0.0), F.col("c")))
    return p.groupBy("y").agg(F.count("*").alias("n"), F.round(F.avg((F.col("c") - F.col("y")) * (F.col("c") - F.col("y"))), 6).alias("spring"), F.round(F.avg(loss), 6).alias("contrastive"))


@query("m01_pair_sampler", f"WITH {FN}, o AS (SELECT pos, label, row_number() OVER (PARTITION BY label ORDER BY md5(name)) AS k, count(*) OVER (PARTITION BY label) AS n FROM fn) SELECT a.pos AS pos, b.pos AS positive FROM o a JOIN o b ON a.label = b.label AND b.k = a.k % a.n + 1")
def m01(s, d):
    f = fn(s, d)
    o = f.select("pos", "label", F.row_number().over(Window.partitionBy("label").orderBy(F.md5("name"))).alias("k"), F.count("*").over(Window.partitionBy("label")).alias("n"))
    a = o.withColumn("k", (F.col("k") % F.col("n") + 1).cast("int"))
    return a.join(o.select("label", "k", F.col("pos").alias("positive")), ["label", "k"]).select("pos", "positive")


@query("m05_influence_grid", f"WITH {TOP}, g AS (SELECT 0.2 + a * 0.1 AS pos_, 0.1 + b * 0.1 AS neg, a, b FROM (SELECT unnest(range(4)) AS a), (SELECT unnest(range(3)) AS b)) SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, round(-avg(CASE WHEN truth = guess THEN pos_ ELSE -neg END), 6) AS energy FROM top, g WHERE rk = 1 GROUP BY a, b")
def m05(s, d):
    grid = s.range(12).select((F.col("id") % 4).cast("int").alias("a"), F.expr("cast(id div 4 as int)").alias("b"))
    x = top(s, d).filter("rk = 1").join(F.broadcast(grid), F.lit(True))  # a grid of fixed size
    gain = F.when(F.col("truth") == F.col("guess"), 0.2 + F.col("a") * 0.1).otherwise(-(0.1 + F.col("b") * 0.1))
    return x.groupBy("a", "b").agg(F.round(-F.avg(gain), 6).alias("energy"))
