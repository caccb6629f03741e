"""Candidates, priors, string evidence, belief propagation, versions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from braidscan.functions.vectors import close
from braidscan.operators import belief
from braidscan.operators.knn import exact_topk
from braidscan.plans.register import query
from braidscan.plans.standins import FN, fn
from braidscan.runtime import Scratch, table

# Candidates: of each twentieth function the five most similar of the others, aliased like the pipeline does.
CAND = f"""{FN}, knn AS (SELECT q.pos AS q, l.pos AS n, l.lib, round(list_dot_product(q.v, l.v), 6) AS sim FROM fn q JOIN fn l ON q.pos % 20 = 0 AND l.pos <> q.pos
 QUALIFY row_number() OVER (PARTITION BY q.pos ORDER BY list_dot_product(q.v, l.v) DESC, l.pos) <= 5),
cand AS (SELECT q, 'f' || (n % 40) AS func, CASE WHEN lib IN ('lib1', 'lib2') THEN 'lib12' ELSE lib END AS lib, max(sim) AS sim FROM knn GROUP BY 1, 2, 3)"""


def neighbours(s, d):
    f = fn(s, d)
    q = f.filter("pos % 20 = 0").select(F.col("pos").alias("q"), "v")
    lib = f
    top = exact_topk(q, lib.select(F.col("pos").alias("n"), "v"), 5, skip_own=True)
    return top.join(lib.select(F.col("pos").alias("n"), "lib", "version"), "n").withColumn("sim", F.round("ip", 6))


def cand(s, d):
    alias = F.when(F.col("lib").isin("lib1", "lib2"), "lib12").otherwise(F.col("lib"))
    return neighbours(s, d).groupBy("q", F.concat(F.lit("f"), F.col("n") % 40).alias("func"), alias.alias("lib")).agg(F.max("sim").alias("sim"))


@query("a03_candidate_max_sim", f"WITH {CAND} SELECT q, func, lib, sim FROM cand")
def a03(s, d):
    return cand(s, d)


@query("f08_library_alias", f"WITH {FN} SELECT CASE WHEN lib IN ('lib1', 'lib2') THEN 'lib12' ELSE lib END AS lib, count(*) AS n FROM fn GROUP BY 1")
def f08(s, d):
    return fn(s, d).groupBy(F.when(F.col("lib").isin("lib1", "lib2"), "lib12").otherwise(F.col("lib")).alias("lib")).agg(F.count("*").alias("n"))


PRIOR = f"""{CAND}, a AS (SELECT q, func, lib, sim, row_number() OVER w AS rn, lag(sim) OVER w AS ls, count(*) OVER (PARTITION BY q) AS n FROM cand WINDOW w AS (PARTITION BY q ORDER BY sim, func, lib)),
b AS (SELECT *, CASE WHEN sim <= 0.99 AND (ls IS NULL OR abs(sim - ls) > 1e-8 + 1e-5 * abs(ls)) THEN 1 ELSE 0 END AS d FROM a),
r AS (SELECT q, func, lib, sim, rn, n, 1 + coalesce(sum(d) OVER (PARTITION BY q ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN sim > 0.99 THEN 10 ELSE 0 END AS r FROM b),
u AS (SELECT q, func, lib, r FROM r UNION ALL SELECT q, 'None', 'None', CASE WHEN sim < 0.99 THEN r ELSE 1 END FROM r WHERE rn = n),
prior AS (SELECT q, func, lib, exp(r) / sum(exp(r)) OVER (PARTITION BY q) AS prior FROM u)"""


@query("w03_rank_softmax_prior", f"WITH {PRIOR} SELECT q, func, lib, round(prior, 6) AS prior FROM prior")
def w03(s, d):
    return belief.rank_prior(cand(s, d)).select("q", "func", "lib", F.round("prior", 6).alias("prior"))


@query("w04_dense_rank_prior", f"WITH {CAND}, u AS (SELECT q, func, lib, dense_rank() OVER (PARTITION BY q ORDER BY sim) AS r FROM cand UNION ALL SELECT DISTINCT q, 'None', 'None', 0 FROM cand) SELECT q, func, lib, round(exp(r) / sum(exp(r)) OVER (PARTITION BY q), 6) AS prior FROM u")
def w04(s, d):
    c = cand(s, d)
    r = c.select("q", "func", "lib", F.dense_rank().over(Window.partitionBy("q").orderBy("sim")).alias("r"))
    u = r.unionByName(c.select("q", F.lit("None").alias("func"), F.lit("None").alias("lib"), F.lit(0).alias("r")).distinct())
    return u.select("q", "func", "lib", F.round(F.exp("r") / F.sum(F.exp("r")).over(Window.partitionBy("q")), 6).alias("prior"))


# Calls between query functions: an event joins two of all the query ids 0, 20, 40, ... up to the largest.
_CALLS = "calls AS (SELECT (event_id % k) * 20 AS a, (user_id % k) * 20 AS b, k, event_id, user_id FROM events, (SELECT max(pos) // 20 + 1 AS k FROM fn))"


def calls(s, d):
    """(a, b, k, event_id, user_id): the calls between query functions, of which there are k."""
    k = fn(s, d).agg(F.floor(F.max("pos") / 20).cast("long") + 1).scalar()
    ev = table(s, d, "events").select("event_id", "user_id", k.alias("k"))
    return ev.select(((F.col("event_id") % F.col("k")) * 20).alias("a"), ((F.col("user_id") % F.col("k")) * 20).alias("b"), "k", "event_id", "user_id")


@query("j07_candidate_edge_admission", f"""WITH {CAND}, {_CALLS}, e AS (SELECT DISTINCT a AS qs, b AS qd, 'f' || (event_id % 40) AS fs, 'f' || (user_id % 40) AS fd FROM calls)
SELECT e.qs, e.qd, e.fs, e.fd FROM e WHERE qs <> qd AND EXISTS (SELECT 1 FROM cand c WHERE c.q = e.qs AND c.func = e.fs) AND EXISTS (SELECT 1 FROM cand c WHERE c.q = e.qd AND c.func = e.fd)""")
def j07(s, d):
    e = calls(s, d).select(F.col("a").alias("qs"), F.col("b").alias("qd"), F.concat(F.lit("f"), F.col("event_id") % 40).alias("fs"), F.concat(F.lit("f"), F.col("user_id") % 40).alias("fd"))
    c = cand(s, d).select("q", "func").distinct()
    e = e.filter("qs <> qd").distinct()
    return e.join(c.select(F.col("q").alias("qs"), F.col("func").alias("fs")), ["qs", "fs"], "left_semi").join(c.select(F.col("q").alias("qd"), F.col("func").alias("fd")), ["qd", "fd"], "left_semi").select("qs", "qd", "fs", "fd")


STR = """st AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents), pr AS (SELECT a.doc_id AS q, b.doc_id AS c FROM documents a JOIN documents b ON b.doc_id = a.doc_id // 2)"""


@query("j08_string_evidence", f"""WITH {STR}, n AS (SELECT doc_id, count(*) AS n FROM st GROUP BY doc_id), sh AS (SELECT pr.q, pr.c, count(*) AS shared FROM pr JOIN st x ON x.doc_id = pr.q JOIN st y ON y.doc_id = pr.c AND y.s = x.s GROUP BY pr.q, pr.c)
SELECT pr.q, pr.c, coalesce(shared, 0) AS shared, a.n + b.n - coalesce(shared, 0) AS differ, coalesce(shared, 0) - (a.n + b.n - coalesce(shared, 0)) AS exponent FROM pr JOIN n a ON a.doc_id = pr.q JOIN n b ON b.doc_id = pr.c LEFT JOIN sh ON sh.q = pr.q AND sh.c = pr.c""")
def j08(s, d):
    docs = table(s, d, "documents")
    st = docs.select("doc_id", F.array_distinct(F.split("text", "\n", -1)).alias("s"))
    q = st.select(F.col("doc_id").alias("q"), F.expr("doc_id div 2").alias("c"), F.col("s").alias("a"))
    return belief.string_evidence(q.join(st.select(F.col("doc_id").alias("c"), F.col("s").alias("b")), "c"))


# A small factor graph: query functions are variables, calls between them pair factors.
_FG = f"""{PRIOR}, opt AS (SELECT q AS v, row_number() OVER (PARTITION BY q ORDER BY func = 'None', func, lib) AS o, prior AS pr, func FROM prior),
{_CALLS}, pairs AS (SELECT DISTINCT a, b, k FROM calls WHERE a <> b),
f AS (SELECT p.a * 20 * p.k + p.b AS fid, p.a, p.b, x.o AS i, y.o AS j, CASE WHEN x.func <> 'None' AND y.func <> 'None' AND (CAST(substr(x.func, 2) AS INT) + CAST(substr(y.func, 2) AS INT)) % 3 = 0 THEN 0.9 ELSE 0.1 END AS pot FROM pairs p JOIN opt x ON x.v = p.a JOIN opt y ON y.v = p.b)"""


def _rounds_sql(n):
    parts = ["fr0 AS (SELECT DISTINCT fid, v, o, CAST(1 AS DOUBLE) AS m FROM (SELECT fid, a AS v, i AS o FROM f UNION ALL SELECT fid, b, j FROM f))"]
    for t in range(1, n + 1):
        parts.append(f"""bl{t} AS (SELECT v, o, sum(ln(m)) AS lm FROM fr{t - 1} GROUP BY v, o),
rf{t} AS (SELECT r.fid, r.v, r.o, exp(bl.lm - ln(r.m) + ln(p.pr)) AS m FROM fr{t - 1} r JOIN bl{t} bl ON bl.v = r.v AND bl.o = r.o JOIN opt p ON p.v = r.v AND p.o = r.o),
u{t} AS (SELECT f.fid, f.a AS v, f.i AS o, sum(f.pot * rf.m) AS m FROM f JOIN rf{t} rf ON rf.fid = f.fid AND rf.v = f.b AND rf.o = f.j GROUP BY 1, 2, 3 UNION ALL SELECT f.fid, f.b, f.j, sum(f.pot * rf.m) FROM f JOIN rf{t} rf ON rf.fid = f.fid AND rf.v = f.a AND rf.o = f.i GROUP BY 1, 2, 3),
fr{t} AS (SELECT fid, v, o, m / sum(m) OVER (PARTITION BY fid, v) AS m FROM u{t})""")
    parts.append(f"blf AS (SELECT p.v, p.o, p.func, p.pr * exp(coalesce(sum(ln(fr.m)), 0)) AS x FROM opt p LEFT JOIN fr{n} fr ON fr.v = p.v AND fr.o = p.o GROUP BY p.v, p.o, p.func, p.pr), marg AS (SELECT v, o, func, x / sum(x) OVER (PARTITION BY v) AS m FROM blf)")
    return ", ".join(parts)


def _factor_graph(s, d):
    p = belief.rank_prior(cand(s, d))
    w = Window.partitionBy("q").orderBy(F.col("func") == "None", "func", "lib")
    opt = p.select(F.col("q").alias("v"), F.row_number().over(w).cast("long").alias("o"), F.col("prior").alias("pr"), "func")
    opt = Scratch(s, "factors").put(opt, "options")  # read up to four times, and each would search all vectors again
    pairs = calls(s, d).filter("a <> b").select("a", "b", "k").distinct()
    x, y = opt.select(F.col("v").alias("a"), F.col("o").alias("i"), F.col("func").alias("fx")), opt.select(F.col("v").alias("b"), F.col("o").alias("j"), F.col("func").alias("fy"))
    num = lambda c: F.expr(f"try_cast(substr({c}, 2) as int)")
    hit = (F.col("fx") != "None") & (F.col("fy") != "None") & ((num("fx") + num("fy")) % 3 == 0)
    f = pairs.join(x, "a").join(y, "b").select((F.col("a") * 20 * F.col("k") + F.col("b")).alias("fid"), "a", "b", "i", "j", F.when(hit, 0.9).otherwise(0.1).alias("pot"))
    return opt, f


@query("i06_bp_marginals_2_rounds", f"WITH {_FG}, {_rounds_sql(2)} SELECT v, o, round(m, 6) AS m FROM marg")
def i06(s, d):
    opt, f = _factor_graph(s, d)
    return belief.propagate(opt, f, 2).select("v", "o", F.round("m", 6).alias("m"))


@query("w05_bp_argmax_with_ties", f"WITH {_FG}, {_rounds_sql(2)}, x AS (SELECT v, o, func, m, max(m) OVER (PARTITION BY v) AS top FROM marg) SELECT v, func FROM x WHERE abs(m - top) <= 1e-8 + 1e-5 * abs(top)")
def w05(s, d):
    opt, f = _factor_graph(s, d)
    x = belief.propagate(opt, f, 2).withColumn("top", F.max("m").over(Window.partitionBy("v")))
    return x.filter(close(F.col("m"), F.col("top"))).join(opt.select("v", "o", "func"), ["v", "o"]).select("v", "func")


@query("i07_max_exclusive", f"WITH {FN}, m AS (SELECT label AS fid, pos AS v, (pos % 10) / 10.0 AS m1 FROM fn), x AS (SELECT *, max(m1) OVER (PARTITION BY fid) AS top, row_number() OVER (PARTITION BY fid ORDER BY m1 DESC, v) AS rn, count(*) OVER (PARTITION BY fid) AS n FROM m) SELECT fid, v, CAST(CASE WHEN n = 1 THEN 0.4 WHEN top < 0.5 THEN 0.1 WHEN rn = 1 THEN 0.999 ELSE 0.001 END AS DOUBLE) AS m1 FROM x")
def i07(s, d):
    m = fn(s, d).select(F.col("label").alias("fid"), F.col("pos").alias("v"), ((F.col("pos") % 10) / 10.0).alias("m1"))
    return belief.max_exclusive(m)


@query("i08_best_joint_of_pairs", f"WITH {_FG}, j AS (SELECT f.fid, f.i, f.j, f.pot * x.pr * y.pr AS p FROM f JOIN opt x ON x.v = f.a AND x.o = f.i JOIN opt y ON y.v = f.b AND y.o = f.j) SELECT fid, i, j, round(p, 6) AS p FROM j QUALIFY row_number() OVER (PARTITION BY fid ORDER BY round(p, 9) DESC, i, j) = 1")
def i08(s, d):
    opt, f = _factor_graph(s, d)
    j = f.join(opt.select(F.col("v").alias("a"), F.col("o").alias("i"), F.col("pr").alias("pa")), ["a", "i"]).join(opt.select(F.col("v").alias("b"), F.col("o").alias("j"), F.col("pr").alias("pb")), ["b", "j"])
    w = Window.partitionBy("fid").orderBy(F.round("p", 9).desc(), "i", "j")
    return j.withColumn("p", F.col("pot") * F.col("pa") * F.col("pb")).withColumn("rk", F.row_number().over(w)).filter("rk = 1").select("fid", "i", "j", F.round("p", 6).alias("p"))


@query("j09_address_window_pairs", f"WITH {FN} SELECT a.pos AS i, b.pos AS j FROM fn a JOIN fn b ON a.pos < b.pos AND b.pos <= a.pos + 19 AND a.lib = b.lib WHERE a.pos < (SELECT count(*) FROM fn) - 20")
def j09(s, d):
    f = fn(s, d).select("pos", "lib")
    # The band becomes an equi join on exploded offsets.
    a = f.select("lib", F.col("pos").alias("i"), F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + 19)).alias("j"))
    n = f.agg((F.count("*") - 20).alias("n"))
    return a.join(f.select("lib", F.col("pos").alias("j")), ["lib", "j"]).join(F.broadcast(n), F.col("i") < F.col("n")).select("i", "j")


VOTE = f"{FN}, vt AS (SELECT pos // 25 AS comp, version, count(*) AS votes FROM fn GROUP BY 1, 2)"


@query("a04_version_vote_ties", f"WITH {VOTE} SELECT comp, version, votes FROM vt QUALIFY rank() OVER (PARTITION BY comp ORDER BY votes DESC) = 1")
def a04(s, d):
    v = fn(s, d).groupBy(F.expr("pos div 25").alias("comp"), "version").agg(F.count("*").alias("votes"))
    return v.withColumn("rk", F.rank().over(Window.partitionBy("comp").orderBy(F.col("votes").desc()))).filter("rk = 1").drop("rk")


@query("a05_global_version_vote", f"WITH {FN} SELECT version, count(*) AS votes, split_part(version, '-', 1) AS lib FROM fn GROUP BY version")
def a05(s, d):
    return fn(s, d).groupBy("version").agg(F.count("*").alias("votes")).withColumn("lib", F.split_part("version", F.lit("-"), F.lit(1)))


@query("j12_sure_contradiction", f"WITH {CAND}, sure AS (SELECT q, max(sim) AS top FROM cand GROUP BY q) SELECT c.q, c.func, c.lib FROM cand c JOIN sure USING (q) WHERE top <= 0.35 OR sim > 0.35")
def j12(s, d):
    c = cand(s, d)
    return c.withColumn("top", F.max("sim").over(Window.partitionBy("q"))).filter("top <= 0.35 or sim > 0.35").select("q", "func", "lib")


@query("f06_equal_distance", "WITH e AS (SELECT event_id % 100 AS k, user_id % 4 AS dist, event_id AS id FROM events) SELECT a.k, a.dist, count(*) AS n FROM e a JOIN e b ON a.k = b.k AND a.dist = b.dist AND a.id < b.id GROUP BY a.k, a.dist")
def f06(s, d):
    e = table(s, d, "events").select((F.col("event_id") % 100).alias("k"), (F.col("user_id") % 4).alias("dist"))
    return e.groupBy("k", "dist").agg(F.count("*").alias("c")).filter("c > 1").select("k", "dist", F.expr("c * (c - 1) div 2").alias("n"))


@query("j10_index_to_metadata", f"WITH {CAND} SELECT k.q, k.n, f.version FROM knn k JOIN fn f ON f.pos = k.n")
def j10(s, d):
    return neighbours(s, d).select("q", "n", "version")
