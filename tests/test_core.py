"""Operators of the identification pipeline on hand-made rows, and queries against SQL."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from braidscan.functions import fuzzy, hashes, vectors
from braidscan.operators import alike, belief, embed, graph, knn, walks
from braidscan.operators.components import connected_components
from braidscan.sources import graphs

SF = "/root/testdata/sf0.01"


def test_distances_are_symmetric_and_keep_the_triangle(spark):
    rng = random.Random(1)
    rows = [[[rng.gauss(0, 1) for _ in range(10)] for _ in range(3)] for _ in range(50)]
    df = spark.createDataFrame(rows, "x array<double>, y array<double>, z array<double>")
    for d in (vectors.euclidean, vectors.manhattan):
        x, y, z = F.col("x"), F.col("y"), F.col("z")
        bad = df.filter((F.abs(d(x, y) - d(y, x)) > 1e-12) | (d(x, z) > d(x, y) + d(y, z) + 1e-9))
        assert bad.count() == 0


def test_unit_keeps_zero_vectors(spark):
    out = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>").select(vectors.unit(F.col("v")).alias("u")).collect()
    assert [r.u for r in out] == [[0.0, 0.0], [0.6, 0.8]]


def test_hash_keys_repeat_and_have_one_character_a_plane(spark):
    df = spark.createDataFrame([([0.1 * i for i in range(8)],)], "v array<double>")
    keys = {df.select(hashes.binary_key(F.col("v"), hashes.normals(5, 10, 8)).alias("k")).first().k for _ in range(3)}
    assert len(keys) == 1 and len(keys.pop()) == 10


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000, j) for j in range(1001, 1100)] + [(7, 7), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(1000, 1100)} == {1000} and got[7] == 7 and 3 not in got


def test_contraction_adds_distances_and_stands_filtered_cycles(spark):
    e = spark.createDataFrame([("a", "s", 1), ("s", "t", 1), ("t", "s", 1), ("t", "b", 1), ("a", "b", 1), ("s", "s2", 1)], "src string, dst string, dist long")
    small = spark.createDataFrame([("s",), ("t",), ("s2",)], "name string")
    got = {tuple(r) for r in graph.contract(e, small, max_depth=4).collect()}
    assert ("a", "b", 1) in got and ("a", "b", 3) in got and all(x[0] == "a" and x[1] == "b" for x in got)


def test_rank_prior_puts_none_last_and_sums_to_one(spark):
    c = spark.createDataFrame([(1, "f", "l", 0.5), (1, "g", "l", 0.5), (1, "h", "l", 0.995)], "q long, func string, lib string, sim double")
    p = {r.func: r.prior for r in belief.rank_prior(c).collect()}
    assert abs(sum(p.values()) - 1) < 1e-12 and p["h"] == max(p.values()) and p["f"] < p["g"]


def test_string_evidence_counts_shared_as_differing_too(spark):
    df = spark.createDataFrame([(1, 2, ["a", "b"], ["b", "c"])], "q long, c long, a array<string>, b array<string>")
    assert belief.string_evidence(df).first()["exponent"] == 1 - 3 and belief.string_evidence(df, strict=True).first()["exponent"] == 1 - 2


def test_graph_readers(spark):
    dot = spark.createDataFrame([('digraph {',), ('  "a" -> "b";',), ("0 -> 203 [ x ]",), ('5 [label="n"]',)], "value string")
    assert {tuple(r) for r in graphs.parse_dot(dot).collect()} == {("a", "b"), ("0", "203")}
    gdl = spark.createDataFrame([('node: { title: "0" label: "f" }',), ('node: { title: "1" label: "g" }',), ('edge: { sourcename: "0" targetname: "1" }',)], "value string")
    assert [tuple(r) for r in graphs.parse_gdl(gdl).collect()] == [("f", "g")]
    truth = spark.createDataFrame([("[1, 2][3]",), ("[1,2,3,4,5][6]",)], "value string")
    assert {tuple(r) for r in graphs.parse_truth(truth).collect()} == {(1, 3), (2, 3)}


def test_stream_ingestion_matches_the_batch(spark, tmp_path):
    from braidscan.streaming.ingest import bucket_rows, store_stream

    df = spark.createDataFrame([(i, [float((i * 7 + k) % 5 - 2) for k in range(4)]) for i in range(20)], "id long, v array<double>")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    store_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), dim=4).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("hash_name", "bucket_key", "id")
    want = bucket_rows(df, dim=4).select("hash_name", "bucket_key", "id")
    assert got.exceptAll(want).count() == 0 and got.count() == 60


SAMPLE = ["knn_exact_10", "j01_lsh_neighbours_top10", "j14_permuted_beam", "j15_prefix_tree_probe", "i02_edge_contract", "a01_near_identical_groups", "w03_rank_softmax_prior", "i06_bp_marginals_2_rounds", "a23_rank_curve_auc", "f16_vocab_rank_encode"]


@pytest.mark.parametrize("name", SAMPLE)
@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    got = entry_points.queries()[name](spark, SF)
    rel = con.sql(entry_points.oracle_sql()[name])
    order = sorted(got.columns)
    assert sorted(rel.columns) == order
    plain = lambda v: round(float(v), 5) if isinstance(v, float) else v
    mine = sorted([tuple(plain(r[c]) for c in order) for r in got.collect()], key=repr)
    theirs = sorted([tuple(plain(dict(zip(rel.columns, r))[c]) for c in order) for r in rel.fetchall()], key=repr)
    assert mine == theirs


def test_rolling_hash_equals_the_byte_by_byte_form():
    data = random.Random(3).randbytes(500)
    window, h1, h2, h3, want = [0] * 7, 0, 0, 0, []
    for i, c in enumerate(data):
        h2 += 7 * c - h1
        h1 += c - window[i % 7]
        window[i % 7] = c
        h3 = ((h3 << 5) & 0xFFFFFFFF) ^ c
        want.append((h1 + h2 + h3) & 0xFFFFFFFF)
    assert fuzzy.rolling(np.frombuffer(data, np.uint8)).tolist() == want


def test_fuzzy_hashes_of_near_copies_are_alike():
    rng = random.Random(4)
    text = bytes(rng.choices(range(97, 123), k=20_000))
    near = text[:9000] + b"changed" + text[9000:]
    other = bytes(rng.choices(range(97, 123), k=20_000))
    a, b, c = map(fuzzy.fuzzy_hash, (text, near, other))
    assert fuzzy.likeness(a, a) == 100 and fuzzy.likeness(a, b) > 80 and fuzzy.likeness(a, c) == 0
    assert fuzzy.fuzzy_hash(b"").startswith("3:")


def test_embedding_equals_dense_messages():
    x, w = np.random.default_rng(5).normal(size=(4, 3)), embed.weights(3)
    n = np.zeros((4, 4))
    for i in range(3):
        n[i, i + 1] = n[i + 1, i] = 1
    mu = np.zeros((4, embed.WIDTH))
    for _ in range(embed.ROUNDS):
        mu = np.tanh(x @ w[0] + np.maximum(np.maximum(n @ mu @ w[1], 0) @ w[2], 0))
    assert np.allclose(embed.embed(x, np.arange(3), np.arange(1, 4), w), mu.sum(0) @ w[3])


def test_signed_walk_keeps_its_mass_without_dead_ends(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", -1), ("c", "a", 1)], "i string, j string, sign int")
    got = {r.node: r for r in walks.signed_walk(edges, spark.createDataFrame([("a",)], "node string"), 12).collect()}
    assert abs(sum(r.plus + r.minus for r in got.values()) - 1) < 1e-9 and got["b"].plus > got["b"].minus and got["c"].minus > got["c"].plus


@pytest.mark.parametrize("measure", ["euclid", "manhattan", "cosine"])
def test_blocked_distances_equal_brute_force_with_ties_and_own_rows(spark, measure):
    rng = random.Random(6)
    rows = [(i, [float(rng.randint(0, 2)) for _ in range(3)]) for i in range(60)]
    q = spark.createDataFrame(rows[::20], "q long, v array<double>")
    got = {(r.q, r.rk): (r.n, r.dist) for r in knn.nearest_by(q, spark.createDataFrame(rows, "n long, v array<double>"), 4, measure).collect()}
    dist = {"euclid": lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5, "manhattan": lambda a, b: sum(abs(x - y) for x, y in zip(a, b)), "cosine": lambda a, b: 1 - sum(x * y for x, y in zip(a, b))}[measure]
    for i, v in rows[::20]:
        best = sorted((round(dist(v, w), 6), j) for j, w in rows if j != i)[:4]
        assert [got[i, k + 1] for k in range(4)] == [(j, x) for x, j in best]


def test_reachability_and_contraction_have_no_silent_bound(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1) for i in range(48)], "src string, dst string, dist long")
    got = graph.reachable(chain).filter("src = 'n0'")
    assert got.count() == 48 and got.agg(F.max("depth")).first()[0] == 48
    with pytest.raises(RuntimeError):
        graph.reachable(chain, max_rounds=20)
    small = spark.createDataFrame([(f"n{i}",) for i in range(1, 40)], "name string")
    bridged = {tuple(r) for r in graph.contract(chain, small).collect()}
    assert ("n0", "n40", 40) in bridged and len(bridged) == 9


def test_stride_sample_of_an_almost_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([(i, [1.0] * 64, 0) for i in range(20)], "vec_id long, embedding array<float>, label int")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert entry_points.queries()["w12_stride_sample"](spark, str(tmp_path)).count() == 0


def _chains(spark, folder):
    """Vectors of 64 components in chains: neighbours are alike, vectors two apart are not; some are copies."""
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(40):
        a, b = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
        rows += [np.cos(0.004 * k) * a + np.sin(0.004 * k) * b for k in range(5)]
    rows += rows[:20]
    order = rng.permutation(len(rows))
    table = [(i, rows[at].tolist(), int(at) % 5) for i, at in enumerate(order)]
    spark.createDataFrame(table, "vec_id long, embedding array<double>, label int").write.parquet(f"{folder}/embeddings.parquet")


def _same_as_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(folder):
        con.sql(f"create view {t.split('.')[0]} as select * from '{folder}/{t}/*.parquet'")
    got = entry_points.queries()[name](spark, str(folder))
    rel = con.sql(entry_points.oracle_sql()[name])
    order = sorted(got.columns)
    assert sorted(rel.columns) == order
    return sorted([tuple(r[c] for c in order) for r in got.collect()]) == sorted(tuple(dict(zip(rel.columns, r))[c] for c in order) for r in rel.fetchall())


def test_groups_are_by_the_smallest_alike_id_and_not_by_chains(spark, tmp_path):
    _chains(spark, tmp_path)
    assert _same_as_sql(spark, tmp_path, "a01_near_identical_groups")


def test_smallest_alike_equals_brute_force_however_sets_are_halved(monkeypatch):
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(60, 6)), 10, axis=0)
    x[300:] += rng.normal(scale=0.002, size=(300, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] = np.nan
    ids, ask = rng.permutation(600), rng.random(600) < 0.8
    hit = x @ x.T > 0.99999
    want = [min([ids[i], *ids[hit[i]]]) if ask[i] else ids[i] for i in range(600)]
    for pairs in (1 << 21, 500, 20):
        monkeypatch.setattr(alike, "PAIRS", pairs)
        assert alike.smallest_alike(ids, x, ask, 0.99999).tolist() == want


def _hub(spark, leaves):
    """A variable of two options with so many factors that products of their messages underflow, and its exact marginals."""
    prior = {v: (0.5, 0.5) if v == 0 else ((0.6, 0.4), (0.4, 0.6), (0.61, 0.39))[v % 3] for v in range(leaves + 1)}
    pot = lambda i, j: 0.6 if i == j else 0.4
    opt = spark.createDataFrame([(v, o, p, f"f{o}") for v, both in prior.items() for o, p in zip((1, 2), both)], "v long, o long, pr double, func string")
    f = spark.createDataFrame([(v, 0, v, i, j, pot(i, j)) for v in range(1, leaves + 1) for i in (1, 2) for j in (1, 2)], "fid long, a long, b long, i long, j long, pot double")
    part = {v: np.log([sum(pot(i, j) * prior[v][j - 1] for j in (1, 2)) for i in (1, 2)]) for v in range(1, leaves + 1)}
    whole = np.log(prior[0]) + sum(part.values())
    shift = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    want = {0: shift(whole)}
    for v in range(1, leaves + 1):
        rest = shift(whole - part[v])
        want[v] = shift(np.log([prior[v][j - 1] * sum(pot(i, j) * rest[i - 1] for i in (1, 2)) for j in (1, 2)]))
    return opt, f, want


def test_belief_propagation_of_many_factors_does_not_underflow(spark):
    opt, f, want = _hub(spark, 1500)
    got = {(r.v, r.o): r.m for r in belief.propagate(opt.drop("func"), f, 2).collect()}
    assert len(got) == 3002 and all(abs(got[v, o] - m[o - 1]) < 1e-9 for v, m in want.items() for o in (1, 2))


def test_belief_propagation_takes_zeros_out_of_products_again(spark):
    opt = spark.createDataFrame([(v, o, p) for v, both in enumerate([(0.5, 0.5), (0.9, 0.1), (0.3, 0.7), (1.0, 0.0)]) for o, p in zip((1, 2), both)], "v long, o long, pr double")
    f = spark.createDataFrame([(b, 0, b, i, j, float(i == j)) for b in (1, 2, 3) for i in (1, 2) for j in (1, 2)], "fid long, a long, b long, i long, j long, pot double")
    got = {(r.v, r.o): r.m for r in belief.propagate(opt.filter("v < 3"), f.filter("b < 3"), 2).collect()}
    assert abs(got[0, 1] - 0.27 / 0.34) < 1e-9 and abs(got[1, 2] - 0.07 / 0.34) < 1e-9
    assert {r.v: r.m for r in belief.propagate(opt, f, 2).filter("o = 1").collect()} == {v: 1.0 for v in range(4)}


def test_best_options_of_a_variable_of_many_factors(spark, monkeypatch):
    from braidscan.plans import q_infer

    opt, f, want = _hub(spark, 1200)
    monkeypatch.setattr(q_infer, "_factor_graph", lambda s, d: (opt, f))
    got = sorted((r.v, r.func) for r in q_infer.w05(spark, "").collect())
    assert got == sorted((v, f"f{o}") for v, m in want.items() for o in (1, 2) if abs(m[o - 1] - m.max()) <= 1e-8 + 1e-5 * m.max())


def test_ungrouping_returns_every_member_without_gathering_a_group(spark, tmp_path):
    _chains(spark, tmp_path)
    assert _same_as_sql(spark, tmp_path, "a02_ungroup")
    plan = entry_points.queries()["a02_ungroup"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_word_vectors_learn_in_several_tasks_and_pass_null_texts(spark, tmp_path, monkeypatch):
    from pyspark.ml.feature import Word2Vec

    from braidscan.plans import q_text

    tasks, fit = [], Word2Vec.fit
    monkeypatch.setattr(Word2Vec, "fit", lambda self, *a: tasks.append(self.getNumPartitions()) or fit(self, *a))
    monkeypatch.setattr(q_text, "PASS_WORDS", 1000, raising=False)
    rng = random.Random(10)
    texts = [" ".join(rng.choices(["a", "B", "b", "c", f"rare{i}"], k=40)) for i in range(80)]
    spark.createDataFrame([*enumerate(texts), (80, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.word: r.vector for r in q_text.m04(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b", "c"} and len(set(got.values())) == 3 and tasks == [4]


def test_neighbour_search_holds_few_values_at_a_time(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(4)
    v, kept = rng.integers(-3, 4, (10000, 4)).astype(float), []  # many ties
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "n long, v array<double>")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: kept.append(run) or spark.createDataFrame([], schema))
    knn.exact_topk(df.filter("n < 3000").withColumnRenamed("n", "q"), df, 5, skip_own=True)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10000)), pa.array(v.tolist())], ["n", "v"])
    tracemalloc.start()
    got = pa.Table.from_batches(kept[0](iter([batch]))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    best = {}
    for r in got:
        best.setdefault(r["q"], []).append((-r["x"], r["n"]))
    for q in range(0, 3000, 100):
        assert sorted(best[q])[:5] == sorted((-x, n) for n, x in enumerate(v @ v[q]) if n != q)[:5]
    assert len(best) == 3000 and peak < 200


def test_factor_graph_searches_its_vectors_once(spark):
    from braidscan.plans import q_infer

    opt, f = q_infer._factor_graph(spark, SF)
    assert not any("MapInArrow" in x._jdf.queryExecution().optimizedPlan().toString() for x in (opt, f))
