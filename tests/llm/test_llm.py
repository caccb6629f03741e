"""The ten operators and the pipeline on small fixtures, against brute force."""

import collections
import hashlib
import math
import os
import struct
import zlib

import numpy as np
import pytest

import corpus_pipeline
from braidscan.llm import bpe, decontam, langid, line_dedup, lm, ngram_join, pseudonyms, quality, topk, urlfilter, wordhash
from braidscan.llm.registry import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, text2 string"
LONG = "word " * 30_000


def docs_of(spark, texts):
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


EDGE = [None, "", " ", "\n\n", "one", "a b c d e f g h", "a b c d e f g h", LONG, "é\x1c\x85 ½ <|endoftext|> Σ"]


def test_line_dedup(spark):
    line = "This line is long enough."
    texts = [line + "\nown first line of this text", " " + line.upper() + "\t", line + "\n" + line, None, "", "short\nshort"]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert [got[i].n_dropped for i in range(6)] == [1, 1, 0, 0, 0, 0]
    assert got[0].kept_text == "own first line of this text" and got[2].kept_text == texts[2] and got[3].kept_text == ""
    assert [got[i].n_lines for i in range(6)] == [2, 1, 2, 1, 1, 2]


def test_pseudonyms_link_and_stay_valid(spark):
    names = pseudonyms.Pseudonyms(b"k")
    for kind, text, valid in (("card", "4111 1111 1111 1111", lambda t: pseudonyms.luhn_valid(t.replace(" ", ""))), ("iban", "GB82 WEST 1234 5698 7654 32", lambda t: pseudonyms.iban_valid(t.replace(" ", ""))), ("date", "2024-02-29", lambda t: len(t) == 10), ("ip", "10.2.3.4", lambda t: all(0 <= int(x) < 256 for x in t.split(".")))):
        out, counts = names.rewrite(f"x {text} y {text}")
        new = out[2 : 2 + len(out) // 2 - 2].rstrip(" y")
        assert counts == {kind: 2} and text not in out and valid(out[2:].split(" y ")[0]), (kind, out, new)
    assert names.rewrite("no 4111111111111112 here")[1] == {} and names.rewrite("31.02.2024")[1] == {}
    p = pseudonyms.Permutation(b"k")
    assert sorted(p(i, 500, "t") for i in range(500)) == list(range(500))
    got = pseudonyms.pseudonymise(docs_of(spark, EDGE)).collect()
    assert len(got) == len(EDGE) and got[0].text is None and sum(r.n_replaced for r in got) == 0


def test_bpe_equals_the_library_and_streams():
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    own, lib = bpe.load(path), Tokenizer.from_file(path)
    texts = [t or "" for t in EDGE] + ["a" * 9000, "abne" * 4000 + "!?" * 700, "<|startoftext|>don't I'LL 12"]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert own.decode(ids) == text
        assert own.digests(t) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert own.decode(own.encode("où élan"), spaced=False) == "où élan "


def test_lookahead_settles_tokens():
    merges = [("a", "b"), ("b", "c"), ("ab", "c"), ("c", "ab")]
    table = bpe.MergeTable(merges, {c: i for i, c in enumerate(["a", "b", "c", "ab", "bc", "abc", "cab"])})
    rng = np.random.default_rng(3)
    for _ in range(300):
        w = "".join(rng.choice(list("abc"), 30))
        whole = table.merged(list(w))
        part = table.merged(list(w[:20]))
        done = 0
        for x, y in zip(part, whole):
            done += len(x)
            if done > 20 - table.lookahead:
                break
            assert x == y


def test_language_model(spark):
    texts = EDGE + [f"the cat sat on mat {i % 3} end" for i in range(40)]
    got = {r.doc_id: r for r in lm.score_documents(docs_of(spark, texts)).collect()}
    words = {i: (t or "").encode().lower().split() + [b""] for i, t in enumerate(texts)}
    c = collections.Counter()
    for i, w in words.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(w)
    n, v = sum(c.values()), len(c)
    for i, w in words.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9) and r.score < 0
    assert sum(got[i].score for i in got) > sum(got[i].base_score for i in got)


def test_url_rules_and_segmentation(spark):
    urls = ["http://A.example.COM/en/7?x", "http://b.com/en/1", "http://x.example.net/de/89", "nohost", None, "http://casinobet.example.org/fr/1#t", "http://xcom/en/"] + ["http://thecat.example.org/fr/1"] * 5
    urls += ["http://casinobet.a.com/en/1"] * 6 + ["http://thecat.example.com/en/7"] * 6
    pages = spark.createDataFrame([(i, u, "<p>the cat win casino bet the cat</p>" if i else None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    rows = urlfilter.judge(pages).collect()
    got = {r.page_id: r for r in rows}
    assert [got[i].rule for i in range(7)] == ["example.com/en/7", "com/en/", "example.net/de/8", None, None, None, None]
    assert [got[i].verdict for i in (0, 1, 2)] == ["allow", "block", "block"] and (got[4].host, got[4].path) == ("", "")
    # What the rules decided about hosts with the same words decides about the others.
    assert got[5].verdict == "block" and got[7].verdict == "allow" and got[0].path == "/en/7" and got[0].host == "a.example.com"
    assert len(rows) == len(urls)


def test_every_url_rule_gives_the_verdict_of_the_contract(spark):
    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert {text: what for what, text in urlfilter.RULES} == {text: what for what, text in (r.split() for r in contract.split(", "))}
    want = {
        "http://com/en/1": ("com/en/", "block"), "http://sub.example.com/en/75": ("example.com/en/7", "allow"),
        "http://net/de/": ("net/de/", "allow"), "http://other.NET/de/8": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"),
        "http://example.net/de/8": ("example.net/de/8", "block"), "http://sub.org/es/1": ("org/es/", "block"),
    }
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(want)], "page_id long, url string, html string")
    assert [(r.rule, r.verdict) for r in urlfilter.judge(pages).orderBy("page_id").collect()] == list(want.values())


def test_naive_bayes_over_segmented_urls_equals_brute_force(spark):
    import itertools

    words = {"red": 30, "redo": 4, "do": 9, "or": 8, "door": 12, "x": 2}
    total = sum(words.values()) + 1
    for name in ("redoor", "redodoor", "xx", "zredz"):
        ways = []
        for cuts in itertools.product((0, 1), repeat=len(name) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(name)]
            parts = [name[a:z] for a, z in zip(at, at[1:])]
            ways.append((sum(math.log(words[w] / total) if w in words else math.log(1 / total) - 1 - 3.0 * len(w) for w in parts), parts))
        assert math.isclose(max(w[0] for w in ways), next(w[0] for w in ways if w[1] == urlfilter.split(name, words, total)))
    hosts = ["redoor.com/en/1", "redoor.com/en/22", "door.example.com/en/7", "red.example.com/en/75", "redoor.org/fr/1", "x.net/de/4"]
    html = " ".join(w for w, n in words.items() for _ in range(n))
    pages = [(i, f"http://{h}", html if i == 0 else "") for i, h in enumerate(hosts * 6)]
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    counts = total + 0

    def said(url):
        host, _, path = url.partition("/")
        out = [f"h:{w}" for label in host.split(".") for w in urlfilter.split(label, words, counts)]
        return out + [f"p:{t[0]}#{len(t)}" if t.isdigit() else f"p:{t}" for t in path.split("/")]

    bad, good, n = collections.Counter(), collections.Counter(), [0, 0]
    for i, (_, u, _) in enumerate(pages):
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 2)
        if r.rule and not r.held_out:
            n[r.verdict == "block"] += 1
            (bad if r.verdict == "block" else good).update(said(u[7:]))
    v = len(bad | good)
    for i, (_, u, _) in enumerate(pages):
        want = math.log((n[1] + 1) / (n[0] + 1))
        for t in said(u[7:]):
            if t in bad or t in good:
                want += math.log((bad[t] + 1) / (sum(bad.values()) + v + 1)) - math.log((good[t] + 1) / (sum(good.values()) + v + 1))
        assert math.isclose(got[i].log_odds, want, rel_tol=1e-9)


def test_decontamination_finds_edits(spark):
    item = " ".join(f"w{i}" for i in range(25))
    near = " ".join("zz" if i in (3, 11) else f"w{i}" for i in range(25) if i != 17)
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short")], "item_id long, text string")
    texts = ["x y " + item.upper() + " z", "pre " + near + " post", " ".join(f"q{i}" for i in range(50)), item[:40], *EDGE]
    got = {(r.doc_id, r.item_id): r.edits for r in decontam.contaminated(docs_of(spark, texts), bench).collect()}
    assert got == {(0, 1): 0, (1, 1): 3}
    assert decontam.contaminated(docs_of(spark, texts), bench.filter("false")).count() == 0


def test_language_id(spark):
    texts = ["the cat and the dog are here with them"] * 9 + ["der hund und die katze sind hier bei uns"] * 9 + [None, "", "12 34"]
    rows = [(i, t, None if t is None else ("en" if i < 9 else "de")) for i, t in enumerate(texts)]
    got = langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)] == ["en"] * 9 + ["de"] * 9 + ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 60, 60)) for _ in range(12)]
    texts = list(EDGE)
    for b in base:
        for _ in range(12):
            w = b.split()
            for at in rng.integers(0, 60, int(rng.integers(0, 3))):
                w[at] = f"n{rng.integers(0, 10**6)}"
            texts.append(" ".join(w))
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(docs_of(spark, texts)).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    vecs = [[float(x) for x in rng.normal(size=6)] for _ in range(400)] + [[0.5] * 6] * 20
    rows = list(enumerate(vecs)) + [(1000, None), (1050, [float("nan")] * 6), (1100, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    got = [tuple(r) for r in topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()]
    q = np.floor(256 * np.array(vecs, np.float32).astype(float)).astype(int)
    want = []
    for i in range(0, 420, 50):
        order = sorted((-int(q[i] @ q[j]), j) for j in range(420) if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(order)]
    assert sorted(got) == want


def test_quality(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    texts = [" ".join(word() for _ in range(80)) + "." if i % 2 else " ".join([word() + "$$$"] * 40) for i in range(80)] + EDGE
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(81, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_documents(docs_of(spark, texts), labels).collect()}
    assert len(got) == len(texts) and all(got[i].predicted == i % 2 for i in range(80)) and all(0 <= r.score <= 1 for r in got.values())
    assert quality.score_documents(docs_of(spark, texts), labels.filter("false")).filter("score <> 0.5").count() == 0


def test_empty_tables(spark):
    empty = docs_of(spark, ["x"]).filter("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert line_dedup.dedup_lines(empty).count() == 0
    assert pseudonyms.pseudonymise(empty).count() == 0 and langid.predict(empty).count() == 0
    assert ngram_join.jaccard_groups(empty).count() == 0 and quality.score_documents(empty, labels).count() == 0
    assert lm.score_documents(empty).count() == 0
    assert topk.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline_stages_keep_the_columns(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = out
    ids = {r.doc_id for r in docs.collect()}
    assert ids == {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}


@pytest.mark.parametrize("kind", ["replaced", "dropped", "added"])
def test_decontamination_meets_passages_at_the_edit_limit(kind):
    """Random edits up to the limit, in items of several lengths: recall of the sampling must reach 0.95."""
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [list(rng.choice(vocabulary, n)) for n in rng.integers(12, 60, 60)]
    index = decontam.ItemIndex(list(range(60)), [" ".join(w).encode() for w in items])
    met = 0
    for i, words in enumerate(items):
        edited = list(words)
        for k, p in enumerate(sorted(rng.choice(len(words), len(words) * decontam.EDITS_PERCENT // 100, replace=False), reverse=True)):
            edited[p : p + (kind != "added")] = [] if kind == "dropped" else [f"x{k}"]
        text = " ".join([*rng.choice(vocabulary, 50), *edited, *rng.choice(vocabulary, 50)])
        met += i in {m[0] for m in index.matches(wordhash.words([text.encode()])[0])}
    assert met >= 57


#: Names the operators use inside, or return, as further columns of documents.
CLASHING = ["_doc", "_body", "row", "body", "pos", "h1", "n_lines", "n_dropped", "kept_text", "score", "stats", "component_id", "n_shingles", "n_tokens", "word", "item_id", "a.b"]


def clashing_docs(spark):
    """Rows with nulls in every column, a repeated row, and extra columns with names the operators use."""
    line = "A line that is long enough to count"
    texts = [line, line, line, line, None, "", "a b c d e", None, "the cat sat on the mat " * 9]
    ids = [1, 2, 3, 3, 4, 5, None, None, 6]
    rows = [(i, t, None if k % 3 == 0 else "en", None, None, *[f"x{k}"] * len(CLASHING)) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))


def test_nulls_repeats_and_clashing_columns(spark):
    docs = clashing_docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1), (6, None, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(None, "a b c d e"), (7, None), (8, ""), (9, "a b c d e"), (9, "a b c d e")], "item_id long, text string")
    kept = line_dedup.dedup_lines(docs).select("doc_id", "n_dropped", "_doc").collect()
    assert len(kept) == 9 and sorted(r.n_dropped for r in kept if r.doc_id in (1, 2, 3)) == [0, 0, 1, 1]
    for rows in (pseudonyms.pseudonymise(docs), langid.predict(docs), lm.score_documents(docs), quality.score_documents(docs, labels)):
        assert rows.count() == 9
    assert bpe.tokenize(docs, tokenizer_file("word_bpe_49k.json")).count() == 9
    groups = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(docs).collect())
    assert [g[0] for g in groups] == [1, 2, 3, 3, 4, 5, 6] and [g[2] for g in groups] == [1, 1, 1, 1, 4, 5, 6]
    assert [(r.doc_id, r.item_id, r.edits) for r in decontam.contaminated(docs.fillna({"doc_id": 70}), bench).collect()] == [(70, 9, 0)]
    for what, stage in corpus_pipeline.STAGES[1:-1]:
        # The stages read their tables themselves; these three need only documents and the benchmark.
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns, what


def test_rewritten_texts_keep_all_other_columns(spark):
    docs = clashing_docs(spark)
    got = sorted(line_dedup.rewrite_texts(docs).collect(), key=lambda r: r.row)
    assert [r.text for r in got] == ["", "", *[r.text for r in sorted(docs.collect(), key=lambda r: r.row)][2:]]
    assert all(r[c] == r.row for r in got for c in CLASHING) and [r.n_chars for r in got[:3]] == [0, 0, 35]


def test_a_very_long_text_does_not_widen_the_other_lanes():
    """Scores are the same whether a long text travels alone or with others, and memory follows the tokens."""
    import tracemalloc

    rng = np.random.default_rng(2)
    docs = [rng.integers(0, lm.MODEL_WORDS, n).astype(np.int32) for n in [20_000, *[30] * 300]]
    net = lm.Gru()
    tracemalloc.start()
    together = net.run(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000
    assert np.allclose(together, np.concatenate([net.run([d]) for d in (docs[0], docs[1])] + [net.run(docs[2:])]), rtol=1e-4)
    assert net.run([]).shape == (0,)


def test_pages_with_nulls_and_clashing_columns(spark):
    pages = spark.createDataFrame([(None, None, None, "x", "y"), (1, "http://a.b/", None, "x", "y"), (1, "http://a.b/", None, "x", "y")], "page_id long, url string, html string, host string, verdict string")
    got = urlfilter.judge(pages).collect()
    assert sorted((r.page_id or 0, r.host) for r in got) == [(0, ""), (1, "a.b"), (1, "a.b")]
    assert urlfilter.judge(pages.filter("false")).count() == 0


def test_the_network_predicts_the_thousand_most_frequent_words():
    """Words far down the list are predicted themselves, not by their shape."""
    words = [f"word{i}" for i in range(1200)]
    lexicon = lm.Lexicon([("", 5000)] + [(w, 4000 - i) for i, w in enumerate(words)], 1_000_000, 1201, {})
    ids = lexicon.read(" ".join(words).encode())[0]
    assert ids[:1023].tolist() == list(range(1, 1024)) and ids[1023:-1].min() >= lm.MODEL_WORDS and ids[-1] == 0
    net = lm.Gru()
    assert net.w["uw"].shape == (1024, 20) and net.w["wh"].shape == (20, 60)


@pytest.mark.parametrize("text, kind, kept", [
    ("4111 1111 1111 1111 123", "card", " 123"), ("12 4111 1111 1111 1111", "card", "12 "), ("order 2024 4111-1111-1111-1111", "card", "order 2024 "),
    ("AT61 1904 3002 3457 3201 EUR", "iban", " EUR"), ("BE68 5390 0754 7034 THIS", "iban", " THIS"), ("XY12 GB82 WEST 1234 5698 7654 32", "iban", "XY12 "),
    ("call 555 123 4567 now", "phone", " now"), ("+44 20 7946 0958", "phone", "+44 "), ("+353 1 234 5678", "phone", "+353 "),
])
def test_findings_beside_other_numbers_and_words(text, kind, kept):
    names = pseudonyms.Pseudonyms(b"k")
    out, counts = names.rewrite(text)
    assert counts == {kind: 1} and kept in out and len(out) == len(text) and out != text
    body = out.replace(kept, "", 1)
    if kind == "card":
        assert pseudonyms.luhn_valid("".join(c for c in body if c.isdigit()))
    if kind == "iban":
        assert pseudonyms.iban_valid(body.replace(" ", ""))


def test_rows_of_digits_are_no_cards_and_layouts_agree():
    names = pseudonyms.Pseudonyms(b"k")
    assert names.rewrite("2 " + "0 " * 30)[1] == {} and names.rewrite("4111 1111 1111 1112")[1] == {}
    assert names.rewrite("+442079460958")[0].replace(" ", "") == names.rewrite("+44 20 7946 0958")[0].replace(" ", "")


def test_a_check_covers_all_that_a_window_can_mean(monkeypatch):
    """An item met only through a window far before it is found with all its added words."""
    item = [f"w{i}" for i in range(25)]
    index = decontam.ItemIndex([1], [" ".join(item).encode()])
    e = index.edits[0]
    text = [f"x{i}" for i in range(40)] + item[:8] + [f"new{i}" for i in range(e)] + item[8:] + [f"y{i}" for i in range(40)]
    for start in (40 - e, 40, 40 + e):
        monkeypatch.setattr(index, "candidates", lambda words, start=start: (np.array([0]), np.array([start])))
        assert [(i, k) for i, k, _, _ in index.matches(wordhash.words([" ".join(text).encode()])[0])] == [(1, e)]


def test_decontamination_reaches_the_recall_of_exact_search():
    """Against the least edit distance over all windows of a whole table: nothing false, recall of 0.9 or more."""
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    import pyarrow.parquet as pq

    texts = [(t or "").encode() for t in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()]
    bench = pq.read_table(f"{sf}/benchmark.parquet")
    index = decontam.ItemIndex(bench["item_id"].to_pylist(), [t.encode() for t in bench["text"].to_pylist()])
    h, bounds = wordhash.words(texts)
    got = {(j, item): edits for j, item, edits, _, _ in index.search(h, bounds)}
    want = {}
    for (item, w), e in zip(index.items, index.edits):
        for j, (a, z) in enumerate(zip(bounds[:-1], bounds[1:])):
            edits = decontam.best_stretch(w, h[a:z])[0]
            if edits <= e:
                want[j, item] = edits
    assert want and set(got.items()) <= set(want.items()) and len(got) >= 0.9 * len(want)


def test_walks_go_on_over_slices_and_very_long_texts(monkeypatch):
    monkeypatch.setattr(decontam, "SLICE", 64)
    item = [f"w{i}" for i in range(30)]
    index = decontam.ItemIndex([5], [" ".join(item).encode()])
    for before in (0, 50, 63, 64, 100):
        text = " ".join([f"x{i}" for i in range(before)] + item + ["end"] * 3000)
        assert list(index.matches(wordhash.words([text.encode()])[0])) == [(5, 0, before, 30)]


def test_the_text_machine_holds_split_characters_back():
    own = bpe.load(tokenizer_file("word_bpe_49k.json"))
    ids = own.encode("zażółć 漢字 🙂")
    machine, parts = own.machine(spaced=False), []
    for i in ids:  # one id at a time: bytes of one character may lie in several
        parts.append(machine.push([i]))
    assert "".join(parts) + machine.close() == own.decode(ids, spaced=False) == "zażółć 漢字 🙂 "
    spaced = own.machine()
    assert "".join(spaced.push([i]) for i in ids) + spaced.close() == own.decode(ids)


def test_topk_counts_repeated_rows_and_takes_very_large_components(spark):
    """Against whole numbers of any size; extra columns clash, lengths differ, rows repeat and share ids."""
    rng = np.random.default_rng(8)
    vecs = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(120)]
    vecs += [(7, vecs[7][1]), (7, vecs[7][1]), (7, [0.25, 0.5, 1.0]), (50, [1.0, 1.0, 1.0]), (300, [1e16, 1.0, 0.0]), (301, [-3e200, 5.0, 1.0]), (302, [1e307, 1e307, 1e307]), (350, [1e16, -1e16, 2.0]), (400, [])]
    vecs += [(i, [float(i), -1.0]) for i in range(500, 700, 25)]
    rows = [(i, v, "x", 1, 2.0) for i, v in vecs]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row string, score int, dist double")
    got = [tuple(r) for r in topk.nearest(table).collect()]
    held = [(i, list(map(topk.whole, v))) for i, v in vecs if v]
    want = []
    for q in sorted({i for i, _ in held if i % 50 == 0}):
        v = next(v for i, v in held if i == q)
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in held if i != q and len(w) == len(v))[:5]
        want += [(q, k + 1, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(best)]
    assert sorted(got) == want


def test_topk_reads_whole_index_when_rows_are_equal(spark, monkeypatch):
    """Small rings and blocks: most rows are one vector, ids break the ties."""
    monkeypatch.setattr(topk, "RING_ROWS", 32)
    monkeypatch.setattr(topk, "BLOCK", 3)
    rng = np.random.default_rng(9)
    vecs = [[0.5] * 4 if i % 3 else [float(x) for x in rng.normal(size=4)] for i in range(600)]
    got = sorted(tuple(r) for r in topk.nearest(spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<double>")).collect())
    q = np.floor(256 * np.array(vecs)).astype(int)
    want = []
    for i in range(0, 600, 50):
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(sorted((-int(q[i] @ q[j]), j) for j in range(600) if j != i)[:5])]
    assert got == want


def test_language_sets_grow_as_far_as_they_pay(spark):
    """A text in four languages is given all four; a text in one language only that; as many languages as there are labels."""
    rng = np.random.default_rng(4)
    letters = ["abcdef", "ghijkl", "mnopqr", "stuvwx", "yzabgm"]
    words = [["".join(rng.choice(list(a), 5)) for _ in range(40)] for a in letters]
    text = lambda k, n: " ".join(rng.choice(words[k], n))
    rows = [(i, text(i % 5, 60), f"l{i % 5}") for i in range(60)] + [(100, " ".join(text(k, 200) for k in (0, 1, 2, 3)), None), (101, text(4, 300), None)]
    rows += [(1000 + i, f"{'xyz'[i % 3]}{i} word", f"rare{i}") for i in range(600)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).filter("doc_id in (100, 101)").collect()}
    assert {s.lang for s in got[100].shares if s.share > 0.1} == {"l0", "l1", "l2", "l3"} and got[101].lang_pred == "l4" and got[101].score > 0.9


def test_estimation_finds_the_proportions_that_a_fine_search_finds():
    rng = np.random.default_rng(5)
    probs = rng.dirichlet(np.ones(40), 2)
    counts = rng.multinomial(4000, 0.3 * probs[0] + 0.7 * probs[1])[None].astype(float)
    grid = np.linspace(0.001, 0.999, 999)
    best = grid[np.argmax([(counts[0] * np.log(a * probs[0] + (1 - a) * probs[1])).sum() for a in grid])]
    assert abs(langid.estimate(counts, probs, np.full((1, 2), 0.5))[0, 0] - best) < 0.02


@pytest.mark.parametrize("text, kind", [
    ("born 1899-05-01", "date"), ("due 2100-01-02", "date"), ("on 31.12.0099", "date"), ("password=секретный", "secret"), ("token: p!$$+w0rd", "secret"),
    ("ssn 123-45-6789", "ssn"), ("mail ann@example.org", "email"), ("call (212) 555-0123", "phone"), ("at 240.1.2.3", "ip"),
])
def test_every_kind_is_replaced_alike_and_keeps_its_format(text, kind):
    names = pseudonyms.Pseudonyms(b"k")
    body = text.split(" ", 1)[1] if kind != "secret" else text
    out, counts = names.rewrite(f"{text} and {body}")
    new = out.split(" and ")[1]
    assert counts == {kind: 2} and new != body and out.split(" and ")[0].endswith(new) and (kind == "ip" or len(new) == len(body))
    assert names.rewrite(new)[1] == {kind: 1}  # still valid


def test_addresses_stay_apart_and_mails_link_without_case():
    names = pseudonyms.Pseudonyms(b"k")
    public, other = {f"{a}.{b}.9.9" for a in (1, 10, 223) for b in range(200)}, {f"{a}.{b}.9.9" for a in (0, 224, 255) for b in range(200)}
    moved = {names.rewrite(x)[0] for x in public | other}
    assert len(moved) == 1200 and names.rewrite("Ann@X-y.org")[0].lower() == names.rewrite("ann@x-Y.org")[0].lower()


def test_the_language_model_reads_and_splits_every_text_once(spark, tmp_path):
    log = tmp_path / "rows"

    def seen(batches):
        for b in batches:
            with open(log, "a") as f:
                f.write("x" * b.num_rows)
            yield b

    texts = EDGE + [f"the cat sat on mat {i % 3} end" for i in range(20)]
    docs = docs_of(spark, texts).select("doc_id", "text").mapInArrow(seen, "doc_id long, text string")
    assert lm.score_documents(docs).count() == len(texts)
    assert len(log.read_text()) == len(texts)


def test_chunks_hold_all_words_and_the_counts_of_texts_to_learn_from():
    texts = [t and t.encode() for t in EDGE] + [b"The cat, 2024 (a) caf\xc3\xa9 the \x0b zz\x1c"]
    chunk = lm.Chunk()
    for i, t in enumerate(texts):
        chunk.add(i, t, i % 2 == 1)
    doc_ids, sizes, ids, blob, times = chunk.row()
    sizes, ids, times, words = np.frombuffer(sizes, np.int64), np.frombuffer(ids, np.uint32), np.frombuffer(times, np.uint32), blob.split(b"\n")
    want = [[*(t or b"").lower().split(), b""] for t in texts]
    assert doc_ids == list(range(len(texts))) and sizes.tolist() == [len(w) for w in want]
    assert [words[i] for i in ids] == [x for w in want for x in w] and lm.listed(blob).to_pylist() == [w.decode() for w in words]
    learned = collections.Counter(x for w in want[1::2] for x in w)
    assert dict(zip(words, times.tolist())) == {w: learned[w] for w in words}

    lexicon = lm.Lexicon([("", 9), ("the", 8), ("word", 7)], 100, 10, {})
    model, base, tail, known, rare = lexicon.encode(blob, ids, np.cumsum(sizes) - sizes)
    # the cat, 2024 (a) café the zz\x1c and the end
    assert model[-8:].tolist() == [1, *(lm.MODEL_WORDS + k for k in (4, 8, 12, 17)), 1, lm.MODEL_WORDS + 12, 0]
    for i, w in enumerate(want):
        logs = [math.log10({b"": 9, b"the": 8, b"word": 7}[x] + 1) for x in w if x in (b"", b"the", b"word")]
        assert known[i] == len(logs) and math.isclose(base[i], sum(logs), rel_tol=1e-9) and tail[i] == 0
        assert {words[p]: k for d, p, k in zip(*(x.tolist() for x in rare)) if d == i} == collections.Counter(x for x in w if x not in (b"", b"the", b"word"))


def test_the_networks_slopes_are_those_of_its_loss():
    rng = np.random.default_rng(3)
    inputs = rng.integers(0, lm.Gru.INPUTS, (lm.WINDOW, 40))
    target = rng.integers(0, lm.MODEL_WORDS + lm.TAIL, inputs.size)
    net = lm.Gru()

    def loss(net):
        hs, _ = net.forward(np.zeros((lm.UNITS, 40), np.float32), inputs, False)
        return -net.outputs(hs[1:].transpose(0, 2, 1).reshape(-1, lm.UNITS), target).sum(dtype=float)

    net.slope = np.zeros(net.SIZE, np.float32)
    slope = net._views(net.slope)
    hs, kept = net.forward(np.zeros((lm.UNITS, 40), np.float32), inputs)
    d = net.outputs(hs[1:].transpose(0, 2, 1).reshape(-1, lm.UNITS), target, slope)
    net.backward(inputs, hs, kept, d.reshape(lm.WINDOW, 40, lm.UNITS), slope)
    for part in ("x", "gates", "classes", "words"):
        way = np.zeros(net.SIZE, np.float32)
        net._views(way)[part][:] = slope[part]
        long = float(np.linalg.norm(way))
        way *= np.float32(0.05 / long)
        assert math.isclose((loss(lm.Gru(net.flat + way)) - loss(lm.Gru(net.flat - way))) / 0.1, long, rel_tol=0.02), part
