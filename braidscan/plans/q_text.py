"""Instruction text, vocabularies, labels, strings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from braidscan.plans.register import query
from braidscan.plans.standins import FN, fn
from braidscan.runtime import table

# Instruction classes by mnemonic.
ARITH = ("add", "sub", "mul", "div", "inc", "dec", "imul", "idiv", "neg")
LOGIC = ("and", "or", "xor", "not", "test", "shl", "shr")
TRANSFER = ("jmp", "jz", "jnz", "je", "jne", "mov", "push", "pop", "ret")
CALLS = ("call",)
_OPS = (*ARITH, *LOGIC, *TRANSFER, *CALLS)
_OPLIST = "[" + ", ".join(f"'{o}'" for o in _OPS) + "]"


@query("s08_instruction_corpus", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents), i AS (SELECT doc_id, unnest(string_split(line, '.')) AS i FROM l WHERE ln % 2 = 1) SELECT doc_id, count(*) AS n FROM i WHERE trim(i) <> '' GROUP BY doc_id")
def s08(s, d):
    """Every second line of a text, from the first, holds instructions."""
    odd = F.expr("filter(split(text, '\n', -1), (x, i) -> i % 2 = 0)")
    x = table(s, d, "documents").select("doc_id", F.explode(odd).alias("line")).select("doc_id", F.explode(F.split("line", "[.]", -1)).alias("i"))
    return x.filter(F.trim("i") != "").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("f14_normalise_instruction", "SELECT doc_id, md5(replace(regexp_replace(regexp_replace(text, '[ \\t\\n][ \\t\\n]+', ', ', 'g'), ' ', '  ', 'g'), '  ', ',')) AS h FROM documents")
def f14(s, d):
    t = F.regexp_replace(F.regexp_replace("text", "[ \\t\\n][ \\t\\n]+", ", "), " ", ",")
    return table(s, d, "documents").select("doc_id", F.md5(t).alias("h"))


_TOK = "tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[0-9A-Za-z@_]+')) AS w FROM documents)"


def tokens(s, d):
    docs = table(s, d, "documents")
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("([0-9A-Za-z@_]+)"), 1)).alias("at", "w"))


@query("f15_tokeniser", "SELECT doc_id, len(regexp_extract_all(text, '[0-9A-Za-z@_.]+|[^0-9A-Za-z@_., \\n]+')) AS n FROM documents")
def f15(s, d):
    n = F.size(F.regexp_extract_all("text", F.lit("([0-9A-Za-z@_.]+|[^0-9A-Za-z@_., \\n]+)"), 1))
    return table(s, d, "documents").select("doc_id", n.cast("long").alias("n"))


_VOC = f"{_TOK}, vc AS (SELECT w, count(*) AS n FROM tok GROUP BY w), voc AS (SELECT w, n, row_number() OVER (ORDER BY n DESC, w) + 1 AS idx FROM vc QUALIFY row_number() OVER (ORDER BY n DESC, w) <= 998)"


def vocabulary(s, d, size=998):
    """The most frequent words with their rank + 2 from 0; 0 ends, 1 is unknown. Only the top goes through one task."""
    c = tokens(s, d).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "w").limit(size)
    return c.withColumn("idx", (F.row_number().over(Window.orderBy(F.col("n").desc(), "w")) + 1).cast("long"))


@query("a16_vocabulary_ranks", f"WITH {_VOC} SELECT w, n, idx FROM voc")
def a16(s, d):
    return vocabulary(s, d)


@query("f16_vocab_rank_encode", f"WITH {_VOC}, t AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9A-Za-z@_]+')[1:9] AS ws FROM documents), x AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS ix FROM t), e AS (SELECT doc_id, ix, coalesce(idx, 1) AS idx FROM x LEFT JOIN voc USING (w)) SELECT doc_id, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY ix) AS codes, count(*) AS n FROM e GROUP BY doc_id")
def f16(s, d):
    head = tokens(s, d).filter("at < 9")
    # The vocabulary has at most 998 rows.
    e = head.join(F.broadcast(vocabulary(s, d).select("w", "idx")), "w", "left").select("doc_id", "at", F.coalesce("idx", F.lit(1)).alias("idx"))
    codes = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "idx"))), lambda x: x["idx"].cast("string")), ",")
    return e.groupBy("doc_id").agg(codes.alias("codes"), F.count("*").alias("n"))


@query("f17_index_decode", f"WITH {_VOC}, c AS (SELECT pos, (pos * 37) % 1100 AS idx FROM (SELECT vec_id AS pos FROM embeddings)) SELECT pos, CASE WHEN c.idx = 0 THEN 'EOS' WHEN c.idx = 1 THEN 'UNK' ELSE coalesce(w, 'NA') END AS w FROM c LEFT JOIN voc ON voc.idx = c.idx")
def f17(s, d):
    c = fn(s, d).select("pos", ((F.col("pos") * 37) % 1100).alias("idx"))
    w = F.when(F.col("idx") == 0, "EOS").when(F.col("idx") == 1, "UNK").otherwise(F.coalesce("w", F.lit("NA")))
    return c.join(F.broadcast(vocabulary(s, d).select("w", "idx")), "idx", "left").select("pos", w.alias("w"))


@query("f18_symbol_names", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN translate('a!b@' || event_type, '!@', '__') ELSE 'sub_' || lower(to_hex(abs(event_id * 16))) END AS name FROM events")
def f18(s, d):
    e = table(s, d, "events")
    return e.select("event_id", F.when(F.col("event_id") % 3 == 0, F.translate(F.concat(F.lit("a!b@"), "event_type"), "!@", "__")).otherwise(F.concat(F.lit("sub_"), F.lower(F.hex(F.abs(F.col("event_id") * 16))))).alias("name"))


@query("f19_label_parse", f"WITH {FN}, l AS (SELECT pos, lib || '_v' || (pos % 7) || '{{' || version || '}}x' AS label FROM fn) SELECT pos, regexp_extract(split_part(label, '{{', 1), '^(.*)_[^_]*$', 1) AS name, split_part(split_part(label, '{{', 2), '}}', 1) AS version FROM l")
def f19(s, d):
    l = F.concat("lib", F.lit("_v"), F.col("pos") % 7, F.lit("{"), "version", F.lit("}x"))  # noqa: E741
    x = fn(s, d).select("pos", l.alias("label"))
    return x.select("pos", F.regexp_extract(F.split_part("label", F.lit("{"), F.lit(1)), "^(.*)_[^_]*$", 1).alias("name"), F.split_part(F.split_part("label", F.lit("{"), F.lit(2)), F.lit("}"), F.lit(1)).alias("version"))


@query("f20_version_to_library", f"WITH {FN} SELECT pos, split_part(version, '-', 1) AS lib FROM fn")
def f20(s, d):
    return fn(s, d).select("pos", F.split_part("version", F.lit("-"), F.lit(1)).alias("lib"))


@query("f04_quote_strip", "SELECT event_id, trim('\"' || event_type || '\"', '\"') AS name FROM events")
def f04(s, d):
    return table(s, d, "events").select("event_id", F.btrim(F.concat(F.lit('"'), "event_type", F.lit('"')), F.lit('"')).alias("name"))


@query("f22_small_sequences", "SELECT doc_id, least(20000, length(text)) AS n FROM documents WHERE length(text) > 10")
def f22(s, d):
    return table(s, d, "documents").filter(F.char_length("text") > 10).select("doc_id", F.least(F.lit(20000), F.char_length("text")).cast("long").alias("n"))


@query("a20_mean_pooling", f"WITH {FN} SELECT label, CAST(i AS INT) AS i, round(avg(v[CAST(i AS INT)]), 6) AS mean FROM fn, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2 UNION ALL SELECT -1, CAST(unnest(range(1, 65)) AS INT), 0")
def a20(s, d):
    """The mean vector of each label, and of label -1, which has no vectors: zeros."""
    x = fn(s, d).select("label", F.posexplode("v").alias("i", "x"))
    means = x.groupBy("label", (F.col("i") + 1).alias("i")).agg(F.round(F.avg("x"), 6).alias("mean"))
    empty = s.range(1, 65).select(F.lit(-1).cast("int").alias("label"), F.col("id").cast("int").alias("i"), F.lit(0.0).alias("mean"))
    return means.unionByName(empty)


def _count(names):
    return "count(*) FILTER (WHERE op IN (" + ", ".join(f"'{n}'" for n in names) + "))"


@query("a21_instruction_classes", f"WITH i AS (SELECT l_orderkey % 500 AS block, {_OPLIST}[1 + l_partkey % {len(_OPS)}] AS op FROM lineitem) SELECT block, {_count(ARITH)} AS arith, {_count(LOGIC)} AS logic, {_count(TRANSFER)} AS transfer, {_count(CALLS)} AS calls, count(*) AS insts FROM i GROUP BY block")
def a21(s, d):
    ops = F.array(*[F.lit(o) for o in _OPS])
    i = table(s, d, "lineitem").select((F.col("l_orderkey") % 500).alias("block"), F.element_at(ops, (1 + F.col("l_partkey") % len(_OPS)).cast("int")).alias("op"))
    some = lambda names: F.count_if(F.col("op").isin(*names))
    return i.groupBy("block").agg(some(ARITH).alias("arith"), some(LOGIC).alias("logic"), some(TRANSFER).alias("transfer"), some(CALLS).alias("calls"), F.count("*").alias("insts"))


_SEQ = "sq AS (SELECT conv_id, turn, role, text FROM conversations)"


@query("w10_skipgram_pairs", f"WITH {_SEQ}, p AS (SELECT conv_id, turn, unnest([-2, -1, 1, 2]) AS o FROM sq) SELECT p.conv_id, p.turn AS centre, q.turn AS context FROM p JOIN sq q ON q.conv_id = p.conv_id AND q.turn = p.turn + p.o")
def w10(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn")
    p = c.select("conv_id", F.col("turn").alias("centre"), F.explode(F.array(*map(F.lit, (-2, -1, 1, 2)))).alias("o")).withColumn("turn", F.col("centre") + F.col("o"))
    return p.join(c, ["conv_id", "turn"]).select("conv_id", "centre", F.col("turn").alias("context"))


@query("w11_cbow_triples", f"WITH {_SEQ}, x AS (SELECT conv_id, lag(turn) OVER w AS before, turn AS middle, lead(turn) OVER w AS after FROM sq WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT * FROM x WHERE before IS NOT NULL AND after IS NOT NULL")
def w11(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = table(s, d, "conversations").select("conv_id", F.lag("turn").over(w).alias("before"), F.col("turn").alias("middle"), F.lead("turn").over(w).alias("after"))
    return x.filter("before is not null and after is not null")


@query("x16_sha256", "SELECT doc_id, sha256(text) AS h FROM documents")
def x16(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))


@query("x19_json_lines", f"WITH {FN} SELECT '{{\"lib\":\"' || lib || '\",\"version\":\"' || version || '\",\"func\":\"' || name || '\"}}' AS line FROM fn")
def x19(s, d):
    return fn(s, d).select(F.to_json(F.struct("lib", "version", F.col("name").alias("func"))).alias("line"))


@query("k11_signed_edge_lines", f"WITH {FN} SELECT pos || chr(9) || (pos + 1) || chr(9) || CASE WHEN pos % 2 = 0 THEN 1 ELSE -1 END AS line FROM fn")
def k11(s, d):
    return fn(s, d).select(F.concat_ws("\t", F.col("pos"), F.col("pos") + 1, F.when(F.col("pos") % 2 == 0, 1).otherwise(-1)).alias("line"))


@query("k03_dot_lines", "SELECT '\"' || event_id % 50 || '\" -> \"' || user_id % 50 || '\";' AS line, count(*) AS n FROM events GROUP BY 1")
def k03(s, d):
    from braidscan.sources.graphs import dot_lines

    e = table(s, d, "events").select((F.col("event_id") % 50).alias("src"), (F.col("user_id") % 50).alias("dst"))
    return dot_lines(e).groupBy("line").agg(F.count("*").alias("n"))


@query("s01_dot_edges", "SELECT CAST(event_id % 50 AS VARCHAR) AS src, CAST(user_id % 50 AS VARCHAR) AS dst, count(*) AS n FROM events GROUP BY 1, 2")
def s01(s, d):
    from braidscan.sources.graphs import dot_lines, parse_dot

    e = table(s, d, "events").select((F.col("event_id") % 50).alias("src"), (F.col("user_id") % 50).alias("dst"))
    return parse_dot(dot_lines(e).withColumnRenamed("line", "value")).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("s16_truth_pairs", "WITH l AS (SELECT conv_id, [conv_id, conv_id + 1] AS a, [conv_id * 2, conv_id * 3] AS b FROM (SELECT DISTINCT conv_id FROM conversations)), x AS (SELECT conv_id, unnest(a) AS addr1, b FROM l) SELECT addr1, unnest(b) AS addr2 FROM x")
def s16(s, d):
    from braidscan.sources.graphs import parse_truth

    c = table(s, d, "conversations").select("conv_id").distinct()
    line = F.format_string("[%d, %d][%d, %d]", "conv_id", F.col("conv_id") + 1, F.col("conv_id") * 2, F.col("conv_id") * 3)
    return parse_truth(c.select(line.alias("value")))


@query("j18_library_attributes", f"WITH {FN} SELECT pos, CASE WHEN label < 3 THEN version ELSE 'unknown' END AS attribute, coalesce(n_name, 'none') AS nation FROM fn LEFT JOIN nation ON n_nationkey = pos")
def j18(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), "n_name")
    return fn(s, d).join(n, "pos", "left").select("pos", F.when(F.col("label") < 3, F.col("version")).otherwise("unknown").alias("attribute"), F.coalesce("n_name", F.lit("none")).alias("nation"))


@query("j20_nearest_by_euclid", f"WITH {FN} SELECT a.pos AS q, arg_min(b.pos, round(list_distance(a.v, b.v), 7) * 1000000 + b.pos / 100000.0) AS nearest FROM fn a JOIN fn b ON a.pos % 20 = 0 AND b.pos <> a.pos GROUP BY a.pos")
def j20(s, d):
    from braidscan.operators.knn import nearest_by

    f = fn(s, d)
    q = f.filter("pos % 20 = 0").select(F.col("pos").alias("q"), "v")
    return nearest_by(q, f.select(F.col("pos").alias("n"), "v"), 1, "euclid", 7).select("q", F.col("n").alias("nearest"))


#: Words that one task of the word vectors' training reads, one after the other.
PASS_WORDS = 1 << 22


@query("m04_word2vec_size")
def m04(s, d):
    """Skip-gram vectors of frequent words (trained, so rows only).

    Tasks of about PASS_WORDS words learn side by side from the same start, and their vectors are averaged.
    """
    from pyspark.ml.feature import Word2Vec

    docs = table(s, d, "documents").filter("text is not null").select(F.split(F.lower("text"), "\\s+").alias("words"))
    n = docs.agg(F.sum(F.size("words").cast("long"))).first()[0] or 0
    model = Word2Vec(vectorSize=8, minCount=50, maxIter=1, seed=7, inputCol="words", outputCol="v", numPartitions=max(1, -(-n // PASS_WORDS))).fit(docs)
    return model.getVectors().select("word", F.col("vector").cast("string").alias("vector"))
