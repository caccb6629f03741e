"""Line dedup with DataFrame functions only.

Lines are hashed to 128 bits. The hashes are range-partitioned and sorted inside each
partition by document (largest first) and position, so that one streaming pass sees the
first occurrence of every line, counts its documents and marks all other occurrences.
What comes back per document is not text but a compressed keep bitmap: the runs of
dropped positions (start, length), from which the kept text is cut.

Lines that very many documents hold would fill one range. They are found with a
frequent-items sketch (bounded size, only routing depends on it), counted by a combining
aggregate, and decided in place by a lookup table of at most ``HOT_ITEMS`` rows. What is left
of a line in the ranges is one row in ``HOT_SHARE`` at most.

Defined cases
  null or empty text      one empty line, kept
  very long texts         split into a row for each line; a text's lines meet again as runs, not as text
  null doc_id             the row is returned whole; its lines neither count nor drop
  repeated rows           rows with one doc_id are one document for the counts; each row is returned
  ties                    none: the largest doc_id keeps the line
  empty table             empty result
  extra columns           ignored by ``keep_bitmaps``, carried along by ``apply_bitmaps``, where the columns it adds
                          win over columns of the same name; ``rewrite_texts`` keeps all
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidscan.runtime import Scratch

# The characters stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
#: Code points a key needs, documents that must hold it.
MIN_CHARS, MIN_DOCS = 20, 3
#: Lines reported by the sketch and its counters; a line with more than one in HOT_SHARE of the line rows is certainly among them.
HOT_ITEMS, HOT_TRACKED, HOT_SHARE = 16384, 65536, 16384

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line stripped of blanks and with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), _UPPER, _LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, body, pos, h1, h2): a row for each line long enough; body tells rows of one doc_id apart."""
    flat = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id"), F.xxhash64("text").alias("body"), F.posexplode(_lines(F.col("text"))).alias("pos", "line")
    )
    keyed = flat.select("doc_id", "body", "pos", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.char_length("key") >= min_chars).select(
        "doc_id", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2")
    )


def _hot_hashes(occ: DataFrame) -> DataFrame:
    """(h1): hashes that may hold more than one in HOT_SHARE of the rows, and at least MIN_DOCS; at most HOT_ITEMS rows by construction."""
    top = occ.agg(F.expr(f"approx_top_k(h1, {HOT_ITEMS}, {HOT_TRACKED})").alias("top"), F.count("*").alias("n"))
    return (
        top.select(F.explode("top").alias("t"), "n")
        .filter((F.col("t.count") * HOT_SHARE > F.col("n")) & (F.col("t.count") >= MIN_DOCS))
        .select(F.col("t.item").alias("h1"))
    )


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, body, n_dropped, drop_runs): run-length coded bitmaps of documents that lose lines."""
    scratch = Scratch(docs.sparkSession, "lines")
    occ = scratch.put(line_occurrences(docs, min_chars), "occurrences")
    hot = F.broadcast(scratch.put(_hot_hashes(occ).coalesce(1), "hot"))

    # Frequent lines: counts combine before the shuffle, the verdict comes from a bounded table.
    frequent = occ.join(hot, "h1", "left_semi")
    facts = (
        frequent.groupBy("h1", "h2", "doc_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("first"))
        .filter(F.col("n_docs") >= min_docs)
    )
    facts = F.broadcast(facts.select("h1", "h2", "first"))  # one row for each of the HOT_ITEMS hashes
    dropped_hot = frequent.join(facts, ["h1", "h2"]).filter(F.col("doc_id") != F.col("first"))

    # All others: range partition by hash, secondary sort by document and position, stream.
    rest = occ.join(hot, "h1", "left_anti").repartitionByRange(F.col("h1"))
    whole = Window.partitionBy("h1", "h2")
    nth = rest.withColumn("nth_doc", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").desc())))
    dropped = nth.withColumn("n_docs", F.max("nth_doc").over(whole)).filter(
        (F.col("n_docs") >= min_docs) & (F.col("nth_doc") > 1)
    )

    positions = dropped.select("doc_id", "body", "pos").unionByName(dropped_hot.select("doc_id", "body", "pos"))
    order = Window.partitionBy("doc_id", "body").orderBy("pos")
    islands = (
        positions.groupBy("doc_id", "body", "pos")
        .agg(F.lit(1).alias("one"))
        .withColumn("island", F.col("pos") - F.row_number().over(order))
    )
    runs = islands.groupBy("doc_id", "body", "island").agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("len"))
    return runs.groupBy("doc_id", "body").agg(
        F.sum("len").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("start", "len"))).alias("drop_runs")
    )


def cut_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(row, n_lines, n_dropped, kept_text): row holds all columns of docs, whatever their names."""
    marks = bitmaps.select(
        F.col("doc_id").alias("_doc"), F.col("body").alias("_body"), F.col("n_dropped").alias("_n"), F.col("drop_runs").alias("_runs")
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(marks, (F.col("row.doc_id") == F.col("_doc")) & (F.xxhash64("row.text") == F.col("_body")), "left")
    lines = _lines(F.col("row.text"))
    cut = joined.withColumn("n_lines", F.size(lines).cast("long")).withColumn("n_dropped", F.coalesce(F.col("_n"), F.lit(0)).cast("long"))
    # Kept runs lie between the dropped ones: before the first, and after each up to the next.
    ends = F.expr("concat(array(0), transform(_runs, r -> r.start + r.len))")
    starts = F.expr("concat(transform(_runs, r -> r.start), array(cast(n_lines as int)))")
    between = cut.withColumn("_lines", F.when(F.col("_runs").isNotNull(), lines)).withColumn("_spans", F.arrays_zip(ends.alias("a"), starts.alias("b")))
    kept = F.expr("array_join(flatten(transform(_spans, s -> slice(_lines, s.a + 1, s.b - s.a))), '\n')")
    whole = F.coalesce("row.text", F.lit(""))
    return between.select("row", "n_lines", "n_dropped", F.when(F.col("_runs").isNull(), whole).otherwise(kept).alias("kept_text"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text added; columns of docs with these names give way."""
    added = ("n_lines", "n_dropped", "kept_text")
    held = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in added]
    return cut_lines(docs, bitmaps).select(*held, *added)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs))


def rewrite_texts(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the same columns: texts that lose lines are replaced, n_chars (if there is one) follows the text."""
    kept = cut_lines(docs, keep_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs))
    lost, text = F.col("n_dropped") > 0, F.col("kept_text")
    changed = {"text": F.when(lost, text).otherwise(F.col("row.text")), "n_chars": F.char_length("kept_text").cast("long")}
    return kept.select(*[(changed[c] if c in changed else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
