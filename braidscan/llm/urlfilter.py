"""URL filters: rules first, then a learned verdict over segmented names.

Host names run words together. A unigram model over the pages' own visible words splits
them by Viterbi search; multinomial naive Bayes then scores the words of host and path. It
learns from the pages that a rule decides, but for a fold held out to measure it; no list
of words teaches it, and what a rule decides stays decided.

All counts stay in tables: the model of words and the model of tokens know every word and
token there is. The parts of each different run of letters meet their counts in a join, and
so do the tokens of each page; only totals reach the driver.

Defined cases
  null url, no "://"   host and path empty; the method judges no words: the prior
  null html            no words
  rules                the longest fitting rule wins; among equals a block
  nothing learned      log odds 0: allowed
  ties                 log odds 0: allowed; of equally likely splits the one whose last word is longest
  very long names      split like others; a word of a host has at most MAX_WORD letters
  repeated rows        each row is judged and counts
  null page_id         judged; never held out
  extra columns        ignored
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidscan.llm.ngram_join import _batches
from braidscan.runtime import Scratch

# The rules of the contract, (verdict, host and path).
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
# Fixed value: a label of a host name has at most 63 letters.
MAX_WORD = 63
#: Words a worker counts before it lets go; pages held out of learning: crc32(page_id) modulo FOLD is HELD_OUT.
HELD, FOLD, HELD_OUT = 200_000, 5, 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty without "://"."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(has, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one."""
    ranked = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in reversed(ranked):
        at = text.find("/")
        name, start = (text, "") if at < 0 else (text[:at], text[at:])
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


_TAGS, _WORDS = re.compile(rb"(?s)<(script|style)\b.*?</\1\s*>|<[^>]*>"), re.compile(rb"[a-z]+")


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n): every word of all pages' visible text."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def rows(c):
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], schema=schema)

    def partial(batches):
        c: Counter = Counter()
        for b in batches:
            for _, texts in _batches(b):
                for t in texts:
                    c.update(_WORDS.findall(_TAGS.sub(b" ", t or b"").lower()))
                    if len(c) > HELD:
                        yield rows(c)
                        c = Counter()
        if c:
            yield rows(c)

    return pages.select("page_id", "html").mapInArrow(partial, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def split(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest words of a run of letters; an unknown word costs more the longer it is."""
    logs, unknown = {w: math.log(n / total) for w, n in counts.items()}, math.log(1 / total) - 1
    best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    for z in range(1, len(name) + 1):
        for a in range(max(0, z - MAX_WORD), z):
            s = best[a] + logs.get(name[a:z], unknown - 3.0 * (z - a))
            if s > best[z]:
                best[z], back[z] = s, a
    cuts, z = [], len(name)
    while z:
        cuts.append(name[back[z] : z])
        z = back[z]
    return cuts[::-1]


def segmented(runs: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(run, words) of each different run of letters: its parts meet their counts, then the best path through them is taken."""
    starts = runs.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at"))
    parts = starts.select("run", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(MAX_WORD), F.length("run") - F.col("at") + 1))).alias("size"))
    parts = parts.select("run", F.expr("substring(run, at, size)").alias("word")).distinct()
    known = parts.join(words.filter(F.length("word") <= MAX_WORD), "word").groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    schema = pa.schema([("run", pa.string()), ("words", pa.list_(pa.string()))])

    def run(batches):
        for b in batches:
            names = b.column(0).to_pylist()
            cuts = [split(name, {x["word"]: x["n"] for x in known or ()}, total) for name, known in zip(names, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(cuts, pa.list_(pa.string()))], schema=schema)

    return runs.join(known, "run", "left").select("run", "known").mapInArrow(run, "run string, words array<string>")


def tokens(urls: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(row, token): the words of each host and path, as often as they occur; numbers by first digit and length."""
    number = lambda c: F.when(c.rlike("^[0-9]"), F.concat(F.substring(c, 1, 1), F.lit("#"), F.length(c))).otherwise(c)
    hosts = urls.select("host").filter("host <> ''").distinct()
    piece = hosts.select("host", F.explode(F.regexp_extract_all("host", F.lit("([a-z]+|[0-9]+|[^a-z0-9.-]+)"), 1)).alias("run"))
    letters = F.col("run").rlike("^[a-z]+$")
    names = segmented(piece.filter(letters).select("run").distinct(), words, total).withColumnRenamed("run", "name")
    split_up = piece.filter(letters).join(names, F.col("run") == F.col("name")).select("host", F.explode("words").alias("w"))
    of_host = split_up.unionByName(piece.filter(~letters).select("host", number(F.col("run")).alias("w")))
    of_host = of_host.groupBy(F.col("host").alias("of")).agg(F.collect_list(F.concat(F.lit("h:"), "w")).alias("held"))
    in_host = urls.select("row", "host").join(of_host, F.col("host") == F.col("of")).select("row", F.explode("held").alias("token"))
    in_path = urls.select("row", F.explode(F.regexp_extract_all(F.lower("path"), F.lit("([a-z]+|[0-9]+)"), 1)).alias("w"))
    return in_host.unionByName(in_path.select("row", F.concat(F.lit("p:"), number(F.col("w"))).alias("token")))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, log_odds, learned, held_out) of every page; learned is the method's own verdict."""
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = split_url(F.col("url"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.select(F.monotonically_increasing_id().alias("row"), "page_id", "host", "path", rule.alias("rule"), verdict.alias("decided"))
    held_out = F.coalesce(F.crc32(F.col("page_id").cast("string")) % FOLD == HELD_OUT, F.lit(False))
    urls = scratch.put(urls.withColumn("held_out", held_out), "urls")
    words = scratch.put(word_counts(pages), "words")
    total = (words.agg(F.sum("n").alias("n")).first()["n"] or 0) + 1
    said = scratch.put(tokens(urls, words, total), "tokens")

    # Naive Bayes with add-one smoothing, from pages with a rule.
    taught = urls.filter(F.col("decided").isNotNull() & ~F.col("held_out")).select("row", (F.col("decided") == "block").cast("long").alias("bad"))
    sizes = taught.agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).first()
    counted = scratch.put(said.join(taught, "row").groupBy("token").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")), "counts")
    sums = counted.agg(F.count("*").alias("v"), F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    of = lambda c: F.log((F.col(c) + 1.0) / ((sums[c] or 0) + sums["v"] + 1.0))
    prior = math.log(((sizes["bad"] or 0) + 1) / (sizes["n"] - (sizes["bad"] or 0) + 1))
    odds = said.join(counted.select("token", (of("bad") - of("good")).alias("odds")), "token").groupBy(F.col("row").alias("at")).agg(F.sum("odds").alias("odds"))
    log_odds = F.coalesce("odds", F.lit(0.0)) + F.lit(prior)
    scored = urls.join(odds, F.col("row") == F.col("at"), "left").withColumn("log_odds", log_odds)
    learned = F.when(F.col("log_odds") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("decided", learned).alias("verdict"), "log_odds", learned.alias("learned"), "held_out")
