"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each whole text gives a fixed number of statistics (lengths, shares of character classes,
repetition), transformed towards normality. For both classes the mean and the covariance
come from sums over all labelled training rows; the covariance is shrunk towards the pooled
one and towards a multiple of the identity. A score is the logistic of the difference of
log densities and log priors, by Mahalanobis distances over Cholesky factors computed once.

Defined cases
  null or empty text   statistics of an empty text; it gets a score like any other
  unlabelled rows      not learned from; null quality counts as unlabelled
  repeated rows        each row is scored; a label given twice counts as its largest value
  one class missing    every score is 1 or 0 for the class there is, 0.5 without any
  null doc_id          scored, never learned from; held_out false
  extra columns        ignored
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidscan.llm import wordhash
from braidscan.llm.ngram_join import _batches
from braidscan.runtime import Scratch

#: Names of the statistics, in order.
STATS = (
    "log_bytes", "log_word_length", "upper", "symbols", "digits", "punctuation", "high_bytes", "distinct_words",
    "repeats", "line_rate", "top_word", "short_cycle",
)
#: Shrinkage towards the pooled covariance and towards the identity.
TO_POOLED, TO_IDENTITY = 0.1, 0.02

_CLASS = np.zeros((5, 256), np.float64)
_CLASS[0, 65:91] = 1
_CLASS[1, [ord(c) for c in "#$%&*|!<>{}[]=+~^\\@_"]] = 1
_CLASS[2, 48:58] = 1
_CLASS[3, [ord(c) for c in ".,;:?'\"()-"]] = 1
_CLASS[4, 128:] = 1


def _word_stats(h: np.ndarray) -> tuple[float, float, float, float]:
    """Shares of distinct words, immediate repeats, the commonest word, and words seen within the last 64."""
    n = len(h)
    if n == 0:
        return 1.0, 0.0, 0.0, 0.0
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    counts = np.diff(np.concatenate((first, [n])))
    same = s[1:] == s[:-1]
    gaps = order[1:][same] - order[:-1][same]
    return len(first) / n, float((gaps == 1).sum()) / n, counts.max() / n, float((gaps <= 64).sum()) / n


def statistics(texts: list[bytes | None]) -> np.ndarray:
    h, bounds = wordhash.words(texts)
    out = np.empty((len(texts), len(STATS)))
    for i, t in enumerate(texts):
        counts = np.bincount(np.frombuffer(t or b"", np.uint8), minlength=256)
        n = max(1, int(counts.sum()))
        upper, symbols, digits, punct, high = _CLASS @ counts / n
        words = max(1, bounds[i + 1] - bounds[i])
        distinct, repeats, top, cycle = _word_stats(h[bounds[i] : bounds[i + 1]])
        root = np.sqrt
        out[i] = (
            np.log1p(n), np.log1p(n / words), root(upper), root(symbols), root(digits), root(punct), root(high),
            distinct, root(repeats), root(counts[10] / words), root(top), root(cycle),
        )
    return out


def statistics_table(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("stats", pa.list_(pa.float64()))])

    def run(batches):
        for b in batches:
            for ids, texts in _batches(b):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(statistics(texts)), pa.list_(pa.float64()))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, stats array<double>")


class Discriminant:
    """Two Gaussian classes with cached Cholesky factors."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        d = len(STATS)
        self.sure = None if all(k in sums for k in (0, 1)) else (0.5 if not sums else float(1 in sums))
        if self.sure is not None:
            return
        total = sum(s[0] for s in sums.values())
        means = {k: s[1] / s[0] for k, s in sums.items()}
        covs = {k: s[2] / s[0] - np.outer(means[k], means[k]) for k, s in sums.items()}
        pooled = sum(s[0] / total * covs[k] for k, s in sums.items())
        self.parts = []
        for k in (0, 1):
            alpha = max(TO_POOLED, d / (d + sums[k][0]))
            cov = (1 - alpha) * covs[k] + alpha * pooled
            cov = (1 - TO_IDENTITY) * cov + TO_IDENTITY * (np.trace(pooled) / d + 1e-9) * np.eye(d)
            low = np.linalg.cholesky(cov)
            self.parts.append((means[k], np.linalg.inv(low), -np.log(np.diag(low)).sum() + np.log(sums[k][0] / total)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.sure is not None:
            return np.full(len(x), self.sure)
        logs = [c - 0.5 * (((x - m) @ inv.T) ** 2).sum(1) for m, inv, c in self.parts]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(stats: DataFrame, labels: DataFrame, trains) -> Discriminant:
    """From sums over every labelled row for which `trains` holds; what reaches the driver has a fixed size."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = stats.filter(trains).join(known, "doc_id")
    d = len(STATS)
    schema = pa.schema([("label", pa.int32()), ("at", pa.int32()), ("value", pa.float64())])

    def partial(batches):
        acc = {}
        for b in batches:
            if not b.num_rows:
                continue
            y = b.column(1).to_numpy(zero_copy_only=False)
            x = np.stack(b.column(0).to_numpy(zero_copy_only=False))
            for k in (0, 1):
                part = x[y == k]
                acc[k] = acc.get(k, 0) + np.concatenate(([len(part)], part.sum(0), (part.T @ part).ravel()))
        for k, v in acc.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(v), pa.int32()), pa.array(range(len(v)), pa.int32()), pa.array(v)], schema=schema)

    sums = rows.select("stats", "quality").mapInArrow(partial, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value")).collect()
    out = {}
    for k in (0, 1):
        v = np.zeros(1 + d + d * d)
        for r in sums:
            if r["label"] == k:
                v[r["at"]] = r["value"]
        if v[0] > 0:
            out[k] = (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d))
    return Discriminant(out)


def score_documents(docs: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted); learns from rows whose crc32(doc_id) mod fold is not `held`."""
    stats = Scratch(docs.sparkSession, "quality").put(statistics_table(docs), "stats")
    fold_of = F.crc32(F.col("doc_id").cast("string")) % fold
    model = fit(stats, labels.select("doc_id", "quality"), fold_of != held)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column(1).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], schema=schema)

    scored = stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(fold_of == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1) -> DataFrame:
    """The rows of docs, whole, that the classifier does not reject."""
    stats = Scratch(docs.sparkSession, "quality").put(statistics_table(docs), "stats")
    model = fit(stats, labels.select("doc_id", "quality"), F.crc32(F.col("doc_id").cast("string")) % fold != held)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            done = 0
            for ids, texts in _batches(pa.RecordBatch.from_arrays([pa.array(range(b.num_rows)), b.column(at)], names=["row", "text"])):
                good = model.score(statistics(texts)) >= 0.5
                yield b.slice(done, len(ids)).filter(pa.array(good))
                done += len(ids)

    return docs.mapInArrow(run, docs.schema)
