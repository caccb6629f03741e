"""Language identification by multilingual mixture inference.

A text's byte trigrams (letters only, A-Z lower-cased, hashed to BUCKETS) are taken to be
drawn from a mixture of the learned languages' trigram distributions.
Expectation-maximisation over all languages, run until nothing moves, estimates the
proportions and so ranks the languages. The set then grows by that ranking, from the likeliest
language alone upwards, as long as its penalised likelihood rises.

The model takes 16 KB for each language there is; nothing else here grows with the labels.

Defined cases
  null text, text without a letter   lang_pred "und", score 0
  nothing learned                    "und" with score 0
  ties                               the language that sorts first
  very long texts                    counted in overlapping parts of bounded size
  repeated rows                      each row is judged (and learned from)
  null doc_id                        judged, never learned from; held_out false
  extra columns                      ignored
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidscan.llm.ngram_join import _batches

#: Hashed trigrams; smoothing; the change of proportions at which estimation ends.
BUCKETS, SMOOTH, STILL = 2048, 0.5, 1e-3
#: Cost of a further language, in halves of the logarithm of the trigrams: one for the parameter, times four
#: because a letter lies in three trigrams and names and borrowed words come in runs, so counts stray far more than draws would.
PENALTY = 4
#: Texts scored at once.
BLOCK = 64

_LETTER = np.zeros(256, np.uint32)
_LETTER[65:91] = np.arange(1, 27)
_LETTER[97:123] = np.arange(1, 27)
_LETTER[128:] = np.arange(27, 155)


def histogram(text: bytes | None) -> np.ndarray:
    """Counts of hashed trigrams that hold a letter, of the whole text."""
    out = np.zeros(BUCKETS, np.int64)
    data = np.frombuffer(text or b"", np.uint8)
    for at in range(0, len(data), 1 << 20):  # overlapping parts of bounded size
        c = _LETTER[data[at : at + (1 << 20) + 2]]
        if at == 0:
            c = np.concatenate(([np.uint32(0)], c)).astype(np.uint32)
        if at + (1 << 20) + 2 > len(data):
            c = np.concatenate((c, [np.uint32(0)])).astype(np.uint32)
        if len(c) < 3:
            continue
        code = (c[:-2] * np.uint32(155) + c[1:-1]) * np.uint32(155) + c[2:]
        code = code[code > 0] * np.uint32(2654435761)
        out += np.bincount(code >> np.uint32(21), minlength=BUCKETS)
    return out


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    if seen[65:91].any() or seen[97:123].any():
        return True
    return bool(seen[128:].any()) and any(map(str.isalpha, text.decode("utf-8", "replace")))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram log-probabilities, from all rows of docs (text, lang)."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def partial(batches):
        acc: dict[str, np.ndarray] = {}
        for b in batches:
            for langs, texts in _batches(b):
                for lang, t in zip(langs, texts):
                    if lang not in acc:
                        acc[lang] = np.zeros(BUCKETS, np.int64)
                    acc[lang] += histogram(t)
        for lang, v in acc.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(v[at])], schema=schema)

    sums = docs.select("lang", "text").mapInArrow(partial, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = sums.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("ns")).orderBy("lang")
    langs, counts = [], []
    for r in rows.toLocalIterator():  # a row for each language, of BUCKETS entries at most
        langs.append(r["lang"])
        counts.append(np.full(BUCKETS, SMOOTH))
        counts[-1][r["buckets"]] += r["ns"]
    known = np.array(counts).reshape(len(langs), BUCKETS)
    return langs, known / known.sum(1, keepdims=True)


def estimate(counts: np.ndarray, probs: np.ndarray, mix: np.ndarray, enough: np.ndarray | None = None) -> np.ndarray:
    """Proportions of each document from the start `mix` on; a language at zero stays there. Documents leave as they settle.

    With `enough`, a document also leaves when no proportions at all can reach that log likelihood: by Jensen's
    inequality it exceeds the present one by n log(g / n) at most, g the largest of the languages' summed ratios.
    """
    mix, total = mix.copy(), np.maximum(counts.sum(1), 1)
    todo, own, step = np.arange(len(counts)), counts, 0
    while len(todo):
        old = mix[todo]
        dense = old @ probs
        np.maximum(dense, 1e-300, out=dense)
        g = (own / dense) @ probs.T
        new = old * g / total[todo, None]
        mix[todo] = new
        moving = np.abs(new - old).max(1) > STILL
        if enough is not None and step % 4 == 0:
            n = total[todo]
            moving &= (own * np.log(dense)).sum(1) + n * np.log(np.maximum(g.max(1), 1e-300) / n) > enough[todo]
        step += 1
        if not moving.all():
            todo, own = todo[moving], own[moving]
    return mix


def proportions(counts: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """(documents, languages): the selected set's proportions, zero outside of it."""
    n_docs, n_langs = len(counts), len(probs)
    cost = PENALTY / 2 * np.log(np.maximum(counts.sum(1), 1))
    alone = counts @ np.log(probs).T
    first = np.argmax(alone, axis=1)
    best = np.zeros((n_docs, n_langs))
    best[np.arange(n_docs), first] = 1
    if n_langs == 1:
        return best
    penalised = alone[np.arange(n_docs), first].copy()
    start = np.full((n_docs, n_langs), 0.2 / (n_langs - 1))
    start[np.arange(n_docs), first] = 0.8
    whole = estimate(counts, probs, start, penalised + cost)
    order = np.argsort(-whole, axis=1, kind="stable")
    # Only where all languages together gain more than the cost of one can a set of several win.
    gained = (counts * np.log(np.maximum(whole @ probs, 1e-300))).sum(1) > penalised + cost
    rising = np.flatnonzero(gained)
    for size in range(2, n_langs + 1):
        if not len(rising):
            break
        mix = np.zeros((len(rising), n_langs))
        mix[np.arange(len(rising))[:, None], order[rising, :size]] = 1 / size
        mix = estimate(counts[rising], probs, mix)
        fit = (counts[rising] * np.log(np.maximum(mix @ probs, 1e-300))).sum(1) - (size - 1) * cost[rising]
        better = fit > penalised[rising]
        rising, mix, fit = rising[better], mix[better], fit[better]
        best[rising], penalised[rising] = mix, fit
    return best


def predict(docs: DataFrame, fold: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, shares) of every whole text; learns where crc32(doc_id) mod fold is not `held`."""
    fold_of = F.crc32(F.col("doc_id").cast("string")) % fold
    langs, probs = learn(docs.filter((fold_of != held) & F.col("lang").isNotNull()))
    share = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("shares", share)])
    shared = docs.sparkSession.sparkContext.broadcast((langs, probs))

    def run(batches):
        langs, probs = shared.value
        for b in batches:
            for ids, texts in _batches(b):
                names, scores, shares = ["und"] * len(ids), [0.0] * len(ids), [[] for _ in ids]
                for at in range(0, len(ids) if langs else 0, BLOCK):
                    part = [j for j in range(at, min(at + BLOCK, len(ids))) if has_letter(texts[j])]
                    if part:
                        mix = proportions(np.stack([histogram(texts[j]) for j in part]).astype(np.float64), probs)
                        for j, m in zip(part, mix):
                            k = int(np.argmax(m))
                            names[j], scores[j] = langs[k], min(1.0, float(m[k]))
                            shares[j] = [(langs[i], float(m[i])) for i in np.flatnonzero(m > STILL)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, share)], schema=schema)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, shares array<struct<lang:string,share:double>>")
    return out.select("doc_id", F.coalesce(fold_of == held, F.lit(False)).alias("held_out"), "lang_pred", "score", "shares")
