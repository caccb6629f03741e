"""Benchmark decontamination by edit distance over words.

A document is contaminated by an item if some stretch of it is within EDITS_PERCENT of the
item's words in edit distance. The item-sized windows that start at every word of a document
go through the CGK random walk, which maps edit to Hamming distance: at each of its steps a
walk shows the word it stands on, and a random bit of (walk, step, word) moves it on. Repeated
bit sampling of what the walks show gives hash keys; a window whose key is an item's key is a
candidate, verified by the exact edit distance. Nothing else proposes candidates.

All windows of a text walk at once. Two walks that stand on one word at the same step stay
together from there on, so they go on as one, which leaves few walkers after some steps. The
coins do not depend on a window's length: items of all lengths share the walks and differ only
in how many of the steps (three times their words at most) they have samples from.

Items travel to the tasks in blocks of at most BLOCK_ITEMS items and BLOCK_BYTES of text; a
longer item is a block of its own.

Defined cases
  null or empty text or item      holds nothing, is found nowhere
  items under MIN_WORDS words     not searched for: they are no evidence
  very long texts                 walked in slices of bounded size that overlap by a walk's length
  repeated rows                   a pair is returned once
  null ids                        left out
  ties                            the leftmost best stretch is reported
  extra columns                   ignored
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidscan.llm import wordhash
from braidscan.llm.ngram_join import _batches

#: Edits allowed, in percent of the item's words; the shortest item searched for; items and bytes of a block.
EDITS_PERCENT, MIN_WORDS, BLOCK_ITEMS, BLOCK_BYTES = 20, 5, 8192, 1 << 24
#: Independent walks; steps of a stretch of samples; keys sampled in each stretch for each walk.
WALKS, SPAN, REPEATS = 4, 16, 5
#: Steps before the first stretch, for items of LONG words and more; shorter ones are sampled from the first step on.
WARM, LONG = 4, 12
#: Windows walked at once; places for each key in the table that tells most keys apart from the items'.
SLICE, FILTER_ROOM = 1 << 16, 64
_PAD = np.uint64(0x5851F42D4C957F2D)


@functools.lru_cache(maxsize=4096)
def samples(number: int, stretch: int) -> list[tuple[int, int, int]]:
    """REPEATS times three sampled steps of a stretch: an early, a middle and a late one."""
    rng = np.random.Generator(np.random.PCG64([number, stretch + 1]))
    part, gap = SPAN // 4, SPAN * 3 // 8  # steps apart, lest one word be sampled twice
    return [tuple(int(k * gap + rng.integers(0, part)) for k in range(3)) for _ in range(REPEATS)]


def salted(number: int, stretch: int, r: int) -> np.uint64:
    return np.uint64((((number * 4099 + stretch + 2) * 61 + r) * 0x9E3779B97F4A7C15 | 1) & (2**64 - 1))


class Walk:
    """One random walk over the windows from each of the first words; behind the last word there must be room for its steps."""

    def __init__(self, words: np.ndarray, starts: int, number: int):
        self.words, self.number, self.step = words, number, 0
        self.at = np.arange(starts)

    def merge(self) -> None:
        """Walkers on one word go on as one; they never overtake each other, so equals are neighbours."""
        apart = np.empty(len(self.at), bool)
        apart[:1] = True
        np.not_equal(self.at[1:], self.at[:-1], out=apart[1:])
        self.at = self.at.take(np.flatnonzero(apart))

    def move(self) -> None:
        if self.step % 64 == 0:  # the coins of 64 steps, a bit for each
            salt = (self.step + 1) * 0x9E3779B97F4A7C15 + self.number * 0xC2B2AE3D27D4EB4F
            block = (self.words ^ np.uint64(salt & (2**64 - 1))) * np.uint64(0xD6E8FEB86659FD93)
            block ^= block >> np.uint64(32)
            self.block = block.view(np.uint8)
        if self.step % 8 == 0:
            self.coins = np.ascontiguousarray(self.block[self.step // 8 % 8 :: 8])
        coin = self.coins.take(self.at, mode="clip")
        coin >>= np.uint8(self.step % 8)
        coin &= np.uint8(1)
        self.at += coin
        self.step += 1

    def stretch(self) -> np.ndarray:
        """(SPAN, walkers): where each walker stands at the next SPAN steps."""
        self.merge()
        out = np.empty((SPAN, len(self.at)), np.int64)
        for k in range(SPAN):
            out[k] = self.at
            self.move()
        return out


def stretches(words: np.ndarray, starts: int, number: int, first: bool, last: int):
    """(stretch, places) of one walk: stretch -1 covers the first steps, the others follow each other from step WARM on."""
    if first:
        yield -1, Walk(words, starts, number).stretch()
    walk = Walk(words, starts, number)
    for k in range(WARM):
        walk.move()
        if k % 2:
            walk.merge()
    for stretch in range(last + 1):
        yield stretch, walk.stretch()


class Symbols:
    """The words' hashes as they enter the keys, for each of the three samples."""

    def __init__(self, words: np.ndarray):
        self.by = [words * np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]

    def pair(self, places: np.ndarray, steps: tuple[int, int, int], salt: np.uint64) -> np.ndarray:
        """The first two samples' keys of all walkers, told apart by their top bits."""
        key = self.by[0].take(places[steps[0]], mode="clip")
        key += self.by[1].take(places[steps[1]], mode="clip")
        key *= salt
        return key

    def whole(self, places: np.ndarray, steps: tuple[int, int, int], pair: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The keys of all three samples, of some walkers."""
        return pair[rows] ^ self.by[2][places[steps[2]][rows]]


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(edits, end): the least edit distance of the item to any stretch of the text, and where that ends first."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for w in item:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text != w))
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


class ItemIndex:
    """A block of items: the sampled keys of each as a window of its own."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        h, bounds = wordhash.words(texts)
        self.items = [(i, h[a:z]) for i, a, z in zip(ids, bounds[:-1], bounds[1:]) if z - a >= MIN_WORDS]
        self.edits = [len(w) * EDITS_PERCENT // 100 for _, w in self.items]
        self.sorted = [np.unique(w) for _, w in self.items]
        self.short = any(len(w) < LONG for _, w in self.items)
        found: dict[tuple[int, int, int], list[tuple[int, int, int]]] = {}
        pairs: list[int] = []
        for t, (_, w) in enumerate(self.items):
            n = len(w)
            padded = np.concatenate((w, np.full(3 * n + 2 * SPAN, _PAD)))
            symbols = Symbols(padded)
            for number in range(WALKS):
                for stretch, places in stretches(padded, 1, number, n < LONG, (3 * n - WARM) // SPAN):
                    for r, steps in enumerate(samples(number, stretch)):
                        if places[steps[2], 0] < n:  # the walk has not left the item
                            pair = symbols.pair(places, steps, salted(number, stretch, r))
                            pairs.append(int(pair[0]))
                            found.setdefault((number, stretch, r), []).append((int(symbols.whole(places, steps, pair, np.zeros(1, np.int64))[0]), t, int(places[steps[0], 0])))
        # One table tells most pairs of samples apart from all of the items'; it grows with their number.
        self.shift = np.uint64(64 - max(16, (len(pairs) * FILTER_ROOM).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[np.array(pairs, np.uint64) >> self.shift] = True
        self.keys: dict[tuple[int, int, int], tuple[np.ndarray, ...]] = {}
        for k, rows in found.items():
            rows.sort()
            self.keys[k] = (np.array([x[0] for x in rows], np.uint64), np.array([x[1] for x in rows]), np.array([x[2] for x in rows]))
        self.last = max((k[1] for k in self.keys), default=-1)

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(items, starts): windows of the words with a key of the item; the starts follow from where the walks stand."""
        out_t, out_s = [], []
        reach = WARM + SPAN * (self.last + 2)
        for a in range(0, len(words) if self.keys else 0, SLICE):
            part = words[a : a + SLICE + reach]
            starts = min(SLICE, len(words) - a)
            part = np.concatenate((part, np.full(starts + reach - len(part), _PAD)))
            symbols = Symbols(part)
            for number in range(WALKS):
                for stretch, places in stretches(part, starts, number, self.short, self.last):
                    for r, steps in enumerate(samples(number, stretch)):
                        held = self.keys.get((number, stretch, r))
                        if held is None:
                            continue
                        pair = symbols.pair(places, steps, salted(number, stretch, r))
                        maybe = np.flatnonzero(self.table.take((pair >> self.shift).view(np.int64), mode="clip"))
                        if not len(maybe):
                            continue
                        keys, item, offset = held
                        key = symbols.whole(places, steps, pair, maybe)
                        lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                        many = hi - lo
                        if many.any():
                            rows = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                            out_t.append(item[rows])
                            out_s.append(a + np.repeat(places[steps[0], maybe], many) - offset[rows])
        if not out_t:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.stack((np.concatenate(out_t), np.concatenate(out_s)), axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def search(self, words: np.ndarray, bounds: np.ndarray):
        """(text, item_id, edits, start, item's words) of every item that a text holds; text j is words[bounds[j]:bounds[j + 1]]."""
        item, start = self.candidates(words)
        size = np.array([len(w) for _, w in self.items], np.int64)
        # A window may begin before its text's first word, or end behind the last; its middle lies inside.
        middle = np.clip(start + size[item] // 2, 0, max(0, len(words) - 1)) if len(item) else start
        text = np.searchsorted(bounds, middle, "right") - 1
        order = np.lexsort((start, item, text))
        item, start, text = item[order], start[order], text[order]
        cuts = np.flatnonzero((item[1:] != item[:-1]) | (text[1:] != text[:-1])) + 1 if len(item) else []
        for group in np.split(np.arange(len(item)), cuts) if len(item) else ():
            t, j = int(item[group[0]]), int(text[group[0]])
            best = self._verified(t, words[bounds[j] : bounds[j + 1]], start[group] - bounds[j])
            if best:
                yield j, self.items[t][0], best[0], best[1], len(self.items[t][1])

    def matches(self, words: np.ndarray):
        """(item_id, edits, start, item's words) of every item one text holds."""
        for _, *found in self.search(words, np.array([0, len(words)])):
            yield tuple(found)

    def _verified(self, t: int, words: np.ndarray, starts: np.ndarray) -> tuple[int, int] | None:
        """(edits, start) of the best stretch near the starts, None beyond the bound."""
        w, e = self.items[t][1], self.edits[t]
        n, found = len(w), None
        # Where walks meet, the edits before have moved them by so many words at most; room for those to come lies behind.
        lo = np.maximum(0, starts - e)
        hi = np.minimum(len(words), starts + n + 2 * e)
        at = 0
        while at < len(starts):
            to, a, z = at + 1, int(lo[at]), int(hi[at])
            while to < len(starts) and lo[to] <= z and hi[to] - a <= 8 * n:
                z = int(hi[to])
                to += 1
            at = to
            part = words[a:z]
            known = self.sorted[t]
            where = np.minimum(np.searchsorted(known, part), len(known) - 1)
            # What is left of the item after its edits stands in the stretch, word by word.
            if np.count_nonzero(known[where] == part) < n - e:
                continue
            edits, end = best_stretch(w, part)
            if edits <= e and (found is None or edits < found[0]):
                found = (edits, max(0, a + end - n))
        return found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, edits, start_word): a row for each document and item it holds."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna().dropDuplicates()
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "n_words", "edits", "start_word")])

    def search(ids, texts) -> DataFrame:
        held = spark.sparkContext.broadcast(ItemIndex(ids, texts))

        def run(batches):
            for b in batches:
                for ids, texts in _batches(b):
                    h, bounds = wordhash.words(texts)
                    rows = [(ids[j], item, n, edits, start) for j, item, edits, start, n in held.value.search(h, bounds)]
                    cols = list(zip(*rows)) if rows else [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

        return source.mapInArrow(run, "doc_id long, item_id long, n_words long, edits long, start_word long")

    out, ids, texts, size = None, [], [], 0
    for r in items.toLocalIterator():
        raw = r["text"].encode()
        if ids and (len(ids) == BLOCK_ITEMS or size + len(raw) > BLOCK_BYTES):
            part = search(ids, texts)
            out, ids, texts, size = part if out is None else out.unionByName(part), [], [], 0
        ids.append(r["item_id"])
        texts.append(raw)
        size += len(raw)
    if ids or out is None:
        part = search(ids, texts)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.min_by(F.struct("n_words", "edits", "start_word"), F.struct("edits", "start_word")).alias("m")).select("doc_id", "item_id", "m.*")
