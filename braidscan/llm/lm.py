"""Gated recurrent language model over words, with corpus counts behind it.

Chunks: every text is read and split once, into places in a list of its chunk's distinct words.
Counts: every word of all training texts is counted (what is gathered grows with the corpus).
Model: the MODEL_WORDS most frequent words and the end mark fall into classes by frequency, all
other words into TAIL classes by their shape. A GRU reads the text; a softmax over classes,
then one over the words of the class, gives a word's probability. Inside a tail class a word has
its smoothed share of the class's counts, so every word, seen or not, has a probability.
Training: truncated backpropagation in numpy. A warm start on a bounded sample on the driver
(WARM_TOKENS, drawn by hash from the whole corpus), then one pass over all training texts, dealt by
hash into AVERAGINGS parts: in each, every partition trains from the common weights on its texts of
the part (long ones in pieces, all of them), and the weights are averaged by tokens. Scoring carries
the state across windows through the whole text.

Defined cases
  null or empty text   one token, the end mark
  null doc_id          scored, never learned from; held_out false
  no training text     base and model fall back to the smoothed empty corpus
  repeated rows        each row is scored (and learned from)
  extra columns        ignored
"""

from __future__ import annotations

import math
from array import array
from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidscan.llm.counts import frequent
from braidscan.llm.ngram_join import _batches
from braidscan.runtime import Scratch

#: Words of the model (with the end mark), words of a class, words whose counts travel to the tasks.
MODEL_WORDS, CLASS_WORDS, KNOWN_WORDS = 1024, 32, 200_000
#: Tail classes by shape; units; lanes; steps of a window; tokens packed at once.
TAIL, UNITS, LANES, WINDOW, PACK_TOKENS = 32, 20, 256, 12, 3_000_000
#: Lanes when weights stay as they are: how many changes no score.
SCORE_LANES = 1024
#: Rows whose class probabilities are computed at once.
BLOCK = LANES * WINDOW
#: Bounded sample of the warm start, in tokens and texts; its passes; how often weights are averaged; how many sums meet on the driver.
WARM_TOKENS, WARM_TEXTS, WARM_PASSES, AVERAGINGS, SLOTS = 400_000, 20_000, 2, 4, 8
#: Distinct words and tokens above which a chunk ends; how its wide rows are written, lest many of them are held at once.
CHUNK_WORDS, CHUNK_TOKENS = 100_000, 1_000_000
WIDE_ROWS = {"parquet.block.size": 32 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}
CLASSES = MODEL_WORDS // CLASS_WORDS + TAIL
F32 = np.float32


def words_of(text: bytes | None) -> list[bytes]:
    """Words outside of the six ASCII blanks, A-Z lower-cased."""
    return (text or b"").lower().split()


def shapes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The tail class of each word data[bounds[i] : bounds[i + 1]], none empty: accents, how it ends, how long it is."""
    last = data[bounds[1:] - 1]
    point = np.isin(last, np.frombuffer(b".,;:?", np.uint8))
    digit = (last >= 48) & (last <= 57)
    letter = ((last >= 97) & (last <= 122)) | (last >= 128)
    end = np.select([letter, point, digit], [0, 1, 2], 3)
    accents = np.concatenate(([0], np.cumsum(data >= 128)))
    size = np.minimum(3, (np.diff(bounds) - 1) // 4)
    return (16 * (accents[bounds[1:]] > accents[bounds[:-1]]) + 4 * end + size).astype(np.int32)


def bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words and where each begins, the end at last."""
    if not len(words):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    words = words.cast(pa.string())
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(words.buffers()[2], np.uint8)[: at[-1]], at


class Chunk:
    """Texts as places in the list of their distinct words; the end mark is the empty word, at place 0."""

    def __init__(self):
        self.place: defaultdict = defaultdict()
        self.place.default_factory = self.place.__len__
        self.place[b""] = 0
        self.ids, self.sizes, self.doc_ids, self.learns = array("I"), [], [], []

    def add(self, doc_id: int | None, text: bytes | None, learns: bool) -> None:
        words = words_of(text)
        self.ids.extend(map(self.place.__getitem__, words))
        self.ids.append(0)
        self.sizes.append(len(words) + 1)
        self.doc_ids.append(doc_id)
        self.learns.append(learns)

    def full(self) -> bool:
        return len(self.place) > CHUNK_WORDS or len(self.ids) >= CHUNK_TOKENS

    def row(self) -> list:
        """doc_ids, sizes, ids, words (no word holds a line feed), how often the texts to learn from hold each."""
        self.place.default_factory = None
        ids, sizes = np.frombuffer(self.ids, np.uint32), np.array(self.sizes, np.int64)
        times = np.bincount(ids[np.repeat(self.learns, sizes)], minlength=len(self.place))
        return [self.doc_ids, sizes.tobytes(), ids.tobytes(), b"\n".join(self.place), times.astype(np.uint32).tobytes()]


CHUNKS = pa.schema([("doc_ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("sizes", "ids", "words", "times"))])


def chunks(docs: DataFrame) -> DataFrame:
    """A row for each Chunk of (doc_id, text, learns): every text is split here, once, for its counts and for the model."""

    def row(chunk):
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(chunk.row(), CHUNKS)], schema=CHUNKS)

    def run(batches):
        chunk = Chunk()
        for b in batches:
            learns = iter(b.column(2).to_pylist())
            for doc_ids, texts in _batches(b):
                for doc_id, text in zip(doc_ids, texts):
                    chunk.add(doc_id, text, next(learns))
                    if chunk.full():
                        yield row(chunk)
                        chunk = Chunk()
        if chunk.sizes:
            yield row(chunk)

    return docs.select("doc_id", "text", "learns").mapInArrow(run, "doc_ids array<long>, sizes binary, ids binary, words binary, times binary")


def listed(words: bytes) -> pa.Array:
    """The words of a chunk's row."""
    raw = np.frombuffer(words, np.uint8)
    cuts = np.flatnonzero(raw == 10)
    bounds = np.concatenate(([0], cuts - np.arange(len(cuts)), [len(raw) - len(cuts)])).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(raw[raw != 10])])


def count_words(parts: DataFrame) -> DataFrame:
    """(word, c) over all texts to learn from, of their chunks; the end mark is the empty word."""
    schema = pa.schema([("word", pa.string()), ("c", pa.int64())])

    def run(batches):
        for b in batches:
            for words, times in zip(b.column(0), b.column(1)):
                c = pa.array(np.frombuffer(times.as_py(), np.uint32).astype(np.int64))
                rows = pa.RecordBatch.from_arrays([listed(words.as_py()), c], schema=schema)
                yield rows.filter(pc.greater(c, 0))

    return parts.select("words", "times").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """What the tasks know of the corpus: its totals, the known words, the tail classes' sums."""

    def __init__(self, top: list[tuple[str, int]], total: int, distinct: int, tail: dict[int, tuple[int, int]]):
        self.total, self.distinct = total, distinct
        self.index = {w.encode(): i for i, (w, _) in enumerate(top)}
        self.log_c = np.array([math.log10(c + 1) for _, c in top] + [0.0])
        # Model ids: the end mark is 0, then the most frequent words, then the tail classes.
        model = np.zeros(len(top) + 1, np.uint16)
        at = [i for i, (w, _) in enumerate(top) if w]
        model[at[: MODEL_WORDS - 1]] = np.arange(1, 1 + len(at[: MODEL_WORDS - 1]))
        rest = at[MODEL_WORDS - 1 :]
        model[rest] = MODEL_WORDS + shapes(*bytes_of(pa.array([top[i][0] for i in rest], pa.string())))
        self.model = model
        self.tail_log = np.array([math.log10(sum(tail.get(k, (0, 0))) + 1) for k in range(TAIL)])

    def encode(self, words: bytes, ids: np.ndarray, starts: np.ndarray):
        """Of a chunk's texts: model ids of all tokens; by text the sum of known log10(c + 1), the same of tail words, known
        tokens; then (text, place of its word, times) of rare words."""
        split = words.split(b"\n")
        at = np.fromiter(map(self.index.get, split, repeat(-1)), np.int64, len(split))
        model, logs, known = self.model[at], self.log_c[at], at >= 0
        rare = ~known
        rare[0] = False  # the end mark
        model[rare] = MODEL_WORDS + shapes(*bytes_of(listed(words).filter(pa.array(rare))))
        by_word = (logs, np.where(model >= MODEL_WORDS, logs, 0.0), known.astype(np.int64))
        sums = [np.add.reduceat(x.take(ids), starts) for x in by_word]
        place = np.flatnonzero(rare.take(ids))
        text = np.searchsorted(starts, place, "right") - 1
        found, times = np.unique(text * len(at) + ids[place], return_counts=True)
        return model.take(ids), *sums, (found // len(at), found % len(at), times)

    def read(self, text: bytes | None):
        """The same of one text."""
        chunk = Chunk()
        chunk.add(None, text, False)
        _, _, ids, words, _ = chunk.row()
        return self.encode(words, np.frombuffer(ids, np.uint32), np.zeros(1, np.int64))


def lanes_of(docs: list[np.ndarray], lanes: int) -> list[list[int]]:
    """Documents dealt to lanes, longest first to the shortest lane; lanes come longest first."""
    import heapq

    heap = [(0, k) for k in range(min(lanes, len(docs)))]
    dealt: list[list[int]] = [[] for _ in heap]
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        size, k = heapq.heappop(heap)
        dealt[k].append(d)
        heapq.heappush(heap, (size + len(docs[d]), k))
    return sorted(dealt, key=lambda ds: -sum(len(docs[d]) for d in ds))


def pieces(docs: list[np.ndarray]) -> list[np.ndarray]:
    """Texts to learn from, cut to a lane's share, lest the last updates follow the longest text alone."""
    share = max(64 * WINDOW, -(-sum(map(len, docs)) // LANES))
    return [d[at : at + share] for d in docs for at in range(0, len(d), share)]


class Gru:
    """Weights and passes of the network. Inputs are the previous token; a text starts from the start mark.

    All weights are views of one flat vector, so that an update is a few passes over that vector.
    """

    INPUTS, INNER = MODEL_WORDS + TAIL + 1, MODEL_WORDS // CLASS_WORDS
    #: Inputs; state to gates, classes and words, each with its bias as a last row or column.
    SHAPES = {"x": (INPUTS, 3 * UNITS), "gates": (UNITS + 1, 3 * UNITS), "classes": (UNITS + 1, CLASSES), "words": (INNER, CLASS_WORDS, UNITS + 1)}
    SIZE = sum(math.prod(s) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray | None = None):
        rng = np.random.Generator(np.random.PCG64(7))
        self.flat = np.zeros(self.SIZE, F32) if flat is None else flat.astype(F32)
        self.w = self._views(self.flat)
        if flat is None:
            for k, scale in (("x", 0.1), ("wh", 1 / math.sqrt(UNITS)), ("uc", 0.1), ("uw", 0.1)):
                self.w[k][:] = rng.standard_normal(self.w[k].shape) * scale
        self.slope = self.m = self.v = None
        self.steps = 0

    @classmethod
    def _views(cls, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The parts of a flat vector by name, and their parts without biases: wh, uc, uw."""
        out, at = {}, 0
        for k, shape in cls.SHAPES.items():
            out[k] = flat[at : at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
        out |= {"wh": out["gates"][:UNITS], "uc": out["classes"][:UNITS], "uw": out["words"].reshape(MODEL_WORDS, UNITS + 1)[:, :UNITS]}
        return out

    def forward(self, h: np.ndarray, inputs: np.ndarray, keep: bool = True):
        """States after each step of a window (steps, units, lanes), with what the backward pass needs, of the last step unless kept.

        Lanes come last, so that the parts of the gates are flat arrays.
        """
        w, n, (u, lanes) = self.w, UNITS, inputs.shape
        live = (inputs != self.INPUTS - 1).astype(F32)
        held = u if keep else 1
        hs, prev, c = np.empty((u + 1, n, lanes), F32), np.ones((held, n + 1, lanes), F32), np.empty((held, n, lanes), F32)
        a, zr = np.empty((held, 3 * n, lanes), F32), np.empty((held, 2 * n, lanes), F32)
        gates = w["gates"].T
        hs[0] = h
        for t in range(u):
            at = t % held
            before, g, new = prev[at, :n], zr[at], c[at]
            np.multiply(hs[t], live[t], out=before)
            np.matmul(gates, prev[at], out=a[at])
            x = w["x"].take(inputs[t], axis=0).T
            np.add(x[: 2 * n], a[at, : 2 * n], out=g)
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += F32(1)
            np.reciprocal(g, out=g)
            np.multiply(g[n:], a[at, 2 * n :], out=new)
            new += x[2 * n :]
            np.tanh(new, out=new)
            np.subtract(before, new, out=hs[t + 1])
            hs[t + 1] *= g[:n]
            hs[t + 1] += new
        return hs, (live, prev, zr, c, a)

    @staticmethod
    def _bound(weights: np.ndarray) -> float:
        """What no product of a state, within -1 and 1, and a row of weights exceeds."""
        return (UNITS + 1) * max(float(weights.max()), -float(weights.min()))

    @staticmethod
    def _softmax(x: np.ndarray, bound: float, own: np.ndarray | None = None) -> tuple[np.ndarray | None, np.ndarray]:
        """Natural log probabilities of the entries `own`, if any, and the sums by which x, from now on exponentials, is to be divided."""
        if bound > 60:  # else no sum can leave the range of single precision
            np.clip(x, -60, 60, out=x)
        at = None if own is None else x.take(np.arange(0, x.size, x.shape[1]) + own)
        np.exp(x, out=x)
        total = x @ np.ones(x.shape[1], F32)
        return None if at is None else at - np.log(total), total

    def outputs(self, hid: np.ndarray, target: np.ndarray, slope: dict | None = None):
        """Natural log probabilities of the targets (a tail word's share of its class left out); or, where weights learn, the slopes of the states."""
        w, rows = self.w, len(target)
        cls = np.where(target < MODEL_WORDS, target // CLASS_WORDS, self.INNER + target - MODEL_WORDS).astype(np.uint16)
        order = np.argsort(cls, kind="stable")  # rows of a class lie together
        held = np.ones((rows, UNITS + 1), F32)
        held[:, :UNITS] = hid.take(order, axis=0)
        cls, target = cls[order], target[order]
        cuts = np.searchsorted(cls, np.arange(self.INNER + 1))
        bound = self._bound(w["classes"])
        logits, total, logs = np.empty((min(rows, BLOCK), CLASSES), F32), np.empty(0, F32), np.empty(rows, F32)
        for k in range(0, rows, BLOCK):  # one block when weights learn
            part = slice(k, min(rows, k + BLOCK))
            logits = logits[: part.stop - k]
            np.matmul(held[part], w["classes"], out=logits)
            if slope is None:
                logs[part], total = self._softmax(logits, bound, cls[part])
            else:
                _, total = self._softmax(logits, bound)
        m = int(cuts[-1])  # rows that have a word of the model
        inner = np.empty((m, CLASS_WORDS), F32)
        parts = [(k, slice(x, y)) for k, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if y > x]
        for k, part in parts:
            np.matmul(held[part], w["words"][k].T, out=inner[part])
        own = target[:m] - cls[:m].astype(target.dtype) * CLASS_WORDS
        bound = self._bound(w["words"])
        if slope is None:
            logs[:m] += self._softmax(inner, bound, own)[0]
            out = np.empty(rows, F32)
            out[order] = logs
            return out
        # The slope is (logits - total where own) / total; states are divided, as they are the narrower ones.
        share = (1 / total)[:, None]
        logits.reshape(-1)[np.arange(0, logits.size, CLASSES) + cls] -= total
        np.matmul((held * share).T, logits, out=slope["classes"])
        d = logits @ w["uc"].T
        d *= share
        slope["words"][:] = 0
        if m:
            inner *= (1 / self._softmax(inner, bound)[1])[:, None]
            inner.reshape(-1)[np.arange(0, inner.size, CLASS_WORDS) + own] -= 1
            d_inner = np.empty((m, UNITS), F32)
            for k, part in parts:
                x = inner[part]
                np.matmul(x.T, held[part], out=slope["words"][k])
                np.matmul(x, w["words"][k, :, :UNITS], out=d_inner[part])
            d[:m] += d_inner
        d_hid = np.empty_like(d)
        d_hid[order] = d
        return d_hid

    def backward(self, inputs, hs, kept, d_out, slope) -> None:
        """Through the window's steps only: the truncation."""
        n, (u, lanes) = UNITS, inputs.shape
        live, prev, zr, c, a = kept
        gx, ga = np.empty((u, lanes, 3 * n), F32), np.empty((u, 3 * n, lanes), F32)
        dh, g = np.zeros((n, lanes), F32), np.empty((3 * n, lanes), F32)
        stay, part = np.empty((n, lanes), F32), np.empty((n, lanes), F32)
        for t in range(u - 1, -1, -1):
            # Slopes of the gates before their curves, step by step, as a step's arrays are small enough to stay near the CPU.
            z, r, new = zr[t, :n], zr[t, n:], c[t]
            dh += d_out[t].T
            np.subtract(1, z, out=stay)
            stay *= dh
            np.subtract(prev[t, :n], new, out=part)
            part *= z
            np.multiply(part, stay, out=g[:n])
            np.multiply(new, new, out=part)
            np.subtract(1, part, out=part)
            to_c = g[2 * n :]
            np.multiply(part, stay, out=to_c)
            ga_c = ga[t, 2 * n :]
            np.multiply(to_c, r, out=ga_c)
            np.subtract(1, r, out=part)
            part *= a[t, 2 * n :]
            np.multiply(part, ga_c, out=g[n : 2 * n])
            ga[t, : 2 * n] = g[: 2 * n]
            gx[t] = g.T
            dh *= z
            dh += self.w["wh"] @ ga[t]
            dh *= live[t]
        np.matmul(prev, ga.transpose(0, 2, 1)).sum(0, out=slope["gates"])
        slope["x"][:] = 0
        read = inputs.ravel().astype(np.uint16)
        order = np.argsort(read, kind="stable")
        read = read[order]
        first = np.flatnonzero(np.concatenate(([True], read[1:] != read[:-1])))
        slope["x"][read[first]] = np.add.reduceat(gx.reshape(-1, 3 * n).take(order, axis=0), first, axis=0)

    def adam(self, rate: float) -> None:
        self.steps += 1
        fix = rate * math.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        g = self.slope
        np.clip(g, -1, 1, out=g)
        part = g - self.m
        part *= F32(0.1)
        self.m += part
        np.multiply(g, g, out=part)
        part -= self.v
        part *= F32(0.01)
        self.v += part
        np.sqrt(self.v, out=part)
        part += F32(1e-6)
        np.divide(self.m, part, out=part)
        part *= F32(fix)
        self.flat -= part

    def run(self, docs: list[np.ndarray], rate: float | None = None) -> np.ndarray:
        """Natural log probability of each document; with a rate, weights learn instead, and zeros return."""
        scores = np.zeros(len(docs))
        dealt = lanes_of(docs, LANES if rate else SCORE_LANES)
        if not dealt:
            return scores
        # Lanes lie one after the other in flat arrays, so a very long text does not widen the others' lanes.
        order = [d for ds in dealt for d in ds]
        token = np.concatenate([docs[d] for d in order])
        owner = np.repeat(order, [len(docs[d]) for d in order]).astype(np.int32)
        reads = np.full(len(token), self.INPUTS - 1, np.int32)
        reads[1:] = np.where(owner[1:] == owner[:-1], token[:-1], self.INPUTS - 1)
        sizes = np.array([sum(len(docs[d]) for d in ds) for ds in dealt])
        first = np.cumsum(sizes) - sizes
        h = np.zeros((UNITS, len(sizes)), F32)
        slope = None
        if rate:
            if self.m is None:
                self.slope, self.m, self.v = (np.zeros(self.SIZE, F32) for _ in range(3))
            slope = self._views(self.slope)
        for at in range(0, int(sizes[0]), WINDOW):
            lanes = int(np.searchsorted(-sizes, -at, "left"))
            steps = np.arange(at, min(at + WINDOW, int(sizes[0])))[:, None]
            place = steps + first[None, :lanes]
            live = None  # all of it; lanes come longest first, so the last one tells
            if steps[-1, 0] >= sizes[lanes - 1]:
                live = steps < sizes[None, :lanes]
                inputs = np.where(live, reads[np.where(live, place, 0)], self.INPUTS - 1)
                place, live = place[live], live.ravel()
            else:
                inputs, place = reads[place], place.ravel()
            hs, kept = self.forward(h[:, :lanes], inputs, bool(rate))
            h = hs[-1]
            hid, target = hs[1:].transpose(0, 2, 1).reshape(-1, UNITS), token[place]
            hid = hid if live is None else hid[live]
            out = self.outputs(hid, target, slope)
            if not rate:
                scores += np.bincount(owner[place], weights=out, minlength=len(docs))
            else:
                d_out = out
                if live is not None:
                    d_out = np.zeros((inputs.size, UNITS), F32)
                    d_out[live] = out
                self.backward(inputs, hs, kept, d_out.reshape(*inputs.shape, UNITS), slope)
                self.slope *= F32(1 / 64)
                self.adam(rate)
        return scores


def _encoded(parts: DataFrame, lexicon) -> DataFrame:
    """A row for each text of the chunks: its model ids (16 bits each), sums over known words, and its rare words."""
    rare_type = pa.list_(pa.struct([("word", pa.string()), ("k", pa.int64())]))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary()), ("known", pa.int64()), ("base", pa.float64()), ("tail", pa.float64()), ("rare", rare_type)])

    def run(batches):
        lex, seq = lexicon.value, TaskContext.get().partitionId() << 40
        for b in batches:
            for i in range(b.num_rows):
                sizes, ids = (np.frombuffer(b.column(k)[i].as_py(), t) for k, t in ((1, np.int64), (2, np.uint32)))
                words, n = b.column(3)[i].as_py(), len(sizes)
                ends = np.concatenate(([0], np.cumsum(sizes)))
                model, base, tail, known, (text, place, times) = lex.encode(words, ids, ends[:-1])
                pairs = pa.StructArray.from_arrays([listed(words).take(pa.array(place)), pa.array(times, pa.int64())], names=["word", "k"])
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32()), pairs)
                raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(model)])
                row = pa.array(np.arange(seq, seq + n), pa.int64())
                yield pa.RecordBatch.from_arrays([row, b.column(0)[i].values, raw, pa.array(known), pa.array(base), pa.array(tail), rare], schema=schema)
                seq += n

    ddl = "row long, doc_id long, ids binary, known long, base double, tail double, rare array<struct<word:string,k:long>>"
    return parts.select("doc_ids", "sizes", "ids", "words").mapInArrow(run, ddl)


def _packs(batches):
    """Encoded texts read until PACK_TOKENS are together: lists of (row, ids)."""
    held, size = [], 0
    for b in batches:
        for row, raw in zip(b.column(0).to_pylist(), b.column(1)):
            ids = np.frombuffer(raw.as_py(), np.uint16).astype(np.int32)
            held.append((row, ids))
            size += len(ids)
            if size >= PACK_TOKENS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _sample(encoded: DataFrame) -> list[np.ndarray]:
    """Texts of about WARM_TOKENS tokens by the hashes of their ids, wherever they lie in the table."""
    size = F.octet_length("ids") / 2
    total = encoded.agg(F.sum(size).alias("n")).first()["n"] or 0
    drawn = F.pmod(F.xxhash64("doc_id", "ids"), F.lit(1 << 20))
    part = encoded.filter(drawn < math.ceil((1 << 20) * min(1.0, 1.5 * WARM_TOKENS / max(total, 1)))).select(drawn.alias("at"), size.alias("n"), "row")
    # The lengths first: of a few texts above the bound none is read.
    rows, held = [], 0
    for r in part.orderBy("at", "row").toLocalIterator():
        if held + r["n"] <= WARM_TOKENS or not rows:
            rows.append(r["row"])
            held += int(r["n"])
        if held >= WARM_TOKENS or len(rows) == WARM_TEXTS:
            break
    found = encoded.filter(F.col("row").isin(rows)).select("row", F.substring("ids", 1, 2 * WARM_TOKENS).alias("ids")).collect() if rows else []
    return [np.frombuffer(bytes(r["ids"]), np.uint16).astype(np.int32) for r in sorted(found, key=lambda r: r["row"])]


def train(encoded: DataFrame) -> Gru:
    """The warm start, then one pass over all of the encoded texts in AVERAGINGS parts, the weights averaged after each."""
    spark = encoded.sparkSession
    gru, sample = Gru(), _sample(encoded)
    # A corpus smaller than the sample's bound is read more often, so that as many tokens are seen.
    passes = min(8 * WARM_PASSES, max(WARM_PASSES, WARM_PASSES * WARM_TOKENS // max(1, sum(map(len, sample)))))
    for p in range(passes):
        gru.run(pieces(sample), 0.01 if 2 * p < passes else 0.005)
    schema = pa.schema([("slot", pa.int32()), ("n", pa.int64()), ("weights", pa.binary())])

    def local(start):
        def run(batches):
            own, n = Gru(start.value), 0
            for pack in _packs(batches):
                own.run(pieces([ids for _, ids in pack]), 0.003)
                n += sum(len(ids) for _, ids in pack)
            if n:
                slot = TaskContext.get().partitionId() % SLOTS
                yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([n], pa.int64()), pa.array([(own.flat.astype(np.float64) * n).tobytes()], pa.binary())], schema=schema)

        return run

    def add(batches):
        # Sums of a task's rows, row by row; no group has to be in memory.
        total, n = None, 0
        for b in batches:
            for k, x in zip(b.column(1).to_pylist(), b.column(2)):
                v = np.frombuffer(x.as_py(), np.float64)
                total, n = (v.copy() if total is None else total + v), n + k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], schema=schema)

    turn = F.pmod(F.xxhash64("row"), F.lit(AVERAGINGS))
    for k in range(AVERAGINGS):
        part = encoded.filter(turn == k).select("row", "ids").mapInArrow(local(spark.sparkContext.broadcast(gru.flat)), "slot int, n long, weights binary")
        total, n = None, 0
        for r in part.repartition(SLOTS, "slot").mapInArrow(add, "slot int, n long, weights binary").collect():
            v = np.frombuffer(bytes(r["weights"]), np.float64)
            total, n = (v.copy() if total is None else total + v), n + r["n"]
        gru = gru if total is None else Gru(total / n)
    return gru


def _tail_sums(counts: DataFrame, skip: DataFrame) -> dict[int, tuple[int, int]]:
    """Occurrences and distinct words of each tail class."""
    schema = pa.schema([("cls", pa.int32()), ("n", pa.int64()), ("v", pa.int64())])

    def run(batches):
        n, v = np.zeros(TAIL, np.int64), np.zeros(TAIL, np.int64)
        for b in batches:
            cls = shapes(*bytes_of(b.column(0)))
            np.add.at(n, cls, b.column(1).to_numpy())
            v += np.bincount(cls, minlength=TAIL)
        own = np.flatnonzero(v).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own]), pa.array(v[own])], schema=schema)

    tail = counts.filter("word <> ''").join(F.broadcast(skip), "word", "left_anti").select("word", "c").mapInArrow(run, "cls int, n long, v long")
    return {r["cls"]: (r["n"], r["v"]) for r in tail.groupBy("cls").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}


def score_documents(docs: DataFrame, fold: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fold_of = F.crc32(F.col("doc_id").cast("string")) % fold
    learns = F.coalesce(fold_of != held, F.lit(False)).alias("learns")
    texts = scratch.put(chunks(docs.select("doc_id", "text", learns)), "chunks", **WIDE_ROWS)
    counts = scratch.put(count_words(texts), "counts")
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, distinct = sums["n"] or 0, sums["v"]
    top = [(r["word"], r["c"]) for r in frequent(counts, F.col("c"), KNOWN_WORDS)]
    model_words = [w for w, _ in top if w][: MODEL_WORDS - 1]
    skip = spark.createDataFrame([(w,) for w in model_words], "word string")
    lexicon = Lexicon(top, total, distinct, _tail_sums(counts, skip))
    part = scratch.put(_encoded(texts, spark.sparkContext.broadcast(lexicon)), "encoded")
    scratch.drop("chunks")
    gru = train(part.filter(fold_of != held))

    shared = spark.sparkContext.broadcast((gru.flat, lexicon.tail_log))
    schema = pa.schema([("row", pa.int64()), ("n_tokens", pa.int64()), ("model", pa.float64())])

    def run(batches):
        flat, tail_log = shared.value
        net = Gru(flat)
        for pack in _packs(batches):
            logs = net.run([ids for _, ids in pack]) / math.log(10)
            inside = [float(tail_log[ids[ids >= MODEL_WORDS] - MODEL_WORDS].sum()) for _, ids in pack]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in pack], pa.int64()), pa.array([len(ids) for _, ids in pack], pa.int64()), pa.array(logs - np.array(inside))], schema=schema)

    scored = scratch.put(part.select("row", "ids").mapInArrow(run, "row long, n_tokens long, model double"), "scored")
    # Words beyond the known ones meet their counts in a join; frequent words never get here.
    rare = part.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k").join(counts, "word")
    added = rare.groupBy("row").agg(F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("k").alias("seen"))
    out = part.select("row", "doc_id", "known", "base", "tail").join(scored, "row").join(added, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    per_token = math.log10(total + distinct + 1)
    return out.select(
        "doc_id",
        F.coalesce(fold_of == held, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        (F.col("model") + F.col("tail") + more).alias("score"),
    )
