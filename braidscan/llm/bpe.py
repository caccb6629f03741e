"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A merge list has a *sufficient lookahead*: a number of symbols after which no
continuation of the input can change a token any more. It follows from the list alone
(``sufficient_lookahead``), so an encoder may emit a token as soon as that many
symbols lie behind it, holding a bounded buffer however long a word is. Decoding is a
state machine over the tokens' bytes that holds an incomplete UTF-8 sequence at most.

Defined cases
  null text        as the empty text: no tokens
  empty text       0 tokens, hashes of the empty string
  very long texts  encoded in slices; buffers stay bounded
  repeated rows    each row is encoded
  null doc_id      returned as null with its hashes
  extra columns    ignored
"""

from __future__ import annotations

import array
import codecs
import functools
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a text handled at a time; entries a worker's cache holds per generation.
SLICE_CHARS, CACHE_ENTRIES = 1 << 16, 250_000
END = "</w>"
#: Chunks beyond this many characters are never held packed as a whole.
_LONG = 4 * SLICE_CHARS
_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character standing for each byte: itself where printable, else the next free from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], width=len) -> int:
    """Symbols behind a token's end that settle it.

    Compare the encodings of w and of wx. Up to some boundary they agree; it starts at the
    end of w and moves left over a token u only when rule (u, v) fires in one of them and
    not in the other. The v there grew, by later symbols, from the token that stood at the
    boundary of an *earlier* such rule, so that token lies on the left edge of v's
    derivation. The farthest the boundary gets is hence the heaviest chain of rules in
    rank order linked that way, weighed by the widths of their left parts.
    """
    lefts: dict[str, set[str]] = {}
    reach: dict[str, int] = {}
    most = 0
    for u, v in merges:
        edge, todo = set(), [v]
        while todo:
            t = todo.pop()
            if t not in edge:
                edge.add(t)
                todo += lefts.get(t, ())
        f = width(u) + max((reach.get(t, 0) for t in edge), default=0)
        reach[u] = max(reach.get(u, 0), f)
        most = max(most, f)
        lefts.setdefault(u + v, set()).add(u)
    return most


def check_proper(merges: list[tuple[str, str]], alphabet: Iterable[str]) -> None:
    """Streaming needs every part of a rule to exist before the rule; else tokens may form out of rank order."""
    known = set(alphabet)
    for u, v in merges:
        if u not in known or v not in known:
            raise ValueError(f"merge ({u}, {v}) uses a part that no earlier merge makes")
        known.add(u + v)


class MergeTable:
    def __init__(self, merges: list[tuple[str, str]], vocab: dict[str, int]):
        check_proper(merges, [c for c in vocab if len(c.removesuffix(END)) == 1])
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.vocab = vocab
        self.lookahead = sufficient_lookahead(merges, lambda t: len(t.removesuffix(END)))

    def merged(self, parts: list[str]) -> list[str]:
        """Lowest rank first, leftmost first among equals; only the two neighbours of a merge change rank."""
        rank = self.ranks.get
        none = len(self.ranks)
        scored = [rank(p, none) for p in zip(parts, parts[1:])]
        while scored:
            best = min(scored)
            if best == none:
                break
            i = scored.index(best)
            parts[i] += parts.pop(i + 1)
            del scored[i]
            if i:
                scored[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(scored):
                scored[i] = rank((parts[i], parts[i + 1]), none)
        return parts


class Transducer:
    """Feeds on the symbols of one word; yields tokens as soon as they are stable."""

    def __init__(self, table: MergeTable):
        self.table, self.held = table, ""
        self.room = 4 * table.lookahead + 64

    def feed(self, symbols: str) -> Iterator[str]:
        at = 0
        while at < len(symbols):
            take = symbols[at : at + self.room]
            at += len(take)
            self.held += take
            if len(self.held) > 2 * self.room:
                # The last symbol may yet turn out to end the word, so it never counts as settled.
                stable = len(self.held) - 1 - self.table.lookahead
                done = 0
                for token in self.table.merged(list(self.held)):
                    if done + len(token) > stable:
                        break
                    done += len(token)
                    yield token
                self.held = self.held[done:]

    def finish(self) -> Iterator[str]:
        if self.held:
            yield from self.table.merged([*self.held[:-1], self.held[-1] + END])
        self.held = ""


class TextMachine:
    """Incremental decoder from token ids to text.

    Every id stands for some bytes; a UTF-8 state machine turns them into text and keeps at
    most three pending bytes between calls. ``spaced`` gives the vocabulary's own strings,
    each after the first led by a blank, as a tokenizer without a decoder prints them;
    otherwise ids give the bytes they encode, and a word's end becomes a blank.
    """

    def __init__(self, spaced: bool, raw: dict[int, bytes]):
        self.spaced, self.raw, self.first = spaced, raw, True
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        data = b"".join(map(self.raw.__getitem__, ids))
        if self.spaced and self.first and data:
            data, self.first = data[1:], False
        return self.utf8.decode(data)

    def close(self) -> str:
        return self.utf8.decode(b"", True)


class WordBpe:
    """A tokenizer file of the byte-level, word-ending kind: NFC, lower case, white space dropped."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        self.table = MergeTable(merges, spec["model"]["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        # Python's \s also takes four separator controls that the file's engine does not.
        self.pieces = regex.compile(split.replace(r"[^\s", r"[^\p{White_Space}"))
        self.blank = regex.compile(r"\p{White_Space}+")
        self.alphabet = byte_alphabet()
        names = {i: t for t, i in self.table.vocab.items()} | {i: t for t, i in self.special.items()}
        byte_of = {c: bytes([b]) for b, c in enumerate(self.alphabet)}
        #: The bytes of each id, by what the machine prints: strings led by blanks, or the bytes behind them.
        self.printed = {i: b" " + t.encode() for i, t in names.items()}
        self.plain = {
            i: t.encode() if t in self.special else b"".join(byte_of[c] for c in t.removesuffix(END)) + b" " * t.endswith(END) for i, t in names.items()
        }
        self.words: dict[str, bytes] = {}
        self.fresh: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def tokens_of(self, piece: str) -> Iterator[str]:
        """The tokens of one word, as the transducer settles them."""
        word = Transducer(self.table)
        for at in range(0, len(piece), SLICE_CHARS):
            part = piece[at : at + SLICE_CHARS]
            yield from word.feed(part if part.isascii() and part.isprintable() else "".join(map(self.alphabet.__getitem__, part.encode())))
        yield from word.finish()

    def _packed(self, tokens: Iterable[str]) -> bytes:
        """Ids as little-endian 32-bit integers; what the vocabulary lacks is left out."""
        vocab = self.table.vocab
        return array.array("I", [vocab[t] for t in tokens if t in vocab]).tobytes()

    def _word(self, piece: str) -> bytes:
        """A word's ids; short words come from the transducer once and then from a cache of its outputs."""
        found = self.words.get(piece)
        if found is None:
            found = self._packed(self.tokens_of(piece))
            if len(piece) <= 64:
                if len(self.words) >= CACHE_ENTRIES // 2:
                    self.words = {}
                self.words[piece] = found
        return found

    def _cached(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            found = b"".join(map(self._word, self.pieces.findall(chunk)))
        if len(chunk) <= 64:
            if len(self.fresh) >= CACHE_ENTRIES:
                self.old, self.fresh = self.fresh, {}
            self.fresh[chunk] = found
        return found

    def _normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower case goes by the character, not by its place in the word
        return text.lower()

    def _slices(self, text: str) -> Iterator[str]:
        """Parts of about SLICE_CHARS that end at white space."""
        at = 0
        while at < len(text):
            to = at + SLICE_CHARS
            if to < len(text):
                m = self.blank.search(text, to)
                to = m.start() if m else len(text)
            yield text[at:to]
            at = to

    def _segment(self, text: str) -> Iterator[bytes]:
        for part in self._slices(text):
            low = self._normal(part)
            if _SEPARATORS.search(low):
                chunks = [c for c in self.blank.split(low) if c]
            else:
                chunks = low.split()
            if any(map(_LONG.__lt__, map(len, chunks))):
                for c in chunks:
                    if len(c) > _LONG:
                        yield from self._long(c)
                    else:
                        yield self._cached(c)
                continue
            got = list(map(self.fresh.get, chunks))
            if None in got:
                got = [self._cached(c) if g is None else g for g, c in zip(got, chunks)]
            yield b"".join(got)

    def _long(self, chunk: str) -> Iterator[bytes]:
        held: list[str] = []
        for m in self.pieces.finditer(chunk):
            for t in self.tokens_of(m[0]):
                held.append(t)
                if len(held) == 4096:
                    yield self._packed(held)
                    held = []
        if held:
            yield self._packed(held)

    def stream(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian 32-bit integers, part by part."""
        if self.specials is None or not self.specials.search(text):
            yield from self._segment(text)
            return
        for part in self.specials.split(text):
            if part in self.special:
                yield struct.pack("<I", self.special[part])
            elif part:
                yield from self._segment(part)

    def machine(self, spaced: bool = True) -> TextMachine:
        return TextMachine(spaced, self.printed if spaced else self.plain)

    def encode(self, text: str | None) -> list[int]:
        raw = b"".join(self.stream(text or ""))
        return list(struct.unpack(f"<{len(raw) // 4}I", raw))

    def decode(self, ids: Iterable[int], spaced: bool = True) -> str:
        machine = self.machine(spaced)
        return machine.push(i for i in ids if i in machine.raw) + machine.close()

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Token count and the two hashes: ids as the transducer emits them, text as the machine decodes these ids."""
        n, ids, words, machine = 0, hashlib.sha256(), hashlib.sha256(), self.machine()
        for raw in self.stream(text or ""):
            ids.update(raw)
            words.update(machine.push(array.array("I", raw)).encode())
            n += len(raw) // 4
        words.update(machine.close().encode())
        return n, ids.hexdigest(), words.hexdigest()


def read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(maxsize=2)
def _built(file: bytes) -> WordBpe:
    return WordBpe(file)


def load(path: str) -> WordBpe:
    return _built(read(path))


def tokenize(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text (and the ids themselves if asked for)."""
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [pa.field("ids", pa.list_(pa.int32()))] * with_ids)

    # The driver reads the file; executors need not see its folder.
    file = docs.sparkSession.sparkContext.broadcast(read(tokenizer_path))

    def run(batches):
        bpe = _built(file.value)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            rows = [bpe.digests(t.as_py()) for t in texts]
            cols = [ids, *(list(c) for c in zip(*rows))] if rows else [[], [], [], []]
            if with_ids:
                cols.append([bpe.encode(t.as_py()) for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, ddl)
