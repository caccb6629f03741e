"""Vectorised word splitting and hashing over whole texts.

Words are the runs outside of the six ASCII blanks; A-Z are lower-cased. A word's hash
is a polynomial over a table of random 64-bit byte values, so it does not depend on
where the word stands, and a batch of texts is hashed without a Python step per word.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUES = BYTE_VALUES[LOWER]

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)
#: Bytes hashed at a time; a longer word stretches its own step only.
STEP = 1 << 20


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if n > STEP:
        return _series(BASE, n), _series(BASE_INV, n)
    if len(_powers) < n:
        _powers, _inverse = _series(BASE, STEP), _series(BASE_INV, STEP)
    return _powers, _inverse


def _series(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _step(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blank = BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts = edge[~blank[edge]] if len(edge) else edge
    ends = edge[blank[edge]] if len(edge) else edge
    if len(data) and not blank[0]:
        starts = np.concatenate(([0], starts))
    if len(data) and not blank[-1]:
        ends = np.concatenate((ends, [len(data)]))
    powers, inverse = _tables(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_VALUES[data] * powers[: len(data)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * inverse[starts])


def words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the words of text i are hashes[bounds[i]:bounds[i + 1]]."""
    counts = np.zeros(len(texts), np.int64)
    out: list[np.ndarray] = []
    group: list[int] = []
    size = 0

    def flush() -> None:
        if not group:
            return
        data = np.frombuffer(b"\n".join([texts[i] for i in group]), np.uint8)
        starts, _, h = _step(data)
        tops = np.cumsum([len(texts[i]) + 1 for i in group])
        counts[group] = np.diff(np.concatenate(([0], np.searchsorted(starts, tops))))
        out.append(h)

    for i, t in enumerate(texts):
        if not t:
            continue
        if len(t) >= STEP:
            flush()
            group, size = [], 0
            for part in _pieces(t):
                h = _step(part)[2]
                counts[i] += len(h)
                out.append(h)
            continue
        if size + len(t) + 1 > STEP:
            flush()
            group, size = [], 0
        group.append(i)
        size += len(t) + 1
    flush()
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(counts)))


def _pieces(text: bytes):
    """Parts of a long text that end at blanks."""
    data = np.frombuffer(text, np.uint8)
    at = 0
    while at < len(data):
        to = min(len(data), at + STEP - 1)
        while to < len(data):
            ahead = np.flatnonzero(BLANK[data[to : to + STEP]])
            if len(ahead):
                to += int(ahead[0])
                break
            to = min(len(data), to + STEP)
        yield data[at:to]
        at = to


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; a shorter text is one shingle as a whole; none without words."""
    n = len(hashes)
    if n == 0:
        return hashes
    m, width = np.uint64(0xD6E8FEB86659FD93), min(n, k)
    h = np.full(n - width + 1, np.uint64(width), np.uint64)
    for j in range(width):
        h = h * m + hashes[j : n - width + 1 + j]
    return mix(h)
