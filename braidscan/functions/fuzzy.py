"""Context-triggered piecewise hashes of whole byte strings, and their likeness from 0 to 100 (Kornblum 2006)."""

from __future__ import annotations

import re

import numpy as np

# Rolling window, least block, signature length, digest alphabet, piece hash multiplier and start.
WINDOW, LEAST, LENGTH = 7, 3, 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
PRIME, START = 0x01000193, 0x28021967

# A digest character shows the low six bits of the piece hash, and these follow from six bits alone.
_STEP = [[((h * PRIME) ^ c) & 63 for c in range(256)] for h in range(64)]


def rolling(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: sum, weighted sum and shifted xor of the last WINDOW bytes."""
    padded = np.concatenate((np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32)))
    n, total = len(data), np.zeros(len(data), np.uint32)
    shifted = np.zeros(n, np.uint32)
    for back in range(WINDOW):
        x = padded[WINDOW - 1 - back : WINDOW - 1 - back + n]
        total += x * np.uint32(1 + WINDOW - back)
        shifted ^= x << np.uint32(5 * back)
    return total + shifted


def _signature(data: bytes, cuts: np.ndarray, length: int) -> str:
    ends = [*(cuts[: length - 1] + 1).tolist()]
    out, at = [], 0
    for end in [*ends, len(data)]:
        h = START & 63
        for c in data[at:end]:
            h = _STEP[h][c]
        if end > at or end in ends:
            out.append(ALPHABET[h])
        at = end
    return "".join(out)


def fuzzy_hash(data: bytes) -> str:
    """block:signature:signature at twice the block; of an empty string 3::."""
    roll = rolling(np.frombuffer(data, np.uint8)).astype(np.int64)
    block = LEAST
    while block * LENGTH < len(data):
        block *= 2
    cuts = np.flatnonzero(roll % block == block - 1)
    while block > LEAST and len(cuts) < LENGTH // 2:
        block //= 2
        cuts = np.flatnonzero(roll % block == block - 1)
    return f"{block}:{_signature(data, cuts, LENGTH)}:{_signature(data, np.flatnonzero(roll % (2 * block) == 2 * block - 1), LENGTH // 2)}"


def _alike(a: str, b: str, block: int) -> int:
    a, b = (re.sub(r"(.)\1{3,}", r"\1\1\1", x) for x in (a, b))
    if not {a[i : i + WINDOW] for i in range(len(a) - WINDOW + 1)} & {b[i : i + WINDOW] for i in range(len(b) - WINDOW + 1)}:
        return 0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (0 if x == y else 2)))
        row = new
    score = 100 - 100 * row[-1] // (len(a) + len(b))
    return min(score, block // LEAST * min(len(a), len(b)))


def likeness(a: str, b: str) -> int:
    """0 to 100; signatures are comparable at equal blocks or where one block is twice the other."""
    (x, a1, a2), (y, b1, b2) = a.split(":"), b.split(":")
    x, y = int(x), int(y)
    if a == b:
        return 100
    if x == y:
        return max(_alike(a1, b1, x), _alike(a2, b2, 2 * x))
    if x == 2 * y:
        return _alike(a1, b2, x)
    return _alike(a2, b1, y) if y == 2 * x else 0
