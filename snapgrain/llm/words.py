"""Vectorised words, word hashes and word windows over the bytes of many texts at once.

Words are runs of bytes other than space and \\t..\\r.  The hash of a word of up to LONG bytes is a polynomial in its bytes
modulo 2**64, taken from prefix sums, so its cost does not depend on the number of words; a finaliser then spreads it over
all 64 bits.  Structured patterns of hundreds of bytes cancel out in such a polynomial, so longer words, which are rare,
get a keyed BLAKE2b hash each.
"""

from __future__ import annotations

import hashlib

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ROOT = 0x9E3779B97F4A7C15
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of the longest word that the polynomial hashes.
LONG = 32
#: Bytes hashed at a time; long texts are cut at white space, so memory does not follow a text's length.
CHUNK = 1 << 20
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        up, down = np.full(size, _ROOT, np.uint64), np.full(size, pow(_ROOT, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words per text): byte places of every word; a text's end also ends a word."""
    n = len(flat)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    ink = ~SPACE[flat]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | cut[1:n]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | cut[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.diff(np.searchsorted(start, offsets))


def hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """The 64-bit hash of every word."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        base = start[at]
        to = max(at + 1, int(np.searchsorted(end, base + CHUNK, "right")))
        piece = flat[base : end[to - 1]]
        up, down = _power(len(piece) + 1)
        value = _TABLE[LOWER[piece] if lower else piece]
        value *= up[: len(piece)]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        s, e = start[at:to] - base, end[at:to] - base
        h = total[e] - total[s]
        h *= down[s]
        out[at:to] = h + (e - s).astype(np.uint64)
        at = to
    out = mix(out)
    for i in np.flatnonzero(end - start > LONG):
        word = flat[start[i] : end[i]]
        out[i] = int.from_bytes(hashlib.blake2b((LOWER[word] if lower else word).tobytes(), digest_size=8, key=b"snapgrain").digest(), "little")
    return out


def windows(word: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of k consecutive words of one text, in order; the run's first word is at the same place among the words that start a run."""
    starts = run_starts(counts, k)
    h = np.zeros(len(starts), np.uint64)
    for j in range(k):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += word[starts + j]
    return mix(h), np.repeat(np.arange(len(counts)), np.maximum(counts - k + 1, 0))


def run_starts(counts: np.ndarray, k: int) -> np.ndarray:
    """Word numbers at which a run of k words of one text starts."""
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(owner) < k:
        return np.zeros(0, np.int64)
    return np.flatnonzero(owner[: len(owner) - k + 1] == owner[k - 1 :])


def shingles(flat: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Per text: its sorted distinct shingle hashes of k lower-cased (A-Z) words; of fewer words, the whole sequence as one; none without words."""
    start, end, counts = spans(flat, offsets)
    word = hashes(flat, start, end, True)
    h, _ = windows(word, counts, k)
    ends = np.cumsum(np.maximum(counts - k + 1, 0))
    firsts = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for i, c in enumerate(counts):
        if c >= k:
            one = np.sort(h[ends[i] - (c - k + 1) : ends[i]])
            out.append(one[np.concatenate([[True], one[1:] != one[:-1]])])
        elif c:
            acc = np.full(1, c, np.uint64)
            for w in word[firsts[i] : firsts[i] + c]:
                acc = acc * np.uint64(0xD6E8FEB86659FD93) + w
            out.append(mix(acc))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def groups(offsets: np.ndarray, limit: int = 4 << 20):
    """Ranges of neighbouring texts of about limit bytes together, one text at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to
