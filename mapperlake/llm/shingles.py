"""Sets of word shingles as sorted arrays of 64-bit hashes, computed for many texts at once.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lowered. A word's hash is a polynomial of random byte values, mixed; a
shingle's is a mixed sum of its words' hashes with a factor for each place. Two different shingles of a pair
of documents share a hash with a chance of about 2**-64 each.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_PLACE = _RNG.integers(1, 2**64, WORDS, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power(n: int, inverse: bool) -> np.ndarray:
    """Powers 0 to n of the base, or of its inverse modulo 2**64."""
    key = "down" if inverse else "up"
    if key not in _powers or len(_powers[key]) <= n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        out = np.ones(1, np.uint64)
        while len(out) <= n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
        _powers[key] = out
    return _powers[key]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and the number of words of each text."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * _power(len(data), False)[: len(data)], out=sums[1:])
    words = _mix((sums[end] - sums[start]) * _power(len(data), True)[start])
    ends = np.cumsum([len(r) + 1 for r in raw])
    return words, np.diff(np.searchsorted(start, np.r_[0, ends], "right"))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted; with fewer than WORDS words, its words as one; without words, none."""
    if not texts:
        return []
    words, n = word_hashes(texts)
    total = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        total += words[k : k + len(total)] * _PLACE[k]
    total = _mix(total)
    out, at = [], 0
    for count in n.tolist():
        if count >= WORDS:
            x = np.sort(total[at : at + count - WORDS + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        elif count:
            short = (words[at : at + count] * _PLACE[:count]).sum(dtype=np.uint64) + np.uint64(count)
            out.append(_mix(np.array([short], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        at += count
    return out
