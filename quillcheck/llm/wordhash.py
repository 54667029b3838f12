"""64-bit hashes of all words of a chunk of texts at once, with numpy."""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number for each byte, so that the sums below have no structure of the alphabet.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


#: Bytes of one text that are hashed at once.
BLOCK = 4 << 20
_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)
_UP, _DOWN = powers(_BASE, 0), powers(_BACK, 0)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without ASCII blanks) of texts laid end to end, and the n + 1 offsets of each text's."""
    n = len(data)
    if n > BLOCK and len(offsets) == 2:  # one long text: block by block, so that memory stays bounded
        found, start = [], 0
        while start < n:
            blanks = np.flatnonzero(_BLANK[data[start + BLOCK : start + 2 * BLOCK]])
            stop = start + BLOCK + int(blanks[0]) if len(blanks) else min(n, start + 2 * BLOCK)
            if not len(blanks) and stop < n:  # a word longer than a block
                later = np.flatnonzero(_BLANK[data[stop:]])
                stop = stop + int(later[0]) if len(later) else n
            part = data[start:stop]
            found.append(_hashes(part, np.array([0, len(part)]), lower)[0])
            start = stop
        hashes = np.concatenate(found)
        return hashes, np.array([0, len(hashes)])
    return _hashes(data, offsets, lower)


def word_spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of the words of texts laid end to end; ``apart`` says of each byte whether it parts words."""
    n = len(data)
    gap = np.empty(n + 1, bool)
    gap[:n] = apart[data]
    gap[n] = True
    before = np.empty(n, bool)
    before[1:] = gap[: n - 1]
    first = offsets[:-1][offsets[:-1] < n]
    before[first] = True
    start = np.flatnonzero(before & ~gap[:n])
    after = gap[1:].copy()
    last = offsets[1:] - 1
    after[last[(last >= 0) & (last < n)]] = True
    return start, np.flatnonzero(after & ~gap[:n]) + 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hashes of the bytes [start, end), lower-cased in A-Z if asked."""
    global _UP, _DOWN
    n = len(data)
    if n + 1 > len(_UP):
        _UP, _DOWN = powers(_BASE, n + 1), powers(_BACK, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[_LOWER[data] if lower else data] * _UP[:n], out=sums[1:])
    return mixed((sums[end] - sums[start]) * _DOWN[start])


def _hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    start, end = word_spans(data, offsets)
    return span_hashes(data, start, end, lower), np.searchsorted(start, offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of texts whose word hashes lie end to end, and the text of each. A text of fewer
    words has one shingle of them all; one without words has none."""
    counts = np.diff(offsets)
    salt = mixed(np.arange(1, k + 1, dtype=np.uint64) * _ODD)
    each = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), each)
    begin = np.repeat(np.cumsum(each) - each, each)
    start = offsets[text] + (np.arange(len(text)) - begin)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    total = np.zeros(len(text), np.uint64)
    long = counts[text] >= k
    for j in range(k):
        inside = long | (j < counts[text])
        total += np.where(inside, padded[start + j] * (salt[j] | np.uint64(1)), np.uint64(0))
    return mixed(total), text
