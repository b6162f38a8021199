"""Vectorised word and shingle hashing shared by the text operators.

A batch of texts is laid out as one byte array; words are found with a mask and
hashed with prefix sums, so the cost is a fixed number of numpy passes over the
bytes, whatever the words are.  Values are 64-bit and equal on every machine.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes of text that are laid out together; a longer text makes a batch alone.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        table = np.full(size, base, np.uint64)
        table[0] = 1
        have = np.cumprod(table, dtype=np.uint64)
        if size <= 4 * CHUNK_BYTES:
            _powers[name] = have
    return have[:n]


def chunks(texts: list[bytes]):
    """Index ranges of texts whose bytes fit one layout."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) + 1 > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, A-Z lower-cased, in order, and for each
    text the index of its first word (one more entry at the end).  Words are
    runs of bytes other than 0x20 and 0x09-0x0D."""
    raw = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    space = _SPACE[raw]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(space & ~before)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _power("up", _BASE, len(raw)), out=total[1:])
    hashes = (total[ends] - total[starts]) * _power("down", _BASE_INVERSE, len(raw))[starts]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return mix(hashes + (ends - starts).astype(np.uint64)), np.searchsorted(starts, bounds)


def substring_hashes(raw: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the substrings of raw bytes that begin at sorted places and are whole."""
    out = np.empty(len(at), np.uint64)
    for start in range(0, len(raw), CHUNK_BYTES):
        a, b = np.searchsorted(at, (start, start + CHUNK_BYTES))
        if a < b:
            piece, place = raw[start : start + CHUNK_BYTES + length], at[a:b] - start
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_BYTE[piece] * _power("up", _BASE, len(piece)), out=total[1:])
            out[a:b] = mix((total[place + length] - total[place]) * _power("down", _BASE_INVERSE, len(piece))[place])
    return out


_PLACE = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; run i begins at word i."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = words[:m] * _PLACE[0]
    for k in range(1, n):
        out += words[k : k + m] * _PLACE[k]
    return mix(out)


def shingle_sets(texts: list[bytes], n: int):
    """Yields for each text its sorted distinct n-word shingle hashes; a text of
    fewer words has its whole sequence as one, a text without words none."""
    for a, b in chunks(texts):
        words, first = word_hashes(texts[a:b])
        runs = windows(words, n)
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= n:
                yield np.unique(runs[lo : hi - n + 1])
            elif hi > lo:
                own = words[lo:hi] * _PLACE[: hi - lo]
                yield mix(np.array([own.sum(dtype=np.uint64) ^ np.uint64(hi - lo)], np.uint64))
            else:
                yield np.empty(0, np.uint64)
