"""Word shingles as 64-bit hashes, computed for many texts at once with numpy.

Words are runs of bytes other than the ASCII white space, A-Z lower-cased. A word's hash is a polynomial over 64-bit
values of its bytes, taken from running sums, then mixed; a shingle's mixes those of its words.
"""

from __future__ import annotations

import hashlib

import numpy as np

PIECE = 1 << 20
_rng = np.random.default_rng(20240101)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_rng.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 1
_TURN = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse mod 2**64 to the powers 0 .. n-1."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        made = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            made.append(np.cumprod(a))
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def running(data: np.ndarray) -> np.ndarray:
    """Sums s with s[i] of the first i bytes; the string i .. j hashes to (s[j] - s[i]) * inverse power of i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data))[0], out=out[1:])
    return out


def _word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of one text, in pieces so that long texts need little memory beyond it."""
    out, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE:
            cut = max(text.rfind(c, at + 1, at + PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            # a longer word than a piece: up to its end
            end = cut if cut > at else min((i for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (i := text.find(c, at + PIECE)) >= 0), default=len(text))
        out.append(_hashes(np.frombuffer(text, np.uint8, end - at, at))[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first bytes) of the words in ``data``."""
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    s = running(data)
    return mix((s[stop] - s[start]) * powers(len(data) + 1)[1][start]), start


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """Word hashes of each text; short texts go through numpy together."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    out: list[np.ndarray] = [None] * len(raw)  # type: ignore[list-item]
    batch, size = [], 0
    for i, t in enumerate([*raw, None]):
        if t is None or size + len(t) + 1 > PIECE:
            if batch:
                joined = b"\n".join(raw[j] for j in batch)
                h, first = _hashes(np.frombuffer(joined, np.uint8))
                ends = np.cumsum([len(raw[j]) + 1 for j in batch])
                for j, part in zip(batch, np.split(h, np.searchsorted(first, ends[:-1])), strict=True):
                    out[j] = part
            batch, size = [], 0
        if t is None:
            break
        if len(t) + 1 > PIECE:
            out[i] = _word_hashes(t)
        else:
            batch.append(i)
            size += len(t) + 1
    return out


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct shingles; with fewer words than ``width`` the whole sequence as one, without words none."""
    if not len(words):
        return words
    n = min(width, len(words))
    s = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        s += words[j : j + len(s)] * _TURN[j]
    return np.unique(mix(s + np.uint64(n)))


def set_id(s: np.ndarray) -> bytes:
    return hashlib.md5(s.tobytes()).digest()


def min_hashes(sets: list[np.ndarray], k: int, seed: int = 7) -> np.ndarray:
    """k minima for each non-empty set, 32 bits each."""
    r = np.random.default_rng(seed)
    factors, adds = r.integers(1, 1 << 63, k, dtype=np.uint64) | np.uint64(1), r.integers(1, 1 << 63, k, dtype=np.uint64)
    out = np.empty((len(sets), k), np.uint32)
    if not sets:
        return out
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    flat = np.concatenate(sets)
    for i in range(k):
        out[:, i] = np.minimum.reduceat((flat ^ adds[i]) * factors[i], at) >> np.uint64(32)
    return out
