"""Words of byte buffers as numpy arrays: starts, ends and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import numpy as np

#: White space by which the contracts of the counting and deduplicating operators part words.
BLANKS = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes worked on at once.
SEGMENT = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, dtype=np.uint64)
_BYTES = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(longest: int):
    global _POWERS, _BYTES
    if _BYTES is None:
        _BYTES = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
    if len(_POWERS) <= longest:
        n = 1 << int(longest + 1).bit_length()
        _POWERS = np.cumprod(np.full(n, _BASE, dtype=np.uint64), dtype=np.uint64)
    return _BYTES, _POWERS


def words(raw: bytes | np.ndarray, blank: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the maximal runs of bytes that are not blank."""
    data = np.frombuffer(raw, dtype=np.uint8) if isinstance(raw, bytes) else raw
    starts, ends, hashes, at = [], [], [], 0
    while at < len(data):
        stop = min(len(data), at + SEGMENT)
        while stop < len(data) and not blank[data[stop]]:  # a segment ends between words
            more = blank[data[stop : stop + 4096]]
            stop += int(more.argmax()) if more.any() else len(more)
        part = data[at:stop]
        inside = ~blank[part]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        s, e = edge[::2], edge[1::2]
        if len(s):
            longest = int((e - s).max())
            weights, powers = _tables(longest)
            where = np.flatnonzero(inside)
            lengths = e - s
            first = np.cumsum(lengths) - lengths
            value = weights[part[where]] * powers[where - np.repeat(s, lengths)]
            h = np.add.reduceat(value, first)
            starts.append(s + at)
            ends.append(e + at)
            hashes.append(mix(h ^ lengths.astype(np.uint64)))
        at = stop
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """All texts with a blank behind each, and where each begins (one more entry for the end)."""
    return b"".join(t + b"\n" for t in texts), np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive entries; shorter input gives none."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        out *= np.uint64(0x100000001B3)
        out += hashes[k : k + len(out)]
    return mix(out)
