"""Hashes of word shingles and byte windows of whole texts, vectorised over one text at a time."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
#: An odd multiplier and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the multiplier and of its inverse."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 16) + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _grown(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:], dtype=np.uint64)
    return sums, inverse


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes."""
    sums, inverse = _prefix(np.frombuffer(data, np.uint8))
    return _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def window_hashes(data: bytes, width: int) -> np.ndarray:
    """64-bit hashes of every window of width bytes."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    sums, inverse = _prefix(np.frombuffer(data, np.uint8))
    return _mix((sums[width:] - sums[:-width]) * inverse[: len(data) - width + 1])


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles: A-Z in lower case, words ``[^\\x20\\x09-\\x0D]+``.
    With fewer words the whole sequence is the one shingle; without words there is none."""
    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(parts) > words:
        starts, ends = starts[: 1 - words] if words > 1 else starts, ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.unique(span_hashes(joined, starts, ends))
