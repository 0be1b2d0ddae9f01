"""Numeric kernels over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

#: Odd multipliers by the place of a byte in its word; places repeat after 64.
_PLACES = (np.random.default_rng(20).integers(1, 1 << 63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """The last steps of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with a line feed after each text, and where each text starts, one more at the end."""
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    return np.frombuffer(b"\n".join([*texts, b""]), np.uint8), starts


def words(data: np.ndarray, member: np.ndarray, fold: np.ndarray = LOWER, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the runs of member bytes. With prefixes (lengths in bytes): a column for each, 0 where the word is no longer, and last one for the whole word."""
    held = member[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], held.view(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.empty((0, len(prefixes) + 1) if prefixes else 0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    value = _PLACES[place & 63] * (fold[data[held]].astype(np.uint64) + np.uint64(1))
    salt = np.uint64(0x9E3779B97F4A7C15)
    whole = mixed(np.add.reduceat(value, first) + size.astype(np.uint64) * salt)
    if not prefixes:
        return starts, ends, whole
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
    out = np.zeros((len(starts), len(prefixes) + 1), np.uint64)
    out[:, -1] = whole
    for k, n in enumerate(prefixes):
        longer = np.flatnonzero(size > n)
        out[longer, k] = mixed(total[first[longer] + n] - total[first[longer]] + np.uint64(n * int(salt) & (1 << 64) - 1) ^ salt)
    return starts, ends, out


def auc(label: np.ndarray, score: np.ndarray) -> float:
    """Area under the curve; ties count half."""
    _, rank, n = np.unique(score, return_inverse=True, return_counts=True)
    mid = np.cumsum(n) - (n - 1) / 2
    good = label == 1
    a, b = good.sum(), (~good).sum()
    return float((mid[rank][good].sum() - a * (a + 1) / 2) / max(1, a * b))
