"""Words and rolling hashes of many texts at once, on the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_SEED = np.random.default_rng(20240607)
#: A random 64-bit value for each byte.
BYTE = _SEED.integers(0, 1 << 64, 256, dtype=U) | U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_LOWER = BYTE[LOWER]
#: Bytes that part words: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2**64, kept for the next call."""
    if len(_POWERS["up"]) < n:
        for k, b in (("up", _BASE), ("down", _INV)):
            with np.errstate(over="ignore"):
                _POWERS[k] = np.cumprod(np.concatenate([np.ones(1, U), np.full(n, b, U)]), dtype=U)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


def join2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of the pair (a, b)."""
    with np.errstate(over="ignore"):
        return mix(a * U(0xD6E8FEB86659FD93) + mix(b + U(0xA0761D6478BD642F)))


def words(buf: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, doc) of each word, a run of bytes that aren't space or \\x09-\\x0D; none crosses a text's end."""
    n = len(buf)
    if n == 0:
        e = np.zeros(0, np.int64)
        return np.zeros(0, U), e, e, e
    solid = ~SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    prev = np.zeros(n, bool)
    prev[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~prev | edge[:n]))
    nxt = np.zeros(n, bool)
    nxt[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~nxt | edge[1:])) + 1
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        acc = np.zeros(n + 1, U)
        np.cumsum((BYTE_LOWER if lower else BYTE)[buf] * up[:n], dtype=U, out=acc[1:])
        h = mix((acc[end] - acc[start]) * down[start] + (end - start).astype(U))
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(start, offs)))
    return h, start, end, doc


def windows(buf: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of ``width`` bytes, by its start."""
    n = len(buf) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    up, down = powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        acc = np.zeros(len(buf) + 1, U)
        np.cumsum(BYTE[buf] * up[: len(buf)], dtype=U, out=acc[1:])
        return mix((acc[width:] - acc[:n]) * down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    n, w = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * w <= width:
        x = np.minimum(x[:-w], x[w:])
        w *= 2
    return np.minimum(x[:n], x[width - w : width - w + n])
