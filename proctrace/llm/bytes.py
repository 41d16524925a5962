"""Words and their hashes for many texts at once, as numpy arrays over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64, to the powers 0 .. n."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, b in enumerate((BASE, np.uint64(pow(int(BASE), -1, 1 << 64)))):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            _POWERS[k] = np.multiply.accumulate(out)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """p with p[e] - p[s] = hash of data[s:e] times BASE ** s."""
    power, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((mix(data.astype(np.uint64) + np.uint64(1))) * power[: len(data)], out=out[1:])
    return out


def spans_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]."""
    _, inverse = powers(len(p))
    return mix((p[end] - p[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words, A-Z lower-cased; words are what white space leaves."""
    data = LOWER[np.frombuffer(text, np.uint8)]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edge = np.diff(inside)
    return spans_hash(prefix_hashes(data), np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))


def binaries(column: pa.Array) -> Iterator[bytes]:
    """The bytes of each text; nulls as empty."""
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""
