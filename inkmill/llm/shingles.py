"""Word shingles of whole texts as 64-bit hashes, in numpy.

Words are runs of bytes other than space and the controls 9 to 13, with A-Z
lower-cased. Words are hashed by prefix sums of a polynomial, so that a block of
texts takes a fixed number of passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

WIDTH = 5
BLOCK_BYTES = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20_240_501)
_BYTE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _rng.integers(0, 1 << 63, WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers up to n and their inverses, made anew: they are as large as a block."""
    return _powers(_BASE, n), _powers(_INVERSE, n)


def _block(texts: Sequence[bytes]) -> list[np.ndarray]:
    lengths = np.array([len(t) + 1 for t in texts])
    data = np.frombuffer(b" ".join([b"", *texts, b""]).translate(_LOWER), np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(texts)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.concatenate([[0], np.searchsorted(starts, np.cumsum(lengths))])
    windows = np.zeros(max(0, len(words) - WIDTH + 1), np.uint64)
    for k in range(WIDTH):
        windows += words[k : k + len(windows)] * _PLACE[k]
    windows = mix(windows)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo >= WIDTH:
            out.append(np.unique(windows[lo : hi - WIDTH + 1]))
        elif hi > lo:  # fewer words: the whole sequence as one
            h = (words[lo:hi] * _PLACE[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            out.append(mix(np.array([h ^ np.uint64(0x5851F42D4C957F2D)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: Sequence[str | None]) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    block, size = [], 0
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if block and size + len(raw) > BLOCK_BYTES:
            yield from _block(block)
            block, size = [], 0
        block.append(raw)
        size += len(raw)
    if block:
        yield from _block(block)
