"""Words of a batch of texts as arrays: bounds and 64-bit hashes, without a Python step per word.

White space is ``[\\x20\\x09-\\x0D]``; in UTF-8 those bytes never occur inside another character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled together up to so many bytes; a longer text makes a batch of its own.
BATCH_BYTES = 1_000_000

_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_powers = [np.empty(0, np.uint64)] * 2


def _weights(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of ``_BASE`` and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return [p[:n] for p in _powers]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the byte spans.

    A polynomial of the bytes' values over all data is summed up once; a span's part of it, moved to the start, depends
    on its bytes only.
    """
    up, down = _weights(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64))


class Batch:
    """Texts of one batch.

    ``data`` holds all bytes with a line feed after each text, ``bounds`` the start of each text (and the end of the
    last). Word ``i`` spans ``starts[i]:ends[i]``; the words of text ``d`` are ``first[d]:first[d + 1]``.
    """

    def __init__(self, texts: list[bytes], lower: bool = False) -> None:
        self.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        space = _SPACE[self.data]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.starts, self.bounds)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every line (cut at line feeds only), and the first line of each text (and past the last)."""
        ends = np.flatnonzero(self.data == 10)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        return starts, ends, np.searchsorted(starts, self.bounds)

    def windows(self, hashes: np.ndarray, width: int) -> np.ndarray:
        """Hash of the ``width`` words from each word on; those that run over a text's end mean nothing."""
        out = np.zeros(len(hashes), np.uint64)
        if len(hashes):
            padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
            for k in range(width):
                out = mix(out * np.uint64(_BASE) + padded[k : k + len(hashes)])
        return out


def batches(columns: list[pa.Array], texts: pa.Array, lower: bool = False) -> Iterator[tuple[list[list], Batch]]:
    """Slices of the given columns (as lists) with their texts' words; NULL texts count as empty."""
    values = texts.cast(pa.binary()).to_pylist()
    others = [c.to_pylist() for c in columns]
    at = 0
    while at < len(values):
        size, upto = 0, at
        while upto < len(values) and (upto == at or size + len(values[upto] or b"") <= BATCH_BYTES):
            size += len(values[upto] or b"")
            upto += 1
        yield [c[at:upto] for c in others], Batch([v or b"" for v in values[at:upto]], lower)
        at = upto
