"""Word hashes of many texts at once, straight from their bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Odd constants of well-known 64-bit mixers.
M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xBF58476D1CE4E5B9)
M3 = np.uint64(0x94D049BB133111EB)
LONG_WORD = 512

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Words:
    """The words of a run of texts: runs of bytes other than ASCII white space."""

    counts: np.ndarray  # words of each text
    hashes: np.ndarray  # of each word, text by text

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.counts)

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """64-bit hashes of all words; ``lower`` folds A-Z.  A null text has no words.

    Words of up to 8 bytes and equal length never share a hash.
    """
    column = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    begin, end = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
    data = np.zeros(end - begin + 8, dtype=np.uint8)
    if end > begin:
        data[: end - begin] = np.frombuffer(column.buffers()[2], dtype=np.uint8)[begin:end]
    offsets = offsets - begin if len(column) else np.zeros(1, np.int64)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data[: end - begin]]
    if not inside.any():
        return Words(np.zeros(len(column), dtype=np.int64), np.zeros(0, dtype=np.uint64))
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    cut = offsets[(offsets > 0) & (offsets < end - begin)]
    before[cut] = False
    after[cut - 1] = False
    starts, stops = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    lengths = stops - starts
    eights = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
    with np.errstate(over="ignore"):
        h = lengths.astype(np.uint64) * M1
        active = np.arange(len(starts))
        at, left = starts, lengths
        while len(active):
            block = eights[at] & _MASKS[np.minimum(left, 8)]
            h[active] = mix(h[active] ^ block) * M1
            more = (left > 8) & (left <= LONG_WORD)
            active, at, left = active[more], at[more] + 8, left[more] - 8
    long = np.flatnonzero(lengths > LONG_WORD)
    if len(long):
        import xxhash

        h[long] = [xxhash.xxh3_64_intdigest(data[starts[i]: stops[i]].tobytes()) for i in long.tolist()]
    return Words(counts, h)


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of ``size`` words; runs that cross texts are the caller's to drop."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, (seed * 2 + 1) & 0xFFFFFFFF, dtype=np.uint64) * M3
        for k in range(size):
            out = out * M1 + mix(hashes[k: k + n] + np.uint64((seed + 1) * 0x51ED270B))
        return mix(out)
