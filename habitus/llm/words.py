"""Words of whole batches of texts as numbers, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from habitus.llm.vocab import filled, slices

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at a time, so that the work arrays stay small.
SLICE_BYTES = 4_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all their bits (the finalizer of splitmix64)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODE = mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)


class Words:
    """Words of a run of texts: the hash of each, ASCII case folded, and where it lies in the bytes.

    ``plain``: ASCII signs other than letters and digits part words, too, as white space does.
    """

    def __init__(self, texts: pa.Array, plain: bool = False):
        texts = filled(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        low, high = int(offsets[0]), int(offsets[-1])
        buffer = texts.buffers()[2]
        data = np.frombuffer(buffer, np.uint8)[low:high] if buffer is not None and high > low else np.empty(0, np.uint8)
        bounds = offsets - low
        space = (_BREAK if plain else _SPACE)[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = space[1:] != space[:-1]
        edge[bounds] = True  # a word never crosses texts
        edge[-1] = True
        edges = np.flatnonzero(edge)
        starts, ends = edges[:-1], edges[1:]  # also of empty texts: no edge twice
        word = ~space[starts] if len(starts) else np.empty(0, bool)
        self.start, self.end = starts[word], ends[word]
        #: First word of each text, and the number of words.
        self.first = np.searchsorted(self.start, bounds)
        self.data, self.bounds = data, bounds
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.empty(0, np.uint64)
        sizes = self.end - self.start
        power = np.ones(int(sizes.max()) + 1, np.uint64)
        power[1:] = np.multiply.accumulate(np.full(len(power) - 1, _STEP | np.uint64(1)))
        out = np.empty(len(self.start), np.uint64)
        step = 1 << 18
        for k in range(0, len(out), step):  # work arrays for some words at a time
            s, n = self.start[k : k + step], sizes[k : k + step]
            begin = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(begin, n)
            codes = _CODE[_LOWER[self.data[np.repeat(s, n) + place]]]
            out[k : k + step] = np.add.reduceat(codes * power[place], begin)
        return mixed(out + sizes.astype(np.uint64))


def words_of(
    texts: pa.Array, plain: bool = False, limit: int = SLICE_BYTES
) -> Iterator[tuple[int, pa.Array, Words]]:
    """(place of the first text, texts, their words) for runs of about ``limit`` bytes."""
    for first, part in slices(filled(texts), limit):
        yield first, part, Words(part, plain)
