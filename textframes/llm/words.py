"""Words of whole texts as 64-bit hashes, straight from the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from textframes.llm.shared import mix

_U = np.uint64
#: Bytes that end a word: space, and 0x09 to 0x0D. No byte of a longer UTF-8 sequence is among them.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are hashed in one go; a longer word stands alone.
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C13
_INVERSE = pow(_BASE, -1, 1 << 64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column (null: none), and where each text begins and the last ends."""
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    return (np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)), offsets - first


class WordCutter:
    """Hashes of the words `[^\\\\x20\\\\x09-\\\\x0D]+`, with A-Z lower-cased if fold is set.

    A word's hash is a polynomial of random values of its bytes, read off running sums modulo 2^64,
    and mixed.
    """

    def __init__(self, fold: bool) -> None:
        self.value = np.random.default_rng(29).integers(1, 1 << 64, 256, dtype=_U)
        if fold:
            self.value[65:91] = self.value[97:123]
        self._extend(PIECE)

    def _extend(self, n: int) -> None:
        self.powers = np.cumprod(np.r_[_U(1), np.full(n, _U(_BASE))])
        self.inverse = np.cumprod(np.r_[_U(1), np.full(n, _U(_INVERSE))])

    def bounds(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte and end of each word, and the number of words of each text."""
        inside = ~SPACE[data]
        breaks = np.zeros(len(data) + 1, bool)
        breaks[offsets] = True
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | breaks[1:-1]
        end[:-1] &= ~inside[1:] | breaks[1:-1]
        starts = np.flatnonzero(begin)
        return starts, np.flatnonzero(end) + 1, np.diff(np.searchsorted(starts, offsets))

    def hashes(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in a row, and the number of words of each text."""
        data, offsets = utf8(column)
        starts, ends, n = self.bounds(data, offsets)
        out = np.empty(len(starts), _U)
        at = 0
        while at < len(starts):
            base = int(starts[at])
            to = max(at + 1, int(np.searchsorted(ends, base + PIECE, "right")))
            size = int(ends[to - 1]) - base
            if size >= len(self.powers):
                self._extend(size)
            sums = np.zeros(size + 1, _U)
            np.cumsum(self.value[data[base : base + size]] * self.powers[:size], out=sums[1:])
            own = starts[at:to] - base
            out[at:to] = (sums[ends[at:to] - base] - sums[own]) * self.inverse[own]
            at = to
        return mix(out), n
