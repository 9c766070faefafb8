"""Vectorised word and shingle hashing over Arrow text columns.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.  All hashes are
Rabin-Karp polynomials modulo 2**64 with an odd base: a prefix sum over the
whole buffer gives every window by one subtraction, and multiplying by the
inverse power of the base makes it independent of the window's place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20  # text hashed at once; one longer text is hashed alone
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        up = np.full(size, base, dtype=np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        have = (np.cumprod(up), np.cumprod(down))
        if size <= 4 * CHUNK_BYTES:
            _POWERS[base] = have
    return have


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for every pair, mixed."""
    up, down = _powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def windows(values: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of every run of ``size`` values, by starting place."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[:n])


def sliding(values: np.ndarray, size: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over every run of ``size`` values."""
    have, width = values, 1
    while width * 2 <= size:
        have = op(have[:-width], have[width:])
        width *= 2
    gap = size - width
    return op(have[: len(have) - gap], have[gap:]) if gap else have


class Words:
    """Words of some consecutive texts: byte places, text number and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.texts = len(offsets) - 1
        data = data[offsets[0] : offsets[-1]]
        self.offsets = offsets.astype(np.int64) - int(offsets[0])
        self.data = _LOWER[data] if lower else data
        filled = ~_SPACE[data]
        begin = filled.copy()
        begin[1:] &= ~filled[:-1]
        edges = self.offsets[:-1][self.offsets[:-1] < len(data)]
        begin[edges] = filled[edges]
        stop = filled.copy()
        stop[:-1] &= ~filled[1:]
        edges = self.offsets[1:][self.offsets[1:] > 0] - 1
        stop[edges] = filled[edges]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(stop) + 1
        #: first[i]:first[i+1] are the words of text i
        self.first = np.searchsorted(self.starts, self.offsets)
        self.text_of = np.repeat(np.arange(self.texts), np.diff(self.first))

    def hashes(self, base: int = BASES[0]) -> np.ndarray:
        lengths = (self.ends - self.starts).astype(np.uint64)
        return mix(spans(self.data.astype(np.uint64), self.starts, self.ends, base) + lengths)

    def inside(self, size: int) -> np.ndarray:
        """Whether the run of ``size`` words from each place stays in one text."""
        n = len(self.starts) - size + 1
        return self.text_of[:n] == self.text_of[size - 1 :] if n > 0 else np.zeros(0, dtype=bool)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), places


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about CHUNK_BYTES with (first row, end row, data, offsets)."""
    data, offsets = text_buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end, data, offsets[row : end + 1]
        row = end


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
