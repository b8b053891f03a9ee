"""Words of many texts at once, as NumPy arrays over one byte buffer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, bool)
IS_WORD[:128] = [chr(i).isalnum() for i in range(128)]
LETTER = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse, modulo 2**64, for i < n."""
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for k, b in enumerate((BASE, inverse)):
            x = np.full(1 << (n - 1).bit_length(), b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit hashes over all their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null counts as empty."""
    values = column.fill_null(b"" if pa.types.is_binary(column.type) else "") if column.null_count else column
    width = np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else np.int32
    offsets = np.frombuffer(values.buffers()[1], width)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int):
    """Runs of rows [a, b) of about ``most`` bytes; a longer text makes a run of its own."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b
        a = b


def words(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes, then start, end and row of each word; words never run over rows."""
    low = LOWER[buffer]
    inside = IS_WORD[low]
    first = np.empty(len(low), bool)
    last = np.empty(len(low), bool)
    if len(low):
        first[0], last[-1] = inside[0], inside[-1]
        first[1:] = inside[1:] & ~inside[:-1]
        last[:-1] = inside[:-1] & ~inside[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(low))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return low, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans."""
    up, down = powers(len(low) + 1)
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(LETTER[low] * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
