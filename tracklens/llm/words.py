"""Words of whole batches as 64-bit hashes, computed on the bytes of the Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20_240_501)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z; no other letter is folded
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes that are hashed at once; a longer text is taken by itself.
CHUNK = 2 << 20

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _powers[i] = p
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of consecutive rows. ``first[i]:first[i + 1]`` are the words of row ``i``."""

    __slots__ = ("row0", "hashes", "first", "data", "starts", "ends")

    def __init__(self, row0: int, data: np.ndarray, bounds: np.ndarray):
        self.row0, self.data = row0, data
        n = len(data)
        word = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        begins = word & edge[:-1]
        begins[1:] |= word[1:] & ~word[:-1]
        stops = word & edge[1:]
        stops[:-1] |= word[:-1] & ~word[1:]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        up, down = _power_tables(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=total[1:])
        self.hashes = mix((total[self.ends] - total[self.starts]) * down[self.starts])
        self.first = np.searchsorted(self.starts, bounds)


def words_of(column) -> Iterator[Words]:
    """Words of an Arrow string column, a few MB at a time; a null is an empty text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        stop = min(stop, len(column))
        yield Words(row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row])
        row = stop
