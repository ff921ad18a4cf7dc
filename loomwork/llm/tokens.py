"""Words and word n-grams of Arrow string columns, hashed with numpy straight from the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that one piece of work holds at most, unless a single word is longer.
SEGMENT = 1 << 20

_U = np.uint64
_RATIO = _U(0x9E3779B97F4A7C13)
_INVERSE = _U(pow(0x9E3779B97F4A7C13, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> _U(31))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(29))
    h = h * _U(0xA5CB9243F0AEF9B5)
    return h ^ (h >> _U(32))


def byte_table(separators: np.ndarray) -> np.ndarray:
    """A 64-bit value for each byte, 0 for separators; A to Z have those of a to z."""
    values = mix(np.arange(1, 257, dtype=_U) * _U(0xD1B54A32D192ED03)) | _U(1)
    values[65:91] = values[97:123]
    values[separators] = 0
    return values


def space_table() -> np.ndarray:
    """Separators are the space and 0x09 to 0x0D."""
    return byte_table(np.array([0x20, *range(0x09, 0x0E)]))


def alnum_table() -> np.ndarray:
    """Separators are all ASCII characters but letters and digits."""
    return byte_table(np.array([b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, int(n).bit_length())
    if size not in _powers:
        if size <= 4 * SEGMENT:
            _powers.clear()
        made = tuple(np.cumprod(np.concatenate(([_U(1)], np.full(size - 1, r, _U))), dtype=_U) for r in (_RATIO, _INVERSE))
        if size > 4 * SEGMENT:
            return made
        _powers[size] = made
    return _powers[size]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


class Words:
    """Words of some rows: where each begins and ends in the bytes, its row, its hash."""

    __slots__ = ("data", "start", "end", "row", "hash", "rows")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, values: np.ndarray):
        self.data, self.rows = data, len(offsets) - 1
        starts, ends, hashes = [], [], []
        at, size = 0, len(data)
        breaks = offsets[:-1]
        while at < size:
            to = min(size, at + SEGMENT)
            if to < size:  # end where a word ends, however long it is
                step = to
                while step < size:
                    gap = np.flatnonzero(values[data[step : step + 4096]] == 0)
                    if len(gap):
                        step += int(gap[0])
                        break
                    step += 4096
                to = min(step, size)
            part = values[data[at:to]]
            word = part != 0
            new = np.zeros(to - at + 1, bool)
            new[breaks[(breaks >= at) & (breaks < to)] - at] = True
            inside = np.concatenate(([False], word, [False]))
            begin = np.flatnonzero(inside[1:] & (~inside[:-1] | new))
            stop = np.flatnonzero(inside[:-1] & (~inside[1:] | new))
            power, inverse = _power(to - at)
            total = np.concatenate(([_U(0)], np.cumsum(part * power[: to - at], dtype=_U)))
            hashes.append(mix((total[stop] - total[begin]) * inverse[begin]))
            starts.append(begin + at)
            ends.append(stop + at)
            at = to
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.start, self.end, self.hash = join(starts, np.int64), join(ends, np.int64), join(hashes, _U)
        self.row = np.searchsorted(offsets, self.start, side="right") - 1

    def bounds(self) -> np.ndarray:
        """Where each row's words begin, and the end of the last."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))

    def grams(self, n: int) -> np.ndarray:
        """A hash for the n words from each word on, for all but the last n - 1; those that cross rows are to be masked."""
        return gram_hashes(self.hash, n)

    def text(self, i: int, j: int) -> list[bytes]:
        """Words i to j, A to Z in lower case."""
        return [self.data[self.start[k] : self.end[k]].tobytes().lower() for k in range(i, j)]


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, _U)
    h = np.full(count, _U(n), _U)
    for k in range(n):
        h = h * _U(0x9FB21C651E98DF25) + words[k : k + count]
        h ^= h >> _U(33)
    return mix(h)


def slices(column: pa.Array, most_bytes: int = SEGMENT) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows that together hold most_bytes at most, or one longer row: first row, end row, bytes, offsets."""
    data, offsets = string_buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, side="right")) - 1)
        yield i, min(j, n), data[offsets[i] : offsets[min(j, n)]], offsets[i : min(j, n) + 1] - offsets[i]
        i = min(j, n)
