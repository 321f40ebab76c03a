"""Vectorised text primitives over Arrow string columns, for Arrow UDFs.

Every function works on the UTF-8 bytes of a whole batch at once (NumPy), so no
Python code runs per character or per word.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_C1 = np.uint64(0x9E3779B97F4A7C15)
_C2 = np.uint64(0xBF58476D1CE4E5B9)
_C3 = np.uint64(0x94D049BB133111EB)
_TAIL = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=np.uint64)


def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: Bytes of words: digits, letters and everything outside ASCII.
ALNUM = _table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
#: Bytes of words: all but ASCII white space.
NONSPACE = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Lower-cases A-Z only; bytes of multi-byte characters stay.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the n+1 offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offs[0] : offs[-1]] if body is not None and len(column) else np.zeros(0, np.uint8)
    return data, offs - (offs[0] if len(offs) else 0)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``most`` bytes of text (or one row)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offs = flat(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offs, offs[at] + most, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
        del batch
        pa.default_memory_pool().release_unused()  # else a worker keeps what its largest batch took


def find_words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): word w is bytes starts[w]:ends[w]; row d has words first[d]:first[d+1]."""
    n = data.size
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = table[data]
    row_start = np.zeros(n + 1, bool)
    row_start[offs[:-1]] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | row_start[1:n]
    end[:-1] &= ~inside[1:] | row_start[1:n]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * _C2
    h = (h ^ (h >> np.uint64(27))) * _C3
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray((data.size + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    h = mix(size.astype(np.uint64) * _C1 + _C2)
    at = np.arange(len(starts))
    k = 0
    while len(at):
        chunk = view[starts[at] + k] & _TAIL[np.minimum(size[at] - k, 8)]
        h[at] = mix(h[at] * _C1 ^ chunk)
        k += 8
        at = at[size[at] > k]
    return h


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words (ignoring row borders; the last k-1 are dropped)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h = mix(h * _C1 + words[j : j + n])
    return h


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """As shingle_hashes(), for large k: differences of a running polynomial sum, whatever k is."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base, inverse = _C1 | np.uint64(1), np.uint64(pow(int(_C1 | np.uint64(1)), -1, 1 << 64))
    power = np.full(len(words), base)
    power[0] = 1
    back = np.full(n, inverse)
    back[0] = 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(power))])
    return mix((total[k:] - total[:n]) * np.cumprod(back))


def sliding(values: np.ndarray, k: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of every k consecutive values."""
    have = 1
    while have < k:
        step = min(have, k - have)
        values = best(values[: len(values) - step], values[step:])
        have += step
    return values


def row_shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each row's k-word shingles; a row of fewer words, but not none, is one shingle."""
    count = np.diff(first)
    many = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(many)])
    out = np.zeros(at[-1], np.uint64)
    full = count >= k
    if full.any():
        h = shingle_hashes(words, k)
        rows = np.repeat(np.flatnonzero(full), many[full])
        inner = np.arange(len(rows)) - np.repeat(np.cumsum(many[full]) - many[full], many[full])
        out[at[rows] + inner] = h[first[rows] + inner]
    for d in np.flatnonzero(~full & (count > 0)):
        h = mix(np.array([count[d]], np.uint64))[0]
        for w in words[first[d] : first[d + 1]]:
            h = mix(np.array([h], np.uint64) * _C1 + w)[0]
        out[at[d]] = h
    return out, at


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[d]:first[d+1]] for each row; 0 for empty rows."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[first[1:]] - total[first[:-1]]


def segment_mins(values: np.ndarray, first: np.ndarray, none) -> np.ndarray:
    """Minima of each row's values; ``none`` for empty rows."""
    out = np.full(len(first) - 1, none, values.dtype)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.minimum.reduceat(values, first[:-1][full])
    return out
