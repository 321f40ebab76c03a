"""Byte streams of symbols: canonical Huffman codes with their table, or differences in zigzag order."""

from __future__ import annotations

import numpy as np

from ..operators.coding import canonical_codes, code_lengths


def _sized(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def split(data: bytes) -> list[bytes]:
    """The parts of joined()."""
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


joined = _sized


def huffman(symbols: np.ndarray) -> bytes:
    """Count, number of different symbols, symbols in the order of their codes, code lengths, and the codes; no bits for a single symbol."""
    kinds, which, n = np.unique(symbols, return_inverse=True, return_counts=True)
    lengths = np.array(code_lengths(n.tolist()), np.int64)
    codes = np.array(canonical_codes(lengths.tolist()), np.uint64)
    order = np.lexsort((kinds, lengths))
    head = np.array([len(symbols), len(kinds)], "<u4").tobytes()
    return head + kinds[order].astype("<i4").tobytes() + lengths[order].astype("u1").tobytes() + _bits(which, codes, lengths)


def unhuffman(data: bytes) -> np.ndarray:
    """The symbols of huffman()."""
    count, many = (int(x) for x in np.frombuffer(data, "<u4", 2))
    kinds = np.frombuffer(data, "<i4", many, 8).astype(np.int64)
    lengths = np.frombuffer(data, "u1", many, 8 + 4 * many).astype(np.int64)
    if many <= 1:
        return np.repeat(kinds, count)
    codes = np.array(canonical_codes(lengths.tolist()), np.uint64)
    return kinds[_decoded(np.frombuffer(data, np.uint8, offset=8 + 5 * many), count, codes, lengths)]


def _orbit(after: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` of 0, after[0], after[after[0]], ...: twice as many each time, by steps twice as long."""
    places, step = np.zeros(1, np.int64), after
    while len(places) < count:
        places = np.concatenate([places, step[places]])
        step = step[step]
    return places[:count]


#: Longest code that is looked up in a table of all words of its length; longer ones are searched for.
LOOKUP = 16


def _decoded(body: np.ndarray, count: int, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which codes (canonical, in order of length) follow each other in a stream of bits."""
    top = int(lengths[-1])
    bits = np.concatenate([np.unpackbits(body), np.zeros(top, np.uint8)]).astype(np.int64)
    # the word of ``top`` bits that begins at each bit
    window = np.zeros(len(bits) - top + 1, np.int64)
    for b in range(top):
        window |= bits[b : b + len(window)] << (top - 1 - b)
    left = (codes << (top - lengths).astype(np.uint64)).astype(np.int64)  # codes to the left of ``top`` bits ascend
    if top <= LOOKUP:
        symbol = np.repeat(np.arange(len(codes)), np.diff(np.append(left, 1 << top)))[window]
    else:
        symbol = np.searchsorted(left, window, side="right") - 1
    return symbol[_orbit(np.minimum(np.arange(len(window)) + lengths[symbol], len(window) - 1), count)]


def _bits(which: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """The codes ``which`` one after the other, highest bit first, padded with zeros."""
    size = lengths[which]
    start = np.cumsum(size) - size
    bits = np.zeros(int(size.sum()), np.uint8)
    code = codes[which]
    for b in range(int(lengths.max(initial=0))):
        live = np.flatnonzero(size > b)
        bits[start[live] + b] = (code[live] >> (size[live] - 1 - b).astype(np.uint64)) & np.uint64(1)
    return np.packbits(bits).tobytes()


def limited_lengths(counts: list[int], most: int) -> list[int]:
    """Huffman code lengths of at most ``most`` bits (or as many as the symbols need): counts are halved until the rarest are near enough."""
    most = max(most, (len(counts) - 1).bit_length() + 1)
    lengths = code_lengths(counts)
    while max(lengths, default=0) > most:
        counts = [(n + 1) // 2 for n in counts]
        lengths = code_lengths(counts)
    return lengths


class Table:
    """One canonical code for the streams of many blocks; to be sent with them once, by to_bytes()."""

    def __init__(self, kinds: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((kinds, lengths))
        self.kinds, self.lengths = np.asarray(kinds, np.int64)[order], np.asarray(lengths, np.int64)[order]
        self.codes = np.array(canonical_codes(self.lengths.tolist()), np.uint64)
        self.sorted = np.argsort(self.kinds)

    @classmethod
    def of(cls, counts: dict[int, int], most: int = LOOKUP) -> Table:
        kinds = sorted(counts)
        return cls(np.array(kinds, np.int64), np.array(limited_lengths([counts[k] for k in kinds], most), np.int64))

    def write(self, symbols: np.ndarray) -> bytes:
        """Their number and their codes; a symbol that the table does not have raises."""
        at = np.searchsorted(self.kinds[self.sorted], symbols)
        which = self.sorted[np.minimum(at, len(self.kinds) - 1)] if len(self.kinds) else np.zeros(0, np.int64)
        if len(symbols) and (not len(self.kinds) or (self.kinds[which] != symbols).any()):
            raise ValueError("a symbol that the table does not have")
        return len(symbols).to_bytes(4, "little") + (_bits(which, self.codes, self.lengths) if len(symbols) else b"")

    def read(self, data: bytes) -> np.ndarray:
        count = int.from_bytes(data[:4], "little")
        if len(self.kinds) < 2 or not count:
            return np.repeat(self.kinds[:1], count)
        return self.kinds[_decoded(np.frombuffer(data, np.uint8, offset=4), count, self.codes, self.lengths)]

    def to_bytes(self) -> bytes:
        """The width of a symbol (1, 2 or 4 bytes), how many symbols have each length, and the symbols in order of their codes, as differences to the smallest."""
        least = int(self.kinds.min(initial=0))
        width = next(w for w in (1, 2, 4) if int(self.kinds.max(initial=0)) - least < 1 << (8 * w))
        many = np.bincount(self.lengths, minlength=1)
        return bytes([width, len(many)]) + least.to_bytes(8, "little", signed=True) + many.astype("<u4").tobytes() + (self.kinds - least).astype(f"<u{width}").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        width, longest = data[0], data[1]
        many = np.frombuffer(data, "<u4", longest, 10)
        kinds = np.frombuffer(data, f"<u{width}", int(many.sum()), 10 + 4 * longest).astype(np.int64) + int.from_bytes(data[2:10], "little", signed=True)
        return cls(kinds, np.repeat(np.arange(longest), many))


class Shared:
    """The tables of a field's blocks: for the ids of bounds, and for the codes of vertices."""

    def __init__(self, ids: Table, codes: Table):
        self.ids, self.codes = ids, codes

    def to_bytes(self) -> bytes:
        return joined(self.ids.to_bytes(), self.codes.to_bytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> Shared:
        return cls(*map(Table.from_bytes, split(data)))


def zigzag(symbols: np.ndarray) -> bytes:
    """Differences to the symbol before, as non-negative numbers: seven bits a byte, the highest bit set where more follow."""
    d = np.diff(symbols.astype(np.int64), prepend=0)
    z = np.where(d >= 0, 2 * d, -2 * d - 1).astype(np.uint64)
    size = np.maximum(1, -(-np.frexp(z.astype(np.float64))[1] // 7))
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for b in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > b)
        out[start[live] + b] = ((z[live] >> np.uint64(7 * b)) & np.uint64(127)) | (np.where(size[live] > b + 1, 128, 0).astype(np.uint64))
    return len(symbols).to_bytes(4, "little") + out.tobytes()


def unzigzag(data: bytes) -> np.ndarray:
    count = int.from_bytes(data[:4], "little")
    raw = np.frombuffer(data, np.uint8, offset=4)
    ends = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if count else np.zeros(0, np.int64)
    which = np.repeat(np.arange(count), ends - first + 1 if count else 0)
    z = np.zeros(count, np.uint64)
    np.add.at(z, which, (raw & np.uint8(127)).astype(np.uint64) << (np.uint64(7) * (np.arange(len(raw)) - first[which]).astype(np.uint64)))
    z = z.astype(np.int64)
    return np.cumsum(np.where(z % 2 == 0, z // 2, -(z + 1) // 2))


CODINGS = {"huffman": (huffman, unhuffman), "zigzag": (zigzag, unzigzag)}
