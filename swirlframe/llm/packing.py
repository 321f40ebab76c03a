"""Packing of tokenised documents into sequences of bounded length.

Only the histogram of piece lengths (at most ``capacity`` numbers) decides how
sequences are made up, so the driver solves that bounded problem and Spark deals the
pieces out by their rank among the pieces of their length.

The solver first applies the Martello-Toth dominance reduction: a small set that
provably dominates all others for its largest piece is fixed for good.  What is left
goes by best fit, longest pieces first.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as X
from .shared import cut, written

CAPACITY = 4096
#: Words whose ids a Python worker keeps; it starts anew beyond that.
KEPT_WORDS = 600_000


#: Classes of bytes for WordTokens: 0 white space, 1 ASCII letter, 2 other ASCII, 3 apostrophe, 4 outside ASCII.
_CLASS = np.array([0 if not X.NONSPACE[b] else 4 if b >= 0x80 else 1 if chr(b).isalpha() else 3 if b == 0x27 else 2 for b in range(256)], np.uint8)
#: Special tokens are found before texts are split; rows that hold one are tokenised in one go.
_SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")


class WordTokens:
    """Token ids of texts by the lower-casing tokenizer whose pieces are runs of letters, single
    digits, runs of other characters, or an apostrophe with some letters.

    Such pieces never cross ASCII white space, nor a border of an ASCII letter and another ASCII
    character (but for an apostrophe before a letter).  So a text is cut there, each different
    part is tokenised once, and its ids are reused.  ASCII capitals are lowered first, but for
    those before a character outside ASCII, which may combine with them.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already use all cores
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode_batch_fast
        self.clear()

    def clear(self):
        #: Sorted hashes of known parts, and the entry of each: where its ids begin in flat, and how many.
        self.known, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.at, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = self.entries = 0

    def learn(self, hashes: np.ndarray, words: list[str]):
        for i in range(0, len(words), 4096):
            ids = [e.ids for e in self.encode(words[i : i + 4096], add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            new = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
            base = self.entries
            while self.used + len(new) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
            while base + len(ids) > len(self.at):
                self.at, self.size = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.at, self.size))
            self.flat[self.used : self.used + len(new)] = new
            self.at[base : base + len(ids)] = self.used + np.cumsum(sizes) - sizes
            self.size[base : base + len(ids)] = sizes
            self.used += len(new)
            self.entries += len(ids)
        order = np.argsort(hashes)
        at = np.searchsorted(self.known, hashes[order])
        self.known = np.insert(self.known, at, hashes[order])
        self.entry = np.insert(self.entry, at, self.entries - len(hashes) + order)

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): row d has ids[first[d]:first[d+1]]."""
        data, offs = X.flat(texts)
        body = data.tobytes()
        if any(s in body for s in _SPECIAL):
            ids = [e.ids for e in self.encode(texts.fill_null("").to_pylist(), add_special_tokens=False)]
            first = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
            return np.fromiter(chain.from_iterable(ids), np.uint32, int(first[-1])), first
        kind = _CLASS[data]
        plain = np.ones(len(data), bool)
        plain[:-1] = kind[1:] != 4
        data = np.where(plain, X.LOWER[data], data)
        row_start = np.zeros(len(data) + 1, bool)
        row_start[offs[:-1]] = True
        begin, end = kind > 0, kind > 0
        if len(data):
            left, right = kind[:-1], kind[1:]
            border = (left == 0) | row_start[1:-1] | ((left == 1) & ((right == 2) | (right == 3))) | ((left == 2) & (right == 1))
            begin[1:] &= border
            end[:-1] &= border | (right == 0)
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        first = np.searchsorted(starts, offs)
        codes, unique = pd.factorize(X.word_hashes(data, starts, ends))
        if len(self.known) + len(unique) > KEPT_WORDS and len(self.known):
            self.clear()
        spot = np.searchsorted(self.known, unique)
        old = np.concatenate([self.known, np.zeros(1, np.uint64)])[spot] == unique
        old &= spot < len(self.known)
        entry = np.zeros(len(unique), np.int64)
        entry[old] = self.entry[spot[old]]
        new = np.flatnonzero(~old)
        if len(new):
            where = np.zeros(len(unique), np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]
            body = data.tobytes()
            at = where[new]
            self.learn(unique[new], [body[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            entry[new] = np.arange(self.entries - len(new), self.entries)
        word = entry[codes]
        size = self.size[word]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.at[word] - total[:-1], size) + np.arange(total[-1])]
        return ids, total[first]


@lru_cache(1)
def _tokens(path: str) -> WordTokens:
    """One per Python worker: what one task has learned serves the next."""
    return WordTokens(path)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents: id, piece (from 0), start, length, ids (binary, little-endian unsigned 32-bit).

    A document is the ids of its text (null: empty) and then end_id.  It is cut every ``capacity``
    ids only if it is longer.  Repeated rows give repeated pieces; extra columns are not read.
    tokenizer: the path of a ``tokenizers`` file, on every executor, whose pieces end at white space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer)
        for part in X.slices(batches, "_text", 2 << 20):
            ids, first = tokens(part.column(1))
            n = np.diff(first) + 1
            last = np.cumsum(n) - 1
            out = np.full(int(n.sum()), end_id, "<u4")
            keep = np.ones(len(out), bool)
            keep[last] = False
            out[keep] = ids
            many = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(n[doc] - start, capacity)
            offs = np.concatenate([[0], np.cumsum(length) * 4]).astype(np.int32)
            body = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offs), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), body], [id_col, "piece", "start", "length", "ids"])

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    schema = T.StructType([rows.schema[0], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def reduce_dominated(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Sets fixed by dominance, as (lengths, how many); takes them out of ``counts`` (by length).

    For a piece of length w, let s be the most further pieces that fit with it.  s = 0: it stays
    alone.  s = 1, or an exact fit with one other: it goes with the largest that fits.  s = 2: it
    goes with the largest alone if that is no smaller than any pair that fits, or with the pair of
    the largest and b if no pair that fits has a smaller piece above b.  Else it is not fixed.
    """
    cap, fixed = len(counts) - 1, []
    size = cap
    while size:
        if not counts[size]:
            size -= 1
            continue
        counts[size] -= 1  # the piece itself
        there = np.flatnonzero(counts)
        few = np.repeat(there[:3], np.minimum(counts[there[:3]], 3))[:3]
        s = int(np.searchsorted(np.cumsum(few), cap - size, side="right"))
        best: tuple[int, ...] | None = None
        if s == 0:
            best = ()
        else:
            room = cap - size
            fit = there[there <= room]
            top = int(fit[-1])
            if s == 1 or top == room:
                best = (top,)
            elif s == 2:
                # for each first piece a the largest second b <= a that fits
                limit = np.minimum(room - fit, fit)
                b = fit[np.maximum(np.searchsorted(fit, limit, side="right") - 1, 0)]
                ok = (b <= limit) & ((b < fit) | (counts[fit] > 1))
                below = np.searchsorted(fit, fit) - 1
                second = fit[np.maximum(below, 0)]
                alone = (b == fit) & (counts[fit] == 1) & (below >= 0) & (second <= limit)
                b, ok = np.where(alone, second, b), ok | alone
                pairs = ok & (b + fit <= room)
                if not pairs.any() or top >= (fit + b)[pairs].max():
                    best = (top,)
                elif pairs[-1] and b[-1] >= b[pairs].max():
                    best = (top, int(b[-1]))
        counts[size] += 1
        if best is None:
            size -= 1
            continue
        group = (size, *best)
        many = min(int(counts[x]) // group.count(x) for x in set(group))
        for x in group:
            counts[x] -= many
        fixed.append((group, many))
    return fixed


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best fit of all pieces in ``counts`` (by length), longest first; equal bins are handled together."""
    cap = len(counts) - 1
    rooms: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(cap + 1)]
    free = np.zeros(cap + 1, bool)

    def put(room: int, group: tuple[int, ...], many: int):
        if many:
            rooms[room].append((group, many))
            free[room] = True

    for size in range(cap, 0, -1):
        n = int(counts[size])
        while n:
            room = size + int(free[size:].argmax())
            if free[room]:
                group, bins = rooms[room].pop()
                free[room] = bool(rooms[room])
            else:
                room, group, bins = cap, (), -(-n // (cap // size))
            each = room // size
            full = min(bins, n // each)
            put(room - each * size, group + (size,) * each, full)
            n -= full * each
            rest = 0
            if full < bins and n:
                put(room - n * size, group + (size,) * n, 1)
                rest, n = 1, 0
            if group:
                put(room, group, bins - full - rest)
    return [x for r in rooms for x in r]


def solve(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """How sequences are made up: (lengths in order, number of such sequences)."""
    counts = counts.astype(np.int64).copy()
    return reduce_dominated(counts) + best_fit(counts)


def _runs(groups: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, in order of rank: from which rank on pieces lie at which offset, from which sequence on."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    bin_ = 0
    for group, many in groups:
        offset = 0
        for size in group:
            found.setdefault(size, []).append((many, bin_, offset))
            offset += size
        bin_ += many
    size, rank, seq, off = [], [], [], []
    for x in sorted(found):
        at = 0
        for many, b, o in found[x]:
            size.append(x), rank.append(at), seq.append(b), off.append(o)
            at += many
    return {"size": np.array(size, np.int64), "rank": np.array(rank, np.int64), "seq": np.array(seq, np.int64), "off": np.array(off, np.int64)}


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset: where each piece of its ``length`` (1 to capacity) lies.

    Offsets leave no gap and sequences hold at most ``capacity``.  Pieces of one length are
    interchangeable, so ties in ``order`` only decide which of them goes where.  pieces should be
    narrow and cheap to read again, as it is read twice; an empty table gives an empty one.
    """
    spark = pieces.sparkSession
    total = pieces.count()
    parts = max(64, total // 200_000)  # pieces of one length are ranked in so many parts
    dealt = pieces.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    sums = cut(dealt.groupBy("length", "_part").agg(F.count("*").alias("_n")))
    per_length = {r[0]: r[1] for r in sums.groupBy("length").agg(F.sum("_n")).collect()}  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in per_length.items():
        counts[size] = n
    runs = spark.sparkContext.broadcast(_runs(solve(counts)))
    before = sums.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy(*order)).cast("long") - 1)
    ranked = ranked.join(before, ["length", "_part"]).select(*pieces.columns, (F.col("_rank") + F.col("_before")).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = runs.value
        big = np.int64(1) << 48
        keys = r["size"] * big + r["rank"]
        for b in batches:
            size, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(keys, size * big + rank, side="right") - 1
            rest = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(r["seq"][at] + rank - r["rank"][at]), pa.array(r["off"][at])], [*b.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(run, T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pieces, places): the pieces with their ids (token_pieces(), written to the shared folder), and for each of
    them id, piece, start, length, ids_crc32, sequence_id, offset.  Join them on id and piece for the sequences' ids."""
    pieces = written(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    narrow = cut(pieces.select(id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return pieces, pack(narrow, [id_col, "piece"], capacity)
