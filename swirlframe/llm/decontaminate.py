"""Benchmark decontamination with suffix arrays over the training documents.

The documents are read in shards of whole documents.  Each shard gets a word-level
suffix array; every suffix (window start) of the benchmark is binary-searched in it,
which gives all places of its matches, and from runs of matching windows the longest
verbatim matches.  Nothing is shuffled: a shard knows all about its documents.

The benchmark is sent in blocks of at most BLOCK_BYTES of text, each its own broadcast, of which a worker holds one at a time.
Equal windows of a block are searched once; which items have them is kept apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as X

WINDOW = 13
#: Text bytes of a benchmark block and of a shard (a longer document is a shard of its own).
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 3 << 20


def suffix_array(seq: np.ndarray, pos: np.ndarray, depth: int) -> np.ndarray:
    """``pos`` in the order of the first ``depth`` symbols (or more) of seq from there; seq must end in ``depth`` zeros.

    Symbols are positive; a 0 ends a document, and what is beyond it does not count in the order.  Prefix doubling by packed ranks; after the first round only tied suffixes are sorted again.
    """
    g, bits = (3, 21) if len(seq) < 1 << 21 and seq.max(initial=0) < 1 << 21 else (2, 31)
    rank, have, sa = seq.astype(np.int64), 1, pos
    starts = np.zeros(0, bool)
    while have < depth and len(sa):
        ahead = np.concatenate([rank, np.zeros(g * have, np.int64)])

        def key(at, ahead=ahead, have=have):
            k = ahead[at]
            for j in range(1, g):
                k = (k << bits) | ahead[at + j * have]
            return k

        if not len(starts):
            k = key(sa)
            order = np.argsort(k)
            sa, k = sa[order], k[order]
            starts = np.concatenate([[True], k[1:] != k[:-1]])
        else:
            alone = starts & np.concatenate([starts[1:], [True]])
            tied = np.flatnonzero(~alone)
            if not len(tied):
                break
            k = key(sa[tied])
            order = np.argsort(k, kind="stable")
            sa[tied] = sa[tied][order]
            k = k[order]
            starts = starts.copy()
            starts[tied] |= np.concatenate([[True], k[1:] != k[:-1]])
        rank = np.zeros(len(seq), np.int64)
        rank[sa] = np.cumsum(starts)
        have *= g
    return sa


def search(seq: np.ndarray, sa: np.ndarray, patterns: np.ndarray, sizes: np.ndarray, right: bool) -> np.ndarray:
    """For each pattern (row, sizes[row] symbols) the first place in sa whose suffix is not below it (right: above it)."""
    low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(sa), np.int64)
    wide = np.arange(patterns.shape[1])
    inside = wide[None, :] < sizes[:, None]
    while (open_ := low < high).any():
        at = np.flatnonzero(open_)
        mid = (low[at] + high[at]) // 2
        there = seq[sa[mid][:, None] + wide]
        other = (there != patterns[at]) & inside[at]
        first = other.argmax(1)
        row = np.arange(len(at))
        below = np.where(other.any(1), there[row, first] < patterns[at][row, first], right)
        low[at[below]] = mid[below] + 1
        high[at[~below]] = mid[~below]
    return low


@dataclass
class Block:
    """Some benchmark items: word hashes, the distinct windows (where one begins among the words, and its size), and the
    occurrences of window w, occurs[first[w]:first[w + 1]], as items and places in them."""

    names: list
    words: np.ndarray
    start: np.ndarray
    size: np.ndarray
    first: np.ndarray
    item: np.ndarray
    inner: np.ndarray

    def occurrences(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of which, occurrence) of all occurrences of some windows."""
        many = self.first[which + 1] - self.first[which]
        row = np.repeat(np.arange(len(which)), many)
        return row, np.repeat(self.first[which], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)


def _block(items: pa.Table, window: int) -> Block:
    data, offs = X.flat(items.column("text"))
    data = X.LOWER[data]
    starts, ends, first = X.find_words(data, offs, X.ALNUM)
    words = X.word_hashes(data, starts, ends)
    n = np.diff(first)
    many = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
    item = np.repeat(np.arange(len(n)), many)
    inner = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
    start, size = first[item] + inner, np.minimum(n, window)[item]
    # equal windows are searched once: their words' codes, in columns
    padded = np.concatenate([np.unique(words, return_inverse=True)[1] + 1, np.zeros(window, np.int64)]) if len(words) else np.zeros(window, np.int64)
    inside = np.arange(window)[None, :] < size[:, None]
    rows = np.where(inside, padded[start[:, None] + np.arange(window)], 0)
    _, one, which = np.unique(rows, axis=0, return_index=True, return_inverse=True) if len(rows) else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(which.ravel(), kind="stable")
    bounds = np.searchsorted(which.ravel()[order], np.arange(len(one) + 1))
    return Block(items.column("item_id").to_pylist(), words, start[one], size[one], bounds, item[order], inner[order])


def _held(blocks: list) -> Iterator[Block]:
    """The blocks one after the other; a worker keeps a block only if there is no other."""
    for b in blocks:
        yield b.value
        if len(blocks) > 1 and hasattr(b, "_value"):
            del b._value  # read again from the executor's disk when it is needed


def _blocks(benchmark: DataFrame, window: int) -> list:
    """The benchmark in broadcasts of bounded size; read in order of item, a few rows at a time."""
    sc = benchmark.sparkSession.sparkContext
    out, rows, size = [], [], 0

    def close():
        nonlocal rows, size
        if rows:
            out.append(sc.broadcast(_block(pa.table({"item_id": pa.array([r[0] for r in rows]), "text": pa.array([r[1] for r in rows], pa.string())}), window)))
        rows, size = [], 0

    for r in benchmark.select("item_id", "text").toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= BLOCK_BYTES:
            close()
    close()
    return out


class Shard:
    """Words and suffix array of some whole documents."""

    def __init__(self, texts, window: int):
        data, offs = X.flat(texts)
        data = X.LOWER[data]
        starts, ends, self.first = X.find_words(data, offs, X.ALNUM)
        hashes = X.word_hashes(data, starts, ends)
        import pandas as pd

        codes, self.vocabulary = pd.factorize(hashes)
        self.order = np.argsort(self.vocabulary)
        n, docs = len(codes), len(self.first) - 1
        self.doc = np.repeat(np.arange(docs), np.diff(self.first))
        self.pos = np.arange(n) + self.doc
        self.window = window
        self.seq = np.zeros(n + docs + 3 * window + 1, np.int64)
        self.seq[self.pos] = codes + 1
        self.sa = suffix_array(self.seq, self.pos.copy(), window)

    def find(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(window of the block, place in seq) of every occurrence of every window."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.sa) or not len(block.start):
            return none
        spot = np.minimum(np.searchsorted(self.vocabulary, block.words, sorter=self.order), len(self.order) - 1)
        code = self.order[spot]
        code = np.where(self.vocabulary[code] == block.words, code + 1, 0)
        missing = np.concatenate([[0], np.cumsum(code == 0)])
        live = np.flatnonzero(missing[block.start + block.size] == missing[block.start])
        if not len(live):
            return none
        padded = np.concatenate([code, np.zeros(self.window, np.int64)])
        patterns, sizes = padded[block.start[live][:, None] + np.arange(self.window)], block.size[live]
        low, high = search(self.seq, self.sa, patterns, sizes, False), search(self.seq, self.sa, patterns, sizes, True)
        many = high - low
        which = np.repeat(live, many)
        return which, self.sa[np.repeat(low, many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)]


def _digest(names) -> str:
    return hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest()


_FLAGS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])


def _flags(shard: Shard, blocks: list, share: int) -> dict[str, np.ndarray]:
    delta = np.zeros(len(shard.seq) + 1, np.int64)
    items: list[set] = [set() for _ in range(len(shard.first) - 1)]
    for block in _held(blocks):
        which, at = shard.find(block)
        if len(which):
            np.add.at(delta, at, 1)
            np.add.at(delta, at + block.size[which], -1)
            doc = shard.doc[np.searchsorted(shard.pos, at)]
            found = np.unique(np.stack([doc, which], 1), axis=0)  # a window's items count once for a document
            row, of = block.occurrences(found[:, 1])
            for d, i in np.unique(np.stack([found[row, 0], block.item[of]], 1), axis=0):
                if block.names[i] is not None:
                    items[d].add(block.names[i])
    hit = (np.cumsum(delta)[shard.pos] > 0).astype(np.int64)
    n, h = np.diff(shard.first), X.segment_sums(hit, shard.first)
    return {"n_words": n, "n_hit": h, "n_items": np.array([len(s) for s in items], np.int64), "items_sha256": [_digest(s) for s in items], "contaminated": (h > 0) & (share * h >= n)}


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased.  A window is
    ``window`` consecutive words of an item (all words of a shorter one); a document word inside
    any occurrence of a window is hit; a document is contaminated if share * n_hit >= n_words > 0
    and n_hit > 0.  Null texts, of either table, have no words.  Items of one id count once,
    items with a null id hit words but are not counted.  Extra columns are not read.
    """
    blocks = _blocks(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches, "_text", SHARD_BYTES):
            found = _flags(Shard(part.column(1), window), blocks, share)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v) for v in found.values())], [id_col, *found])

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, T.StructType([rows.schema[0], *_FLAGS]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """docs without the contaminated rows (see contamination()); all columns stay, and nothing is shuffled."""
    blocks = _blocks(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches, text_col, SHARD_BYTES):
            found = _flags(Shard(part.column(part.schema.get_field_index(text_col)), window), blocks, share)
            yield part.filter(pa.array(~found["contaminated"]))

    return docs.mapInArrow(run, docs.schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Maximal verbatim matches of at least ``window`` words: id, item_id (as text), item_word, doc_word (from 0), n_words.

    Windows that match on one diagonal one after the other are one longest match.
    """
    blocks = _blocks(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches, "_text", SHARD_BYTES):
            shard = Shard(part.column(1), window)
            for block in _held(blocks):
                which, at = shard.find(block)
                if not len(which):
                    continue
                row, of = block.occurrences(which)
                word = np.searchsorted(shard.pos, at)[row]
                doc, item, inner, size = shard.doc[word], block.item[of], block.inner[of], block.size[which][row]
                order = np.lexsort((word, word - inner, item))
                word, item, inner, size, doc = word[order], item[order], inner[order], size[order], doc[order]
                new = np.concatenate([[True], (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (word[1:] - inner[1:] != word[:-1] - inner[:-1]) | (word[1:] != word[:-1] + 1)])
                head = np.flatnonzero(new)
                run_len = np.diff(np.concatenate([head, [len(new)]]))
                names = pa.array([None if block.names[i] is None else str(block.names[i]) for i in item[head]], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc[head])), names, pa.array(inner[head]), pa.array(word[head] - shard.first[doc[head]]), pa.array(size[head] + run_len - 1)], [id_col, "item_id", "item_word", "doc_word", "n_words"])

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("item_id", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("item_word", "doc_word", "n_words"))]))
