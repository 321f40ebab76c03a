"""Near duplicates by a chosen-path similarity join over word shingles.

Several independent trees each send a document down a path of minwise tokens: a node is
the documents that chose the same tokens so far.  Nodes of at most SMALL documents are
compared exhaustively; larger ones branch on by the next token, down to DEPTH.  Of a node
that is still larger there (a big group of near copies, as a rule), all members are compared
with two pivots, and then only members that are not in the pivot's component with all others,
as a query set that is broadcast in blocks.

A pair of similarity J meets in a tree with probability J, or J**2, ... where tokens are so
common that nodes branch: at J = 0.8 and twenty trees 1e-14 are missed where tokens are rare,
3e-5 if every token of the pair is very common, at any size of the corpus (DEPTH is the last branching).  Before texts are fetched, sizes and a sketch of 48
four-bit minwise values are compared (at J = 0.8 under 1e-6 are lost).  Every link is then
confirmed on the full sets of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as X
from .shared import bit_map, components, cut, looked_up, only, place, sized, spread, text_key, without, without_rows, written

TREES, DEPTH, SMALL = 20, 4, 32
ROW_BITS = 12  # at most so many rows (as a power of two) are handled at once; shingle hashes keep the other 52 bits
#: Texts, and bytes of text, that are held against all members of large nodes at once.
QUESTIONS, QUESTION_BYTES = 2_000, 8 << 20
SKETCH = ["s0", "s1", "s2"]
#: Texts that are held against one other in one task, when links are confirmed.
PART = 500


def _few_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in parts:
        for i in range(0, p.num_rows, 1 << ROW_BITS):
            yield p.slice(i, 1 << ROW_BITS)


def distinct_shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of each row's distinct k-word shingles."""
    h, at = X.row_shingles(words, first, k)
    row = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    keys = np.sort(row << np.uint64(64 - ROW_BITS) | h >> np.uint64(ROW_BITS))
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    rows = (keys >> np.uint64(64 - ROW_BITS)).astype(np.int64)
    return keys << np.uint64(ROW_BITS), np.searchsorted(rows, np.arange(len(at)))


def minwise(shingles: np.ndarray, first: np.ndarray, many: int) -> np.ndarray:
    """The smallest value of each row's shingles under each of ``many`` hash functions: (rows, many)."""
    odd = X.mix(np.arange(1, many + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.zeros((len(first) - 1, many), np.uint64)
    for f in range(many):
        out[:, f] = X.segment_mins(shingles * odd[f], first, np.uint64(0))
    return X.mix(out)


def sequence_hashes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each row's sequence of words."""
    at = (np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64) + np.uint64(1)
    a, b = X.mix(words + at * X._C1), X.mix(words * X._C2 ^ X.mix(at * X._C3))
    return X.segment_sums(a, first), X.segment_sums(b, first)


def sketches(values: np.ndarray) -> list[np.ndarray]:
    """Four bits of each of 48 minwise values, 16 to a column."""
    nibbles = values[:, :48] >> np.uint64(60)
    return [sum(nibbles[:, 16 * c + j] << np.uint64(4 * j) for j in range(16)).astype(np.uint64).view(np.int64) for c in range(3)]


def path_keys(values: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Node keys (rows, trees, depth): each level's key is of the path so far and that level's token."""
    out = np.zeros((len(values), trees, depth), np.uint64)
    for t in range(trees):
        key = X.mix(np.full(len(values), t + 1, np.uint64))
        for d in range(depth):
            key = X.mix(key * X._C1 ^ values[:, t * depth + d])
            out[:, t, d] = key
    return out


def _list_column(values: np.ndarray) -> pa.Array:
    values = values.reshape(len(values), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel().view(np.int64)))


def signatures(texts: DataFrame, k: int, table: np.ndarray, trees: int = TREES, depth: int = DEPTH, least: int = 1, last: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """Of (id, body, also): id, n (distinct shingles; 0 for texts of fewer than ``least`` words), c1, c2 (of the words), keys
    (of all levels of all trees; last: of each tree's last level, which makes a tree a band of ``depth`` values), sketch, also."""
    names = ["id", "n", "c1", "c2", "keys", *SKETCH, *also]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _few_rows(X.slices(batches, "body")):
            data, offs = X.flat(part.column(1))
            data = X.LOWER[data]
            starts, ends, first = X.find_words(data, offs, table)
            words = X.word_hashes(data, starts, ends)
            if least > 1:
                size = np.diff(first)
                words = words[np.repeat(size >= least, size)]
                first = np.concatenate([[0], np.cumsum(np.where(size >= least, size, 0))])
            shingles, at = distinct_shingles(words, first, k)
            values = minwise(shingles, at, max(trees * depth, 48))
            c1, c2 = sequence_hashes(words, first)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), _list_column(path_keys(values, trees, depth)[:, :, depth - 1 if last else 0 :]), *map(pa.array, sketches(values)), *part.columns[2:]], names)

    rows = texts.select("id", "body", *also)
    long_ = [T.StructField(c, T.LongType()) for c in names[1:4]]
    return rows.mapInArrow(run, T.StructType([rows.schema[0], *long_, T.StructField("keys", T.ArrayType(T.LongType())), *(T.StructField(c, T.LongType()) for c in SKETCH), *rows.schema[2:]]))


def _alike(percent: int) -> Column:
    """Whether rows a and b may be as similar: by size exactly, by sketch with a wide margin."""
    differ = []
    for c in SKETCH:
        x = F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))
        folded = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        differ.append(F.bit_count(folded.bitwiseAND(F.lit(0x1111111111111111))))
    size = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent
    return size & (reduce(lambda p, q: p + q, differ) <= 24)


def node_pairs(members: DataFrame, about: DataFrame, depth: int, percent: int, small: int = SMALL, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, large): candidate pairs (a, b) with a < b, and the members of nodes that are large at the last level.

    members: id and k1..k<depth>, a row for each tree; about: id, n and sketch.  bits: members go on to the join with the sizes of their nodes only
    if their bit is set in a map of 2**bits bits of the keys that members share; for keys of which most are of one member.
    """
    pair = [F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")]
    found, rows = [], members
    for d in range(1, depth + 1):
        key = f"k{d}"
        sizes = cut(rows.groupBy(key).agg(F.count("*").alias("_size")).filter("_size > 1"))
        if bits:
            rows = looked_up(rows, cut(bit_map(sizes.select(key), bits)), place(bits, F.col(key)), "_shared").filter("_shared").drop("_shared")
        rows = spread(rows, sizes, [key], "_size", ["id"], most=0)
        rows = written(rows.join(about, "id") if d == 1 else rows, "nodes")
        few = rows.filter(F.col("_size") <= small)
        found.append(few.alias("a").join(few.alias("b"), (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.id") < F.col("b.id")) & _alike(percent)).select(*pair))
        rows = rows.filter(F.col("_size") > small).drop("_size")
    kept = [key, "id", "n", *SKETCH]
    large = cut(rows.select(*kept).withColumnRenamed(key, "node"))
    one = F.struct("id", "n", *SKETCH)
    pivots = cut(large.groupBy("node").agg(F.array(F.min(one), F.max(one)).alias("b"), F.count("*").alias("_n")))
    held = spread(large, pivots, ["node"], "_n", ["id"]).select(one.alias("a"), F.explode("b").alias("b"))
    found.append(held.filter((F.col("a.id") != F.col("b.id")) & _alike(percent)).select(*pair))
    return cut(reduce(DataFrame.unionByName, found).distinct()), large


def verified(pairs: DataFrame, bodies: DataFrame, k: int, percent: int, nonspace: bool = True) -> DataFrame:
    """The pairs (a, b) whose texts in bodies (id, body) have 100 * shared >= percent * all distinct k-word shingles.

    Compares the words themselves.  nonspace: words are runs without ASCII white space, else of
    digits, letters and non-ASCII characters.  Of a pair the text that has more pairs goes first: it is sent once to each
    task that holds it against others, at most PART of them, whose texts follow it one by one.
    """
    table = cut(pairs)
    ends = table.select(F.col("a").alias("id")).union(table.select("b")).groupBy("id").agg(F.count("*").alias("n"))
    many = sized(cut(ends.filter(F.col("n") > PART)))
    of = lambda c: many.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"))
    both = table.join(of("a"), "a", "left").join(of("b"), "b", "left")
    swap = F.coalesce("n_b", F.lit(0)) > F.coalesce("n_a", F.lit(0))
    head, tail = F.when(swap, F.col("b")).otherwise(F.col("a")), F.when(swap, F.col("a")).otherwise(F.col("b"))
    parts = F.ceil(F.greatest(F.coalesce("n_a", F.lit(1)), F.coalesce("n_b", F.lit(1))) / PART).cast("long")
    dealt = cut(both.select(head.alias("head"), F.pmod(F.xxhash64(tail), parts).alias("part"), tail.alias("tail")))
    first = dealt.select("head", "part").distinct().join(bodies.withColumnRenamed("id", "head"), "head").select("head", "part", F.lit(None).cast(dealt.schema["tail"].dataType).alias("tail"), "body")
    rest = dealt.join(bodies.withColumnRenamed("id", "tail"), "tail").select("head", "part", "tail", "body")
    rows = first.unionByName(rest).repartition("head", "part").sortWithinPartitions("head", "part", F.col("tail").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        words = (lambda t: t.split()) if nonspace else re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall

        def shingles(text: str) -> set:
            w = words(text.encode().lower())
            return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()

        now, sets, ended = None, [], True
        for b in X.slices(batches, "body"):
            ok = []
            for x, part, y, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if y is None:
                    if ended or (x, part) != now:
                        now, sets, ended = (x, part), [], False
                    sets.append(shingles(body))
                    ok.append(False)
                    continue
                ended = True
                q = shingles(body)
                ok.append(any((n := len(p & q)) and 100 * n >= percent * (len(p) + len(q) - n) for p in sets))
            yield b.select([0, 2]).filter(pa.array(ok, pa.bool_()))

    found = rows.mapInArrow(run, T.StructType([rows.schema["head"], rows.schema["tail"]]))
    return found.select(F.least("head", "tail").alias("a"), F.greatest("head", "tail").alias("b")).distinct()


def _bodies(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    ends = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    return written(only(texts, ends, "id"), "bodies")


class Questions:
    """Some texts, indexed by shingle, to be held against others: intersections of all with a batch in one count."""

    def __init__(self, ids: list, components: list, texts: list[str], k: int, table: np.ndarray):
        self.ids, self.components, self.k, self.table = ids, components, k, table
        h, first = self.shingles(pa.array(texts, pa.string()))
        self.size = np.diff(first)
        owner = np.repeat(np.arange(len(ids)), self.size)
        order = np.argsort(h, kind="stable")
        self.keys, begin = np.unique(h[order], return_index=True)
        self.begin, self.owner = np.append(begin, len(h)), owner[order]

    def shingles(self, texts) -> tuple[np.ndarray, np.ndarray]:
        data, offs = X.flat(texts)
        data = X.LOWER[data]
        starts, ends, first = X.find_words(data, offs, self.table)
        return distinct_shingles(X.word_hashes(data, starts, ends), first, self.k)

    def answers(self, texts, percent: int, most: int = 500_000) -> Iterator[tuple[int, int, float]]:
        """(row, question, similarity) of all pairs that reach ``percent``; at most ``most`` counts (or a row's) at a time."""
        h, first = self.shingles(texts)
        if not len(self.keys) or not len(h):
            return
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        many = np.where(self.keys[at] == h, self.begin[at + 1] - self.begin[at], 0)
        done, size = 0, np.diff(first)
        load = X.segment_sums(many, first) + len(self.ids)
        total = np.concatenate([[0], np.cumsum(load)])
        while done < len(size):
            end = max(done + 1, int(np.searchsorted(total, total[done] + most, side="right")) - 1)
            part = slice(first[done], first[end])
            n = many[part]
            row = np.repeat(np.repeat(np.arange(end - done), size[done:end]), n)
            which = self.owner[np.repeat(self.begin[at[part]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            both = np.bincount(row * len(self.ids) + which, minlength=(end - done) * len(self.ids)).reshape(end - done, -1)
            union = size[done:end, None] + self.size[None, :] - both
            for r, q in zip(*np.nonzero((both > 0) & (100 * both >= percent * union)), strict=True):
                yield done + int(r), int(q), both[r, q] / union[r, q]
            done = end


def held_against(asked: DataFrame, all_: DataFrame, k: int, percent: int, nonspace: bool) -> DataFrame:
    """Pairs (a, b): for each text of ``asked`` and each other component, a link from each batch of ``all_`` that has one.

    Both are (id, component, body).  asked goes to the executors in blocks of bounded size, each held
    against all rows, one after the other; pairs are only ever counted, and at most one for a text and a component is given on.
    """
    sc, table = asked.sparkSession.sparkContext, X.NONSPACE if nonspace else X.ALNUM
    kind = asked.schema["id"].dataType
    plain = (lambda x: x.asDict(True)) if isinstance(kind, T.StructType) else (lambda x: x)
    out: list[DataFrame] = []

    def close(rows: list):
        sent = sc.broadcast(Questions([plain(r[0]) for r in rows], [plain(r[1]) for r in rows], [r[2] for r in rows], k, table))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = sent.value
            for part in _few_rows(X.slices(batches, "body")):
                mine = part.column(1).to_pylist()
                best: dict = {}
                for r, u, share in q.answers(part.column(2), percent):
                    if mine[r] != q.components[u] and share > best.get((u, str(mine[r])), (0,))[0]:
                        best[u, str(mine[r])] = (share, r)
                if best:
                    left = part.column(0).take(pa.array([r for _, r in best.values()]))
                    ids = [q.ids[u] for u, _ in best]
                    yield pa.RecordBatch.from_arrays([left, pa.array(ids, left.type)], ["a", "b"])

        out.append(cut(all_.select("id", "component", "body").mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))))
        sent.destroy()

    rows, size = [], 0
    for r in asked.select("id", "component", "body").toLocalIterator():
        rows.append(r)
        size += len(r[2])
        if size > QUESTION_BYTES or len(rows) >= QUESTIONS:
            close(rows)
            rows, size = [], 0
    if rows:
        close(rows)
    found = reduce(DataFrame.unionByName, out)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def link_components(texts: DataFrame, pairs: DataFrame, large: DataFrame, k: int, percent: int, nonspace: bool = True) -> tuple[DataFrame, DataFrame]:
    """(links, labels): confirmed links (a, b), and (id, component) of all linked ids.

    Members of large nodes that are not in their pivot's component are held against all members of
    large nodes, so no link between components of a node is missed.
    """
    links = cut(verified(pairs, _bodies(texts, pairs), k, percent, nonspace))
    labels = cut(components(links))
    if not large.isEmpty():
        labelled = cut(large.select("node", "id").join(labels, "id", "left").select("node", "id", F.coalesce("component", "id").alias("component")))
        main = labelled.groupBy("node").agg(F.min(F.struct("id", "component")).alias("p")).select("node", F.col("p.component").alias("main"))
        main = sized(cut(main))
        open_ = labelled.join(main, "node").filter("component <> main")
        asked = cut(open_.select("id", "component").distinct())
        if not asked.isEmpty():
            nodes = open_.select("node").distinct()
            there = cut(labelled.join(nodes, "node", "left_semi").select("id", "component").distinct())
            bodies = written(only(texts, there.select("id"), "id"), "members").dropDuplicates(["id"])
            there = cut(there.join(bodies, "id"))
            more = cut(held_against(there.join(asked.select("id"), "id", "left_semi"), there, k, percent, nonspace))
            if not more.isEmpty():
                links = cut(links.union(verified(more, there.select("id", "body"), k, percent, nonspace)).distinct())
                labels = cut(components(links))
    return links, labels


def _groups(rows: DataFrame, k: int, percent: int, also: tuple[str, ...] = ()) -> DataFrame:
    """(id, n, component, also) of rows (id, body, also)."""
    found = written(signatures(rows, k, X.NONSPACE, also=also), "signatures")
    full = found.filter("n > 0 and id is not null")
    some = full.select("id", "n", "c1", "c2", *also)
    classes = some.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.count("*").alias("_many")).filter("_many > 1")
    classes = cut(classes)
    copies = cut(spread(some.select("id", "c1", "c2"), classes, ["c1", "c2"], "_many", ["id"]).filter("id <> rep").select("id", "c1", "c2", "rep"))
    single = without(full.drop(*also), copies.select("id", "c1", "c2"), ["id", "c1", "c2"])
    key = [F.element_at(F.col("keys"), F.col("_t") * DEPTH + d).alias(f"k{d}") for d in range(1, DEPTH + 1)]
    members = single.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).select("id", *key)
    pairs, large = node_pairs(members, single.select("id", "n", *SKETCH), DEPTH, percent)
    links, labels = link_components(rows.select("id", "body"), pairs, large, k, percent)
    # an id that has one text of a class and another that others are compared with links the two
    again = copies.join(single.select("id").distinct(), "id", "left_semi").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    if not again.isEmpty():
        labels = cut(components(links.union(again)))
    labels = labels.select("id", "component")
    of_class = cut(classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("c1", "c2", "_many", F.coalesce("component", "rep").alias("of_class")))
    whole = spread(some, of_class, ["c1", "c2"], "_many", ["id"], "left").join(labels, "id", "left")
    whole = whole.select("id", "n", F.coalesce("of_class", "component", "id").alias("component"), *also)
    return whole.unionByName(found.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component"), *also))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (smallest id reached by links, itself included), kept.

    Words are runs without ASCII white space, A-Z lower-cased.  Two texts are linked if their sets
    of distinct k-word shingles (a shorter text is one shingle) overlap by ``percent`` of their union.
    Null texts and texts without words have no shingles, are linked with nothing and stay, as do rows
    with a null id (component_id null).  Rows of one id are one document, so the links of each of its texts count for all.  Equal sequences of words
    are handled once.  Extra columns are not read.
    """
    out = _groups(docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("body")), k, percent)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near duplicates, the one with the smallest id; all columns stay.

    Rows go by id and text, as near_groups() says of each.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("body"), text_key(text_col).alias("_text"))
    gone = _groups(rows, k, percent, ("_text",)).filter("id <> component").select("id", "_text")
    return without_rows(docs, gone, id_col, text_key(text_col))
