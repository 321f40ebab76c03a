"""Passages that repeat across documents, by MinHash banding of paragraphs.

A paragraph is a line; those of at least LEAST words take part.  Bands of ROWS minwise values
over five-word shingles are tuned for recall: at a similarity of 0.8 a pair shares no band
with probability (1 - 0.8**ROWS)**BANDS = 6e-7.  Colliding paragraphs are joined, checked by
exact Jaccard similarity of their shingles, and clustered by components.  The first paragraph of
a component stays.

A passage within longer lines has no border of its own.  For these, windows of WINDOW words are
paragraphs too, chosen by their content (winnowing, Schleimer et al. 2003): of every REACH
consecutive windows the one with the smallest hash.  So any run of WINDOW + REACH - 1 = 51 words that
two documents share has a chosen window in both.  Windows match if they are equal: their
similarity is 1 and all bands would be the same, so one 96-bit hash stands for the bands.  Of the windows only
those go on whose bit is set in a map of 2**BITS bits of the hashes that documents share; it is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as X
from .near_dedup import SKETCH, link_components, node_pairs, signatures
from .shared import bit_map, cut, fresh, looked_up, only, place, sized, spread, text_key, without, written

BANDS, ROWS, LEAST = 14, 2, 50
WINDOW, REACH = 26, 26
LONG = WINDOW + REACH - 1
#: Bits (as a power of two) of the map of shared windows: at most 2**BITS / 64 rows of 16 bytes.
BITS = 25


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per paragraph that repeats: id, para (line from 0), n_shingles, component_doc, component_para, removed.

    Words are runs without ASCII white space, A-Z lower-cased.  component_* is the first paragraph
    (by id, then line) that links reach; it is not removed, the others are.  Paragraphs without a
    near copy have no row.  Null texts and ids have no paragraphs; rows of one id are one document,
    so repeated rows are no repeats, but a paragraph that repeats within a document is one.
    """
    lines = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n", -1)).alias("para", "body"))
    lines = lines.filter(F.length("body") >= 2 * least - 1).select(F.struct("doc", "para").alias("id"), "body")
    found = written(signatures(lines, k, X.NONSPACE, BANDS, ROWS, least, last=True).filter("n > 0"), "passages")
    classes = cut(found.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.count("*").alias("_many")).filter("_many > 1"))
    copies = spread(found.select("id", "c1", "c2"), classes, ["c1", "c2"], "_many", ["id"]).filter("id <> rep").select("id", "c1", "c2")
    single = without(found, copies, ["id", "c1", "c2"])
    members = single.select("id", F.explode("keys").alias("k1"))
    pairs, large = node_pairs(members, single.select("id", "n", *SKETCH), 1, percent, bits=BITS)
    _, labels = link_components(lines, pairs, large, k, percent)
    # paragraphs with an equal one, and paragraphs linked with another
    of_class = cut(classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("c1", "c2", "_many", F.coalesce("component", "rep").alias("of_class")))
    out = spread(found.select("id", "n", "c1", "c2"), of_class, ["c1", "c2"], "_many", ["id"], "left").join(labels, "id", "left")
    out = cut(out.select("id", "n", F.coalesce("of_class", "component").alias("component")).filter("component is not null").distinct())
    # repeated rows of one id: the same paragraph is no repeat of itself
    sizes = cut(out.groupBy("component").agg(F.count("*").alias("_size")).filter("_size > 1"))
    out = spread(out, sizes, ["component"], "_size", ["id"])
    return out.select(F.col("id.doc").alias(id_col), F.col("id.para").cast("long").alias("para"), F.col("n").alias("n_shingles"), F.col("component.doc").alias("component_doc"), F.col("component.para").cast("long").alias("component_para"), (F.col("id") != F.col("component")).alias("removed"))


def chosen_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, lines: bool = False) -> DataFrame:
    """(doc, at, h, g): places (in words from 0) and hashes of the chosen windows of all documents with an id; ``lines`` adds line and last, the first and last line of each."""

    names = ["line", "last"] if lines else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches, "_text"):
            data, offs = X.flat(part.column(1))
            data = X.LOWER[data]
            starts, ends, first = X.find_words(data, offs, X.NONSPACE)
            h = X.window_hashes(X.word_hashes(data, starts, ends), WINDOW)
            if len(h) < 1:
                continue
            # the smallest of reach windows is smallest in some reach windows that hold it; beyond the ends nothing is smaller
            edge = np.full(reach - 1, ~np.uint64(0))
            low = X.sliding(np.concatenate([edge, h, edge]), reach, np.minimum)
            chosen = X.sliding(low, reach, np.maximum) == h
            at = np.flatnonzero(chosen)
            row = np.searchsorted(first, at, side="right") - 1
            inside = at + WINDOW <= first[row + 1]
            at, row = at[inside], row[inside]
            hashes = h[at]
            second = X.mix(X.window_hashes(X.mix(X.word_hashes(data, starts, ends) ^ X._C3), WINDOW)[at])
            more = [pa.array(_lines_of(data, offs, starts[w], row)) for w in (at, at + WINDOW - 1)] if lines else []
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array((at - first[row]).astype(np.int32)), pa.array(hashes.view(np.int64)), pa.array((second >> np.uint64(32)).astype(np.uint32).view(np.int32)), *more], ["doc", "at", "h", "g", *names])

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("at", T.IntegerType()), T.StructField("h", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in ["g", *names])]))


def _lines_of(data: np.ndarray, offs: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The lines (from 0, within their rows) of the bytes ``at``, which are in the rows ``row``."""
    ends = np.flatnonzero(data == 10)
    return (np.searchsorted(ends, at) - np.searchsorted(ends, offs[row])).astype(np.int32)


def _long_windows(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, passage: int = LONG, gone: DataFrame | None = None) -> DataFrame:
    """(doc, start, low): windows of ``passage`` words around members (doc, at, left, right) that two documents share, and the first (doc, start) of each.

    Of the windows of ``passage`` words that hold the member at ``at``, those that begin before at - left or end behind at + right, and lie in no line that is gone.
    """
    places = members.groupBy("doc").agg(F.collect_set(F.struct("at", "left", "right")).alias("places"))  # no longer than a document
    without_lines = F.lit(None).cast("array<int>")
    places = cut(places.withColumn("gone", without_lines) if gone is None else places.join(gone, "doc", "left"))
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = only(texts, places.select("doc"), "doc").join(places, "doc")
    reach = passage - WINDOW + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches, "_text"):
            data, offs = X.flat(part.column(1))
            data = X.LOWER[data]
            starts, ends, first = X.find_words(data, offs, X.NONSPACE)
            words = X.word_hashes(data, starts, ends)
            h, g = X.window_hashes(words, passage), X.window_hashes(X.mix(words ^ X._C3), passage)
            row = np.repeat(np.arange(part.num_rows), part.column(2).value_lengths().to_numpy())
            at, left, right = (c.to_numpy().astype(np.int64) for c in part.column(2).flatten().flatten())
            back = np.arange(reach)[None, :]
            every = (at + first[row])[:, None] - back
            beyond = (back > left[:, None]) | (back < passage - right[:, None])
            inside = beyond & (every >= first[row][:, None]) & (every + passage <= first[row + 1][:, None])
            if part.column(3).null_count < part.num_rows:
                inside &= _untouched(part, data, offs, starts, first, passage)[np.minimum(np.maximum(every, 0), len(starts))]
            row = np.broadcast_to(row[:, None], every.shape)
            every, keep = np.unique(every[inside], return_index=True)
            row = row[inside][keep]
            if len(row):
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array((every - first[row]).astype(np.int32)), pa.array(h[every].view(np.int64)), pa.array((X.mix(g[every]) >> np.uint64(32)).astype(np.uint32).view(np.int32))], ["doc", "start", "h", "g"])

    made = written(rows.select("doc", "_text", "places", "gone").mapInArrow(run, T.StructType([rows.schema["doc"], T.StructField("start", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("g", T.IntegerType())])), "long-windows")
    both = written(made.groupBy("h", "g").agg(F.min(F.struct("doc", "start")).alias("low"), F.max("doc").alias("high"), F.count("*").alias("n")).filter("low.doc <> high").select("h", "g", "low", "n"), "long-keys")
    return spread(made, both, ["h", "g"], "n", ["doc", "start"], most=0).select("doc", "start", "low")


def _untouched(part: pa.RecordBatch, data: np.ndarray, offs: np.ndarray, starts: np.ndarray, first: np.ndarray, passage: int) -> np.ndarray:
    """For each word (and the place behind the last one): whether none of the ``passage`` words from it on is in a line that is gone."""
    row = np.repeat(np.arange(part.num_rows), np.diff(first))
    lines = _lines_of(data, offs, starts, row).astype(np.int64)
    listed = (1 << 32) * np.repeat(np.arange(part.num_rows), part.column(3).value_lengths().fill_null(0).to_numpy()) + part.column(3).flatten().to_numpy()
    bad = np.isin((1 << 32) * row + lines, listed)
    before = np.concatenate([[0], np.cumsum(bad)])
    return before[np.minimum(np.arange(len(starts) + 1) + passage, len(starts))] == before


def _pieces(runs: list[dict]) -> list[tuple[int, int, object, bool]]:
    """(first, n, low, removed), disjoint: the runs that others lean on stay whole, and of the others the words that no run before has."""
    own = [(r["first"], r["end"]) for r in runs if r["own"]]
    out = [(a, b - a, None, False) for a, b in own]
    at, rest = 0, sorted((r["first"], -r["end"], r["low"]) for r in runs if not r["own"])
    k = 0
    while k < len(rest):
        best = None  # of the runs that go on from here, the one that reaches farthest
        while k < len(rest) and (best is None or rest[k][0] <= max(at, best[0])):
            if -rest[k][1] > at and (best is None or -rest[k][1] > best[1]):
                best = (max(rest[k][0], at), -rest[k][1], rest[k][2])
            k += 1
        if best is None:
            break
        first, at = best[0], best[1]
        for a, b in own:
            if b > first and a < at:
                if a > first:
                    out.append((first, a - first, best[2], True))
                first = b
        if first < at:
            out.append((first, at - first, best[2], True))
    return out


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = LONG, gone: DataFrame | None = None) -> DataFrame:
    """One row per run of words that another document has too: id, first_word, n_words, component_doc, removed.

    Every run of ``passage`` words or more that two documents share is covered from its first word to its last, and
    nothing else is.  A row is one stretch of the text of component_doc, the smallest id that has it; it is
    removed if that is another document, which keeps all of it: words that a later document leans on stay,
    even where a smaller id has a part of them.  Rows of a document do not overlap, so a row may be what is left of a longer run.
    Null texts and ids have none, and rows of one id are one document.  gone (doc, gone: numbers of lines; cut) has lines whose words
    count for nothing: no run holds one, and no document is said to keep a run by them.
    """
    gone = None if gone is None or gone.isEmpty() else sized(gone, weight=F.size("gone"))
    windows = chosen_windows(docs, id_col, text_col, passage - WINDOW + 1)
    often = windows.groupBy("h").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low <> high").select("h")
    if gone is not None:
        windows = chosen_windows(docs, id_col, text_col, passage - WINDOW + 1, lines=True)
    windows = looked_up(windows, cut(bit_map(often, BITS)), place(BITS, F.col("h")), "_in").filter("_in").drop("_in")
    if gone is not None:
        touched = F.coalesce(F.exists("gone", lambda x: x.between(F.col("line"), F.col("last"))), F.lit(False))
        windows = windows.join(gone, "doc", "left").filter(~touched).drop("gone", "line", "last")
    windows = written(windows, "windows")
    keys = written(windows.groupBy("h", "g").agg(F.min(F.struct("doc", "at")).alias("low"), F.max(F.struct("doc", "at")).alias("high"), F.count("*").alias("n")).filter("low.doc <> high.doc"), "keys")
    # held against the first document that has it, or, in that one itself, the last
    shared = spread(windows, keys, ["h", "g"], "n", ["doc", "at"], most=0).withColumn("other", F.when(F.col("doc") == F.col("low.doc"), F.col("high")).otherwise(F.col("low")))
    shared = shared.select("doc", "at", "h", "g", "n", F.col("other.doc").alias("other"), (F.col("at") - F.col("other.at")).alias("shift"))
    # _run: windows that follow each other in the other document too
    same = Window.partitionBy("doc", "other", "shift").orderBy("at")
    new = F.coalesce(F.col("at") > F.lag("at").over(same) + WINDOW, F.lit(True))
    runs = shared.withColumn("_new", new.cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(same.rowsBetween(Window.unboundedPreceding, 0)))
    one = Window.partitionBy("doc", "other", "shift", "_run")
    runs = written(runs.withColumn("first", F.min("at").over(one)).withColumn("end", F.max("at").over(one) + WINDOW).select("doc", "at", "h", "g", "n", F.least("doc", "other").alias("low"), F.when(F.col("other") < F.col("doc"), F.col("shift")).otherwise(F.lit(0)).alias("shift"), "first", "end"), "runs")
    # A longer window that a run does not hold is asked of the words: in all documents that have one of its chosen windows, as in
    # any of them the run may end elsewhere.
    left, right = F.col("at") - F.col("first"), F.col("end") - F.col("at")
    asked = runs.filter((left < passage - WINDOW) | (right < passage)).groupBy("h", "g").agg(F.min(left).alias("left"), F.min(right).alias("right"), F.first("n").alias("_n"))
    members = spread(runs.select("doc", "at", "h", "g"), written(asked, "asked"), ["h", "g"], "_n", ["doc", "at"], most=0)
    found = _long_windows(members.select("doc", "at", "left", "right"), docs, id_col, text_col, passage, gone)
    found = found.select("doc", F.col("low.doc").alias("low"), F.when(F.col("doc") == F.col("low.doc"), F.lit(0)).otherwise(F.col("start") - F.col("low.start")).alias("shift"), F.col("start").alias("first"), (F.col("start") + passage).alias("end"))
    spans = runs.filter(F.col("end") - F.col("first") >= passage).select("doc", "low", "shift", "first", "end").distinct().unionByName(found)
    same = Window.partitionBy("doc", "low", "shift").orderBy("first")
    new = F.coalesce(F.col("first") > F.max("end").over(same.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    joined = spans.withColumn("_new", new).withColumn("_run", F.sum("_new").over(same.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy("doc", "low", "shift", "_run").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    lists = joined.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("first", "end", "low", (F.col("doc") == F.col("low")).alias("own")))).alias("runs"))  # no longer than a document
    kind = lists.schema["doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            got = [(d, first, n, d if low is None else low, gone) for d, runs in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for first, n, low, gone in _pieces(runs)]
            if got:
                doc, first, n, low, gone = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, part.schema[0].type), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(low, part.schema[0].type), pa.array(gone)], [id_col, "first_word", "n_words", "component_doc", "removed"])

    return cut(lists.mapInArrow(run, T.StructType([T.StructField(id_col, kind.dataType), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("component_doc", kind.dataType), T.StructField("removed", T.BooleanType())])))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, passage: int = LONG) -> DataFrame:
    """Both: id, kind ("paragraph" or "passage"), first (line or word, from 0), length (lines or words), component_doc, removed.

    Lines are decided first, and passages over what stays: words of a removed line are kept for nobody, and have no passage rows.  So any run of
    ``passage`` words that stands in a line that stays, or across such lines, stands in some document afterwards.  Null texts and ids have no rows; rows of one id are
    one document (equal rows are no repeats); ties go to the smallest id, then line.
    """
    lines = written(repeated_paragraphs(docs, id_col, text_col, least), "paragraphs")
    gone = cut(lines.filter("removed").groupBy(F.col(id_col).alias("doc")).agg(F.sort_array(F.collect_set(F.col("para").cast("int"))).alias("gone")))  # no longer than a document
    words = repeated_windows(docs, id_col, text_col, passage, gone)
    one = lines.select(id_col, F.lit("paragraph").alias("kind"), F.col("para").alias("first"), F.lit(1).cast("long").alias("length"), "component_doc", "removed")
    return one.unionByName(words.select(id_col, F.lit("passage").alias("kind"), F.col("first_word").alias("first"), F.col("n_words").alias("length"), "component_doc", "removed"))


def _without_spans(text: str, lines: list[int], runs: list[tuple[int, int]]) -> str:
    """The text without some lines, and without some runs of words (first, number) and what is between their words."""
    body = text.encode()
    starts, ends, _ = X.find_words(np.frombuffer(body, np.uint8), np.array([0, len(body)]), X.NONSPACE)
    gone = np.zeros(len(body) + 1, bool)
    for first, n in runs:
        gone[starts[first] : ends[first + n - 1]] = True
    at, kept = 0, []
    for k, line in enumerate(body.split(b"\n")):
        if k not in lines:
            kept.append(np.frombuffer(line, np.uint8)[~gone[at : at + len(line)]].tobytes())
        at += len(line) + 1
    return b"\n".join(kept).decode()


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, passage: int = LONG) -> DataFrame:
    """docs without what repeated_passages() removes; other columns, and other texts, stay as they are.

    Rows go by id and text: other texts of one id are documents of their own here.  Rows with a null id stay as they are.
    """
    key, name = fresh(docs, "_id"), fresh(docs, "_gone")
    own = F.struct(F.col(id_col).alias("id"), text_key(text_col).alias("text"))
    rows = docs.filter(F.col(id_col).isNotNull()).select(own.alias("doc_id"), F.col(text_col).alias("text"))
    found = repeated_passages(rows, "doc_id", "text", least, passage).filter("removed")
    gone = cut(found.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set(F.struct("kind", "first", "length")).alias(name)))  # no longer than a document

    @F.pandas_udf("string")
    def shortened(text, spans):
        import pandas as pd

        return pd.Series([x if s is None or x is None else _without_spans(x, {y["first"] for y in s if y["kind"] == "paragraph"}, [(y["first"], y["length"]) for y in s if y["kind"] == "passage"]) for x, s in zip(text, spans, strict=True)])

    both = docs.join(sized(gone, weight=F.size(name)), own == F.col(key), "left")
    return both.withColumn(text_col, F.when(F.col(name).isNull(), F.col(text_col)).otherwise(shortened(F.col(text_col), F.col(name)))).select(docs.columns)
