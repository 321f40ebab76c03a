"""Repeated passages of three lines (DataFrame operations only).

Lines are hashed, every window of WINDOW consecutive lines gets a hash, and windows that
occur again, anywhere later in the corpus, are removed: the lines that they cover, merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, fresh, sized, spread

WINDOW = 3


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """(id, at, h1, h2) of rows (id, text): the 128-bit hash of every window of lines, and its place from 0."""
    hashed = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("p"), F.xxhash64(F.lit(1), x, F.lit(2)).alias("q")))
    lines = rows.select("id", hashed.alias("lines")).filter(F.size("lines") >= window)
    many = F.size("lines") - (window - 1)
    shifted = [F.slice("lines", k + 1, many).alias(f"l{k}") for k in range(window)]
    names = [f"l{k}" for k in range(window)]
    each = lines.select("id", *shifted).select("id", F.posexplode(F.arrays_zip(*names)).alias("at", "w"))
    return each.select("id", "at", *(F.xxhash64(*(F.col(f"w.{n}.{x}") for n in names)).alias(h) for h, x in (("h1", "p"), ("h2", "q"))))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, first, last): merged runs of lines (from 0) of a document that repeated windows cover; rows only for what is to go.

    Lines are what stands between line feeds, compared as they are.  The first occurrence of a
    window stays: the one with the smallest id, then the smallest line.  Documents of fewer than
    ``window`` lines and null texts or ids have no windows and are left alone.  Rows of one id and
    equal windows at the same place are one occurrence.  Extra columns are not read.
    """
    found = _windows(docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), window)
    seen = cut(found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("id", "at")).alias("keep")).filter("n > 1"))
    later = spread(found, seen, ["h1", "h2"], "n", ["id", "at"]).filter(F.struct("id", "at") > F.col("keep")).select("id", "at").distinct()
    before = Window.partitionBy("id").orderBy("at")
    # a run ends where the next covered window starts beyond the lines covered so far
    marked = later.withColumn("new", F.coalesce(F.col("at") > F.lag("at").over(before) + window, F.lit(True)).cast("int"))
    runs = marked.withColumn("run", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("id", "run").agg(F.min("at").alias("first"), (F.max("at") + window - 1).alias("last"))
    return merged.select(F.col("id").alias(id_col), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without the lines of repeated_lines(); other columns, and texts without such lines, stay as they are."""
    key, name = fresh(docs, "_id"), fresh(docs, "_runs")
    runs = repeated_lines(docs, id_col, text_col, window).groupBy(F.col(id_col).alias(key)).agg(F.collect_list(F.struct("first", "last")).alias(name))
    runs = cut(runs)  # a document has fewer runs than lines
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.exists(name, lambda r: i.between(r["first"], r["last"])))
    text = F.when(F.col(name).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return docs.join(sized(runs, weight=F.size(name)), F.col(id_col) == F.col(key), "left").withColumn(text_col, text).select(docs.columns)
