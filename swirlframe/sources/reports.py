"""Text and CSV reports and records, written and read by Spark."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import union_all
from ..plans.checkpoints import written
from .parts import BYTES, Text, find_in, parts_of, read_text, write_pieces

CONFUSION = "region string, index int, tp long, tn long, fp long, fn long"
#: Frames whose points are a file.
FRAMES = 64
#: Lines of text that are a piece of a file.
LINES = 1000


def write_counts(counts: DataFrame, path: str) -> None:
    """(t, n) as text in order of t, a number a line; frames without a count get 0."""
    last = counts.agg(F.max("t")).first()[0]
    frames = counts.sparkSession.range(0 if last is None else last + 1).select(F.col("id").cast("int").alias("t"))
    frames.join(counts, "t", "left").orderBy("t").coalesce(1).select(F.coalesce("n", F.lit(0)).cast("string").alias("value")).write.mode("overwrite").text(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(n) of the lines that are whole numbers; others are skipped."""
    line = F.trim("value")
    return spark.read.text(path).select(F.when(line.rlike("^[+-]?[0-9]+$"), line.try_cast("long")).alias("n")).filter("n is not null")


def write_confusion(confusion: DataFrame, path: str) -> None:
    rows = confusion.filter("idx is not null").select("region", F.col("idx").alias("index"), "tp", "tn", "fp", "fn")
    rows.coalesce(1).sortWithinPartitions("region", "index").write.mode("overwrite").option("header", True).csv(path)


def read_confusion(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(CONFUSION).csv(path)


def confusion_sums(confusion: DataFrame) -> DataFrame:
    return confusion.groupBy("region").agg(*(F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")))


def write_points(points: DataFrame, path: str) -> None:
    """Critical points as Parquet, a file for each FRAMES frames and in their order, so that few files are made and a frame is read alone."""
    rows = points.withColumn("frames", F.floor(F.col("t") / FRAMES).cast("int"))
    rows.repartition("frames").sortWithinPartitions("frames", "t").write.mode("overwrite").partitionBy("frames").parquet(path)


def read_points(spark: SparkSession, path: str, frame: int | None = None) -> DataFrame:
    """The points of write_points(), of all frames or of one."""
    rows = spark.read.parquet(path)
    return (rows if frame is None else rows.filter((F.col("frames") == frame // FRAMES) & (F.col("t") == frame))).drop("frames")


def _numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """(rows with at, n): places in an order, from 0: those within a sorted partition, behind the rows of the partitions before."""
    marked = written(rows.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_row", 33)
    begins, n = [], 0
    for r in marked.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each partition
        begins.append((r.part, n))
        n += r.n
    begins = rows.sparkSession.createDataFrame(begins, "part long, begin long")
    joined = marked.withColumn("part", part).join(F.broadcast(begins), "part")
    return joined.withColumn("at", F.col("begin") + F.col("_row").bitwiseAND((1 << 33) - 1)).drop("part", "begin", "_row"), n


def _pieces(lines: DataFrame, first: int) -> DataFrame:
    """(at, body): lines (at, value), LINES of them a piece, of which the first one is ``first``."""
    joined = lines.groupBy(F.floor(F.col("at") / LINES).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("r"))
    return joined.select((F.col("piece") + first).alias("at"), F.encode(F.concat(F.concat_ws("\n", "r.value"), F.lit("\n")), "UTF-8").alias("body"))


def write_polydata(samples: DataFrame, path: str, parts: bool = False, most: int = BYTES) -> None:
    """VTK PolyData XML of ordered trajectories (component, place, x, y, t): points and lines; one file, whose pieces go through the driver, or in parts (see parts.py) that tasks write."""
    from .raw import output

    spark = samples.sparkSession
    points, n_points = _numbered(written(samples.select("component", "place", *(F.col(c).cast("double").alias(c) for c in "xyt")), "samples"), "component", "place")
    ends, n_lines = _numbered(points.groupBy("component").agg((F.max("at") + 1).alias("end")), "end")
    tag = lambda at, *lines: spark.createDataFrame([(at, ("\n".join(lines) + "\n").encode())], "at long, body binary")
    count = lambda n: -(-n // LINES)
    head = ('<?xml version="1.0"?>', '<VTKFile type="PolyData" version="0.1" byte_order="LittleEndian">', "<PolyData>", f'<Piece NumberOfPoints="{n_points}" NumberOfLines="{n_lines}">', '<Points><DataArray type="Float64" NumberOfComponents="3" format="ascii">')
    own = count(n_points)  # pieces of points, and of connectivity
    from_, to = F.col("id") * LINES, F.least((F.col("id") + 1) * LINES, F.lit(n_points)) - 1
    made = union_all([
        tag(0, *head),
        _pieces(points.select("at", F.format_string("%.9g %.9g %.9g", "x", "y", "t").alias("value")), 1),
        tag(1 + own, "</DataArray></Points>", '<Lines><DataArray type="Int64" Name="connectivity" format="ascii">'),
        spark.range(own).select((F.col("id") + 2 + own).alias("at"), F.encode(F.concat(F.concat_ws(" ", F.sequence(from_, to).cast("array<string>")), F.lit("\n")), "UTF-8").alias("body")),
        tag(2 + 2 * own, "</DataArray>", '<DataArray type="Int64" Name="offsets" format="ascii">'),
        _pieces(ends.select("at", F.col("end").cast("string").alias("value")), 3 + 2 * own),
        tag(3 + 2 * own + count(n_lines), "</DataArray></Lines>", "</Piece>", "</PolyData>", "</VTKFile>"),
    ])
    if parts:
        return write_pieces(made, 4 + 2 * own + count(n_lines), path, 36 * LINES, most=most)
    with output(spark, path) as write:
        for r in made.orderBy("at").toLocalIterator():
            write(r.body)


def read_polydata(spark: SparkSession, path: str, most: int = BYTES) -> DataFrame:
    """(line, place, x, y, t) of a file of write_polydata(), one or in parts, read by ranges of ``most`` bytes; in order of line and place (which Spark leaves out where sums follow)."""
    parts = parts_of(spark, path)
    tags = find_in(spark, parts, rb"</?DataArray[^>]*>", most=most)
    spans = {}
    for (at, opened), (end, _) in zip(tags[::2], tags[1::2], strict=True):
        name = re.search(rb'Name="([^"]*)"', opened)
        spans[name and name.group(1).decode()] = at + len(opened), end
    rows = lambda name, width: read_text(spark, [Text(path, parts, *spans[name], width)], most)
    value = F.col("values")[0].cast("long")
    points = rows(None, 3).select(F.col("at").alias("point"), *(F.col("values")[k].alias(c) for k, c in enumerate("xyt")))
    ends = rows("offsets", 1).select(F.col("at").alias("line"), value.alias("end"))
    begins = ends.select((F.col("line") + 1).alias("line"), F.col("end").alias("begin"))
    lines = ends.join(begins, "line", "left").withColumn("begin", F.coalesce("begin", F.lit(0).cast("long"))).filter("begin < end")
    some = lines.select("line", "begin", "end", F.explode(F.sequence("begin", F.col("end") - 1, F.lit(LINES))).alias("low"))  # a long line is many rows
    places = some.select("line", "begin", F.explode(F.sequence("low", F.least(F.col("low") + LINES, F.col("end")) - 1)).alias("at"))
    found = places.join(rows("connectivity", 1).select("at", value.alias("point")), "at").join(points, "point")
    return found.select(F.col("line").cast("int").alias("line"), (F.col("at") - F.col("begin")).cast("int").alias("place"), "x", "y", "t").orderBy("line", "place")
