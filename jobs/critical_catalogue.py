"""A catalogue of the critical points of a field whose frames keep coming.

Input: a Parquet table of grid rows; row number id has the (u, v) pairs of row id mod ``rows`` of frame id div ``rows``.  Output,
partitioned by chunks of frames: every face of the space-time triangulation that holds a zero, where it is crossed, and its
type if it lies in a frame.  Trajectories (operators.critical) and reports by layer and slab start from these rows.

A high-water mark, ``out``/marks, has the number of frames that are in the output.  A run reads the frames behind it, and those of
the chunk that is still open: the faces between the last frame and the next one could not be made before.  Chunks are replaced whole and the mark
is written after them, so a run that was stopped is done again by the next one, and a run with nothing new writes nothing.

Values are compared in fixed point.  Its scale, 2**shift, is a setting, as the largest value of later frames is not known; a value too
large for it, a missing value or a missing row stops the run before anything is written.
"""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import main, settings, there
from swirlframe.functions.triangles import zero_type
from swirlframe.grid import Grid, Scale, to_fixed, vector_field
from swirlframe.operators import critical, mesh

NAME = "critical_catalogue"
log = logging.getLogger(NAME)

MARKS = "frames long, first_frame long, n_points long, settings string"
POINTS = "face long, t int, i int, j int, tmpl int, cls string, type int, x double, y double, time double, chunk long"
#: Fixed point has so many bits; products of two values then fit into 64.
BITS = 30


def crossings(fixed: DataFrame, grid: Grid) -> DataFrame:
    """(face, t, i, j, tmpl, cls, type, x, y, time): zeros on faces; t, i, j are those of the face's cube, type is null between frames."""
    zero = mesh.zero_faces(fixed, grid)
    kind = F.when(F.col("tmpl") <= 2, zero_type(*(F.col(c) for c in critical.SIX), F.col("tmpl") == 1)).cast("int")
    rows = zero.select("t", "i", "j", "tmpl", "cls", "a", "b", "c", *critical.SIX, kind.alias("type"))
    return critical.located(rows, grid).select("face", "t", "i", "j", "tmpl", "cls", "type", "x", "y", F.col("at").alias("time"))


def checked(field: DataFrame, rows: DataFrame, first: int, frames: int, cfg: dict) -> None:
    """Raises unless the grid rows ``first`` to ``frames`` * rows are all there, once each, with values that fixed point can hold."""
    begin, end = first * cfg["rows"], frames * cfg["rows"]
    got = rows.agg(F.count("*"), F.min(cfg["id"]), F.max(cfg["id"]), F.sum(cfg["id"]), F.count(F.when(F.size(cfg["values"]) == 2 * cfg["columns"], 1))).first()
    n = end - begin
    if tuple(got) != (n, begin, end - 1, (begin + end - 1) * n // 2, n):
        raise ValueError(f"rows {begin} to {end - 1} have to be there once each, with {2 * cfg['columns']} values; found {got[0]} from {got[1]} to {got[2]}, {got[4]} of that size")
    bad = (F.col("u").isNull() | F.col("v").isNull() | F.isnan("u") | F.isnan("v"))
    missing, top = field.agg(F.count(F.when(bad, 1)), F.max(F.greatest(F.abs("u"), F.abs("v")).cast("double"))).first()
    if missing:
        raise ValueError(f"{missing} vertices of frames {first} to {frames - 1} have no value")
    if top * 2.0 ** cfg["shift"] >= 2.0**BITS:
        raise ValueError(f"the largest value, {top}, does not fit into {BITS} bits with shift {cfg['shift']}")


def run(spark: SparkSession, vectors: str, out: str, given: dict | None = None) -> dict:
    """Takes the new frames of ``vectors`` into the catalogue at ``out``; returns what it did: frames, first_frame, n_points (0 and no first_frame if nothing was new)."""
    cfg = settings(NAME, given)
    stated = json.dumps(cfg, sort_keys=True)
    marks = there(spark, f"{out}/marks", MARKS)
    last = None if marks is None else marks.orderBy(F.desc("frames")).first()
    done = last.frames if last else 0
    if last and last.settings != stated:
        raise ValueError(f"{out} was made with the settings {last.settings}")
    rows = spark.read.parquet(vectors).select(cfg["id"], cfg["values"])
    frames = rows.count() // cfg["rows"]  # from the files' metadata; frames that are not whole wait
    log.info("%s has %d whole frames, %d are done", vectors, frames, done)
    if frames < done:
        raise ValueError(f"{vectors} has {frames} frames, fewer than the {done} that are in {out}")
    if frames == done:
        log.info("nothing new")
        return {"frames": done, "first_frame": None, "n_points": 0}
    # the last frame that is done lacks the faces behind it; its chunk is made again
    first = max(done - 1, 0) // cfg["frames_per_chunk"] * cfg["frames_per_chunk"]
    new = rows.filter((F.col(cfg["id"]) >= first * cfg["rows"]) & (F.col(cfg["id"]) < frames * cfg["rows"]))
    field = vector_field(new, cfg["rows"], cfg["columns"], cfg["id"], cfg["values"])
    checked(field, new, first, frames, cfg)
    log.info("read frames %d to %d", first, frames - 1)
    grid = Grid(cfg["rows"], cfg["columns"], frames)
    found = crossings(to_fixed(field, Scale(0.0, cfg["shift"])), grid)
    chunk = F.floor(F.col("t") / cfg["frames_per_chunk"]).alias("chunk")
    # files by chunk; a chunk with more than fits a file is split by the rebalance
    found.select("*", chunk).hint("rebalance", "chunk").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(f"{out}/points")
    n = catalogue(spark, out).filter(F.col("chunk") >= first // cfg["frames_per_chunk"]).count()
    spark.createDataFrame([(frames, first, n, stated)], MARKS).coalesce(1).write.mode("append").parquet(f"{out}/marks")
    log.info("wrote %d points of frames %d to %d to %s/points", n, first, frames - 1, out)
    return {"frames": frames, "first_frame": first, "n_points": n}


def catalogue(spark: SparkSession, out: str) -> DataFrame:
    """The output of all runs."""
    made = there(spark, f"{out}/points", POINTS)
    return spark.createDataFrame([], POINTS) if made is None else made


if __name__ == "__main__":
    main(NAME, __doc__, {"vectors": "Parquet table of grid rows", "out": "folder of the catalogue and its marks"}, run)
