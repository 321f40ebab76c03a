"""Frame streams: a row is a whole frame, (t, u array, v array) of fixed-point values in order of (i, j).

What needs one frame only is stateless.  What needs the frame before keeps it as state, per field
and segment of frames, and holds frames that come early until the ones before them are there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..grid import Grid
from ..plans.kernels import has_zero

SCHEMA = "field string, t int, u array<long>, v array<long>"
#: Frames that share a state: those of one segment wait for each other, whatever has come of the others.
SEGMENT = 256


def frames(fixed: DataFrame, name: str = "field") -> DataFrame:
    """(field, t, u, v) of a fixed-point field (t, i, j, u, v): a frame is as large as the grid's plane."""
    rows = fixed.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("i", "j", "u", "v"))).alias("r"))
    return rows.select(F.lit(name).alias("field"), "t", F.col("r.u").alias("u"), F.col("r.v").alias("v"))


def read_frames(spark: SparkSession, path: str, per_trigger: int = 16) -> DataFrame:
    """A stream of frames from Parquet files that appear at path."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(path)


def layer_counts(stream: DataFrame, grid: Grid) -> DataFrame:
    """(field, t, n): zero faces of each frame; for streams and tables alike, without state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = []
            for u, v in zip(b["u"], b["v"], strict=True):
                x, y = (np.asarray(c, np.int64).reshape(grid.H, grid.W) for c in (u, v))
                c = [(p[:-1, :-1], p[:-1, 1:], p[1:, :-1], p[1:, 1:]) for p in (x, y)]
                total = 0
                for k in (2, 1):  # the cell's triangles {0, below, across} and {0, right, across}
                    total += int(has_zero(c[0][0], c[1][0], c[0][k], c[1][k], c[0][3], c[1][3]).sum())
                n.append(total)
            yield pd.DataFrame({"field": b["field"], "t": b["t"], "n": n})

    return stream.mapInPandas(run, "field string, t int, n long")


def by_segment(rows: DataFrame, length: int) -> DataFrame:
    """rows with seg, t div ``length``; the last frame of a segment is there for the next one too, which begins by looking back at it."""
    home = F.floor(F.col("t") / length).cast("int")
    return rows.withColumn("seg", F.explode(F.when((F.col("t") + 1) % length == 0, F.array(home, home + 1)).otherwise(F.array(home))))


def frame_changes(stream: DataFrame, first: int = 0, ahead: int = 1024) -> DataFrame:
    """(field, t, sum_abs, max_abs) of the change from frame t - 1 to t, in order of t within a segment whatever the order of arrival.

    Frame ``first`` is compared with zeros.  A frame that was handled already is ignored.  State, of each segment of SEGMENT frames:
    the last frame, and those that came before their turn, by at most ``ahead`` frames: beyond that the query fails, as no frame may be
    lost.  A segment waits for none but its own frames and the one before, so files may come in any order.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begin = key[1] * SEGMENT
        due, last, early = state.get if state.exists else (max(first, begin - 1), b"", [])
        waiting = dict(early)
        for p in parts:
            for t, u, v in zip(p["t"], p["u"], p["v"], strict=True):
                if t >= due:
                    waiting[int(t)] = np.concatenate([np.asarray(u, "<i8"), np.asarray(v, "<i8")]).tobytes()
        out = []
        while due in waiting:
            now = waiting.pop(due)
            if due >= begin:
                x, y = (np.frombuffer(b, "<i8") for b in (now, last or bytes(len(now))))
                d = np.abs(x - y)
                out.append((key[0], due, int(d.sum()), int(d.max(initial=0))))
            last, due = now, due + 1
        if due == begin + SEGMENT:
            last = b""
        if waiting and max(waiting) > due + ahead:
            raise ValueError(f"frame {max(waiting)} of {key[0]} came more than {ahead} frames before its turn")
        state.update((due, last, sorted(waiting.items())))
        yield pd.DataFrame(out, columns=["field", "t", "sum_abs", "max_abs"])

    kept = "due int, last binary, early array<struct<t:int,both:binary>>"
    return by_segment(stream, SEGMENT).groupBy("field", "seg").applyInPandasWithState(run, "field string, t int, sum_abs long, max_abs long", kept, "append", GroupStateTimeout.NoTimeout)


def run_to_end(out: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that is there now goes through the stream ``out`` to Parquet at path; the result is read back."""
    q = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return out.sparkSession.read.parquet(path)


def windowed_events(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(day, n, total) of a stream or table of events (ts, value): tumbling windows of event time; rows later than ``late`` are dropped by the watermark of a stream."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", size).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "n", "total")
