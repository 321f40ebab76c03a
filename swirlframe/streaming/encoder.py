"""The codec on a stream of frames: blocks come out as soon as their frames are there.

A frame is cut into the tiles of the block grid, each with the row and column before it; a tile's state, in each segment of frames, is
the frames of the block that is due, and the last one of the block before.  As a block's last frame, row and column are lossless
where another block follows, a block needs no frame behind it, and its rows are those of plans.codec.encode().
The scale is given beforehand, as a stream's largest value is not known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..grid import Grid, Scale
from ..plans.codec import _NAMES, CODED, _checked, _Coder
from .frames import SEGMENT, by_segment

SCHEMA = "field string, t int, u array<float>, v array<float>"
_TILE = "field string, bi int, bj int, t int, u binary, v binary"


def real_frames(field: DataFrame, name: str = "field") -> DataFrame:
    """(field, t, u, v) of a field (t, i, j, u, v) of real values: a frame is as large as the grid's plane."""
    rows = field.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("i", "j", "u", "v"))).alias("r"))
    return rows.select(F.lit(name).alias("field"), "t", F.col("r.u").cast("array<float>").alias("u"), F.col("r.v").cast("array<float>").alias("v"))


def read_real_frames(spark: SparkSession, path: str, per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(path)


def tiles(frames: DataFrame, plane: tuple[int, int], block: tuple[int, int]) -> DataFrame:
    """(field, bi, bj, t, u, v): each tile of each frame as little-endian floats, with a row and a column before it where there are any."""
    h, w = plane

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, t, *both in zip(b["field"], b["t"], b["u"], b["v"], strict=True):
                u, v = (np.asarray(x, "<f4").reshape(h, w) for x in both)
                for i in range(0, h, block[0]):
                    for j in range(0, w, block[1]):
                        cut = np.s_[max(i - 1, 0) : i + block[0], max(j - 1, 0) : j + block[1]]
                        out.append((name, i // block[0], j // block[1], t, u[cut].tobytes(), v[cut].tobytes()))
            yield pd.DataFrame(out, columns=["field", "bi", "bj", "t", "u", "v"])

    return frames.mapInPandas(run, _TILE)


def encode_stream(frames: DataFrame, plane: tuple[int, int], scale: Scale, eb: int, block: tuple[int, int, int], total: int | None = None, predictor: str = "lorenzo3d", guard: str = "faces", ahead: int = 256, coding: str = "huffman") -> DataFrame:
    """(field, and the columns of codec.encode()) of a stream or table of frames (field, t, u, v), t from 0, in any order.

    plane: rows and columns of a frame; total: the number of frames, if it is known: then the last block may be shorter, else only whole blocks
    come out.  A frame that comes again is ignored.  A frame may come up to ``ahead`` frames before its block is due in its segment (whole blocks
    of about SEGMENT frames); the query fails beyond that, as state must not grow without bound and no frame may be lost.  Segments wait for none but
    their own frames and the one before, so files may come in any order.
    """
    _checked(predictor, guard, "uv", coding)
    (h, w), (b0, b1, b2) = plane, block
    per = max(1, SEGMENT // b0)
    coder = _Coder((total, h, w), block, scale.factor, eb, predictor, 1 / scale.factor, 0.003, guard, "uv", "<f4", False, 1, coding)

    def block_row(bt: int, bi: int, bj: int, have: dict[int, tuple[bytes, bytes]]) -> tuple:
        i0, j0 = int(bi > 0), int(bj > 0)
        shape = (min(b1, h - bi * b1) + i0, min(b2, w - bj * b2) + j0)
        real, there = np.zeros((1, 2, b0 + 2, b1 + 2, b2 + 2)), np.zeros((1, b0 + 2, b1 + 2, b2 + 2), bool)
        place = np.s_[1 - i0 : 1 - i0 + shape[0], 1 - j0 : 1 - j0 + shape[1]]
        for t, both in have.items():
            k = t - bt * b0 + 1
            if 0 <= k <= b0:
                there[(0, k, *place)] = True
                for c in (0, 1):
                    real[(0, c, k, *place)] = np.frombuffer(both[c], "<f4").reshape(shape)
        return coder(np.array([[bt * b0], [bi * b1], [bj * b2]]), real, there)[0]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, bi, bj, seg = key
        due, ts, us, vs = state.get if state.exists else (seg * per, [], [], [])
        end = (seg + 1) * per
        have = {t: (bytes(u), bytes(v)) for t, u, v in zip(ts, us, vs, strict=True)}
        for p in parts:
            for t, u, v in zip(p["t"], p["u"], p["v"], strict=True):
                if t >= due * b0 - 1:
                    have.setdefault(int(t), (bytes(u), bytes(v)))
        out = []
        while due < end and (total is None or due * b0 < total) and all(t in have for t in range(max(due * b0 - 1, 0), (due + 1) * b0 if total is None else min((due + 1) * b0, total))):
            out.append((name, *block_row(due, int(bi), int(bj), have)))
            due += 1
            have = {t: x for t, x in have.items() if t >= due * b0 - 1}
        if due == end:
            have = {}
        if have and max(have) >= (due + 1) * b0 + ahead:
            raise ValueError(f"frame {max(have)} of {name} came more than {ahead} frames before its turn")
        kept = sorted(have)
        state.update((due, kept, [have[t][0] for t in kept], [have[t][1] for t in kept]))
        yield pd.DataFrame(out, columns=["field", *_NAMES])

    kept = "due int, t array<int>, u array<binary>, v array<binary>"
    grouped = by_segment(tiles(frames, plane, (b1, b2)), per * b0).groupBy("field", "bi", "bj", "seg")
    if frames.isStreaming:
        return grouped.applyInPandasWithState(run, f"field string, {CODED}", kept, "append", GroupStateTimeout.NoTimeout)

    def whole(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        class Once:
            exists = False

            def update(self, _):
                pass

        return next(iter(run(key, iter([part]), Once())))

    return grouped.applyInPandas(whole, f"field string, {CODED}")


def plan(grid: Grid) -> dict:
    """What encode_stream() needs to know of a grid."""
    return {"plane": (grid.H, grid.W), "total": grid.T}
