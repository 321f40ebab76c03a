"""The codec across block borders: blocks are coded from what the blocks before them were decoded to.

The vertices of a face of the triangulation are a chain: each is at or behind the one before it in t, i and j alike.  So two blocks share a
face only if one is at or behind the other in all three, and blocks with the same bt + bi + bj share none.  Diagonals are coded
one after the other, all blocks of one at once.  Where a block begins, its vertices have neighbours that are decoded; where it ends, neighbours that
still are as they were.  That is what coding vertex by vertex through the whole field sees, so its codes are the same to the bit, and
no border is lossless, however many blocks there are.

A block hands its last frames, rows and columns on as rows of the table that its stage writes, one for each of the (at most seven) blocks behind
it that see them.  A stage reads the three stages before it; a lost executor costs tasks of one stage.

A long field has as many diagonals as blocks in time, one after the other.  ``segment`` cuts it into segments of so many blocks in time: the last frames of
one, as many as a predictor looks back at, are lossless, so the next one needs nothing of it that has to be waited for.  All segments go through their
diagonals at once, and the number of stages does not grow with the number of frames.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid, Scale
from . import kernels as K
from .checkpoints import scratch, written
from .codec import BATCH, _blocks, _checked, _pack, _unpack, block_of

#: Guards whose faces (or tetrahedra) are chains, and which need fixed point only.
CHAINS = ("faces", "layers", "symmetric", "tried", "typed", "tetrahedra", "tried_tetrahedra", "none")
#: Blocks in time of a segment, for fields of any length.
SEGMENT = 16
#: Frames before a vertex that predictors look at, if more than one.
FRAMES = {"mixed_order": 2, "time_linear": 2, "stride2": 2, "ar2_clamped": 2}
#: The blocks behind a block that see its end, by whether they are behind it in t, i and j.
SIDES = {4 * a + 2 * b + c: (a, b, c) for a, b, c in product((0, 1), repeat=3) if a or b or c}
STAGE = "bt int, bi int, bj int, side int, payload binary, raw_bytes long, n long, n_lossless long, max_err long, bytes long"
_NAMES = [c.split()[0] for c in STAGE.split(", ")]


class _Shape:
    """Where what lies in the array of a block: its border, the block itself, and one more vertex around both."""

    def __init__(self, grid: Grid, block: tuple[int, int, int], predictor: str, comps: int, segment: int | None = None):
        self.plan, self.block, self.comps, self.many = (grid.T, grid.H, grid.W), block, comps, _blocks(grid, block)
        self.border = (FRAMES.get(predictor, 1), 1, 1)
        if any(n > 1 and b < d for n, b, d in zip(self.many, block, self.border, strict=True)):
            raise ValueError(f"blocks of {block} are smaller than the border {self.border} that {predictor} needs")
        self.size = tuple(b + d for b, d in zip(block, self.border, strict=True))
        self.segment = min(segment or self.many[0], self.many[0])
        self.stages = self.segment + self.many[1] + self.many[2] - 2

    def diagonal(self):
        """The number of a block's stage, as a column."""
        return (F.col("bt") % self.segment + F.col("bi") + F.col("bj")).cast("int")

    def ends(self, bt):
        """Whether another segment follows a block in time (a number or a column)."""
        return (bt % self.segment == self.segment - 1) & (bt + 1 < self.many[0])

    def halo(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        around = tuple(s + 2 for s in self.size)
        return np.zeros((n, self.comps, *around), np.int64), np.zeros((n, *around), bool)

    def own(self, more: int = 0) -> tuple[slice, ...]:
        """The block within halo(), and ``more`` vertices behind it."""
        return tuple(slice(d + 1, d + 1 + b + more) for d, b in zip(self.border, self.block, strict=True))

    def live(self, place: tuple[int, int, int], more: int = 0) -> np.ndarray:
        """Which vertices of a block, and of ``more`` behind it, are in the grid."""
        ends = [np.arange(b + more) < p - k * b for k, b, p in zip(place, self.block, self.plan, strict=True)]
        return ends[0][:, None, None] & ends[1][None, :, None] & ends[2][None, None, :]

    def given(self, side: int) -> tuple[slice, ...]:
        """The part of the border, within halo(), that a block of that side sees."""
        return tuple(slice(1, d + 1) if e else slice(d + 1, d + 1 + b) for e, d, b in zip(SIDES[side], self.border, self.block, strict=True))

    def take(self, halo: np.ndarray, there: np.ndarray, place: tuple[int, int, int], side: int, payload: bytes) -> None:
        """Puts what another block has handed on into a block's border."""
        at = self.given(side)
        got = np.frombuffer(payload, "<i8").reshape(self.comps, *(s.stop - s.start for s in at))
        halo[(slice(None), *at)] = got
        there[at] = self.live(place)[tuple(slice(0, d) if e else slice(None) for e, d in zip(SIDES[side], self.border, strict=True))]

    def handed(self, done: np.ndarray, place: tuple[int, int, int], onward: bool = False) -> list[tuple]:
        """(bt, bi, bj, side, payload, ...) of a decoded array (component, border and block) for the blocks behind it in its segment (onward: in the next one)."""
        out = []
        for side, e in SIDES.items():
            to = [k + x for k, x in zip(place, e, strict=True)]
            if (bool(e[0]) and bool(self.ends(place[0]))) == onward and all(k < n for k, n in zip(to, self.many, strict=True)):
                end = tuple(slice(b, b + d) if x else slice(d, d + b) for x, d, b in zip(e, self.border, self.block, strict=True))
                out.append((*to, side, done[(slice(None), *end)].astype("<i8").tobytes(), 0, 0, 0, 0, 0))
        return out


def _group(shape: _Shape, cores: int):
    """A column: which blocks of a diagonal go through the kernel together."""
    many = shape.many
    widest = min(shape.segment * many[1], shape.segment * many[2], many[1] * many[2]) * -(-many[0] // shape.segment)
    batch = min(BATCH, max(1, -(-widest // (2 * cores))))
    return F.floor((F.floor(F.col("bt") / shape.segment) * many[1] + F.col("bi")) / batch).cast("long")


def _stages(first: DataFrame, shape: _Shape, folder: str, run, given) -> str:
    """Goes through the diagonals; ``first`` is written, with bt, bi, bj, payload and d.  Returns the folder of what ``run`` gives, stage by stage.

    given: what the last frames of a segment hand on, which their blocks know from the beginning, of batches of rows of ``first``.
    """
    spark = first.sparkSession
    group = _group(shape, spark.sparkContext.defaultParallelism)
    out = scratch(spark, folder)
    between = spark.createDataFrame([], STAGE)
    if shape.segment < shape.many[0]:
        between = written(first.filter(shape.ends(F.col("bt"))).mapInPandas(given, STAGE), folder)
    for d in range(shape.stages):
        mine = first.filter(F.col("d") == d).withColumn("_g", group)
        pieces = between.unionByName(_read(spark, out, range(max(d - 3, 0), d))) if d else between
        pieces = pieces.filter((F.col("side") > 0) & (shape.diagonal() == d)).withColumn("_g", group)
        done = mine.groupBy("_g").cogroup(pieces.groupBy("_g")).applyInPandas(run, STAGE)
        done.write.partitionBy("side").option("compression", "zstd").parquet(f"{out}/stage={d}")
    return out


def _read(spark: SparkSession, out: str, stages: range) -> DataFrame:
    made = spark.read.option("basePath", out).schema(f"{STAGE}, stage int").parquet(*(f"{out}/stage={d}" for d in stages))
    return made.select(_NAMES)


def _blocks_of(spark: SparkSession, out: str, shape: _Shape) -> DataFrame:
    """The rows of blocks, without what they hand on."""
    return _read(spark, out, range(shape.stages)).filter("side = 0").drop("side")


def _packed(field: DataFrame, shape: _Shape, cols: str, kind: str) -> DataFrame:
    """(bt, bi, bj, payload, d): the values of each block and of one more vertex behind it, written by diagonal."""
    spots = []
    for axis, (name, size) in enumerate(zip("tij", shape.block, strict=True)):
        home = F.floor(F.col(name) / size).cast("int")
        first = (F.col(name) % size == 0) & (home > 0)
        spots.append(F.when(first, F.array(home - 1, home)).otherwise(F.array(home)))
    rows = field.select("t", "i", "j", *cols)
    for name, spot in zip(("bt", "bi", "bj"), spots, strict=True):
        rows = rows.withColumn(name, F.explode(spot))
    n0, n1, n2 = shape.many
    cores = field.sparkSession.sparkContext.defaultParallelism
    batch = min(BATCH, max(1, -(-n0 * n1 * n2 // (4 * cores))))
    rows = rows.withColumn("_g", F.floor(((F.col("bt") * n1 + F.col("bi")) * n2 + F.col("bj")) / batch).cast("long"))
    wide = tuple(b + 1 for b in shape.block)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        keys = (part["bt"].to_numpy(np.int64) * n1 + part["bi"].to_numpy(np.int64)) * n2 + part["bj"].to_numpy(np.int64)
        found, which = np.unique(keys, return_inverse=True)
        place = np.stack([found // (n1 * n2), found // n2 % n1, found % n2])
        local = [part[c].to_numpy(np.int64) - (place[k] * shape.block[k])[which] for k, c in enumerate("tij")]
        values = np.zeros((len(found), shape.comps, *wide), kind)
        for k, c in enumerate(cols):
            values[which, k, *local] = part[c].to_numpy()
        return pd.DataFrame({"bt": place[0], "bi": place[1], "bj": place[2], "payload": [v.tobytes() for v in values], "d": place[0] % shape.segment + place[1] + place[2]})

    at = scratch(field.sparkSession, "wavefront-values")
    made = rows.groupBy("_g").applyInPandas(run, "bt int, bi int, bj int, payload binary, d int")
    made.write.partitionBy("d").option("compression", "zstd").parquet(at)
    return field.sparkSession.read.schema(made.schema).parquet(at)


def encode(field: DataFrame, grid: Grid, scale: Scale, eb: int, predictor: str = "lorenzo3d", block: tuple[int, int, int] | None = None, guard: str = "faces", cols: str = "uv", relax: int = 1, coding: str = "huffman", segment: int | None = None) -> DataFrame:
    """The columns of codec.encode(), with the same arguments: predictor of kernels.PREDICTORS, guard of CHAINS.  segment: blocks in time of a segment (None: all).

    With "lorenzo3d", "lorenzo2d", "mixed_order" and "dt2d", and one segment, the field decodes to what codec.encode() with one block of the whole field gives; the other
    predictors treat what is before the grid as zeros, where that one has rules of its own for the first frames.
    """
    _checked(predictor, guard, cols, coding)
    if predictor not in K.PREDICTORS or guard not in CHAINS:
        raise ValueError(f"blocks in order go with {[*K.PREDICTORS]} and {CHAINS}, not with {predictor!r} and {guard!r}")
    shape = _Shape(grid, block or block_of(grid), predictor, len(cols), segment)
    kind = "<f4" if all(dict(field.dtypes)[c] == "float" for c in cols) else "<f8"
    factor, wide = float(scale.factor), tuple(b + 1 for b in shape.block)
    inner = (..., slice(1, -1), slice(1, -1), slice(1, -1))
    coded = tuple(slice(d, None) for d in shape.border)

    def run(values: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
        n = len(values)
        places = [tuple(map(int, p)) for p in zip(values["bt"], values["bi"], values["bj"], strict=True)]
        number = {p: k for k, p in enumerate(places)}
        halo, there = shape.halo(n)
        real = np.zeros((n, shape.comps, *shape.block))
        for k, (place, payload) in enumerate(zip(places, values["payload"], strict=True)):
            x = np.frombuffer(payload, kind).reshape(shape.comps, *wide)
            halo[(k, slice(None), *shape.own(1))] = np.trunc(x.astype(np.float64) * factor).astype(np.int64)
            there[(k, *shape.own(1))] = shape.live(place, 1)
            real[k] = x[:, :-1, :-1, :-1]
        for *place, side, payload in zip(*(pieces[c] for c in ("bt", "bi", "bj", "side", "payload")), strict=True):
            k = number[tuple(map(int, place))]
            shape.take(halo[k], there[k], places[k], int(side), payload)
        x, mine = halo[inner].copy(), there[inner]
        fixed = ~mine
        for k, place in enumerate(places):
            if shape.ends(place[0]):
                fixed[k, -shape.border[0] :] = True
        ids, codes, done = K.encode(x, halo, there, fixed, eb, predictor, None, None, guard, relax=relax, border=shape.border)
        out = []
        for k, place in enumerate(places):
            live, id_ = shape.live(place), ids[k][coded]
            lossless = (id_ == 0) & live
            payload, before = _pack(id_.ravel(), codes[(k, slice(None), *coded)].reshape(shape.comps, -1), np.concatenate([real[k, c][lossless] for c in range(shape.comps)]).astype(kind), np.zeros(0), np.zeros(0, bool), coding)
            err = np.abs(done[k] - x[k])[(slice(None), *coded)][:, live]
            out.append((*place, 0, payload, before, int(live.sum()), int(lossless.sum()), int(err.max(initial=0)), len(payload)))
            out += shape.handed(done[k], place)
        return pd.DataFrame(out, columns=_NAMES)

    def given(batches):
        for part in batches:
            out = []
            for *place, payload in zip(part["bt"], part["bi"], part["bj"], part["payload"], strict=True):
                whole = np.zeros((shape.comps, *shape.size), np.int64)
                whole[(slice(None), *coded)] = np.trunc(np.frombuffer(payload, kind).reshape(shape.comps, *wide)[:, :-1, :-1, :-1].astype(np.float64) * factor)
                out += shape.handed(whole, tuple(map(int, place)), True)
            yield pd.DataFrame(out, columns=_NAMES)

    out = _stages(_packed(field, shape, cols, kind), shape, "wavefront", run, given)
    return _blocks_of(field.sparkSession, out, shape)


def decode(blocks: DataFrame, grid: Grid, scale: Scale, predictor: str = "lorenzo3d", block: tuple[int, int, int] | None = None, cols: str = "uv", kind: str = "float", coding: str = "huffman", segment: int | None = None) -> DataFrame:
    """(t, i, j, cols as doubles, <col>fp, lossless) of encode()'s blocks, as codec.decode(), with the same ``segment``; diagonals one after the other."""
    shape = _Shape(grid, block or block_of(grid), predictor, len(cols), segment)
    factor, dtype = float(scale.factor), {"float": "<f4", "double": "<f8"}[kind]
    inner = (..., slice(1, -1), slice(1, -1), slice(1, -1))
    coded = tuple(slice(d, None) for d in shape.border)

    def run(part: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
        n = len(part)
        places = [tuple(map(int, p)) for p in zip(part["bt"], part["bi"], part["bj"], strict=True)]
        number = {p: k for k, p in enumerate(places)}
        halo, there = shape.halo(n)
        ids, codes = np.zeros((n, *shape.size), np.int8), np.zeros((n, shape.comps, *shape.size), np.int32)
        real = np.zeros((n, shape.comps, *shape.block))
        for k, (place, payload, size) in enumerate(zip(places, part["payload"], part["raw_bytes"], strict=True)):
            id_, c, raw, _, _ = _unpack(payload, int(size), shape.comps, dtype, coding)
            ids[(k, *coded)], codes[(k, slice(None), *coded)] = id_.reshape(shape.block), c.reshape(shape.comps, *shape.block)
            lossless = (id_.reshape(shape.block) == 0) & shape.live(place)
            for m in range(shape.comps):
                real[k, m][lossless] = raw[m * int(lossless.sum()) : (m + 1) * int(lossless.sum())]
            halo[(k, slice(None), *shape.own())] = np.trunc(real[k] * factor).astype(np.int64)
        for *place, side, payload in zip(*(pieces[c] for c in ("bt", "bi", "bj", "side", "payload")), strict=True):
            k = number[tuple(map(int, place))]
            shape.take(halo[k], there[k], places[k], int(side), payload)
        done = K.decode(ids, codes, halo[inner], predictor, None, None, border=shape.border)
        out = []
        for k, place in enumerate(places):
            values = done[(k, slice(None), *coded)]
            lossless = ids[(k, *coded)] == 0
            body = np.concatenate([np.where(lossless, real[k], values / factor).astype("<f8").view("<i8").ravel(), values.ravel(), lossless.ravel().astype(np.int64)]).astype("<i8").tobytes()
            out.append((*place, 0, body, len(body), 0, 0, 0, 0))
            out += shape.handed(done[k], place)
        return pd.DataFrame(out, columns=_NAMES)

    spark = blocks.sparkSession
    first = blocks.withColumn("d", shape.diagonal())

    def given(batches):
        for part in batches:
            out = []
            for *place, payload, size in zip(*(part[c] for c in ("bt", "bi", "bj", "payload", "raw_bytes")), strict=True):
                place = tuple(map(int, place))
                id_, _, raw, _, _ = _unpack(payload, int(size), shape.comps, dtype, coding)
                lossless = (id_.reshape(shape.block) == 0) & shape.live(place)
                real = np.zeros((shape.comps, *shape.block))
                real[:, lossless] = raw.reshape(shape.comps, -1)
                whole = np.zeros((shape.comps, *shape.size), np.int64)
                whole[(slice(None), *coded)] = np.trunc(real * factor)
                out += shape.handed(whole, place, True)
            yield pd.DataFrame(out, columns=_NAMES)

    out = _stages(first, shape, "wavefront-decoded", run, given)

    def spread(batches):
        for part in batches:
            for bt, bi, bj, body in zip(part["bt"], part["bi"], part["bj"], part["payload"], strict=True):
                place = (int(bt), int(bi), int(bj))
                w = np.nonzero(shape.live(place))
                all_ = np.frombuffer(body, "<i8").reshape(-1, *shape.block)
                value, fixed, lossless = all_[: shape.comps].view("<f8"), all_[shape.comps : 2 * shape.comps], all_[-1] > 0
                yield pd.DataFrame({
                    **{c: (w[k] + place[k] * shape.block[k]).astype(np.int32) for k, c in enumerate("tij")},
                    **{c: value[k][w] for k, c in enumerate(cols)},
                    **{f"{c}fp": fixed[k][w] for k, c in enumerate(cols)},
                    "lossless": lossless[w],
                })

    return _blocks_of(spark, out, shape).select("bt", "bi", "bj", "payload").mapInPandas(spread, "t int, i int, j int, " + ", ".join([f"{c} double" for c in cols] + [f"{c}fp long" for c in cols]) + ", lossless boolean")
