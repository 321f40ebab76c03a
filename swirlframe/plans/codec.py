"""The critical-point-preserving codec: blocks of a field, each coded on its own.

Vertices on a block's far border are lossless where another block follows and the guard sees it, so what a block sees of
its neighbours never changes, and blocks may be coded, and decoded, in any order and place.  A guard of faces within frames sees no block
that follows in time, so blocks of one frame are coded as others are.
Some neighbouring blocks make a group, which bounds what one task holds.

A block's payload has the ids of its bounds, the codes of its coded vertices, and the original values of the others in the input's
type: symbols in Huffman codes (or as differences in zigzag order), and everything through ZSTD.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import Grid, Scale, bits_above
from . import kernels as K
from .streams import CODINGS, Shared, Table, joined, split

#: Most blocks of a group.
BATCH = 128
#: Vertices along t, i and j that a block has about; block_of() fits it to the grid.
BLOCK = (8, 12, 12)
#: Logarithms of doubles are below 2**11; thirty bits in all.
LOG_SCALE = Scale(2048.0, 19)
_COUNTS = "n long, n_lossless long, max_err long, bytes long"


def block_of(grid: Grid, about: tuple[int, int, int] = BLOCK) -> tuple[int, int, int]:
    """The block size of about ``about`` vertices that divides the grid most evenly."""
    return tuple(-(-n // max(1, round(n / b))) for n, b in zip((grid.T, grid.H, grid.W), about, strict=True))


def _blocks(grid: Grid, block: tuple[int, int, int]) -> tuple[int, int, int]:
    return tuple(-(-n // b) for n, b in zip((grid.T, grid.H, grid.W), block, strict=True))


def _pack(ids: np.ndarray, codes: np.ndarray, raw: np.ndarray, fit: np.ndarray, signs: np.ndarray, coding: str) -> tuple[bytes, int]:
    """(payload, its size before ZSTD) of a block; codes (component, vertex) of all vertices."""
    write = CODINGS[coding][0]
    body = joined(write(ids), write(codes[:, ids > 0].ravel()), raw.tobytes(), fit.astype("<f8").tobytes(), np.packbits(signs.ravel()).tobytes())
    return pa.Codec("zstd", compression_level=3).compress(body, asbytes=True), len(body)


def _unpack(payload: bytes, size: int, many: int, kind: str, coding: str | Shared) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    read_ids, read_codes = (coding.ids.read, coding.codes.read) if isinstance(coding, Shared) else (CODINGS[coding][1],) * 2
    ids, coded, raw, fit, signs = split(pa.Codec("zstd").decompress(payload, size, asbytes=True))
    ids = read_ids(ids)
    codes = np.zeros((many, len(ids)), np.int64)
    codes[:, ids > 0] = read_codes(coded).reshape(many, -1)
    return ids, codes, np.frombuffer(raw, kind), np.frombuffer(fit, "<f8"), np.unpackbits(np.frombuffer(signs, np.uint8))


class _Coder:
    """Codes some blocks of a grid (whose last frame may not be known: then T is None)."""

    def __init__(self, shape: tuple[int | None, int, int], block, factor, eb, predictor, cell, gain, guard, cols, kind, log, relax, coding):
        self.shape, self.block, self.factor, self.eb, self.predictor, self.cell, self.gain = shape, block, float(factor), eb, predictor, cell, gain
        self.guard, self.cols, self.kind, self.log, self.relax, self.coding = guard, cols, kind, log, relax, coding

    def __call__(self, corner: np.ndarray, real: np.ndarray, there: np.ndarray, limits: np.ndarray | None = None) -> list[tuple]:
        """Rows (bt, bi, bj, mode, payload, raw_bytes, n, n_lossless, max_err, bytes).

        corner: (3, block); real: (block, component, t, i, j) with one more vertex around; there: those that exist; limits: a bound for each vertex.
        """
        n, many = real.shape[:2]
        inner = (..., slice(1, -1), slice(1, -1), slice(1, -1))
        if self.log:
            code = np.where(real == 0, -100.0, np.log2(np.abs(np.where(real == 0, 1.0, real))))
        else:
            code = real
        halo = np.trunc(code * self.factor).astype(np.int64)
        values, mine = halo[inner].copy(), there[inner]
        fixed = np.zeros_like(mine)
        for k in K.SEEN.get(self.guard, (0, 1, 2)):
            p = self.shape[k]
            more = np.ones(n, bool) if p is None else corner[k] + self.block[k] < p
            edge: list = [slice(None)] * 3
            edge[k] = self.block[k] - 1
            fixed[(more, *edge)] = True
        size = [np.full(n, b) if p is None else np.minimum(b, p - c) for b, p, c in zip(self.block, self.shape, corner, strict=True)]
        motion, modes, fit = K.Motion(self.cell, size[1], size[2]), None, None
        if self.predictor == "modes":
            modes = K.choose_modes(values, mine, motion, self.gain)
        if self.predictor == "modes_entropy":
            modes = K.choose_by_entropy(values, mine, fixed | ~mine, self.eb, motion, self.gain)
        if self.predictor == "lorenzo_ar2":
            fit = K.fit_ar2(values, mine)
        if self.predictor == "plane":
            fit = K.fit_plane(values, mine, self.eb)
        reals = K.Reals(real, self.factor, self.log) if self.guard in K.RELATIVE else None
        ids, codes, done = K.encode(values, halo, there, fixed | ~mine, self.eb, self.predictor, motion, modes, self.guard, fit, limits, self.relax, reals)
        out = []
        for b in range(n):
            live, raw = mine[b], real[inner][b]
            lossless = (ids[b] == 0) & live
            signs = np.stack([raw > 0, raw == 0]) if self.log else np.zeros(0, bool)
            payload, before = _pack(ids[b].ravel(), codes[b].reshape(many, -1), np.concatenate([raw[k][lossless] for k in range(many)]).astype(self.kind), fit[b] if fit is not None else np.zeros(0), signs, self.coding)
            err = np.abs(done[b] - values[b])[:, live]
            mode = int(modes[b]) if modes is not None else int(self.predictor in K.MOVING)
            out.append((*(int(c[b]) // s for c, s in zip(corner, self.block, strict=True)), mode, payload, before, int(live.sum()), int(lossless.sum()), int(err.max(initial=0)), len(payload)))
        return out


_NAMES = ["bt", "bi", "bj", "mode", "payload", "raw_bytes", "n", "n_lossless", "max_err", "bytes"]
CODED = f"bt int, bi int, bj int, mode int, payload binary, raw_bytes long, {_COUNTS}"


def _checked(predictor: str, guard: str, cols: str, coding: str) -> None:
    known = [*K.PREDICTORS, *K.MOVING, *K.FITTED]
    if predictor not in known:
        raise ValueError(f"no predictor {predictor!r}; there are {known}")
    if guard not in K.GUARDS or (guard in K.SPATIAL) != (len(cols) == 3) and guard != "none":
        raise ValueError(f"guard {guard!r} does not go with components {cols!r}")
    if coding not in CODINGS:
        raise ValueError(f"no coding {coding!r}; there are {[*CODINGS]}")


def encode(field: DataFrame, grid: Grid, scale: Scale, eb: int, predictor: str = "lorenzo3d", block: tuple[int, int, int] | None = None, cell: float | None = None, gain: float = 0.003, guard: str = "faces", cols: str = "uv", log: bool = False, limit: str | None = None, relax: int = 1, coding: str = "huffman") -> DataFrame:
    """(bt, bi, bj, mode, payload, raw_bytes, n, n_lossless, max_err, bytes): a row for each block of a field (t, i, j, and cols).

    eb: the largest error, in units of fixed point.  predictor: one of kernels.PREDICTORS; "advect", "warped", "modes" or "modes_entropy"
    (the better of Lorenzo and advection for each block, by the sum of residuals or by the bits that coding takes); "lorenzo_ar2" (with an AR(2)
    of each block), or "plane" (a hyperplane or Lorenzo for each block).  block: by default block_of() the grid.  cell: displacement in cells
    of a fixed-point unit (by default a velocity of 1 moves one cell a frame).  guard: what may not change, of kernels.GUARDS: "faces" of space-time, "layers"
    (faces of single frames only), "legacy" (faces of the other triangulation), "symmetric" (faces, with the least bound of their vertices), "tried" (faces, by trial), "typed"
    (faces of frames and the types of their zeros, by trial), "relative" and "bilinear" (triangles or cells of frames, of real values),
    "tetrahedra", "tried_tetrahedra" and "relative_tetrahedra" (of three components), or "none".  log: codes base-2 logarithms (scale: LOG_SCALE) and
    signs; errors are then relative.  limit: a column with a bound of each vertex, in units of fixed point.  relax: steps may be so many times
    their bound where the result holds it.  coding: of streams.CODINGS.
    """
    _checked(predictor, guard, cols, coding)
    block = block or block_of(grid)
    cell = 1 / scale.factor if cell is None else cell
    many, (b0, b1, b2) = _blocks(grid, block), block
    kind = "<f4" if all(dict(field.dtypes)[c] == "float" for c in cols) else "<f8"
    coder = _Coder((grid.T, grid.H, grid.W), block, scale.factor, eb, predictor, cell, gain, guard, cols, kind, log, relax, coding)
    spots = []
    for axis, (name, size) in enumerate(zip("tij", block, strict=True)):
        home = F.floor(F.col(name) / size).cast("int")
        # the last vertex of a block is halo of the next one
        last = (F.col(name) % size == size - 1) & (home + 1 < many[axis])
        spots.append(F.when(last, F.array(home, home + 1)).otherwise(F.array(home)))
    rows = field.select("t", "i", "j", *cols, *([F.col(limit).alias("_limit")] if limit else []))
    rows = rows.withColumn("_bt", F.explode(spots[0])).withColumn("_bi", F.explode(spots[1])).withColumn("_bj", F.explode(spots[2]))
    cores = field.sparkSession.sparkContext.defaultParallelism
    batch = min(BATCH, max(4, -(-int(np.prod(many)) // (2 * cores))))
    group = F.floor(((F.col("_bt") * many[1] + F.col("_bi")) * many[2] + F.col("_bj")) / batch).cast("long")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        keys = (part["_bt"].to_numpy(np.int64) * many[1] + part["_bi"].to_numpy(np.int64)) * many[2] + part["_bj"].to_numpy(np.int64)
        found, which = np.unique(keys, return_inverse=True)
        n = len(found)
        corner = np.stack([found // (many[1] * many[2]) * b0, found // many[2] % many[1] * b1, found % many[2] * b2])
        local = [part[c].to_numpy(np.int64) - corner[k][which] + 1 for k, c in enumerate("tij")]
        real = np.zeros((n, len(cols), b0 + 2, b1 + 2, b2 + 2))
        there = np.zeros((n, b0 + 2, b1 + 2, b2 + 2), bool)
        for k, c in enumerate(cols):
            real[which, k, *local] = part[c].to_numpy(np.float64)
        there[which, *local] = True
        limits = None
        if limit:
            limits = np.zeros(there.shape, np.int64)
            limits[which, *local] = part["_limit"].to_numpy(np.int64)
            limits = limits[:, 1:-1, 1:-1, 1:-1]
        return pd.DataFrame(coder(corner, real, there, limits), columns=_NAMES)

    # as many tasks as groups: they take long, though their rows are few bytes
    groups = int(min(-(-int(np.prod(many)) // batch), 10_000))
    return rows.withColumn("_g", group).repartition(groups, "_g").groupBy("_g").applyInPandas(run, CODED)


def decode(blocks: DataFrame, grid: Grid, scale: Scale, predictor: str = "lorenzo3d", block: tuple[int, int, int] | None = None, cell: float | None = None, cols: str = "uv", log: bool = False, kind: str = "float", coding: str | Shared = "huffman") -> DataFrame:
    """(t, i, j, cols as doubles, <col>fp, lossless): the field of encode()'s blocks; lossless vertices have their original values.

    kind: the type of the field that was coded, float or double; the other arguments as for encode().
    """
    block = block or block_of(grid)
    cell, factor = 1 / scale.factor if cell is None else cell, float(scale.factor)
    plan, many, comps = (grid.T, grid.H, grid.W), _blocks(grid, block), len(cols)
    dtype = {"float": "<f4", "double": "<f8"}[kind]

    def run(batches):
        for part in batches:
            n = len(part)
            if not n:
                continue
            corner = np.stack([part[c].to_numpy(np.int64) * s for c, s in zip(("bt", "bi", "bj"), block, strict=True)])
            size = [np.minimum(b, p - c) for b, p, c in zip(block, plan, corner, strict=True)]
            ids, codes = np.zeros((n, *block), np.int8), np.zeros((n, comps, *block), np.int32)
            real, sign = np.zeros((n, comps, *block)), np.zeros((n, comps, *block))
            axes = [np.arange(b) for b in block]
            live = np.ones((n, *block), bool)
            for k in range(3):
                live &= (axes[k][None, :] < size[k][:, None]).reshape([n, *(block[k] if m == k else 1 for m in range(3))])
            fits = []
            for b in range(n):
                x, c, raw, fit, signs = _unpack(part["payload"].iloc[b], int(part["raw_bytes"].iloc[b]), comps, dtype, coding)
                ids[b], codes[b] = x.reshape(block), c.reshape(comps, *block)
                lossless = (ids[b] == 0) & live[b]
                for k in range(comps):
                    real[b, k][lossless] = raw[k * int(lossless.sum()) : (k + 1) * int(lossless.sum())]
                fits.append(fit.reshape(comps, -1))
                if log:
                    up, zero = signs[: 2 * real[b].size].reshape(2, *real[b].shape)
                    sign[b] = np.where(zero > 0, 0.0, np.where(up > 0, 1.0, -1.0))
            modes = part["mode"].to_numpy() > 0 if predictor.startswith("modes") else None
            inside = np.where(real == 0, -100.0, np.log2(np.abs(np.where(real == 0, 1.0, real)))) if log else real
            raw = np.trunc(inside * factor).astype(np.int64)
            done = K.decode(ids, codes, raw, predictor, K.Motion(cell, size[1], size[2]), modes, np.stack(fits))
            w = np.nonzero(live)
            lossless = ids[w] == 0
            value = lambda k: sign[:, k][w] * np.exp2(done[:, k][w] / factor) if log else done[:, k][w] / factor  # noqa: B023, E731
            yield pd.DataFrame({
                **{c: (corner[k][w[0]] + w[k + 1]).astype(np.int32) for k, c in enumerate("tij")},
                **{c: np.where(lossless, real[:, k][w], value(k)) for k, c in enumerate(cols)},
                **{f"{c}fp": done[:, k][w] for k, c in enumerate(cols)},
                "lossless": lossless,
            })

    # by vertices: blocks of one frame are many, and small
    width = max(1, min(int(np.prod(many)), grid.size // (4 * int(np.prod(BLOCK)))))
    return blocks.repartition(min(width, 10_000), "bt", "bi", "bj").mapInPandas(run, "t int, i int, j int, " + ", ".join([f"{c} double" for c in cols] + [f"{c}fp long" for c in cols]) + ", lossless boolean")


def with_shared_tables(blocks: DataFrame, coding: str = "huffman", most: int = 16) -> tuple[DataFrame, Shared]:
    """(blocks, tables): blocks of encode() with their streams in codes of one table for all ids and one for all codes, of at most ``most`` bits; decode(..., coding=tables).

    Symbols are counted where the blocks are; of the counts, which are as many as quantisation has symbols (2**17 at most), the driver makes the tables.  blocks is
    read twice, so it should be a table.
    """
    read = CODINGS[coding][1]

    def streams(payload: bytes, size: int) -> list[bytes]:
        return split(pa.Codec("zstd").decompress(payload, size, asbytes=True))

    def count(batches):
        for part in batches:
            for k in (0, 1):
                found = [read(streams(p, int(n))[k]) for p, n in zip(part["payload"], part["raw_bytes"], strict=True)]
                sym, n = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
                yield pd.DataFrame({"stream": k, "sym": sym, "n": n})

    counted = blocks.select("payload", "raw_bytes").mapInPandas(count, "stream int, sym long, n long").groupBy("stream", "sym").agg(F.sum("n").alias("n")).limit((1 << 18) + 1).collect()
    if len(counted) > 1 << 18:
        raise ValueError("more symbols than quantisation can give")
    tables = Shared(*(Table.of({r.sym: r.n for r in counted if r.stream == k}, most) for k in (0, 1)))

    def run(batches):
        for part in batches:
            out = part.copy()
            for at, (payload, n) in enumerate(zip(part["payload"], part["raw_bytes"], strict=True)):
                ids, codes, *rest = streams(payload, int(n))
                body = joined(tables.ids.write(read(ids)), tables.codes.write(read(codes)), *rest)
                packed = pa.Codec("zstd", compression_level=3).compress(body, asbytes=True)
                for c, x in (("payload", packed), ("raw_bytes", len(body)), ("bytes", len(packed))):
                    out.iat[at, out.columns.get_loc(c)] = x
            yield out

    return blocks.mapInPandas(run, blocks.schema), tables


def statistics(blocks: DataFrame, bytes_per_value: int = 4, components: int = 2) -> DataFrame:
    """(n, n_lossless, lossless_share, max_err, bytes, ratio) of all blocks."""
    s = blocks.agg(*(F.sum(c).alias(c) for c in ("n", "n_lossless", "bytes")), F.max("max_err").alias("max_err"))
    return s.select("n", "n_lossless", (F.col("n_lossless") / F.col("n")).alias("lossless_share"), "max_err", "bytes", (float(components) * bytes_per_value * F.col("n") / F.col("bytes")).alias("ratio"))


def bound_for(field_scale: Scale, eb: float, mode: str = "abs", fixed_range: int | None = None) -> int:
    """A bound in units of fixed point: of an absolute error, or of one relative to the range of values."""
    if mode not in ("abs", "rel"):
        raise ValueError("mode is abs or rel")
    if mode == "rel" and fixed_range is None:
        raise ValueError("a relative bound needs the range of values")
    return int(eb * field_scale.factor) if mode == "abs" else int(eb * fixed_range)


def write_blocks(blocks: DataFrame, path: str, grid: Grid, scale: Scale, **how) -> None:
    """Blocks as Parquet, and beside them a header: what decode() needs to know (predictor, block, cell, cols, log, kind, coding)."""
    blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    head = {"H": grid.H, "W": grid.W, "T": grid.T, "max_abs": scale.max_abs, "shift": scale.shift, "bits": bits_above(scale.max_abs), **how}
    spark = blocks.sparkSession
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def read_blocks(spark, path: str) -> DataFrame:
    """decode() of what write_blocks() wrote."""
    head = json.loads(spark.read.text(f"{path}/header").first()[0])
    grid, scale = Grid(head.pop("H"), head.pop("W"), head.pop("T")), Scale(head.pop("max_abs"), head.pop("shift"))
    head.pop("bits")
    block = head.pop("block", None)
    return decode(spark.read.parquet(f"{path}/blocks"), grid, scale, block=tuple(block) if block else None, **head)


def relative_limit(share, scale: Scale = LOG_SCALE):
    """A column of relative bounds as one of bounds of logarithms, in units of fixed point (one less for what is truncated)."""
    return F.greatest(F.floor(F.log2(1 + F.least(share, F.lit(1.0)) * (1 - 1e-9)) * float(scale.factor)).cast("long") - 1, F.lit(0).cast("long"))


def encode_relative(field: DataFrame, grid: Grid, share: float, predictor: str = "lorenzo3d", block: tuple[int, int, int] | None = None, guard: str = "none", cols: str = "uv", limit: str | None = None) -> tuple[DataFrame, Scale]:
    """(blocks, scale): errors of at most ``share`` of each value, by base-2 logarithms; decode(..., log=True) undoes it.

    limit: a column with a bound (relative_limit()) of each vertex beside that.
    """
    eb = int(np.log2(1 + share) * LOG_SCALE.factor) - 1
    return encode(field, grid, LOG_SCALE, eb, predictor, block, guard=guard, cols=cols, log=True, limit=limit), LOG_SCALE


def encode_rotated(field: DataFrame, grid: Grid, eb: float, predictor: str = "lorenzo3d", block: tuple[int, int, int] | None = None) -> tuple[DataFrame, Scale, tuple[float, float]]:
    """(blocks, scale, (c, s)): the field in the axes in which its components are not correlated; critical points of the rotated field are kept.

    Those of the field itself are to be verified after decode_rotated(); kept_after_rotation() says how many are.
    """
    from ..functions.scalars import rotate
    from ..grid import fixed_scale
    from ..operators.verify import channel_rotation

    c, s = channel_rotation(field, grid).first()
    a, b = rotate(F.col("u"), F.col("v"), c, s)
    turned = field.select("t", "i", "j", a.alias("u"), b.alias("v"))
    scale = fixed_scale(turned)
    return encode(turned, grid, scale, int(eb * scale.factor), predictor, block), scale, (c, s)


def decode_rotated(blocks: DataFrame, grid: Grid, scale: Scale, angle: tuple[float, float], predictor: str = "lorenzo3d", block: tuple[int, int, int] | None = None) -> DataFrame:
    from ..functions.scalars import rotate_back

    u, v = rotate_back(F.col("u"), F.col("v"), F.lit(angle[0]), F.lit(angle[1]))
    return decode(blocks, grid, scale, predictor, block, kind="double").select("t", "i", "j", u.alias("u"), v.alias("v"))


def kept_after_rotation(field: DataFrame, decoded: DataFrame, grid: Grid, scale: Scale) -> DataFrame:
    """(n, lost, new): faces of the unrotated field whose verdict changed on the way through the rotated one, by rounding."""
    from ..grid import to_fixed
    from ..operators.verify import marked_faces

    both = to_fixed(field, scale).join(to_fixed(decoded, scale).select("t", "i", "j", F.col("u").alias("du"), F.col("v").alias("dv")), ["t", "i", "j"])
    count = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0)).cast("long")
    return marked_faces(both, grid).agg(F.count("*").alias("n"), count(F.col("ori") & ~F.col("dec")).alias("lost"), count(~F.col("ori") & F.col("dec")).alias("new"))
