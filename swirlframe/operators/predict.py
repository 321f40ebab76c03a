"""Predictors of fixed-point values from neighbours before them, on the values themselves.

Outside the grid neighbours count as 0.  Each predictor is an expression over the columns that
stencil() gives: <col>_p<dt><di><dj> is the value dt frames, di rows and dj columns before.
"""

from __future__ import annotations

from collections.abc import Callable
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import Grid, neighbours

Back = Callable[[int, int, int], Column]


def stencil(field: DataFrame, cols: tuple[str, ...], back: list[tuple[int, int, int]]) -> DataFrame:
    """field with <col>_p<dt><di><dj> for each (dt, di, dj) in ``back``."""
    found = neighbours(field, list(cols), [(-a, -b, -c) for a, b, c in back])
    renamed = [F.coalesce(F.col(f"{x}_{k}"), F.lit(0)).cast("long").alias(f"{x}_p{a}{b}{c}") for x in cols for k, (a, b, c) in enumerate(back)]
    return found.select("t", "i", "j", *cols, *renamed)


def back(col: str) -> Back:
    return lambda a, b, c: F.col(f"{col}_p{a}{b}{c}")


def lorenzo2d(p: Back) -> Column:
    return p(0, 1, 0) + p(0, 0, 1) - p(0, 1, 1)


def lorenzo3d(p: Back) -> Column:
    return mixed_order(p, 1, 1, 1)


def mixed_order(p: Back, kt: int, ki: int, kj: int) -> Column:
    """Lorenzo of the given order in each direction: signed binomials of all earlier neighbours."""
    total = F.lit(0).cast("long")
    for a in range(kt + 1):
        for b in range(ki + 1):
            for c in range(kj + 1):
                if a or b or c:
                    total = total + (-1) ** (a + b + c + 1) * comb(kt, a) * comb(ki, b) * comb(kj, c) * p(a, b, c)
    return total


def time_linear(p: Back) -> Column:
    """Linear extrapolation in time, corrected by 2D Lorenzo of its own residuals; Lorenzo 3D in the first two frames."""

    def residual(b: int, c: int) -> Column:
        inside = (F.col("i") >= b) & (F.col("j") >= c)
        return F.when(inside, p(0, b, c) - 2 * p(1, b, c) + p(2, b, c)).otherwise(0)

    ahead = 2 * p(1, 0, 0) - p(2, 0, 0) + residual(1, 0) + residual(0, 1) - residual(1, 1)
    return F.when(F.col("t") < 2, lorenzo3d(p)).otherwise(ahead)


def stride2(p: Back) -> Column:
    """Lorenzo 3D whose earlier frame is the one before the last."""
    return F.when(F.col("t") < 2, lorenzo3d(p)).otherwise(p(2, 1, 1) + p(2, 0, 0) + p(0, 1, 0) + p(0, 0, 1) - p(2, 1, 0) - p(2, 0, 1) - p(0, 1, 1))


def dt2d(p: Back) -> Column:
    """The last frame's value plus 2D Lorenzo of the changes since."""
    change = lambda b, c: p(0, b, c) - p(1, b, c)
    return F.when(F.col("t") < 1, lorenzo3d(p)).otherwise(p(1, 0, 0) + change(1, 0) + change(0, 1) - change(1, 1))


def ar2_clamped(p: Back) -> Column:
    """Linear extrapolation in time, kept within the smallest and largest of its neighbours in the two frames before."""
    base = 2 * p(1, 0, 0) - p(2, 0, 0)
    around = [F.when((F.col("i") >= b) & (F.col("j") >= c), p(a, b, c)).otherwise(p(1, 0, 0)) for b, c in ((0, 0), (1, 0), (0, 1), (1, 1)) for a in (1, 2)]
    return F.when(F.col("t") < 2, lorenzo3d(p)).otherwise(F.greatest(F.least(*around), F.least(F.greatest(*around), base)))


_CUBE = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1) if a + b + c]
_DEEP = _CUBE + [(2, b, c) for b in (0, 1) for c in (0, 1)]

#: Name: (expression, neighbours that it needs).
PREDICTORS: dict[str, tuple[Callable[[Back], Column], list[tuple[int, int, int]]]] = {
    "lorenzo2d": (lorenzo2d, [(0, 1, 0), (0, 0, 1), (0, 1, 1)]),
    "lorenzo3d": (lorenzo3d, _CUBE),
    "mixed_order": (lambda p: mixed_order(p, 2, 1, 1), _DEEP),
    "time_linear": (time_linear, _DEEP),
    "stride2": (stride2, _DEEP),
    "dt2d": (dt2d, _CUBE),
    "ar2_clamped": (ar2_clamped, _DEEP),
}


def register_predictor(name: str, expression: Callable[[Back], Column], back_: list[tuple[int, int, int]]) -> None:
    """Adds a predictor of one's own: an expression over p(dt, di, dj), and the neighbours that it names."""
    PREDICTORS[name] = (expression, back_)


def predicted(field: DataFrame, predictor: str, cols: tuple[str, ...] = ("u", "v")) -> DataFrame:
    """(t, i, j, cols, <col>_pred)."""
    expression, needs = PREDICTORS[predictor]
    rows = stencil(field, cols, needs)
    return rows.select("t", "i", "j", *cols, *(expression(back(c)).alias(f"{c}_pred") for c in cols))


def residual_summary(field: DataFrame, predictor: str) -> DataFrame:
    """(sum_abs, max_abs, n) of the residuals of both components."""
    p = predicted(field, predictor)
    both = p.select(F.explode(F.array(F.abs(F.col("u") - F.col("u_pred")), F.abs(F.col("v") - F.col("v_pred")))).alias("r"))
    return both.agg(F.sum("r").alias("sum_abs"), F.max("r").alias("max_abs"), F.count("*").alias("n"))


def _clamped(x: Column, most: int) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(float(most)), x))


def sampled(points: DataFrame, frames: DataFrame, grid: Grid, cols: tuple[str, ...] = ("u", "v")) -> DataFrame:
    """points (t, y, x, and others) with <col>_at: bilinear samples of frames (t, i, j, cols) of the same t at row y and column x, clamped to the grid.

    Each point is joined with its four vertices through one equi-join on (t, i, j) of exploded corners, and summed up again.
    """
    y, x = _clamped(F.col("y"), grid.H - 1), _clamped(F.col("x"), grid.W - 1)
    p = points.withColumn("_y", y).withColumn("_x", x).withColumn("_i", F.floor("_y").cast("int")).withColumn("_j", F.floor("_x").cast("int"))
    p = p.withColumn("_fy", F.col("_y") - F.col("_i")).withColumn("_fx", F.col("_x") - F.col("_j"))

    def corner(k: int) -> Column:
        di, dj = k >> 1, k & 1
        w = (F.col("_fx") if dj else 1.0 - F.col("_fx")) * (F.col("_fy") if di else 1.0 - F.col("_fy"))
        return F.struct(F.lit(k).alias("k"), F.least(F.col("_i") + di, F.lit(grid.H - 1)).alias("i"), F.least(F.col("_j") + dj, F.lit(grid.W - 1)).alias("j"), w.alias("w"))

    names = points.columns
    wide = p.select(F.struct(*names).alias("p"), F.col("t").alias("_t"), F.explode(F.array(*map(corner, range(4)))).alias("c")).select("p", "_t", F.col("c.i").alias("_i"), F.col("c.j").alias("_j"), "c.k", "c.w")
    f = frames.select(F.col("t").alias("_t"), F.col("i").alias("_i"), F.col("j").alias("_j"), *(F.col(c).cast("double").alias(c) for c in cols))
    hit = wide.join(f, ["_t", "_i", "_j"])
    # a fixed order of additions, so that results do not depend on how rows are dealt
    parts = [F.max(F.when(F.col("k") == k, F.col("w") * F.col(c))).alias(f"{c}{k}") for c in cols for k in range(4)]
    summed = hit.groupBy("p").agg(*parts)
    return summed.select("p.*", *((F.col(f"{c}0") + F.col(f"{c}1") + F.col(f"{c}2") + F.col(f"{c}3")).alias(f"{c}_at") for c in cols))


def _tile_halos(field: DataFrame, tile: int, cy: float, cx: float) -> DataFrame:
    """(t, ti, tj, hy, hx): how many rows and columns around a tile its traces may need, at most a tile's: the largest move in it and the eight around it."""
    keys = ("t", F.floor(F.col("i") / tile).cast("int").alias("ti"), F.floor(F.col("j") / tile).cast("int").alias("tj"))
    moves = field.groupBy(*keys).agg(F.max(F.abs("v") * F.lit(cy)).alias("dy"), F.max(F.abs("u") * F.lit(cx)).alias("dx"))
    most = _around(moves).groupBy("t", "ti", "tj").agg(F.max("dy").alias("dy"), F.max("dx").alias("dx"))
    whole = moves.select("t", "ti", "tj").join(most, ["t", "ti", "tj"])
    return whole.select("t", "ti", "tj", *(F.least(F.ceil(d) + 2, F.lit(tile)).cast("int").alias(h) for d, h in (("dy", "hy"), ("dx", "hx"))))


def _around(tiles: DataFrame) -> DataFrame:
    """Each tile nine times: for itself and for each place around it; (oi, oj) is the tile it is."""
    near = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    rest = [c for c in tiles.columns if c not in ("t", "ti", "tj")]
    return tiles.withColumn("_n", near).select("t", (F.col("ti") + F.col("_n.a")).alias("ti"), (F.col("tj") + F.col("_n.b")).alias("tj"), F.col("ti").alias("oi"), F.col("tj").alias("oj"), *rest)


def _tile_rows(field: DataFrame, halos: DataFrame, tile: int) -> DataFrame:
    """(t, ti, tj, i, j, u, v): the rows of each tile and its halo, in pieces: arrays of u and v from column j on; t is the frame after."""
    cut_at = F.floor(F.col("j") / tile).cast("int")
    pieces = field.groupBy("t", "i", cut_at.alias("oj")).agg(F.array_sort(F.collect_list(F.struct("j", "u", "v"))).alias("r"))
    pieces = pieces.withColumn("oi", F.floor(F.col("i") / tile).cast("int"))
    wants = _around(halos)  # a tile with its halo, once for each tile that it may read
    wants = wants.select("t", F.col("ti").alias("oi"), F.col("tj").alias("oj"), F.col("oi").alias("ti"), F.col("oj").alias("tj"), "hy", "hx")
    both = pieces.join(wants, ["t", "oi", "oj"]).filter((F.col("i") >= F.col("ti") * tile - F.col("hy")) & (F.col("i") < (F.col("ti") + 1) * tile + F.col("hy")))
    first = F.col("oj") * tile
    low = F.greatest(first, F.col("tj") * tile - F.col("hx"))
    high = F.least(first + F.size("r"), (F.col("tj") + 1) * tile + F.col("hx"))
    part = F.slice("r", low - first + 1, high - low)
    some = both.filter(high > low).select((F.col("t") + 1).alias("t"), "ti", "tj", "i", low.alias("j"), part.alias("r"))
    return some.select("t", "ti", "tj", "i", "j", F.col("r.u").alias("u"), F.col("r.v").alias("v"))


def advected(field: DataFrame, grid: Grid, factor: int, dt_dx: float = 1.0, dt_dy: float = 1.0, cells: float | None = None, tile: int = 128) -> DataFrame:
    """(t, i, j, u, v, u_pred, v_pred) for t >= 1: each vertex traced back along the last frame's velocity by the midpoint rule and sampled there.

    field is fixed point; a velocity of factor moves dt_dx columns and dt_dy rows a frame.  With ``cells``, vertices whose own move is longer
    take Euler steps of at most so many cells instead, at most 32 steps.  Ends and steps stay within the grid.

    Vertices are traced in tiles, with as much of the last frame around them as the moves there ask for, at most a tile on each side.  A trace that
    leaves it is handed to the tile where it is, in rounds, and goes on there, so that no group has more than nine tiles, however far traces lead; a
    group takes the traces of one tile of origin only, so many traces into one tile are several groups.
    """
    import numpy as np
    import pyarrow as pa

    from ..plans.checkpoints import cut

    h, w, cx, cy = grid.H, grid.W, dt_dx / factor, dt_dy / factor
    keys = ["t", "ti", "tj", "oi", "oj"]
    names = ["t", "i", "j", "u", "v", "y", "x", "n", "s", "u_pred", "v_pred"]

    def run(points: pa.Table, rows: pa.Table) -> pa.Table:
        if not points.num_rows or not rows.num_rows:  # no frame before
            return pa.table({c: pa.array([], kinds[c]) for c in names})
        size = np.diff(rows.column("u").combine_chunks().offsets.to_numpy())
        i0, j0 = (rows.column(c).to_numpy().astype(np.int64) for c in "ij")
        top, left = i0.min(), j0.min()
        bottom, right = i0.max(), (j0 + size).max() - 1
        at = np.repeat(i0 - top, size), np.repeat(j0 - left - np.cumsum(size) + size, size) + np.arange(size.sum())
        planes = []
        for c in "uv":
            p = np.zeros((bottom - top + 1, right - left + 1))
            p[at] = rows.column(c).combine_chunks().flatten().to_numpy()
            planes.append(p)
        i, j = (points.column(c).to_numpy().astype(np.float64) for c in "ij")
        y, x = (points.column(c).to_numpy().copy() for c in "yx")
        n, s = (points.column(c).to_numpy().copy() for c in "ns")

        def seen(y, x):
            return (np.floor(y) >= top) & (np.floor(x) >= left) & (np.minimum(np.floor(y) + 1, h - 1) <= bottom) & (np.minimum(np.floor(x) + 1, w - 1) <= right)

        def sampled_at(y, x):
            a, b = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
            fy, fx = y - a, x - b
            k, m, a, b = np.minimum(a + 1, h - 1) - top, np.minimum(b + 1, w - 1) - left, a - top, b - left
            # weights and additions in the order of sampled()
            return [(1.0 - fx) * (1.0 - fy) * p[a, b] + fx * (1.0 - fy) * p[a, m] + (1.0 - fx) * fy * p[k, b] + fx * fy * p[k, m] for p in planes]

        fresh = np.flatnonzero(n == 0)
        if len(fresh):
            here = sampled_at(y[fresh], x[fresh])
            far = np.maximum(np.abs(here[0]) * cx, np.abs(here[1]) * cy)
            n[fresh] = 1 if cells is None else np.clip(np.ceil(far / cells), 1, 32)
        steps = np.where(n == 1, 2, n)
        while True:
            go = np.flatnonzero((s < steps) & seen(y, x))
            if not len(go):
                break
            u, v = sampled_at(y[go], x[go])
            one = n[go] == 1
            part = np.where(one, np.where(s[go] == 0, 0.5, 1.0), 1.0)
            by, bx = (np.where(one, part * c, c / n[go]) for c in (cy, cx))
            y[go] = np.clip(np.where(one, i[go], y[go]) - v * by, 0.0, h - 1.0)
            x[go] = np.clip(np.where(one, j[go], x[go]) - u * bx, 0.0, w - 1.0)
            s[go] += 1
        end = (s == steps) & seen(y, x)
        found = [np.zeros(len(n), np.int64) for _ in planes]
        for p, value in zip(found, sampled_at(y[end], x[end]), strict=True):
            p[end] = (np.sign(value) * np.floor(np.abs(value) + 0.5)).astype(np.int64)
        out = dict(zip(names, [*(points.column(c) for c in names[:5]), pa.array(y), pa.array(x), pa.array(n), pa.array(s), *(pa.array(p, mask=~end) for p in found)], strict=True))
        return pa.table({c: out[c].cast(kinds[c]) for c in names})

    kinds = {c: pa.int32() if c in ("t", "i", "j", "n", "s") else pa.float64() if c in "yx" else pa.int64() for c in names}
    schema = ", ".join(f"{c} {'int' if c in ('t', 'i', 'j', 'n', 's') else 'double' if c in 'yx' else 'long'}" for c in names)
    of = lambda c: F.floor(F.col(c) / tile).cast("int")
    wide = [F.col(c).cast("long").alias(c) for c in "uv"]
    field = field.select("t", "i", "j", *wide)

    single = h <= tile and w <= tile
    if single:  # a frame is a tile, without a halo
        whole = field.groupBy("t", "i").agg(F.array_sort(F.collect_list(F.struct("j", "u", "v"))).alias("r"))
        rows = whole.select(F.col("t") + 1, F.lit(0), F.lit(0), "i", F.col("r.j")[0], "r.u", "r.v")
    else:
        rows = _tile_rows(field, _tile_halos(field, tile, cy, cx), tile)
    rows = rows.toDF("t", "ti", "tj", "i", "j", "u", "v")

    def in_tiles(points: DataFrame) -> DataFrame:
        return points.toDF(*points.columns).select("*", of("y").alias("ti"), of("x").alias("tj"), of("i").alias("oi"), of("j").alias("oj"))

    zero = F.lit(0).cast("int")
    start = field.filter("t > 0").select("t", "i", "j", "u", "v", F.col("i").cast("double").alias("y"), F.col("j").cast("double").alias("x"), zero.alias("n"), zero.alias("s"))
    own = rows.select("*", F.col("ti").alias("oi"), F.col("tj").alias("oj"))
    out = in_tiles(start).groupBy(*keys).cogroup(own.groupBy(*keys)).applyInArrow(run, schema)
    result = ["t", "i", "j", "u", "v", "u_pred", "v_pred"]
    # the sum of a trace's moves is at most the largest move of its frame, so within a tile's width none leaves its halo
    far = 0.0 if single else field.agg(F.max(F.greatest(F.abs("v") * F.lit(cy), F.abs("u") * F.lit(cx)))).first()[0] or 0.0
    if single or far + 2 <= tile:
        return out.select(*result)
    parts = []
    while True:
        out = cut(out)
        parts.append(out.filter("u_pred is not null").select(*result))
        away = out.filter("u_pred is null").drop("u_pred", "v_pred")
        if away.isEmpty():
            break
        keyed = in_tiles(away)
        asked = keyed.select(*keys).distinct().toDF(*keys)
        out = keyed.groupBy(*keys).cogroup(rows.join(asked, ["t", "ti", "tj"]).groupBy(*keys)).applyInArrow(run, schema)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def plane_regression(field: DataFrame, col: str, block: int) -> DataFrame:
    """(t, bi, bj, b0, b1, b2): the least-squares plane b0 * row + b1 * column + b2 of each square block (rows and columns from its corner).

    Closed form from sums, for the block's own shape; a slope is 0 where the block is one row or column wide.
    """
    di, dj, x = (F.col("i") % block).cast("double"), (F.col("j") % block).cast("double"), F.col(col).cast("double")
    sums = field.groupBy("t", F.floor(F.col("i") / block).cast("int").alias("bi"), F.floor(F.col("j") / block).cast("int").alias("bj")).agg(
        F.sum(x).alias("s"), F.sum(x * di).alias("sy"), F.sum(x * dj).alias("sx"), (F.max(di) + 1).alias("h"), (F.max(dj) + 1).alias("w"))
    n = F.col("h") * F.col("w")

    def slope(moment: str, size: str) -> Column:
        m, s = F.col(moment), F.col(size)
        spread = n * (s * s - 1.0) / 12.0
        return F.when(s > 1, (m - F.col("s") * (s - 1.0) / 2.0) / F.when(s > 1, spread).otherwise(1.0)).otherwise(0.0)

    b0, b1 = slope("sy", "h"), slope("sx", "w")
    b2 = F.col("s") / n - b0 * (F.col("h") - 1.0) / 2.0 - b1 * (F.col("w") - 1.0) / 2.0
    return sums.select("t", "bi", "bj", b0.alias("b0"), b1.alias("b1"), b2.alias("b2"))


def block_modes(lorenzo: DataFrame, advect: DataFrame, block: int = 32, gain: float = 0.003) -> DataFrame:
    """(t, bi, bj, mode): 1 (advection) for blocks where it cuts the sum of magnitudes of residuals by at least ``gain``, else 0.

    lorenzo and advect are predicted() and advected() rows; frames without advection have mode 0.
    """
    cost = lambda name: (F.abs(F.col("u") - F.col("u_pred")) + F.abs(F.col("v") - F.col("v_pred"))).alias(name)
    both = lorenzo.select("t", "i", "j", cost("a")).join(advect.select("t", "i", "j", cost("b")), ["t", "i", "j"], "left")
    per = both.groupBy("t", F.floor(F.col("i") / block).cast("int").alias("bi"), F.floor(F.col("j") / block).cast("int").alias("bj")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    better = (F.col("a") - F.col("b")).cast("double") / (F.col("a").cast("double") + 1e-12) >= gain
    return per.select("t", "bi", "bj", F.when(F.col("b").isNotNull() & (F.col("b") < F.col("a")) & better, 1).otherwise(0).alias("mode"))


def mode_counts(modes: DataFrame) -> DataFrame:
    return modes.groupBy("mode").agg(F.count("*").alias("n"))


def plane_predicted(field: DataFrame, col: str, block: int) -> DataFrame:
    """(t, i, j, col, <col>_pred): each value and that of its block's least-squares plane, rounded."""
    plane = plane_regression(field, col, block)
    keyed = field.select("t", "i", "j", col, F.floor(F.col("i") / block).cast("int").alias("bi"), F.floor(F.col("j") / block).cast("int").alias("bj"))
    value = F.col("b0") * (F.col("i") % block) + F.col("b1") * (F.col("j") % block) + F.col("b2")
    return keyed.join(plane, ["t", "bi", "bj"]).select("t", "i", "j", col, F.round(value).cast("long").alias(f"{col}_pred"))


def volume_regression(field: DataFrame, col: str, block: int) -> DataFrame:
    """(bt, bi, bj, b0, b1, b2, b3): the least-squares hyperplane of each cube of vertices, by frame, row, column and a constant."""
    local = {a: (F.col(a) % block).cast("double") for a in "tij"}
    x = F.col(col).cast("double")
    keys = [F.floor(F.col(a) / block).cast("int").alias(f"b{a}") for a in "tij"]
    sums = field.groupBy(*keys).agg(F.sum(x).alias("s"), *(F.sum(x * local[a]).alias(f"s{a}") for a in "tij"), *((F.max(local[a]) + 1).alias(f"n{a}") for a in "tij"))
    n = F.col("nt") * F.col("ni") * F.col("nj")

    def slope(a: str) -> Column:
        k = F.col(f"n{a}")
        spread = n * (k * k - 1.0) / 12.0
        return F.when(k > 1, (F.col(f"s{a}") - F.col("s") * (k - 1.0) / 2.0) / F.when(k > 1, spread).otherwise(1.0)).otherwise(0.0)

    b = {a: slope(a) for a in "tij"}
    constant = F.col("s") / n
    for a in "tij":
        constant = constant - b[a] * (F.col(f"n{a}") - 1.0) / 2.0
    return sums.select("bt", "bi", "bj", b["t"].alias("b0"), b["i"].alias("b1"), b["j"].alias("b2"), constant.alias("b3"))


def regression_or_lorenzo(field: DataFrame, col: str, block: int, eb: int) -> DataFrame:
    """(t, bi, bj, mode): 1 where the plane's residuals on the block's two diagonals are smaller in sum than those of 2D Lorenzo, which get eb more each."""
    plane = plane_predicted(field, col, block).select("t", "i", "j", F.abs(F.col(col) - F.col(f"{col}_pred")).alias("p"))
    lorenzo = predicted(field.select("t", "i", "j", col), "lorenzo2d", (col,)).select("t", "i", "j", (F.abs(F.col(col) - F.col(f"{col}_pred")) + eb).alias("l"))
    di, dj = F.col("i") % block, F.col("j") % block
    both = plane.join(lorenzo, ["t", "i", "j"]).filter((di == dj) | (di + dj == block - 1))
    per = both.groupBy("t", F.floor(F.col("i") / block).cast("int").alias("bi"), F.floor(F.col("j") / block).cast("int").alias("bj")).agg(F.sum("p").alias("p"), F.sum("l").alias("l"))
    return per.select("t", "bi", "bj", (F.col("p") < F.col("l")).cast("int").alias("mode"))


def entropy_modes(predictions: dict[int, DataFrame], eb: int, block: int = 32, gain: float = 0.003, capacity: int = 65536, bins: bool = False) -> DataFrame:
    """(t, bi, bj, mode): the mode (key of predictions, rows as of predicted()) with the fewest bits a symbol in each block.

    bins: symbols count by magnitude only, in the six classes of coding.six_bins().

    Bits are the entropy of the block's quantised residuals, and 16 for each that has no code.  A mode other
    than the first wins only by the relative ``gain``; a block without rows of a mode can't take it.
    """
    div = lambda x, y: F.call_function("div", x, F.lit(y).cast("long"))
    scored = []
    for mode, rows in predictions.items():
        r = rows.select("t", F.floor(F.col("i") / block).cast("int").alias("bi"), F.floor(F.col("j") / block).cast("int").alias("bj"), F.explode(F.array(F.col("u") - F.col("u_pred"), F.col("v") - F.col("v_pred"))).alias("r"))
        steps = div(F.abs("r"), eb) + 1
        sym = F.when(steps >= capacity, F.lit(None)).otherwise(F.when(F.col("r") < 0, -div(steps, 2)).otherwise(div(steps, 2)))
        if bins:
            from .coding import six_bins

            sym = F.when(sym.isNotNull(), six_bins(sym))
        hist = r.groupBy("t", "bi", "bj", sym.alias("q")).agg(F.count("*").alias("n"))
        n = F.col("n").cast("double")
        per = hist.groupBy("t", "bi", "bj").agg(F.sum(F.when(F.col("q").isNotNull(), n)).alias("coded"), F.sum(F.when(F.col("q").isNotNull(), n * F.log2(n))).alias("s"), F.sum(n).alias("all"), F.sum(F.when(F.col("q").isNull(), n).otherwise(0.0)).alias("over"))
        bits = F.coalesce(F.log2("coded") - F.col("s") / F.col("coded"), F.lit(0.0)) + 16.0 * F.col("over") / F.col("all")
        scored.append(per.select("t", "bi", "bj", F.lit(mode).alias("mode"), bits.alias("bits")))
    first = next(iter(predictions))
    union = scored[0]
    for s in scored[1:]:
        union = union.unionByName(s)
    per = union.groupBy("t", "bi", "bj").agg(F.max(F.when(F.col("mode") == first, F.col("bits"))).alias("base"), F.min(F.struct("bits", "mode")).alias("best"))
    wins = (F.col("base") - F.col("best.bits")) / (F.col("base") + 1e-12) >= gain
    return per.select("t", "bi", "bj", F.when(wins, F.col("best.mode")).otherwise(F.lit(first)).alias("mode"))
