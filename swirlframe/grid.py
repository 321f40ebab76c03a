"""Grids and vector fields as DataFrames.

A field is (t, i, j, u, v): frame, row, column (fastest) and two components.  Neighbour
access packs each grid row (one t, one i) into arrays of its columns: moving in j is then an array slice,
moving in t or i an equi-join on (t, i) of N / W packed rows.  A stencil of eight corners thus
costs three joins of packed rows, whatever the number of faces built from it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Rows H, columns W and frames T of a dense field."""

    H: int
    W: int
    T: int

    @property
    def plane(self) -> int:
        return self.H * self.W

    @property
    def size(self) -> int:
        return self.plane * self.T

    def vid(self, t: Column | str = "t", i: Column | str = "i", j: Column | str = "j") -> Column:
        t, i, j = (F.col(x) if isinstance(x, str) else x for x in (t, i, j))
        return t.cast("long") * self.plane + i.cast("long") * self.W + j.cast("long")

    def coordinates(self, vid: Column | str) -> tuple[Column, Column, Column]:
        vid = F.col(vid) if isinstance(vid, str) else vid
        whole = lambda x, y: F.floor(x / F.lit(y)).cast("long")
        t = whole(vid, self.plane)
        rest = vid - t * self.plane
        i = whole(rest, self.W)
        return t, i, rest - i * self.W

    def inside(self, t: Column, i: Column, j: Column) -> Column:
        return t.between(0, self.T - 1) & i.between(0, self.H - 1) & j.between(0, self.W - 1)


#: The field view of the embeddings table: 25 vectors of 64 numbers make a frame of 25 rows and 32 columns.
VIEW_H, VIEW_W = 25, 32


def field_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, i, j, u, v) from the embeddings table: consecutive pairs of numbers of a vector are the vertices of a grid row."""
    n = view_grid(spark, sf_dir).T
    return vector_field(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), VIEW_H, VIEW_W, "vec_id", "embedding").filter(F.col("t") < n)


def vector_field(vectors: DataFrame, height: int, width: int, id_col: str, values_col: str) -> DataFrame:
    """(t, i, j, u, v) of a table of grid rows: vector number id has the pairs of row id mod height of frame id div height."""
    e = vectors.select(F.col(id_col).alias("id"), F.col(values_col).alias("e"))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.struct(F.element_at("e", (2 * k + 1).cast("int")).alias("u"), F.element_at("e", (2 * k + 2).cast("int")).alias("v")))
    rows = e.select(F.floor(F.col("id") / height).cast("int").alias("t"), (F.col("id") % height).cast("int").alias("i"), F.posexplode(pairs).alias("j", "p"))
    return rows.select("t", "i", "j", "p.u", "p.v")


def view_grid(spark: SparkSession, sf_dir: str) -> Grid:
    """Its whole frames only count (the table's metadata gives the number of rows)."""
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    return Grid(VIEW_H, VIEW_W, n // VIEW_H)


def smooth_view(spark: SparkSession, sf_dir: str, reach: int = 3) -> DataFrame:
    """field_view() with every value the mean of those within ``reach`` along each axis: what a field of a flow is like, where the view is nearly noise."""
    f = field_view(spark, sf_dir)
    for axis, rest in (("j", ("t", "i")), ("i", ("t", "j")), ("t", ("i", "j"))):
        near = Window.partitionBy(*rest).orderBy(axis).rowsBetween(-reach, reach)
        f = f.select("t", "i", "j", *(F.avg(F.col(c).cast("double")).over(near).alias(c) for c in "uv"))
    return f.select("t", "i", "j", *(F.col(c).cast("float").alias(c) for c in "uv"))


@dataclass(frozen=True)
class Scale:
    """A field's fixed-point scale: values times 2**shift, truncated."""

    max_abs: float
    shift: int

    @property
    def factor(self) -> int:
        return 1 << self.shift


def bits_above(x: float) -> int:
    """ceil(log2(x)) exactly; 0 for x = 0."""
    if x <= 0:
        return 0
    m, e = math.frexp(x)
    return e - 1 if m == 0.5 else e


def fixed_scale(field: DataFrame, cols: tuple[str, ...] = ("u", "v"), nbits: int = 30) -> Scale:
    """One aggregate over the field: the largest magnitude, and how far values can be shifted to stay below 2**nbits."""
    top = field.agg(F.max(F.greatest(*(F.abs(c).cast("double") for c in cols)) if len(cols) > 1 else F.abs(cols[0]).cast("double"))).first()[0] or 0.0
    return Scale(top, min(max(nbits - bits_above(top), 0), 62))


def to_fixed(field: DataFrame, scale: Scale, cols: tuple[str, ...] = ("u", "v")) -> DataFrame:
    """Each column as bigint: x * 2**shift, truncated towards zero (the product is exact)."""
    return field.withColumns({c: (F.col(c).cast("double") * float(scale.factor)).cast("long") for c in cols})


def to_float(field: DataFrame, scale: Scale, cols: tuple[str, ...] = ("u", "v"), kind: str = "float") -> DataFrame:
    """The inverse of to_fixed(), up to what it truncated."""
    return field.withColumns({c: (F.col(c) / float(scale.factor)).cast(kind) for c in cols})


def packed_rows(field: DataFrame, cols: list[str]) -> DataFrame:
    """(t, i, arrays of cols in order of j): one row per grid row; its arrays hold W numbers."""
    packed = field.groupBy("t", "i").agg(F.array_sort(F.collect_list(F.struct("j", *cols))).alias("_r"))
    return packed.select("t", "i", *(F.col(f"_r.{c}").alias(c) for c in cols))


def neighbours(field: DataFrame, cols: list[str], offsets: list[tuple[int, int, int]]) -> DataFrame:
    """(t, i, j, cols, and <col>_<k> at the vertex moved by offsets[k] = (dt, di, dj)); null outside the grid.

    Rows must be dense in j from 0.  A join for each different (dt, di) other than (0, 0).
    """
    rows = packed_rows(field, cols)
    base, width = rows, F.size(cols[0])
    for dt, di in sorted({(a, b) for a, b, _ in offsets} - {(0, 0)}):
        moved = rows.select((F.col("t") - dt).alias("t"), (F.col("i") - di).alias("i"), *(F.col(c).alias(f"{c}|{dt}|{di}") for c in cols))
        base = base.join(moved, ["t", "i"], "left")

    def shifted(c: str, offset: tuple[int, int, int]) -> Column:
        dt, di, dj = offset
        kind = field.schema[c].dataType.simpleString()
        none = F.lit(None).cast(kind)
        whole = F.col(c) if (dt, di) == (0, 0) else F.coalesce(F.col(f"`{c}|{dt}|{di}`"), F.array_repeat(none, width))
        if dj > 0:
            return F.concat(F.slice(whole, dj + 1, width), F.array_repeat(none, F.least(F.lit(dj), width)))
        if dj < 0:
            return F.slice(F.concat(F.array_repeat(none, -dj), whole), 1, width)
        return whole

    names = [*cols, *(f"{c}_{k}" for c in cols for k in range(len(offsets)))]
    arrays = [*(F.col(c) for c in cols), *(shifted(c, o) for c in cols for o in offsets)]
    base = base.select("t", "i", *(a.alias(n) for a, n in zip(arrays, names, strict=True)))
    zipped = F.arrays_zip(*names)
    return base.select("t", "i", F.posexplode(zipped).alias("j", "_z")).select("t", "i", "j", *(F.col(f"_z.{n}").alias(n) for n in names))


def swirl_field(spark: SparkSession, grid: Grid, kind: str = "repelling", drift: float = 0.25, ci: float | None = None, cj: float | None = None) -> DataFrame:
    """An analytic field with one critical point that moves ``drift`` columns and half as many rows a frame: repelling, attracting, saddle, center or focus.

    Rational numbers only, so all engines agree to the last bit.
    """
    ci = (grid.H - 1) / 2 + 0.25 if ci is None else ci
    cj = (grid.W - 1) / 2 - 2.0 + 0.125 if cj is None else cj
    base = spark.range(grid.size).select(*(c.cast("int").alias(n) for c, n in zip(grid.coordinates(F.col("id")), "tij", strict=True)))
    x = F.col("j") - (F.lit(cj) + F.col("t") * F.lit(drift))
    y = F.col("i") - (F.lit(ci) + F.col("t") * F.lit(drift / 2))
    made = {"repelling": (x, y), "attracting": (-x, -y), "saddle": (x, -y), "center": (-y, x), "focus": (x * 0.25 - y, x + y * 0.25)}[kind]
    return base.select("t", "i", "j", made[0].cast("double").alias("u"), made[1].cast("double").alias("v"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
