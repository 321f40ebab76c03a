"""Headerless arrays of floats in C order (frame, row, column)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid, packed_rows
from .parts import BYTES, Component, Layout, bodies, parts_of, read_layouts, size_of, write_pieces


def _file(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, so that any store that Spark reads is reached."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


@contextmanager
def output(spark: SparkSession, path: str) -> Iterator[Callable[[bytes], None]]:
    """Writes bytes to a new file in any store."""
    fs, p = _file(spark, path)
    stream = fs.create(p, True)
    try:
        yield stream.write
    finally:
        stream.close()


def layout(spark: SparkSession, paths: list[str], grid: Grid, dtype: str = "<f4") -> Layout:
    """Files of one grid side by side; raises if one does not hold exactly the grid's values."""
    size, comps = np.dtype(dtype).itemsize, []
    for path in paths:
        parts = parts_of(spark, path)
        if size_of(parts) != size * grid.size:
            raise ValueError(f"{path} has {size_of(parts)} bytes; the grid needs {size * grid.size}")
        comps.append(Component(parts, 0, grid.plane * size, grid.W * size, size, dtype))
    return Layout(paths[0], (grid.T, grid.H, grid.W), comps)


def read_rows(spark: SparkSession, path: str, grid: Grid, col: str = "u", dtype: str = "<f4", most: int = BYTES) -> DataFrame:
    """(t, i, col array of doubles): one row per grid row, read by as many tasks as there are ranges of ``most`` bytes."""
    return read_layouts(spark, [layout(spark, [path], grid, dtype)], [col], most=most).drop("path")


def read_field(spark: SparkSession, u: str, v: str, grid: Grid, dtype: str = "<f4", eps: float | None = None, most: int = BYTES) -> DataFrame:
    """(t, i, j, u, v) of two files, of which a task reads the same range; eps: magnitudes below it become 0."""
    rows = read_layouts(spark, [layout(spark, [u, v], grid, dtype)], ["u", "v"], most=most)
    out = rows.select("t", "i", F.posexplode(F.arrays_zip("u", "v")).alias("j", "z")).select("t", "i", "j", "z.u", "z.v")
    if eps is not None:
        out = out.withColumns({c: F.when(F.abs(c) < eps, 0.0).otherwise(F.col(c)) for c in "uv"})
    return out


def read_frame(spark: SparkSession, path: str, grid: Grid, t: int, dtype: str = "<f4", most: int = BYTES) -> DataFrame:
    """(t, i, u array of doubles) of one frame: only its bytes are read, by tasks."""
    if not 0 <= t < grid.T:
        raise ValueError(f"frame {t} of {grid.T}")
    return read_layouts(spark, [layout(spark, [path], grid, dtype)], ["u"], frames=(t, t + 1), most=most).drop("path")


def sized_rows(field: DataFrame, cols: list[str]) -> tuple[DataFrame, int, int]:
    """(rows, frames, height): (t, i, at, cols as arrays in order of j) of a field, at counting rows through all frames."""
    last = field.agg(F.max("t"), F.max("i")).first()
    frames, height = (0, 0) if last[0] is None else (last[0] + 1, last[1] + 1)
    return packed_rows(field, cols).withColumn("at", F.col("t").cast("long") * height + F.col("i")), frames, height


def write_raw(field: DataFrame, col: str, path: str, dtype: str = "<f4", most: int = BYTES) -> int:
    """One column as a file in order of (t, i, j), written in parts (see parts.py) of about ``most`` bytes, a task for some of them; returns the number of bytes."""
    rows, frames, height = sized_rows(field, [col])
    width = (field.agg(F.max("j")).first()[0] or 0) + 1
    size = np.dtype(dtype).itemsize * width
    write_pieces(bodies(rows, [col], lambda x: [r.tobytes() for r in x[:, 0].astype(dtype)]), frames * height, path, size, most=most)
    return frames * height * size


def frame_slice(field: DataFrame, t: int) -> DataFrame:
    return field.filter(F.col("t") == t)


def repacked(field: DataFrame) -> DataFrame:
    """(component, j, i, t, value): components apart and columns outermost."""
    return field.select("t", "i", "j", F.explode(F.array(F.struct(F.lit(0).alias("component"), F.col("u").alias("value")), F.struct(F.lit(1).alias("component"), F.col("v").alias("value")))).alias("c")).select("c.component", "j", "i", "t", "c.value")


def write_image(field: DataFrame, grid: Grid, path: str, most: int = BYTES) -> None:
    """VTK ImageData XML of a field (t, i, j, u, v): columns, rows and frames as x, y and z, values as text, a line for a grid row; in parts, as write_raw()."""
    extent = f"0 {grid.W - 1} 0 {grid.H - 1} 0 {grid.T - 1}"
    head = f'<?xml version="1.0"?>\n<VTKFile type="ImageData" version="0.1" byte_order="LittleEndian">\n<ImageData WholeExtent="{extent}" Origin="0 0 0" Spacing="1 1 1">\n<Piece Extent="{extent}">\n<PointData Vectors="uv">\n<DataArray type="Float32" Name="uv" NumberOfComponents="2" format="ascii">\n'
    line = lambda x: [(" ".join(f"{a:.9g} {b:.9g}" for a, b in zip(*r.tolist(), strict=True)) + "\n").encode() for r in x]
    rows, frames, height = sized_rows(field, ["u", "v"])
    write_pieces(bodies(rows, ["u", "v"], line), frames * height, path, 24 * grid.W, head.encode(), b"</DataArray>\n</PointData>\n</Piece>\n</ImageData>\n</VTKFile>\n", most)
