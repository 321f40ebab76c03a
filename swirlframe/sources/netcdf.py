"""NetCDF files of the classic format (versions 1 and 2): a binary header of dimensions and variables, then big-endian values.

The format of version 4, which is HDF5, needs a library and is not read.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid
from .parts import BYTES, Component, Layout, bodies, files_of, header, read_layouts, write_pieces
from .raw import sized_rows

# Numbers of types, tags of lists.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12


@dataclass
class Variable:
    shape: tuple[int, ...]
    record: bool
    kind: np.dtype
    begin: int
    attributes: dict


class _Header:
    def __init__(self, body: bytes):
        if body[:3] != b"CDF" or body[3] not in (1, 2):
            raise ValueError("not a NetCDF file of the classic format")
        self.body, self.at, self.wide = body, 4, body[3] == 2
        self.records = self.number()
        sizes = [(self.name(), self.number()) for _ in range(self.list_of(DIMENSION))]
        self.attributes()
        self.variables: dict[str, Variable] = {}
        self.record_size = 0
        for _ in range(self.list_of(VARIABLE)):
            name = self.name()
            dims = [sizes[self.number()][1] for _ in range(self.number())]
            attributes = self.attributes()
            kind = np.dtype(TYPES[self.number()])
            stored = self.number()
            begin = struct.unpack_from(">q" if self.wide else ">i", body, self.at)[0]
            self.at += 8 if self.wide else 4
            record = bool(dims) and dims[0] == 0
            self.record_size += stored if record else 0
            self.variables[name] = Variable(tuple(self.records if record and k == 0 else n for k, n in enumerate(dims)), record, kind, begin, attributes)

    def number(self) -> int:
        self.at += 4
        return struct.unpack_from(">i", self.body, self.at - 4)[0]

    def name(self) -> str:
        n = self.number()
        self.at += -(-n // 4) * 4
        start = self.at - -(-n // 4) * 4
        return self.body[start : start + n].decode()

    def list_of(self, tag: int) -> int:
        found, n = self.number(), self.number()
        if found not in (0, tag):
            raise ValueError(f"a list with the tag {found}")
        return n

    def attributes(self) -> dict:
        out = {}
        for _ in range(self.list_of(ATTRIBUTE)):
            name, kind, n = self.name(), np.dtype(TYPES[self.number()]), self.number()
            out[name] = np.frombuffer(self.body, kind, n, self.at)
            self.at += -(-n * kind.itemsize // 4) * 4
        return out


def layout(path: str, parts: list, names: list[str]) -> Layout:
    """Where variables (frame, row, column) lie in a file; what their _FillValue or missing_value marks, and NaN, reads as 0."""

    def parse(body: bytes) -> _Header:
        return _Header(body)

    if not header(parts, lambda b: b[:3] == b"CDF" and b[3:4] in (b"\x01", b"\x02"), 4):
        raise ValueError(f"{path} is not a NetCDF file of the classic format")
    head, comps, shapes = header(parts, parse), [], []
    for name in names:
        if name not in head.variables:
            raise ValueError(f"no variable {name!r} in {path}; there are {sorted(head.variables)}")
        v = head.variables[name]
        shapes.append(v.shape)
        if len(v.shape) != 3:
            continue
        row = v.shape[2] * v.kind.itemsize
        several = len([x for x in head.variables.values() if x.record]) > 1
        frame = head.record_size if v.record and several else v.shape[1] * row
        missing = [v.attributes[m][0].item() for m in ("_FillValue", "missing_value") if m in v.attributes]
        comps.append(Component(parts, v.begin, frame, row, v.kind.itemsize, v.kind.str, missing))
    if len(comps) < len(names) or len(set(shapes)) > 1:
        raise ValueError(f"{', '.join(names)} of {path} are {', '.join(map(str, shapes))}; one shape (frame, row, column) is needed")
    return Layout(path, shapes[0], comps)


def read_netcdf_field(spark: SparkSession, path: str, u: str = "u", v: str = "v", most: int = BYTES) -> DataFrame:
    """(path, t, i, j, u, v) as floats of two variables (frame, row, column) of all files at path (a file, a pattern, or what write_netcdf() has written); files are split by rows, at ``most`` bytes."""
    rows = read_layouts(spark, [layout(name, parts, [u, v]) for name, parts in files_of(spark, path)], ["u", "v"], "float", most=most)
    return rows.select("path", "t", "i", F.posexplode(F.arrays_zip("u", "v")).alias("j", "z")).select("path", "t", "i", "j", "z.u", "z.v")


def _head(names: list[str], frames: int, h: int, w: int, fill: float | None) -> bytes:
    """The header of a file of float variables (frame, row, column); frames are records."""
    text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    mark = struct.pack(">ii", 0, 0) if fill is None else struct.pack(">ii", ATTRIBUTE, 1) + text("_FillValue") + struct.pack(">iif", 5, 1, fill)
    head = b"CDF\x01" + struct.pack(">i", frames)
    head += struct.pack(">ii", DIMENSION, 3) + b"".join(text(n) + struct.pack(">i", s) for n, s in (("time", 0), ("y", h), ("x", w)))
    head += struct.pack(">ii", 0, 0) + struct.pack(">ii", VARIABLE, len(names))
    plane = h * w * 4
    size = len(head) + sum(len(text(n)) + 16 + len(mark) + 12 for n in names)
    for k, n in enumerate(names):
        head += text(n) + struct.pack(">iiii", 3, 0, 1, 2) + mark + struct.pack(">iii", 5, plane, size + k * plane)
    return head


def write_netcdf(field: DataFrame, grid: Grid, path: str, fill: float | None = None, most: int = BYTES) -> None:
    """A field (t, i, j, u, v) as one file of the classic format, in parts (see parts.py) of about ``most`` bytes; nulls are written as ``fill`` (None: 0).

    A frame is all rows of u, then all rows of v.
    """
    none = F.lit(fill if fill is not None else 0.0)
    rows, frames, height = sized_rows(field.withColumns({c: F.coalesce(F.col(c).cast("double"), none) for c in "uv"}), ["u", "v"])
    each = rows.select("t", "i", F.posexplode(F.array("u", "v")).alias("c", "values"))
    each = each.select(((F.col("t").cast("long") * 2 + F.col("c")) * height + F.col("i")).alias("at"), "values")
    write_pieces(bodies(each, ["values"], lambda x: [r.tobytes() for r in x[:, 0].astype(">f4")]), 2 * frames * height, path, 4 * grid.W, _head(["u", "v"], grid.T, grid.H, grid.W, fill), most=most)
