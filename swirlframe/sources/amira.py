"""Amira lattices: a text header, then binary, ASCII or Base64 values.

The header is read line by line: its first line names the kind of file and the order of bytes, a ``define`` gives the size of
the lattice, a declaration in braces the type of its values, and the line ``# Data section follows`` ends it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid, union_all
from .parts import BYTES, Bytes, Component, Layout, Text, bodies, files_of, header, read_layouts, read_text, size_of, write_pieces
from .raw import sized_rows

END = "# data section follows"
# Types of numbers.
TYPES = {"byte": "u1", "char": "i1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8"}


@dataclass(frozen=True)
class Lattice:
    nx: int
    ny: int
    nz: int
    kind: str
    components: int
    order: str
    encoding: str

    @property
    def count(self) -> int:
        return self.nx * self.ny * self.nz * self.components


def _tokens(line: str) -> list[str]:
    """The words of a line; braces, brackets, quotes and commas stand alone or fall away."""
    for mark in "{}[]":
        line = line.replace(mark, f" {mark} ")
    return line.replace('"', " ").replace(",", " ").split()


def split(body: bytes) -> tuple[str, bytes]:
    """(header text, data): what follows the end mark, empty lines and a tag such as @1."""
    at = 0
    while at < len(body):
        line_end = body.find(b"\n", at)
        line_end = len(body) if line_end < 0 else line_end
        if body[at:line_end].decode("latin-1").strip().lower() == END:
            header, at = body[:at].decode("latin-1"), line_end + 1
            break
        at = line_end + 1
    else:
        raise ValueError("no data section")
    while body[at : at + 1] in (b"\n", b"\r"):
        at += 1
    tag = body[at : at + 32].split(b"\n")[0].strip()
    if tag[:1] == b"@" and tag[1:].isdigit():
        at = body.index(b"\n", at) + 1
    return header, body[at:]


def parse_header(text: str) -> Lattice:
    """Raises for headers without a size or a type, or with a type that is no number."""
    lines = [_tokens(x) for x in text.splitlines()]
    first = next((x for x in lines if x), [])
    marks = [x.upper() for x in first]
    size, kind, components, encoding = None, None, 1, "binary"
    for words in lines:
        low = [w.lower() for w in words]
        if low[:2] == ["define", "lattice"]:
            size = [int(w) for w in words[2:5]]
        elif low[:2] == ["lattice", "{"] and "}" in low:
            # Lattice { type [ n ] name } @k
            inside = words[2 : low.index("}")]
            kind = inside[0].lower()
            if "[" in inside:
                components = int(inside[inside.index("[") + 1])
        if "encoding" in low and low[low.index("encoding") + 1 :][:1] == ["base64"]:
            encoding = "base64"
    if size is None or len(size) != 3 or kind is None:
        raise ValueError("a header needs 'define Lattice nx ny nz' and 'Lattice { type[n] name }'")
    if kind not in TYPES:
        raise ValueError(f"unknown type {kind}")
    if encoding == "binary" and "ASCII" in marks:
        encoding = "ascii"
    order = ">" if any("BIG-ENDIAN" in m for m in marks) else "<"
    return Lattice(*size, kind, components, order, encoding)


def values(lattice: Lattice, data: bytes) -> np.ndarray:
    """All values as doubles, (nz, ny, nx, components).

    Data that a header does not mark as Base64 are taken as such if there are more bytes than binary values need and they are
    whole Base64: a multiple of four letters of its alphabet for exactly the values of the lattice.
    """
    kind, encoding = np.dtype(lattice.order + TYPES[lattice.kind]), lattice.encoding
    need = lattice.count * kind.itemsize
    raw = data
    if encoding == "base64" or encoding == "binary" and len(data) > need:
        letters = b"".join(data.split())
        if encoding == "base64" or len(letters) == -(-need // 3) * 4:
            try:
                raw = base64.b64decode(letters, validate=True)
            except ValueError:
                if encoding == "base64":
                    raise
    if encoding == "ascii":
        flat = np.array(data.split()[: lattice.count], dtype="f8").astype(kind.newbyteorder("="))
    else:
        flat = np.frombuffer(raw[: need - need % kind.itemsize], kind, min(lattice.count, len(raw) // kind.itemsize))
    if flat.size != lattice.count:
        raise ValueError(f"{flat.size} values; the header says {lattice.count}")
    return flat.astype("f8").reshape(lattice.nz, lattice.ny, lattice.nx, lattice.components)


def found(parts: list) -> tuple[Lattice, int]:
    """(lattice, where its values begin)."""

    def parse(body: bytes) -> tuple[Lattice, int]:
        head, data = split(body)
        if len(data) < 64 and len(body) < size_of(parts):
            raise ValueError("the tag behind the header may go on")
        return parse_header(head), len(body) - len(data)

    return header(parts, parse)


def layout(path: str, parts: list) -> Layout | None:
    """Where a lattice of binary values lies in its file; None if values are text."""

    lattice, begin = found(parts)
    kind = np.dtype(lattice.order + TYPES[lattice.kind])
    need, have = lattice.count * kind.itemsize, size_of(parts) - begin
    if lattice.encoding != "binary" or 3 * have >= 4 * need > 0:  # as long as Base64 of the values would be
        return None
    if have < need:
        raise ValueError(f"{path}: {have} bytes of values; the header says {need}")
    item = lattice.components * kind.itemsize
    row = lattice.nx * item
    return Layout(path, (lattice.nz, lattice.ny, lattice.nx), [Component(parts, begin + c * kind.itemsize, lattice.ny * row, row, item, kind.str) for c in range(lattice.components)])


def read_lattices(spark: SparkSession, path: str, most: int = BYTES) -> list[tuple[int, DataFrame]]:
    """(components, rows) of the files at path, those with as many components together: (path, t, i, c0, c1, ...: arrays of doubles), a row per grid row.

    path is a file, a pattern of files, or what write_amira() has written.  Files of binary and ASCII values are split by rows, at ``most`` bytes; one in Base64 is read by one task.
    """
    binary: dict[int, list[Layout]] = {}
    ascii_: dict[int, dict[str, tuple[Lattice, Text]]] = {}
    texts: dict[int, list] = {}
    for name, parts in files_of(spark, path):
        made = layout(name, parts)
        if made:
            binary.setdefault(len(made.components), []).append(made)
            continue
        lattice, begin = found(parts)
        if lattice.encoding == "ascii":
            text = Text(name, parts, begin, size_of(parts), lattice.nx * lattice.components, lattice.ny * lattice.nz, TYPES[lattice.kind])
            ascii_.setdefault(lattice.components, {})[name] = lattice, text
        else:
            texts.setdefault(lattice.components, []).append((name, parts))
    out = []
    for n in sorted({*binary, *ascii_, *texts}):
        names = [f"c{k}" for k in range(n)]
        made = [read_layouts(spark, binary[n], names, most=most)] if n in binary else []
        if n in ascii_:
            heights = spark.createDataFrame([(name, lattice.ny) for name, (lattice, _) in ascii_[n].items()], "path string, ny int")
            rows = read_text(spark, [text for _, text in ascii_[n].values()], most).join(F.broadcast(heights), "path")
            each = [F.expr(f"filter(values, (_, m) -> m % {n} = {k})").alias(c) for k, c in enumerate(names)]
            made.append(rows.select("path", F.expr("cast(at div ny as int)").alias("t"), F.expr("cast(at % ny as int)").alias("i"), *each))
        if n in texts:
            listed = spark.createDataFrame([(name, [tuple(p) for p in parts]) for name, parts in texts[n]], "path string, parts array<struct<uri:string,at:long,size:long>>")
            made.append(listed.repartition(len(texts[n]), "path").mapInPandas(_read_text(names), "path string, t int, i int, " + ", ".join(f"{c} array<double>" for c in names)))
        out.append((n, union_all(made)))
    return out


def _read_text(names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, parts in zip(b["path"], b["parts"], strict=True):
                parts = [(p["uri"], p["at"], p["size"]) if isinstance(p, dict) else tuple(p) for p in parts]
                source = Bytes(parts)
                head, data = split(source.read(0, size_of(parts)))
                source.close()
                v = values(parse_header(head), data)
                for t in range(v.shape[0]):
                    yield pd.DataFrame({"path": name, "t": t, "i": range(v.shape[1]), **{c: v[t, :, :, k].tolist() for k, c in enumerate(names)}})

    return run


def read_amira(spark: SparkSession, path: str, most: int = BYTES) -> DataFrame:
    """(path, t, i, component, values array of doubles): a row per grid row of each component, of all files at path (see read_lattices())."""
    made = []
    for n, rows in read_lattices(spark, path, most):
        made.append(rows.select("path", "t", "i", F.posexplode(F.array(*(F.col(f"c{k}") for k in range(n)))).alias("component", "values")))
    return union_all(made)


def read_amira_field(spark: SparkSession, path: str, most: int = BYTES) -> DataFrame:
    """(path, t, i, j, u, v) of lattices of two components: frames along the slowest axis."""
    rows = [r for n, r in read_lattices(spark, path, most) if n == 2]
    if not rows:
        raise ValueError(f"no lattice of two components at {path}")
    return rows[0].select("path", "t", "i", F.posexplode(F.arrays_zip("c0", "c1")).alias("j", "z")).select("path", "t", "i", "j", F.col("z.c0").alias("u"), F.col("z.c1").alias("v"))


def component(rows: DataFrame, number: int, name: str = "u") -> DataFrame:
    """(t, i, j, name): one component of read_amira(), as raw.write_raw() takes it."""
    return rows.filter(F.col("component") == number).select("t", "i", F.posexplode("values").alias("j", name))


def write_amira(field: DataFrame, grid: Grid, path: str, encoding: str = "binary", most: int = BYTES) -> None:
    """A field (t, i, j, u, v) as one lattice of floats at path, in parts (see parts.py) of about ``most`` bytes; encoding binary (little-endian) or ascii."""
    head = f"# AmiraMesh {'ASCII' if encoding == 'ascii' else 'BINARY-LITTLE-ENDIAN'} 2.1\n\ndefine Lattice {grid.W} {grid.H} {grid.T}\n\nLattice {{ float[2] Data }} @1\n\n# Data section follows\n@1\n"

    def body(x: np.ndarray) -> list[bytes]:
        pairs = x.transpose(0, 2, 1).astype("<f4")
        return [r.tobytes() if encoding == "binary" else (" ".join(map(repr, r.ravel().astype(float).tolist())) + "\n").encode() for r in pairs]

    rows, frames, height = sized_rows(field, ["u", "v"])
    write_pieces(bodies(rows, ["u", "v"], body), frames * height, path, (8 if encoding == "binary" else 40) * grid.W, head.encode(), most=most)
