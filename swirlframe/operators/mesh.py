"""The space-time mesh: triangles of vertices of a (t, i, j) grid.

Corners of a cube are numbered 4 * dt + 2 * di + dj.  FACES are the triangles {0, a, b} of every
chain 0 < a < b of corners: the triangulation in which verification is done.  LEGACY splits sides
and diagonals the other way.  A face belongs to the cube of its smallest vertex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.triangles import has_zero
from ..grid import Grid, neighbours

CORNERS = [(k >> 2, k >> 1 & 1, k & 1) for k in range(8)]

# Fixed values: (number, class, corners) of the faces of a cube.
FACES = [
    (1, "layer", (0, 2, 3)), (2, "layer", (0, 1, 3)),
    (3, "horizontal", (0, 1, 5)), (4, "horizontal", (0, 4, 5)),
    (5, "vertical", (0, 2, 6)), (6, "vertical", (0, 4, 6)),
    (7, "diagonal", (0, 4, 7)), (8, "diagonal", (0, 3, 7)),
    (9, "interior", (0, 6, 7)), (10, "interior", (0, 2, 7)),
    (11, "interior", (0, 5, 7)), (12, "interior", (0, 1, 7)),
]
LEGACY = [
    (1, "layer", (0, 2, 3)), (2, "layer", (0, 1, 3)),
    (3, "horizontal", (0, 1, 5)), (4, "horizontal", (0, 4, 5)),
    (5, "vertical", (0, 2, 4)), (6, "vertical", (2, 4, 6)),
    (7, "diagonal", (0, 3, 4)), (8, "diagonal", (3, 4, 7)),
    (9, "interior", (2, 3, 4)), (10, "interior", (2, 4, 7)),
    (11, "interior", (0, 3, 5)), (12, "interior", (3, 4, 5)),
]


def corner_values(field: DataFrame, cols: tuple[str, ...] = ("u", "v")) -> DataFrame:
    """(t, i, j, <col>_0 .. <col>_7): each vertex with the corners of its cube; null where that leaves the grid."""
    return neighbours(field, list(cols), CORNERS)


def offset(grid: Grid, corner: int) -> int:
    dt, di, dj = CORNERS[corner]
    return dt * grid.plane + di * grid.W + dj


def faces(field: DataFrame, grid: Grid, templates: list = FACES) -> DataFrame:
    """All faces of a fixed-point field (t, i, j, u, v): t, i, j of the cube, tmpl, cls, a < b < c, and ua .. vc.

    One row per template and cube whose three vertices are in the grid.
    """
    at = grid.vid()

    def one(number: int, cls: str, corners: tuple[int, int, int]) -> Column:
        ids = [(at + offset(grid, c)).alias(n) for c, n in zip(corners, "abc", strict=True)]
        values = [F.col(f"{x}_{c}").alias(x + n) for c, n in zip(corners, "abc", strict=True) for x in "uv"]
        return F.struct(F.lit(number).alias("tmpl"), F.lit(cls).alias("cls"), *ids, *values)

    made = corner_values(field).select("t", "i", "j", F.explode(F.array(*(one(*x) for x in templates))).alias("f")).select("t", "i", "j", "f.*")
    return made.filter("ua is not null and ub is not null and uc is not null")


def layer_faces(field: DataFrame, grid: Grid) -> DataFrame:
    return faces(field, grid, FACES[:2])


def zero_faces(field: DataFrame, grid: Grid, templates: list = FACES) -> DataFrame:
    """The faces that hold a zero of the field (critical points), ties decided by vertex order."""
    f = faces(field, grid, templates)
    return f.filter(has_zero(*(F.col(x) for x in ("ua", "va", "ub", "vb", "uc", "vc"))))


def adjacent_vertices(grid: Grid, vertices: DataFrame) -> DataFrame:
    """(vid, other): the six neighbours along the axes, as far as they are in the grid; vertices has (t, i, j)."""
    steps = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    moved = F.array(*(F.struct((F.col("t") + a).alias("t"), (F.col("i") + b).alias("i"), (F.col("j") + c).alias("j")) for a, b, c in steps))
    out = vertices.select(grid.vid().alias("vid"), F.explode(moved).alias("o")).select("vid", "o.*")
    return out.filter(grid.inside(F.col("t"), F.col("i"), F.col("j"))).select("vid", grid.vid().alias("other"))


#: The six tetrahedra of a cube: chains 0 < a < b < 7 of corners.
TETRAHEDRA = [(0, 1, 3, 7), (0, 1, 5, 7), (0, 2, 3, 7), (0, 2, 6, 7), (0, 4, 5, 7), (0, 4, 6, 7)]
#: The three tetrahedra of the prism over each of a cell's triangles.
PRISMS = {1: [(0, 2, 3, 7), (0, 2, 6, 7), (0, 4, 6, 7)], 2: [(0, 1, 3, 7), (0, 1, 5, 7), (0, 4, 5, 7)]}


def tetrahedron_faces(field: DataFrame, grid: Grid) -> DataFrame:
    """(tet, a, b, c, hit): the four faces of each tetrahedron (tet = 6 * vid of its cube + its number) and whether they hold a zero."""
    at = grid.vid()

    def one(number: int, corners: tuple[int, ...]) -> Column:
        sides = []
        for left_out in range(4):
            abc = [c for k, c in enumerate(corners) if k != left_out]
            ids = [(at + offset(grid, c)).alias(n) for c, n in zip(abc, "abc", strict=True)]
            values = [F.col(f"{x}_{c}").alias(x + n) for c, n in zip(abc, "abc", strict=True) for x in "uv"]
            sides.append(F.struct((at * 6 + number).alias("tet"), *ids, *values))
        return F.array(*sides)

    inside = corner_values(field).filter("u_7 is not null")
    made = inside.select(F.explode(F.concat(*(one(n, c) for n, c in enumerate(TETRAHEDRA)))).alias("f")).select("f.*")
    return made.select("tet", "a", "b", "c", has_zero(*(F.col(x) for x in ("ua", "va", "ub", "vb", "uc", "vc"))).alias("hit"))


def tetrahedron_hits(field: DataFrame, grid: Grid) -> DataFrame:
    """(hits, n): how many tetrahedra have how many faces with a zero; in a proper field all have 0 or 2."""
    per = tetrahedron_faces(field, grid).groupBy("tet").agg(F.sum(F.col("hit").cast("long")).alias("hits"))
    return per.groupBy("hits").agg(F.count("*").alias("n"))


def split_by_template(grid: Grid) -> dict[int, int]:
    """How many faces each template has in the grid."""
    out = {}
    for number, _, corners in FACES:
        d = [max(CORNERS[c][k] for c in corners) for k in range(3)]
        out[number] = max(grid.T - d[0], 0) * max(grid.H - d[1], 0) * max(grid.W - d[2], 0)
    return out


def incident_templates(templates: list = FACES) -> list[tuple[int, tuple[int, int, int], tuple[int, int, int]]]:
    """The 36 faces around an inner vertex, as (template, offset, offset) of the two other vertices."""
    out = []
    for number, _, corners in templates:
        for me in corners:
            rest = [tuple(x - y for x, y in zip(CORNERS[c], CORNERS[me], strict=True)) for c in corners if c != me]
            out.append((number, *rest))
    return out
