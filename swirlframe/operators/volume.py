"""Fields of three components on a (t, i, j) grid, seen as a volume, and on unstructured tetrahedra."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import Grid, neighbours
from .mesh import CORNERS, TETRAHEDRA, offset

Four = tuple[Column, Column, Column, Column]
NBITS = 19  # so that determinants of three fixed-point vectors stay within a bigint
VERTICES = "abcd"
#: Rows of an unstructured mesh, four a tetrahedron, that a task of unstructured() has about.
ROWS = 1 << 20

# Type numbers of critical points of volumes, by stable (real eigenvalues) or not, and sinks by number of
# negative real parts.
TYPE_NAMES = ["singular", "stable source", "unstable source", "stable repelling saddle", "unstable repelling saddle", "stable attracting saddle", "unstable attracting saddle", "stable sink", "unstable sink"]


def volume_view(spark, sf_dir: str) -> tuple[DataFrame, Grid]:
    """(t, i, j, u, v, w) from the embeddings table: consecutive triples of numbers of a vector; 25 vectors a layer."""
    from ..grid import VIEW_H, view_grid

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("e"))
    g = view_grid(spark, sf_dir)
    triples = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.struct(*(F.element_at("e", (3 * k + m).cast("int")).alias(c) for m, c in enumerate("uvw", 1))))
    rows = e.select(F.floor(F.col("vec_id") / VIEW_H).cast("int").alias("t"), (F.col("vec_id") % VIEW_H).cast("int").alias("i"), F.posexplode(triples).alias("j", "p"))
    return rows.select("t", "i", "j", "p.u", "p.v", "p.w").filter(F.col("t") < g.T), Grid(VIEW_H, 21, g.T)


def det3(a: tuple[Column, ...], b: tuple[Column, ...], c: tuple[Column, ...]) -> Column:
    """det of the vectors a, b, c."""
    return a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])


def _vectors() -> list[tuple[Column, Column, Column]]:
    return [tuple(F.col(x + n) for x in "uvw") for n in VERTICES]


def weights(p: list[tuple[Column, Column, Column]]) -> list[Column]:
    """The four determinants whose common sign says that the origin is within the tetrahedron of vectors p."""
    a, b, c, d = p
    return [-det3(b, c, d), det3(a, c, d), -det3(a, b, d), det3(a, b, c)]


def tetrahedra(field: DataFrame, grid: Grid) -> DataFrame:
    """(t, i, j, tet, a .. d, ua .. wd) of a fixed-point field (t, i, j, u, v, w): six of each cube, corners in order of vid."""
    at = grid.vid()

    def one(number: int, corners: tuple[int, ...]) -> Column:
        ids = [(at + offset(grid, c)).alias(n) for c, n in zip(corners, VERTICES, strict=True)]
        return F.struct(F.lit(number).alias("tet"), *ids, *(F.col(f"{x}_{c}").alias(x + n) for c, n in zip(corners, VERTICES, strict=True) for x in "uvw"))

    cubes = neighbours(field, ["u", "v", "w"], CORNERS).filter("u_7 is not null")
    return cubes.select("t", "i", "j", F.explode(F.array(*(one(k, c) for k, c in enumerate(TETRAHEDRA)))).alias("f")).select("t", "i", "j", "f.*")


def ties_agree(p: list[tuple[Column, Column, Column]]) -> Column:
    """Whether the signs (1 or -1) of weights() are one, where a determinant of 0 is decided as if the origin were moved by (e, e*e, e*e*e) for a small e > 0.

    det(a - q, b - q, c - q) = det(a, b, c) - q . n with n = b x c + c x a + a x b, so the first of det, -n that isn't 0 tells (for vectors
    on one line: 1).  The sign of a side depends on its three vertices only, so two tetrahedra never both miss a zero on their side, nor both have it.
    The four sides are elements of an array, so that what is done with each is compiled once; it is meant for the few rows with a tie.
    """

    def cross(x, y):
        return (x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0])

    def sign(side: Column) -> Column:
        x, y, z = (tuple(side[f"{v}{k}"] for k in range(3)) for v in "xyz")
        normal = [sum(k[1:], k[0]) for k in zip(cross(y, z), cross(z, x), cross(x, y), strict=True)]
        turn, s = side["turn"], side["turn"]
        for term in [*(-n for n in reversed(normal)), det3(x, y, z)]:
            s = F.when(term > 0, turn).when(term < 0, -turn).otherwise(s)
        return s

    a, b, c, d = p
    sides = [F.struct(F.lit(turn).alias("turn"), *(x[k].alias(f"{v}{k}") for v, x in zip("xyz", side, strict=True) for k in range(3))) for turn, side in zip((-1, 1, -1, 1), ((b, c, d), (a, c, d), (a, b, d), (a, b, c)), strict=True)]
    return F.size(F.array_distinct(F.transform(F.array(*sides), sign))) == 1


def with_zero(tets: DataFrame) -> DataFrame:
    """The tetrahedra that hold a zero (m0 .. m3: weights()): all determinants have one sign, ties decided by ties_agree()."""
    return _weighed(tets).filter(_holds_zero())


def _weighed(tets: DataFrame) -> DataFrame:
    return tets.withColumns({f"m{k}": w for k, w in enumerate(weights(_vectors()))})


def _holds_zero() -> Column:
    """Of _weighed() rows."""
    strict = ((F.col("m0") > 0) & (F.col("m1") > 0) & (F.col("m2") > 0) & (F.col("m3") > 0)) | ((F.col("m0") < 0) & (F.col("m1") < 0) & (F.col("m2") < 0) & (F.col("m3") < 0))
    tied = (F.col("m0") == 0) | (F.col("m1") == 0) | (F.col("m2") == 0) | (F.col("m3") == 0)
    return strict | (tied & ties_agree(_vectors()))


def _axes(tet: int) -> list[int]:
    """Along which axis (0 t, 1 i, 2 j) each step of a tetrahedron's chain goes."""
    chain = TETRAHEDRA[tet]
    return [next(k for k in range(3) if CORNERS[b][k] != CORNERS[a][k]) for a, b in zip(chain, chain[1:], strict=False)]


def volume_points(field: DataFrame, grid: Grid) -> DataFrame:
    """(t, i, j, tet, x, y, z, type): critical points; u, v, w are along j, i, t.

    The type is from the cubic of the Jacobian's eigenvalues: its discriminant tells complex ones (unstable), Routh's
    scheme the number of negative real parts.
    """
    found = with_zero(tetrahedra(field, grid))
    total = F.col("m0") + F.col("m1") + F.col("m2") + F.col("m3")
    # where all determinants are 0 there is no single place: a quarter each
    mu = [F.when(total == 0, 0.25).otherwise(F.col(f"m{k}").cast("double") / F.when(total == 0, 1.0).otherwise(total.cast("double"))) for k in range(4)]
    steps = {x: [(F.col(x + b) - F.col(x + a)).cast("double") for a, b in zip(VERTICES, VERTICES[1:], strict=False)] for x in "uvw"}
    cells: dict[str, Column] = {}
    for axis, name in ((2, "x"), (1, "y"), (0, "z")):
        for c in "uvw":
            d = F.lit(None).cast("double")
            for k in range(6):
                d = F.when(F.col("tet") == k, steps[c][_axes(k).index(axis)]).otherwise(d)
            cells[c + name] = d
        place = F.lit(None).cast("double")
        for k in range(6):
            n = _axes(k).index(axis)  # vertices after step n have moved along the axis
            place = F.when(F.col("tet") == k, sum((mu[m] for m in range(n + 2, 4)), mu[n + 1])).otherwise(place)
        cells[name] = F.col({"x": "j", "y": "i", "z": "t"}[name]) + place
    j = found.withColumns(cells)
    r = [tuple(F.col(c + n) for n in "xyz") for c in "uvw"]
    minors = sum((r[a][a] * r[b][b] - r[a][b] * r[b][a] for a, b in ((0, 2), (1, 2))), r[0][0] * r[1][1] - r[0][1] * r[1][0])
    poly = j.withColumns({"a2": -(r[0][0] + r[1][1] + r[2][2]), "a1": minors, "a0": -det3(*r)})
    a2, a1, a0 = F.col("a2"), F.col("a1"), F.col("a0")
    q, s = (3.0 * a1 - a2 * a2) / 9.0, (9.0 * a2 * a1 - 27.0 * a0 - 2.0 * a2 * a2 * a2) / 54.0
    poly = poly.withColumn("disc", q * q * q + s * s)
    sg = lambda x: F.when(x > 0, 1).otherwise(-1)
    col = [F.lit(1), sg(a2), sg(F.when(a2 == 0, -a0).otherwise((a2 * a1 - a0) / F.when(a2 == 0, 1.0).otherwise(a2))), sg(a0)]
    changes = sum(((x != y).cast("int") for x, y in zip(col[1:], col[2:], strict=False)), (col[0] != col[1]).cast("int"))
    negative = 3 - changes
    kind = F.when((F.col("disc") == 0) | (a0 == 0), 0).otherwise(2 * negative + F.when(F.col("disc") > 0, 2).otherwise(1))
    return poly.select("t", "i", "j", "tet", "x", "y", "z", kind.alias("type"))


def _spread(x: tuple[Column, ...], y: tuple[Column, ...]) -> Column:
    return F.abs(x[1] * y[2] - x[2] * y[1]) + F.abs(x[0] * y[2] - x[2] * y[0]) + F.abs(x[0] * y[1] - x[1] * y[0])


def tetrahedron_bound(kind: str = "long") -> Column:
    """How far vertex d may move, in each component, with no determinant's sign changed, in whole units: of columns ua .. wd.

    If all four vertices agree in the sign of a component, d may move by its largest such magnitude.
    0 for flat tetrahedra.  kind "decimal(10,0)" is for more than NBITS bits: up to 30, as every product then has at most 38 digits.
    """
    p = [tuple(x.cast(kind) for x in v) for v in _vectors()] if kind != "long" else _vectors()
    m = weights(p)
    total = m[0] + m[1] + m[2] + m[3]
    same = F.lit(0).cast("long")
    for k in range(3):
        c = [x[k] for x in p]
        one = F.lit(True)
        for x in c:
            one = one & (x > 0)
        other = F.lit(True)
        for x in c:
            other = other & (x < 0)
        same = F.greatest(same, F.when(one | other, F.abs(c[3])).otherwise(0).cast("long"))
    div = lambda x, y: F.call_function("div", F.abs(x), F.greatest(y, F.lit(1).cast(kind)))

    a, b, c, _ = p
    edge = lambda x, y: tuple(q - r for q, r in zip(x, y, strict=True))
    pairs = [_spread(b, c), _spread(a, c), _spread(a, b)]
    eb = F.least(div(total, _spread(edge(b, a), edge(c, a))), *(div(x, y) for x, y in zip(m[:3], pairs, strict=True)))
    flat = (total == 0) | ((same == 0) & ((pairs[0] == 0) | (pairs[1] == 0) | (pairs[2] == 0)))
    return F.when(flat, F.lit(0).cast("long")).when(same > 0, same).otherwise(eb)


def incident_index(tets: DataFrame) -> DataFrame:
    """(pid, tets array of (tid, pos)) of an unstructured mesh (tid, pos, pid); a point's list is as long as its tetrahedra."""
    return tets.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("tid", "pos"))).alias("tets"))


def unstructured(tets: DataFrame, data: DataFrame) -> DataFrame:
    """(tid, a .. d, ua .. wd) of tets (tid, pos 0 to 3, pid) and data (pid, u, v, w): one join on pid and a pivot by position.

    tets is counted first, so it should be a table: tasks are as many as bound the rows of each.
    """
    n = max(tets.sparkSession.sparkContext.defaultParallelism, -(-tets.count() // ROWS))
    both = tets.repartition(n, "pid").join(data, "pid")
    at = lambda c, k: F.max(F.when(F.col("pos") == k, F.col(c)))
    cols = [at("pid", k).alias(n) for k, n in enumerate(VERTICES)] + [at(x, k).alias(x + n) for k, n in enumerate(VERTICES) for x in "uvw"]
    return both.repartition(n, "tid").groupBy("tid").agg(*cols)


def vertex_bounds(tets: DataFrame, most: int) -> DataFrame:
    """(pid, required_eb): how far each vertex of tetrahedra (a .. d, ua .. wd) alone may move with all their determinants' signs unchanged.

    At most ``most``; 0 where one of its tetrahedra holds a zero.  Of grids and unstructured meshes alike.
    """
    v = dict(zip(VERTICES, _vectors(), strict=True))
    edge = lambda x, y: tuple(q - r for q, r in zip(v[x], v[y], strict=True))
    # what several vertices' bounds need is a column each: of every two vertices, of every three, and signs that all four share
    made = {f"s{x}{y}": _spread(v[x], v[y]) for x, y in combinations(VERTICES, 2)}
    made |= {f"area{x}{y}{z}": _spread(edge(y, x), edge(z, x)) for x, y, z in combinations(VERTICES, 3)}
    for c in "uvw":
        signs = [F.col(c + n) for n in VERTICES]
        made["one" + c] = reduce(Column.__and__, (x > 0 for x in signs)) | reduce(Column.__and__, (x < 0 for x in signs))
    rows = _weighed(tets.select(*VERTICES, *(x + n for n in VERTICES for x in "uvw")))
    rows = rows.withColumn("zero", _holds_zero()).withColumns({**made, "total": F.col("m0") + F.col("m1") + F.col("m2") + F.col("m3")})
    div = lambda x, y: F.call_function("div", F.abs(x), F.greatest(F.col(y), F.lit(1).cast("long")))
    none, bounds, agree = F.lit(0).cast("long"), {}, {}
    for me in VERTICES:
        rest = [n for n in VERTICES if n != me]
        pairs = {x: "s" + "".join(n for n in rest if n != x) for x in rest}
        agree["same" + me] = F.greatest(*(F.when(F.col("one" + c), F.abs(c + me)).otherwise(none) for c in "uvw"))
        least = F.least(div(F.col("total"), "area" + "".join(rest)), *(div(F.col(f"m{VERTICES.index(x)}"), pairs[x]) for x in rest))
        flat = reduce(Column.__or__, (F.col(y) == 0 for y in pairs.values()))
        bounds["eb" + me] = F.when(F.col("zero") | (F.col("total") == 0), none).when(F.col("same" + me) > 0, F.col("same" + me)).when(flat, none).otherwise(least)
    rows = rows.withColumns(agree).withColumns(bounds)
    per = rows.select(F.explode(F.array(*(F.struct(F.col(me).alias("pid"), F.col("eb" + me).alias("eb")) for me in VERTICES))).alias("r")).select("r.*")
    return per.groupBy("pid").agg(F.least(F.min("eb"), F.lit(most).cast("long")).alias("required_eb"))


def relative_rows(tets: DataFrame, factor: float = 1.0) -> DataFrame:
    """tets with the columns that functions.relative needs of tetrahedra: u0 .. w3 (values over ``factor``) and tetrahedron_columns()."""
    from ..functions import relative

    named = {f"{x}{k}": F.col(x + n).cast("double") / F.lit(float(factor)) for k, n in enumerate(VERTICES) for x in "uvw"}
    return tets.withColumns(named).withColumns({c: F.expr(e) for c, e in relative.tetrahedron_columns().items()})


def relative_vertex_bounds(tets: DataFrame) -> DataFrame:
    """(pid, share): by how large a share all vertices may move at once with no tetrahedron's verdict changed; of grids and unstructured meshes."""
    from ..functions import relative

    rows = relative_rows(tets).select(F.explode(F.array(*VERTICES)).alias("pid"), F.expr(relative.tetrahedron_offline_bound()).alias("share"))
    return rows.groupBy("pid").agg(F.least(F.min("share"), F.lit(1.0)).alias("share"))


def real_zeros(tets: DataFrame) -> DataFrame:
    """Tetrahedra of real values whose four determinants have one sign."""
    m = [F.col(f"m{k}") for k in range(4)]
    return relative_rows(tets).filter(((m[0] > 0) & (m[1] > 0) & (m[2] > 0) & (m[3] > 0)) | ((m[0] < 0) & (m[1] < 0) & (m[2] < 0) & (m[3] < 0)))


def encode_points(tets: DataFrame, data: DataFrame, share: float) -> tuple[DataFrame, Grid]:
    """(blocks, a grid of one row): the points of an unstructured mesh, tets (tid, pos, pid) and data (pid from 0, u, v, w), in order of pid.

    Every value is kept to ``share`` of itself, and to what keeps the verdicts of all tetrahedra if all vertices move at once; points
    without a tetrahedron only to ``share``.  decode_points() undoes it.
    """
    from ..plans import codec

    grid = Grid(1, data.count(), 1)
    bounds = relative_vertex_bounds(unstructured(tets, data))
    rows = data.join(bounds, "pid", "left").withColumn("share", F.coalesce("share", F.lit(1.0)))
    rows = rows.select(F.lit(0).alias("t"), F.lit(0).alias("i"), F.col("pid").cast("int").alias("j"), "u", "v", "w", codec.relative_limit(F.col("share")).alias("limit"))
    return codec.encode_relative(rows, grid, share, "lorenzo2d", (1, 1, 1024), cols="uvw", limit="limit")[0], grid


def decode_points(blocks: DataFrame, grid: Grid) -> DataFrame:
    """(pid, u, v, w) of encode_points()."""
    from ..plans import codec

    return codec.decode(blocks, grid, codec.LOG_SCALE, "lorenzo2d", (1, 1, 1024), cols="uvw", log=True, kind="double").select(F.col("j").cast("long").alias("pid"), "u", "v", "w")
