import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from swirlframe.grid import Grid, bits_above, fixed_scale, neighbours, swirl_field, to_fixed
from swirlframe.operators import critical, mesh, verify
from swirlframe.plans import kernels


def test_templates_are_the_chains_of_a_cube():
    corners = list(itertools.product((0, 1), repeat=3))
    below = lambda a, b: a != b and all(x <= y for x, y in zip(a, b, strict=True))
    chains = {(0, 4 * a[0] + 2 * a[1] + a[2], 4 * b[0] + 2 * b[1] + b[2]) for a in corners for b in corners if below((0, 0, 0), a) and below(a, b)}
    assert {c for _, _, c in mesh.FACES} == chains and len(chains) == 12
    assert len({tuple(sorted(map(str, (a, b)))) for _, a, b in mesh.incident_templates()}) == 36


def test_faces_of_one_cube(spark):
    g = Grid(2, 2, 2)
    assert sum(mesh.split_by_template(g).values()) == 18
    f = to_fixed(swirl_field(spark, g), fixed_scale(swirl_field(spark, g)))
    assert mesh.faces(f, g).count() == 18
    got = {r.tmpl: r.n for r in verify.face_census(f, g).collect()}
    assert got == {k: n for k, n in mesh.split_by_template(g).items() if n}


@pytest.mark.parametrize("shape", [(1, 5, 3), (5, 1, 2), (1, 1, 1), (3, 4, 1)])
def test_degenerate_grids(spark, shape):
    g = Grid(*shape)
    f = to_fixed(swirl_field(spark, g), fixed_scale(swirl_field(spark, g)))
    assert mesh.faces(f, g).count() == sum(mesh.split_by_template(g).values())
    assert verify.quality(f, "u", "u").first().psnr == float("inf")


def test_neighbours(spark):
    g = Grid(3, 4, 2)
    f = swirl_field(spark, g).select("t", "i", "j", g.vid().alias("u"))
    offsets = [(0, 0, 1), (0, 0, -1), (1, 0, 0), (-1, 1, -2), (0, 2, 3), (0, 0, 9)]
    for r in neighbours(f, ["u"], offsets).collect():
        for k, (a, b, c) in enumerate(offsets):
            t, i, j = r.t + a, r.i + b, r.j + c
            inside = 0 <= t < 2 and 0 <= i < 3 and 0 <= j < 4
            assert r[f"u_{k}"] == (t * 12 + i * 4 + j if inside else None)


@pytest.mark.parametrize("kind, number", [("repelling", 2), ("attracting", 1), ("saddle", 3), ("center", 6), ("focus", 5)])
def test_known_points(spark, kind, number):
    g = Grid(9, 11, 3)
    field = swirl_field(spark, g, kind)
    rows = critical.layer_points(to_fixed(field, fixed_scale(field)), g).orderBy("t").collect()
    assert [r.type for r in rows] == [number] * 3
    for r in rows:
        assert abs(r.x - (3.125 + 0.25 * r.t)) < 1e-6 and abs(r.y - (4.25 + 0.125 * r.t)) < 1e-6


def test_trajectory_is_one_curve_and_tetrahedra_have_two_or_none(spark):
    g = Grid(9, 11, 6)
    field = swirl_field(spark, g, "focus")
    p = to_fixed(field, fixed_scale(field))
    assert {r.hits for r in mesh.tetrahedron_hits(p, g).collect()} == {0, 2}
    zero = mesh.zero_faces(p, g)
    c = critical.curves(zero, g).collect()
    assert len(c) == 1 and not c[0].is_loop and c[0].n_faces == zero.count()
    order = critical.ordered_curves(zero, g).orderBy("place").collect()
    steps = [abs(b.t - a.t) + abs(b.x - a.x) + abs(b.y - a.y) for a, b in zip(order, order[1:], strict=False)]
    assert max(steps) < 1.5 and [r.place for r in order] == list(range(len(order)))


def test_recorded_faces(spark):
    from swirlframe.queries import QUERIES

    assert {r.name: r.zero for r in QUERIES["recorded_faces"](spark, "").collect()} == {"A original": False, "A decoded": True, "B original": False, "B decoded": True}


big = st.integers(-(2**30), 2**30)


@settings(max_examples=150, deadline=None)
@given(st.lists(big, min_size=6, max_size=6))
def test_bound_keeps_the_verdict(v):
    a = [np.array([x], np.int64) for x in v]
    eb = int(kernels.strict_bound(*a)[0])
    was = bool(kernels.has_zero(*a)[0])
    for du in (-eb, 0, eb):
        for dv in (-eb, 0, eb):
            assert bool(kernels.has_zero(*a[:4], a[4] + du, a[5] + dv)[0]) == was


def test_ties_agree_in_kernel_and_columns(spark):
    from pyspark.sql import functions as F

    from swirlframe.functions.triangles import has_zero

    rows = list(itertools.product((-1, 0, 1), repeat=6))
    df = spark.createDataFrame(rows, "ua long, va long, ub long, vb long, uc long, vc long")
    got = {tuple(r[:6]): r.z for r in df.withColumn("z", has_zero(*(F.col(c) for c in df.columns))).collect()}
    arr = np.array(rows, np.int64).T
    assert [got[r] for r in rows] == kernels.has_zero(*arr).tolist()


def test_scale():
    assert [bits_above(x) for x in (0.0, 0.5, 0.500001, 1.0, 2.0, 3.0, 2.0**40)] == [0, -1, 0, 0, 1, 2, 40]


def test_bilinear_points(spark):
    g = Grid(6, 7, 2)
    field = swirl_field(spark, g, "focus")
    rows = critical.bilinear_points(to_fixed(field, fixed_scale(field)), g).orderBy("t").collect()
    assert len(rows) == 2
    for r in rows:  # a linear field is bilinear too
        assert r.type == 5 and abs(r.x - (1.125 + 0.25 * r.t)) < 1e-6 and abs(r.y - (2.75 + 0.125 * r.t)) < 1e-6


def test_bilinear_cells_with_two_zeros(spark):
    """u = x - y, v = x * x-like: (x - 0.25) * (y - 0.75) + 0.0x has two zeros on the diagonal of the cell."""
    from swirlframe.grid import neighbours  # noqa: F401

    f = lambda x, y: (x - y, x * y - 0.5 * (x + y) + 0.1875)  # noqa: E731  on x = y: (x - 0.25) * (x - 0.75)
    rows = [(0, i, j, *f(float(j), float(i))) for i in (0, 1) for j in (0, 1)]
    field = spark.createDataFrame(rows, "t int, i int, j int, u double, v double")
    got = sorted((round(r.x, 9), round(r.y, 9)) for r in critical.bilinear_points(field, Grid(2, 2, 1)).collect())
    assert got == [(0.25, 0.25), (0.75, 0.75)]


def test_bilinear_cells_with_a_constant_side(spark):
    """Sides with equal corners, as decoding gives: a zero is where the other two corners and the side face each other, and nowhere else."""
    rng = random.Random(6)
    cells, want = [], {}
    # what relative_bilinear decoded two cells to, all of whose corners are on one side of a line
    cells.append([(-0.2301608591283948, 0.1834723600176604), (-0.1478986144065857, -0.08682018518447876), (-0.2301608591283948, 0.1834723600176604), (0.04086851328611374, 0.06357480585575104)])
    cells.append([(-0.06885365488843005, -0.14262059286424034), (-0.09226844805673692, -0.03775041758806529), (-0.06885365488843005, -0.10084798835115007), (-0.09226844805673692, -0.21354861015315904)])
    want = {0: 0, 1: 0}
    for side in ((0, 1), (2, 3), (0, 2), (1, 3)):
        for _ in range(50):
            cell = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(4)]
            cell[side[1]] = c = cell[side[0]]
            a, b = (cell[k] for k in range(4) if k not in side)
            ca, cb = a[0] * c[1] - a[1] * c[0], b[0] * c[1] - b[1] * c[0]
            s = ca / (ca - cb)  # where the opposite side is parallel to c
            want[len(cells)] = int(0 <= s < 1 and sum(((1 - s) * x + s * y) * z for x, y, z in zip(a, b, c, strict=True)) < 0)
            cells.append(cell)
    rows = [(t, k // 2, k % 2, *c) for t, cell in enumerate(cells) for k, c in enumerate(cell)]
    field = spark.createDataFrame(rows, "t int, i int, j int, u double, v double")
    got = critical.bilinear_points(field, Grid(2, 2, len(cells))).collect()
    assert {t: sum(r.t == t for r in got) for t in want} == want and 20 < sum(want.values()) < 150
    for r in got:
        x, y = r.x, r.y
        w = [(1 - x) * (1 - y), x * (1 - y), (1 - x) * y, x * y]
        assert all(abs(sum(z * c[k] for z, c in zip(w, cells[r.t], strict=True))) < 1e-9 for k in (0, 1))


def test_zeros_on_sides_of_tetrahedra(spark):
    """A linear field of whole numbers whose zero is a vertex, on an edge, on a side or within: one tetrahedron has it, wherever it is."""
    from swirlframe.operators import volume

    for zero in ((1, 1, 1), (2, 1, 1), (3, 1, 1), (3, 3, 1), (3, 3, 3), (3, 2, 1), (2, 2, 2)):
        rows = [(t, i, j, 2 * j - zero[2], 2 * i - zero[1], 2 * t - zero[0]) for t in range(4) for i in range(4) for j in range(4)]
        field = spark.createDataFrame(rows, "t int, i int, j int, u long, v long, w long")
        assert volume.with_zero(volume.tetrahedra(field, Grid(4, 4, 4))).count() == 1, zero
        points = volume.volume_points(field, Grid(4, 4, 4)).collect()
        assert [(round(2 * p.z, 9), round(2 * p.y, 9), round(2 * p.x, 9)) for p in points] == [zero]


@pytest.mark.parametrize("move, cells", [(0.5, None), (9.0, None), (9.0, 2.0)])
def test_advection_is_the_same_over_any_tiles(spark, move, cells):
    """Short moves stay in the halo of a tile; long ones go from tile to tile, in one step or many; a frame without one before has no row."""
    from swirlframe.operators import predict

    g = Grid(11, 14, 3)
    scale = fixed_scale(swirl_field(spark, g))
    f = to_fixed(swirl_field(spark, g), scale)
    whole, tiles = (sorted(map(tuple, predict.advected(f, g, scale.factor, move, move, cells=cells, tile=size).collect())) for size in (64, 3))
    assert whole == tiles and len(whole) == 2 * 11 * 14
    assert predict.advected(f.filter("t = 0"), g, scale.factor, move, move, cells=cells, tile=3).count() == 0


def test_bilinear_stages(spark):
    """Zeros in stages are those of bilinear_zero(), to the bit, and no expression holds others many times; ties and degenerate cells included."""
    from swirlframe.functions import triangles

    rng = random.Random(5)
    some = [[rng.choice([-2.0, -1.0, 0.0, 1.0, 3.0]) for _ in range(8)] for _ in range(300)] + [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(300)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(some)], "id int, " + ", ".join(f"{c}{k} double" for c in "uv" for k in range(4)))
    u, v = (tuple(F.col(f"{c}{k}") for k in range(4)) for c in "uv")
    want = df.select("*", F.explode(triangles.bilinear_zero(u, v)).alias("z")).select("id", "z.x", "z.y", triangles.bilinear_type(u, v, F.col("z.x"), F.col("z.y")).alias("type"))
    got = df
    for cols, keep in triangles.bilinear_stages():
        assert all(len(str(e)) < 400 for e in cols.values())
        got = got.withColumns(cols)
        got = got if keep is None else got.filter(keep)
    rows = sorted(map(tuple, got.select("id", "_x", "_y", "_type").collect()))
    assert rows == sorted(map(tuple, want.collect())) and len(rows) > 100


def test_unstructured_meshes_of_any_size(spark, monkeypatch):
    """Tasks grow in number with a mesh, not in rows."""
    from swirlframe.operators import volume

    tets = spark.range(4000).selectExpr("id div 4 tid", "cast(id % 4 as int) pos", "id div 4 + id % 4 pid")
    data = spark.range(1003).selectExpr("id pid", "id * 2 u", "id * 3 v", "-id w")
    monkeypatch.setattr(volume, "ROWS", 100)
    made = volume.unstructured(tets, data)
    assert made.rdd.getNumPartitions() == 40
    assert sorted((r.tid, r.a, r.ub, r.wd) for r in made.collect()) == [(k, k, 2 * (k + 1), -(k + 3)) for k in range(1000)]


def test_vertex_bounds_by_roles(spark):
    """The bounds of a tetrahedron's four vertices are tetrahedron_bound() with each of them put last."""
    from swirlframe.operators import volume

    rng = random.Random(3)
    tets = [[k, *(4 * k + m for m in range(4)), *(rng.choice([-5, -1, 0, 1, 2, 7]) if k % 2 else rng.randint(-400_000, 400_000) for _ in range(12))] for k in range(300)]
    df = spark.createDataFrame(tets, "tid long, a long, b long, c long, d long, " + ", ".join(f"{x}{n} long" for n in "abcd" for x in "uvw"))
    want = []
    zero = {r.tid for r in volume.with_zero(df).select("tid").collect()}
    for me in "abcd":
        order = [n for n in "abcd" if n != me] + [me]
        turned = df.select("tid", F.col(me).alias("pid"), *(F.col(x + old).alias(x + new) for new, old in zip("abcd", order, strict=True) for x in "uvw"))
        want += [(r.pid, 0 if r.tid in zero else min(r.eb, 1 << 17)) for r in turned.select("tid", "pid", volume.tetrahedron_bound().alias("eb")).collect()]
    assert sorted(map(tuple, volume.vertex_bounds(df, 1 << 17).select("pid", "required_eb").collect())) == sorted(want)
