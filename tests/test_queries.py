"""Every query that has SQL gives the rows of its SQL; the others run."""

import pytest
from support import SF, spark_rows

from swirlframe import queries as q

#: Held against their SQL by the driver, and in a smaller form by other tests.
LONG = {"roundtrip_lorenzo2d", "roundtrip_time_linear", "roundtrip_stride2", "roundtrip_dt2d", "roundtrip_ar2_clamped", "roundtrip_mixed_order", "roundtrip_lorenzo_ar2", "smooth_typed", "smooth_tried", "smooth_types_kept", "smooth_warped", "smooth_mixed_order", "smooth_plane", "smooth_lorenzo_ar2", "smooth_symmetric", "relative_bilinear", "relative_offline_typed", "wavefront_lorenzo3d", "wavefront_mixed_order"}


def test_bilinear_guard(spark):
    """Zeros of bilinear cells, and their types, stay as they are; most vertices are coded."""
    from swirlframe.grid import Grid, swirl_field
    from swirlframe.operators import critical
    from swirlframe.plans import codec

    g = Grid(9, 10, 3)
    field = swirl_field(spark, g, "focus")
    blocks, s = codec.encode_relative(field, g, 0.05, "lorenzo2d", (2, 9, 5), guard="bilinear")
    assert codec.statistics(blocks).first().lossless_share < 0.6
    back = codec.decode(blocks, g, s, "lorenzo2d", (2, 9, 5), log=True, kind="double")
    assert back.join(field.withColumnsRenamed({"u": "x", "v": "y"}), ["t", "i", "j"]).filter("abs(u - x) > 0.05 * abs(x) or abs(v - y) > 0.05 * abs(y)").count() == 0
    found = [sorted((r.t, r.i, r.j, r.type) for r in critical.bilinear_points(f.select("t", "i", "j", "u", "v"), g).collect()) for f in (field, back)]
    assert found[0] == found[1] and len(found[0]) == 3


def test_huffman_size_by_hand(spark):
    import heapq

    from swirlframe.operators import coding

    counts = [r.n for r in coding.frequencies(q._symbols(spark, SF)).collect()]
    heap, total = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    assert q.QUERIES["huffman_size"](spark, SF).first()[0] == total


def test_ranked_paths(spark):
    """One long chain in a shuffled order of names, short ones, nodes alone, and loops; and more rounds than are allowed."""
    import random

    from swirlframe.operators.critical import ranked_paths

    rng = random.Random(3)
    names = rng.sample(range(10**6), 3000)
    chains = [names[:2500], names[2500:2501], names[2501:2503], names[2503:2800], *([n] for n in names[2800:])]
    links = [tuple(sorted(p)) for c in chains for p in zip(c, c[1:], strict=False)]
    rng.shuffle(links)
    frame = spark.createDataFrame(links, "x long, y long")
    got = ranked_paths(frame, spark.createDataFrame([(n,) for n in names], "node long"), 14)
    want = set()
    for c in chains:
        c = c if c[0] <= c[-1] else c[::-1]
        want |= {(n, c[0], k, min(c)) for k, n in enumerate(c)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == 3000
    rings = [rng.sample(range(10**6), n) for n in (3, 4, 64, 100)]
    links = [tuple(sorted(p)) for c in rings for p in zip(c, c[1:] + c[:1], strict=True)] + [(-2, -1)]
    got = ranked_paths(spark.createDataFrame(links, "x long, y long"), spark.createDataFrame([(n,) for c in [*rings, [-1, -2]] for n in c], "node long"))
    want = {(-2, -2, 0, -2), (-1, -2, 1, -2)}
    for c in rings:
        at = c.index(min(c))
        c = c[at:] + c[:at]
        c = c if c[1] < c[-1] else [c[0], *c[:0:-1]]
        want |= {(n, c[0], k, c[0]) for k, n in enumerate(c)}
    assert {tuple(r) for r in got.collect()} == want
    with pytest.raises(RuntimeError):
        ranked_paths(frame, spark.createDataFrame([(1,)], "node long"), 4)


def test_a_loop_in_order(spark):
    """A loop begins with its smallest face and goes on to the smaller one of its neighbours; a face with three links is alone."""
    from unittest.mock import patch

    from swirlframe.operators import critical

    loop = [5, 9, 7, 30, 12, 6]
    star = [(40, 41), (40, 42), (40, 43), (43, 44)]
    links = [tuple(sorted((a, b))) for a, b in zip(loop, loop[1:] + loop[:1], strict=True)] + star
    faces = spark.createDataFrame([(f, 0.0, 0.0, 0.0) for f in [*loop, 40, 41, 42, 43, 44, 50]], "face long, x double, y double, t double")
    comp = spark.createDataFrame([(f, 5) for f in loop] + [(f, 40) for f in range(40, 45)] + [(50, 50)], "face long, component long")
    none = spark.createDataFrame([], "t int, i int, j int, tmpl int, a long, b long, c long, ua long, va long, ub long, vb long, uc long, vc long")
    with patch.object(critical, "zero_components", lambda *a: comp), patch.object(critical, "zero_graph", lambda *a: spark.createDataFrame(links, "x long, y long")), patch.object(critical, "zero_samples", lambda *a: faces):
        got = {(r.strand, r.place): r.face for r in critical.ordered_curves(none, None).collect()}
    assert [got[5, k] for k in range(6)] == [5, 6, 12, 30, 7, 9]
    assert {k: v for k, v in got.items() if k[0] >= 40} == {(40, 0): 40, (41, 0): 41, (42, 0): 42, (43, 0): 43, (43, 1): 44, (50, 0): 50}


def test_ordered_curves(spark):
    """Samples in order: each face follows one that it is linked with, or begins a new stretch where no neighbour is left."""
    from swirlframe.operators import critical

    zero, g = q._swirl(spark)[0], q.SWIRL
    from swirlframe.operators import mesh

    zero = mesh.zero_faces(zero, g)
    links = {frozenset(r) for r in critical.zero_graph(zero, g).collect()}
    rows = critical.ordered_curves(zero, g).orderBy("component", "place").collect()
    assert sorted(r.face for r in rows) == sorted(r[0] for r in critical.zero_components(zero, g).select("face").collect())
    assert all(frozenset((a.face, b.face)) in links for a, b in zip(rows, rows[1:], strict=False) if a.component == b.component)
    w = critical.speed(critical.ordered_curves(zero, g)).orderBy("component", "place").collect()
    assert all(abs(b.step - ((b.x - a.x) ** 2 + (b.y - a.y) ** 2) ** 0.5) < 1e-12 for a, b in zip(w, w[1:], strict=False) if a.component == b.component)


@pytest.mark.parametrize("name", [n for n in q.QUERIES if n not in LONG])
def test_query(spark, duck, name):
    cols, rows = spark_rows(q.QUERIES[name](spark, SF))
    assert rows
    if name in q.SQL:
        assert (cols, rows) == duck(q.SQL[name])


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(q.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_codec_statistics_count_the_table(spark):
    from swirlframe.grid import Grid, fixed_scale, swirl_field, view_grid
    from swirlframe.plans import codec

    got = q.QUERIES["codec_statistics"](spark, SF).first()
    g = view_grid(spark, SF)
    assert got.n == g.size and 0 <= got.n_lossless <= got.n and got.bytes > 0
    g = Grid(25, 32, 10)
    field = swirl_field(spark, g, "focus")
    s = fixed_scale(field)
    analytic = codec.statistics(codec.encode(field, g, s, codec.bound_for(s, q.EB))).first()
    assert analytic.n == g.size and analytic.max_err <= codec.bound_for(s, q.EB) and analytic.ratio > got.ratio
