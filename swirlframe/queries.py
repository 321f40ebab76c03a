"""The registered queries over vector fields, and SQL that gives their rows.

Most run over the field view of the embeddings table (grid.field_view()), some over events
or an analytic field.  SQL follows the definitions, by joins on vertices.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import relative
from .functions import scalars as S
from .grid import Grid, Scale, field_view, fixed_scale, smooth_view, swirl_field, to_fixed, view_grid
from .operators import coding, critical, mesh, predict, verify
from .plans import codec, wavefront
from .plans.checkpoints import cut, scratch, written
from .plans.streams import Shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EB = 0.01  # absolute error bound of the coding queries
SWIRL = Grid(12, 16, 8)


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def fixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid, Scale]:
    field = field_view(spark, sf_dir)
    scale = fixed_scale(field)
    return to_fixed(field, scale), view_grid(spark, sf_dir), scale


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# --- SQL pieces ---------------------------------------------------------------------------------------

FIELD = """
    nf AS (SELECT count(*) // 25 AS nt FROM embeddings),
    f AS (SELECT (vec_id // 25)::INT AS t, (vec_id % 25)::INT AS i, k::INT AS j, embedding[2 * k + 1] AS u, embedding[2 * k + 2] AS v
          FROM embeddings, range(32) r(k), nf WHERE vec_id // 25 < nt),
    sc AS (SELECT max(greatest(abs(u), abs(v)))::DOUBLE AS max_abs, (30 - ceil(log2(max(greatest(abs(u), abs(v))))))::INT AS shift FROM f),
    p AS (SELECT t, i, j, (t * 800 + i * 32 + j)::BIGINT AS vid, trunc(u::DOUBLE * (1::BIGINT << shift))::BIGINT AS u, trunc(v::DOUBLE * (1::BIGINT << shift))::BIGINT AS v FROM f, sc)"""


def _swirl_sql(h: int, w: int, t: int) -> str:
    ci, cj = (h - 1) / 2 + 0.25, (w - 1) / 2 - 2.0 + 0.125
    return f"""
    g AS (SELECT (k // {h * w})::INT AS t, (k // {w} % {h})::INT AS i, (k % {w})::INT AS j FROM range({h * w * t}) r(k)),
    f0 AS (SELECT t, i, j, j - ({cj}::DOUBLE + t * 0.25::DOUBLE) AS x, i - ({ci}::DOUBLE + t * 0.125::DOUBLE) AS y FROM g),
    f AS (SELECT t, i, j, x * 0.25::DOUBLE - y AS u, x + y * 0.25::DOUBLE AS v FROM f0),
    sc AS (SELECT (30 - ceil(log2(max(greatest(abs(u), abs(v))))))::INT AS shift FROM f),
    p AS (SELECT t, i, j, (t * {h * w} + i * {w} + j)::BIGINT AS vid, trunc(u * (1::BIGINT << shift))::BIGINT AS u, trunc(v * (1::BIGINT << shift))::BIGINT AS v FROM f, sc)"""


def _faces_sql(templates=mesh.FACES, extra: str = "") -> str:
    rows = ", ".join(f"({n}, '{cls}', {', '.join(str(x) for c in corners for x in mesh.CORNERS[c])})" for n, cls, corners in templates)
    more = "".join(f", {p}.{x} AS {x}{n}" for x in extra.split() for p, n in (("pa", "a"), ("pb", "b"), ("pc", "c")))
    return f"""
    tm(tmpl, cls, a_t, a_i, a_j, b_t, b_i, b_j, c_t, c_i, c_j) AS (VALUES {rows}),
    fa AS (SELECT o.t, o.i, o.j, o.vid, tmpl, cls, pa.vid AS a, pb.vid AS b, pc.vid AS c, pa.u AS ua, pa.v AS va, pb.u AS ub, pb.v AS vb, pc.u AS uc, pc.v AS vc{more}
           FROM p o CROSS JOIN tm JOIN p pa ON pa.t = o.t + a_t AND pa.i = o.i + a_i AND pa.j = o.j + a_j
           JOIN p pb ON pb.t = o.t + b_t AND pb.i = o.i + b_i AND pb.j = o.j + b_j JOIN p pc ON pc.t = o.t + c_t AND pc.i = o.i + c_i AND pc.j = o.j + c_j)"""


def _turn(xj: str, yj: str, xk: str, yk: str) -> str:
    terms = (f"{xj} * {yk} - {xk} * {yj}", f"{xk} - {xj}", f"{yj} - {yk}", f"-{xk}")
    return "CASE " + " ".join(f"WHEN {x} > 0 THEN 1 WHEN {x} < 0 THEN -1" for x in terms) + " ELSE 1 END"


def _zero_sql(u: str = "u", v: str = "v") -> str:
    """Every turn around the origin has one sense; ties are decided by the order of vertices."""
    a, p, b, q, c, r = f"{u}a", f"{v}a", f"{u}b", f"{v}b", f"{u}c", f"{v}c"
    return f"(({_turn(a, p, b, q)}) = ({_turn(b, q, c, r)}) AND ({_turn(a, p, b, q)}) = -({_turn(a, p, c, r)}))"


ZERO = _zero_sql()
FACES_SQL = FIELD + "," + _faces_sql()
LAYER_SQL = FIELD + "," + _faces_sql(mesh.FACES[:2])

TYPE_SQL = """
    jac AS (SELECT *, (CASE WHEN tmpl = 1 THEN uc - ub ELSE ub - ua END)::DOUBLE AS ux, (CASE WHEN tmpl = 1 THEN ub - ua ELSE uc - ub END)::DOUBLE AS uy,
              (CASE WHEN tmpl = 1 THEN vc - vb ELSE vb - va END)::DOUBLE AS vx, (CASE WHEN tmpl = 1 THEN vb - va ELSE vc - vb END)::DOUBLE AS vy FROM zf),
    td AS (SELECT *, ux + vy AS tr, ux * vy - uy * vx AS det FROM jac),
    ty AS (SELECT *, CASE WHEN tr * tr - 4.0::DOUBLE * det >= 0 THEN CASE WHEN det < 0 THEN 3 WHEN det = 0 THEN 0 WHEN tr < 0 THEN 1 ELSE 2 END
                     WHEN tr < 0 THEN 4 WHEN tr > 0 THEN 5 ELSE 6 END AS type FROM td)"""

POINTS_SQL = f"""{LAYER_SQL}, zf AS (SELECT * FROM fa WHERE {ZERO}), {TYPE_SQL},
    m AS (SELECT *, ub::DOUBLE * vc - uc::DOUBLE * vb AS m0, uc::DOUBLE * va - ua::DOUBLE * vc AS m1, ua::DOUBLE * vb - ub::DOUBLE * va AS m2 FROM ty),
    w AS (SELECT *, CASE WHEN m0 + m1 + m2 = 0 THEN 1.0::DOUBLE / 3 ELSE m1 / (m0 + m1 + m2) END AS w1, CASE WHEN m0 + m1 + m2 = 0 THEN 1.0::DOUBLE / 3 ELSE m2 / (m0 + m1 + m2) END AS w2 FROM m),
    pt AS (SELECT t, i, j, ((i * 31 + j) * 2 + tmpl - 1)::BIGINT AS simplex_id, round(j + CASE WHEN tmpl = 1 THEN w2 ELSE w1 + w2 END, 6) AS x,
             round(i + CASE WHEN tmpl = 1 THEN w1 + w2 ELSE w2 END, 6) AS y, type FROM w)"""


def _bound_sql(x: str, y: str, z: str) -> str:
    """How far vertex z may move, as SQL over face columns."""
    u0, v0, u1, v1, u2, v2 = (f"{c}{n}" for n in (x, y, z) for c in "uv")
    m0, m1, m2 = f"({u2} * {v0} - {u0} * {v2})", f"({u1} * {v2} - {u2} * {v1})", f"({u0} * {v1} - {u1} * {v0})"
    d, d0, d1 = f"(abs({u1} - {u0}) + abs({v1} - {v0}))", f"(abs({u0}) + abs({v0}))", f"(abs({u1}) + abs({v1}))"
    low = f"least(abs({m0} + {m1} + {m2}) // greatest({d}, 1), abs({m1}) // greatest({d1}, 1), abs({m0}) // greatest({d0}, 1))"
    same = lambda a, b, c: f"(sign({a}) <> 0 AND sign({a}) = sign({b}) AND sign({a}) = sign({c}))"
    su, sv = same(u0, u1, u2), same(v0, v1, v2)
    return f"CASE WHEN {m0} + {m1} + {m2} = 0 OR {d0} = 0 OR {d1} = 0 THEN 0 ELSE greatest({low}, CASE WHEN {su} THEN abs({u2}) ELSE 0 END, CASE WHEN {sv} THEN abs({v2}) ELSE 0 END) END"


def _vertex_sql(a: str, b: str, c: str) -> str:
    return f"""{FACES_SQL}, z AS (SELECT *, {ZERO} AS zero FROM fa),
    sides AS (SELECT a AS vid, CASE WHEN zero THEN 0 ELSE {a} END AS eb FROM z UNION ALL SELECT b, CASE WHEN zero THEN 0 ELSE {b} END FROM z UNION ALL SELECT c, CASE WHEN zero THEN 0 ELSE {c} END FROM z),
    vb AS (SELECT vid, least(min(eb), (SELECT trunc({EB} * (1::BIGINT << shift))::BIGINT FROM sc))::BIGINT AS required_eb FROM sides GROUP BY vid)"""


VERTEX_SQL = _vertex_sql(_bound_sql("b", "c", "a"), _bound_sql("a", "c", "b"), _bound_sql("a", "b", "c"))
_ANY = f"least({_bound_sql('a', 'b', 'c')}, {_bound_sql('c', 'b', 'a')}, {_bound_sql('a', 'c', 'b')})"

# --- values -------------------------------------------------------------------------------------------


@query(f"WITH {FIELD} SELECT t, i, j, u::DOUBLE AS u, v::DOUBLE AS v FROM f", "field_view")
def field_rows(spark, sf_dir):
    return field_view(spark, sf_dir).select("t", "i", "j", F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))


@query(f"WITH {FIELD} SELECT t, i, j, u AS ufp, v AS vfp FROM p")
def fixed_point(spark, sf_dir):
    p, _, _ = fixed(spark, sf_dir)
    return p.select("t", "i", "j", F.col("u").alias("ufp"), F.col("v").alias("vfp"))


@query(f"WITH {FIELD} SELECT max_abs, shift, min(least(u, v)) AS fp_min, max(greatest(u, v)) AS fp_max, max(greatest(u, v)) - min(least(u, v)) AS fp_range FROM p, sc GROUP BY 1, 2")
def fixed_point_range(spark, sf_dir):
    p, _, s = fixed(spark, sf_dir)
    low, high = F.min(F.least("u", "v")), F.max(F.greatest("u", "v"))
    return p.agg(F.lit(s.max_abs).alias("max_abs"), F.lit(s.shift).alias("shift"), low.alias("fp_min"), high.alias("fp_max"), (high - low).alias("fp_range"))


@query(f"WITH {FIELD} SELECT t, i, j, u::DOUBLE / (1::BIGINT << shift) AS u, v::DOUBLE / (1::BIGINT << shift) AS v FROM p, sc")
def fixed_to_float(spark, sf_dir):
    from .grid import to_float

    p, _, s = fixed(spark, sf_dir)
    return to_float(p, s, kind="double")


@query(f"WITH {FIELD} SELECT t, i, j, CASE WHEN abs(u) < 0.01 THEN 0 ELSE u::DOUBLE END AS u, CASE WHEN abs(v) < 0.01 THEN 0 ELSE v::DOUBLE END AS v FROM (SELECT t, i, j, u::DOUBLE AS u, v::DOUBLE AS v FROM f)")
def zero_small(spark, sf_dir):
    f = field_view(spark, sf_dir)
    return f.select("t", "i", "j", S.zero_small(F.col("u").cast("double"), 0.01).alias("u"), S.zero_small(F.col("v").cast("double"), 0.01).alias("v"))


@query(f"WITH {FIELD} SELECT t, i, j, round(sqrt(u::DOUBLE * u::DOUBLE + v::DOUBLE * v::DOUBLE), 9) AS mag FROM f")
def magnitude(spark, sf_dir):
    return field_view(spark, sf_dir).select("t", "i", "j", F.round(S.magnitude(F.col("u"), F.col("v")), 9).alias("mag"))


@query(f"WITH {FIELD} SELECT min(u)::DOUBLE AS min_u, max(u)::DOUBLE AS max_u, min(v)::DOUBLE AS min_v, max(v)::DOUBLE AS max_v FROM f")
def component_stats(spark, sf_dir):
    f = field_view(spark, sf_dir)
    return verify.component_stats(f.select(F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v")))


@query(f"WITH {FIELD}, m AS (SELECT avg(u::DOUBLE) AS mu, avg(v::DOUBLE) AS mv FROM f) SELECT t, i, j, round(u - mu, 9) AS u, round(v - mv, 9) AS v FROM f, m")
def frame_of_reference(spark, sf_dir):
    f = field_view(spark, sf_dir)
    m = f.agg(F.avg(F.col("u").cast("double")).alias("mu"), F.avg(F.col("v").cast("double")).alias("mv"))
    return f.crossJoin(F.broadcast(m)).select("t", "i", "j", F.round(F.col("u") - F.col("mu"), 9).alias("u"), F.round(F.col("v") - F.col("mv"), 9).alias("v"))


@query(f"WITH {FIELD} SELECT t, i, j, round(CASE WHEN u = 0 THEN -100 ELSE log2(abs(u::DOUBLE)) END, 9) AS log_u, u > 0 AS positive, u = 0 AS zero FROM f")
def log_transform(spark, sf_dir):
    log, pos, zero = S.log_transform(F.col("u"))
    return field_view(spark, sf_dir).select("t", "i", "j", F.round(log, 9).alias("log_u"), pos.alias("positive"), zero.alias("zero"))


@query(f"WITH {FIELD} SELECT vid, t, i, j FROM p")
def vertex_ids(spark, sf_dir):
    f, g = field_view(spark, sf_dir), view_grid(spark, sf_dir)
    back = f.select(g.vid().alias("vid"))
    t, i, j = g.coordinates("vid")
    return back.select("vid", t.cast("int").alias("t"), i.cast("int").alias("i"), j.cast("int").alias("j"))


@query(f"WITH {FIELD} SELECT a.vid, b.vid AS other FROM p a CROSS JOIN (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) o(x, y, z) JOIN p b ON b.t = a.t + x AND b.i = a.i + y AND b.j = a.j + z")
def adjacent_vertices(spark, sf_dir):
    return mesh.adjacent_vertices(view_grid(spark, sf_dir), field_view(spark, sf_dir))


# --- faces and critical points ------------------------------------------------------------------------


@query(f"WITH {FACES_SQL} SELECT tmpl, count(*) AS n FROM fa GROUP BY 1")
def face_census(spark, sf_dir):
    p, g, _ = fixed(spark, sf_dir)
    return verify.face_census(p, g)


@query(f"WITH {LAYER_SQL} SELECT a, b, c FROM fa WHERE {ZERO}")
def layer_cp_faces(spark, sf_dir):
    p, g, _ = fixed(spark, sf_dir)
    return mesh.zero_faces(p, g, mesh.FACES[:2]).select("a", "b", "c")


@query(f"WITH {FACES_SQL} SELECT tmpl, a, b, c FROM fa WHERE {ZERO}")
def all_cp_faces(spark, sf_dir):
    p, g, _ = fixed(spark, sf_dir)
    return mesh.zero_faces(p, g).select("tmpl", "a", "b", "c")


@query(f"WITH {FIELD}, {_faces_sql(mesh.LEGACY)} SELECT tmpl, least(a, b, c) AS a, a + b + c - least(a, b, c) - greatest(a, b, c) AS b, greatest(a, b, c) AS c FROM fa WHERE {ZERO}")
def legacy_cp_faces(spark, sf_dir):
    p, g, _ = fixed(spark, sf_dir)
    return mesh.zero_faces(p, g, mesh.LEGACY).select("tmpl", "a", "b", "c")


@query(f"WITH {LAYER_SQL} SELECT t, count(*) AS n FROM fa WHERE {ZERO} GROUP BY 1")
def cp_count_per_layer(spark, sf_dir):
    p, g, _ = fixed(spark, sf_dir)
    return critical.count_by_layer(mesh.zero_faces(p, g, mesh.FACES[:2]))


@query(f"WITH {POINTS_SQL} SELECT t, type, count(*) AS n FROM pt GROUP BY ALL")
def cp_type_counts(spark, sf_dir):
    p, g, _ = fixed(spark, sf_dir)
    return critical.layer_points(p, g).groupBy("t", "type").agg(F.count("*").alias("n"))


@query(f"WITH {POINTS_SQL} SELECT t, simplex_id, x, y, type FROM pt")
def cp_locations(spark, sf_dir):
    p, g, _ = fixed(spark, sf_dir)
    return rounded(critical.layer_points(p, g).select("t", "simplex_id", "x", "y", "type"))


@query(f"WITH {POINTS_SQL} SELECT t, simplex_id, x, y, ['singular', 'attracting', 'repelling', 'saddle', 'attracting focus', 'repelling focus', 'center'][type + 1] AS type FROM pt WHERE i BETWEEN 1 AND 22 AND j BETWEEN 1 AND 29")
def interior_cp(spark, sf_dir):
    from .functions.triangles import type_name

    p, g, _ = fixed(spark, sf_dir)
    return rounded(critical.interior_points(p, g).select("t", "simplex_id", "x", "y", type_name(F.col("type")).alias("type")))


def _tets_sql() -> str:
    rows = []
    for k, tet in enumerate(mesh.TETRAHEDRA):
        for left_out in range(4):
            rows.append((k, "side", tuple(c for m, c in enumerate(tet) if m != left_out)))
    return f"""{FIELD}, {_faces_sql(rows)},
    h AS (SELECT vid * 6 + tmpl AS tet, sum(({ZERO})::INT) AS hits FROM fa WHERE t + 1 < (SELECT nt FROM nf) AND i + 1 < 25 AND j + 1 < 32 GROUP BY 1)"""


@query(f"WITH {_tets_sql()} SELECT hits::BIGINT AS hits, count(*) AS n FROM h GROUP BY 1")
def tet_hit_histogram(spark, sf_dir):
    p, g, _ = fixed(spark, sf_dir)
    return mesh.tetrahedron_hits(p, g)


# --- bounds -------------------------------------------------------------------------------------------


def _bounds(spark, sf_dir, symmetric=False):
    p, g, s = fixed(spark, sf_dir)
    return critical.vertex_bounds(p, g, S.absolute_bound(EB, s.factor), symmetric=symmetric)


@query(f"WITH {VERTEX_SQL} SELECT vid, required_eb FROM vb")
def vertex_bound(spark, sf_dir):
    return _bounds(spark, sf_dir)


@query(f"WITH {_vertex_sql(_ANY, _ANY, _ANY)} SELECT vid, required_eb FROM vb")
def bound_symmetric(spark, sf_dir):
    return _bounds(spark, sf_dir, True)


_ID = "CASE WHEN required_eb <= 1 THEN 0 ELSE length(ltrim(bin(required_eb), '0')) - 1 END"


@query(f"WITH {VERTEX_SQL} SELECT ({_ID})::INT AS eb_id, count(*) AS n FROM vb GROUP BY 1")
def eb_id_histogram(spark, sf_dir):
    return critical.bound_ids(_bounds(spark, sf_dir)).groupBy("eb_id").agg(F.count("*").alias("n"))


@query(f"WITH {VERTEX_SQL} SELECT round(avg((({_ID}) = 0)::INT), 9) AS ratio FROM vb")
def lossless_share(spark, sf_dir):
    return critical.bound_ids(_bounds(spark, sf_dir)).agg(F.round(F.avg((F.col("eb_id") == 0).cast("int")), 9).alias("ratio"))


@query(f"WITH {VERTEX_SQL} SELECT vid, (CASE WHEN required_eb <= 1 THEN 1 ELSE length(ltrim(bin(required_eb), '0')) END)::INT AS id, (1::BIGINT << (CASE WHEN required_eb <= 1 THEN 1 ELSE length(ltrim(bin(required_eb), '0')) END - 1))::BIGINT AS eb FROM vb")
def bound_offset_ids(spark, sf_dir):
    b = _bounds(spark, sf_dir)
    id_, eb = S.quantize_bound_offset(F.col("required_eb"))
    return b.select("vid", id_.alias("id"), eb.alias("eb"))


# --- predictors ---------------------------------------------------------------------------------------


def _at(dt: int, di: int, dj: int, c: str) -> str:
    return f"coalesce({c}{dt}{di}{dj}.{c}, 0)"


def _stencil_sql(back: list[tuple[int, int, int]]) -> str:
    joins = "".join(f" LEFT JOIN p n{a}{b}{c} ON n{a}{b}{c}.t = o.t - {a} AND n{a}{b}{c}.i = o.i - {b} AND n{a}{b}{c}.j = o.j - {c}" for a, b, c in back)
    cols = "".join(f", coalesce(n{a}{b}{c}.{x}, 0) AS {x}{a}{b}{c}" for a, b, c in back for x in "uv")
    return f"st AS (SELECT o.t, o.i, o.j, o.u, o.v{cols} FROM p o{joins})"


_L3 = "({0}111 + {0}100 + {0}010 + {0}001 - {0}110 - {0}101 - {0}011)"
_PRED_SQL = {
    "lorenzo2d": "({0}010 + {0}001 - {0}011)",
    "lorenzo3d": _L3,
    "mixed_order": "(2 * {0}100 - {0}200 + {0}010 - 2 * {0}110 + {0}210 + {0}001 - 2 * {0}101 + {0}201 - {0}011 + 2 * {0}111 - {0}211)",
    "time_linear": "CASE WHEN t < 2 THEN " + _L3 + " ELSE 2 * {0}100 - {0}200 + CASE WHEN i > 0 THEN {0}010 - 2 * {0}110 + {0}210 ELSE 0 END + CASE WHEN j > 0 THEN {0}001 - 2 * {0}101 + {0}201 ELSE 0 END - CASE WHEN i > 0 AND j > 0 THEN {0}011 - 2 * {0}111 + {0}211 ELSE 0 END END",
    "stride2": "CASE WHEN t < 2 THEN " + _L3 + " ELSE {0}211 + {0}200 + {0}010 + {0}001 - {0}210 - {0}201 - {0}011 END",
    "dt2d": "CASE WHEN t < 1 THEN " + _L3 + " ELSE {0}100 + ({0}010 - {0}110) + ({0}001 - {0}101) - ({0}011 - {0}111) END",
}
_B = "(2 * {0}100 - {0}200)"
_near = [", ".join("CASE WHEN i >= %d AND j >= %d THEN {0}%d%d%d ELSE {0}100 END" % (b, c, a, b, c) for b, c in ((0, 0), (1, 0), (0, 1), (1, 1)) for a in (1, 2))]
_PRED_SQL["ar2_clamped"] = "CASE WHEN t < 2 THEN " + _L3 + f" ELSE greatest(least({_near[0]}), least({_B}, greatest({_near[0]}))) END"


def _residual_query(name: str):
    back = predict.PREDICTORS[name][1]
    sql = f"WITH {FIELD}, {_stencil_sql(back)}, r AS (SELECT abs(u - ({_PRED_SQL[name].format('u')})) AS r FROM st UNION ALL SELECT abs(v - ({_PRED_SQL[name].format('v')})) FROM st) SELECT sum(r)::BIGINT AS sum_abs, max(r) AS max_abs, count(*) AS n FROM r"

    @query(sql, f"{name}_residual")
    def run(spark, sf_dir):
        p, _, _ = fixed(spark, sf_dir)
        return predict.residual_summary(p, name)


for _name in _PRED_SQL:
    _residual_query(_name)


def _sample_sql(points: str, out: str, names: str) -> str:
    """CTEs that sample frames pv (u, v) at y and x of points, as columns su, sv of ``out``."""
    return f"""
    {out}0 AS (SELECT *, greatest(0, least(24, y)) AS yy, greatest(0, least(31, x)) AS xx FROM {points}),
    {out}1 AS (SELECT *, floor(yy)::INT AS i0, floor(xx)::INT AS j0, least(floor(yy)::INT + 1, 24) AS i1, least(floor(xx)::INT + 1, 31) AS j1, yy - floor(yy) AS fy, xx - floor(xx) AS fx FROM {out}0),
    {out} AS (SELECT {names}, (1 - fx) * (1 - fy) * a.u + fx * (1 - fy) * b.u + (1 - fx) * fy * c.u + fx * fy * d.u AS su, (1 - fx) * (1 - fy) * a.v + fx * (1 - fy) * b.v + (1 - fx) * fy * c.v + fx * fy * d.v AS sv
      FROM {out}1 o JOIN pv a ON a.t = o.t AND a.i = i0 AND a.j = j0 JOIN pv b ON b.t = o.t AND b.i = i0 AND b.j = j1
      JOIN pv c ON c.t = o.t AND c.i = i1 AND c.j = j0 JOIN pv d ON d.t = o.t AND d.i = i1 AND d.j = j1)"""


_ADVECT_SQL = f"""{FIELD}, pv AS (SELECT t + 1 AS t, i, j, u::DOUBLE AS u, v::DOUBLE AS v FROM p),
    h AS (SELECT p.t, p.i, p.j, p.u, p.v, p.i - 0.5::DOUBLE * pv.v * (1.0::DOUBLE / (1::BIGINT << shift)) AS y, p.j - 0.5::DOUBLE * pv.u * (1.0::DOUBLE / (1::BIGINT << shift)) AS x FROM p JOIN pv USING (t, i, j), sc),
    {_sample_sql("h", "m", "o.t, o.i, o.j, o.u, o.v")},
    e AS (SELECT t, i, j, u, v, i - sv * (1.0::DOUBLE / (1::BIGINT << shift)) AS y, j - su * (1.0::DOUBLE / (1::BIGINT << shift)) AS x FROM m, sc),
    {_sample_sql("e", "z", "o.t, o.i, o.j, o.u, o.v")},
    ad AS (SELECT t, i, j, u, v, round(su)::BIGINT AS u_pred, round(sv)::BIGINT AS v_pred FROM z)"""


@query(f"WITH {_ADVECT_SQL} SELECT t, i, j, u_pred, v_pred FROM ad")
def advect_sample(spark, sf_dir):
    p, g, s = fixed(spark, sf_dir)
    return predict.advected(p, g, s.factor).select("t", "i", "j", "u_pred", "v_pred")


#: Steps of the walk in SQL: one row a vertex and step, midpoint walks in two steps, others in n.
_WALK_SQL = f"""{FIELD}, pv AS (SELECT t + 1 AS t, i, j, u::DOUBLE AS u, v::DOUBLE AS v FROM p),
    c AS (SELECT 8.0::DOUBLE / (1::BIGINT << shift) AS c FROM sc),
    n AS (SELECT p.t, p.i, p.j, greatest(1, least(32, ceil(greatest(abs(pv.u), abs(pv.v)) * c / 2.0)))::INT AS n, c FROM p JOIN pv USING (t, i, j), c),
    wk AS (SELECT t, i, j, n, c, 0 AS s, i::DOUBLE AS y, j::DOUBLE AS x FROM n
      UNION ALL
      SELECT o.t, o.i, o.j, n, c, s + 1, greatest(0, least(24, CASE WHEN n = 1 THEN o.i - sv * (CASE WHEN s = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * c) ELSE y - sv * (c / n) END)),
             greatest(0, least(31, CASE WHEN n = 1 THEN o.j - su * (CASE WHEN s = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * c) ELSE x - su * (c / n) END))
      FROM (SELECT o.*, (1 - fx) * (1 - fy) * a.u + fx * (1 - fy) * b.u + (1 - fx) * fy * g.u + fx * fy * d.u AS su, (1 - fx) * (1 - fy) * a.v + fx * (1 - fy) * b.v + (1 - fx) * fy * g.v + fx * fy * d.v AS sv
            FROM (SELECT *, floor(y)::INT AS i0, floor(x)::INT AS j0, least(floor(y)::INT + 1, 24) AS i1, least(floor(x)::INT + 1, 31) AS j1, y - floor(y) AS fy, x - floor(x) AS fx FROM wk WHERE s < greatest(n, 2)) o
            JOIN pv a ON a.t = o.t AND a.i = i0 AND a.j = j0 JOIN pv b ON b.t = o.t AND b.i = i0 AND b.j = j1
            JOIN pv g ON g.t = o.t AND g.i = i1 AND g.j = j0 JOIN pv d ON d.t = o.t AND d.i = i1 AND d.j = j1) o),
    e AS (SELECT t, i, j, n, y, x FROM wk WHERE s = greatest(n, 2)),
    {_sample_sql("e", "z", "o.t, o.i, o.j")}"""


@query(f"WITH RECURSIVE {_WALK_SQL} SELECT t, i, j, round(su)::BIGINT AS u_pred, round(sv)::BIGINT AS v_pred FROM z")
def advect_substeps(spark, sf_dir):
    """Moves of up to eight cells, in steps of at most two, traced over tiles of four by four, which some leave."""
    p, g, s = fixed(spark, sf_dir)
    return predict.advected(p, g, s.factor, 8.0, 8.0, cells=2.0, tile=4).select("t", "i", "j", "u_pred", "v_pred")


def _modes(spark, sf_dir):
    p, g, s = fixed(spark, sf_dir)
    return predict.block_modes(predict.predicted(p, "lorenzo3d"), predict.advected(p, g, s.factor), 8)


_MODES_SQL = f"""{_ADVECT_SQL}, {_stencil_sql(predict.PREDICTORS['lorenzo3d'][1])},
    c AS (SELECT st.t, st.i, st.j, abs(st.u - {_L3.format('u')}) + abs(st.v - {_L3.format('v')}) AS a, abs(st.u - ad.u_pred) + abs(st.v - ad.v_pred) AS b FROM st LEFT JOIN ad USING (t, i, j)),
    k AS (SELECT t, i // 8 AS bi, j // 8 AS bj, sum(a) AS a, sum(b) AS b FROM c GROUP BY ALL),
    md AS (SELECT t, bi, bj, CASE WHEN b IS NOT NULL AND b < a AND (a - b)::DOUBLE / (a::DOUBLE + 1e-12) >= 0.003 THEN 1 ELSE 0 END AS mode FROM k)"""


@query(f"WITH {_MODES_SQL} SELECT t, bi, bj, mode FROM md")
def block_mode_fast(spark, sf_dir):
    return _modes(spark, sf_dir)


@query(f"WITH {_MODES_SQL} SELECT mode, count(*) AS n FROM md GROUP BY 1")
def block_mode_counts(spark, sf_dir):
    return predict.mode_counts(_modes(spark, sf_dir))


@query(f"""WITH {FIELD}, b AS (SELECT t, i // 8 AS bi, j // 8 AS bj, regr_slope(u, i % 8) AS b0, regr_slope(u, j % 8) AS b1, avg(u) AS m, max(i % 8) AS h, max(j % 8) AS w FROM p GROUP BY ALL)
    SELECT t, bi, bj, round(coalesce(CASE WHEN h > 0 THEN b0 ELSE 0 END, 0), 6) AS b0, round(coalesce(CASE WHEN w > 0 THEN b1 ELSE 0 END, 0), 6) AS b1,
           round(m - CASE WHEN h > 0 THEN b0 ELSE 0 END * h / 2.0 - CASE WHEN w > 0 THEN b1 ELSE 0 END * w / 2.0, 6) AS b2 FROM b""")
def block_regression(spark, sf_dir):
    p, _, _ = fixed(spark, sf_dir)
    return rounded(predict.plane_regression(p, "u", 8), 6)


# --- symbols ------------------------------------------------------------------------------------------

_STEP = 1 << 22


def _symbols(spark, sf_dir):
    p, _, _ = fixed(spark, sf_dir)
    r = predict.predicted(p, "lorenzo3d")
    both = r.select(F.explode(F.array(F.col("u") - F.col("u_pred"), F.col("v") - F.col("v_pred"))).alias("r"))
    return both.select(F.floor(F.col("r") / F.lit(float(_STEP))).cast("long").alias("sym"), "r")


_SYMBOLS_SQL = f"{FIELD}, {_stencil_sql(predict.PREDICTORS['lorenzo3d'][1])}, y AS (SELECT u - {_L3.format('u')} AS r FROM st UNION ALL SELECT v - {_L3.format('v')} FROM st), sy AS (SELECT r, floor(r / {_STEP}.0::DOUBLE)::BIGINT AS sym FROM y)"


@query(f"WITH {_SYMBOLS_SQL} SELECT sym, count(*) AS n FROM sy GROUP BY 1")
def symbol_frequencies(spark, sf_dir):
    return coding.frequencies(_symbols(spark, sf_dir))


@query(f"WITH {_SYMBOLS_SQL} SELECT round(entropy(sym), 9) AS bits FROM sy")
def residual_entropy(spark, sf_dir):
    return rounded(coding.entropy(coding.frequencies(_symbols(spark, sf_dir))), 9)


@query(f"WITH {_SYMBOLS_SQL} SELECT round(entropy(CASE WHEN abs(sym) = 0 THEN 0 WHEN abs(sym) = 1 THEN 1 WHEN abs(sym) <= 3 THEN 2 WHEN abs(sym) <= 15 THEN 3 WHEN abs(sym) <= 255 THEN 4 ELSE 5 END), 9) AS bits FROM sy")
def six_bin_entropy(spark, sf_dir):
    s = _symbols(spark, sf_dir).select(coding.six_bins(F.col("sym")).alias("sym"))
    return rounded(coding.entropy(coding.frequencies(s)), 9)


@query()
def huffman_size(spark, sf_dir):
    return coding.huffman_bits(coding.frequencies(_symbols(spark, sf_dir)))


@query(f"""WITH {_SYMBOLS_SQL}, h AS (SELECT least((abs(r) // {_STEP} + 1) // 2, 32767) AS q, count(*) AS n FROM sy GROUP BY 1),
    c AS (SELECT q, sum(n) OVER (ORDER BY q) AS below, sum(n) OVER () AS total FROM h), m AS (SELECT 2 * (min(q) + 1) AS need FROM c WHERE below >= total * 0.999)
    SELECT greatest(32, (2 ** ceil(log2(need)))::BIGINT) AS intervals FROM m""")
def quant_interval_estimate(spark, sf_dir):
    return coding.interval_estimate(_symbols(spark, sf_dir), "r", _STEP)


_EVENTS = "ev AS (SELECT user_id, event_id, (floor(value)::BIGINT % 4) - 1 AS x FROM events WHERE value IS NOT NULL)"


def _events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("value is not null")
    return e.select("user_id", "event_id", (F.floor("value").cast("long") % 4 - 1).alias("x"))


def _runs_sql(new: str, tail: str) -> str:
    return f"""WITH {_EVENTS}, l AS (SELECT *, lag(x) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM ev),
        g AS (SELECT *, sum(CASE WHEN b IS NULL OR {new} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM l) {tail}"""


@query(_runs_sql("x <> 0 OR b <> 0", "SELECT user_id, min(event_id) AS place, CASE WHEN min(x) = 0 THEN -count(*) ELSE min(x) END AS sym FROM g GROUP BY user_id, run"))
def zero_rle(spark, sf_dir):
    return coding.zero_runs(_events(spark, sf_dir), ["user_id"], "event_id", "x")


@query(_runs_sql("(x BETWEEN -1 AND 1) <> (b BETWEEN -1 AND 1) OR (x BETWEEN -1 AND 1 AND x <> b)", "SELECT user_id, min(event_id) AS place, CASE WHEN min(x) BETWEEN -1 AND 1 THEN 'run' ELSE 'literal' END AS kind, CASE WHEN min(x) BETWEEN -1 AND 1 THEN min(x) END AS value, count(*) AS n FROM g GROUP BY user_id, run"))
def tri_rle(spark, sf_dir):
    return coding.tri_runs(_events(spark, sf_dir), ["user_id"], "event_id", "x")


@query(f"WITH {_EVENTS}, d AS (SELECT user_id, event_id, x - coalesce(lag(x) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS d FROM ev) SELECT user_id, event_id, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS sym FROM d")
def delta_zigzag(spark, sf_dir):
    return coding.delta_zigzag(_events(spark, sf_dir), ["user_id"], "event_id", "x")


# --- reports ------------------------------------------------------------------------------------------

_Q = 1 << 20


def _quantized(spark, sf_dir):
    p, g, s = fixed(spark, sf_dir)
    return verify.uniform_quantized(p, _Q), g, s


_Q_SQL = f"{FIELD}, q AS (SELECT t, i, j, vid, u, v, (floor((u + {_Q}) / {2.0 * _Q}::DOUBLE) * {2 * _Q})::BIGINT AS du, (floor((v + {_Q}) / {2.0 * _Q}::DOUBLE) * {2 * _Q})::BIGINT AS dv FROM p)"
_METRICS = """SELECT n, round(mse, 3) AS mse, round(sqrt(mse), 6) AS rmse, round(sqrt(mse) / (hi - lo), 9) AS nrmse, round(20 * log10(hi - lo) - 10 * log10(mse), 6) AS psnr, max_err, lo AS min_orig, hi AS max_orig
    FROM (SELECT count(*) AS n, sum((x - y) ** 2) / count(*) AS mse, max(abs(x - y)) AS max_err, min(x) AS lo, max(x) AS hi FROM xy)"""


def _metrics(df):
    return df.select("n", F.round("mse", 3).alias("mse"), F.round("rmse", 6).alias("rmse"), F.round("nrmse", 9).alias("nrmse"), F.round("psnr", 6).alias("psnr"), "max_err", "min_orig", "max_orig")


@query(f"WITH {_Q_SQL}, xy AS (SELECT u::DOUBLE AS x, du::DOUBLE AS y FROM q) {_METRICS}")
def quality_metrics(spark, sf_dir):
    return _metrics(verify.quality(_quantized(spark, sf_dir)[0], "u", "du"))


@query(f"WITH {_Q_SQL}, xy AS (SELECT u::DOUBLE AS x, du::DOUBLE AS y FROM q UNION ALL SELECT v, dv FROM q) {_METRICS}")
def combined_quality_metrics(spark, sf_dir):
    return _metrics(verify.combined_quality(_quantized(spark, sf_dir)[0], [("u", "du"), ("v", "dv")]))


@query(f"WITH {_Q_SQL} SELECT round(max(abs(u - du)::DOUBLE / abs(u)) FILTER (abs(u) > 1), 6) AS max_pw_rel, round(corr(u, du), 9) AS ac_eff FROM q")
def correlation_metrics(spark, sf_dir):
    c = verify.correlation(_quantized(spark, sf_dir)[0], "u", "du")
    return c.select(F.round("max_pw_rel", 6).alias("max_pw_rel"), F.round("ac_eff", 9).alias("ac_eff"))


_MARK_SQL = f"{_Q_SQL.replace('p AS (', 'p0 AS (').replace('FROM p)', 'FROM p0)')}, p AS (SELECT * FROM q), {_faces_sql(extra='du dv')}, mk AS (SELECT t, tmpl, a, b, c, {ZERO} AS ori, {_zero_sql('du', 'dv')} AS dec FROM fa)"


@query(f"""WITH {_MARK_SQL} SELECT region, idx, count(*) FILTER (ori AND dec) AS tp, count(*) FILTER (NOT ori AND NOT dec) AS tn, count(*) FILTER (NOT ori AND dec) AS fp, count(*) FILTER (ori AND NOT dec) AS fn
    FROM (SELECT CASE WHEN tmpl <= 2 THEN 'layer' ELSE 'slab' END AS region, t AS idx, ori, dec FROM mk) GROUP BY GROUPING SETS ((region, idx), (region))""")
def cp_confusion(spark, sf_dir):
    q, g, _ = _quantized(spark, sf_dir)
    return verify.confusion(verify.marked_faces(q, g))


@query(f"WITH {_MARK_SQL} SELECT CASE WHEN ori THEN 'lost' ELSE 'new' END AS side, a, b, c FROM mk WHERE ori <> dec")
def cp_diff(spark, sf_dir):
    q, g, _ = _quantized(spark, sf_dir)
    return verify.differences(verify.marked_faces(q, g))


@query()
def cp_match_types(spark, sf_dir):
    q, g, _ = _quantized(spark, sf_dir)
    a = critical.layer_points(q.select("t", "i", "j", "u", "v"), g)
    b = critical.layer_points(q.select("t", "i", "j", F.col("du").alias("u"), F.col("dv").alias("v")), g)
    return verify.match_points(a, b)


@query(f"""WITH {FIELD}, m AS (SELECT covar_samp(u::DOUBLE, v::DOUBLE) AS uv, var_samp(u::DOUBLE) AS uu, var_samp(v::DOUBLE) AS vv FROM f, nf WHERE (t * 800 + i * 32 + j) % greatest(1, nt * 800 // 200000) = 0)
    SELECT round(cos(0.5 * atan2(2 * uv, uu - vv)), 9) AS c, round(sin(0.5 * atan2(2 * uv, uu - vv)), 9) AS s FROM m""")
def channel_rotation(spark, sf_dir):
    return rounded(verify.channel_rotation(field_view(spark, sf_dir), view_grid(spark, sf_dir)), 9)


@query(f"WITH {FIELD} SELECT t, i, j, round(0.6 * u::DOUBLE + 0.8 * v::DOUBLE, 9) AS a, round(0.6 * v::DOUBLE - 0.8 * u::DOUBLE, 9) AS b FROM f")
def rotated(spark, sf_dir):
    a, b = S.rotate(F.col("u"), F.col("v"), 0.6, 0.8)
    return field_view(spark, sf_dir).select("t", "i", "j", F.round(a, 9).alias("a"), F.round(b, 9).alias("b"))


# Two recorded faces before and after coding, in units of fixed point.
RECORDED = [
    ("A original", 270, -428, -4268, 7467, 35924, 51546), ("A decoded", 242, -449, -4273, 7473, 36018, 51649),
    ("B original", 36621, -50800, 270, -428, -4268, 7467), ("B decoded", 36620, -50793, 242, -449, -4273, 7473),
]


@query("""SELECT * FROM (VALUES ('A original', false), ('A decoded', true), ('B original', false), ('B decoded', true)) v(name, zero)""")
def recorded_faces(spark, sf_dir):
    rows = spark.createDataFrame(RECORDED, "name string, ua long, va long, ub long, vb long, uc long, vc long")
    return verify.recorded_faces(rows).select("name", "zero")


# --- trajectories -------------------------------------------------------------------------------------


def _tet_sides_sql() -> str:
    """fz (tet, face): the zero faces of each tetrahedron, of the faces fa of p."""
    sides = [(k, [tet[m] for m in range(4) if m != left_out]) for k, tet in enumerate(mesh.TETRAHEDRA) for left_out in range(4)]
    rows = ", ".join(f"({k}, {', '.join(str(x) for c in abc for x in mesh.CORNERS[c])})" for k, abc in sides)
    joins = " ".join(f"JOIN p q{n} ON q{n}.t = o.t + {n}t AND q{n}.i = o.i + {n}i AND q{n}.j = o.j + {n}j" for n in "xyz")
    return f"""z AS (SELECT vid * 12 + tmpl - 1 AS face, a, b, c FROM fa WHERE {ZERO}),
    ts(tet, {", ".join(n + k for n in "xyz" for k in "tij")}) AS (VALUES {rows}),
    sd AS (SELECT o.vid * 6 + tet AS tet, qx.vid AS a, qy.vid AS b, qz.vid AS c FROM p o CROSS JOIN ts {joins}
           WHERE o.t < (SELECT max(t) FROM p) AND o.i < (SELECT max(i) FROM p) AND o.j < (SELECT max(j) FROM p)),
    fz AS (SELECT tet, face FROM sd JOIN z USING (a, b, c)),
    lk AS (SELECT DISTINCT x.face AS x, y.face AS y FROM fz x JOIN fz y ON x.tet = y.tet AND x.face < y.face)"""


_COMPONENTS_SQL = """w AS (SELECT x, y FROM lk UNION ALL SELECT y, x FROM lk),
    cc(id, component) USING KEY (id) AS (SELECT face, face FROM z
        UNION (SELECT u.id, min(v.component) FROM recurring.cc u JOIN w ON w.x = u.id JOIN cc v ON v.id = w.y WHERE v.component < u.component GROUP BY u.id))
    SELECT component, count(*) AS n_faces FROM cc GROUP BY 1"""


def _swirl(spark):
    f = swirl_field(spark, SWIRL, "focus")
    return to_fixed(f, fixed_scale(f)), SWIRL


def _zero(spark, sf_dir):
    p, g, _ = fixed(spark, sf_dir)
    return mesh.zero_faces(p, g), g


@query(f"WITH {FACES_SQL}, {_tet_sides_sql()} SELECT x, y FROM lk")
def cp_links(spark, sf_dir):
    return critical.zero_graph(*_zero(spark, sf_dir))


@query(f"WITH RECURSIVE {FACES_SQL}, {_tet_sides_sql()}, {_COMPONENTS_SQL}")
def cp_components(spark, sf_dir):
    return critical.zero_components(*_zero(spark, sf_dir)).groupBy("component").agg(F.count("*").alias("n_faces"))


@query(f"WITH RECURSIVE {_swirl_sql(SWIRL.H, SWIRL.W, SWIRL.T)}, {_faces_sql()}, {_tet_sides_sql()}, {_COMPONENTS_SQL}")
def swirl_components(spark, sf_dir):
    """Of an analytic field with one moving critical point."""
    p, g = _swirl(spark)
    return critical.zero_components(mesh.zero_faces(p, g), g).groupBy("component").agg(F.count("*").alias("n_faces"))


@query()
def cp_curves(spark, sf_dir):
    return rounded(critical.curves(*_zero(spark, sf_dir)))


@query()
def cp_ordered_curves(spark, sf_dir):
    return rounded(critical.speed(critical.ordered_curves(*_zero(spark, sf_dir))))


# --- coding -------------------------------------------------------------------------------------------


def _count(x) -> F.Column:
    return F.coalesce(F.sum(x.cast("long")), F.lit(0)).cast("long")


def _beside(field, decoded, scale):
    """(t, i, j, u, v, du, dv) in fixed point."""
    return to_fixed(field, scale).join(decoded.select("t", "i", "j", F.col("ufp").alias("du"), F.col("vfp").alias("dv")), ["t", "i", "j"])


def _checked(field, g, s, eb, blocks, decoded, templates=mesh.FACES):
    """Vertices decoded, those beyond the bound, and faces whose verdict changed; and whether the blocks are smaller than the field."""
    both = _beside(field, decoded, s)
    far = F.greatest(F.abs(F.col("u") - F.col("du")), F.abs(F.col("v") - F.col("dv"))) > eb
    count = both.agg(F.count("*").alias("n"), _count(far).alias("n_bound_violations"))
    flips = verify.marked_faces(both, g, templates).agg(_count(~F.col("ori") & F.col("dec")).alias("fp"), _count(F.col("ori") & ~F.col("dec")).alias("fn"))
    return count.crossJoin(flips).crossJoin(codec.statistics(blocks).select((F.col("ratio") > 1).alias("smaller"), (F.col("max_err") <= eb).alias("within")))


_KEPT_SQL = "SELECT (count(*) // 25 * 800)::BIGINT AS n, 0::BIGINT AS n_bound_violations, 0::BIGINT AS fp, 0::BIGINT AS fn, {} AS smaller, true AS within FROM embeddings"


def _roundtrip(name: str, smooth: bool = False, label: str | None = None, eb: float = EB, templates=mesh.FACES, smaller: bool = True, **how):
    """By the codec's guarantee no vertex is beyond the bound and no verdict changes.  The field view is nearly noise, of which a third of the
    faces hold zeros: nearly all of it is lossless, and takes as much as it did."""

    @query(_KEPT_SQL.format("true") if smaller else _KEPT_SQL.format("true").replace(", true AS smaller", ""), label or f"roundtrip_{name}")
    def run(spark, sf_dir):
        field, g = (smooth_view if smooth else field_view)(spark, sf_dir), view_grid(spark, sf_dir)
        s = fixed_scale(field)
        bound = codec.bound_for(s, eb)
        blocks = cut(codec.encode(field, g, s, bound, name, **how))
        decoded = codec.decode(blocks, g, s, name, how.get("block"), coding=how.get("coding", "huffman"))
        out = _checked(field, g, s, bound, blocks, decoded, templates)
        return out if smaller else out.drop("smaller")


for _name in ("lorenzo3d", "lorenzo2d", "mixed_order", "time_linear", "stride2", "dt2d", "ar2_clamped", "lorenzo_ar2", "advect", "warped", "modes"):
    _roundtrip(_name, smaller=False)
for _name in ("lorenzo3d", "modes_entropy", "lorenzo_ar2", "plane", "mixed_order", "warped"):
    _roundtrip(_name, True, f"smooth_{_name}", 0.002)
_roundtrip("lorenzo3d", True, "smooth_zigzag", 0.002, coding="zigzag")
_roundtrip("lorenzo3d", True, "smooth_symmetric", 0.002, guard="symmetric")
_roundtrip("lorenzo2d", True, "smooth_tried", 0.002, mesh.FACES[:2], guard="tried")
_roundtrip("lorenzo2d", True, "smooth_relaxed", 0.002, mesh.FACES[:2], guard="layers", relax=8)
_roundtrip("lorenzo2d", True, "smooth_typed", 0.002, mesh.FACES[:2], guard="typed")


@query(_KEPT_SQL.format("true").replace("true AS within", "true AS within, true AS fewer_bytes"))
def smooth_shared_huffman(spark, sf_dir):
    """One table for all blocks, written and read as bytes; with it they take fewer bytes than with a table each."""
    field, g = smooth_view(spark, sf_dir), view_grid(spark, sf_dir)
    s = fixed_scale(field)
    bound = codec.bound_for(s, 0.002)
    own = cut(codec.encode(field, g, s, bound))
    shared, tables = codec.with_shared_tables(own)
    shared, head = cut(shared), tables.to_bytes()
    both = codec.statistics(shared).select((F.col("bytes") + len(head)).alias("b")).crossJoin(codec.statistics(own).select("bytes"))
    return _checked(field, g, s, bound, shared, codec.decode(shared, g, s, coding=Shared.from_bytes(head))).crossJoin(both.select((F.col("b") < F.col("bytes")).alias("fewer_bytes")))


def _in_order(label: str, predictor: str, guard: str = "faces", templates=mesh.FACES, **how):
    """Blocks that predict across their borders, diagonal by diagonal, in segments of time; fewer vertices are lossless than with blocks on their own, and it takes fewer bytes."""

    @query(_KEPT_SQL.format("true").replace("true AS within", "true AS within, true AS fewer_lossless, true AS fewer_bytes"), label)
    def run(spark, sf_dir):
        field, g = smooth_view(spark, sf_dir), view_grid(spark, sf_dir)
        s = fixed_scale(field)
        bound = codec.bound_for(s, 0.002)
        blocks = cut(wavefront.encode(field, g, s, bound, predictor, guard=guard, segment=wavefront.SEGMENT, **how))
        decoded = wavefront.decode(blocks, g, s, predictor, segment=wavefront.SEGMENT)
        alone = codec.statistics(codec.encode(field, g, s, bound, predictor, guard=guard, **how)).select(F.col("n_lossless").alias("l"), F.col("bytes").alias("b"))
        less = codec.statistics(blocks).crossJoin(alone).select((F.col("n_lossless") < F.col("l")).alias("fewer_lossless"), (F.col("bytes") < F.col("b")).alias("fewer_bytes"))
        return _checked(field, g, s, bound, blocks, decoded, templates).crossJoin(less)


_in_order("wavefront_lorenzo3d", "lorenzo3d")
_in_order("wavefront_mixed_order", "mixed_order")


@query("SELECT 'matched' AS class, true AS some FROM (SELECT 1)")
def smooth_types_kept(spark, sf_dir):
    """Critical points before and after coding with guard "typed", by simplex: none is lost, new, or of another type."""
    field, g = smooth_view(spark, sf_dir), view_grid(spark, sf_dir)
    s = fixed_scale(field)
    blocks = codec.encode(field, g, s, codec.bound_for(s, 0.002), "lorenzo2d", guard="typed")
    both = cut(_beside(field, codec.decode(blocks, g, s, "lorenzo2d"), s))
    a = critical.layer_points(both.select("t", "i", "j", "u", "v"), g)
    b = critical.layer_points(both.select("t", "i", "j", F.col("du").alias("u"), F.col("dv").alias("v")), g)
    return verify.match_points(a, b).select("class", (F.col("n") > 0).alias("some"))


def _relative_roundtrip(label: str, guard: str = "none", offline: bool = False, log: bool = True, typed: bool = False, share: float = 0.1):
    """Real values within a tenth of themselves, and triangles of frames that win or lose a zero (of strict signs): none of either."""

    @query("SELECT (count(*) // 25 * 800)::BIGINT AS n, 0::BIGINT AS n_bound_violations, 0::BIGINT AS flipped FROM embeddings", label)
    def run(spark, sf_dir):
        field, g = field_view(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in "uv"}), view_grid(spark, sf_dir)
        rows, limit = field, None
        if offline:
            bounds = critical.relative_vertex_bounds(field, g, typed)
            rows, limit = field.join(bounds, ["t", "i", "j"]).withColumn("limit", codec.relative_limit(F.col("share"))), "limit"
        if log:
            blocks, s = codec.encode_relative(rows, g, share, "lorenzo2d", guard=guard, limit=limit)
        else:
            s = fixed_scale(field)
            blocks = codec.encode(rows, g, s, codec.bound_for(s, share), "lorenzo2d", guard=guard)
        back = codec.decode(blocks, g, s, "lorenzo2d", log=log, kind="double").select("t", "i", "j", F.col("u").alias("du"), F.col("v").alias("dv"))
        both = cut(field.join(back, ["t", "i", "j"]))
        far = F.greatest(*(F.abs(F.col(c) - F.col("d" + c)) - (share * F.abs(c) if log else F.lit(share)) for c in "uv")) > 0
        flips = verify.marked_faces(both, g, mesh.FACES[:2]).agg(_count(F.col("ori") != F.col("dec")).alias("flipped"))
        return both.agg(F.count("*").alias("n"), _count(far).alias("n_bound_violations")).crossJoin(flips)


_relative_roundtrip("relative_offline", offline=True)
_relative_roundtrip("relative_offline_typed", offline=True, typed=True)
_relative_roundtrip("relative_online_log", "relative")
_relative_roundtrip("relative_online", "relative", log=False, share=0.01)


@query("SELECT (count(*) // 25 * 800)::BIGINT AS n, 0::BIGINT AS n_bound_violations, 0::BIGINT AS flipped FROM embeddings")
def relative_bilinear(spark, sf_dir):
    """As the others, for zeros of the bilinear field: cells whose number of zeros or types changed."""
    field, g = field_view(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in "uv"}), view_grid(spark, sf_dir)
    blocks, s = codec.encode_relative(field, g, 0.1, "lorenzo2d", guard="bilinear")
    back = cut(codec.decode(blocks, g, s, "lorenzo2d", log=True, kind="double").select("t", "i", "j", "u", "v"))
    both = field.join(back.withColumnsRenamed({"u": "x", "v": "y"}), ["t", "i", "j"])
    far = (F.abs(F.col("u") - F.col("x")) > 0.1 * F.abs("u")) | (F.abs(F.col("v") - F.col("y")) > 0.1 * F.abs("v"))
    cells = lambda f, name: critical.bilinear_points(f, g).withColumn("ci", F.floor("y")).withColumn("cj", F.floor("x")).groupBy("t", "i", "j").agg(F.sort_array(F.collect_list("type")).alias(name))
    flips = cells(field, "a").join(cells(back, "b"), ["t", "i", "j"], "full_outer").agg(_count(~F.col("a").eqNullSafe(F.col("b"))).alias("flipped"))
    return both.agg(F.count("*").alias("n"), _count(far).alias("n_bound_violations")).crossJoin(flips)


@query()
def codec_statistics(spark, sf_dir):
    field, g = field_view(spark, sf_dir), view_grid(spark, sf_dir)
    s = fixed_scale(field)
    return codec.statistics(codec.encode(field, g, s, codec.bound_for(s, EB)))


# --- volumes ------------------------------------------------------------------------------------------

_VOLUME = """
    nf AS (SELECT count(*) // 25 AS nt FROM embeddings),
    f AS (SELECT (vec_id // 25)::INT AS t, (vec_id % 25)::INT AS i, k::INT AS j, embedding[3 * k + 1] AS u, embedding[3 * k + 2] AS v, embedding[3 * k + 3] AS w
          FROM embeddings, range(21) r(k), nf WHERE vec_id // 25 < nt),
    sc AS (SELECT (19 - ceil(log2(max(greatest(abs(u), abs(v), abs(w))))))::INT AS shift FROM f),
    p AS (SELECT t, i, j, (t * 525 + i * 21 + j)::BIGINT AS vid, trunc(u::DOUBLE * (1::BIGINT << shift))::BIGINT AS u, trunc(v::DOUBLE * (1::BIGINT << shift))::BIGINT AS v, trunc(w::DOUBLE * (1::BIGINT << shift))::BIGINT AS w FROM f, sc)"""


def _tet_sql() -> str:
    rows = ", ".join(f"({k}, {', '.join(str(x) for c in tet for x in mesh.CORNERS[c])})" for k, tet in enumerate(mesh.TETRAHEDRA))
    names = ", ".join(f"{n}_{x}" for n in "abcd" for x in "tij")
    joins = " ".join(f"JOIN p p{n} ON p{n}.t = o.t + {n}_t AND p{n}.i = o.i + {n}_i AND p{n}.j = o.j + {n}_j" for n in "abcd")
    cols = ", ".join(f"p{n}.vid AS {n}, " + ", ".join(f"p{n}.{x} AS {x}{n}" for x in "uvw") for n in "abcd")
    det = lambda a, b, c: f"(u{a} * (v{b} * w{c} - w{b} * v{c}) - v{a} * (u{b} * w{c} - w{b} * u{c}) + w{a} * (u{b} * v{c} - v{b} * u{c}))"
    return f"""{_VOLUME}, tm(tet, {names}) AS (VALUES {rows}), te AS (SELECT o.t, o.i, o.j, tet, {cols} FROM p o CROSS JOIN tm {joins}),
    mm AS (SELECT *, -{det('b', 'c', 'd')} AS m0, {det('a', 'c', 'd')} AS m1, -{det('a', 'b', 'd')} AS m2, {det('a', 'b', 'c')} AS m3 FROM te)"""


def _side_sql(a: str, b: str, c: str, turn: int) -> str:
    """The sign of turn * det(a, b, c), as with the origin moved by (e, e * e, e * e * e)."""
    cross = lambda p, q, x, y: f"({x}{p} * {y}{q} - {y}{p} * {x}{q})"
    det = f"(u{a} * {cross(b, c, 'v', 'w')} - v{a} * {cross(b, c, 'u', 'w')} + w{a} * {cross(b, c, 'u', 'v')})"
    normal = [f"-({' + '.join(cross(p, q, x, y) for p, q in ((b, c), (c, a), (a, b)))})" for x, y in (("v", "w"), ("w", "u"), ("u", "v"))]
    return "CASE " + " ".join(f"WHEN {x} > 0 THEN {turn} WHEN {x} < 0 THEN {-turn}" for x in (det, *normal)) + f" ELSE {turn} END"


_SIDES = [f"({_side_sql(*k, turn)})" for k, turn in (("bcd", -1), ("acd", 1), ("abd", -1), ("abc", 1))]
_IN = f"({_SIDES[0]} = {_SIDES[1]} AND {_SIDES[1]} = {_SIDES[2]} AND {_SIDES[2]} = {_SIDES[3]})"


def _volume(spark, sf_dir):
    from .operators import volume

    f, g = volume.volume_view(spark, sf_dir)
    cols = ("u", "v", "w")
    return to_fixed(f, fixed_scale(f, cols, volume.NBITS), cols), g


@query(f"WITH {_tet_sql()} SELECT t, i, j, tet, a, b, c, d FROM mm WHERE {_IN}")
def volume_cp_tetrahedra(spark, sf_dir):
    from .operators import volume

    p, g = _volume(spark, sf_dir)
    return volume.with_zero(volume.tetrahedra(p, g)).select("t", "i", "j", "tet", "a", "b", "c", "d")


@query()
def volume_cp_types(spark, sf_dir):
    from .operators import volume

    p, g = _volume(spark, sf_dir)
    return volume.volume_points(p, g).groupBy("type").agg(F.count("*").alias("n"))


def _tet_bound_sql() -> str:
    same = lambda x: f"CASE WHEN (u0 > 0 AND u1 > 0 AND u2 > 0 AND u3 > 0) OR (u0 < 0 AND u1 < 0 AND u2 < 0 AND u3 < 0) THEN abs(u3) ELSE 0 END".replace("u0", x + "a").replace("u1", x + "b").replace("u2", x + "c").replace("u3", x + "d")  # noqa: E731, F541
    pair = lambda p, q: f"(abs(v{p} * w{q} - w{p} * v{q}) + abs(u{p} * w{q} - w{p} * u{q}) + abs(u{p} * v{q} - v{p} * u{q}))"
    area = " + ".join(f"abs(({x}b - {x}a) * ({y}c - {y}a) - ({x}c - {x}a) * ({y}b - {y}a))" for x, y in ("vw", "uw", "uv"))
    return f"""{_tet_sql()}, sd AS (SELECT *, greatest({same('u')}, {same('v')}, {same('w')}) AS same, {pair('b', 'c')} AS d0, {pair('a', 'c')} AS d1, {pair('a', 'b')} AS d2, {area} AS d3 FROM mm)
    SELECT t, i, j, tet, CASE WHEN m0 + m1 + m2 + m3 = 0 OR (same = 0 AND (d0 = 0 OR d1 = 0 OR d2 = 0)) THEN 0 WHEN same > 0 THEN same
      ELSE least(abs(m0 + m1 + m2 + m3) // greatest(d3, 1), abs(m0) // greatest(d0, 1), abs(m1) // greatest(d1, 1), abs(m2) // greatest(d2, 1)) END AS eb FROM sd"""


@query(f"WITH {_tet_bound_sql()}")
def volume_tet_bound(spark, sf_dir):
    from .operators import volume

    p, g = _volume(spark, sf_dir)
    return volume.tetrahedra(p, g).select("t", "i", "j", "tet", volume.tetrahedron_bound().alias("eb"))


@query(f"WITH {_tet_sql()} SELECT ((t * 525 + i * 21 + j) * 6 + tet)::BIGINT AS tid FROM mm WHERE {_IN}")
def unstructured_cp(spark, sf_dir):
    """The volume's tetrahedra again, as an unstructured mesh of its own tables."""
    from .operators import volume

    p, g = _volume(spark, sf_dir)
    made = volume.tetrahedra(p, g).select((g.vid() * 6 + F.col("tet")).alias("tid"), F.posexplode(F.array(*"abcd")).alias("pos", "pid"))
    data = p.select(g.vid().alias("pid"), "u", "v", "w")
    return volume.with_zero(volume.unstructured(written(made, "tets"), data)).select("tid")


# --- streams ------------------------------------------------------------------------------------------


def _stream(spark, sf_dir, make):
    from .streaming import frames as fr

    p, g, _ = fixed(spark, sf_dir)
    at = scratch(spark, "stream")
    fr.frames(p).repartitionByRange(8, "t").write.parquet(f"{at}/in")
    return fr.run_to_end(make(fr.read_frames(spark, f"{at}/in", 3), g), f"{at}/out", f"{at}/state")


@query(f"WITH {LAYER_SQL} SELECT t, count(*) AS n FROM fa WHERE {ZERO} GROUP BY 1")
def stream_layer_counts(spark, sf_dir):
    from .streaming.frames import layer_counts

    return _stream(spark, sf_dir, layer_counts).select("t", "n")


@query(f"WITH {FIELD}, d AS (SELECT a.t, abs(a.u - coalesce(b.u, 0)) AS x, abs(a.v - coalesce(b.v, 0)) AS y FROM p a LEFT JOIN p b ON b.t = a.t - 1 AND b.i = a.i AND b.j = a.j) SELECT t, sum(x + y)::BIGINT AS sum_abs, max(greatest(x, y)) AS max_abs FROM d GROUP BY 1")
def stream_frame_changes(spark, sf_dir):
    from .streaming.frames import frame_changes

    return _stream(spark, sf_dir, lambda s, g: frame_changes(s)).select("t", "sum_abs", "max_abs")


@query(_KEPT_SQL.format("true"))
def stream_encoder(spark, sf_dir):
    """The codec on a stream of frames of the smoothed view, in blocks of four frames; what it gives decodes as a table's blocks do."""
    from .streaming import encoder
    from .streaming.frames import run_to_end

    field, g = smooth_view(spark, sf_dir), view_grid(spark, sf_dir)
    s, block, at = fixed_scale(field), codec.block_of(g, (6, 12, 12)), scratch(spark, "stream")
    eb = codec.bound_for(s, 0.002)
    encoder.real_frames(field).repartitionByRange(8, "t").write.parquet(f"{at}/in")
    coded = encoder.encode_stream(encoder.read_real_frames(spark, f"{at}/in", 3), (g.H, g.W), s, eb, block, g.T)
    blocks = run_to_end(coded, f"{at}/out", f"{at}/state")
    return _checked(field, g, s, eb, blocks, codec.decode(blocks.drop("field"), g, s, block=block))


@query("SELECT date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1")
def events_by_day(spark, sf_dir):
    from .streaming.frames import windowed_events

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "value")
    return windowed_events(e).select("day", "n", F.round("total", 6).alias("total"))


# --- block choices and bilinear cells -----------------------------------------------------------------


@query(f"""WITH {_MODES_SQL}, en AS (SELECT t, i, j, 0 AS mode, u - {_L3.format('u')} AS r FROM st UNION ALL SELECT t, i, j, 0, v - {_L3.format('v')} FROM st UNION ALL SELECT t, i, j, 1, u - u_pred FROM ad UNION ALL SELECT t, i, j, 1, v - v_pred FROM ad),
    qq AS (SELECT t, i // 8 AS bi, j // 8 AS bj, mode, CASE WHEN r < 0 THEN -((abs(r) // {_STEP} + 1) // 2) ELSE (abs(r) // {_STEP} + 1) // 2 END AS q FROM en),
    bb AS (SELECT t, bi, bj, mode, entropy(q) AS bits FROM qq GROUP BY ALL),
    w AS (SELECT t, bi, bj, max(bits) FILTER (mode = 0) AS base, min(bits) AS best, arg_min(mode, bits) AS m FROM bb GROUP BY ALL)
    SELECT t, bi, bj, CASE WHEN (base - best) / (base + 1e-12) >= 0.003 THEN m ELSE 0 END AS mode FROM w""")
def block_mode_entropy(spark, sf_dir):
    p, g, s = fixed(spark, sf_dir)
    return predict.entropy_modes({0: predict.predicted(p, "lorenzo3d"), 1: predict.advected(p, g, s.factor)}, _STEP, 8)


@query()
def regression_or_lorenzo(spark, sf_dir):
    p, _, _ = fixed(spark, sf_dir)
    return predict.regression_or_lorenzo(p, "u", 8, _STEP)


@query()
def volume_regression(spark, sf_dir):
    p, _, _ = fixed(spark, sf_dir)
    return rounded(predict.volume_regression(p, "u", 6), 3)


@query()
def bilinear_cp(spark, sf_dir):
    p, g, _ = fixed(spark, sf_dir)
    return rounded(critical.bilinear_points(p, g))


@query(f"WITH {_SYMBOLS_SQL}, b AS (SELECT floor(r / {4 * _STEP}.0::DOUBLE) AS b, count(*) AS n FROM sy GROUP BY 1) SELECT (arg_max(b, n * 1e9 - b) + 0.5) * {4 * _STEP} AS mid, max(n) / sum(n) AS share FROM b")
def dense_interval(spark, sf_dir):
    return coding.dense_interval(_symbols(spark, sf_dir), "r", 4.0 * _STEP)


@query(f"WITH {_EVENTS} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, x AS sym FROM ev")
def huffman_streams(spark, sf_dir):
    """Each user's symbols, coded and decoded."""
    e = _events(spark, sf_dir)
    return coding.huffman_decode(coding.huffman_encode(e, "user_id", "event_id", "x"), coding.huffman_table(coding.frequencies(e, "x")), "user_id")


@query("SELECT (count(*) // 25 * 525)::BIGINT AS n, 0::BIGINT AS n_bound_violations, 0::BIGINT AS fp, 0::BIGINT AS fn FROM embeddings")
def roundtrip_volume(spark, sf_dir):
    """As the other round trips, for tetrahedra of the volume view; the last three are 0 by the codec's guarantee."""
    from .operators import volume

    cols = ("u", "v", "w")
    f, g = volume.volume_view(spark, sf_dir)
    s = fixed_scale(f, cols, volume.NBITS)
    eb = codec.bound_for(s, EB)
    d = codec.decode(codec.encode(f, g, s, eb, guard="tetrahedra", cols="uvw"), g, s, cols="uvw")
    p, q = to_fixed(f, s, cols), d.select("t", "i", "j", *(F.col(f"{c}fp").alias(c) for c in cols))
    both = p.join(q.withColumnsRenamed({c: c + "d" for c in cols}), ["t", "i", "j"])
    far = F.greatest(*(F.abs(F.col(c) - F.col(c + "d")) for c in cols)) > eb
    count = both.agg(F.count("*").alias("n"), F.sum(far.cast("long")).alias("n_bound_violations"))
    keys = ["t", "i", "j", "tet"]
    a = volume.with_zero(volume.tetrahedra(p, g)).select(*keys, F.lit(1).alias("x"))
    b = volume.with_zero(volume.tetrahedra(q, g)).select(*keys, F.lit(1).alias("y"))
    flips = a.join(b, keys, "full_outer").agg(F.coalesce(F.sum(F.col("x").isNull().cast("long")), F.lit(0)).alias("fp"), F.coalesce(F.sum(F.col("y").isNull().cast("long")), F.lit(0)).alias("fn"))
    return count.crossJoin(flips)


@query("SELECT (count(*) // 25 * 800)::BIGINT AS n, 0::BIGINT AS flipped FROM embeddings")
def roundtrip_layers(spark, sf_dir):
    """The per-frame baseline: only faces within a frame are guarded, by 2D Lorenzo in blocks of one frame."""
    field, g = field_view(spark, sf_dir), view_grid(spark, sf_dir)
    s, block = fixed_scale(field), codec.block_of(g, (1, 12, 12))
    d = codec.decode(codec.encode(field, g, s, codec.bound_for(s, EB), "lorenzo2d", block, guard="layers"), g, s, "lorenzo2d", block)
    both = cut(_beside(field, d, s))
    flips = verify.marked_faces(both, g, mesh.FACES[:2]).agg(F.sum((F.col("ori") != F.col("dec")).cast("long")).alias("flipped"))
    return both.agg(F.count("*").alias("n")).crossJoin(flips)


# --- relative bounds ----------------------------------------------------------------------------------


def _relative(spark, sf_dir):
    p, g, s = fixed(spark, sf_dir)
    f = mesh.layer_faces(p, g)
    named = [(F.col(x + n).cast("double") / float(s.factor)).alias(x + str(k)) for k, n in enumerate("abc") for x in "uv"]
    return f.select("tmpl", "a", "b", "c", *named)


_RELATIVE_SQL = f"{LAYER_SQL}, rf AS (SELECT tmpl, a, b, c, {', '.join(f'{x}{n}::DOUBLE / (1::BIGINT << shift) AS {x}{k}' for k, n in enumerate('abc') for x in 'uv')} FROM fa, sc)"


def _relative_query(name: str, bound: str, typed: bool = False):
    triangles = {1: relative.columns(True if typed else None), 2: relative.columns(False if typed else None)}
    parts = " UNION ALL ".join(f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in made.items())} FROM rf WHERE tmpl = {k}" for k, made in triangles.items())

    @query(f"WITH {_RELATIVE_SQL}, pn AS ({parts}) SELECT a, b, c, round({bound}, 9) AS eb FROM pn", name)
    def run(spark, sf_dir):
        rows = _relative(spark, sf_dir)
        both = [rows.filter(F.col("tmpl") == k).withColumns({c: F.expr(e) for c, e in made.items()}) for k, made in triangles.items()]
        return both[0].unionByName(both[1]).select("a", "b", "c", F.round(F.expr(bound), 9).alias("eb"))


_relative_query("relative_bound_offline", relative.offline_bound())
_relative_query("relative_bound_typed", relative.offline_bound(True), True)
_relative_query("relative_bound_online", relative.online_bound())


@query()
def roundtrip_relative(spark, sf_dir):
    """Pointwise relative coding: vertices, and those beyond one percent of their value."""
    field, g = field_view(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in "uv"}), view_grid(spark, sf_dir)
    blocks, s = codec.encode_relative(field, g, 0.01)
    back = codec.decode(blocks, g, s, log=True, kind="double")
    both = field.join(back.select("t", "i", "j", F.col("u").alias("x"), F.col("v").alias("y")), ["t", "i", "j"])
    far = (F.abs(F.col("u") - F.col("x")) > 0.01 * F.abs("u")) | (F.abs(F.col("v") - F.col("y")) > 0.01 * F.abs("v"))
    return both.agg(F.count("*").alias("n"), F.sum(far.cast("long")).alias("n_bound_violations"))


SQL["roundtrip_relative"] = "SELECT (count(*) // 25 * 800)::BIGINT AS n, 0::BIGINT AS n_bound_violations FROM embeddings"


def _volume_bound_sql() -> str:
    body = _tet_bound_sql()
    cte, final = body[: body.index("sd AS (SELECT")], body[body.index("sd AS (SELECT") :]
    roles = []
    for me in "abcd":
        order = [n for n in "abcd" if n != me] + [me]
        det = lambda *k: "(u{0} * (v{1} * w{2} - w{1} * v{2}) - v{0} * (u{1} * w{2} - w{1} * u{2}) + w{0} * (u{1} * v{2} - v{1} * u{2}))".format(*k)
        p, q, r, s = order
        names = ", ".join(f"{x}{old} AS {x}{new}" for new, old in zip("abcd", order, strict=True) for x in "uvw")
        roles.append(f"SELECT {me} AS vid, {_IN} AS zero, {names}, -{det(q, r, s)} AS m0, {det(p, r, s)} AS m1, -{det(p, q, s)} AS m2, {det(p, q, r)} AS m3 FROM mm")
    final = final.replace("FROM mm)", "FROM rl)").replace("SELECT t, i, j, tet, CASE", "SELECT vid, zero, CASE")
    final = final.replace("\n    SELECT vid, zero, CASE", ", ebs AS (SELECT vid, zero, CASE")
    most = f"(SELECT trunc({EB} * (1::BIGINT << shift))::BIGINT FROM sc)"
    return f"{cte} rl AS ({' UNION ALL '.join(roles)}), {final}) SELECT vid AS pid, least(min(CASE WHEN zero THEN 0 ELSE eb END), {most})::BIGINT AS required_eb FROM ebs GROUP BY 1"


@query(f"WITH {_volume_bound_sql()}")
def volume_vertex_bound(spark, sf_dir):
    from .operators import volume

    f, g = volume.volume_view(spark, sf_dir)
    cols = ("u", "v", "w")
    s = fixed_scale(f, cols, volume.NBITS)
    return volume.vertex_bounds(volume.tetrahedra(to_fixed(f, s, cols), g), S.absolute_bound(EB, s.factor))


# --- relative bounds of tetrahedra and bilinear cells -----------------------------------------------------


def _real_volume(spark, sf_dir):
    from .operators import volume

    f, g = volume.volume_view(spark, sf_dir)
    return f.withColumns({c: F.col(c).cast("double") for c in "uvw"}), g


def _real_tets(spark, sf_dir):
    from .operators import volume

    f, g = _real_volume(spark, sf_dir)
    return volume.relative_rows(volume.tetrahedra(f, g))


def _real_tet_sql() -> str:
    names = ", ".join(f"{x}{n}::DOUBLE AS {x}{k}" for k, n in enumerate("abcd") for x in "uvw")
    base = _tet_sql()
    base = base[: base.index("p AS (SELECT")] + "p AS (SELECT t, i, j, (t * 525 + i * 21 + j)::BIGINT AS vid, u, v, w FROM f), " + base[base.index("tm(tet") : base.index("mm AS (")]
    made = ", ".join(f"{e} AS {c}" for c, e in relative.tetrahedron_columns().items())
    return f"{base} rt AS (SELECT t, i, j, tet, a, b, c, d, {names} FROM te), rk AS (SELECT *, {made} FROM rt)"


def _tet_relative_query(name: str, bound: str):
    @query(f"WITH {_real_tet_sql()} SELECT t, i, j, tet, round({bound}, 9) AS eb FROM rk", name)
    def run(spark, sf_dir):
        return _real_tets(spark, sf_dir).select("t", "i", "j", "tet", F.round(F.expr(bound), 9).alias("eb"))


_tet_relative_query("volume_relative_offline", relative.tetrahedron_offline_bound())
_tet_relative_query("volume_relative_online", relative.tetrahedron_online_bound())


def _cell_sql() -> str:
    at = [(0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1)]
    joins = " ".join(f"JOIN f n{k} ON n{k}.t = o.t AND n{k}.i = o.i + {b} AND n{k}.j = o.j + {c}" for k, (_, b, c) in enumerate(at))
    cols = ", ".join(f"n{k}.{x}::DOUBLE AS {x}{k}" for k in range(4) for x in "uv")
    return f"{FIELD}, ce AS (SELECT o.t, o.i, o.j, {cols} FROM f o {joins})"


@query(f"WITH {_cell_sql()} SELECT t, i, j, round({relative.bilinear_online_bound()}, 9) AS eb FROM ce")
def bilinear_relative_online(spark, sf_dir):
    from .grid import neighbours

    f = field_view(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in "uv"})
    cells = neighbours(f, ["u", "v"], [(0, 0, 1), (0, 1, 0), (0, 1, 1)]).filter("u_2 is not null")
    named = cells.select("t", "i", "j", *(F.col(x if not k else f"{x}_{k - 1}").alias(f"{x}{k}") for k in range(4) for x in "uv"))
    return named.select("t", "i", "j", F.round(F.expr(relative.bilinear_online_bound()), 9).alias("eb"))


@query(f"WITH {_tet_bound_sql().replace('(19 - ceil', '(28 - ceil').replace('::BIGINT AS u,', '::HUGEINT AS u,').replace('::BIGINT AS v,', '::HUGEINT AS v,').replace('::BIGINT AS w FROM', '::HUGEINT AS w FROM').replace('END AS eb', 'END::BIGINT AS eb')}")
def volume_tet_bound_wide(spark, sf_dir):
    """volume_tet_bound with 28 bits, in decimals."""
    from .operators import volume

    f, g = volume.volume_view(spark, sf_dir)
    cols = ("u", "v", "w")
    p = to_fixed(f, fixed_scale(f, cols, 28), cols)
    return volume.tetrahedra(p, g).select("t", "i", "j", "tet", volume.tetrahedron_bound("decimal(10,0)").cast("long").alias("eb"))


def _volume_roundtrip(label: str, offline: bool):
    """Three real components within a tenth of themselves, and tetrahedra that win or lose a zero: none of either."""

    @query("SELECT (count(*) // 25 * 525)::BIGINT AS n, 0::BIGINT AS n_bound_violations, 0::BIGINT AS flipped FROM embeddings", label)
    def run(spark, sf_dir):
        from .operators import volume

        field, g = _real_volume(spark, sf_dir)
        rows, limit, guard = field, None, "relative_tetrahedra"
        if offline:
            bounds = volume.relative_vertex_bounds(volume.tetrahedra(field, g))
            rows = field.withColumn("pid", g.vid()).join(bounds, "pid").withColumn("limit", codec.relative_limit(F.col("share")))
            limit, guard = "limit", "none"
        blocks, s = codec.encode_relative(rows, g, 0.1, guard=guard, cols="uvw", limit=limit)
        back = cut(codec.decode(blocks, g, s, cols="uvw", log=True, kind="double").select("t", "i", "j", "u", "v", "w"))
        both = field.join(back.withColumnsRenamed({c: "d" + c for c in "uvw"}), ["t", "i", "j"])
        far = F.greatest(*(F.abs(F.col(c) - F.col("d" + c)) - 0.1 * F.abs(c) for c in "uvw")) > 0
        zeros = lambda f, name: volume.real_zeros(volume.tetrahedra(f, g)).select("t", "i", "j", "tet", F.lit(1).alias(name))
        flips = zeros(field, "a").join(zeros(back, "b"), ["t", "i", "j", "tet"], "full_outer").agg(_count(F.col("a").isNull() | F.col("b").isNull()).alias("flipped"))
        return both.agg(F.count("*").alias("n"), _count(far).alias("n_bound_violations")).crossJoin(flips)


_volume_roundtrip("relative_volume_offline", True)
_volume_roundtrip("relative_volume_online", False)


@query("SELECT (count(*) // 25 * 525)::BIGINT AS n, 0::BIGINT AS n_bound_violations, 0::BIGINT AS flipped FROM embeddings")
def relative_unstructured(spark, sf_dir):
    """As relative_volume_offline, on the volume's tetrahedra as an unstructured mesh: points in order of their ids, each predicted by the one before."""
    from .operators import volume

    field, g = _real_volume(spark, sf_dir)
    tets = volume.tetrahedra(field, g).select((g.vid() * 6 + F.col("tet")).alias("tid"), F.posexplode(F.array(*"abcd")).alias("pos", "pid"))
    tets = written(tets, "tets")
    data = field.select(g.vid().alias("pid"), "u", "v", "w")
    back = cut(volume.decode_points(*volume.encode_points(tets, data, 0.1)))
    both = data.join(back.withColumnsRenamed({c: "d" + c for c in "uvw"}), "pid")
    far = F.greatest(*(F.abs(F.col(c) - F.col("d" + c)) - 0.1 * F.abs(c) for c in "uvw")) > 0
    zeros = lambda d, name: volume.real_zeros(volume.unstructured(tets, d)).select("tid", F.lit(1).alias(name))
    flips = zeros(data, "a").join(zeros(back, "b"), "tid", "full_outer").agg(_count(F.col("a").isNull() | F.col("b").isNull()).alias("flipped"))
    return both.agg(F.count("*").alias("n"), _count(far).alias("n_bound_violations")).crossJoin(flips)


from . import source_queries  # noqa: E402, F401  registers its queries here
