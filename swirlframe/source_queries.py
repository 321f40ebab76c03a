"""Registered queries of sources and sinks (what is written is read back), of single functions, and SQL of queries that are long in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalars as S
from .functions import triangles
from .grid import field_view, fixed_scale, smooth_view, to_fixed, view_grid
from .operators import critical, mesh, predict, verify
from .plans import codec
from .plans.checkpoints import cut, scratch
from .queries import (
    _beside, _checked, _COMPONENTS_SQL, _count, _IN, _KEPT_SQL, _L3, _Q, EB, FACES_SQL, FIELD, LAYER_SQL, POINTS_SQL, SQL, VERTEX_SQL, ZERO, _quantized, _stencil_sql, _tet_sides_sql, _tet_sql, _zero, fixed, query, rounded,
)
from .sources import amira, netcdf, raw, reports

# --- sources and sinks --------------------------------------------------------------------------------


def _view(spark, sf_dir):
    return field_view(spark, sf_dir), view_grid(spark, sf_dir)


def _raw_files(spark, sf_dir):
    f, g = _view(spark, sf_dir)
    at = scratch(spark, "raw")
    sizes = {c: raw.write_raw(f, c, f"{at}/{c}.bin") for c in "uv"}
    return at, g, sizes


_FIELD_ROWS = f"WITH {FIELD} SELECT t, i, j, u::DOUBLE AS u, v::DOUBLE AS v FROM f"


def _doubles(df):
    return df.select("t", "i", "j", F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))


@query(_FIELD_ROWS)
def raw_field(spark, sf_dir):
    at, g, _ = _raw_files(spark, sf_dir)
    return raw.read_field(spark, f"{at}/u.bin", f"{at}/v.bin", g)


@query(f"WITH {FIELD}, d AS (SELECT t, i, j, u::DOUBLE AS u, v::DOUBLE AS v FROM f) SELECT t, i, j, CASE WHEN abs(u) < 0.05 THEN 0 ELSE u END AS u, CASE WHEN abs(v) < 0.05 THEN 0 ELSE v END AS v FROM d")
def raw_field_zeroed(spark, sf_dir):
    at, g, _ = _raw_files(spark, sf_dir)
    return raw.read_field(spark, f"{at}/u.bin", f"{at}/v.bin", g, eps=0.05)


@query(f"WITH {FIELD} SELECT t, i, j, u::DOUBLE AS u FROM f WHERE t = 3")
def raw_frame(spark, sf_dir):
    at, g, _ = _raw_files(spark, sf_dir)
    return raw.read_frame(spark, f"{at}/u.bin", g, 3).select("t", "i", F.posexplode("u").alias("j", "u"))


@query("SELECT c AS component, (count(*) // 25 * 3200)::BIGINT AS bytes FROM embeddings, (VALUES ('u'), ('v')) x(c) GROUP BY 1")
def raw_bytes(spark, sf_dir):
    at, _, _ = _raw_files(spark, sf_dir)
    files = spark.read.format("binaryFile").load(f"{at}/*.bin").select("path", "length")
    return files.groupBy(F.substring_index(F.substring_index(F.substring_index("path", "/", -2), "/", 1), ".", 1).alias("component")).agg(F.sum("length").alias("bytes"))


@query(f"WITH {FIELD} SELECT t, i, j, u::DOUBLE AS u FROM f WHERE t = 2")
def frame_slice(spark, sf_dir):
    return raw.frame_slice(field_view(spark, sf_dir), 2).select("t", "i", "j", F.col("u").cast("double").alias("u"))


@query(f"WITH {FIELD} SELECT 0 AS component, j, i, t, u::DOUBLE AS value FROM f UNION ALL SELECT 1, j, i, t, v FROM f")
def repacked_field(spark, sf_dir):
    return raw.repacked(field_view(spark, sf_dir)).withColumn("value", F.col("value").cast("double"))


@query("SELECT (count(*) // 25 * 800)::BIGINT AS n_points, (count(*) // 25 * 1600)::BIGINT AS n_values FROM embeddings")
def image_file(spark, sf_dir):
    f, g = _view(spark, sf_dir)
    at = f"{scratch(spark, 'image')}.vti"
    raw.write_image(f, g, at)
    lines = spark.read.text(at)
    ends = F.split(F.regexp_extract("value", 'WholeExtent="([^"]*)"', 1), " ")
    whole = lines.filter("value like '<ImageData%'").select(((ends[1].cast("long") + 1) * (ends[3].cast("long") + 1) * (ends[5].cast("long") + 1)).alias("n_points"))
    return whole.crossJoin(lines.filter("value not like '<%'").agg(F.sum(F.size(F.split("value", " "))).alias("n_values")))


@query(f"WITH {FIELD} SELECT t, i, j, 0 AS component, u::DOUBLE AS value FROM f UNION ALL SELECT t, i, j, 1, v FROM f")
def amira_values(spark, sf_dir):
    f, g = _view(spark, sf_dir)
    at = f"{scratch(spark, 'amira')}.am"
    amira.write_amira(f, g, at)
    return amira.read_amira(spark, at).select("t", "i", F.posexplode("values").alias("j", "value"), "component")


@query(_FIELD_ROWS)
def amira_field(spark, sf_dir):
    f, g = _view(spark, sf_dir)
    at = f"{scratch(spark, 'amira')}.am"
    amira.write_amira(f, g, at, "ascii")
    return amira.read_amira_field(spark, at).drop("path")


@query(f"WITH {FIELD} SELECT t, i, j, v::DOUBLE AS v FROM f")
def amira_component(spark, sf_dir):
    """One component of a lattice, written as raw floats."""
    f, g = _view(spark, sf_dir)
    at = scratch(spark, "amira")
    amira.write_amira(f, g, f"{at}/a.am")
    raw.write_raw(amira.component(amira.read_amira(spark, f"{at}/a.am"), 1, "v"), "v", f"{at}/v.bin")
    return raw.read_rows(spark, f"{at}/v.bin", g, "v").select("t", "i", F.posexplode("v").alias("j", "v"))


@query(f"WITH {FIELD}, d AS (SELECT t, i, j, u::DOUBLE AS u, v::DOUBLE AS v FROM f) SELECT t, i, j, CASE WHEN u > 0.2 THEN 0 ELSE u END AS u, v FROM d")
def netcdf_field(spark, sf_dir):
    """A file whose masked cells, here those above 0.2, read as 0."""
    f, g = _view(spark, sf_dir)
    at = f"{scratch(spark, 'netcdf')}.nc"
    netcdf.write_netcdf(f.withColumn("u", F.when(F.col("u").cast("double") > 0.2, F.lit(None)).otherwise(F.col("u"))), g, at, -9999.0)
    return _doubles(netcdf.read_netcdf_field(spark, at))


@query(f"WITH {POINTS_SQL} SELECT t, simplex_id, x, y, type FROM pt")
def cp_records(spark, sf_dir):
    p, g, _ = fixed(spark, sf_dir)
    at = scratch(spark, "points")
    reports.write_points(critical.layer_points(p, g), at)
    return rounded(reports.read_points(spark, at).select("t", "simplex_id", "x", "y", "type"))


@query(f"WITH {LAYER_SQL} SELECT count(*) FILTER ({ZERO}) AS n FROM fa GROUP BY t HAVING t <= (SELECT max(t) FROM fa WHERE {ZERO})")
def cp_count_lines(spark, sf_dir):
    p, g, _ = fixed(spark, sf_dir)
    at = scratch(spark, "counts")
    reports.write_counts(critical.count_by_layer(mesh.zero_faces(p, g, mesh.FACES[:2])), at)
    return reports.read_counts(spark, at)


SQL["confusion_file"] = SQL["cp_confusion"].replace("GROUP BY GROUPING SETS ((region, idx), (region))", "GROUP BY region").replace("SELECT region, idx, count(*) FILTER (ori AND dec)", "SELECT region, count(*) FILTER (ori AND dec)")


@query(SQL["confusion_file"])
def confusion_file(spark, sf_dir):
    q, g, _ = _quantized(spark, sf_dir)
    at = scratch(spark, "confusion")
    reports.write_confusion(verify.confusion(verify.marked_faces(q, g)), at)
    return reports.confusion_sums(reports.read_confusion(spark, at))


@query("SELECT count(*) AS n, sum(floor(value)::BIGINT)::BIGINT AS total FROM events WHERE event_id % 3 <> 0 AND value IS NOT NULL")
def numbers_with_skip(spark, sf_dir):
    """Lines of text of which a third are no numbers."""
    e, at = spark.read.parquet(f"{sf_dir}/events.parquet"), scratch(spark, "numbers")
    e.select(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), "event_type")).otherwise(F.coalesce(F.floor("value").cast("string"), F.lit(""))).alias("value")).write.text(at)
    return reports.read_counts(spark, at).agg(F.count("*").alias("n"), F.sum("n").alias("total"))


_SIZES_SQL = _COMPONENTS_SQL.replace("SELECT component, count(*) AS n_faces FROM cc GROUP BY 1", "SELECT n_faces AS n_points, count(*) AS n FROM (SELECT component, count(*) AS n_faces FROM cc GROUP BY 1) GROUP BY 1")


@query(f"WITH RECURSIVE {FACES_SQL}, {_tet_sides_sql()}, {_SIZES_SQL}")
def polydata_file(spark, sf_dir):
    """Trajectories as VTK lines: how many have how many points."""
    at = f"{scratch(spark, 'curves')}.vtp"
    reports.write_polydata(critical.ordered_curves(*_zero(spark, sf_dir)), at, parts=True)
    return reports.read_polydata(spark, at).groupBy("line").agg(F.count("*").alias("n_points")).groupBy("n_points").agg(F.count("*").alias("n"))


# --- single functions ---------------------------------------------------------------------------------


@query(f"WITH {LAYER_SQL} SELECT a, b, c, sign(ua) <> 0 AND sign(ua) = sign(ub) AND sign(ub) = sign(uc) AS same_u, sign(va)::INT AS sign_v FROM fa")
def face_signs(spark, sf_dir):
    p, g, _ = fixed(spark, sf_dir)
    return mesh.layer_faces(p, g).select("a", "b", "c", S.same_sign(F.col("ua"), F.col("ub"), F.col("uc")).alias("same_u"), S.sign(F.col("va")).alias("sign_v"))


@query(f"WITH {FACES_SQL} SELECT a // 800 = b // 800 AND b // 800 = c // 800 AS one_frame, count(*) AS n FROM fa WHERE {ZERO} GROUP BY 1")
def ordinal_faces(spark, sf_dir):
    zero, g = _zero(spark, sf_dir)
    t = [g.coordinates(x)[0] for x in "abc"]
    return zero.select(triangles.ordinal(*t).alias("one_frame")).groupBy("one_frame").agg(F.count("*").alias("n"))


def _real_bounds(spark, sf_dir):
    p, g, s = fixed(spark, sf_dir)
    return critical.vertex_bounds(p, g, S.absolute_bound(EB, s.factor)).withColumn("eb", F.col("required_eb") / float(s.factor))


@query(f"WITH {VERTEX_SQL}, r AS (SELECT vid, required_eb::DOUBLE / (1::BIGINT << shift) AS eb FROM vb, sc) SELECT vid, floor(eb / 0.001)::INT AS id, round(floor(eb / 0.001) * 0.001, 9) AS bound, round(eb * 8, 9) AS relaxed, round(eb / 2, 9) AS halved FROM r")
def bounds_linear(spark, sf_dir):
    b = _real_bounds(spark, sf_dir)
    id_, eb = S.quantize_linear(F.col("eb"), 0.001)
    return b.select("vid", id_.alias("id"), F.round(eb, 9).alias("bound"), F.round(S.relax(F.col("eb")), 9).alias("relaxed"), F.round(S.restrict(F.col("eb")), 9).alias("halved"))


@query(f"""WITH {FIELD}, {_stencil_sql(predict.PREDICTORS['lorenzo3d'][1])}, x AS (SELECT t, i, j, u, {_L3.format('u')} AS p, trunc({EB} * (1::BIGINT << shift))::BIGINT AS eb FROM st, sc),
    h AS (SELECT *, CASE WHEN u < p THEN -((abs(u - p) // eb + 1) // 2) ELSE (abs(u - p) // eb + 1) // 2 END AS half FROM x)
    SELECT t, i, j, half + 32768 AS code, CASE WHEN abs(u - p) // eb + 1 < 65536 AND abs(p + 2 * half * eb - u) <= eb THEN p + 2 * half * eb ELSE u END AS value, abs(u - p) // eb + 1 < 65536 AND abs(p + 2 * half * eb - u) <= eb AS ok FROM h""")
def quantized_values(spark, sf_dir):
    p, _, s = fixed(spark, sf_dir)
    r = predict.predicted(p, "lorenzo3d")
    code, value, ok = S.quantize_value(F.col("u"), F.col("u_pred"), F.lit(S.absolute_bound(EB, s.factor)).cast("long"))
    return r.select("t", "i", "j", code.alias("code"), value.alias("value"), ok.alias("ok"))


@query(f"WITH {FIELD} SELECT t, i, j, floor(log2(abs(u::DOUBLE)))::INT AS exponent, round(u::DOUBLE / 2.0 ** floor(log2(abs(u::DOUBLE))), 9) AS mantissa, trunc(u::DOUBLE * 128) / 128 AS short FROM f WHERE u <> 0")
def exponents(spark, sf_dir):
    f = field_view(spark, sf_dir).filter("u <> 0")
    return f.select("t", "i", "j", S.exponent(F.col("u")).alias("exponent"), F.round(S.mantissa(F.col("u")), 9).alias("mantissa"), S.shortened(F.col("u"), EB).alias("short"))


@query(f"WITH {FIELD} SELECT vid, CASE WHEN abs(u) <= 1 THEN 1 ELSE 1::BIGINT << length(ltrim(bin(abs(u) - 1), '0')) END AS power FROM p")
def powers_of_two(spark, sf_dir):
    p, g, _ = fixed(spark, sf_dir)
    return p.select(g.vid().alias("vid"), S.next_power_of_two(F.abs("u")).alias("power"))


@query(f"WITH {FACES_SQL} SELECT tmpl, count(*) AS n, (3 * count(*))::BIGINT AS visits FROM fa GROUP BY 1")
def face_coverage(spark, sf_dir):
    f, g = _view(spark, sf_dir)
    return verify.face_visits(g, f.select("t", "i", "j"))


@query(f"WITH {_tet_sql()}, k AS (SELECT (t * 525 + i * 21 + j) * 6 + tet AS tid, unnest([a, b, c, d]) AS pid FROM te) SELECT pid, count(*) AS n, min(tid)::BIGINT AS low, sum(tid)::BIGINT AS total FROM k GROUP BY 1")
def incident_tetrahedra(spark, sf_dir):
    from .operators import volume

    f, g = volume.volume_view(spark, sf_dir)
    made = volume.tetrahedra(f, g).select((g.vid() * 6 + F.col("tet")).alias("tid"), F.posexplode(F.array(*"abcd")).alias("pos", "pid"))
    found = volume.incident_index(made).select("pid", F.col("tets.tid").alias("tids"))
    return found.select("pid", F.size("tids").cast("long").alias("n"), F.array_min("tids").alias("low"), F.aggregate("tids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


# --- more of coding -----------------------------------------------------------------------------------


def _smooth_coded(spark, sf_dir, predictor, limit=None, **how):
    """(field, grid, scale, bound, blocks, decoded) of the smoothed view."""
    field, g = smooth_view(spark, sf_dir), view_grid(spark, sf_dir)
    s = fixed_scale(field)
    eb = codec.bound_for(s, 0.002)
    rows = field if limit is None else field.withColumn("limit", limit(g, eb))
    blocks = cut(codec.encode(rows, g, s, eb, predictor, limit=None if limit is None else "limit", **how))
    return field, g, s, eb, blocks, codec.decode(blocks, g, s, predictor)


@query(_KEPT_SQL.format("true"))
def smooth_legacy(spark, sf_dir):
    """The guard of the other triangulation, verified on that one."""
    field, g, s, eb, blocks, decoded = _smooth_coded(spark, sf_dir, "lorenzo3d", guard="legacy")
    return _checked(field, g, s, eb, blocks, decoded, mesh.LEGACY)


@query("SELECT (count(*) // 25 * 800)::BIGINT AS n, 0::BIGINT AS n_bound_violations, 0::BIGINT AS n_lossless_beyond, true AS smaller FROM embeddings")
def plain_point_bounds(spark, sf_dir):
    """Without a guard, in hyperplanes or Lorenzo, with a bound of each vertex: every third has half of it, every fifth none."""
    limit = lambda g, eb: F.when(g.vid() % 5 == 0, 0).when(g.vid() % 3 == 0, eb // 2).otherwise(eb)
    field, g, s, eb, blocks, decoded = _smooth_coded(spark, sf_dir, "plane", limit, guard="none")
    both = _beside(field, decoded, s).withColumn("limit", limit(g, eb))
    far = F.greatest(F.abs(F.col("u") - F.col("du")), F.abs(F.col("v") - F.col("dv")))
    return both.agg(F.count("*").alias("n"), _count(far > F.col("limit")).alias("n_bound_violations"), _count((F.col("limit") == 0) & (far > 0)).alias("n_lossless_beyond")).crossJoin(codec.statistics(blocks).select((F.col("ratio") > 1).alias("smaller")))


@query("SELECT (count(*) // 25 * 525)::BIGINT AS n, 0::BIGINT AS n_bound_violations, 0::BIGINT AS flipped FROM embeddings")
def roundtrip_volume_tried(spark, sf_dir):
    """Tetrahedra that win or lose a zero when bounds are tried: none."""
    from .operators import volume

    cols = ("u", "v", "w")
    f, g = volume.volume_view(spark, sf_dir)
    s = fixed_scale(f, cols, volume.NBITS)
    eb = codec.bound_for(s, EB)
    d = codec.decode(codec.encode(f, g, s, eb, guard="tried_tetrahedra", cols="uvw"), g, s, cols="uvw")
    p, q = to_fixed(f, s, cols), cut(d.select("t", "i", "j", *(F.col(f"{c}fp").alias(c) for c in cols)))
    far = F.greatest(*(F.abs(F.col(c) - F.col(c + "d")) for c in cols)) > eb
    count = p.join(q.withColumnsRenamed({c: c + "d" for c in cols}), ["t", "i", "j"]).agg(F.count("*").alias("n"), _count(far).alias("n_bound_violations"))
    zeros = lambda x, name: volume.with_zero(volume.tetrahedra(x, g)).select("t", "i", "j", "tet", F.lit(1).alias(name))
    return count.crossJoin(zeros(p, "a").join(zeros(q, "b"), ["t", "i", "j", "tet"], "full_outer").agg(_count(F.col("a").isNull() | F.col("b").isNull()).alias("flipped")))


@query("SELECT (count(*) // 25 * 800)::BIGINT AS n, 0::BIGINT AS n_bound_violations, true AS nearly_all_kept FROM embeddings")
def roundtrip_rotated(spark, sf_dir):
    """In decorrelated axes: errors of the field itself, and of its faces verified without rotation at most one in a hundred changed, by rounding."""
    field, g = smooth_view(spark, sf_dir), view_grid(spark, sf_dir)
    blocks, s, angle = codec.encode_rotated(field, g, 0.002)
    back = cut(codec.decode_rotated(blocks, g, s, angle))
    both = field.join(back.withColumnsRenamed({"u": "x", "v": "y"}), ["t", "i", "j"])
    far = F.pow(F.col("u") - F.col("x"), 2) + F.pow(F.col("v") - F.col("y"), 2) > 2 * 0.00201**2
    kept = codec.kept_after_rotation(field, back, g, fixed_scale(field)).select((F.col("lost") + F.col("new") <= 0.01 * F.col("n")).alias("nearly_all_kept"))
    return both.agg(F.count("*").alias("n"), _count(far).alias("n_bound_violations")).crossJoin(kept)


_BINS = "CASE WHEN abs({0}) = 0 THEN 0 WHEN abs({0}) = 1 THEN 1 WHEN abs({0}) <= 3 THEN 2 WHEN abs({0}) <= 15 THEN 3 WHEN abs({0}) <= 255 THEN 4 ELSE 5 END"


@query(SQL["block_mode_entropy"].replace("entropy(q) AS bits", f"entropy({_BINS.format('q')}) AS bits"))
def block_mode_bins(spark, sf_dir):
    p, g, s = fixed(spark, sf_dir)
    return predict.entropy_modes({0: predict.predicted(p, "lorenzo3d"), 1: predict.advected(p, g, s.factor)}, 1 << 22, 8, bins=True)


# --- planes -------------------------------------------------------------------------------------------

_PLANE_SQL = f"""{FIELD}, ps AS (SELECT t, i // 8 AS bi, j // 8 AS bj, sum(u)::DOUBLE AS s, sum(u * (i % 8))::DOUBLE AS sy, sum(u * (j % 8))::DOUBLE AS sx, max(i % 8)::DOUBLE + 1 AS h, max(j % 8)::DOUBLE + 1 AS w FROM p GROUP BY ALL),
    pb AS (SELECT *, CASE WHEN h > 1 THEN (sy - s * (h - 1) / 2) / (h * w * (h * h - 1) / 12) ELSE 0 END AS b0, CASE WHEN w > 1 THEN (sx - s * (w - 1) / 2) / (h * w * (w * w - 1) / 12) ELSE 0 END AS b1 FROM ps),
    pc AS (SELECT *, s / (h * w) - b0 * (h - 1) / 2 - b1 * (w - 1) / 2 AS b2 FROM pb),
    pp AS (SELECT p.t, p.i, p.j, p.u, round(b0 * (p.i % 8) + b1 * (p.j % 8) + b2)::BIGINT AS u_pred FROM p JOIN pc ON pc.t = p.t AND pc.bi = p.i // 8 AND pc.bj = p.j // 8)"""


@query(f"WITH {_PLANE_SQL} SELECT t, i, j, u_pred FROM pp")
def plane_prediction(spark, sf_dir):
    p, _, _ = fixed(spark, sf_dir)
    return predict.plane_predicted(p, "u", 8).select("t", "i", "j", "u_pred")


SQL["regression_or_lorenzo"] = f"""WITH {_PLANE_SQL}, {_stencil_sql(predict.PREDICTORS['lorenzo2d'][1])},
    k AS (SELECT t, i // 8 AS bi, j // 8 AS bj, abs(pp.u - u_pred) AS a, abs(st.u - (u010 + u001 - u011)) + {1 << 22} AS l FROM pp JOIN st USING (t, i, j) WHERE i % 8 = j % 8 OR i % 8 + j % 8 = 7)
    SELECT t, bi, bj, (sum(a) < sum(l))::INT AS mode FROM k GROUP BY ALL"""

SQL["volume_regression"] = f"""WITH {FIELD}, ps AS (SELECT t // 6 AS bt, i // 6 AS bi, j // 6 AS bj, sum(u)::DOUBLE AS s, {', '.join(f'sum(u * ({x} % 6))::DOUBLE AS s{x}, max({x} % 6)::DOUBLE + 1 AS n{x}' for x in 'tij')} FROM p GROUP BY ALL),
    pb AS (SELECT *, {', '.join(f'CASE WHEN n{x} > 1 THEN (s{x} - s * (n{x} - 1) / 2) / (nt * ni * nj * (n{x} * n{x} - 1) / 12) ELSE 0 END AS b{x}_' for x in 'tij')} FROM ps)
    SELECT bt, bi, bj, round(bt_, 3) AS b0, round(bi_, 3) AS b1, round(bj_, 3) AS b2, round(s / (nt * ni * nj) - bt_ * (nt - 1) / 2 - bi_ * (ni - 1) / 2 - bj_ * (nj - 1) / 2, 3) AS b3 FROM pb"""

# --- SQL of longer queries ----------------------------------------------------------------------------

_Q_POINTS = POINTS_SQL.replace("p AS (SELECT t, i, j,", "p0 AS (SELECT t, i, j,", 1).replace("FROM f, sc),", f"FROM f, sc), p AS (SELECT t, i, j, vid, (floor((u + {_Q}) / {2.0 * _Q}::DOUBLE) * {2 * _Q})::BIGINT AS u, (floor((v + {_Q}) / {2.0 * _Q}::DOUBLE) * {2 * _Q})::BIGINT AS v FROM p0),", 1)
SQL["cp_match_types"] = f"""SELECT CASE WHEN a.type IS NULL THEN 'new' WHEN b.type IS NULL THEN 'lost' WHEN a.type = b.type THEN 'matched' ELSE 'type changed' END AS class, count(*) AS n
    FROM (WITH {POINTS_SQL} SELECT t, simplex_id, type FROM pt) a FULL JOIN (WITH {_Q_POINTS} SELECT t, simplex_id, type FROM pt) b USING (t, simplex_id) GROUP BY 1"""


def _bilinear_sql() -> str:
    at = [(0, 0), (0, 1), (1, 0), (1, 1)]
    joins = " ".join(f"JOIN p n{k} ON n{k}.t = o.t AND n{k}.i = o.i + {b} AND n{k}.j = o.j + {c}" for k, (b, c) in enumerate(at))
    cols = ", ".join(f"n{k}.{x}::DOUBLE AS {x}{k}" for k in range(4) for x in "uv")
    place = "CASE WHEN abs(r + s * x) >= abs(m + n * x) THEN -(p + q * x) / CASE WHEN r + s * x = 0 THEN 1 ELSE r + s * x END ELSE -(k + l * x) / CASE WHEN m + n * x = 0 THEN 1 ELSE m + n * x END END"
    return f"""{FIELD}, c0 AS (SELECT o.t, o.i, o.j, {cols} FROM p o {joins}),
    c1 AS (SELECT *, u0 AS p, u1 - u0 AS q, u2 - u0 AS r, u0 - u1 - u2 + u3 AS s, v0 AS k, v1 - v0 AS l, v2 - v0 AS m, v0 - v1 - v2 + v3 AS n FROM c0),
    c2 AS (SELECT *, q * n - l * s AS a2, p * n + q * m - k * s - l * r AS a1, p * m - k * r AS a0 FROM c1),
    c3 AS (SELECT *, a1 * a1 - 4 * a2 * a0 AS disc FROM c2),
    c4 AS (SELECT *, unnest([CASE WHEN a2 = 0 THEN CASE WHEN a1 <> 0 THEN -a0 / a1 END WHEN disc >= 0 THEN (-a1 - sqrt(greatest(disc, 0))) / (2 * a2) END,
                             CASE WHEN a2 <> 0 AND disc > 0 THEN (-a1 + sqrt(greatest(disc, 0))) / (2 * a2) END]) AS x FROM c3),
    c5 AS (SELECT *, {place} AS y FROM c4 WHERE x IS NOT NULL),
    c6 AS (SELECT *, q + s * y AS ux, r + s * x AS uy, l + n * y AS vx, m + n * x AS vy FROM c5 WHERE x >= 0 AND x < 1 AND y >= 0 AND y < 1),
    c7 AS (SELECT *, ux + vy AS tr, ux * vy - uy * vx AS det FROM c6)
    SELECT t, i, j, round(j + x, 6) AS x, round(i + y, 6) AS y, CASE WHEN tr * tr - 4.0::DOUBLE * det >= 0 THEN CASE WHEN det < 0 THEN 3 WHEN det = 0 THEN 0 WHEN tr < 0 THEN 1 ELSE 2 END
                     WHEN tr < 0 THEN 4 WHEN tr > 0 THEN 5 ELSE 6 END AS type FROM c7"""


SQL["bilinear_cp"] = f"WITH {_bilinear_sql()}"


def _volume_types_sql() -> str:
    axes = [[next(k for k in range(3) if mesh.CORNERS[b][k] != mesh.CORNERS[a][k]) for a, b in zip(chain, chain[1:], strict=False)] for chain in mesh.TETRAHEDRA]
    r = {}
    for axis, name in ((2, "x"), (1, "y"), (0, "z")):
        for c in "uvw":
            r[c + name] = "CASE tet " + " ".join(f"WHEN {k} THEN ({c}{'abcd'[a.index(axis) + 1]} - {c}{'abcd'[a.index(axis)]})::DOUBLE" for k, a in enumerate(axes)) + " END"
    names = ", ".join(f"{e} AS {n}" for n, e in r.items())
    sg = lambda x: f"CASE WHEN {x} > 0 THEN 1 ELSE -1 END"
    return f"""{_tet_sql()}, ja AS (SELECT *, {names} FROM mm WHERE {_IN}),
    po AS (SELECT *, -(ux + vy + wz) AS a2, ux * vy - uy * vx + (ux * wz - uz * wx) + (vy * wz - vz * wy) AS a1, -(ux * (vy * wz - vz * wy) - uy * (vx * wz - vz * wx) + uz * (vx * wy - vy * wx)) AS a0 FROM ja),
    pq AS (SELECT *, (3.0 * a1 - a2 * a2) / 9.0 AS q, (9.0 * a2 * a1 - 27.0 * a0 - 2.0 * a2 * a2 * a2) / 54.0 AS s FROM po),
    ro AS (SELECT *, q * q * q + s * s AS disc, {sg('a2')} AS c1, {sg('CASE WHEN a2 = 0 THEN -a0 ELSE (a2 * a1 - a0) / a2 END')} AS c2, {sg('a0')} AS c3 FROM pq),
    ty AS (SELECT CASE WHEN disc = 0 OR a0 = 0 THEN 0 ELSE 2 * (3 - (c1 <> 1)::INT - (c2 <> c1)::INT - (c3 <> c2)::INT) + CASE WHEN disc > 0 THEN 2 ELSE 1 END END AS type FROM ro)
    SELECT type, count(*) AS n FROM ty GROUP BY 1"""


SQL["volume_cp_types"] = f"WITH {_volume_types_sql()}"

COORDS_SQL = ", ".join(f"({x} // 800)::DOUBLE AS t{x}, ({x} % 800 // 32)::DOUBLE AS i{x}, ({x} % 32)::DOUBLE AS j{x}" for x in "abc")
def located_sql(x: str) -> str:
    """Coordinate x (t, i or j) of a face's zero, over its weights m0, m1, m2 of sum m."""
    return f"CASE WHEN m = 0 THEN {x}a / 3 + {x}b / 3 + {x}c / 3 ELSE m0 / m * {x}a + m1 / m * {x}b + m2 / m * {x}c END"


_SAMPLES_SQL = f"""m AS (SELECT vid * 12 + tmpl - 1 AS face, {COORDS_SQL}, ub::DOUBLE * vc - uc::DOUBLE * vb AS m0, uc::DOUBLE * va - ua::DOUBLE * vc AS m1, ua::DOUBLE * vb - ub::DOUBLE * va AS m2 FROM fa WHERE {ZERO}),
    g AS (SELECT *, m0 + m1 + m2 AS m FROM m),
    s AS (SELECT face, {located_sql("j")} AS x, {located_sql("i")} AS y, {located_sql("t")} AS t FROM g)"""


@query(f"WITH {FACES_SQL}, {_SAMPLES_SQL} SELECT face, round(x, 6) AS x, round(y, 6) AS y, round(t, 6) AS t FROM s")
def cp_samples(spark, sf_dir):
    return rounded(critical.zero_samples(*_zero(spark, sf_dir)))


SQL["cp_curves"] = f"""WITH RECURSIVE {FACES_SQL}, {_tet_sides_sql()},
    w AS (SELECT x, y FROM lk UNION ALL SELECT y, x FROM lk),
    cc(id, component) USING KEY (id) AS (SELECT face, face FROM z
        UNION (SELECT u.id, min(v.component) FROM recurring.cc u JOIN w ON w.x = u.id JOIN cc v ON v.id = w.y WHERE v.component < u.component GROUP BY u.id)),
    {_SAMPLES_SQL},
    k AS (SELECT component, face, x, y, t FROM cc JOIN s ON s.face = cc.id),
    n AS (SELECT component, count(*) AS links FROM lk JOIN cc ON cc.id = lk.x GROUP BY 1)
    SELECT component, count(*) AS n_faces, coalesce(any_value(links), 0) >= count(*) AS is_loop, round(min(t), 6) AS t_first, round(max(t), 6) AS t_last,
           round(arg_min(x, (t, face)), 6) AS x_first, round(arg_min(y, (t, face)), 6) AS y_first, round(arg_max(x, (t, face)), 6) AS x_last, round(arg_max(y, (t, face)), 6) AS y_last
    FROM k LEFT JOIN n USING (component) GROUP BY component"""

SQL["cp_ordered_curves"] = f"""WITH RECURSIVE {FACES_SQL}, {_tet_sides_sql()},
    w AS (SELECT x, y FROM lk UNION ALL SELECT y, x FROM lk),
    cc(id, component) USING KEY (id) AS (SELECT face, face FROM z
        UNION (SELECT u.id, min(v.component) FROM recurring.cc u JOIN w ON w.x = u.id JOIN cc v ON v.id = w.y WHERE v.component < u.component GROUP BY u.id)),
    dg AS (SELECT id, component, count(w.y) AS n, max(w.y) AS other FROM cc LEFT JOIN w ON w.x = id GROUP BY 1, 2),
    lp AS (SELECT component FROM dg GROUP BY 1 HAVING min(n) = 2),
    ct AS (SELECT id AS x, other AS y FROM dg JOIN lp USING (component) WHERE id = component),
    pw AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM ct WHERE (ct.x = w.x AND ct.y = w.y) OR (ct.x = w.y AND ct.y = w.x))),
    st AS (SELECT component, min(id) AS face FROM (SELECT id, component FROM cc LEFT JOIN pw ON pw.x = id GROUP BY 1, 2 HAVING count(pw.y) < 2) GROUP BY 1),
    wk(component, strand, face, was, place) AS (SELECT component, face, face, -1::BIGINT, 0::BIGINT FROM st UNION ALL SELECT component, strand, pw.y, face, place + 1 FROM wk JOIN pw ON pw.x = face AND pw.y <> was),
    {_SAMPLES_SQL}
    SELECT component, strand, place, wk.face AS face, round(s.x, 6) AS x, round(s.y, 6) AS y, round(s.t, 6) AS t,
           round(sqrt((s.x - b.x) ** 2 + (s.y - b.y) ** 2), 6) AS step
    FROM wk JOIN s ON s.face = wk.face LEFT JOIN s b ON b.face = wk.was"""
