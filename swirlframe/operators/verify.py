"""Quality and topology reports: error metrics, confusion of zero faces, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.triangles import determinant3, has_zero
from ..grid import Grid
from .mesh import FACES, faces

SIX = ("ua", "va", "ub", "vb", "uc", "vc")


def _report(sums: DataFrame) -> DataFrame:
    """Metrics of sums (n, sse, lo, hi, max_err)."""
    mse = F.col("sse") / F.greatest(F.col("n"), F.lit(1))
    rmse, span = F.sqrt(mse), F.col("hi") - F.col("lo")
    log = lambda x: F.log10(F.when(x > 0, x).otherwise(1.0))
    psnr = F.when(rmse == 0, F.lit(float("inf"))).when(span > 0, 20 * log(span) - 10 * log(mse))
    psnr = psnr.when(F.abs("hi") > 0, 20 * log(F.abs("hi")) - 10 * log(mse)).otherwise(F.lit(float("-inf")))
    return sums.select("n", mse.alias("mse"), rmse.alias("rmse"), F.when(span > 0, rmse / F.when(span > 0, span).otherwise(1.0)).otherwise(rmse).alias("nrmse"), psnr.alias("psnr"), F.col("max_err").alias("max_err"), F.col("lo").alias("min_orig"), F.col("hi").alias("max_orig"))


def _sums(pairs: DataFrame) -> DataFrame:
    d = F.col("x") - F.col("y")
    return pairs.agg(F.count("*").alias("n"), F.coalesce(F.sum(d * d), F.lit(0.0)).alias("sse"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.coalesce(F.max(F.abs(d)), F.lit(0.0)).alias("max_err"))


def quality(pairs: DataFrame, original: str, decoded: str) -> DataFrame:
    """One row: n, mse, rmse, nrmse, psnr, max_err, min_orig, max_orig.  PSNR is infinite without error, and by the peak for a constant original."""
    return _report(_sums(pairs.select(F.col(original).cast("double").alias("x"), F.col(decoded).cast("double").alias("y"))))


def combined_quality(pairs: DataFrame, cols: list[tuple[str, str]]) -> DataFrame:
    """quality() of several (original, decoded) columns as one."""
    both = F.explode(F.array(*(F.struct(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in cols)))
    return _report(_sums(pairs.select(both.alias("p")).select("p.x", "p.y")))


def correlation(pairs: DataFrame, original: str, decoded: str, over: float = 1.0) -> DataFrame:
    """(max_pw_rel, ac_eff): the largest error relative to values of magnitude above ``over``, and the correlation."""
    x, y = F.col(original).cast("double"), F.col(decoded).cast("double")
    return pairs.agg(F.coalesce(F.max(F.when(F.abs(x) > over, F.abs(x - y) / F.abs(x))), F.lit(0.0)).alias("max_pw_rel"), F.corr(x, y).alias("ac_eff"))


def component_stats(field: DataFrame, cols: tuple[str, ...] = ("u", "v")) -> DataFrame:
    return field.agg(*(f(c).alias(f"{n}_{c}") for c in cols for n, f in (("min", F.min), ("max", F.max))))


def channel_rotation(field: DataFrame, grid: Grid, most: int = 200_000) -> DataFrame:
    """(c, s): cosine and sine of half the angle that decorrelates the components, from every k-th vertex so that about ``most`` are taken."""
    stride = max(1, grid.size // most)
    u, v = F.col("u").cast("double"), F.col("v").cast("double")
    m = field.filter(grid.vid() % stride == 0).agg(F.covar_samp(u, v).alias("uv"), F.var_samp(u).alias("uu"), F.var_samp(v).alias("vv"))
    none = (F.abs("uv") < 1e-15) & (F.abs(F.col("uu") - F.col("vv")) < 1e-15)
    theta = F.when(none, 0.0).otherwise(0.5 * F.atan2(2.0 * F.col("uv"), F.col("uu") - F.col("vv")))
    return m.select(F.cos(theta).alias("c"), F.sin(theta).alias("s"))


def marked_faces(both: DataFrame, grid: Grid, templates: list = FACES) -> DataFrame:
    """(tmpl, t, a, b, c, ori, dec): every face of a field (t, i, j, u, v, du, dv), and whether it holds a zero before (u, v) and after (du, dv).

    Both fields go through one enumeration, so no join of face sets is needed.
    """
    from .mesh import CORNERS, offset
    from ..grid import neighbours

    at = grid.vid()
    rows = neighbours(both, ["u", "v", "du", "dv"], CORNERS)

    def one(number: int, corners: tuple[int, int, int]) -> Column:
        ids = [(at + offset(grid, c)).alias(n) for c, n in zip(corners, "abc", strict=True)]
        values = [F.col(f"{x}_{c}").alias(x + n) for c, n in zip(corners, "abc", strict=True) for x in ("u", "v", "du", "dv")]
        return F.struct(F.lit(number).alias("tmpl"), *ids, *values)

    made = rows.select("t", F.explode(F.array(*(one(n, c) for n, _, c in templates))).alias("f")).select("t", "f.*")
    made = made.filter("ua is not null and ub is not null and uc is not null")
    ori, dec = (has_zero(*(F.col(x + n) for n in "abc" for x in xs)) for xs in (("u", "v"), ("du", "dv")))
    return made.select("tmpl", "t", "a", "b", "c", ori.alias("ori"), dec.alias("dec"))


def confusion(marked: DataFrame) -> DataFrame:
    """(region, idx, tp, tn, fp, fn): per layer (faces of one frame) and slab (faces between frames), and both totals (idx null)."""
    region = F.when(F.col("tmpl") <= 2, "layer").otherwise("slab")
    tally = lambda x: F.sum(x.cast("long"))
    o, d = F.col("ori"), F.col("dec")
    return marked.select(region.alias("region"), F.col("t").cast("int").alias("idx"), "ori", "dec").rollup("region", "idx").agg(tally(o & d).alias("tp"), tally(~o & ~d).alias("tn"), tally(~o & d).alias("fp"), tally(o & ~d).alias("fn")).filter("region is not null")


def differences(marked: DataFrame) -> DataFrame:
    """(side, a, b, c): zero faces that only the original ("lost") or only the decoded field has ("new")."""
    return marked.filter("ori <> dec").select(F.when(F.col("ori"), "lost").otherwise("new").alias("side"), "a", "b", "c")


def match_points(original: DataFrame, decoded: DataFrame, keys: tuple[str, ...] = ("t", "simplex_id")) -> DataFrame:
    """(class, n): points of layer_points() by simplex: matched, type changed, lost, new."""
    a, b = original.select(*keys, F.col("type").alias("a")), decoded.select(*keys, F.col("type").alias("b"))
    kind = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "lost").when(F.col("a") == F.col("b"), "matched").otherwise("type changed")
    return a.join(b, list(keys), "full_outer").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


def recorded_faces(rows: DataFrame) -> DataFrame:
    """rows (name, ua .. vc) with det (of u, v, 1) and whether the face holds a zero."""
    u, v = tuple(F.col(f"u{x}") for x in "abc"), tuple(F.col(f"v{x}") for x in "abc")
    return rows.withColumn("det", determinant3(u, v)).withColumn("zero", has_zero(*(F.col(x) for x in SIX)))


def uniform_quantized(field: DataFrame, eb: int) -> DataFrame:
    """(t, i, j, u, v, du, dv): fixed-point values and what they become when rounded to multiples of 2 * eb."""
    q = lambda c: (F.floor((F.col(c) + eb) / F.lit(2.0 * eb)) * (2 * eb)).cast("long")
    return field.select("t", "i", "j", "u", "v", q("u").alias("du"), q("v").alias("dv"))


def face_census(field: DataFrame, grid: Grid) -> DataFrame:
    """(tmpl, n): how many faces of each template there are."""
    return faces(field, grid).groupBy("tmpl").agg(F.count("*").alias("n"))


def face_visits(grid: Grid, vertices: DataFrame) -> DataFrame:
    """(tmpl, n, visits): how many faces the vertices (t, i, j) see around them, and how often; all faces of a grid are seen three times."""
    from .mesh import CORNERS

    seen = []
    for number, _, corners in FACES:
        for me in corners:
            home = [F.col(a) - CORNERS[me][k] for k, a in enumerate("tij")]
            far = [h + max(CORNERS[c][k] for c in corners) for k, h in enumerate(home)]
            inside = grid.inside(*home) & grid.inside(*far)
            seen.append(F.when(inside, F.struct(F.lit(number).alias("tmpl"), grid.vid(*home).alias("cube"))))
    rows = vertices.select(F.explode(F.array_compact(F.array(*seen))).alias("f")).select("f.*")
    per = rows.groupBy("tmpl", "cube").agg(F.count("*").alias("v"))
    return per.groupBy("tmpl").agg(F.count("*").alias("n"), F.sum("v").alias("visits"))
