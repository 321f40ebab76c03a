"""Triangles of two-component vectors in fixed point: tests, location, type, bounds.

Magnitudes of at most 2**30 keep every product and sum within a bigint.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _orientation(xj: Column, yj: Column, xk: Column, yk: Column) -> Column:
    """The sign (1 or -1) of the turn origin -> j -> k, where j comes before k.

    A determinant of 0 is decided by simulation of simplicity (Edelsbrunner and Muecke 1990): the
    first term that isn't 0 of x_k - x_j, y_j - y_k, -x_k, 1, with the origin as the lowest index.
    """
    det = xj * yk - xk * yj
    out = F.lit(1)
    for term in (-xk, yj - yk, xk - xj, det):
        out = F.when(term > 0, 1).when(term < 0, -1).otherwise(out)
    return out


def has_zero(ua: Column, va: Column, ub: Column, vb: Column, uc: Column, vc: Column) -> Column:
    """Whether the origin is in the triangle of vectors a, b, c, of vertices in ascending order."""
    ab, bc, ac = _orientation(ua, va, ub, vb), _orientation(ub, vb, uc, vc), _orientation(ua, va, uc, vc)
    m0, m1, m2 = ub * vc - uc * vb, uc * va - ua * vc, ua * vb - ub * va
    strict = ((m0 > 0) & (m1 > 0) & (m2 > 0)) | ((m0 < 0) & (m1 < 0) & (m2 < 0))
    degenerate = (m0 == 0) | (m1 == 0) | (m2 == 0)
    return strict | (degenerate & (ab == bc) & (ab == -ac))


def barycentric(ua: Column, va: Column, ub: Column, vb: Column, uc: Column, vc: Column) -> tuple[Column, Column, Column]:
    """Weights of a, b, c at which the linear field is zero; a third each where there is no single such place."""
    m = [(x.cast("double"), y.cast("double")) for x, y in ((ua, va), (ub, vb), (uc, vc))]
    (a, p), (b, q), (c, r) = m
    m0, m1, m2 = b * r - c * q, c * p - a * r, a * q - b * p
    total = m0 + m1 + m2
    third = F.lit(1.0) / 3
    return tuple(F.when(total == 0, third).otherwise(x / F.when(total == 0, 1.0).otherwise(total)) for x in (m0, m1, m2))


def zero_type(ua: Column, va: Column, ub: Column, vb: Column, uc: Column, vc: Column, upper: Column) -> Column:
    """The type of a layer face's zero: 0 singular, 1 attracting, 2 repelling, 3 saddle, 4 attracting focus, 5 repelling focus, 6 center.

    From the eigenvalues of the Jacobian, for the cell's triangle (i,j) (i+1,j) (i+1,j+1) if ``upper``,
    else (i,j) (i,j+1) (i+1,j+1); x is the column and y the row.
    """
    a, p, b, q, c, r = (x.cast("double") for x in (ua, va, ub, vb, uc, vc))
    ux, uy = F.when(upper, c - b).otherwise(b - a), F.when(upper, b - a).otherwise(c - b)
    vx, vy = F.when(upper, r - q).otherwise(q - p), F.when(upper, q - p).otherwise(r - q)
    trace, det = ux + vy, ux * vy - uy * vx
    delta = trace * trace - 4.0 * det
    real = F.when(det < 0, 3).when(det == 0, 0).when(trace < 0, 1).otherwise(2)
    return F.when(delta >= 0, real).when(trace < 0, 4).when(trace > 0, 5).otherwise(6)


TYPE_NAMES = ["singular", "attracting", "repelling", "saddle", "attracting focus", "repelling focus", "center"]


def type_name(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TYPE_NAMES)), kind + 1)


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, F.when(y == 0, F.lit(1).cast("long")).otherwise(y))


def zero_bound(u0: Column, v0: Column, u1: Column, v1: Column, u2: Column, v2: Column) -> Column:
    """How far vertex 2 of a triangle may move, in each component, with the verdict of has_zero() unchanged (whole numbers).

    The smallest of the distances at which one of three determinants may change its sign; but where all three
    u, or v, are of one sign, vertex 2 may move by its own |u|, or |v|, at least.  0 for flat triangles.
    """
    m0, m1, m2 = u2 * v0 - u0 * v2, u1 * v2 - u2 * v1, u0 * v1 - u1 * v0
    m = m0 + m1 + m2
    d0, d1 = F.abs(u0) + F.abs(v0), F.abs(u1) + F.abs(v1)
    eb = F.least(_div(F.abs(m), F.abs(u1 - u0) + F.abs(v1 - v0)), _div(F.abs(m1), d1), _div(F.abs(m0), d0))

    def agree(x: Column, y: Column, z: Column) -> Column:
        return ((x > 0) & (y > 0) & (z > 0)) | ((x < 0) & (y < 0) & (z < 0))

    eb = F.when(agree(u0, u1, u2), F.greatest(eb, F.abs(u2))).otherwise(eb)
    eb = F.when(agree(v0, v1, v2), F.greatest(eb, F.abs(v2))).otherwise(eb)
    return F.when((m == 0) | (d0 == 0) | (d1 == 0), F.lit(0).cast("long")).otherwise(eb)


def zero_bound_any(u0: Column, v0: Column, u1: Column, v1: Column, u2: Column, v2: Column) -> Column:
    """The smallest zero_bound() of the three vertices."""
    return F.least(zero_bound(u0, v0, u1, v1, u2, v2), zero_bound(u2, v2, u1, v1, u0, v0), zero_bound(u0, v0, u2, v2, u1, v1))


def determinant3(u: tuple[Column, Column, Column], v: tuple[Column, Column, Column]) -> Column:
    """det of rows (u_k, v_k, 1)."""
    return u[0] * (v[1] - v[2]) - v[0] * (u[1] - u[2]) + (u[1] * v[2] - u[2] * v[1])


def ordinal(t_a: Column, t_b: Column, t_c: Column) -> Column:
    """Whether a face lies in one frame."""
    return (t_a == t_b) & (t_b == t_c)


#: Of a cell's coefficient of x * x: what rounding alone may leave, as a share of the products it is the difference of.
FLAT = 2.0**-50
#: How near to 0 a component must be at a place that counts as a zero, as a share of the sum of its corners' magnitudes.
NEAR = 1e-6


def bilinear_zero(u: tuple[Column, Column, Column, Column], v: tuple[Column, Column, Column, Column]) -> Column:
    """Places (x, y) in a unit cell where the bilinear field of corner values (0,0), (1,0), (0,1), (1,1) is zero: an array of up to two.

    Without y, the two components give a quadratic in x; x must be in [0, 1) and so must y.  The quadratic also has a root where the field
    does not change along y (as on a side with equal corners), though it may not be zero there: both components are tested at each place.
    """
    u, v = (tuple(x.cast("double") for x in c) for c in (u, v))
    a = [(c[0], c[1] - c[0], c[2] - c[0], c[0] - c[1] - c[2] + c[3]) for c in (u, v)]
    su, sv = (F.abs(c[0]) + F.abs(c[1]) + F.abs(c[2]) + F.abs(c[3]) for c in (u, v))
    (p, q, r, s), (k, l, m, n) = a  # p + q x + r y + s x y
    # (p + q x)(m + n x) = (k + l x)(r + s x)
    a2, a1, a0 = q * n - l * s, p * n + q * m - k * s - l * r, p * m - k * r
    a2 = F.when(F.abs(a2) <= FLAT * (F.abs(q) * sv + F.abs(l) * su), F.lit(0.0)).otherwise(a2)
    disc = a1 * a1 - 4.0 * a2 * a0
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    safe = lambda x: F.when(x == 0, F.lit(1.0)).otherwise(x)
    one = F.when(a2 == 0, F.when(a1 != 0, -a0 / safe(a1))).when(disc >= 0, (-a1 - root) / safe(2.0 * a2))
    two = F.when((a2 != 0) & (disc > 0), (-a1 + root) / safe(2.0 * a2))

    def place(x: Column) -> Column:
        d0, d1, e0, e1 = r + s * x, m + n * x, p + q * x, k + l * x
        y = F.when(F.abs(d0) >= F.abs(d1), -e0 / safe(d0)).otherwise(-e1 / safe(d1))
        near = (F.abs(e0 + d0 * y) <= NEAR * su) & (F.abs(e1 + d1 * y) <= NEAR * sv)
        return F.when((x >= 0) & (x < 1) & (y >= 0) & (y < 1) & near, F.struct(x.alias("x"), y.alias("y")))

    return F.array_compact(F.array(place(one), place(two)))


def bilinear_type(u: tuple[Column, Column, Column, Column], v: tuple[Column, Column, Column, Column], x: Column, y: Column) -> Column:
    """The type, as of zero_type(), of the bilinear field's Jacobian at (x, y)."""
    d = [(c[1] - c[0] + (c[0] - c[1] - c[2] + c[3]) * y, c[2] - c[0] + (c[0] - c[1] - c[2] + c[3]) * x) for c in (tuple(z.cast("double") for z in u), tuple(z.cast("double") for z in v))]
    trace, det = d[0][0] + d[1][1], d[0][0] * d[1][1] - d[0][1] * d[1][0]
    delta = trace * trace - 4.0 * det
    real = F.when(det < 0, 3).when(det == 0, 0).when(trace < 0, 1).otherwise(2)
    return F.when(delta >= 0, real).when(trace < 0, 4).when(trace > 0, 5).otherwise(6)


def bilinear_stages() -> list[tuple[dict[str, Column], Column | None]]:
    """bilinear_zero() and bilinear_type() of doubles u0 .. v3, as columns and filters one after the other: a row for each zero, with _x, _y and _type.

    What is used often is a column of its own, so that no expression holds another one many times.
    """
    c = F.col
    safe = lambda x: F.when(c(x) == 0, F.lit(1.0)).otherwise(c(x))
    names = ("pqrs", "klmn")
    first = {n: e for row, x in zip(names, "uv", strict=True) for n, e in zip(row, (c(x + "0"), c(x + "1") - c(x + "0"), c(x + "2") - c(x + "0"), c(x + "0") - c(x + "1") - c(x + "2") + c(x + "3")), strict=True)}
    return [
        ({"_" + n: e for n, e in first.items()} | {"_s" + x: F.abs(x + "0") + F.abs(x + "1") + F.abs(x + "2") + F.abs(x + "3") for x in "uv"}, None),
        ({"_a2": c("_q") * c("_n") - c("_l") * c("_s"), "_flat": FLAT * (F.abs("_q") * c("_sv") + F.abs("_l") * c("_su")), "_a1": c("_p") * c("_n") + c("_q") * c("_m") - c("_k") * c("_s") - c("_l") * c("_r"), "_a0": c("_p") * c("_m") - c("_k") * c("_r")}, None),
        ({"_a2": F.when(F.abs("_a2") <= c("_flat"), F.lit(0.0)).otherwise(c("_a2"))}, None),
        ({"_disc": c("_a1") * c("_a1") - 4.0 * c("_a2") * c("_a0"), "_twice": 2.0 * c("_a2")}, None),
        ({"_root": F.sqrt(F.greatest("_disc", F.lit(0.0)))}, None),
        ({"_one": F.when(c("_a2") == 0, F.when(c("_a1") != 0, -c("_a0") / safe("_a1"))).when(c("_disc") >= 0, (-c("_a1") - c("_root")) / safe("_twice")), "_two": F.when((c("_a2") != 0) & (c("_disc") > 0), (-c("_a1") + c("_root")) / safe("_twice"))}, None),
        ({"_x": F.explode(F.array("_one", "_two"))}, (c("_x") >= 0) & (c("_x") < 1)),
        ({"_d0": c("_r") + c("_s") * c("_x"), "_d1": c("_m") + c("_n") * c("_x"), "_e0": c("_p") + c("_q") * c("_x"), "_e1": c("_k") + c("_l") * c("_x")}, None),
        ({"_y": F.when(F.abs("_d0") >= F.abs("_d1"), -c("_e0") / safe("_d0")).otherwise(-c("_e1") / safe("_d1"))}, (c("_y") >= 0) & (c("_y") < 1)),
        ({"_near": (F.abs(c("_e0") + c("_d0") * c("_y")) <= NEAR * c("_su")) & (F.abs(c("_e1") + c("_d1") * c("_y")) <= NEAR * c("_sv"))}, c("_near")),
        ({"_ux": c("_q") + c("_s") * c("_y"), "_vx": c("_l") + c("_n") * c("_y")}, None),  # _d0 and _d1 are the derivatives by y
        ({"_trace": c("_ux") + c("_d1"), "_det": c("_ux") * c("_d1") - c("_d0") * c("_vx")}, None),
        ({"_delta": c("_trace") * c("_trace") - 4.0 * c("_det")}, None),
        ({"_type": F.when(c("_delta") >= 0, F.when(c("_det") < 0, 3).when(c("_det") == 0, 0).when(c("_trace") < 0, 1).otherwise(2)).when(c("_trace") < 0, 4).when(c("_trace") > 0, 5).otherwise(6)}, None),
    ]
