"""NumPy kernels of the block codec.

A vertex's bound depends on what its predecessors were decoded to, so the vertices of a block go in
raster order; but all blocks of a batch go through it together, each step on arrays over blocks
(and over the 36 faces of a vertex).
"""

from __future__ import annotations

from collections.abc import Callable
from math import comb

import numpy as np

from ..operators.mesh import CORNERS, FACES, LEGACY, TETRAHEDRA, incident_templates

RADIUS = 32768


def _sos(xj, yj, xk, yk):
    det = xj * yk - xk * yj
    s = np.where(-xk > 0, 1, np.where(-xk < 0, -1, 1))
    for term in (yj - yk, xk - xj, det):
        s = np.where(term > 0, 1, np.where(term < 0, -1, s))
    return s


def has_zero(a, p, b, q, c, r):
    """As functions.triangles.has_zero(), for arrays."""
    m0, m1, m2 = b * r - c * q, c * p - a * r, a * q - b * p
    strict = ((m0 > 0) & (m1 > 0) & (m2 > 0)) | ((m0 < 0) & (m1 < 0) & (m2 < 0))
    flat = (m0 == 0) | (m1 == 0) | (m2 == 0)
    if not flat.any():
        return strict
    strict = np.asarray(strict)
    a, p, b, q, c, r = (np.broadcast_to(x, strict.shape)[flat] for x in (a, p, b, q, c, r))  # ties are few
    ab, bc, ac = _sos(a, p, b, q), _sos(b, q, c, r), _sos(a, p, c, r)
    strict[flat] = (ab == bc) & (ab == -ac)
    return strict


def strict_bound(u0, v0, u1, v1, u2, v2):
    """How far vertex 2 may move with no determinant reaching 0 (one unit less than zero_bound() allows)."""
    m0, m1, m2 = u2 * v0 - u0 * v2, u1 * v2 - u2 * v1, u0 * v1 - u1 * v0
    m = m0 + m1 + m2
    d, d0, d1 = np.abs(u1 - u0) + np.abs(v1 - v0), np.abs(u0) + np.abs(v0), np.abs(u1) + np.abs(v1)
    eb = np.minimum(np.minimum((np.abs(m) - 1) // np.maximum(d, 1), (np.abs(m1) - 1) // np.maximum(d1, 1)), (np.abs(m0) - 1) // np.maximum(d0, 1))
    for x, y, z in ((u0, u1, u2), (v0, v1, v2)):
        same = ((x > 0) & (y > 0) & (z > 0)) | ((x < 0) & (y < 0) & (z < 0))
        eb = np.where(same, np.maximum(eb, np.abs(z) - 1), eb)
    return np.where((m == 0) | (d0 == 0) | (d1 == 0), 0, np.maximum(eb, 0))


def _strides(shape: tuple[int, ...]) -> tuple[int, int, int]:
    return shape[1] * shape[2], shape[2], 1


def _at(rows: np.ndarray | None):
    """Index of some rows, or of all, before one of columns."""
    return slice(None) if rows is None else rows[:, None]


class NoGuard:
    """Only the error bound counts."""

    partial = False

    def __init__(self, shape: tuple[int, ...]):
        pass

    def bound(self, flat: list[np.ndarray], exists: np.ndarray, at: int, now: list[np.ndarray], most: int) -> np.ndarray:
        return np.full(len(exists), most, np.int64)


class FaceGuard:
    """No face of a vertex may win or lose its zero.  layers: only faces within a frame count."""

    layers, templates = False, FACES
    #: Whether bound() can be asked for some blocks only: their numbers in ``rows``, with ``now`` of those.
    partial = True

    def __init__(self, shape: tuple[int, ...]):
        step = _strides(shape)
        around = [x for x in incident_templates(self.templates) if x[0] <= 2 or not self.layers]
        self.o1, self.o2 = (np.array([sum(x * s for x, s in zip(f[k], step, strict=True)) for f in around]) for k in (1, 2))
        rank = np.array([sorted((0, x, y)).index(0) for x, y in zip(self.o1, self.o2, strict=True)])
        self.first, self.second = rank == 0, rank == 1

    def _faces(self, flat, exists, at, rows=None):
        some = _at(rows)
        a, p, b, q = (flat[k][some, at + o] for o in (self.o1, self.o2) for k in (0, 1))
        return (a, p, b, q), exists[some, at + self.o1] & exists[some, at + self.o2]

    def zero(self, others, x, y):
        """Verdicts, with the vertex at (x, y) put in its place by order of vid."""
        return has_zero(*self.placed(others, x, y))

    def placed(self, others, x, y):
        a, p, b, q = others
        f, m = self.first, self.second
        return [np.where(f, x, a), np.where(f, y, p), np.where(f, a, np.where(m, x, b)), np.where(f, p, np.where(m, y, q)), np.where(f | m, b, x), np.where(f | m, q, y)]

    def bound(self, flat, exists, at, now, most, rows=None):
        others, here = self._faces(flat, exists, at, rows)
        x, y = now[0][:, None], now[1][:, None]
        free = ~(here & self.zero(others, x, y)).any(1)  # with a zero the bound is 0
        out = np.zeros(len(x), np.int64)
        if free.any():
            out[free] = np.where(here[free], strict_bound(*(z[free] for z in (*others, x, y))), most).min(1)
        return out


class LayerGuard(FaceGuard):
    layers = True


class LegacyGuard(FaceGuard):
    """As FaceGuard, for the triangulation that splits sides and diagonals the other way."""

    templates = LEGACY


class SymmetricGuard(FaceGuard):
    """As FaceGuard, with the smallest bound of the three vertices of a face, whichever moves."""

    def bound(self, flat, exists, at, now, most, rows=None):
        others, here = self._faces(flat, exists, at, rows)
        a, p, b, q = others
        x, y = now[0][:, None], now[1][:, None]
        least = np.minimum(np.minimum(strict_bound(a, p, b, q, x, y), strict_bound(x, y, b, q, a, p)), strict_bound(a, p, x, y, b, q))
        return np.where(here, np.where(self.zero(others, x, y), 0, least), most).min(1)


class TriedGuard(FaceGuard):
    """Bounds are tried: the largest power of two at which all four corners of what may become of a vertex keep every verdict.

    Convexity does not make this a proof for values between, so what was decoded is checked as well (accepts()).
    Faces with a zero may change too, as long as they keep one.
    """

    tries = 12

    def bound(self, flat, exists, at, now, most, rows=None):
        others, here = self._faces(flat, exists, at, rows)
        x, y = now[0][:, None], now[1][:, None]
        was = self.zero(others, x, y)
        return _tried(len(x), most, self.tries, [(-1, -1), (-1, 1), (1, -1), (1, 1)], lambda some, move: ((self.zero([z[some] for z in others], x[some] + move[0], y[some] + move[1]) == was[some]) | ~here[some]).all(1))

    def accepts(self, flat, exists, at, now, then, rows=None):
        others, here = self._faces(flat, exists, at, rows)
        same = self.zero(others, now[0][:, None], now[1][:, None]) == self.zero(others, then[0][:, None], then[1][:, None])
        return (same | ~here).all(1)


def _tried(n: int, most: int, tries: int, turns: list[tuple[int, ...]], keeps) -> np.ndarray:
    """For each of n vertices the first of most, most / 2, .. with which keeps(vertices, move) holds in all turns, else 0; what is decided is not tried again."""
    best, left = np.zeros(n, np.int64), np.arange(n)
    for k in range(tries):
        eb = most >> k
        if eb < 2 or not len(left):
            break
        some = left
        for turn in turns:
            if len(some):
                some = some[keeps(some, [eb * d for d in turn])]
        best[some] = eb
        left = left[best[left] == 0]
    return best


class TypedGuard(TriedGuard):
    """As TriedGuard, for the faces within a frame, whose zeros must keep their types too."""

    layers = True

    def __init__(self, shape: tuple[int, ...]):
        super().__init__(shape)
        self.upper = np.array([x[0] == 1 for x in incident_templates() if x[0] <= 2])

    def zero(self, others, x, y):
        """0 without a zero, else 1 + its type (as functions.triangles.zero_type())."""
        placed = self.placed(others, x, y)
        zero = has_zero(*placed)
        a, p, b, q, c, r = (z[zero].astype(np.float64) for z in placed)
        upper = np.broadcast_to(self.upper, zero.shape)[zero]
        ux, uy = np.where(upper, c - b, b - a), np.where(upper, b - a, c - b)
        vx, vy = np.where(upper, r - q, q - p), np.where(upper, q - p, r - q)
        trace, det = ux + vy, ux * vy - uy * vx
        real = np.where(det < 0, 3, np.where(det == 0, 0, np.where(trace < 0, 1, 2)))
        out = np.zeros(zero.shape, np.int64)
        out[zero] = 1 + np.where(trace * trace - 4.0 * det >= 0, real, np.where(trace < 0, 4, np.where(trace > 0, 5, 6)))
        return out


def _inside(a, b, c, d):
    """Whether the four determinants of each tetrahedron have one sign."""
    m = [-_det(b, c, d), _det(a, c, d), -_det(a, b, d), _det(a, b, c)]
    return np.logical_and.reduce([x > 0 for x in m]) | np.logical_and.reduce([x < 0 for x in m]), np.logical_or.reduce([x == 0 for x in m])


def _sum_margin(moving: list, rest):
    """How large a share the terms in ``moving`` may move by with the sign of their sum with ``rest`` kept; 0 if all are 0."""
    size = sum(np.abs(m) for m in moving)
    return np.where(size == 0, 0.0, np.abs(sum(moving) + rest) / np.where(size == 0, 1.0, size))


#: Bounds of doubles are this much smaller, for what rounding may add up to.
SAFE = 1 - 1e-9


class RelativeGuard(LayerGuard):
    """Of real values: the share by which a vertex may move with the verdict of no triangle of its frame changed, as a bound of
    base-2 logarithms (``log``) or of the values."""

    partial = False

    def __init__(self, shape: tuple[int, ...], real: np.ndarray, factor: float, log: bool):
        super().__init__(shape)
        self.real, self.factor, self.log = [real[:, k].reshape(len(real), -1).copy() for k in range(real.shape[1])], factor, log

    def share(self, exists, at):
        (u0, v0, u1, v1), here = self._faces(self.real, exists, at)
        u2, v2 = (r[:, at][:, None] for r in self.real)
        # the three determinants; the first two move with the vertex
        m0, m1, m2 = u2 * v0 - u0 * v2, u1 * v2 - u2 * v1, u0 * v1 - u1 * v0
        zero = ((m0 > 0) & (m1 > 0) & (m2 > 0)) | ((m0 < 0) & (m1 < 0) & (m2 < 0))
        k0, k1 = _sum_margin([u2 * v0, -(u0 * v2)], 0.0), _sum_margin([u1 * v2, -(u2 * v1)], 0.0)
        # without a zero two determinants differ in sign, and it is enough that these two keep theirs
        up = np.maximum(np.maximum(np.where(m0 > 0, k0, 0), np.where(m1 > 0, k1, 0)), np.where(m2 > 0, 1.0, 0))
        down = np.maximum(np.maximum(np.where(m0 < 0, k0, 0), np.where(m1 < 0, k1, 0)), np.where(m2 < 0, 1.0, 0))
        return np.where(here, np.where(zero, 0.0, np.minimum(up, down)), 1.0).min(1)

    def bound(self, flat, exists, at, now, most):
        share = np.minimum(self.share(exists, at), 1.0) * SAFE
        size = np.log2(1 + share) if self.log else share * np.minimum.reduce([np.abs(r[:, at]) for r in self.real])
        return np.floor(size * self.factor).astype(np.int64) - 1  # fixed point is truncated

    def update(self, at: int, values: list[np.ndarray]):
        """What the vertex at ``at`` is decoded to."""
        for r, v in zip(self.real, values, strict=True):
            r[:, at] = v


class BilinearGuard(RelativeGuard):
    """As RelativeGuard, for the bilinear field of each cell: it has no zero while its four corners lie on one side of a line through
    the origin, and a vertex may move as far as one of some such lines allows; where there is none, not at all."""

    def __init__(self, shape, real, factor, log):
        super().__init__(shape, real, factor, log)
        step = _strides(shape)
        cells = [((i, 0), (0, j), (i, j)) for i in (-1, 1) for j in (-1, 1)]
        self.cells = np.array([[a * step[1] + b * step[2] for a, b in c] for c in cells])

    def share(self, exists, at):
        spots = at + self.cells
        here = exists[:, spots].all(2)
        u, v = ([r[:, at][:, None], *(r[:, spots[:, k]] for k in range(3))] for r in self.real)
        unit = [(x / np.maximum(np.hypot(x, y), 1e-300), y / np.maximum(np.hypot(x, y), 1e-300)) for x, y in zip(u, v, strict=True)]
        lines = [(1.0, 0.0), (0.0, 1.0), *((unit[a][0] + unit[b][0], unit[a][1] + unit[b][1]) for a in range(4) for b in range(a))]
        best = np.zeros(here.shape)
        for nx, ny in lines:
            d = np.broadcast_arrays(*(nx * x + ny * y for x, y in zip(u, v, strict=True)))
            one = np.logical_and.reduce([z > 0 for z in d]) | np.logical_and.reduce([z < 0 for z in d])
            best = np.maximum(best, np.where(one, _sum_margin([nx * u[0], ny * v[0]], 0.0), 0.0))
        return np.where(here, best, 1.0).min(1)


def _det(a, b, c):
    return a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])


class TetrahedronGuard:
    """For three components: no tetrahedron of a vertex may change a determinant's sign."""

    partial = True

    def __init__(self, shape: tuple[int, ...]):
        step = _strides(shape)
        self.around = []
        for tet in TETRAHEDRA:
            for me in tet:
                self.around.append([sum((x - y) * s for x, y, s in zip(CORNERS[c], CORNERS[me], step, strict=True)) for c in tet if c != me])
        self.offsets = np.array(self.around).T

    def _others(self, flat, exists, at, rows=None):
        o, some = self.offsets, _at(rows)
        return [tuple(f[some, at + x] for f in flat) for x in o], exists[some, at + o[0]] & exists[some, at + o[1]] & exists[some, at + o[2]]

    def bound(self, flat, exists, at, now, most, rows=None):
        (a, b, c), here = self._others(flat, exists, at, rows)
        d = tuple(x[:, None] for x in now)
        m = [_det(b, c, d), _det(a, c, d), _det(a, b, d), _det(a, b, c)]
        total = -m[0] + m[1] - m[2] + m[3]

        def spread(x, y):
            return np.abs(x[1] * y[2] - x[2] * y[1]) + np.abs(x[0] * y[2] - x[2] * y[0]) + np.abs(x[0] * y[1] - x[1] * y[0])

        edge = lambda x, y: tuple(q - r for q, r in zip(x, y, strict=True))
        eb = (np.abs(total) - 1) // np.maximum(spread(edge(b, a), edge(c, a)), 1)
        for det, pair in ((m[0], (b, c)), (m[1], (a, c)), (m[2], (a, b))):
            eb = np.minimum(eb, (np.abs(det) - 1) // np.maximum(spread(*pair), 1))
        zero = (np.sign(-m[0]) == np.sign(m[1])) & (np.sign(m[1]) == np.sign(-m[2])) & (np.sign(-m[2]) == np.sign(m[3]))
        eb = np.where(zero, 0, np.maximum(eb, 0))
        for k in range(3):
            same = (np.sign(a[k]) == np.sign(b[k])) & (np.sign(b[k]) == np.sign(c[k])) & (np.sign(c[k]) == np.sign(d[k])) & (d[k] != 0)
            eb = np.where(same, np.maximum(eb, np.abs(d[k]) - 1), eb)
        return np.where(here, eb, most).min(1)


class TriedTetrahedronGuard(TetrahedronGuard):
    """As TriedGuard, for tetrahedra: the bound is tried from the largest on, and what was decoded is checked.  Flat cases stay as they are."""

    tries = 8

    @staticmethod
    def _same(others, here, was, flat, then):
        is_, tied = _inside(*others, tuple(x[:, None] for x in then))
        return (((was == is_) & ~flat & ~tied) | ~here).all(1)

    def bound(self, flat, exists, at, now, most, rows=None):
        others, here = self._others(flat, exists, at, rows)
        was, even = _inside(*others, tuple(x[:, None] for x in now))
        turns = [tuple(1 if turn >> c & 1 else -1 for c in range(3)) for turn in range(8)]
        keeps = lambda some, move: self._same([tuple(x[some] for x in o) for o in others], here[some], was[some], even[some], [x[some] + d for x, d in zip(now, move, strict=True)])
        return _tried(len(here), most, self.tries, turns, keeps)

    def accepts(self, flat, exists, at, now, then, rows=None):
        others, here = self._others(flat, exists, at, rows)
        return self._same(others, here, *_inside(*others, tuple(x[:, None] for x in now)), then)


class RelativeTetrahedronGuard(RelativeGuard):
    """As RelativeGuard, for three components and all tetrahedra of a vertex."""

    def __init__(self, shape, real, factor, log):
        super().__init__(shape, real, factor, log)
        self.offsets = TetrahedronGuard(shape).offsets

    def share(self, exists, at):
        a, b, c = (tuple(r[:, at + o] for r in self.real) for o in self.offsets)
        d = tuple(r[:, at][:, None] for r in self.real)
        here = exists[:, at + self.offsets[0]] & exists[:, at + self.offsets[1]] & exists[:, at + self.offsets[2]]
        terms = []  # of the determinants with d, its three components times what the others give
        for sign, x, y in ((-1, b, c), (1, a, c), (-1, a, b)):
            terms.append([sign * d[0] * (x[1] * y[2] - x[2] * y[1]), sign * d[1] * (x[2] * y[0] - x[0] * y[2]), sign * d[2] * (x[0] * y[1] - x[1] * y[0])])
        m = [*map(sum, terms), _det(a, b, c)]
        k = [*(_sum_margin(t, 0.0) for t in terms), 1.0]
        zero = np.logical_and.reduce([x > 0 for x in m]) | np.logical_and.reduce([x < 0 for x in m])
        up, down = (np.maximum.reduce([np.where(x * s > 0, y, 0.0) for x, y in zip(m, k, strict=True)]) for s in (1, -1))
        return np.where(here, np.where(zero, 0.0, np.minimum(up, down)), 1.0).min(1)


#: Guards of real values.
RELATIVE = {"relative": RelativeGuard, "bilinear": BilinearGuard, "relative_tetrahedra": RelativeTetrahedronGuard}
GUARDS = {"faces": FaceGuard, "layers": LayerGuard, "legacy": LegacyGuard, "symmetric": SymmetricGuard, "tried": TriedGuard, "typed": TypedGuard, "tetrahedra": TetrahedronGuard, "tried_tetrahedra": TriedTetrahedronGuard, "none": NoGuard, **RELATIVE}
#: Axes along which a guard sees the vertices around one, of (0, 1, 2) for t, i and j: all of them, but for guards of faces or cells of single frames, and for none.
SEEN = {"layers": (1, 2), "typed": (1, 2), "relative": (1, 2), "bilinear": (1, 2), "none": ()}
#: Guards of fields of three components.
SPATIAL = ("tetrahedra", "tried_tetrahedra", "relative_tetrahedra")


Get = Callable[[int, int, int], np.ndarray]


def mixed_order(p: Get, kt: int, ki: int, kj: int) -> np.ndarray:
    total = 0
    for a in range(kt + 1):
        for b in range(ki + 1):
            for c in range(kj + 1):
                if a or b or c:
                    total = total + (-1) ** (a + b + c + 1) * comb(kt, a) * comb(ki, b) * comb(kj, c) * p(a, b, c)
    return total


def lorenzo3d(p: Get, t: int, i: int, j: int) -> np.ndarray:
    return mixed_order(p, 1, 1, 1)


def lorenzo2d(p: Get, t: int, i: int, j: int) -> np.ndarray:
    return p(0, 1, 0) + p(0, 0, 1) - p(0, 1, 1)


def time_linear(p: Get, t: int, i: int, j: int) -> np.ndarray:
    if t < 2:
        return lorenzo3d(p, t, i, j)
    rest = lambda b, c: p(0, b, c) - 2 * p(1, b, c) + p(2, b, c)
    return 2 * p(1, 0, 0) - p(2, 0, 0) + rest(1, 0) + rest(0, 1) - rest(1, 1)


def stride2(p: Get, t: int, i: int, j: int) -> np.ndarray:
    if t < 2:
        return lorenzo3d(p, t, i, j)
    return p(2, 1, 1) + p(2, 0, 0) + p(0, 1, 0) + p(0, 0, 1) - p(2, 1, 0) - p(2, 0, 1) - p(0, 1, 1)


def dt2d(p: Get, t: int, i: int, j: int) -> np.ndarray:
    if t < 1:
        return lorenzo3d(p, t, i, j)
    change = lambda b, c: p(0, b, c) - p(1, b, c)
    return p(1, 0, 0) + change(1, 0) + change(0, 1) - change(1, 1)


def ar2_clamped(p: Get, t: int, i: int, j: int) -> np.ndarray:
    if t < 2:
        return lorenzo3d(p, t, i, j)
    base = 2 * p(1, 0, 0) - p(2, 0, 0)
    around = [p(a, b, c) for a in (1, 2) for b, c in ((0, 0), (1, 0), (0, 1), (1, 1)) if i >= b and j >= c]
    return np.clip(base, np.min(around, 0), np.max(around, 0))


PREDICTORS = {
    "lorenzo3d": lorenzo3d,
    "lorenzo2d": lorenzo2d,
    "mixed_order": lambda p, t, i, j: mixed_order(p, 2, 1, 1),
    "time_linear": time_linear,
    "stride2": stride2,
    "dt2d": dt2d,
    "ar2_clamped": ar2_clamped,
}
#: Predictors that follow the velocity of the last frame; they see both components.
MOVING = ("advect", "warped", "modes", "modes_entropy")
#: Predictors with numbers of each block that go beside its codes.
FITTED = ("lorenzo_ar2", "plane")


def fit_ar2(values: np.ndarray, there: np.ndarray) -> np.ndarray:
    """(block, component, 2): AR(2) of the Lorenzo residuals in time, by the Yule-Walker equations on original values, kept stable; multiples of 2**-12."""
    n, many, nt, nh, nw = values.shape
    out = np.zeros((n, many, 2))
    for k in range(many):
        r = np.zeros((n, nt, nh, nw))
        for t in range(nt):
            for i in range(nh):
                for j in range(nw):
                    r[:, t, i, j] = np.where(there[:, t, i, j], values[:, k, t, i, j] - _still("lorenzo3d", values[:, k], t, i, j), 0)
        g0, g1, g2 = ((r[:, 1 + d :] * r[:, 1 : nt - d or None]).sum((1, 2, 3)) if nt > 1 + d else np.zeros(n) for d in range(3))
        p1, p2 = (g / np.maximum(g0, 1e-300) for g in (g1, g2))
        free = np.maximum(1 - p1 * p1, 1e-6)
        beta = np.clip((p2 - p1 * p1) / free, -0.95, 0.95)
        alpha = np.clip(p1 * (1 - p2) / free, -0.98 * (1 - beta), 0.98 * (1 - beta))
        out[:, k, 0], out[:, k, 1] = alpha, beta
    return np.rint(out * 4096) / 4096


def fit_plane(values: np.ndarray, there: np.ndarray, eb: int) -> np.ndarray:
    """(block, component, 5): a least-squares hyperplane (by t, i, j and a constant; multiples of 1/16), and whether it is taken.

    It is where its residuals on the block's diagonals are smaller in sum than those of Lorenzo, which get eb more each.
    """
    n, many, *size = values.shape
    axes = np.meshgrid(*(np.arange(s) for s in size), indexing="ij")
    design = np.stack([*(a.ravel() for a in axes), np.ones(axes[0].size)], 1).astype(np.float64)
    m = there.reshape(n, -1).astype(np.float64)
    gram = np.einsum("nv,va,vb->nab", m, design, design) + 1e-9 * np.eye(4)
    out = np.zeros((n, many, 5))
    longest = max(size)
    along = lambda d, s: d * (s - 1) // max(longest - 1, 1)
    spots = sorted({(along(d, size[0]), along(d, size[1]), along(e, size[2])) for d in range(longest) for e in (d, longest - 1 - d)})
    for k in range(many):
        x = values[:, k].reshape(n, -1)
        out[:, k, :4] = np.rint(np.linalg.solve(gram, ((m * x) @ design)[:, :, None])[:, :, 0] * 16) / 16
        plane, still = np.zeros(n), np.zeros(n)
        for t, i, j in spots:
            here = there[:, t, i, j]
            plane += np.where(here, np.abs(values[:, k, t, i, j] - _on_plane(out[:, k], t, i, j)), 0)
            still += np.where(here, np.abs(values[:, k, t, i, j] - _still("lorenzo3d", values[:, k], t, i, j)) + eb, 0)
        out[:, k, 4] = plane < still
    return out


def _on_plane(coefficients: np.ndarray, t: int, i: int, j: int) -> np.ndarray:
    return np.rint(coefficients[:, 0] * t + coefficients[:, 1] * i + coefficients[:, 2] * j + coefficients[:, 3]).astype(np.int64)


def _with_ar2(x: np.ndarray, t: int, i: int, j: int, fit: np.ndarray) -> np.ndarray:
    """Lorenzo 3D plus an AR(2) of its own residuals in the two frames before."""
    still = _still("lorenzo3d", x, t, i, j)
    if t < 3:
        return still
    r1, r2 = (x[:, t - b, i, j] - _still("lorenzo3d", x, t - b, i, j) for b in (1, 2))
    return still + np.rint(fit[:, 0] * r1 + fit[:, 1] * r2).astype(np.int64)


def bilinear(plane: np.ndarray, y: np.ndarray, x: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Samples plane[b] (block, row, column) at row y[b] and column x[b], clamped to h[b] rows and w[b] columns."""
    b = np.arange(len(plane))
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    i, j = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
    k, m = np.minimum(i + 1, h - 1), np.minimum(j + 1, w - 1)
    fy, fx = y - i, x - j
    return (1 - fx) * (1 - fy) * plane[b, i, j] + fx * (1 - fy) * plane[b, i, m] + (1 - fx) * fy * plane[b, k, j] + fx * fy * plane[b, k, m]


class Motion:
    """Prediction along the last frame's velocity, within a block; cell is the displacement in cells of one fixed-point unit."""

    def __init__(self, cell: float, h: np.ndarray, w: np.ndarray):
        self.cell, self.h, self.w = cell, h, w

    def sample(self, plane, y, x):
        return bilinear(plane, y, x, self.h, self.w)

    def advect(self, done: np.ndarray, t: int, i: int, j: int) -> list[np.ndarray]:
        """Both components, traced back by the midpoint rule, or by steps of at most two cells for large displacements."""
        u, v = done[:, 0, t - 1], done[:, 1, t - 1]
        n = np.clip(np.ceil(np.maximum(np.abs(u[:, i, j]), np.abs(v[:, i, j])) * self.cell / 2), 1, 32)
        ones = np.ones(len(u))
        y, x = i * ones, j * ones
        mid_y, mid_x = y - 0.5 * self.sample(v, y, x) * self.cell, x - 0.5 * self.sample(u, y, x) * self.cell
        end_y, end_x = y - self.sample(v, mid_y, mid_x) * self.cell, x - self.sample(u, mid_y, mid_x) * self.cell
        for s in range(int(n.max())) if (n > 1).any() else ():
            go = s < n
            du, dv = self.sample(u, y, x) * self.cell / n, self.sample(v, y, x) * self.cell / n
            y, x = np.where(go, np.clip(y - dv, 0, self.h - 1), y), np.where(go, np.clip(x - du, 0, self.w - 1), x)
        y, x = np.where(n > 1, y, end_y), np.where(n > 1, x, end_x)
        return [np.rint(self.sample(p, y, x)).astype(np.int64) for p in (u, v)]

    def warped(self, done: np.ndarray, t: int, i: int, j: int, most: float = 6.0, gate: float = 0.5) -> list[np.ndarray]:
        """2D Lorenzo of the change against the last frame moved by the velocity (small moves count as none, large ones are cut)."""
        u, v = done[:, 0, t - 1], done[:, 1, t - 1]
        dx, dy = u[:, i, j] * self.cell, v[:, i, j] * self.cell
        still = dx * dx + dy * dy < gate * gate
        dx, dy = (np.where(still, 0, np.clip(d, -most, most)) for d in (dx, dy))
        out = []
        for k in (0, 1):
            now, last = done[:, k, t], done[:, k, t - 1]
            w = lambda b, c, last=last: np.rint(self.sample(last, i - dy - b, j - dx - c)).astype(np.int64)
            x = w(0, 0)
            if i:
                x = x + now[:, i - 1, j] - w(1, 0)
            if j:
                x = x + now[:, i, j - 1] - w(0, 1)
            if i and j:
                x = x - now[:, i - 1, j - 1] + w(1, 1)
            out.append(x)
        return out


def predict(name: str, done: np.ndarray, t: int, i: int, j: int, motion: Motion, modes: np.ndarray | None, fit: np.ndarray | None = None) -> list[np.ndarray]:
    """All components at (t, i, j) of all blocks, from ``done`` (block, component, t, i, j), 0 outside the block."""
    every = range(done.shape[1])
    if name == "lorenzo_ar2":
        return [_with_ar2(done[:, k], t, i, j, fit[:, k]) for k in every]
    if name == "plane":
        return [np.where(fit[:, k, 4] > 0, _on_plane(fit[:, k], t, i, j), _still("lorenzo3d", done[:, k], t, i, j)) for k in every]
    if name in MOVING:
        still = [_still("lorenzo3d", done[:, k], t, i, j) for k in every]
        if t < 1:
            return still
        moved = motion.warped(done, t, i, j) if name == "warped" else motion.advect(done, t, i, j)
        return moved if modes is None else [np.where(modes, m, s) for m, s in zip(moved, still, strict=True)]
    return [_still(name, done[:, k], t, i, j) for k in every]


def _still(name: str, x: np.ndarray, t: int, i: int, j: int) -> np.ndarray:
    none = np.zeros(len(x), np.int64)
    return PREDICTORS[name](lambda a, b, c: x[:, t - a, i - b, j - c] if t >= a and i >= b and j >= c else none, t, i, j)


def choose_modes(values: np.ndarray, there: np.ndarray, motion: Motion, gain: float) -> np.ndarray:
    """Per block: whether advection cuts the sum of magnitudes of residuals of the original values by at least ``gain``."""
    a, b = np.zeros(len(values)), np.zeros(len(values))
    _, _, nt, nh, nw = values.shape
    for t in range(1, nt):
        for i in range(nh):
            for j in range(nw):
                s = [_still("lorenzo3d", values[:, k], t, i, j) for k in (0, 1)]
                m = motion.advect(values, t, i, j)
                for k in (0, 1):
                    x = values[:, k, t, i, j]
                    a += np.where(there[:, t, i, j], np.abs(x - s[k]), 0)
                    b += np.where(there[:, t, i, j], np.abs(x - m[k]), 0)
    return (b < a) & ((a - b) / (a + 1e-12) >= gain)


def _entropy(codes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Bits a symbol of each block's codes, and 16 for each value without one."""
    out = np.zeros(len(codes))
    for b in range(len(codes)):
        coded = ids[b] > 0
        n = np.unique(codes[b][:, coded], return_counts=True)[1]
        p = n / max(n.sum(), 1)
        out[b] = -(p * np.log2(p)).sum() + 16.0 * (1 - coded.mean())
    return out


def choose_by_entropy(values: np.ndarray, there: np.ndarray, fixed: np.ndarray, most: int, motion: Motion, gain: float) -> np.ndarray:
    """Per block: whether coding it with advection, at the largest bound, takes fewer bits a symbol than with Lorenzo by at least ``gain``."""
    size = values.shape[2:]
    halo, around = (np.zeros((*x.shape[:-3], *(n + 2 for n in size)), x.dtype) for x in (values, there))
    inner = (..., slice(1, -1), slice(1, -1), slice(1, -1))
    halo[inner], around[inner] = values, there
    bits = []
    for name in ("lorenzo3d", "advect"):
        ids, codes, _ = encode(values, halo, around, fixed, most, name, motion, None, "none")
        bits.append(_entropy(codes, ids))
    a, b = bits
    return (a - b) / (a + 1e-12) >= gain


def encode(values: np.ndarray, halo: np.ndarray, there: np.ndarray, fixed: np.ndarray, most: int, name: str, motion: Motion, modes: np.ndarray | None, guard: str = "faces", fit: np.ndarray | None = None, limits: np.ndarray | None = None, relax: int = 1, reals: Reals | None = None, border: tuple[int, int, int] = (0, 0, 0)):
    """(eb ids, codes, decoded) of blocks.

    values: fixed point (block, component, t, i, j); halo: the same with one more vertex before and after in each
    direction (original values); there: vertices that exist in halo's shape; fixed: vertices of the block
    that must be lossless, as other blocks see them.  limits: a bound for each vertex, beside ``most``.  relax: steps may be so many times (a power
    of two) as large as the bound, where what they give holds it.  reals: what guards of real values need.  border: so many of the first
    frames, rows and columns are what other blocks were decoded to: they are predicted from, and not coded.
    """
    n, many, nt, nh, nw = values.shape
    shape = halo.shape[2:]
    flat = [halo[:, k].reshape(n, -1).copy() for k in range(many)]
    exists = there.reshape(n, -1)
    step = _strides(shape)
    watch = GUARDS[guard](shape, reals.halo, reals.factor, reals.log) if guard in RELATIVE else GUARDS[guard](shape)
    done = _begun(values, border)
    ids, codes = np.zeros((n, nt, nh, nw), np.int8), np.zeros((n, many, nt, nh, nw), np.int32)
    for t in range(border[0], nt):
        for i in range(border[1], nh):
            for j in range(border[2], nw):
                at = (t + 1) * step[0] + (i + 1) * step[1] + j + 1
                now = [values[:, k, t, i, j] for k in range(many)]
                open_, bound = ~fixed[:, t, i, j], np.zeros(n, np.int64)
                if limits is not None:
                    open_ &= limits[:, t, i, j] > 1
                if open_.any():
                    if watch.partial and not open_.all():
                        rows = np.flatnonzero(open_)
                        bound[rows] = np.minimum(watch.bound(flat, exists, at, [x[rows] for x in now], most, rows), most)
                    else:
                        bound = np.where(open_, np.minimum(watch.bound(flat, exists, at, now, most), most), 0)
                if limits is not None:
                    bound = np.minimum(bound, limits[:, t, i, j])
                power = np.where(bound > 1, np.frexp(np.maximum(bound, 1).astype(np.float64))[1] - 1, 0)
                if not power.any():  # all are lossless, as they are
                    for k in range(many):
                        done[:, k, t, i, j] = now[k]
                        flat[k][:, at] = np.where(exists[:, at], now[k], flat[k][:, at])
                    continue
                pred = predict(name, done, t, i, j, motion, modes, fit)
                id_, out, code = np.zeros(n, np.int64), list(now), [np.zeros(n, np.int64)] * many
                for up in range(relax.bit_length()):  # the largest step that holds is taken
                    tried = np.where(power > 0, power + up, 0)
                    eb = np.where(tried > 0, np.int64(1) << tried, 0)
                    good, rec = eb > 0, []
                    for x, p in zip(now, pred, strict=True):
                        steps = np.abs(x - p) // np.maximum(eb, 1) + 1
                        half = np.where(x < p, -(steps // 2), steps // 2)
                        value = p + 2 * half * eb
                        good &= (steps < 2 * RADIUS) & (np.abs(value - x) <= (eb if relax == 1 else bound))
                        rec.append((value, half))
                    if hasattr(watch, "accepts") and good.any():
                        rows = np.flatnonzero(good)
                        good[rows] = watch.accepts(flat, exists, at, [x[rows] for x in now], [v[rows] for v, _ in rec], rows)
                    id_ = np.where(good, tried, id_)
                    out = [np.where(good, v, o) for (v, _), o in zip(rec, out, strict=True)]
                    code = [np.where(good, h, c) for (_, h), c in zip(rec, code, strict=True)]
                for k in range(many):
                    done[:, k, t, i, j] = out[k]
                    flat[k][:, at] = np.where(exists[:, at], out[k], flat[k][:, at])
                    codes[:, k, t, i, j] = code[k]
                if guard in RELATIVE:
                    watch.update(at, [np.where(id_ > 0, reals.value(k, out[k], t, i, j), watch.real[k][:, at]) for k in range(many)])
                ids[:, t, i, j] = id_
    return ids, codes, done


def _begun(values: np.ndarray, border: tuple[int, int, int]) -> np.ndarray:
    """values in the border, zeros elsewhere."""
    done = values.copy() if any(border) else np.zeros_like(values)
    done[(..., *(slice(b, None) for b in border))] = 0
    return done


class Reals:
    """Real values of blocks: halo (block, component, t, i, j) with one more vertex around, in logarithms (with signs) or not."""

    def __init__(self, halo: np.ndarray, factor: float, log: bool):
        self.halo, self.factor, self.log = halo, factor, log

    def value(self, k: int, v: np.ndarray, t: int, i: int, j: int) -> np.ndarray:
        return np.sign(self.halo[:, k, t + 1, i + 1, j + 1]) * np.exp2(v / self.factor) if self.log else v / self.factor


def decode(ids: np.ndarray, codes: np.ndarray, raw: np.ndarray, name: str, motion: Motion, modes: np.ndarray | None, fit: np.ndarray | None = None, border: tuple[int, int, int] = (0, 0, 0)) -> np.ndarray:
    """The values that encode() gave; raw holds the originals of lossless vertices (id 0), and in the border what other blocks were decoded to."""
    n, nt, nh, nw = ids.shape
    done = _begun(raw.astype(np.int64), border)
    for t in range(border[0], nt):
        for i in range(border[1], nh):
            for j in range(border[2], nw):
                id_ = ids[:, t, i, j].astype(np.int64)
                if not id_.any():
                    done[:, :, t, i, j] = raw[:, :, t, i, j]
                    continue
                pred = predict(name, done, t, i, j, motion, modes, fit)
                for k in range(codes.shape[1]):
                    done[:, k, t, i, j] = np.where(id_ > 0, pred[k] + 2 * codes[:, k, t, i, j].astype(np.int64) * (np.int64(1) << id_), raw[:, k, t, i, j])
    return done
