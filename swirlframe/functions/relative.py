"""Bounds relative to each value that keep signs of sums of products, as SQL expressions.

If every factor moves by at most a share e, a product of d factors keeps between (1 - e)**d and
(1 + e)**d of itself; so a sum keeps its sign while the positive part P and the negative part N have
(P**(1/d) - N**(1/d)) / (P**(1/d) + N**(1/d)) above e.  Expressions are of doubles u0 .. v2 of a triangle.
"""

from __future__ import annotations

Terms = list[str]

#: The three 2 x 2 determinants whose sum tells the triangle's area in (u, v), as terms; 0 is opposite vertex 1, 1 opposite 0, 2 opposite 2.
PAIRS: list[Terms] = [["u2 * v0", "-(u0 * v2)"], ["u1 * v2", "-(u2 * v1)"], ["u0 * v1", "-(u1 * v0)"]]


def total(terms: Terms) -> str:
    return "(" + " + ".join(f"({t})" for t in terms) + ")"


def sums(upper: bool | None = None) -> dict[str, Terms]:
    """The sums whose signs matter, by name: k0 to k2 each determinant, o0 to o2 the two others, and of a grid triangle's
    Jacobian (``upper`` tells which triangle of the cell) trace, det and delta, the discriminant."""
    out = {f"k{k}": p for k, p in enumerate(PAIRS)}
    out |= {f"o{k}": [t for m, p in enumerate(PAIRS) if m != k for t in p] for k in range(3)}
    if upper is not None:
        trace = ["u2", "-u1", "v1", "-v0"] if upper else ["u1", "-u0", "v2", "-v1"]
        det = [f"{'-' if upper else ''}({t})" for p in PAIRS for t in p]
        out |= {"trace": trace, "det": det, "delta": [f"({x}) * ({y})" for x in trace for y in trace] + [f"-4 * ({t})" for t in det]}
    return out


def columns(upper: bool | None = None) -> dict[str, str]:
    """p_<name> and n_<name> of sums(): their positive and negative parts.  Bounds below are of these columns and u0 .. v2."""
    out = {}
    for name, terms in sums(upper).items():
        for part, sign in (("p", ""), ("n", "-")):
            out[f"{part}_{name}"] = "(" + " + ".join(f"greatest({sign}({t}), CAST(0 AS DOUBLE))" for t in terms) + ")"
    return out


def sign_margin(name: str, degree: int) -> str:
    """The largest share by which all factors may move with the sum's sign kept; 1 if all terms have one sign."""
    p, n = f"p_{name}", f"n_{name}"
    root = {1: "{}", 2: "sqrt({})", 3: "cbrt({})"}[degree]
    a, b = root.format(p), root.format(n)
    return f"(CASE WHEN {p} = 0 OR {n} = 0 THEN CAST(1 AS DOUBLE) ELSE abs({a} - {b}) / ({a} + {b}) END)"


def moving_margin(a: str, b: str, rest: str = "0") -> str:
    """As sign_margin(), of a * (1 + e1) + b * (1 + e2) + rest, where only a and b move; 0 if both are 0."""
    size = f"(abs({a}) + abs({b}))"
    return f"(CASE WHEN {size} = 0 THEN CAST(0 AS DOUBLE) ELSE abs(({a}) + ({b}) + ({rest})) / {size} END)"


def _within(k: int) -> str:
    """Whether determinant k does not exceed the whole: true for all three just if the triangle holds a zero."""
    return f"({total(PAIRS[k])} = 0 OR ({total(sum(PAIRS, []))}) / {total(PAIRS[k])} >= 1)"


def _combined(margins: list[str], inside: str) -> str:
    """The least of ``inside`` for triangles with a zero, else the largest margin of a condition that fails; 0 for flat ones."""
    fails = ", ".join(f"CASE WHEN {_within(k)} THEN CAST(0 AS DOUBLE) ELSE {m} END" for k, m in enumerate(margins))
    return f"(CASE WHEN {total(sum(PAIRS, []))} = 0 THEN CAST(0 AS DOUBLE) WHEN {' AND '.join(_within(k) for k in range(3))} THEN {inside} ELSE greatest({fails}) END)"


def type_margin() -> str:
    """The share that keeps the signs of trace, determinant and discriminant."""
    least = f"least({sign_margin('trace', 1)}, {sign_margin('det', 2)})"
    return f"(CASE WHEN p_det = n_det THEN CAST(0 AS DOUBLE) WHEN p_det < n_det THEN {least} ELSE least({least}, {sign_margin('delta', 2)}) END)"


def offline_bound(typed: bool = False) -> str:
    """All three vertices may move by this share: whether there is a zero is kept, and if ``typed`` its type (see columns())."""
    margins = [f"least({sign_margin(f'k{k}', 2)}, {sign_margin(f'o{k}', 2)})" for k in range(3)]
    return _combined(margins, f"least({', '.join(margins + ([type_margin()] if typed else []))})")


def online_bound() -> str:
    """Only vertex 2 may move, by this share: whether there is a zero is kept."""
    (a0, b0), (a1, b1), _ = PAIRS
    fixed = total(PAIRS[2])
    margins = [
        f"least({moving_margin(a0, b0)}, {moving_margin(b1, a1, fixed)})",
        f"least({moving_margin(b1, a1)}, {moving_margin(a0, b0, fixed)})",
        moving_margin("u2 * v0 - u2 * v1", "u1 * v2 - u0 * v2"),
    ]
    return _combined(margins, f"least({moving_margin(b1, a1)}, {moving_margin(a0, b0)})")


def log_bound(share: str) -> str:
    """The bound of base-2 logarithms that a relative bound allows."""
    return f"log2(1 + {share})"


# --- tetrahedra: doubles u0 .. w3, vertex 3 the one that moves -------------------------------------------


def _det_terms(x: int, y: int, z: int, sign: str = "") -> Terms:
    """det of the vectors x, y, z as six products, those of each component of z one after the other."""
    made = [("u", f"v{x} * w{y}", f"w{x} * v{y}"), ("v", f"w{x} * u{y}", f"u{x} * w{y}"), ("w", f"u{x} * v{y}", f"v{x} * u{y}")]
    flip = "" if sign else "-"
    return [t for c, a, b in made for t in (f"{sign}({c}{z} * {a})", f"{flip}({c}{z} * {b})")]


#: The four determinants whose common sign says that the origin is within a tetrahedron; the last has no part of vertex 3.
TETRAHEDRON = [_det_terms(1, 2, 3, "-"), _det_terms(0, 2, 3), _det_terms(0, 1, 3, "-"), _det_terms(0, 1, 2)]


def tetrahedron_columns() -> dict[str, str]:
    """p_k<n> and n_k<n>: the positive and negative parts of the four determinants, and m<n>, c<n>: the determinants, and the sums of
    the magnitudes by which components of vertex 3 enter them."""
    out = {}
    for k, terms in enumerate(TETRAHEDRON):
        for part, sign in (("p", ""), ("n", "-")):
            out[f"{part}_k{k}"] = "(" + " + ".join(f"greatest({sign}({t}), CAST(0 AS DOUBLE))" for t in terms) + ")"
        out[f"m{k}"] = total(terms)
        out[f"c{k}"] = "(" + " + ".join(f"abs({total(terms[2 * i : 2 * i + 2])})" for i in range(3)) + ")"
    return out


def _two_signs(margins: list[str], inside: str) -> str:
    """``inside`` where all determinants have one sign; else the smaller of the best margins of either sign: two that differ are enough."""
    best = [f"greatest({', '.join(f'CASE WHEN m{k} {op} 0 THEN {m} ELSE CAST(0 AS DOUBLE) END' for k, m in enumerate(margins))})" for op in "><"]
    same = " OR ".join("(" + " AND ".join(f"m{k} {op} 0" for k in range(4)) + ")" for op in "><")
    return f"(CASE WHEN {same} THEN {inside} ELSE least({best[0]}, {best[1]}) END)"


def tetrahedron_offline_bound() -> str:
    """All four vertices may move by this share: whether there is a zero is kept."""
    margins = [sign_margin(f"k{k}", 3) for k in range(4)]
    return _two_signs(margins, f"least({', '.join(margins)})")


def tetrahedron_online_bound() -> str:
    """Only vertex 3 may move, by this share: whether there is a zero is kept.  0 where there is one."""
    margins = [f"(CASE WHEN c{k} = 0 THEN CAST(0 AS DOUBLE) ELSE abs(m{k}) / c{k} END)" for k in range(3)]
    return _two_signs([*margins, "CAST(1 AS DOUBLE)"], "CAST(0 AS DOUBLE)")


# --- bilinear cells: doubles u0 .. v3, vertex 0 the one that moves ----------------------------------------


def bilinear_online_bound() -> str:
    """Vertex 0 may move by this share: the cell keeps on one side of a line through the origin, so it has no zero; 0 where no line is found.

    Lines: the axes, and those square to the bisectors of two vertices' vectors.
    """
    unit = lambda c, k: f"{c}{k} / greatest(sqrt(u{k} * u{k} + v{k} * v{k}), CAST(1e-300 AS DOUBLE))"
    lines = [("CAST(1 AS DOUBLE)", "CAST(0 AS DOUBLE)"), ("CAST(0 AS DOUBLE)", "CAST(1 AS DOUBLE)")]
    lines += [tuple(f"({unit(c, a)} + {unit(c, b)})" for c in "uv") for a in range(4) for b in range(a)]
    found = []
    for x, y in lines:
        d = [f"({x} * u{k} + {y} * v{k})" for k in range(4)]
        one = " OR ".join("(" + " AND ".join(f"{z} {op} 0" for z in d) + ")" for op in "><")
        found.append(f"CASE WHEN {one} THEN abs({d[0]}) / (abs({x} * u0) + abs({y} * v0)) ELSE CAST(0 AS DOUBLE) END")
    return f"greatest({', '.join(found)})"
