import random

from pyspark.sql import functions as F

from swirlframe.functions import relative as R


def _zero(p):
    m = [p[4] * p[1] - p[0] * p[5], p[2] * p[5] - p[4] * p[3], p[0] * p[3] - p[2] * p[1]]
    return all(x > 0 for x in m) or all(x < 0 for x in m)


def test_bounds_keep_the_verdict(spark):
    rng = random.Random(4)
    rows = [tuple(rng.uniform(-1, 1) for _ in range(6)) for _ in range(300)]
    df = spark.createDataFrame(rows, "u0 double, v0 double, u1 double, v1 double, u2 double, v2 double")
    made = df.withColumns({c: F.expr(e) for c, e in R.columns().items()})
    got = made.select(*df.columns, F.expr(R.offline_bound()).alias("all_"), F.expr(R.online_bound()).alias("last")).collect()
    for r in got:
        p = list(r[:6])
        for _ in range(20):
            e = 0.999 * min(r.all_, 1.0)
            assert _zero([x * (1 + rng.choice((-e, 0, e))) for x in p]) == _zero(p)
            e = 0.999 * min(r["last"], 1.0)
            assert _zero(p[:4] + [x * (1 + rng.choice((-e, 0, e))) for x in p[4:]]) == _zero(p)
    assert sum(r.all_ > 0 for r in got) > 290


def test_bounds_of_tetrahedra_and_cells(spark):
    """No verdict changes within the bounds: of four corners at once, of the last one, and of a bilinear cell's first."""
    import numpy as np

    rng = random.Random(6)
    rows = [tuple(rng.uniform(-1, 1) + (0.6 if k % 3 == n % 3 else 0) for k in range(12)) for n in range(400)]
    names = [f"{c}{k}" for k in range(4) for c in "uvw"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    made = df.withColumns({c: F.expr(e) for c, e in R.tetrahedron_columns().items()})
    got = made.select(*names, F.expr(R.tetrahedron_offline_bound()).alias("all_"), F.expr(R.tetrahedron_online_bound()).alias("last"), F.expr(R.bilinear_online_bound()).alias("cell")).collect()

    def zero(p):
        a, b, c, d = (p[3 * k : 3 * k + 3] for k in range(4))
        m = [-np.linalg.det([b, c, d]), np.linalg.det([a, c, d]), -np.linalg.det([a, b, d]), np.linalg.det([a, b, c])]
        return all(x > 0 for x in m) or all(x < 0 for x in m)

    for r in got:
        p = np.array(r[:12])
        for _ in range(8):
            assert zero(p * (1 + 0.999 * r.all_ * np.array([rng.choice((-1, 0, 1)) for _ in p]))) == zero(p)
            q = p.copy()
            q[9:] *= 1 + 0.999 * min(r["last"], 1.0) * np.array([rng.choice((-1, 0, 1)) for _ in range(3)])
            assert zero(q) == zero(p)
        if r.cell > 0:
            q = p.copy()
            q[:3] *= 1 + 0.9 * min(r.cell, 1.0) * np.array([rng.choice((-1, 1)) for _ in range(3)])
            a = np.sort(np.arctan2(q[1::3], q[0::3]))
            assert np.max(np.diff(np.concatenate([a, [a[0] + 2 * np.pi]]))) > np.pi - 1e-9  # the corners stay on one side of a line
    assert sum(r.all_ > 0 for r in got) > 390 and 50 < sum(r.cell > 0 for r in got) < 400
