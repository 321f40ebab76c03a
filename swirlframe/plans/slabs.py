"""Trajectories by slabs: some consecutive frames of cubes, with the zero faces of all their tetrahedra.

A tetrahedron joins faces of its cube's frame and faces within the next one, so a slab has all links of its tetrahedra, and shares with the slabs around
it only faces within its first and last frame.  What is connected within a slab is found there; what goes on between slabs is a graph of
those shared faces, which is as much smaller as a slab has frames.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import Grid
from ..operators.mesh import FACES, TETRAHEDRA, offset

#: Faces of a slab, with and without a zero, about; a frame is the least.
FACES_AT_ONCE = 1 << 18


def frames_of(grid: Grid) -> int:
    """Frames of a slab."""
    return max(1, FACES_AT_ONCE // (12 * grid.plane))


def by_slab(faces: DataFrame, grid: Grid) -> DataFrame:
    """faces (face, ...) with slab; a face within the first frame of a slab is there for the one before too."""
    each = 12 * grid.plane * frames_of(grid)
    home, within = F.expr(f"face div {each}"), F.col("face") % each
    shared = (within < 12 * grid.plane) & (F.col("face") % 12 < 2) & (home > 0)
    return faces.withColumn("slab", F.explode(F.when(shared, F.array(home - 1, home)).otherwise(F.array(home))))


def _tetrahedra(grid: Grid) -> tuple[np.ndarray, np.ndarray]:
    """(number, offset) of the two tetrahedra of each template's faces."""
    by_corners = {c: n for n, _, c in FACES}
    sides: dict[int, list[tuple[int, int]]] = {n: [] for n, _, _ in FACES}
    for k, tet in enumerate(TETRAHEDRA):
        for left_out in range(4):
            abc = tuple(c for m, c in enumerate(tet) if m != left_out)
            # a side that lacks corner 0 belongs to the cube of its smallest corner
            sides[by_corners[tuple(c - abc[0] for c in abc)]].append((k, offset(grid, abc[0])))
    both = np.array([sides[n] for n, _, _ in FACES], np.int64)
    return both[:, :, 0], both[:, :, 1]


def links_within(face: np.ndarray, tets: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y), x < y, in sorted ``face`` of those that are sides of one tetrahedron.  Proper fields have two there; more are linked through the smallest."""
    number, moved = tets
    tet = ((face // 12)[:, None] - moved[face % 12]) * 6 + number[face % 12]
    tet, place = tet.ravel(), np.repeat(np.arange(len(face)), 2)
    order = np.lexsort((place, tet))
    tet, place = tet[order], place[order]
    begins = np.r_[True, tet[1:] != tet[:-1]] if len(tet) else np.zeros(0, bool)
    smallest = place[np.flatnonzero(begins)][np.cumsum(begins) - 1]
    return smallest[~begins], place[~begins]


def least_within(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest number that each of 0 to n - 1 is connected with by links (x, y)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        now = label.copy()
        np.minimum.at(now, label[x], low)
        np.minimum.at(now, label[y], low)
        while (now[now] != now).any():
            now = now[now]
        if (now == label).all():
            return label
        label = now


def links(faces: DataFrame, grid: Grid) -> DataFrame:
    """(x, y), x < y: pairs of zero faces (face) that are sides of one tetrahedron."""
    tets = _tetrahedra(grid)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        face = np.sort(part["face"].to_numpy(np.int64))
        x, y = links_within(face, tets)
        return pd.DataFrame({"x": face[x], "y": face[y]})

    return by_slab(faces.select("face"), grid).groupBy("slab").applyInPandas(run, "x long, y long")


def labelled(faces: DataFrame, grid: Grid) -> DataFrame:
    """faces (face, ...) with label, the smallest face that each is connected with in a slab; links, of how many there it is the smaller face; own, false for
    the row of a shared face in the slab before its own; and shared."""
    tets, each = _tetrahedra(grid), 12 * grid.plane * frames_of(grid)
    kept = ", ".join(f"{c} {t}" for c, t in faces.dtypes)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("face", ignore_index=True)
        face = part["face"].to_numpy(np.int64)
        x, y = links_within(face, tets)
        part["label"] = face[least_within(len(face), x, y)]
        part["links"] = np.bincount(x, minlength=len(face))
        part["own"] = face // each == part["slab"].to_numpy(np.int64)
        part["shared"] = (face % each < 12 * grid.plane) & (face % 12 < 2) & (face >= each)
        return part.drop(columns="slab")

    return by_slab(faces, grid).groupBy("slab").applyInPandas(run, f"{kept}, label long, links long, own boolean, shared boolean")


def components(faces: DataFrame, grid: Grid, rounds: int = 60) -> DataFrame:
    """labelled() faces with component, the smallest face that each is connected with in all."""
    from .checkpoints import written
    from .components import connected

    rows = written(labelled(faces, grid), "slabs")
    between = rows.filter("shared").groupBy("face").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b")
    found = connected(between.select("a", "b"), rounds)
    return rows.join(found.withColumnRenamed("id", "label"), "label", "left").withColumn("component", F.coalesce("component", "label"))


def _ranked_within(n: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, place, length) of 0 to n - 1, of which none has more than two links: the smaller end of its path, how many links it is away from that, and the path's.

    A loop begins at its smallest number and goes on to that one's smaller neighbour; its length is 0.
    """
    here, there = np.r_[x, y], np.r_[y, x]
    order = np.lexsort((there, here))
    here, there = here[order], there[order]
    many = np.bincount(here, minlength=n)
    near = np.full((n, 2), -1)
    near[here, np.arange(len(here)) - np.repeat(np.cumsum(many) - many, many)] = there
    # a step 2 * v + k goes from v to near[v, k], and on from there, until a path ends
    at = near.ravel()
    goes = at >= 0
    went = np.where(near[at, 0] == np.repeat(np.arange(n), 2), 1, 0)
    on = np.where(goes & (near[at, went] >= 0), 2 * at + went, -1)
    steps = goes.astype(np.int64)
    at = np.where(goes, at, np.repeat(np.arange(n), 2))
    for _ in range(int(2 * n).bit_length() + 1):
        more = on >= 0
        if not more.any():
            break
        to = on[more]
        steps[more], at[more], on[more] = steps[more] + steps[to], at[to], on[to]
    at, steps, loop = at.reshape(-1, 2), steps.reshape(-1, 2), (on.reshape(-1, 2) >= 0).any(1)
    low = at.argmin(1)[:, None]
    end, place, length = np.take_along_axis(at, low, 1)[:, 0], np.take_along_axis(steps, low, 1)[:, 0], steps.sum(1)
    length[loop] = 0
    seen = np.zeros(n, bool)
    for v in np.flatnonzero(loop):  # ascending, so the first of a loop is its smallest
        was, k, first = v, 0, v
        now = near[v, 0]
        while not seen[v]:
            seen[v], end[v], place[v] = True, first, k
            was, v, k = v, now, k + 1
            now = near[v, 1] if near[v, 0] == was else near[v, 0]
    return end, place, length


def chains(faces: DataFrame, grid: Grid) -> DataFrame:
    """(face, x, y, off, w) of zero faces (face) none of which has more than two links; faces without links have no row.

    Paths that end within a slab, and loops: off is the place of face from x, and y the smallest face.  Others are cut into stretches (x, y) of w links (face is null), with the
    faces within them (w is null), off links behind x.  The ends of a path, its smallest face, and the neighbours of these are ends of stretches.
    """
    tets, each = _tetrahedra(grid), 12 * grid.plane * frames_of(grid)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        face = np.sort(part["face"].to_numpy(np.int64))
        x, y = links_within(face, tets)
        linked, pair = np.unique(np.r_[x, y], return_inverse=True)
        face, n = face[linked], len(linked)
        x, y = pair[: len(x)], pair[len(x) :]
        least = least_within(n, x, y)
        end, place, length = _ranked_within(n, x, y)
        order = np.lexsort((place, end))
        face, least, end, place, length = face[order], face[least[order]], face[end[order]], place[order], length[order]
        shared = (face % each < 12 * grid.plane) & (face % 12 < 2) & (face >= each)
        begins = np.flatnonzero(place == 0)
        chain = np.cumsum(place == 0) - 1
        last = np.r_[begins[1:], n] - 1 if n else begins
        whole = ((length == 0) | ~(shared[begins] | shared[last])[chain]) if n else np.zeros(0, bool)
        at_least = place[face == least][chain] if n else place
        stop = (place <= 1) | (place >= length - 1) | (np.abs(place - at_least) <= 1)
        number = np.arange(n)
        before = np.maximum.accumulate(np.where(stop, number, 0)) if n else number
        behind = np.minimum.accumulate(np.where(stop, number, n)[::-1])[::-1] if n else number
        inner = ~whole & ~stop
        to = np.flatnonzero(~whole & stop & (place > 0))
        since = before[to - 1]
        return pd.DataFrame({
            "face": np.r_[face[whole], face[inner], np.zeros(len(to), np.int64)],
            "x": np.r_[end[whole], face[before[inner]], face[since]],
            "y": np.r_[least[whole], face[behind[inner]], face[to]],
            "off": np.r_[place[whole], (place - place[before])[inner], np.zeros(len(to), np.int64)],
            "w": np.r_[np.full(whole.sum(), -1), np.zeros(inner.sum(), np.int64), place[to] - place[since]],
        })

    made = by_slab(faces.select("face"), grid).groupBy("slab").applyInPandas(run, "face long, x long, y long, off long, w long")
    whole, link = F.col("w") < 0, F.col("w") > 0
    return made.select(F.when(~link, F.col("face")).alias("face"), "x", "y", "off", F.when(link | whole, F.col("w")).alias("w"))


def ranked(faces: DataFrame, grid: Grid, rounds: int = 60) -> DataFrame:
    """(node, first, place, low), as critical.ranked_paths(), of zero faces (face) that have links; only stretches between slabs go through its rounds."""
    from ..operators.critical import ranked_paths
    from .checkpoints import written

    rows = written(chains(faces, grid), "chains")
    stretches = rows.filter("w > 0").select("x", "y", "w")
    ends = written(ranked_paths(stretches, stretches.select(F.col("x").alias("node")).union(stretches.select("y")).distinct(), rounds), "ranks")
    begin, end = (ends.select(F.col("node").alias(c), F.col("first").alias("first_" + c), F.col("place").alias("place_" + c), F.col("low").alias("low_" + c)) for c in "xy")
    both = stretches.join(begin, "x").join(end, "y").select("x", "y", F.col("first_x").alias("first"), F.col("place_x").alias("place"), F.when(F.col("place_x") < F.col("place_y"), 1).otherwise(-1).alias("way"), F.col("low_x").alias("low"))
    within = rows.filter("w is null").join(both, ["x", "y"]).select(F.col("face").alias("node"), "first", (F.col("place") + F.col("way") * F.col("off")).alias("place"), "low")
    whole = rows.filter("w < 0").select(F.col("face").alias("node"), F.col("x").alias("first"), F.col("off").alias("place"), F.col("y").alias("low"))
    return ends.select("node", "first", "place", "low").unionByName(within).unionByName(whole)
