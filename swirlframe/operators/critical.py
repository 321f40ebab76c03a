"""Critical points: detection per layer, location, type, counts, per-vertex bounds, tracing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import quantize_bound
from ..functions.triangles import barycentric, has_zero, zero_bound, zero_type
from ..grid import Grid
from .mesh import FACES, faces, layer_faces, zero_faces

SIX = ("ua", "va", "ub", "vb", "uc", "vc")


def _six() -> list[Column]:
    return [F.col(x) for x in SIX]


def layer_points(field: DataFrame, grid: Grid) -> DataFrame:
    """(t, i, j, tmpl, simplex_id, x, y, type): the critical points of every frame.

    simplex_id = 2 * (i * (W - 1) + j) + (0 for template 1, 1 for template 2), within a frame.
    """
    found = layer_faces(field, grid).filter(has_zero(*_six()))
    _, mb, mc = barycentric(*_six())
    upper = F.col("tmpl") == 1
    x = F.col("j") + F.when(upper, mc).otherwise(mb + mc)
    y = F.col("i") + F.when(upper, mb + mc).otherwise(mc)
    simplex = (F.col("i") * (grid.W - 1) + F.col("j")) * 2 + F.col("tmpl") - 1
    return found.select("t", "i", "j", "tmpl", simplex.cast("long").alias("simplex_id"), x.alias("x"), y.alias("y"), zero_type(*_six(), upper).alias("type"))


def interior_points(field: DataFrame, grid: Grid) -> DataFrame:
    """layer_points() of cells at least one cell away from the border of the frame."""
    return layer_points(field, grid).filter(F.col("i").between(1, grid.H - 3) & F.col("j").between(1, grid.W - 3))


def count_by_layer(zero: DataFrame) -> DataFrame:
    """(t, n): zero faces of each frame itself."""
    return zero.filter("tmpl <= 2").groupBy("t").agg(F.count("*").alias("n"))


def vertex_bounds(field: DataFrame, grid: Grid, most: int, templates: list = FACES, symmetric: bool = False) -> DataFrame:
    """(vid, required_eb): how far each vertex alone may move with all its faces' verdicts unchanged; at most ``most``.

    0 where a face of the vertex holds a zero.  Faces are summed up per cube before anything is shuffled.
    """
    f = faces(field, grid, templates)
    last = {"a": "bca", "b": "acb", "c": "abc"}  # the vertex that moves comes last
    bound = {me: zero_bound(*(F.col(x + n) for n in order for x in "uv")) for me, order in last.items()}
    if symmetric:
        bound = dict.fromkeys(last, F.least(*bound.values()))
    none = F.lit(0).cast("long")
    marked = f.select(*last, has_zero(*_six()).alias("zero"), *(x.alias(f"eb_{me}") for me, x in bound.items()))
    sides = [F.struct(F.col(me).alias("vid"), F.when(F.col("zero"), none).otherwise(F.col(f"eb_{me}")).alias("eb")) for me in last]
    per = marked.select(F.explode(F.array(*sides)).alias("s")).select("s.*")
    return per.groupBy("vid").agg(F.least(F.min("eb"), F.lit(most).cast("long")).alias("required_eb"))


def relative_vertex_bounds(field: DataFrame, grid: Grid, typed: bool = False) -> DataFrame:
    """(t, i, j, share): by how large a share all vertices may move at once with no verdict (typed: and no type) of a triangle of their frames changed.

    field holds real values; the least share of the (up to) six triangles of a vertex, at most 1.
    """
    from ..functions import relative

    f = layer_faces(field, grid)
    named = [F.col(x + n).cast("double").alias(x + str(k)) for k, n in enumerate("abc") for x in "uv"]
    rows = f.select("tmpl", "a", "b", "c", *named)
    parts = []
    for tmpl in (1, 2):
        made = relative.columns((tmpl == 1) if typed else None)
        one = rows.filter(F.col("tmpl") == tmpl).withColumns({c: F.expr(e) for c, e in made.items()})
        parts.append(one.select(F.explode(F.array("a", "b", "c")).alias("vid"), F.expr(relative.offline_bound(typed)).alias("share")))
    per = parts[0].unionByName(parts[1]).groupBy("vid").agg(F.least(F.min("share"), F.lit(1.0)).alias("share"))
    t, i, j = (c.cast("int") for c in grid.coordinates("vid"))
    return per.select(t.alias("t"), i.alias("i"), j.alias("j"), "share")


def bound_ids(bounds: DataFrame) -> DataFrame:
    """bounds with eb_id and abs_eb: the power of two that is stored."""
    id_, eb = quantize_bound(F.col("required_eb"))
    return bounds.withColumn("eb_id", id_).withColumn("abs_eb", eb)


def zero_graph(zero: DataFrame, grid: Grid) -> DataFrame:
    """(x, y), x < y: pairs of zero faces that are sides of one tetrahedron.  A face's name is 12 * (vid of its cube) + tmpl - 1."""
    from ..plans import slabs

    return slabs.links(zero.select((grid.vid() * 12 + F.col("tmpl") - 1).alias("face")), grid)


def zero_components(zero: DataFrame, grid: Grid, rounds: int = 60) -> DataFrame:
    """(face, component): trajectories as connected zero faces, named by their smallest face; single faces are their own."""
    from ..plans import slabs

    nodes = zero.select((grid.vid() * 12 + F.col("tmpl") - 1).alias("face"))
    return slabs.components(nodes, grid, rounds).filter("own").select("face", "component")


def located(zero: DataFrame, grid: Grid) -> DataFrame:
    """zero with face (its name), and where it is crossed: x, y and at, in columns, rows and frames."""
    weights = barycentric(*_six())
    at = dict.fromkeys("tij")
    for k, axis in enumerate("tij"):
        total = F.lit(0.0)
        for m, n in zip(weights, "abc", strict=True):
            total = total + m * grid.coordinates(F.col(n))[k]
        at[axis] = total
    return zero.select("*", (grid.vid() * 12 + F.col("tmpl") - 1).alias("face"), at["j"].alias("x"), at["i"].alias("y"), at["t"].alias("at"))


def zero_samples(zero: DataFrame, grid: Grid) -> DataFrame:
    """(face, x, y, t): where each zero face is crossed, in columns, rows and frames."""
    return located(zero, grid).select("face", "x", "y", F.col("at").alias("t"))


def curves(zero: DataFrame, grid: Grid, rounds: int = 60) -> DataFrame:
    """(component, n_faces, is_loop, t_first, t_last, x_first, y_first, x_last, y_last) of each trajectory.

    A loop has as many links as faces.  First and last are by frame (ties: by face).
    """
    from ..plans import slabs

    found = slabs.components(zero_samples(zero, grid), grid, rounds)
    sample = F.when(F.col("own"), F.struct("t", "face", "x", "y"))
    per = found.groupBy("component").agg(F.count(F.when(F.col("own"), 1)).alias("n_faces"), F.sum("links").alias("links"), F.min(sample).alias("f"), F.max(sample).alias("l"))
    return per.select(
        "component", "n_faces", (F.col("links") >= F.col("n_faces")).alias("is_loop"),
        F.col("f.t").alias("t_first"), F.col("l.t").alias("t_last"), F.col("f.x").alias("x_first"), F.col("f.y").alias("y_first"), F.col("l.x").alias("x_last"), F.col("l.y").alias("y_last"),
    )


def ranked_paths(links: DataFrame, nodes: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, first, place, low) of the paths and loops that links (x, y) make: how many links each node is away from the smaller end of
    its path, ``first``, and the smallest node of the path.  A loop is cut at its smallest node, behind the larger neighbour of that.

    links may have w, of how many links each stands for (stretches whose ends' neighbours are nodes).  nodes (node) has all of them, alone or not; a node has at most two links.  Each link is walked in both directions: a step looks at
    where its end has got to, and goes there at once, so the rounds grow with the logarithm of the longest path, and no task sees
    more of a path than the two steps that it joins.  Raises if ``rounds`` do not suffice.
    """
    from ..plans.checkpoints import written

    w = F.col("w") if "w" in links.columns else F.lit(1).cast("long")
    both = links.select("x", "y", w.alias("w")).union(links.select("y", "x", w)).distinct()
    onward = both.select(F.col("x").alias("y"), F.col("y").alias("_next"))
    # from x by y on to ``at``, after n links; from there the step (at, via) goes on, or at is the end.  low: the smallest node behind x
    begun = both.join(onward, "y").groupBy("x", "y", "w").agg(F.min(F.when(F.col("_next") != F.col("x"), F.col("_next"))).alias("via"))
    # as tables: a checkpoint hands its constraints on, which would double with each round
    steps = written(begun.select("x", "y", F.col("y").alias("at"), "via", F.col("w").alias("n"), F.col("y").alias("low"), "w"), "ranks")
    before = None
    for _ in range(rounds):
        now = tuple(steps.agg(F.count("via"), F.sum(F.when(F.col("via").isNotNull(), F.col("low").cast("decimal(38,0)")))).first())
        if not now[0] or now == before:  # all have ended, or only loops go on, whose smallest node every step has found
            break
        before = now
        far = steps.select(F.col("x").alias("at"), F.col("y").alias("via"), *(F.col(c).alias("_" + c) for c in ("at", "via", "n", "low")))
        went = steps.filter("via is not null").join(far, ["at", "via"]).select("x", "y", F.col("_at").alias("at"), F.col("_via").alias("via"), (F.col("n") + F.col("_n")).alias("n"), F.least("low", "_low").alias("low"), "w")
        steps = written(steps.filter("via is null").unionByName(went), "ranks")
    else:
        raise RuntimeError(f"no order after {rounds} rounds")
    reached = steps.filter("via is null").groupBy(F.col("x").alias("node")).agg(F.min(F.struct(F.col("at").alias("first"), F.col("n").alias("place"))).alias("end"), F.min("low").alias("low"), F.count("*").alias("n"))
    alone = nodes if not now[0] else nodes.join(steps.filter("via is not null").select(F.col("x").alias("node")).distinct(), "node", "left_anti")
    own = F.struct(F.col("node").alias("first"), F.lit(0).cast("long").alias("place"))
    placed = alone.join(reached, "node", "left").withColumn("end", F.when(F.col("n") == 2, F.col("end")).otherwise(F.least(F.coalesce("end", own), own)))
    out = placed.select("node", "end.first", "end.place", F.least(F.coalesce("low", F.col("node")), F.col("node")).alias("low"))
    if not now[0]:
        return out
    loops = steps.filter("via is not null").select("x", "y", "low", "w")
    behind = F.max(F.when(F.col("x") == F.col("low"), F.col("y"))).over(Window.partitionBy("x"))
    opened = loops.filter("x < y").join(loops.withColumn("y", behind).filter("x = low").select("x", "y").distinct(), ["x", "y"], "left_anti")
    return out.unionByName(ranked_paths(opened, loops.select(F.col("x").alias("node")).distinct(), rounds))


def ordered_curves(zero: DataFrame, grid: Grid, rounds: int = 60) -> DataFrame:
    """(component, strand, place, face, x, y, t): the samples of each trajectory in order along it, from its end with the smaller
    face; a loop from its smallest face, by way of that one's smaller neighbour.

    strand is the face that it begins with.  In a proper field a component is one strand.  A face with more than two neighbours, which only an
    improper one has, is a strand alone, and ends the ones that it parts.
    """
    from ..plans.checkpoints import cut

    zero = cut(zero.select("t", "i", "j", "tmpl", "a", "b", "c", *SIX))
    links = cut(zero_graph(zero, grid))
    samples = zero_samples(zero, grid)
    degree = links.select("x", "y").union(links.select("y", "x")).groupBy(F.col("x").alias("face")).agg(F.count("*").alias("n"))
    parting = cut(degree.filter("n > 2").select("face"))
    proper = parting.isEmpty()
    paths = links.join(parting.withColumnRenamed("face", "x"), "x", "left_anti").join(parting.withColumnRenamed("face", "y"), "y", "left_anti").select("x", "y")
    if proper:
        from ..plans import slabs

        ranked = slabs.ranked(samples, grid, rounds).withColumnsRenamed({"node": "face", "low": "component"})
        alone = samples.select("face").join(degree, "face", "left_anti").select("face", F.col("face").alias("first"), F.lit(0).cast("long").alias("place"), F.col("face").alias("component"))
        ranked = ranked.unionByName(alone)
    else:
        ranked = ranked_paths(paths, samples.select(F.col("face").alias("node")), rounds).withColumnRenamed("node", "face").drop("low").join(zero_components(zero, grid, rounds), "face")
    return ranked.join(samples, "face").select("component", F.col("first").alias("strand"), "place", "face", "x", "y", "t")


def speed(samples: DataFrame) -> DataFrame:
    """ordered_curves() with the displacement to the sample before; null for the first of a strand."""
    before = samples.select("strand", (F.col("place") + 1).alias("place"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    both = samples.join(before, ["strand", "place"], "left")
    return both.withColumn("step", F.sqrt(F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2))).drop("_x", "_y")


def all_zero_faces(field: DataFrame, grid: Grid, templates: list = FACES) -> DataFrame:
    return zero_faces(field, grid, templates)


def bilinear_points(field: DataFrame, grid: Grid) -> DataFrame:
    """(t, i, j, x, y, type): zeros of the bilinear field of each cell of each frame; a cell may have two."""
    from ..functions.triangles import bilinear_stages
    from ..grid import neighbours

    cells = neighbours(field, ["u", "v"], [(0, 0, 1), (0, 1, 0), (0, 1, 1)]).filter("u_2 is not null")
    found = cells.select("t", "i", "j", *(F.col(x + n).cast("double").alias(x + str(k)) for k, n in enumerate(("", "_0", "_1", "_2")) for x in "uv"))
    for cols, keep in bilinear_stages():
        found = found.withColumns(cols)
        found = found if keep is None else found.filter(keep)
    return found.select("t", "i", "j", (F.col("j") + F.col("_x")).alias("x"), (F.col("i") + F.col("_y")).alias("y"), F.col("_type").alias("type"))
