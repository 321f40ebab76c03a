"""Blocks coded in order: what they decode to is what one block of the whole field decodes to."""

import pytest
from pyspark.sql import functions as F

from swirlframe.grid import Grid, fixed_scale, swirl_field
from swirlframe.plans import codec, wavefront


def _field(spark, g, cols="uv"):
    base = swirl_field(spark, g, "focus").withColumns({c: F.col(c) + F.sin(F.col("i") * 0.7 + F.col("t") * n) * F.cos(F.col("j") * 0.9) for n, c in enumerate("uv", 1)})
    return base.withColumn("w", F.col("u") * 0.3 - F.col("v") * F.cos("t")).select("t", "i", "j", *(F.col(c).cast("float").alias(c) for c in cols)).cache()


@pytest.mark.parametrize(("predictor", "guard", "cols", "same"), [("lorenzo3d", "faces", "uv", True), ("mixed_order", "typed", "uv", True), ("dt2d", "none", "uv", True), ("time_linear", "layers", "uv", False), ("lorenzo3d", "tetrahedra", "uvw", True)])
def test_as_one_block(spark, predictor, guard, cols, same):
    """Sizes that blocks do not divide, and blocks that end with one vertex."""
    g = Grid(9, 11, 7)
    field = _field(spark, g, cols)
    s = fixed_scale(field, tuple(cols), 30 if len(cols) == 2 else 19)
    eb = codec.bound_for(s, 0.05)
    many = wavefront.encode(field, g, s, eb, predictor, (3, 4, 5), guard, cols)
    rows = wavefront.decode(many, g, s, predictor, (3, 4, 5), cols)
    names = [*"tij", *cols, *(f"{c}fp" for c in cols), "lossless"]
    got = sorted(tuple(r) for r in rows.select(names).collect())
    assert len(got) == g.size and codec.statistics(many, components=len(cols)).first().max_err <= eb
    assert 0 < sum(not r[-1] for r in got)
    whole = (g.T, g.H, g.W)
    one = codec.encode(field, g, s, eb, predictor, whole, guard=guard, cols=cols)
    want = sorted(tuple(r) for r in codec.decode(one, g, s, predictor, whole, cols=cols).select(names).collect())
    assert (got == want) is same
    by_place = {r[:3]: r[3:] for r in got}
    factor = float(s.factor)
    for r in field.collect():
        mine = by_place[tuple(r[:3])]
        assert all(abs(int(x * factor) - y) <= eb for x, y in zip(r[3:], mine[len(cols) : 2 * len(cols)], strict=True))
        assert not mine[-1] or mine[: len(cols)] == tuple(r[3:])


def test_one_frame_and_small_blocks(spark):
    for g, block in ((Grid(5, 6, 1), (1, 2, 2)), (Grid(1, 9, 4), (2, 1, 4)), (Grid(4, 4, 3), (4, 4, 4))):
        field = _field(spark, g)
        s = fixed_scale(field)
        back = wavefront.decode(wavefront.encode(field, g, s, 1 << 20, block=block), g, s, block=block)
        assert back.count() == g.size


def test_what_does_not_go(spark):
    g = Grid(4, 4, 4)
    field = _field(spark, g)
    s = fixed_scale(field)
    for how in ({"guard": "legacy"}, {"predictor": "advect"}, {"predictor": "time_linear", "block": (1, 2, 2)}):
        with pytest.raises(ValueError):
            wavefront.encode(field, g, s, 1 << 20, **how)


@pytest.mark.parametrize(("predictor", "back"), [("lorenzo3d", 1), ("mixed_order", 2)])
def test_segments_go_through_their_stages_at_once(spark, monkeypatch, predictor, back):
    """A longer field takes no more stages; only the last frames of a segment become lossless, and no face changes its verdict."""
    from swirlframe.grid import to_fixed
    from swirlframe.operators import verify

    written, read = [], wavefront._read
    monkeypatch.setattr(wavefront, "_read", lambda spark, out, stages: (written.append(max(stages)), read(spark, out, stages))[1])
    block, most = (3, 4, 5), []
    for frames in (13, 25):
        g = Grid(7, 9, frames)
        field = _field(spark, g)
        s = fixed_scale(field)
        eb = codec.bound_for(s, 0.05)
        written.clear()
        rows = wavefront.decode(wavefront.encode(field, g, s, eb, predictor, block, segment=2), g, s, predictor, block, segment=2).cache()
        assert rows.count() == g.size
        most.append(max(written))
        ends = [t for t in range(frames - 1) if (t // 3 % 2, t % 3 >= 3 - back) == (1, True) and t // 6 * 6 + 6 < frames]
        assert rows.filter(F.col("t").isin(ends) & ~F.col("lossless")).count() == 0 and rows.filter(~F.col("t").isin(ends) & ~F.col("lossless")).count() > g.size // 4
        both = to_fixed(field, s).join(rows.select("t", "i", "j", F.col("ufp").alias("du"), F.col("vfp").alias("dv")), ["t", "i", "j"])
        assert both.filter((F.abs(F.col("u") - F.col("du")) > eb) | (F.abs(F.col("v") - F.col("dv")) > eb)).count() == 0
        assert verify.marked_faces(both, g).filter("ori <> dec").count() == 0
    assert most[0] == most[1]
