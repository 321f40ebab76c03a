from swirlframe.grid import Grid, fixed_scale, swirl_field, to_fixed
from swirlframe.operators import critical, mesh
from swirlframe.streaming import frames as fr


def test_frames_out_of_order(spark, tmp_path):
    g = Grid(5, 6, 5)
    field = swirl_field(spark, g, "focus")
    p = to_fixed(field, fixed_scale(field))
    rows = {r.t: r for r in fr.frames(p).collect()}
    out = state = None
    for k, t in enumerate([2, 0, 0, 4, 1, 3]):
        spark.createDataFrame([rows[t]], fr.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out, state = f"{tmp_path}/out", f"{tmp_path}/state"
        got = fr.run_to_end(fr.frame_changes(fr.read_frames(spark, f"{tmp_path}/in")), out, state)
    assert sorted(r.t for r in got.collect()) == [0, 1, 2, 3, 4]
    from pyspark.sql import functions as F

    before = p.select((F.col("t") + 1).alias("t"), "i", "j", F.col("u").alias("x"), F.col("v").alias("y"))
    want = p.join(before, ["t", "i", "j"], "left").groupBy("t").agg(F.sum(F.abs(F.col("u") - F.coalesce("x", F.lit(0))) + F.abs(F.col("v") - F.coalesce("y", F.lit(0)))).alias("s"))
    assert {r.t: r.s for r in want.collect()} == {r.t: r.sum_abs for r in got.collect()}


def test_stream_equals_table(spark, tmp_path):
    g = Grid(5, 6, 5)
    field = swirl_field(spark, g, "saddle")
    p = to_fixed(field, fixed_scale(field))
    fr.frames(p).write.parquet(f"{tmp_path}/in")
    got = fr.run_to_end(fr.layer_counts(fr.read_frames(spark, f"{tmp_path}/in", 1), g), f"{tmp_path}/out", f"{tmp_path}/state")
    want = {r.t: r.n for r in critical.count_by_layer(mesh.zero_faces(p, g, mesh.FACES[:2])).collect()}
    assert {r.t: r.n for r in got.collect() if r.n} == want


def test_encoder_on_a_stream(spark, tmp_path):
    """Frames in any order, some twice: the blocks are those of the table, to the byte."""
    import pytest

    from swirlframe.plans import codec
    from swirlframe.streaming import encoder as en

    g, block = Grid(9, 10, 7), (3, 5, 4)
    field = swirl_field(spark, g, "focus").selectExpr("t", "i", "j", "cast(u as float) u", "cast(v as float) v")
    s = fixed_scale(field)
    eb = codec.bound_for(s, 0.05)
    rows = {r.t: r for r in en.real_frames(field).collect()}
    for t in [2, 0, 0, 5, 1, 4, 6, 3]:
        spark.createDataFrame([rows[t]], en.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = fr.run_to_end(en.encode_stream(en.read_real_frames(spark, f"{tmp_path}/in"), (9, 10), s, eb, block, 7), f"{tmp_path}/out", f"{tmp_path}/state")
    want = codec.encode(field, g, s, eb, block=block)
    assert got.drop("field").exceptAll(want).count() == 0 and got.count() == want.count() == 3 * 2 * 3
    table = en.encode_stream(en.real_frames(field), (9, 10), s, eb, block, 7)
    assert table.drop("field").exceptAll(want).count() == 0
    open_ = en.encode_stream(en.real_frames(field), (9, 10), s, eb, block)  # the end is not known
    assert open_.select("bt").distinct().count() == 2
    with pytest.raises(Exception, match="before its turn"):
        en.encode_stream(en.real_frames(field.filter("t > 0")), (9, 10), s, eb, block, ahead=2).collect()


def test_a_long_stream_in_any_order(spark, tmp_path):
    """Files that come long before those before them: more frames than may wait in one state."""
    from swirlframe.plans import codec
    from swirlframe.streaming import encoder as en

    rows = [("f", t, [t, -t, 2 * t, t % 7], [t % 5, 0, t, 1]) for t in range(1400)]
    flat = [r[2] + r[3] for r in rows]
    for part in (rows[1300:], rows[:700], rows[700:1300]):
        spark.createDataFrame(part, fr.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = fr.run_to_end(fr.frame_changes(fr.read_frames(spark, f"{tmp_path}/in", 1)), f"{tmp_path}/out", f"{tmp_path}/state")
    change = [[abs(x - y) for x, y in zip(now, before)] for now, before in zip(flat, [[0] * 8, *flat])]
    assert sorted((r.t, r.sum_abs, r.max_abs) for r in got.collect()) == [(t, sum(d), max(d)) for t, d in enumerate(change)]

    g, block = Grid(3, 4, 600), (5, 3, 4)
    field = swirl_field(spark, g, "focus", drift=0.01).selectExpr("t", "i", "j", "cast(u as float) u", "cast(v as float) v")
    s = fixed_scale(field)
    eb = codec.bound_for(s, 0.05)
    frames = en.real_frames(field)
    for part in ("t >= 550", "t < 300", "t >= 300 and t < 550"):
        frames.filter(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/real")
    coded = en.encode_stream(en.read_real_frames(spark, f"{tmp_path}/real", 1), (3, 4), s, eb, block, 600)
    got, want = fr.run_to_end(coded, f"{tmp_path}/coded", f"{tmp_path}/state2").drop("field"), codec.encode(field, g, s, eb, block=block)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() == 120
