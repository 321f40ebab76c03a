import base64

import numpy as np
import pytest

from swirlframe.grid import Grid, swirl_field
from swirlframe.sources import amira, raw, reports


def test_raw_round_trip(spark, tmp_path):
    g = Grid(3, 5, 4)
    field = swirl_field(spark, g)
    for c in "uv":
        assert raw.write_raw(field, c, f"{tmp_path}/{c}.bin", "<f8") == g.size * 8
    back = raw.read_field(spark, f"{tmp_path}/u.bin", f"{tmp_path}/v.bin", g, "<f8")
    assert back.join(field.withColumnsRenamed({"u": "x", "v": "y"}), ["t", "i", "j"]).filter("u = x and v = y").count() == g.size
    assert raw.read_frame(spark, f"{tmp_path}/u.bin", g, 2, "<f8").count() == g.H
    assert raw.repacked(field).count() == 2 * g.size
    with pytest.raises(ValueError):
        raw.read_rows(spark, f"{tmp_path}/u.bin", Grid(3, 5, 5), "u", "<f8")


@pytest.mark.parametrize("form", ["LE", "BE", "ascii", "base64", "unmarked"])
def test_amira(spark, tmp_path, form):
    x = np.arange(24, dtype="f4").reshape(2, 3, 2, 2) - 7.5
    token = {"BE": "BINARY-BIG-ENDIAN", "ascii": "ASCII"}.get(form, "BINARY-LITTLE-ENDIAN")
    head = f"# AmiraMesh {token} 2.1\ndefine Lattice 2 3 2\nParameters {{ {'Encoding \"Base64\"' if form == 'base64' else ''} }}\nLattice {{ float[2] Data }} @1\n\n# Data section follows\n@1\n"
    data = {"LE": x.astype("<f4").tobytes(), "BE": x.astype(">f4").tobytes(), "ascii": " ".join(map(str, x.ravel())).encode()}.get(form, base64.b64encode(x.astype("<f4").tobytes()))
    (tmp_path / "a.am").write_bytes(head.encode() + data)
    rows = amira.read_amira(spark, str(tmp_path / "a.am")).collect()
    assert len(rows) == 12
    for r in rows:
        assert r["values"] == x[r.t, r.i, :, r.component].tolist()


def test_amira_headers_that_are_wrong():
    with pytest.raises(ValueError):
        amira.split(b"nothing here")
    with pytest.raises(ValueError):
        amira.parse_header("define Lattice 1 2 3")
    with pytest.raises(ValueError):
        amira.values(amira.Lattice(2, 2, 2, "float", 1, "<", "binary"), b"\x00" * 8)


def test_reports(spark, tmp_path):
    counts = spark.createDataFrame([(0, 3), (2, 5)], "t int, n long")
    reports.write_counts(counts, f"{tmp_path}/c")
    assert [r.n for r in reports.read_counts(spark, f"{tmp_path}/c").collect()] == [3, 0, 5]
    (tmp_path / "odd.txt").write_text("1\nx\n\n 7 \n2.5\n")
    assert [r.n for r in reports.read_counts(spark, f"{tmp_path}/odd.txt").collect()] == [1, 7]
    conf = spark.createDataFrame([("layer", 0, 1, 2, 3, 4), ("layer", 1, 1, 0, 0, 1), ("slab", None, 9, 9, 9, 9)], "region string, idx int, tp long, tn long, fp long, fn long")
    reports.write_confusion(conf, f"{tmp_path}/f")
    back = reports.read_confusion(spark, f"{tmp_path}/f")
    assert back.count() == 2
    assert reports.confusion_sums(back).first().asDict() == {"region": "layer", "tp": 2, "tn": 2, "fp": 3, "fn": 5}
    pts = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.25)], "t int, simplex_id long, x double")
    reports.write_points(pts, f"{tmp_path}/p")
    assert reports.read_points(spark, f"{tmp_path}/p").filter("t = 1").count() == 1
    curve = spark.createDataFrame([(1, k, float(k), 0.0, 0.0) for k in range(3)] + [(2, 0, 5.0, 0.0, 0.0)], "component long, place long, x double, y double, t double")
    reports.write_polydata(curve, f"{tmp_path}/c.vtp")
    text = (tmp_path / "c.vtp").read_text()
    assert 'NumberOfPoints="4" NumberOfLines="2"' in text and "3\n4\n" in text
    back = reports.read_polydata(spark, f"{tmp_path}/c.vtp").collect()
    assert [(r.line, r.place, r.x) for r in back] == [(0, 0, 0.0), (0, 1, 1.0), (0, 2, 2.0), (1, 0, 5.0)]


def test_amira_header_forms():
    one = "# Avizo BINARY-LITTLE-ENDIAN 2.1\n\ndefine   Lattice 4 5 6\nParameters {\n  CoordType \"uniform\"\n}\nLattice { float Field } = @1\n"
    assert amira.parse_header(one) == amira.Lattice(4, 5, 6, "float", 1, "<", "binary")
    two = "# AmiraMesh 3D ASCII 2.0\nDEFINE lattice 1 2 3\nLattice {Double[3] Data} @1"
    assert amira.parse_header(two) == amira.Lattice(1, 2, 3, "double", 3, "<", "ascii")
    for wrong in ("define Lattice 1 2\nLattice { float Data } @1", "define Lattice 1 2 3\nLattice { text Data } @1"):
        with pytest.raises(ValueError):
            amira.parse_header(wrong)
    assert amira.split(b"a\n# Data section follows\r\n\n@1\nxyz") == ("a\n", b"xyz") and amira.split(b"#  x\n# Data section follows\n@2x\n")[1] == b"@2x\n"


@pytest.mark.parametrize("encoding", ["binary", "ascii"])
def test_amira_field_round_trip(spark, tmp_path, encoding):
    g = Grid(3, 5, 4)
    field = swirl_field(spark, g)
    amira.write_amira(field, g, f"{tmp_path}/f.am", encoding)
    back = amira.read_amira_field(spark, f"{tmp_path}/f.am").drop("path")
    want = field.selectExpr("t", "i", "j", "cast(cast(u as float) as double) u", "cast(cast(v as float) as double) v")
    assert back.exceptAll(want).count() == 0 and back.count() == g.size


def test_netcdf(spark, tmp_path):
    from swirlframe.sources import netcdf

    g = Grid(3, 5, 4)
    field = swirl_field(spark, g).selectExpr("t", "i", "j", "case when j = 2 then null else u end as u", "v")
    netcdf.write_netcdf(field, g, f"{tmp_path}/f.nc", 1e20)
    back = netcdf.read_netcdf_field(spark, f"{tmp_path}/f.nc").drop("path")
    want = field.selectExpr("t", "i", "j", "cast(coalesce(u, 0) as float) u", "cast(v as float) v")
    assert back.exceptAll(want).count() == 0 and back.count() == g.size
    body = whole(tmp_path / "f.nc")
    assert body[:4] == b"CDF\x01" and len(body) % 4 == 0
    with pytest.raises(ValueError, match="no variable 'w'"):
        netcdf.read_netcdf_field(spark, f"{tmp_path}/f.nc", "u", "w")
    (tmp_path / "hdf").write_bytes(b"\x89HDF\r\n")
    with pytest.raises(ValueError, match="not a NetCDF file"):
        netcdf.read_netcdf_field(spark, f"{tmp_path}/hdf")


def test_netcdf_of_other_writers(spark, tmp_path):
    """Variables without records, of 16-bit numbers; and one record variable alone, of doubles; with long attributes before them."""
    import struct

    from swirlframe.sources import netcdf

    text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    dims = lambda *n: struct.pack(">ii", 10, len(n)) + b"".join(text(f"d{k}") + struct.pack(">i", x) for k, x in enumerate(n))
    note = struct.pack(">ii", 12, 1) + text("history") + struct.pack(">ii", 2, 200_000) + b"x" * 200_000
    plain = b"CDF\x02" + struct.pack(">i", 0) + dims(2, 3, 4) + note + struct.pack(">ii", 11, 3)
    of = lambda name, kind, size, begin, attributes=struct.pack(">ii", 0, 0): text(name) + struct.pack(">iiii", 3, 0, 1, 2) + attributes + struct.pack(">iiq", kind, size, begin)
    mark = struct.pack(">ii", 12, 1) + text("missing_value") + struct.pack(">iih", 3, 1, -7) + b"\0\0"
    size = len(plain) + len(of("u", 3, 48, 0, mark)) + len(of("v", 3, 48, 0)) + len(text("x") + struct.pack(">ii", 1, 2) + struct.pack(">ii", 0, 0) + struct.pack(">iiq", 6, 32, 0))
    body = plain + of("u", 3, 48, size, mark) + of("v", 3, 48, size + 48) + text("x") + struct.pack(">ii", 1, 2) + struct.pack(">ii", 0, 0) + struct.pack(">iiq", 6, 32, size + 96)
    u, v = (np.arange(24) - 9).astype(">i2"), (np.arange(24) * 3).astype(">i2")
    (tmp_path / "a.nc").write_bytes(body + u.tobytes() + v.tobytes() + bytes(32))
    got = netcdf.read_netcdf_field(spark, f"{tmp_path}/a.nc", most=16)
    assert got.rdd.getNumPartitions() == 6
    assert [(r.u, r.v) for r in got.orderBy("t", "i", "j").collect()] == [(0 if x == -7 else x, y) for x, y in zip(u.tolist(), v.tolist(), strict=True)]
    with pytest.raises(ValueError, match="one shape"):
        netcdf.read_netcdf_field(spark, f"{tmp_path}/a.nc", "u", "x")
    alone = b"CDF\x01" + struct.pack(">i", 3) + dims(0, 1, 2) + struct.pack(">iiii", 0, 0, 11, 1) + text("u") + struct.pack(">iiii", 3, 0, 1, 2) + struct.pack(">ii", 0, 0)
    x = np.arange(6, dtype=">f8")
    (tmp_path / "b.nc").write_bytes(alone + struct.pack(">iii", 6, 16, len(alone) + 12) + x.tobytes())
    assert [r.u for r in netcdf.read_netcdf_field(spark, f"{tmp_path}/b.nc", "u", "u").orderBy("t", "j").collect()] == x.tolist()


def whole(path) -> bytes:
    """A file written in parts."""
    return b"".join(p.read_bytes() for p in sorted(path.glob("part-*")))


def test_one_file_is_many_tasks(spark, tmp_path):
    """A file is split at any number of bytes, whoever wrote it; what is written in parts is the same file to the byte."""
    g = Grid(6, 8, 10)
    field = swirl_field(spark, g).selectExpr("t", "i", "j", "cast(u as float) u", "cast(v as float) v")
    u, v = (np.array([r[0] for r in field.orderBy("t", "i", "j").select(c).collect()], "<f4") for c in "uv")
    for c, x in (("u", u), ("v", v)):
        (tmp_path / f"{c}.bin").write_bytes(x.tobytes())
        raw.write_raw(field, c, f"{tmp_path}/{c}", most=300)
        assert whole(tmp_path / c) == x.tobytes() and len(list((tmp_path / c).glob("part-*"))) == 7
    for names in (("u.bin", "v.bin"), ("u", "v")):
        got = raw.read_field(spark, *(f"{tmp_path}/{n}" for n in names), g, most=200)
        assert got.rdd.getNumPartitions() == 20
        assert got.exceptAll(field.selectExpr("t", "i", "j", "cast(u as double) u", "cast(v as double) v")).count() == 0 and got.count() == g.size
    assert raw.read_frame(spark, f"{tmp_path}/u", g, 7, most=64).rdd.getNumPartitions() == 3
    head = "# AmiraMesh BINARY-BIG-ENDIAN 2.1\ndefine Lattice 8 6 10\nParameters { " + "x" * 70_000 + " }\nLattice { float[2] Data } @1\n# Data section follows\n@1\n"
    (tmp_path / "b.am").write_bytes(head.encode() + np.stack([u, v], 1).astype(">f4").tobytes() + b"\n")
    amira.write_amira(field, g, f"{tmp_path}/a.am", most=500)
    for name in ("a.am", "b.am"):
        rows = amira.read_amira_field(spark, f"{tmp_path}/{name}", most=640)
        assert rows.rdd.getNumPartitions() == 6
        assert [r.u for r in rows.orderBy("t", "i", "j").collect()] == u.tolist()
    assert whole(tmp_path / "a.am").endswith(np.stack([u, v], 1).tobytes()) and whole(tmp_path / "a.am").startswith(b"# AmiraMesh")
    assert amira.read_amira(spark, f"{tmp_path}/*.am").filter("path like '%b.am'").count() == 120  # a pattern of files


def test_parts_that_are_not_whole(spark, tmp_path):
    """A gap or a row that is there twice raises and leaves the file as it was; a new file replaces the old one's parts."""
    g = Grid(3, 2, 4)
    field = swirl_field(spark, g)
    raw.write_raw(field, "u", f"{tmp_path}/u", "<f8", most=20)
    before = whole(tmp_path / "u")
    for bad in (field.filter("not (t = 1 and i = 1)"), field.filter("t <> 2")):
        with pytest.raises(Exception, match="is not there once|pieces"):
            raw.write_raw(bad, "u", f"{tmp_path}/u", "<f8", most=20)
        assert raw.read_rows(spark, f"{tmp_path}/u", g, "u", "<f8").count() == 12
    raw.write_raw(field.selectExpr("t", "i", "j", "u + 1 as u"), "u", f"{tmp_path}/u", "<f8", most=50)
    assert np.frombuffer(whole(tmp_path / "u"), "<f8").tolist() == (np.frombuffer(before, "<f8") + 1).tolist()
    with pytest.raises(ValueError, match="the grid needs"):
        raw.read_rows(spark, f"{tmp_path}/u", Grid(3, 2, 5), "u", "<f8")


def test_image_and_frames(spark, tmp_path):
    g = Grid(3, 5, 4)
    field = swirl_field(spark, g)
    raw.write_image(field, g, f"{tmp_path}/f.vti")
    text = whole(tmp_path / "f.vti").decode()
    assert 'WholeExtent="0 4 0 2 0 3"' in text and len(text.split("ascii\">\n")[1].split("</DataArray>")[0].split()) == 2 * g.size
    raw.write_raw(field, "u", f"{tmp_path}/u.bin", "<f8")
    for t in (0, 3):
        got = raw.read_frame(spark, f"{tmp_path}/u.bin", g, t, "<f8").orderBy("i").collect()
        want = np.frombuffer(whole(tmp_path / "u.bin"), "<f8").reshape(4, 3, 5)[t]
        assert [r.u for r in got] == want.tolist()
    with pytest.raises(ValueError):
        raw.read_frame(spark, f"{tmp_path}/u.bin", g, 4, "<f8")


def test_points_of_many_frames_are_few_files(spark, tmp_path):
    from swirlframe.sources import reports

    points = spark.range(1000).repartition(5).selectExpr("cast(id div 5 as int) t", "id simplex_id", "id * 0.5 x")
    reports.write_points(points, f"{tmp_path}/points")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{tmp_path}/points")
    assert files.count() <= 4
    assert sorted(tuple(r) for r in reports.read_points(spark, f"{tmp_path}/points").select(points.columns).collect()) == sorted(tuple(r) for r in points.collect())
    assert sorted(r.simplex_id for r in reports.read_points(spark, f"{tmp_path}/points", 70).collect()) == list(range(350, 355))


def test_text_values_are_split_at_any_byte(spark, tmp_path):
    """Values as text are read by many tasks, whatever a range cuts: a value, a row, the white space between."""
    g = Grid(3, 5, 4)
    field = swirl_field(spark, g)
    amira.write_amira(field, g, f"{tmp_path}/a.am", "ascii", most=400)
    want = sorted(tuple(r) for r in field.selectExpr("t", "i", "j", "cast(cast(u as float) as double) u", "cast(cast(v as float) as double) v").collect())
    for most in (7, 64, 1000):
        rows = amira.read_amira_field(spark, f"{tmp_path}/a.am", most=most).drop("path")
        assert rows.rdd.getNumPartitions() >= 700 // most
        assert sorted(tuple(r) for r in rows.collect()) == want
    (tmp_path / "short.am").write_bytes(b"# AmiraMesh ASCII 2.1\ndefine Lattice 2 2 2\nLattice { float[2] Data } @1\n# Data section follows\n@1\n" + b"1 2 3\n" * 5)
    with pytest.raises(ValueError, match="15 values; the header says 16"):
        amira.read_amira_field(spark, f"{tmp_path}/short.am", most=8)


def test_polydata_in_parts(spark, tmp_path):
    """Trajectories of more points than a piece has, written and read by many tasks; in parts and as one file they are the same bytes."""
    from swirlframe.sources import reports

    curve = spark.range(2500).selectExpr("if(id < 7, 3L, if(id < 2480, 5L, id)) component", "id place", "id * 0.5 x", "-id * 0.25 y", "id * 1e-7 t").repartition(3)
    reports.write_polydata(curve, f"{tmp_path}/parts.vtp", parts=True, most=40_000)
    reports.write_polydata(curve, f"{tmp_path}/one.vtp")
    assert whole(tmp_path / "parts.vtp") == (tmp_path / "one.vtp").read_bytes() and len(list((tmp_path / "parts.vtp").glob("part-*"))) > 3
    for name, most in (("parts.vtp", 5000), ("one.vtp", 1 << 20)):
        back = reports.read_polydata(spark, f"{tmp_path}/{name}", most)
        assert [tuple(r) for r in back.groupBy("line").count().filter("line < 3").orderBy("line").collect()] == [(0, 7), (1, 2473), (2, 1)]
        got = back.orderBy("line", "place").collect()
        assert [r.x for r in got] == [k * 0.5 for k in range(2500)] and abs(got[2100].t - 2.1e-4) < 1e-12 and got[2100].place == 2093
    reports.write_polydata(curve.limit(0), f"{tmp_path}/none.vtp", parts=True)
    assert reports.read_polydata(spark, f"{tmp_path}/none.vtp").count() == 0


def test_what_is_read_as_text_is_not_taken_for_small(spark, tmp_path):
    """Values of a file may be many, whatever the number of its ranges: Spark's estimate broadcasts none of them, and none goes through the driver."""
    from swirlframe.sources import reports

    curve = spark.range(60).selectExpr("id div 7 component", "id place", "id * 0.5 x", "0D y", "0D t")
    reports.write_polydata(curve, f"{tmp_path}/c.vtp", parts=True, most=500)
    back = reports.read_polydata(spark, f"{tmp_path}/c.vtp", 200)
    plan = back._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "Broadcast" not in plan and back.count() == 60


def test_files_are_written_without_processes_beside_the_driver(spark, tmp_path):
    """The driver of a data source of the Python API keeps processes that plan and commit writes; parts that fail leave the file as it was."""
    import psutil

    from swirlframe.sources import parts

    pieces = spark.range(7).selectExpr("id at", "encode(string(id), 'UTF-8') body")
    parts.write_pieces(pieces, 7, f"{tmp_path}/f", 1, b"<", b">", most=3)
    for wrong in (pieces.filter("at <> 4"), pieces.union(pieces.filter("at = 5")), pieces.filter("at < 6")):
        with pytest.raises(Exception, match="piece"):
            parts.write_pieces(wrong, 7, f"{tmp_path}/f", 1, b"<", b">", most=3)
    source = parts.Bytes(of := parts.parts_of(spark, f"{tmp_path}/f"))
    assert source.read(0, parts.size_of(of)) == b"<0123456>" and len(of) == 5
    running = [" ".join(p.cmdline()) for p in psutil.Process().children(recursive=True)]
    assert not [x for x in running if "write_into_data_source" in x or "commit_data_source_write" in x]
