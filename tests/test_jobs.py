"""The jobs: two runs over growing input give what one run over all of it gives, also if a run is stopped in between."""

import json
import math
import os
import shutil
import subprocess
import sys
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from support import SF, spark_rows

from jobs import critical_catalogue as cc
from jobs import queries as q
from jobs import symbol_survey as ss
from jobs.common import settings


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_query(spark, duck, name):
    cols, rows = spark_rows(q.QUERIES[name](spark, SF))
    assert rows and (cols, rows) == duck(q.SQL[name])


def rows_of(df):
    return spark_rows(q.rounded(df))[1]


def test_catalogue_grows(spark, tmp_path):
    """Frames come in pieces that end within frames and within chunks; a stopped run is done again."""
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    src, out, given = f"{tmp_path}/in", f"{tmp_path}/out", {"frames_per_chunk": 4}
    cc.run(spark, f"{SF}/embeddings.parquet", f"{tmp_path}/once", given)
    once = rows_of(cc.catalogue(spark, f"{tmp_path}/once"))

    def grow(a, b):
        table.filter((F.col("vec_id") >= a) & (F.col("vec_id") < b)).repartition(2).write.mode("append").parquet(src)

    grow(0, 6 * 25 + 7)
    assert cc.run(spark, src, out, given)["frames"] == 6
    files = {f for _, _, names in os.walk(f"{out}/points/chunk=0") for f in names}
    assert {r[-1] for r in cc.catalogue(spark, out).select("chunk").distinct().collect()} == {0, 1}
    assert cc.run(spark, src, out, given) == {"frames": 6, "first_frame": None, "n_points": 0}
    grow(6 * 25 + 7, 9 * 25)
    assert cc.run(spark, src, out, given)["first_frame"] == 4
    assert {f for _, _, names in os.walk(f"{out}/points/chunk=0") for f in names} == files  # what is done stays as it is
    # stopped after its points were written, before its mark was
    grow(9 * 25, 500)
    shutil.copytree(f"{out}/marks", f"{tmp_path}/marks")
    assert cc.run(spark, src, out, given)["frames"] == 20
    assert rows_of(cc.catalogue(spark, out)) == once
    shutil.rmtree(f"{out}/marks")
    shutil.copytree(f"{tmp_path}/marks", f"{out}/marks")
    assert cc.run(spark, src, out, given)["first_frame"] == 8
    assert rows_of(cc.catalogue(spark, out)) == once
    table.limit(0).write.parquet(f"{tmp_path}/fewer")
    with pytest.raises(ValueError, match="fewer than"):
        cc.run(spark, f"{tmp_path}/fewer", out, given)
    with pytest.raises(ValueError, match="was made with the settings"):
        cc.run(spark, src, out, {"frames_per_chunk": 4, "shift": 20})


def test_catalogue_of_odd_input(spark, tmp_path):
    """No frames give no rows; gaps, repeated rows, nulls, NaN, short rows and large values stop the run before it writes."""
    given = {"rows": 3, "columns": 2}
    good = [(k, [math.sin(3.0 * k + 7 * c) for c in range(4)], "x", 1) for k in range(12)]

    def run(rows, name, **more):
        spark.createDataFrame(rows, "vec_id long, embedding array<double>, u string, chunk int").write.parquet(f"{tmp_path}/in-{name}")
        return cc.run(spark, f"{tmp_path}/in-{name}", f"{tmp_path}/{name}", given | more)

    assert run([], "none") == {"frames": 0, "first_frame": None, "n_points": 0}
    assert cc.catalogue(spark, f"{tmp_path}/none").count() == 0
    assert run(good[:5], "one")["frames"] == 1
    changed = lambda k, row: [*good[:k], (k, row, "x", 1), *good[k + 1 :]]
    bad = {"gap": [*good[:4], *good[5:], (12, good[0][1], "x", 1)], "twice": [*good[:11], good[2]], "null": changed(3, None), "none": changed(3, [1.0, None, 0.5, 1.0]), "nan": changed(3, [1.0, math.nan, 0.5, 1.0]), "short": changed(3, [1.0]), "large": changed(3, [1.0, 2.0**9, 0.5, 1.0])}
    for name, rows in bad.items():
        with pytest.raises(ValueError, match="once each|no value|does not fit"):
            run(rows, f"bad-{name}")
        assert not os.path.exists(f"{tmp_path}/bad-{name}")
    assert run(bad["large"], "fits", shift=20)["frames"] == 4
    with pytest.raises(ValueError, match="no setting"):
        settings(cc.NAME, {"row": 3})


LANG = T.StructField("lang", T.StringType())


def brute(rows):
    """The survey of (lang, text), byte by byte."""
    groups = defaultdict(list)
    for lang, text in rows:
        if text:
            groups[lang].append(text.encode())
    out = []
    for lang, texts in groups.items():
        one, pair = Counter(), Counter()
        for t in texts:
            one.update(t)
            pair.update(zip([-1, *t[:-1]], t, strict=True))
        n = sum(one.values())
        befores = Counter()
        for (b, _), k in pair.items():
            befores[b] += k
        h0 = -sum(k * math.log2(k / n) for k in one.values())
        h1 = -sum(k * math.log2(k / befores[b]) for (b, _), k in pair.items())
        heap, size = sorted(one.values()), 0
        while len(heap) > 1:
            size += heap[0] + heap[1]
            heap = sorted([heap[0] + heap[1], *heap[2:]])
        out.append((round(h0 / n, 6) + 0.0, size, lang, n, n - sum(k for (b, s), k in pair.items() if b == s), len(one), len(texts), round(h1 / n, 6) + 0.0, "null" if lang is None else "=" + lang))
    return sorted(out, key=repr)


def got(spark, out):
    rows = q.rounded(ss.survey(spark, out, LANG)).select("entropy_bits", "huffman_bits", "lang", "n_bytes", "n_runs", "n_symbols", "n_texts", "order1_bits", "part").collect()
    return sorted((tuple(x + 0.0 if isinstance(x, float) else x for x in r) for r in rows), key=repr)


FIRST = [("en", "aaab  bb"), ("en", None), (None, "no language"), ("", "empty name"), ("=en", "x/y"), ("en", ""), ("fr", "été" * 2000), ("none", None)]
SECOND = [("en", "more of it"), ("null", "a name"), (None, "é\0\n"), ("fr", "a"), *[(f"l{k}", "ab" * k) for k in range(300)]]


def test_survey_grows(spark, tmp_path):
    src, out, at = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"

    def grow(rows, parts):
        spark.createDataFrame([(lang, t, 7, "x") for lang, t in rows], "lang string, text string, before int, sym string").repartition(parts).write.mode("append").parquet(src)

    grow(FIRST, 3)
    given = {"files_per_batch": 1}
    assert ss.run(spark, src, out, at, given)["n_rows"] == len(FIRST)
    assert got(spark, out) == brute(FIRST)
    assert ss.run(spark, src, out, at, given)["n_rows"] == 0
    assert got(spark, out) == brute(FIRST)
    grow(SECOND, 2)
    assert ss.run(spark, src, out, at, given)["n_rows"] == len(SECOND)
    assert got(spark, out) == brute(FIRST + SECOND)
    # stopped after the counts of the last batch were written, before it was committed, and before the survey
    last = max(int(f) for f in os.listdir(f"{at}/commits") if f.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        os.remove(f"{at}/commits/{name}")
    shutil.rmtree(f"{out}/survey")
    ss.run(spark, src, out, at, given)
    assert got(spark, out) == brute(FIRST + SECOND)
    # a lost checkpoint: all is counted again
    assert ss.run(spark, src, out, f"{tmp_path}/other")["n_rows"] == len(FIRST + SECOND)
    assert got(spark, out) == brute(FIRST + SECOND)


def test_survey_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "lang string, text string").write.parquet(f"{tmp_path}/in")
    ss.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert ss.survey(spark, f"{tmp_path}/out", LANG).count() == 0


def test_command_line(tmp_path):
    """Settings from a file; the log says what was read and written."""
    (tmp_path / "s.json").write_text(json.dumps({"frames_per_chunk": 5}))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-m", "jobs.critical_catalogue", f"{SF}/embeddings.parquet", f"{tmp_path}/out", "--settings", f"{tmp_path}/s.json"], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read frames 0 to 19" in done.stderr and "points of frames 0 to 19" in done.stderr
    assert len([d for d in os.listdir(tmp_path / "out" / "points") if d.startswith("chunk=")]) == 4
