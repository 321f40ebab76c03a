import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from swirlframe.functions import scalars as S
from swirlframe.operators import coding


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=40))
def test_huffman_lengths(counts):
    n = coding.code_lengths(counts)
    if len(counts) == 1:
        assert n == [0]
        return
    assert abs(sum(2.0**-x for x in n) - 1) < 1e-12
    codes = coding.canonical_codes(n)
    words = sorted(format(c, f"0{k}b") for c, k in zip(codes, n, strict=True))
    assert all(not b.startswith(a) for a, b in zip(words, words[1:], strict=False))


def _sequence(spark, seed):
    rng = random.Random(seed)
    x = [rng.choice([0, 0, 0, 1, 5, 9]) for _ in range(80)]
    return x, spark.createDataFrame([(1, k, v) for k, v in enumerate(x)], "g int, k long, x long")


def test_runs_and_back(spark):
    x, df = _sequence(spark, 1)
    runs = coding.zero_runs(df, ["g"], "k", "x")
    back = [r.sym for r in coding.unzero_runs(runs, ["g"]).orderBy("place", "k").collect()]
    assert back == x
    assert sum(r.n for r in coding.tri_runs(df, ["g"], "k", "x").collect()) == len(x)
    assert coding.zero_runs(df.limit(0), ["g"], "k", "x").count() == 0


def test_differences_and_zigzag(spark):
    from pyspark.sql import functions as F

    x, df = _sequence(spark, 2)
    z = [r.sym for r in coding.delta_zigzag(df, ["g"], "k", "x").orderBy("k").collect()]
    total, out = 0, []
    for s in z:
        total += s // 2 if s % 2 == 0 else -(s + 1) // 2
        out.append(total)
    assert out == x
    d = spark.range(-5, 6).select("id", S.unzigzag(S.zigzag(F.col("id"))).alias("b"))
    assert all(r.id == r.b for r in d.collect())


def test_bound_ids(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 4, 7, 8, 2**40, 2**62 - 1)], "eb long")
    a, b = S.quantize_bound(F.col("eb"))
    c, d = S.quantize_bound_offset(F.col("eb"))
    for r in rows.select("eb", a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")).collect():
        assert (r.a, r.b) == ((0, 0) if r.eb <= 1 else (r.eb.bit_length() - 1, 1 << (r.eb.bit_length() - 1)))
        assert r.d == (1 << (r.c - 1)) <= max(r.eb, 1) < 2 * r.d


def test_quantize_value(spark):
    from pyspark.sql import functions as F

    rows = [(random.Random(k).randint(-10**6, 10**6), random.Random(k + 99).randint(-10**6, 10**6), e) for k in range(40) for e in (0, 1, 8, 64)]
    df = spark.createDataFrame(rows, "x long, p long, e long")
    code, value, ok = S.quantize_value(F.col("x"), F.col("p"), F.col("e"))
    for r in df.select("x", "p", "e", code.alias("c"), value.alias("v"), ok.alias("ok")).collect():
        assert abs(r.v - r.x) <= r.e and (r.ok or r.v == r.x)
        if r.ok:
            assert r.v == r.p + 2 * (r.c - 32768) * r.e


def test_exponent_and_powers(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(x,) for x in (1.0, 0.75, 8.0, 7.999999999, 2.0**-30)], "x double")
    assert [r[0] for r in df.select(S.exponent(F.col("x"))).collect()] == [0, -1, 3, 2, -30]
    n = spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 5, 1000)], "x long")
    assert [r[0] for r in n.select(S.next_power_of_two(F.col("x"))).collect()] == [1, 2, 4, 4, 8, 1024]


def test_streams_of_codes(spark):
    rng = random.Random(7)
    for x in ([5] * 20, [rng.choice([1, 1, 1, 2, 3, -4]) for _ in range(200)], []):
        kinds = sorted(set(x))
        n = coding.code_lengths([x.count(k) for k in kinds])
        table = {k: (a, c) for k, a, c in zip(kinds, n, coding.canonical_codes(n), strict=True)}
        data = coding.encode_stream(x, table)
        if x:
            assert coding.decode_stream(data, len(x), table) == x
        assert len(data) == -(-sum(table[s][0] for s in x) // 8)
    for width in (1, 2, 4):
        v = [rng.randrange(1 << width) for _ in range(37)]
        assert coding.unpack_bits(coding.pack_bits(v, width), 37, width) == v


def test_shared_tables():
    """Streams and tables come back; codes are as long as the limit allows, and the table-driven reader agrees with reading bit by bit."""
    from swirlframe.operators.coding import decode_stream
    from swirlframe.plans.streams import Table, huffman, limited_lengths, unhuffman

    rng = np.random.default_rng(4)
    skewed = np.round(rng.standard_t(1.5, 20_000) * 4).astype(np.int64)
    for symbols in (skewed, np.array([7] * 9), np.arange(-300, 300), np.zeros(0, np.int64), np.array([5, -(2**30)]), np.repeat(np.arange(40), 2 ** np.minimum(np.arange(40), 12))):
        assert unhuffman(huffman(symbols)).tolist() == symbols.tolist()
        kinds, n = np.unique(symbols, return_counts=True)
        for most in (9, 16, 40):
            table = Table.of(dict(zip(kinds.tolist(), n.tolist(), strict=True)), most)
            assert table.lengths.max(initial=0) <= max(most, (len(kinds) - 1).bit_length() + 1) and (len(kinds) < 2 or sum(2.0 ** -x for x in table.lengths.tolist()) <= 1)
            again = Table.from_bytes(table.to_bytes())
            assert again.kinds.tolist() == table.kinds.tolist() and again.lengths.tolist() == table.lengths.tolist()
            part = symbols[:500]
            body = table.write(part)
            assert again.read(body).tolist() == part.tolist()
            if len(kinds) > 1:
                assert decode_stream(body[4:], len(part), {int(k): (int(x), int(c)) for k, x, c in zip(table.kinds, table.lengths, table.codes, strict=True)}) == part.tolist()
    with pytest.raises(ValueError):
        Table.of({1: 2, 3: 4}).write(np.array([2]))
    assert max(limited_lengths([2**k for k in range(30)], 12)) <= 12


def test_byte_pairs_of_slices(spark, monkeypatch):
    """Texts are counted some bytes at once, wherever that cuts them; working memory does not grow with a batch."""
    import tracemalloc
    from collections import Counter

    import pyarrow as pa

    texts = [("a", "aab"), ("b", ""), (None, "héllo" * 3), ("a", None), ("b", "x"), ("a", "b" * 40)]
    want: Counter = Counter()
    for name, text in texts:
        body = (text or "").encode()
        want.update((name, b, s) for b, s in zip([-1, *body], body, strict=False))
    taken = {}
    frame = spark.createDataFrame(texts, "g string, s string")
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, out: taken.setdefault("run", run) and self.selectExpr("g", "1 before", "1 sym", "1L n"))
    coding.byte_pairs(frame, "g", "s")
    monkeypatch.undo()
    for at_once in (1, 7, 1 << 20):
        monkeypatch.setattr(coding, "BYTES_AT_ONCE", at_once)
        got: Counter = Counter()
        for b in taken["run"](iter([pa.RecordBatch.from_pydict({"g": [g for g, _ in texts], "s": [s for _, s in texts]})])):
            for r in b.to_pylist():
                got[r["g"], r["before"], r["sym"]] += r["n"]
        assert got == want
    large = pa.RecordBatch.from_pydict({"g": ["a"] * 100, "s": ["xyz" * 70_000] * 100})  # 21 MB
    tracemalloc.start()
    assert sum(sum(b.column(3).to_pylist()) for b in taken["run"](iter([large]))) == 21_000_000
    assert tracemalloc.get_traced_memory()[1] < 80 << 20
    tracemalloc.stop()
