"""Merkle manifests and WARC archives, against brute force and by exact round trips."""

import base64
import gzip
import hashlib
import os
import zlib

import pytest
from helpers import docs, odd_rows
from pyspark.sql import functions as F

from swirlframe.llm import merkle as m
from swirlframe.llm import warc as w


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, at):
    return [(at % 2 ** (k + 1) >> k, level[(at >> k) ^ 1] if (at >> k) ^ 1 < len(level) else None) for k, level in enumerate(tree[:-1])]


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded) of (doc_id, source, lang, n_chars, text), in any order."""
    leaf = lambda r: H(*map(field, r))
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in order:
        langs[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[x] = levels([leaf(r) for r in langs[x]])
    top = levels([trees[x][-1][0] for x in order])
    out = []
    for n, x in enumerate(order):
        for at, r in enumerate(langs[x]):
            path = siblings(trees[x], at) + siblings(top, n)
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            got = leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r)
            for left, s in path:
                got = H(got) if s is None else H(s, got) if left else H(got, s)
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], H(*(s for _, s in path if s)), got, got == top[-1][0]))
    return sorted(out, key=repr)


def audited(spark, rows, stride):
    frame = spark.createDataFrame([(*r, "tree", 5, "-", "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, idx int, leaf string, Level string")
    return sorted((tuple(r) for r in m.audit(frame, stride=stride).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("stride", [1, 3, 12])
def test_manifest(spark, stride):
    """Trees of 1 to 70 leaves; nulls everywhere, repeated ids and rows, languages that are names of other trees."""
    rows = [(i, t, lang, n, t) for n, (i, t, *_) in enumerate(odd_rows()) for lang in (None, "", "-", "/")]
    rows += [(k, "s", "en", k if k % 5 else None, f"text {k}") for k in range(70)] + [(1, "s", "fr", 1, "alone"), (7, None, "zz", None, None)] * 2
    rows += [(k, "é", "日本", 1, "x") for k in range(2, 10)]
    assert audited(spark, rows, stride) == brute(rows)


def test_small_manifests(spark):
    one = [(3, "s", None, 1, "x")]
    assert audited(spark, one, 2) == brute(one)
    assert brute(one)[0][4] == H()
    assert audited(spark, [], 2) == []
    two = [(3, "s", None, 1, "x"), (4, "s", "a", 1, "x")]
    assert audited(spark, two, 2) == brute(two)


def test_order_and_proofs_of_some(spark):
    """The root does not depend on the order of rows; proofs of asked coordinates hold for their leaf only."""
    frame = docs(spark, [(k, f"t{k}", "ab"[k % 2]) for k in range(50)])
    columns = ["doc_id", "text", "a"]
    one, two = m.manifest(frame, columns, stride=2), m.manifest(frame.repartition(7).orderBy(F.desc("doc_id")), columns, stride=2)
    assert one.root == two.root
    assert m.manifest(frame.withColumn("a", F.when(F.col("doc_id") == 11, 8).otherwise(F.col("a"))), columns, stride=2).root != one.root
    got = one.proofs(one.store.leaves.filter("id in (0, 11, 49)").select("tree", "idx", "id", "leaf"))
    rows = got.select("id", m.folded(F.lower(F.hex("leaf")), F.col("siblings")).alias("root"), m.folded(F.lit(H("other")), F.col("siblings")).alias("other")).collect()
    assert len(rows) == 3 and all(r.root == one.root != r.other for r in rows)
    # each level of the store is the one below, two by two
    for tree in ("=a", "=b"):
        here = [[r.digest.hex() for r in one.store.level(k).filter(F.col("tree") == tree).orderBy("idx").collect()] for k in range(one.store.height + 1)]
        assert here == levels(here[0])


PAGES = "page_id long, url string, html string, _payload string, _many int, value string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "v") for r in rows], PAGES)


def odd_pages():
    texts = [None, "", "x", "\r\n\r\n", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n", "\n\n\n", "no end\r", "é" * 70_000, "nul \0 and \x1a", "w" * 300_000, "<html>\n one</html>\n"]
    urls = ["http://a/", None, "http://b/x y\r\nWARC-Type: revisit", "http://c/é?%20"]
    rows = [(k, urls[k % 4], t) for k, t in enumerate(texts * 3)]
    return [*rows, rows[-1], rows[5], (None, "u", "x"), (None, None, "only here"), (100, "u", None)]


def brute_pages(rows, least):
    out = []
    for i, _, t in rows:
        body = (t or "").encode()
        same = [j for j, _, x in rows if (x or "").encode() == body and j is not None]
        keep = max(same) if len(body) >= least and same else i
        again = keep != i
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", keep if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 2])
def test_archives(spark, least):
    rows = odd_pages()
    got = w.round_trip(pages(spark, rows).repartition(3), least=least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_pages(rows, least)
    assert w.round_trip(pages(spark, [])).count() == 0


def test_members_and_index(spark, tmp_path):
    """What the index names are whole gzip files; payloads come back to the byte, also of a few rows of the index."""
    rows = [r for r in odd_pages() if r[0] is not None]
    index = w.archived(pages(spark, rows).repartition(2), f"file://{tmp_path}/out")
    stated = index.collect()
    assert {r.record_type for r in stated} == {"response", "revisit"}
    for name in {r.archive for r in stated}:
        data = open(name.removeprefix("file:"), "rb").read()
        mine = sorted((r.offset, r.length) for r in stated if r.archive == name)
        assert [a + n for a, n in mine] == [a for a, _ in mine[1:]] + [len(data)]
        assert all(gzip.decompress(data[a : a + n]).startswith(b"WARC/1.1\r\n") and gzip.decompress(data[a : a + n]).endswith(b"\r\n\r\n") for a, n in mine)
        assert gzip.decompress(data) == b"".join(gzip.decompress(data[a : a + n]) for a, n in mine)
    texts = {i: (t or "").encode() for i, _, t in rows}
    back = w.read_records(index.filter("record_type = 'response'")).select("payload", "target_uri", w.page_of(F.col("record_id"), rows and pages(spark, rows).schema["page_id"].dataType).alias("i")).collect()
    assert all(bytes(r.payload) == texts[r.i] for r in back) and {r.i for r in back} >= {29, 30, 31, 32, 100}
    assert all(r.target_uri == "http://b/x%20y%0D%0AWARC-Type:%20revisit" for r in back if r.i % 4 == 2 and r.i < 33)


def test_other_archives(spark, tmp_path):
    """Files of other writers: many members, other records, any bytes; and files that end too early."""
    raw = bytes(range(256)) * 3
    record = lambda kind, body, more=b"": b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nContent-Length: " + str(len(body)).encode() + b"\r\n" + more + b"\r\n" + body + b"\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\n" + raw
    parts = [record(b"warcinfo", b"software: x"), record(b"response", http, b"warc-target-uri: http://z/\r\n"), record(b"request", b"GET /")]
    os.mkdir(tmp_path / "in")
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "in" / "b.warc.gz").write_bytes(gzip.compress(b"".join(parts)))
    (tmp_path / "in" / "none.warc.gz").write_bytes(gzip.compress(b""))
    index = w.normalise(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    assert index.count() == 6
    got = w.read_records(index.filter("record_type = 'response'")).collect()
    assert [bytes(r.payload) for r in got] == [raw, raw] and {r.target_uri for r in got} == {"http://z/"}
    os.mkdir(tmp_path / "bad")
    (tmp_path / "bad" / "a.warc.gz").write_bytes(gzip.compress(b"".join(parts)[:-9]))
    with pytest.raises(Exception, match="behind the last whole record"):
        w.normalise(spark, f"file://{tmp_path}/bad", f"file://{tmp_path}/out2")
