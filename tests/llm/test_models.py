import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs, odd_rows, prose
from pyspark.sql import functions as F
from support import SF

from swirlframe.llm import language, quality
from swirlframe.llm.shared import held_out

WORDS = {"xx": ["aba", "bab", "cac"], "yy": ["zuz", "éöé", "wyw"], "zz": ["мир", "год", "дом"]}


def _corpus(spark, n=240):
    rng = random.Random(9)
    return docs(spark, [(k, prose(rng, rng.randint(4, 40), WORDS[lang]), lang) for k in range(n) for lang in [rng.choice(list(WORDS))]])


def test_languages_are_told_apart(spark):
    d = _corpus(spark)
    got = language.identify(d).join(d.select("doc_id", "lang"), "doc_id")
    assert got.filter("held_out and lang <> lang_pred").count() == 0 and got.filter("held_out").count() > 20
    assert got.filter("score < 0 or score > 1 or score is null").count() == 0


def test_odd_rows_have_defined_languages(spark):
    d = _corpus(spark).union(docs(spark, [(10_000 + i if i is not None else None, t, None) for i, t in odd_rows()]))
    got = {(r.doc_id, r.n_keys): r for r in language.identify(d).filter("doc_id is null or doc_id >= 10000").collect()}
    for (i, _), r in got.items():
        assert (r.lang_pred == "und") == (r.n_keys == 0)
        if r.lang_pred == "und":
            assert r.score == 0 and r.entropy is None
    kept = {r.doc_id for r in language.keep_identified(d).collect()}
    assert not kept & {10_001, 10_002, 10_003, 10_009, 10_011} and kept >= {k for k in range(240)}


def test_without_learning_rows(spark):
    none = docs(spark, [])
    assert language.identify(none).count() == 0 and language.keep_identified(none).count() == 0
    blind = docs(spark, [(1, "abc", None), (2, "def", None)])
    assert {r.lang_pred for r in language.identify(blind).collect()} == {"und"}


def test_probabilities_sum_to_one():
    rng = random.Random(2)
    texts = [prose(rng, 30, WORDS["xx"]) for _ in range(20)]
    keys, _, _ = language.letter_keys(pa.array(texts))
    k, n = np.unique(keys, return_counts=True)
    m = language.KneserNey(["xx"], np.zeros(len(k), int), k.view(np.int64), n)
    for context in (np.unique(k >> np.uint64(16))[:30].tolist() + [12345]):
        every = (np.uint64(context) << np.uint64(16)) + np.arange(1 << 16, dtype=np.uint64)
        assert abs(np.exp(m.logs(every).astype(float)).sum() - 1) < 1e-4


def _kneser_ney(grams):
    """log P(last letter | the others) by the definition, from counts {4-gram: n}."""
    levels = [dict(grams)]
    while len(next(iter(levels[0]))) > 1:
        shorter = {}
        for g in levels[0]:
            shorter[g[1:]] = shorter.get(g[1:], 0) + 1
        levels.insert(0, shorter)

    def p(g):
        if not g:
            return 2.0**-16
        c = levels[len(g) - 1]
        ones, twos = (sum(v == x for v in c.values()) for x in (1, 2))
        d = min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones else 0.5
        same = [v for h, v in c.items() if h[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        return max(c.get(g, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * p(g[1:])

    return p


def test_kneser_ney_by_definition():
    rng = random.Random(5)
    texts = {l: [prose(rng, 6, WORDS[l]) for _ in range(4)] for l in ("xx", "yy")}
    parts = [language._count(language.letter_keys(pa.array(texts[l]))[0]) for l in ("xx", "yy")]
    lang = np.concatenate([np.full(len(k), i) for i, (k, _) in enumerate(parts)])
    m = language.KneserNey(["xx", "yy"], lang, np.concatenate([k for k, _ in parts]).view(np.int64), np.concatenate([n for _, n in parts]))
    asked = np.unique(np.concatenate([parts[0][0], parts[1][0], language.letter_keys(pa.array(["bazz мир 中文 ab", "q"]))[0]]))
    gram = lambda k: tuple(int(k) >> 16 * j & 0xFFFF for j in (3, 2, 1, 0))
    for l in (0, 1):
        p = _kneser_ney({gram(k): int(n) for k, n in zip(*parts[l], strict=True)})
        assert np.allclose(np.exp(m.logs(asked)[:, l].astype(float)), [p(gram(k)) for k in asked], rtol=1e-4)


def test_keys_by_hand():
    keys, first, letters = language.letter_keys(pa.array(["Ab c!", None, "", "7", "b", "\u0301", "中😀𝒜"]))
    assert first.tolist() == [0, 5, 5, 5, 5, 6, 7, 10] and letters.tolist() == [3, 0, 0, 0, 1, 0, 2]
    pack = lambda *x: sum(ord(v) << 16 * (3 - i) if v else 0 for i, v in enumerate(x))
    assert keys[:6].tolist() == [pack("", "", "", "a"), pack("", "", "a", "b"), pack("", "a", "b", ""), pack("a", "b", "", "c"), pack("b", "", "c", ""), pack("", "", "", "b")]
    assert keys[7] == pack("", "", "", "中") and 0xE000 <= int(keys[9]) & 0xFFFF < 0xE000 + 6400


def test_scripts_do_not_mix(spark):
    rng = random.Random(3)
    words = {"aa": ["东西", "南北", "上下"], "bb": ["大小", "多少", "天地"], "cc": ["क्या", "नाम", "है"], "dd": ["मराठी", "आहे", "काय"]}
    rows = [(k, prose(rng, rng.randint(3, 12), words[l]), l) for k in range(200) for l in [rng.choice(list(words))]]
    d = docs(spark, [*rows, (1000, "hello world in another script", None), (1001, "\u0301\u0301", None)])
    got = {r.doc_id: r for r in language.identify(d).collect()}
    assert all(got[k].lang_pred == l and not got[k].rejected for k, _, l in rows)
    assert got[1000].rejected and got[1001].lang_pred == "und" and got[1001].rejected


def test_models_as_tables_give_the_same_rows(spark, monkeypatch):
    """With models too large to be sent, and with all joins shuffled: odd rows, repeated rows, texts in scripts that no language has."""
    from swirlframe.plans import skew

    more = [(10_000 + i if i is not None else None, t, None) for i, t in odd_rows()] + [(20_000, "中😀文 aba", None), (20_000, "中😀文 aba", None)]
    d = _corpus(spark).union(docs(spark, more)).select("doc_id", "text", "lang")

    def rows():
        return sorted((str(r.doc_id), r.n_keys, r.lang_pred, r.held_out, r.rejected, round(r.score, 3), round(r.entropy or -1, 4)) for r in language.identify(d).collect())

    sent = rows()
    monkeypatch.setattr(language, "SENT", -1)
    assert rows() == sent and len(sent) == d.count()
    monkeypatch.setattr(skew, "BROADCAST", 0)
    monkeypatch.setattr(skew, "FEW", 50)
    monkeypatch.setattr(skew, "SHARE", 10**9)
    assert rows() == sent


def test_rejected_rows_go_by_text(spark):
    d = _corpus(spark).union(docs(spark, [(7, "中文 中文 中文 中文", None), (None, "中文 中文 中文", None), (None, "aba bab", None)]))
    left = [(r.doc_id, r.text) for r in language.keep_identified(d).collect()]
    assert len(left) == 241 and 7 in {i for i, _ in left} and (None, "aba bab") in left and not any("中" in t for _, t in left)


def test_counts_take_all_rows(spark):
    d = _corpus(spark, 60)
    c = language.key_counts(d, ["xx", "yy"]).groupBy("lang").agg(F.sum("n").alias("n")).collect()
    want = {}
    for r in d.filter("lang in ('xx', 'yy')").collect():
        keys, _, _ = language.letter_keys(pa.array([r.text]))
        want[["xx", "yy"].index(r.lang)] = want.get(["xx", "yy"].index(r.lang), 0) + len(keys)
    assert {r.lang: r.n for r in c} == want


def test_held_out_share(spark):
    import zlib

    rows = spark.range(2000).select(F.col("id").alias("doc_id"), held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_quality_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.quality_scores(d, labels)
    assert got.count() == d.count() and got.filter("score < 0 or score > 1 or (predicted = 1) <> (score >= 0.3)").count() == 0
    j = got.filter("held_out").join(labels.groupBy("doc_id").agg(F.max("quality").alias("q")), "doc_id")
    assert j.filter("q = predicted").count() / j.count() > 0.95


def test_quality_of_odd_rows(spark):
    d = docs(spark, odd_rows())
    some = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (7, None), (8, 0), (5, 1), (11, 0), (2, 1)], "doc_id long, quality int")
    for labels in (some, some.limit(0)):
        got = quality.quality_scores(d, labels).collect()
        assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
        empty = {r.score for r in got if r.doc_id in (1, 2)}
        assert len(empty) == 1
    assert quality.quality_scores(docs(spark, []), some).count() == 0


def test_nnpu_risk_is_least():
    rng = np.random.default_rng(1)
    p, u = rng.normal(1, 1, (200, 2)), rng.normal(0, 1.5, (400, 2))
    prior, decay = 0.3, 1e-4
    w, b, c, s = quality.fit_nnpu(p, u, prior, decay=decay)

    def risk(w, b):  # the definition, over all rows
        zp, zu = (p - c) / s @ w + b, (u - c) / s @ w + b
        return prio(zp) + max(0.0, np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()) + decay / 2 * (w @ w)

    def prio(zp):
        return prior * np.logaddexp(0, -zp).mean()

    best = risk(w, b)
    assert all(risk(w + rng.normal(0, t, 2), b + rng.normal(0, t)) >= best - 1e-4 for t in (0.01, 0.1, 0.5, 2) for _ in range(100))


def test_nnpu_finds_the_side():
    rng = np.random.default_rng(0)
    p = rng.normal(1.5, 1, (400, 3))
    u = np.concatenate([rng.normal(1.5, 1, (500, 3)), rng.normal(-1.5, 1, (500, 3))])
    w, b, c, s = quality.fit_nnpu(p, u, 0.5)
    z = ((u - c) / s) @ w + b
    assert ((z > 0) == (np.arange(1000) < 500)).mean() > 0.93


def test_quality_is_the_fit_over_all_rows(spark):
    """The whole operator against the same risk minimised over arrays of all learning rows, by gradient steps of its definition."""
    rng = random.Random(4)
    junk = lambda: prose(rng, 30) + " " + " ".join(rng.choice(["$$$", "BUY!!!", "|||"]) for _ in range(rng.randint(0, 20)))
    rows = [(i, junk() if i % 3 == 0 else prose(rng, 40)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.quality_scores(docs(spark, rows), labels).collect()}
    kept = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5]
    x = quality.features(pa.array([t for _, t in rows]))
    u, p = x[kept], x[[i for i in kept if i % 2 == 0 and i % 3]]
    sums = quality._of_arrays(p, u)
    centre, scale, n = quality.spread_of(sums)
    assert tuple(n) == (len(p), len(u)) and np.allclose(centre, np.concatenate([p, u]).mean(0))
    first, _ = quality.minimised(sums, centre, scale, 0.5)
    prior = quality.pool_prior(sums, first / scale)
    w, b, _, _ = quality.fit_nnpu(p, u, prior)
    want = 1 / (1 + np.exp(-((x - centre) / scale @ w + b)))
    assert max(abs(got[i] - want[i]) for i in got) < 1e-3

    def risk(w, b):
        zp, zu = ((a - centre) / scale @ w + b for a in (p, u))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        return prior * np.logaddexp(0, -zp).mean() + max(0.0, negative) + 5e-5 * (w @ w)

    least, noise = risk(w, b), np.random.default_rng(2)
    near = [risk(w + noise.normal(0, t, len(w)), b + noise.normal(0, t)) for t in (0.001, 0.01, 0.1) for _ in range(200)]
    assert min(near) >= least - 1e-4


@pytest.mark.parametrize("text", ["", "a", "THE!! CAT!!", "x " * 50, "é" * 100])
def test_features_are_finite(text):
    f = quality.features(pa.array([text, None]))
    assert f.shape == (2, quality.SIZE) and np.isfinite(f).all() and (f[1] == 0).all()


def test_unlabelled_documents_enter(spark, monkeypatch):
    rng = random.Random(8)
    junk = lambda: " ".join(rng.choice(["$$$", "BUY!!!", "|||", "###", "WIN!!!"]) for _ in range(80))
    rows = [(i, junk() if i % 2 else prose(rng, 80)) for i in range(1200)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(1200) if i % 2 == 0 and i < 600 or i % 40 == 1], "doc_id long, quality int")  # of junk, few have a label
    seen, fit = [], quality.minimised
    monkeypatch.setattr(quality, "minimised", lambda sums, c, s, prior: seen.append((quality.spread_of(sums)[2][1], prior)) or fit(sums, c, s, prior))
    got = quality.quality_scores(docs(spark, rows), labels).collect()
    assert seen[-1][0] == spark.range(1200).filter(~held_out("id")).count() and abs(seen[-1][1] - 0.5) < 0.1
    assert sum(r.predicted == 1 - r.doc_id % 2 for r in got) >= 0.98 * len(rows)
