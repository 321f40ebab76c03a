import random

import corpus_pipeline
from helpers import components, docs, edited, near, odd_rows, prose
from support import SF


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language id", "exact dedup", "near dedup", "decontamination", "packing"]


def test_stages_on_odd_rows(spark):
    rng = random.Random(11)
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").limit(3).collect()]
    base = prose(rng, 200)
    rows = [(100 + k, prose(rng, 50)) for k in range(25)] + [(200 + k, edited(rng, base, 0.006)) for k in range(5)] + [(300, bench[0]), (301, rows_text := prose(rng, 30)), (302, rows_text)] + odd_rows()
    d = docs(spark, rows)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r.doc_id for r in d.collect()}
        out = stage(spark, d, SF)
        assert out.columns == d.columns, name
        d = spark.createDataFrame(out.collect(), d.schema)
        after = {r.doc_id for r in d.collect()}
        gone = before - after
        if n == 0:
            assert gone >= {1, 2, 3, 9, 11} and not gone & set(range(100, 125))
        if n == 1:
            assert {5, 7, 301} <= gone and not gone & set(range(100, 125))
        if n == 2:
            texts = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
            assert all(near(texts, 5)[i] == i for i in texts) and not gone & set(range(100, 125)) and 200 in after
        if n == 3:
            assert 300 in gone and not gone & set(range(100, 125))
    packed = corpus_pipeline.STAGES[-1][1](spark, d, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in d.collect()}


def test_stages_by_brute_force(spark):
    """Each stage against the definition of its operator, on what the one before kept."""
    from test_models import _kneser_ney

    rng = random.Random(17)
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").limit(2).collect()]
    base, twice = prose(rng, 150), prose(rng, 40)
    rows = [(k, prose(rng, rng.randint(5, 60))) for k in range(40)] + [(100 + k, edited(rng, base, 0.01 * k)) for k in range(6)] + [(200, bench[0]), (201, bench[0] + " " + prose(rng, 900)), (202, bench[1] + " x")]
    rows += [(300, twice), (301, twice), (300, prose(rng, 30)), (400, "中文中文中文"), (401, ""), (402, None), (403, "12 !")]
    d = docs(spark, rows)

    def after(name):
        made = dict(corpus_pipeline.STAGES)[name](spark, d, SF)
        return spark.createDataFrame(made.collect(), d.schema), sorted((r.doc_id, r.text or "") for r in made.collect())

    # language: one language, so only the limit decides
    from swirlframe.llm.shared import held_out

    learn = {r.doc_id for r in d.filter(~held_out("doc_id")).collect()}

    def keys(t):
        units, out = [0, 0, 0], []
        for a, b in zip(" " + t, t, strict=False):
            if b.isalpha() or a.isalpha():
                units.append(ord(b.lower()) if b.isalpha() else 0)
                out.append(tuple(units[-4:]))
        return out

    counts = {}
    for i, t in rows:
        for k in keys(t or "") if i in learn else ():
            counts[k] = counts.get(k, 0) + 1
    p, memo = _kneser_ney(counts), {}
    import math

    def entropy(t):
        for k in keys(t):
            if k not in memo:
                memo[k] = -math.log(p(k))
        return sum(memo[k] for k in keys(t)) / len(keys(t)) if keys(t) else None

    found = {(i, t): entropy(t or "") for i, t in rows}
    learned = sorted(e for (i, t), e in found.items() if i in learn and e is not None)
    limit = 1.5 * learned[math.ceil(0.999 * len(learned)) - 1]
    d, got = after("language id")
    assert got == sorted((i, t) for (i, t), e in found.items() if e is not None and e <= limit) and len(got) < len(rows)
    best = {}
    for i, t in got:
        best[t] = max(i, best.get(t, i))
    d, got = after("exact dedup")
    assert got == sorted((i, t) for t, i in best.items())
    # ids with two texts are one document
    sets = {i: near({n: t for n, (_, t) in enumerate(got)}, 5)[i] for i in range(len(got))}
    parent = components({i for i, _ in got}, [(got[a][0], got[b][0]) for a, b in sets.items()])
    d, got = after("near dedup")
    assert got == sorted((i, t) for n, (i, t) in enumerate(sorted((i, t) for t, i in best.items())) if parent[i] == i)
    from test_texts import _contaminated

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [x for x, c in zip(got, _contaminated([t for _, t in got], items), strict=True) if not c[-1]]
    d, got2 = after("decontamination")
    assert got2 == want and len(want) < len(got) and 201 in {i for i, _ in want}
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    places = corpus_pipeline.STAGES[-1][1](spark, d, SF).collect()
    size = sorted((i, len(t.encode(x, add_special_tokens=False).ids) + 1) for i, x in want)
    assert sorted((r.doc_id, r.length) for r in places) == size  # all are shorter than a sequence
    ends = {}
    for r in sorted(places, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and len(ends) == -(-sum(n for _, n in size) // 4096)


def test_every_stage_takes_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark, []), SF).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
