import random

from helpers import docs, edited, near, odd_rows, prose, shingles
from pyspark.sql import functions as F

from swirlframe.llm import exact_dedup as exact
from swirlframe.llm import near_dedup as nd
from swirlframe.llm import shared
from swirlframe.llm import substring_dedup as substring
from swirlframe.plans import skew
from swirlframe.llm.exact_dedup import exact_dedup, exact_groups
from swirlframe.llm.line_dedup import line_dedup, repeated_lines
from swirlframe.llm.substring_dedup import WINDOW, repeated_paragraphs, repeated_passages, repeated_windows, substring_dedup


def test_exact_groups_of_odd_rows(spark):
    rows = odd_rows()
    got = exact_groups(docs(spark, rows), digest=True).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    for r in got:
        mine = next(g for t, g in groups.items() if __import__("hashlib").sha256(t.encode()).hexdigest() == r.text_sha256 and r.doc_id in g)
        ids = [x for x in mine if x is not None]
        assert r.group_size == len(mine) and r.keep_id == (max(ids) if ids else None)
        assert r.kept == (r.doc_id == r.keep_id)
    plain = exact_groups(docs(spark, rows))
    assert plain.exceptAll(exact_groups(docs(spark, rows), digest=True).drop("text_sha256")).count() == 0
    kept = exact_dedup(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} >= {2, 3, 4, 6, 8, 9, 10, 11} and not {5, 7} & {r.doc_id for r in kept.collect()}


def test_rows_go_by_id_and_text(spark):
    rows = [(7, "x"), (7, "y"), (8, "x"), (None, "x"), (None, "q"), (None, None), (3, "")]
    assert sorted(((r.doc_id, r.text) for r in exact_dedup(docs(spark, rows)).collect()), key=repr) == sorted([(7, "y"), (8, "x"), (None, "q"), (3, "")], key=repr)
    rng = random.Random(4)
    a, b, c = (prose(rng, 40) for _ in range(3))
    rows = [(1, a), (2, a + " "), (2, b), (3, c), (3, c), (4, c), (5, b)]
    kept = [(r.doc_id, r.text) for r in nd.near_dedup(docs(spark, rows)).collect()]
    assert sorted(kept) == [(1, a), (3, c), (3, c)]  # 2 is one document: what it has of b links it, and 5, with 1
    got = {r.doc_id: r.component_id for r in nd.near_groups(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 1}


def test_small_limits_give_the_same_rows(spark, monkeypatch):
    """What is broadcast, dealt over tasks, compared or held in blocks does not change what comes out."""
    rng, texts = random.Random(13), {k: t for k, t in _families(5, 2).items() if k % 2}
    rows = [*texts.items(), *((200 + k, texts[2 * (k % 7) + 1]) for k in range(20)), *((300 + k, f"a\nb\nc\nd\n{prose(rng, 20)}\n{texts[3]} {texts[61]}") for k in range(10)), (7, "other text of a known id")]
    d = docs(spark, rows)

    def all_():
        frames = exact_groups(d, digest=True), exact_dedup(d), nd.near_groups(d, k=2), nd.near_dedup(d), repeated_lines(d), line_dedup(d), repeated_passages(d, least=20, passage=40), substring_dedup(d)
        return [sorted(map(repr, f.collect())) for f in frames]

    want = all_()
    for module, name, value in ((shared, "BROADCAST_IDS", 8), (skew, "BROADCAST", 2), (skew, "FEW", 2), (skew, "SHARE", 9), (nd, "PART", 3), (nd, "SMALL", 6), (nd, "QUESTIONS", 40), (exact, "BITS", 7), (substring, "BITS", 8)):
        monkeypatch.setattr(module, name, value)
    assert all_() == want


def test_exact_same_prefix_and_length(spark):
    a, b = "p" * 500 + "x", "p" * 500 + "y"
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_groups(docs(spark, [(1, a), (2, b), (3, a)])).collect()}
    assert got == {1: (3, 2), 3: (3, 2), 2: (2, 1)}


def test_empty_tables(spark):
    none = docs(spark, [])
    for out in (exact_groups(none), exact_dedup(none), nd.near_groups(none), nd.near_dedup(none), repeated_lines(none), line_dedup(none), repeated_passages(none), substring_dedup(none)):
        assert out.count() == 0


def test_near_groups_of_odd_rows(spark):
    rows = odd_rows()
    got = nd.near_groups(docs(spark, rows), k=2).collect()
    assert len(got) == len(rows)
    want = near({i: t for i, t in rows if i is not None}, 2)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            text = next(t for i, t in rows if i == r.doc_id)
            assert r.n_shingles == len(shingles(text, 2)) and r.component_id == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)
    kept = nd.near_dedup(docs(spark, rows), k=2)
    assert kept.columns == docs(spark, rows).columns and not {6, 8} & {r.doc_id for r in kept.collect()}


def _families(seed, k):
    rng, texts = random.Random(seed), {}
    for family in range(12):
        base = prose(rng, rng.choice([3, 8, 40, 120]))
        for _ in range(rng.choice([1, 2, 5])):
            texts[len(texts)] = edited(rng, base, rng.choice([0, 0.02, 0.05, 0.1, 0.2]))
    base = prose(rng, 60)  # one family that is a large node at every level
    for _ in range(90):
        texts[len(texts)] = edited(rng, base, rng.choice([0, 0.02, 0.05, 0.08, 0.1]))
    return texts


def test_near_groups_against_all_pairs(spark):
    for seed, k in ((1, 2), (2, 2), (3, 5)):
        texts = _families(seed, k)
        got = {r.doc_id: r.component_id for r in nd.near_groups(docs(spark, list(texts.items())), k=k).collect()}
        assert got == near(texts, k)


def test_questions_against_all_pairs():
    import pyarrow as pa

    from swirlframe.llm import arrowtext as X

    texts = list(_families(4, 2).values())
    q = nd.Questions(list(range(len(texts))), list(range(len(texts))), texts, 2, X.NONSPACE)
    got = {(r, u) for r, u, _ in q.answers(pa.array(texts), 80, most=3000)}
    sets = [shingles(t, 2) for t in texts]
    assert got == {(x, y) for x, a in enumerate(sets) for y, b in enumerate(sets) if a and 100 * len(a & b) >= 80 * len(a | b)}


def test_repeated_lines(spark):
    t = "a\nb\nc\nd\ne"
    rows = [(1, t), (2, "z\n" + t), (3, "b\nc\nd"), (4, "b\nc"), (5, None), (None, t), (6, "q\nq\nq\nq\nq")]
    got = {(r.doc_id, r.first, r.last) for r in repeated_lines(docs(spark, rows)).collect()}
    assert got == {(2, 1, 5), (3, 0, 2), (6, 1, 4)}
    d = docs(spark, rows).withColumn("_id", F.lit(1)).withColumn("_runs", F.lit(2))
    out = {r.doc_id: r.text for r in line_dedup(d).collect()}
    assert out == {1: t, 2: "z", 3: "", 4: "b\nc", 5: None, None: t, 6: "q"}
    assert line_dedup(d).columns == d.columns


def test_repeated_passages(spark):
    rng = random.Random(3)
    p, q, r, short = prose(rng, 60), prose(rng, 80), prose(rng, 55), prose(rng, 12)
    near_p = edited(rng, p, 0.03)
    rows = [(1, f"{short}\n{p}\n{short}"), (2, f"{q}\n{near_p}"), (3, f"{short}\n{r}"), (4, f"{p}"), (5, None), (None, p), (6, ""), (7, f"{q}\n{q}"), (9, r), (9, r)]
    got = {(x.doc_id, x.para): (x.component_doc, x.component_para, x.removed) for x in repeated_paragraphs(docs(spark, rows)).collect()}
    want = near({(i, k): line for i, t in dict(rows).items() if i is not None and t for k, line in enumerate(t.split("\n")) if len(line.split()) >= 50}, 5)
    sizes = {}
    for c in want.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert got == {x: (*c, x != c) for x, c in want.items() if sizes[c] > 1}
    d = docs(spark, rows).withColumn("_id", F.lit(1)).withColumn("_gone", F.lit(2))
    out = {x.doc_id: x.text for x in substring_dedup(d).collect()}
    assert out[1] == rows[0][1] and out[4] == "" and out[5] is None and out[None] == p
    assert substring_dedup(d).columns == d.columns


def _common_runs(a, b, n):
    """Places in a of runs of n words that b has too."""
    have = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)}
    return {k for k in range(len(a) - n + 1) if tuple(a[k : k + n]) in have}


def test_passages_within_lines(spark):
    rng = random.Random(12)
    shared = [prose(rng, n).split(" ") for n in (51, 60, 120, 45, 37)]
    texts = {}
    for k in range(40):
        w = prose(rng, rng.randint(5, 90)).split(" ")
        if k % 3:
            at = rng.randint(0, len(w))
            w[at:at] = shared[k % 5]
        texts[k] = " ".join(w)
    rows = [*texts.items(), (7, texts[7]), (100, None), (None, texts[1]), (101, ""), (102, "la " * 90)]
    got = {}
    for r in repeated_windows(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.first_word, r.n_words, r.component_doc, r.removed))
    words = {i: t.split(" ") for i, t in texts.items()}
    for i, w in words.items():
        long_, short = set(), set()
        for m, other in words.items():
            if m != i:
                long_ |= _common_runs(w, other, 51)
                short |= _common_runs(w, other, WINDOW)
        covered = {k for first, n, _, _ in got.get(i, []) for k in range(first, first + n)}
        assert all(covered & set(range(k, k + 51)) for k in long_)
        assert covered <= {k + m for k in short for m in range(WINDOW)}
        assert all(n >= 51 or any(k <= first and first + n <= k + 51 for k in long_) for first, n, _, _ in got.get(i, []))
    assert not {100, 101, 102, None} & set(got)
    out = {r.doc_id: r.text for r in substring_dedup(docs(spark, rows)).collect()}
    firsts = {i for i, runs in got.items() if not any(x[3] for x in runs)}
    assert all(out[i] == texts[i] for i in texts if i in firsts or i not in got) and all(len(out[i]) < len(texts[i]) for i in got if i not in firsts)


def _overlaps(seed):
    """Texts whose passages overlap: cut-off copies, chains, passages side by side, repeats within a document."""
    rng = random.Random(seed)
    p = [prose(rng, 300).split(" ") for _ in range(3)]
    own = lambda: prose(rng, rng.randint(3, 40)).split(" ")
    texts = [own() + p[0][:80] + own(), own() + p[0][:160] + own(), own() + p[0][:160] + own(), own() + p[0][60:200] + own(), own() + p[1][:90] + p[2][:90] + own(), own() + p[2][:90] + own(), own() + p[1][:90] + p[2][:90] + own(), ["la"] * 200 + own(), own() + ["la"] * 150]
    for _ in range(30):
        w = own()
        for _ in range(rng.randint(1, 3)):
            q, a = rng.choice(p), rng.randrange(240)
            w += q[a : a + rng.randint(20, 150)] + own() * rng.randint(0, 1)
        texts.append(w)
    return {k: " ".join(w) for k, w in enumerate(texts)}


def test_removed_words_stand_elsewhere(spark):
    texts = _overlaps(21)
    words = {i: t.split(" ") for i, t in texts.items()}
    left = [t.split() for t in substring_dedup(docs(spark, list(texts.items())), least=10**6).toPandas()["text"]]
    have = {n: {tuple(w[k : k + n]) for w in left for k in range(len(w) - n + 1)} for n in range(1, WINDOW + 1)}
    gone = [r for r in repeated_windows(docs(spark, list(texts.items()))).collect() if r.removed]
    assert len(gone) > 20 and {1, 2} <= {r.doc_id for r in gone}
    for r in gone:
        run, n = words[r.doc_id][r.first_word : r.first_word + r.n_words], min(WINDOW, r.n_words)
        assert all(tuple(run[k : k + n]) in have[n] for k in range(len(run) - n + 1))


def test_passages_from_end_to_end(spark):
    rng = random.Random(24)
    base = prose(rng, 300)
    copies = {k: edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02])) for k in range(25)}
    for texts, n in ((_overlaps(22), 51), (_overlaps(23), 40), (copies, 40)):
        words = {i: t.split(" ") for i, t in texts.items()}
        covered = {i: set() for i in texts}
        for r in repeated_windows(docs(spark, list(texts.items())), passage=n).collect():
            places = set(range(r.first_word, r.first_word + r.n_words))
            assert not covered[r.doc_id] & places
            covered[r.doc_id] |= places
        for i, w in words.items():
            assert covered[i] == {k + m for x, other in words.items() if x != i for k in _common_runs(w, other, n) for m in range(n)}


def _left(spark, rows, **how):
    """Words of each document after substring_dedup(), the removed lines, and the removed runs (id, first, number of words)."""
    frame = docs(spark, rows)
    found = repeated_passages(frame, **how).filter("removed").collect()
    lines, runs = {(r.doc_id, r.first) for r in found if r.kind == "paragraph"}, [(r.doc_id, r.first, r.length) for r in found if r.kind == "passage"]
    return {r.doc_id: (r.text or "").split() for r in substring_dedup(frame, **how).collect()}, lines, runs


def test_a_removed_line_keeps_nothing(spark):
    """A line goes as a near copy, and with it words of a passage that another document has too: that one keeps them."""
    rng = random.Random(31)
    base, x = prose(rng, 900).split(" "), prose(rng, 60).split(" ")
    near_line = " ".join(base[:400] + x + base[400:])
    around = " ".join(prose(rng, 200).split(" ") + x + prose(rng, 200).split(" "))
    for ids, many in (((1, 2, 3), 1), ((0, 1, 3), 30)):  # lines before it shift places
        text = "\n".join(["a b c"] * (many - 1) + [near_line])
        left, lines, _ = _left(spark, list(zip(ids, (" ".join(base), text, around), strict=True)), least=40, passage=40)
        assert lines == {(ids[1], many - 1)}
        assert any(w[k : k + 60] == x for w in left.values() for k in range(len(w)))


def test_no_run_is_lost(spark):
    """Lines and passages together, on random tables with near copies: what is removed as a passage stands elsewhere, as does every run of 40 words that lines that stay share."""
    for seed in range(2):
        rng = random.Random(40 + seed)
        stock = [prose(rng, n).split(" ") for n in (45, 60, 90, 200)]

        def line():
            parts = [edited(rng, " ".join(rng.choice(stock)), rng.choice([0, 0, 0.02])) for _ in range(rng.choice([1, 1, 2]))]
            return " ".join([prose(rng, rng.randint(1, 30)), *parts, prose(rng, rng.randint(1, 30))] if rng.random() < 0.5 else parts)

        rows = [(k, "\n".join(line() for _ in range(rng.randint(1, 4)))) for k in range(25)]
        left, lines, runs = _left(spark, rows, least=40, passage=40)
        have = {n: {tuple(w[k : k + n]) for w in left.values() for k in range(len(w) - n + 1)} for n in range(1, 41)}
        words = {i: t.split() for i, t in rows}
        for i, first, n in runs:
            run, m = words[i][first : first + n], min(n, 40)
            assert all(tuple(run[k : k + m]) in have[m] for k in range(n - m + 1))
        holders = {}
        for i, text in rows:
            stretch = []
            for n, body in [*enumerate(text.split("\n")), (-1, None)]:
                if body is None or (i, n) in lines:
                    for k in range(len(stretch) - 39):
                        holders.setdefault(tuple(stretch[k : k + 40]), set()).add(i)
                    stretch = []
                else:
                    stretch += body.split()
        shared_runs = [w for w, at in holders.items() if len(at) > 1]
        assert all(w in have[40] for w in shared_runs)
        assert lines and runs and len(shared_runs) > 50 and sum(map(len, left.values())) < 0.8 * sum(map(len, words.values()))
