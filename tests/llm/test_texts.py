import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import docs, lower, odd_rows, prose

from swirlframe.llm import chat, decontaminate, licenses, packing
from swirlframe.llm import arrowtext as X

PATH = public_tokenizers.path("word_bpe_49k.json")


def _words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def _contaminated(texts, items, window=13):
    wins = {}
    for name, t in items:
        w = _words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(name)
    out = []
    for t in texts:
        w, hit, found = _words(t), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    found |= wins[tuple(w[k : k + n])]
                    hit.update(range(k, k + n))
        names = sorted(str(x) for x in found if x is not None)
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def _bench(spark):
    rng = random.Random(1)
    long_ = prose(rng, 40)
    items = [(1, long_), (10, "".join(c.upper() if c.isascii() else c for c in long_)), (2, "Just four little words"), (3, None), (4, "!!"), (None, prose(rng, 15)), (5, "one"), (6, "the the the the the the the the the the the the the the the")]
    return items, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


def test_contamination_by_brute_force(spark):
    items, bench = _bench(spark)
    rng = random.Random(2)
    texts = [(k, " ".join([prose(rng, rng.randint(0, 80)), rng.choice(["", items[0][1][:120], "just Four little words!", items[5][1], "the " * 40]), prose(rng, 5)])) for k in range(60)]
    rows = texts + odd_rows() + [(99, items[0][1]), (99, items[0][1])]
    d = docs(spark, rows)
    got = sorted(map(tuple, decontaminate.contamination(d, bench).collect()), key=repr)
    want = sorted(((i, *w) for (i, *_), w in zip(rows, _contaminated([r[1] for r in rows], items), strict=True)), key=repr)
    assert got == want
    kept = decontaminate.decontaminate(d, bench)
    assert kept.columns == d.columns and kept.count() == sum(not w[-1] for w in want)
    matches = decontaminate.longest_matches(d, bench).collect()
    with pytest.MonkeyPatch.context() as m:  # many blocks, shards of one document
        m.setattr(decontaminate, "BLOCK_BYTES", 50)
        m.setattr(decontaminate, "SHARD_BYTES", 10)
        assert len(decontaminate._blocks(bench, 13)) > 2
        assert sorted(map(tuple, decontaminate.contamination(d, bench).collect()), key=repr) == want
        assert sorted(map(repr, decontaminate.longest_matches(d, bench).collect())) == sorted(map(repr, matches))
    assert decontaminate.contamination(d, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(d.limit(0), bench).count() == 0


def test_longest_matches(spark):
    items, bench = _bench(spark)
    w = items[0][1].split(" ")
    d = docs(spark, [(1, "q r " + " ".join(w[3:30]) + " s")])
    got = {(r.item_id, r.item_word, r.doc_word, r.n_words) for r in decontaminate.longest_matches(d, bench).collect()}
    assert got == {("1", 3, 2, 27), ("10", 3, 2, 27)}


@pytest.mark.parametrize("top", [2, 5, 2**22])
def test_suffix_array(top):
    rng = np.random.default_rng(3)
    seq = np.concatenate([rng.integers(0, top, 400), np.tile([1, 2], 60), np.zeros(40, int)])
    pos = np.flatnonzero(seq > 0)
    sa = decontaminate.suffix_array(seq, pos.copy(), 13)
    assert sorted(sa) == pos.tolist()
    cut = lambda k: k[: k.index(0) + 1] if 0 in k else k  # a 0 ends a document; nothing is said about the order beyond
    keys = [cut(tuple(seq[p : p + 13].tolist())) for p in sa]
    assert keys == sorted(keys)
    some = np.array([seq[p : p + 13] for p in pos if (seq[p : p + 4] > 0).all()])
    size = np.full(len(some), 4)
    low, high = (decontaminate.search(seq, sa, some, size, r) for r in (False, True))
    for p, a, b in zip(some, low, high, strict=True):
        assert [k for k in range(len(sa)) if keys[k][:4] == tuple(p[:4])] == list(range(a, b))


def _optimum(items, cap):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        seen = set()
        for b, load in enumerate(bins):
            if load + items[k] <= cap and load not in seen:
                seen.add(load)
                bins[b] += items[k]
                go(k + 1, bins)
                bins[b] -= items[k]
        bins.append(items[k])
        go(k + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    for seed in range(120):
        rng = random.Random(seed)
        cap = rng.choice([10, 20, 30])
        items = [rng.randint(1, cap) for _ in range(rng.randint(1, 10))]
        counts = np.bincount(items, minlength=cap + 1).astype(np.int64)
        best, left = _optimum(items, cap), counts.copy()
        fixed = packing.reduce_dominated(left)
        rest = [x for x in range(cap + 1) for _ in range(int(left[x]))]
        assert sum(m for _, m in fixed) + _optimum(rest, cap) == best
        made = packing.solve(counts)
        back = np.zeros_like(counts)
        for group, m in made:
            assert sum(group) <= cap
            for x in group:
                back[x] += m
        assert (back == counts).all()


def test_tokens_word_by_word():
    from tokenizers import Tokenizer

    t, w, rng = Tokenizer.from_file(PATH), packing.WordTokens(PATH), random.Random(4)
    odd = ["don't it's we'RE 'rest x'!s !'s 12a3", "≮ H̱ İ Áb …, a\x85b", "<|endoftext|> x", "'S 'T''s a'b'c d'll'd", "", " "]
    made = ["".join(rng.choice("aABh'sSt!-1 2\n\tÉé̸̱́ß<=…Σİ漢😀 rel") for _ in range(rng.randint(0, 14))) for _ in range(800)]
    for text in odd + made:
        ids, first = w(pa.array([text]))
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids and first.tolist() == [0, len(ids)]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    rows = [(i, s) for i, s in odd_rows() if i is not None]
    pieces, places = packing.pack_documents(docs(spark, rows), PATH, capacity=256)
    ids = {}
    for p in pieces.collect():
        ids.setdefault((p.doc_id, p.piece), []).append(bytes(p.ids))
    seqs = {}
    for r in places.collect():
        assert r.ids_crc32 in [zlib.crc32(b) for b in ids[r.doc_id, r.piece]] and r.start == 256 * r.piece
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    assert places.count() == sum(map(len, ids.values()))
    for i, s in rows:
        want = np.array([*t.encode(s or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert b"".join(ids[i, k][0] for k in range(len([1 for x in ids if x[0] == i]))) == want
    assert packing.pack_documents(docs(spark, []), PATH)[1].count() == 0


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>\n<|im_start|>user\n", "<", "<<", "<<|im_end|>", "", None, "a<b", "é😀 "]
    rows = [(1, k, "assistant" if k % 2 else "user", x, "e") for k, x in enumerate(nasty)] + [(2, 0, "assistant", "first", "e"), (2, 0, "assistant", "first", "e"), (None, 1, "user", "u", "e"), (3, None, None, "n", "e"), (3, 2, "sys<tem", "m", "e")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seg string")
    made = chat.segments(c)
    assert made.count() == 3 * len(rows)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert set(got) == {1, 2, 3, None}
    key = lambda r: tuple((x is not None, x) for x in (r[1], r[2], r[3] or ""))
    for conv, r in got.items():
        mine = sorted((x for x in rows if x[0] == conv), key=key)
        said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine)
        loss = "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(24 + len((x[2] or "").replace("<", "<<")) + len((x[3] or "").replace("<", "<<")) for x in mine)
        m = chat.Machine(chat.Template())
        for x in mine:
            m.step(x[2])
        assert (r.n_errors, r.complete) == (m.errors, m.complete())
    assert {c: (r.n_errors, r.complete) for c, r in got.items()} == {1: (0, True), 2: (2, False), 3: (2, False), None: (0, False)}
    mixed = chat.read_back(made.orderBy("text", "seg").repartition(3))
    assert {tuple(r) for r in mixed.collect()} == {tuple(r) for r in got.values()}
    with pytest.raises(Exception, match="does not begin"):
        chat.read_back(made.filter("seg > 0")).collect()
    with pytest.raises(Exception, match="has no end"):
        chat.read_back(made.filter("seg = 0")).collect()
    assert chat.read_back(chat.segments(c.limit(0))).count() == 0
    valid = {(r.conv_id, r.turn): r.valid for r in made.filter("seg = 1").collect()}
    assert valid[1, 0] and valid[1, 3] and not valid[2, 0]


def test_machine():
    m = chat.Machine(chat.Template())
    assert [m.step(r) for r in ("system", "user", "assistant", "user", "assistant")] == [True] * 5 and m.complete()
    m = chat.Machine(chat.Template())
    assert [m.step(r) for r in ("user", "user", None, "tool")] == [True, False, False, False] and not m.complete()


def _best(text, sets, sizes):
    """As Templates.scan(), without bands: every window of the grid."""
    w, out = licenses.words(text or ""), {}
    for k, size in enumerate(sizes):
        wide, s = licenses.class_of(size)
        for at in range(0, len(w), s):
            share = len(licenses.shingles(w[at : at + wide]) & sets[k]) / len(sets[k])
            if share >= licenses.CONTAINED and share > out.get(k, (0,))[0]:
                out[k] = (share, at, len(w[at : at + wide]))
    return out


def test_licenses_by_brute_force(spark):
    rng, m = random.Random(6), licenses.Templates(licenses.TEMPLATES)
    rows = []
    for k in range(80):
        t = rng.choice(list(licenses.TEMPLATES.values())).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            t[rng.randrange(len(t))] = prose(rng, 1)
        rows.append((k, prose(rng, rng.randint(0, 60)) + " " + " ".join(t).upper() + " " + prose(rng, rng.randint(0, 30))))
    rows += odd_rows()
    got = sorted((r.doc_id is None, r.doc_id, r.license, round(r.containment, 9), r.first_word, r.n_words) for r in licenses.license_scan(docs(spark, rows)).collect())
    want = sorted((i is None, i, m.names[k], round(v[0], 9), v[1], v[2]) for i, t in rows for k, v in _best(t, m.sets, m.sizes).items())
    assert got == want and len(got) > 40
    assert licenses.license_scan(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        licenses.Templates({"x": "two words"})


def test_bands_retrieve_what_windows_hold():
    """Every window that holds 0.8 of a template retrieves it, and unlike templates are not retrieved."""
    m = licenses.Templates(licenses.TEMPLATES)
    assert len(m.classes) > 5 and sum(len(c.members) for c in m.classes) == len(licenses.TEMPLATES)
    for c in m.classes:
        for t in c.members[:, 0]:
            own = m._hashes(list(licenses.TEMPLATES.values())[t])
            noise = np.arange(c.wide - len(own), dtype=np.uint64) * X._C1 if c.wide > len(own) else np.zeros(0, np.uint64)
            assert [0, t] in c.retrieved(licenses.band_keys(np.concatenate([own, noise])[None, :])).tolist()
        assert not len(c.retrieved(licenses.band_keys(np.arange(1, c.wide, dtype=np.uint64)[None, :] * X._C3)))


def test_word_hashes_tell_words_apart():
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 40))) for _ in range(5000)})
    data, offs = X.flat(pa.array([" ".join(words), " ".join(reversed(words)), None]))
    s, e, first = X.find_words(data, offs, X.NONSPACE)
    h = X.word_hashes(data, s, e)
    assert first.tolist() == [0, len(words), 2 * len(words), 2 * len(words)]
    assert len(set(h.tolist())) == len(words) and h[: len(words)].tolist() == h[len(words) :][::-1].tolist()
