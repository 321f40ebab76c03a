"""Small tables with everything that may go wrong, and brute-force forms of the operators."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, body string, _text string, a int, b int, key string, component string"


def docs(spark, rows, schema=SCHEMA):
    """rows (doc_id, text[, lang]); the other columns have names that operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 1, "x", "y", "z", 7, 8, "k", "c") for r in rows]
    return spark.createDataFrame(full, schema)


def prose(rng, n, words=None):
    words = words or ["the", "of", "and", "thion", "ered", "anst", "onhe", "reti", "shin", "ble", "ndre", "éau", "ñar"]
    return " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(n))


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    long_ = prose(rng, 30_000)
    return [(None, "a text without an id"), (None, None), (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, long_), (6, long_), (7, "x y z"), (7, "x y z"), (8, "x y z"), (9, "\n\n\n\n"), (10, "w" * 100_000), (11, "%%% 123 !!!")]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(text)) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(texts, k, percent=80):
    """Component of each id of {id: text}, by comparing all pairs."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    ids = sorted(sets)
    links = [(x, y) for n, x in enumerate(ids) for y in ids[n + 1 :] if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y])]
    return components(ids, links)


def edited(rng, text, share):
    w = text.split(" ")
    for _ in range(int(share * len(w))):
        w[rng.randrange(len(w))] = prose(rng, 1)
    return " ".join(w)
