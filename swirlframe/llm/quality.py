"""A quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text give a linear classifier over dense shape features of
whole texts, by minimising the non-negative unbiased risk (Kiryo et al. 2017)
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))
with the logistic loss, over all rows: there is no sample.  The loss of the two signs differs by the logit
itself, so the risk is convex where its second part is above zero, and Newton's method finds its minimum in a few passes,
each of which sums gradient and curvature where the rows are.  Unlabelled is the whole corpus that may be learned from,
and the class prior is estimated on it, so labels need not cover the corpus evenly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as X
from .shared import cut, held_out

#: Passes over the learning rows that a fit takes at most.
PASSES = 24
THRESHOLD = 0.3
_UPPER = X._table(lambda b: 0x41 <= b <= 0x5A)
_LETTER = X._table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
_DIGIT = X._table(lambda b: 0x30 <= b <= 0x39)
_STOP = X._table(lambda b: b in b".,;:?'-\"()")
_SYMBOL = X._table(lambda b: b in b"#$%&*+/<=>@[\\]^_`{|}~")
_BANG = X._table(lambda b: b == 0x21)
_BAR = X._table(lambda b: b == 0x7C)
_LINE = X._table(lambda b: b == 0x0A)

#: Shares in 0..1; each also enters through saturating steps, so that a junk part of a long text counts.
SHARES = ["upper", "digit", "stop", "symbol", "bang", "bar", "line", "other", "repeat", "again", "common", "shouted", "odd_end"]
STEPS = [20.0, 200.0]
BASE = len(SHARES) + 4
SIZE = len(SHARES) * (1 + len(STEPS)) + 4


def features(texts) -> np.ndarray:
    """(rows, SIZE) dense features of texts; all zero for empty ones."""
    return stepped(shapes(texts))


def stepped(base: np.ndarray) -> np.ndarray:
    """(rows, SIZE): shapes() with the steps of their shares."""
    base = base.astype(np.float64)
    share = base[:, : len(SHARES)]
    return np.concatenate([share, *(np.minimum(1, share * s) for s in STEPS), base[:, len(SHARES) :]], 1)


def shapes(texts) -> np.ndarray:
    """(rows, BASE): shares and sizes of texts."""
    data, offs = X.flat(texts)
    n = np.diff(offs).astype(np.float64)
    some = np.maximum(n, 1)

    def share(table: np.ndarray) -> np.ndarray:
        return X.segment_sums(table[data].astype(np.int64), offs) / some

    letters = np.maximum(X.segment_sums(_LETTER[data].astype(np.int64), offs), 1)
    upper = X.segment_sums(_UPPER[data].astype(np.int64), offs) / letters
    known = _LETTER | _DIGIT | _STOP | _SYMBOL | _BANG | _LINE
    known[0x20] = True
    starts, ends, first = X.find_words(data, offs, X.NONSPACE)
    count = np.diff(first).astype(np.float64)
    words = X.word_hashes(X.LOWER[data], starts, ends)
    row = np.repeat(np.arange(len(n)), np.diff(first))
    at_least = np.maximum(count, 1)
    same = np.zeros(len(words), np.int64)
    same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    pairs = np.zeros(len(words), np.uint64)
    pairs[1:] = X.mix(words[1:] * X._C1 + words[:-1])
    keys = np.sort(row.astype(np.uint64) << np.uint64(52) | pairs >> np.uint64(12))
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    kinds = np.bincount((keys[new] >> np.uint64(52)).astype(np.int64), minlength=len(n))
    single = np.sort(row.astype(np.uint64) << np.uint64(52) | words >> np.uint64(12))
    new = np.concatenate([[True], single[1:] != single[:-1]]) if len(single) else np.zeros(0, bool)
    types = np.bincount((single[new] >> np.uint64(52)).astype(np.int64), minlength=len(n))
    ups = np.concatenate([[0], np.cumsum(_UPPER[data])])
    long_ = ends - starts > 2
    shouted = (ups[ends] - ups[starts] >= 2) & long_
    tail = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    odd = (_SYMBOL | _BANG)[tail]
    shares = [upper, share(_DIGIT), share(_STOP), share(_SYMBOL), share(_BANG), share(_BAR), share(_LINE), share(~known)]
    shares += [X.segment_sums(same, first) / at_least, 1 - kinds / at_least, 1 - types / at_least]
    shares += [X.segment_sums(x.astype(np.int64), first) / at_least for x in (shouted, odd)]
    shares = [np.where(n > 0, x, 0) for x in shares]
    mean = np.where(count > 0, (n - count) / at_least, 0)
    rest = [np.log1p(n) / 10, np.log1p(count) / 10, mean / 10, np.log1p(X.segment_sums(_LINE[data].astype(np.int64), offs)) / 5]
    return np.stack([*shares, *rest], 1).astype(np.float32)


def shape_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, features array of floats: shapes()), a row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches, "_text"):
            for i in range(0, part.num_rows, 4096):
                p = part.slice(i, 4096)
                f = shapes(p.column(1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * BASE), pa.array(f.ravel()))
                yield pa.RecordBatch.from_arrays([p.column(0), lists], [id_col, "features"])

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("features", T.ArrayType(T.FloatType()))]))


Sums = Callable[[Callable[[np.ndarray], np.ndarray]], tuple[np.ndarray, np.ndarray]]


def _of_arrays(positive: np.ndarray, unlabelled: np.ndarray) -> Sums:
    return lambda part: (part(positive), part(unlabelled))


def _of_rows(rows: DataFrame) -> Sums:
    """Sums over (features, positive boolean): tasks add up what ``part`` says of their rows, Spark adds up the tasks place by place."""

    def sums(part):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [None, None]
            for b in batches:
                x, mark = b.column(0).flatten().to_numpy().reshape(-1, BASE), b.column(1).to_numpy(zero_copy_only=False)
                for k in (0, 1):
                    some = x[mark == (k == 0)]
                    for i in range(0, len(some), 8192):
                        got = part(stepped(some[i : i + 8192]))
                        total[k] = got if total[k] is None else total[k] + got
            for k, v in enumerate(total):
                if v is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["k", "at", "v"])

        size = len(part(np.zeros((0, SIZE))))
        out = np.zeros((2, size))
        for r in rows.mapInArrow(run, "k int, at int, v double").groupBy("k", "at").agg(F.sum("v").alias("v")).collect():  # 2 * size rows
            out[r.k, r.at] = r.v
        return out[0], out[1]

    return sums


def spread_of(sums: Sums) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, scale, (positives, unlabelled rows)) of all rows."""
    p, u = sums(lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    n, d = p[0] + u[0], (len(p) - 1) // 2
    centre = (p + u)[1 : d + 1] / max(n, 1)
    scale = np.sqrt(np.maximum((p + u)[d + 1 :] / max(n, 1) - centre * centre, 0)) + 1e-6
    return centre, scale, np.array([p[0], u[0]])


def minimised(sums: Sums, centre: np.ndarray, scale: np.ndarray, prior: float, decay: float = 1e-4, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """(weights, bias) of a linear logit over standardised features that minimises the non-negative PU risk, by Newton's method.

    Each step minimises a quadratic model of the risk whose second part keeps its bend at zero: ``side`` is the weight of that part, 1 where it is
    above zero, 0 below, and between at the bend.  A step is halved until the risk is less.
    """
    d = len(centre)

    def risk(w: np.ndarray):
        def part(x):
            x = np.concatenate([(x - centre) / scale, np.ones((len(x), 1))], 1)
            z = x @ w
            q = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            return np.concatenate([[len(x), np.logaddexp(0, z).sum()], x.sum(0), q @ x, ((x * (q * (1 - q))[:, None]).T @ x).ravel()])

        p, u = sums(part)
        p, u = p / max(p[0], 1), u / max(u[0], 1)
        mean, (at_p, at_u) = p[2 : d + 3], (v[d + 3 : 2 * d + 4] for v in (p, u))
        bend_p, bend_u = (v[2 * d + 4 :].reshape(d + 1, d + 1) for v in (p, u))
        keep = decay * np.append(w[:d], 0)
        negative = u[1] - prior * p[1]
        value = prior * (p[1] - mean @ w) + max(negative, 0) + keep @ w / 2
        return value, negative, prior * (at_p - mean) + keep, at_u - prior * at_p, prior * bend_p, bend_u

    def step_from(state, side: float) -> tuple[np.ndarray, float]:
        _, negative, first, second, bend_p, bend_u = state
        bend = (1 - side) * bend_p + side * bend_u + np.diag(np.append(np.full(d, decay), 1e-6))
        x, y = np.linalg.solve(bend, np.stack([first, second], 1)).T
        side = float(np.clip((negative - second @ x) / max(second @ y, 1e-12), 0, 1))
        return x + side * y, side

    w = np.append(np.zeros(d), np.log(prior / (1 - prior)))
    state = risk(w)
    (step, side), size = step_from(state, 1.0), 1.0
    for _ in range(passes - 1):
        tried = risk(w - size * step)
        if tried[0] > state[0]:
            size /= 2
            if size < 1e-3:
                break
            continue
        gain, w, state = state[0] - tried[0], w - size * step, tried
        if size == 1 and gain < 1e-7:
            break
        (step, side), size = step_from(state, side), min(1.0, 2 * size)
    return w[:d], float(w[d])


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, decay: float = 1e-4, passes: int = PASSES) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """(weights, bias, centre, scale): minimised() over arrays."""
    sums = _of_arrays(positive, unlabelled)
    centre, scale, _ = spread_of(sums)
    return *minimised(sums, centre, scale, prior, decay, passes), centre, scale


def pool_prior(sums: Sums, w: np.ndarray, bins: int = 4096) -> float:
    """The share of positives among unlabelled rows, from their scores x @ w: the least ratio of the parts above a threshold.

    Above a threshold that no negative reaches the ratio is the share (best bin estimation, Garg et al. 2021).  Thresholds are edges of
    equal bins between the least and the largest score that lie within four deviations of the positives, and keep a tenth of the positives.
    """
    p, _ = sums(lambda x: np.array([len(x), (x @ w).sum(), ((x @ w) ** 2).sum()]))
    mean = p[1] / max(p[0], 1)
    wide = 4 * np.sqrt(max(p[2] / max(p[0], 1) - mean * mean, 0)) + 1e-9
    edges = np.linspace(mean - wide, mean + wide, bins + 1)
    p, u = sums(lambda x: np.bincount(np.searchsorted(edges, x @ w, "right"), minlength=bins + 2).astype(np.float64))
    n_p, n_u = p.sum(), u.sum()
    above_p, above_u = (1 - np.cumsum(x)[:-1] / x.sum() for x in (p, u))
    some = above_p >= 0.1
    above_p, above_u = above_p[some], above_u[some]
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(n_p) + 1 / np.sqrt(n_u))
    best = int(np.argmin((above_u + slack) / above_p))
    return min(max(float(above_u[best] / above_p[best]), 0.01), 0.99)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Learns from rows that are not held out (by id) and have one: those of label 1 are trusted positives, and all of them,
    with or without a label, are the unlabelled text.  The prior is estimated on it,
    kept within 0.01 and 0.99.  Ids with several labels take the largest; null
    labels are none.  Null texts score as empty ones; without any positive all scores are the share
    of label 1 among labelled learning rows.
    """
    spark = docs.sparkSession
    found = cut(shape_features(docs, id_col, text_col))
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    learning = found.filter(F.col(id_col).isNotNull() & ~held_out(id_col))
    labelled = cut(learning.join(known, id_col).select("features", (F.col("_label") == 1).alias("positive")))
    sums = _of_rows(learning.select("features", F.lit(False).alias("positive")).unionByName(labelled.filter("positive")))
    centre, scale, (ones, pool) = spread_of(sums)
    if ones and pool:
        w, _ = minimised(sums, centre, scale, 0.5)
        w, b = minimised(sums, centre, scale, pool_prior(sums, w / scale))
    else:
        n = labelled.count()
        prior = min(max(ones / n, 0.01), 0.99) if n else 0.5
        w, b, centre, scale = np.zeros(SIZE), float(np.log(prior / (1 - prior))), np.zeros(SIZE), np.ones(SIZE)
    weight, bias = w / scale, b - float((w * centre / scale).sum())
    sent = spark.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            z = stepped(part.column(1).flatten().to_numpy().reshape(-1, BASE)) @ sent.value + bias
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], [id_col, "score"])

    scored = found.mapInArrow(run, T.StructType([found.schema[0], T.StructField("score", T.DoubleType())]))
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
