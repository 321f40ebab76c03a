"""Language identification by interpolated Kneser-Ney character models.

A text becomes a sequence of units of 16 bits: lower-case letters (and marks on them) by code point, 0 for a gap,
which is anything else; letters beyond the basic plane share the private range.  Four units are
one 64-bit key, so scripts never mix, and what is counted grows with the corpus: all keys of all learning rows.

Kneser-Ney probabilities of orders 4 to 1 are stored in sorted arrays of keys with a column
per language.  The language with the lowest mean cross-entropy per letter is chosen; a text whose
cross-entropy is beyond a limit, calibrated on the learning rows of that language, is rejected.

Models of at most SENT counts are sent to each worker as arrays.  Beyond that nothing of them leaves the executors: each order is a table, the
probabilities of all keys that occur in the texts are looked up by joins, order by order, and summed up by row.  Both ways give the same
results up to rounding, and no key is left out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as X
from .shared import cut, held_out, spread, text_key, without_rows

ORDER, UNIT = 4, 16
UNKNOWN = "und"
#: Most counts (keys of order 4 by language, 20 bytes each) that are sent to the driver, and as a model to the workers.
SENT = 1 << 22
_PRIVATE, _PRIVATE_SIZE = 0xE000, 6400


@lru_cache(1)
def _units() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point of the basic plane: its unit (0: a gap), and whether it is a letter."""
    unit, letter = np.zeros(1 << 16, np.uint16), np.zeros(1 << 16, bool)
    for cp in range(1 << 16):
        c = chr(cp)
        letter[cp] = c.isalpha()
        if letter[cp] or unicodedata.category(c)[0] == "M":
            low = ord(c.lower()[0])
            unit[cp] = low if low < 1 << 16 else _PRIVATE
    return unit, letter


def letter_keys(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, first, letters): the keys of the letters (and of the gaps after words) of each row, where rows begin, and how many letters each has."""
    data, offs = X.flat(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    count = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    first = count[offs]
    unit, letter = _units()
    low = np.minimum(points, 0xFFFF)
    kind, is_letter = unit[low], letter[low]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        is_letter[high] = [chr(p).isalpha() for p in points[high]]
        kind[high] = np.where(is_letter[high], _PRIVATE + points[high] % _PRIVATE_SIZE, 0)
    total = np.concatenate([[0], np.cumsum(is_letter)])
    letters = np.diff(total[first])
    keep = kind > 0
    inside = np.ones(len(kind) + 1, bool)
    inside[first] = False  # the first character of a row
    keep[1:] |= (kind[:-1] > 0) & inside[1:-1]
    before = np.concatenate([[0], np.cumsum(keep)])[first]
    kind = kind[keep]
    rows = len(before) - 1
    padded = np.zeros(len(kind) + (ORDER - 1) * rows, np.uint64)  # gaps before each row
    at = np.arange(len(kind)) + (ORDER - 1) * (1 + np.repeat(np.arange(rows), np.diff(before)))
    padded[at] = kind
    key = padded.copy()
    for j in range(1, ORDER):
        key[ORDER - 1 :] |= padded[ORDER - 1 - j : len(padded) - j] << np.uint64(UNIT * j)
    return key[at], before, letters


def _count(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their (weighted) counts."""
    if weights is None:
        values = np.sort(values)
    else:
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
    head = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    ends = np.concatenate([head[1:], [len(values)]])
    return values[head], ends - head if weights is None else np.add.reduceat(weights, head) if len(head) else weights


def key_counts(docs: DataFrame, languages: list[str], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang int, key long, n long): how often each key occurs in each language, over all rows whose lang is in languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = {x: i for i, x in enumerate(languages)}
        kept: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            return _count(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))

        for part in X.slices(batches, "_text", 1 << 20):
            keys, first, _ = letter_keys(part.column(0))
            lang = np.array([code.get(x, -1) for x in part.column(1).to_pylist()], np.int64)
            of = np.repeat(lang, np.diff(first))
            for l in np.unique(lang[lang >= 0]).tolist():
                parts = kept.setdefault(l, [])
                parts.append(_count(keys[of == l]))
                if len(parts) > 8:
                    kept[l] = [merged(parts)]
        for l, parts in kept.items():
            k, n = merged(parts)
            for i in range(0, len(k), 100_000):
                a, b = k[i : i + 100_000].view(np.int64), n[i : i + 100_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), l, np.int32)), pa.array(a), pa.array(b)], ["lang", "key", "n"])

    rows = docs.filter(F.col(lang_col).isin(languages)).select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    return rows.mapInArrow(run, "lang int, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _discount(counts: np.ndarray) -> float:
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return min(max(one / (one + 2 * two), 0.05), 0.95) if one else 0.5


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << UNIT * order) - 1)


def _place(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted ``table`` has keys, and whether it has them."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Level:
    """One order: sorted keys with natural logs of probabilities, and sorted contexts (order - 1 units) with logs of back-off weights, a column per language."""

    def __init__(self, order: int, keys: list[np.ndarray], counts: list[np.ndarray], below: Level | None):
        self.order, self.below = order, below
        n = len(keys)
        own = [k >> np.uint64(UNIT) for k in keys]
        self.keys = np.unique(np.concatenate(keys)) if n else np.zeros(0, np.uint64)
        self.contexts = np.unique(np.concatenate(own)) if n else np.zeros(0, np.uint64)
        self.weight = np.zeros((len(self.contexts), n), np.float32)
        for l, (k, c) in enumerate(zip(keys, counts, strict=True)):
            d, at = _discount(c), np.searchsorted(self.contexts, own[l])
            total = np.bincount(at, c, len(self.contexts))
            kinds = np.bincount(at, minlength=len(self.contexts))
            seen = kinds > 0
            self.weight[seen, l] = np.log(d * kinds[seen] / total[seen])
        self.logs = self._lower(self.keys)
        for l, (k, c) in enumerate(zip(keys, counts, strict=True)):
            if not len(k):
                continue
            d, at = _discount(c), np.searchsorted(self.contexts, own[l])
            total = np.bincount(at, c, len(self.contexts))
            place = np.searchsorted(self.keys, k)
            self.logs[place, l] = np.log(np.maximum(c - d, 0) / total[at] + np.exp(self.logs[place, l].astype(np.float64)))

    def _lower(self, keys: np.ndarray) -> np.ndarray:
        """Logs of keys by the weight of their context and the order below."""
        at, there = _place(self.contexts, keys >> np.uint64(UNIT))
        out = self.below(keys & _mask(self.order - 1)) if self.below else np.full((len(keys), self.weight.shape[1]), -UNIT * np.log(2), np.float32)
        if there.any():
            out[there] += self.weight[at[there]]
        return out

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at, there = _place(self.keys, keys)
        if there.all() and len(keys):
            return self.logs[at]
        out = np.zeros((len(keys), self.weight.shape[1]), np.float32)
        out[there] = self.logs[at[there]]
        out[~there] = self._lower(keys[~there])
        return out


class KneserNey:
    """The models of all languages: levels of order 1 to ORDER, over one uniform distribution of all units."""

    def __init__(self, languages: list[str], lang: np.ndarray, key: np.ndarray, n: np.ndarray):
        self.languages = languages
        keys, counts = [], []
        for l in range(len(languages)):
            k, c = key[lang == l].view(np.uint64), n[lang == l]
            order = np.argsort(k)
            keys.append(k[order]), counts.append(c[order].astype(np.float64))
        # a lower order counts the different units before each of its keys
        orders = [(keys, counts)]
        for o in range(ORDER - 1, 0, -1):
            shorter = [_count(k & _mask(o)) for k in orders[0][0]]
            orders.insert(0, ([k for k, _ in shorter], [c.astype(np.float64) for _, c in shorter]))
        self.top: Level | None = None
        for o, (k, c) in enumerate(orders, 1):
            self.top = Level(o, k, c, self.top)

    def logs(self, keys: np.ndarray) -> np.ndarray:
        return self.top(keys)

    def entropies(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(mean cross-entropy per key of each row in each language, number of keys of each row; 0 for rows without a letter)."""
        keys, first, letters = letter_keys(texts)
        count = np.diff(first)
        if not self.languages:
            return np.zeros((len(count), 0)), count
        mean = -X.segment_sums(self.logs(keys).astype(np.float64), first) / np.maximum(count, 1)[:, None]
        return mean, np.where(letters > 0, count, 0)


def learned(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], DataFrame]:
    """(languages, their key_counts()): of all non-null values of lang_col, from all rows; null texts teach nothing."""
    languages = sorted(r[0] for r in docs.select(lang_col).filter(F.col(lang_col).isNotNull()).distinct().collect())
    return languages, cut(key_counts(docs, languages, text_col, lang_col))


def evidence(n):
    """How many independent letters n letters in a row are worth to the score: fewer, and more of more."""
    return n**0.75


def scores(docs: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None) -> DataFrame:
    """One row per row of docs: id, extra columns, lang_pred, score, entropy (of lang_pred), n_keys.

    score is the probability of lang_pred, where n letters of this mean cross-entropy count as evidence(n).
    lang_pred is "und", with score 0 and no entropy, for null texts and texts without a letter, and
    if no language was learned.  Ties go to the language that sorts first.
    """
    extra = extra or []
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.languages, UNKNOWN], object)
        for part in X.slices(batches, "_text", 1 << 20):
            i = part.schema.get_field_index("_text")
            mean, count = m.entropies(part.column(i))
            best = np.full(len(count), len(m.languages))
            low, share = np.full(len(count), np.nan), np.zeros(len(count))
            has = count > 0 if m.languages else np.zeros(len(count), bool)
            if has.any():
                best[has] = mean[has].argmin(1)
                low[has] = mean[has].min(1)
                gap = (mean[has] - low[has][:, None]) * evidence(count[has])[:, None]
                share[has] = 1 / np.exp(-gap).sum(1)
            rest = [part.column(j) for j in range(part.num_columns) if j != i]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(names[best].tolist(), pa.string()), pa.array(share), pa.array(low, mask=~has), pa.array(count.astype(np.int64))], [id_col, *extra, "lang_pred", "score", "entropy", "n_keys"])

    rows = docs.select(F.col(id_col), *extra, F.col(text_col).alias("_text"))
    more = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("entropy", T.DoubleType()), ("n_keys", T.LongType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema[:-1], *(T.StructField(*x) for x in more)]))


def _order(counts: DataFrame, order: int, asked: DataFrame, below: DataFrame | None, languages: int) -> DataFrame:
    """(lang, key, p): the probability of each asked key in each language by the counts (lang, key, n) of this order, and the order below."""
    ones = {r.lang: r for r in counts.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).collect()}  # a row a language
    share = [0.5 if l not in ones or not ones[l].one else min(max(ones[l].one / (ones[l].one + 2 * ones[l].two), 0.05), 0.95) for l in range(languages)]
    d = F.element_at(F.array(*map(F.lit, share)), F.col("lang") + 1)
    above = F.shiftrightunsigned("key", UNIT)
    contexts = counts.groupBy("lang", above.alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    rows = asked.select("key", F.explode(F.array(*(F.lit(l) for l in range(languages)))).alias("lang"), above.alias("context"), F.col("key").bitwiseAND(_units_mask(order - 1)).alias("low"))
    found = rows.join(contexts, ["lang", "context"], "left").join(counts, ["lang", "key"], "left")
    lower = F.lit(2.0**-UNIT)
    if below is not None:
        found, lower = found.join(below.select("lang", F.col("key").alias("low"), F.col("p").alias("lower")), ["lang", "low"]), F.col("lower")
    own = F.coalesce(F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total"), F.lit(0.0))
    return found.select("lang", "key", (own + F.coalesce(d * F.col("kinds") / F.col("total"), F.lit(1.0)) * lower).alias("p"))


def _units_mask(order: int) -> int:
    return (1 << UNIT * order) - 1


def key_logs(asked: DataFrame, counts: DataFrame, languages: int) -> DataFrame:
    """(key, logs): the log of the probability of each asked key (distinct) in each language, as KneserNey.logs() has it, by tables of all orders.

    A context and a lower key have at most 2**16 asked keys, so no key of these joins is larger than that, for each language.
    """
    levels, keys = [counts], [asked.select("key")]
    for o in range(ORDER - 1, 0, -1):
        shorter = F.col("key").bitwiseAND(_units_mask(o)).alias("key")
        levels.insert(0, cut(levels[0].select("lang", shorter).groupBy("lang", "key").agg(F.count("*").alias("n"))))
        keys.insert(0, cut(keys[0].select(shorter).distinct()))
    below = None
    for o, (level, some) in enumerate(zip(levels, keys, strict=True), 1):
        below = cut(_order(level, o, some, below, languages))
    by_language = F.array_sort(F.collect_list(F.struct("lang", F.log("p").alias("log"))))
    return below.groupBy("key").agg(by_language.alias("r")).select("key", F.col("r.log").alias("logs"))


def scores_by_tables(docs: DataFrame, languages: list[str], counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None) -> DataFrame:
    """scores() without a model in memory: the keys of each row are joined with key_logs(); frequent keys are dealt over tasks."""
    from pyspark import TaskContext

    extra = extra or []
    rest = [id_col, *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for part in X.slices(batches, "_text", 1 << 20):
            i = part.schema.get_field_index("_text")
            keys, first, letters = letter_keys(part.column(i))
            of = np.repeat(np.arange(part.num_rows), np.diff(first))
            kept = letters[of] > 0
            order = np.lexsort((keys[kept], of[kept]))
            k, r = keys[kept][order], of[kept][order]
            head = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])])) if len(k) else np.zeros(0, np.int64)
            times = np.diff(np.append(head, len(k)))
            offs = pa.array(np.searchsorted(r[head], np.arange(part.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offs, pa.array(x)) for x in (k[head].view(np.int64), times.astype(np.int64))]
            number = pa.array(np.where(letters > 0, np.diff(first), 0).astype(np.int64))
            others = [part.column(j) for j in range(part.num_columns) if j != i]
            yield pa.RecordBatch.from_arrays([*others, pa.array(np.arange(row, row + part.num_rows)), number, *lists], [*rest, "_row", "n_keys", "_keys", "_times"])
            row += part.num_rows

    rows = docs.select(F.col(id_col), *extra, F.col(text_col).alias("_text"))
    longs = T.ArrayType(T.LongType())
    more = [("_row", T.LongType()), ("n_keys", T.LongType()), ("_keys", longs), ("_times", longs)]
    keyed = cut(rows.mapInArrow(run, T.StructType([*rows.schema[:-1], *(T.StructField(*x) for x in more)])))
    each = keyed.select("_row", F.explode(F.arrays_zip("_keys", "_times")).alias("k")).select("_row", F.col("k._keys").alias("key"), F.col("k._times").alias("times"))
    asked = cut(each.groupBy("key").agg(F.count("*").alias("n")))
    logs = cut(key_logs(asked, counts, len(languages)).join(asked, "key"))
    parts = [F.sum(F.col("times") * F.col("logs")[l]).alias(f"_{l}") for l in range(len(languages))]
    sums = spread(each, logs, ["key"], "n", ["_row"]).groupBy("_row").agg(*parts)
    mean = F.array(*(-F.col(f"_{l}") / F.col("n_keys") for l in range(len(languages))))
    found = keyed.drop("_keys", "_times").join(sums, "_row", "left").withColumn("_mean", F.when(F.col("n_keys") > 0, mean)).withColumn("entropy", F.array_min("_mean"))
    name = F.element_at(F.array(*map(F.lit, languages)), F.array_position("_mean", F.col("entropy")).cast("int"))
    weight = evidence(F.col("n_keys").cast("double"))
    odds = F.aggregate("_mean", F.lit(0.0), lambda a, m: a + F.exp((F.col("entropy") - m) * weight))
    return found.select(*rest, F.when(F.col("n_keys") > 0, name).otherwise(UNKNOWN).alias("lang_pred"), F.coalesce(1 / odds, F.lit(0.0)).alias("score"), "entropy", "n_keys")


def calibrated_limits(found: DataFrame, quantile: float = 0.999, slack: float = 1.5) -> DataFrame:
    """(lang_pred, most): beyond which entropy a text is rejected; ``slack`` times the quantile of the learning rows of that language (_lang)."""
    return found.filter("not held_out and entropy is not null and _lang = lang_pred").groupBy("lang_pred").agg((F.percentile_approx("entropy", quantile, 10_000) * slack).alias("most"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", extra: list[str] | None = None) -> DataFrame:
    """scores() of all rows, held_out and rejected, by models of the rows that are not held out (by id) and have a language.

    rejected: lang_pred is "und", or the entropy is beyond the calibrated limit of lang_pred (no learning row of it: no limit).
    """
    languages, counts = learned(docs.filter(~held_out(id_col)), text_col, lang_col)
    extra = extra or []
    rows = docs.select(id_col, text_col, *extra, F.col(lang_col).alias("_lang"))
    if counts.count() <= SENT:
        sent = counts.toArrow()
        model = KneserNey(languages, *(sent.column(c).to_numpy() for c in ("lang", "key", "n")))
        found = scores(rows, model, id_col, text_col, [*extra, "_lang"])
    else:
        found = scores_by_tables(rows, languages, counts, id_col, text_col, [*extra, "_lang"])
    found = cut(found.withColumn("held_out", held_out(id_col)))
    limits = F.broadcast(calibrated_limits(found))  # a row per language
    beyond = F.col("entropy").isNull() | F.coalesce(F.col("entropy") > F.col("most"), F.lit(False))
    return found.join(limits, "lang_pred", "left").select(*found.drop("_lang").columns, beyond.alias("rejected"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows that identify() rejects; rows go by id and text, so an id may have several texts, or be null."""
    key = "_text_key"
    found = identify(docs.select(id_col, text_col, lang_col, text_key(text_col).alias(key)), id_col, text_col, lang_col, [key])
    return without_rows(docs, found.filter("rejected").select(id_col, key), id_col, text_key(text_col))
