"""Helpers that the operators share: row filters, joins that spread hot keys, held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import cut, qualified, removed, scratch, shared_dir, written
from ..plans.components import connected as components
from ..plans.skew import spread

__all__ = ["bit_map", "components", "cut", "fresh", "held_out", "looked_up", "only", "place", "qualified", "removed", "scratch", "shared_dir", "sized", "spread", "text_key", "without", "without_rows", "written"]

#: Most ids that are broadcast at once (8 bytes each, about 50 MB as a hash table); beyond it a shuffle join is used.
BROADCAST_IDS = 1_000_000
#: Bits (as a power of two) of the map of keys that are too many to be broadcast.
MAP_BITS = 24


def held_out(doc_id: str | Column) -> Column:
    """True for the fifth of the ids that no model learns from; a null id is held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5, F.lit(0)) == 0


def without(docs: DataFrame, ids: DataFrame, key: str | list[str] = "doc_id") -> DataFrame:
    """docs without the rows whose key is in ids (which has the columns of ``key`` only); rows with a null in it stay.

    The ids are broadcast only if they are at most BROADCAST_IDS (an eighth of that for keys of several columns); else both sides are shuffled.
    """
    return _less(docs, ids.dropna(), [key] if isinstance(key, str) else key).select(docs.columns)


def _less(rows: DataFrame, gone: DataFrame, same) -> DataFrame:
    gone = cut(gone.distinct())
    most = BROADCAST_IDS if len(gone.columns) == 1 else BROADCAST_IDS // 8  # rows of several columns are as much wider
    if gone.count() <= most:
        return rows.join(F.broadcast(gone), same, "left_anti")
    if not isinstance(same, list):
        return rows.join(gone, same, "left_anti")
    # of the others only rows whose bit is set are shuffled
    some = fresh(rows, "_some")
    marked = looked_up(rows, cut(bit_map(gone.select(same), MAP_BITS)), place(MAP_BITS, *(F.col(c) for c in same)), some)
    return marked.filter(~F.col(some)).drop(some).unionByName(marked.filter(some).drop(some).join(gone, same, "left_anti"))


def only(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with the rows whose key is in ids (distinct); broadcast as in without()."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, key, "left_semi").select(docs.columns)


def text_key(text: str | Column) -> Column:
    """What tells the texts of one id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, key: Column) -> DataFrame:
    """docs without the rows that are in gone, (id, text): an id, which may be null or repeat, and what ``key`` (text_key() of docs' texts, say) is."""
    id_, text = fresh(docs, "_gone_id"), fresh(docs, "_gone_text")
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (key == F.col(text))
    return _less(docs, gone.toDF(id_, text), same).select(docs.columns)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def sized(keys: DataFrame, most: int | None = None, weight: Column | None = None) -> DataFrame:
    """keys with a broadcast hint if they are at most ``most`` narrow rows (or elements, by weight; some 50 MB as a hash table); else as they are, to be shuffled."""
    n = keys.count() if weight is None else keys.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return F.broadcast(keys) if n <= (BROADCAST_IDS // 4 if most is None else most) else keys


def place(bits: int, *key: Column) -> Column:
    """The place of a key in a map of 2**bits bits."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << bits))


def bit_map(keys: DataFrame, bits: int) -> DataFrame:
    """(_word, _bits): the places of all keys (rows of ``keys``) as bits of 64-bit words: at most 2**bits / 64 rows, however many keys there are."""
    at = keys.select(place(bits, *(F.col(c) for c in keys.columns)).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    return at.groupBy(F.floor(F.col("at") / 64).alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def looked_up(rows: DataFrame, bits: DataFrame, at_: Column, name: str) -> DataFrame:
    """rows with a column ``name``: whether the bit of a place (null: no) is set in a map, which is broadcast."""
    at, word, mask = (fresh(rows, c) for c in ("_at", "_word", "_bits"))
    sent = F.broadcast(bits.select(F.col("_word").alias(word), F.col("_bits").alias(mask)))
    found = rows.withColumn(at, at_).withColumn(word, F.floor(F.col(at) / 64)).join(sent, word, "left")
    return found.withColumn(name, F.coalesce(F.getbit(F.col(mask), (F.col(at) % 64).cast("int")) == 1, F.lit(False))).drop(at, word, mask)
