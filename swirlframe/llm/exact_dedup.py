"""Exact duplicates by progressive refinement (DataFrame operations only).

Rows are grouped by byte length; rows in a group of more than one by a hash of
their first characters; and only rows that still share a group are hashed in full.

Which lengths and prefixes are shared is broadcast as a map of 2**BITS bits by their hash, so what is sent
has one size for any corpus, and no text is shuffled: a bit that two keys share only means that a
row is hashed in full for nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bit_map, cut, fresh, looked_up, place, spread, without_rows

#: Characters of the prefix that the second step hashes.
PREFIX = 64
#: Bits (as a power of two) of the map of what is shared: at most 2**BITS / 64 rows of 16 bytes.
BITS = 24


def refined(docs: DataFrame, text_col: str = "text", prefix: int = PREFIX) -> tuple[DataFrame, str]:
    """docs with one more column, and its name: the SHA-256 of texts that share length and prefix with another row, null for others."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    size, head = F.octet_length(body), F.xxhash64(F.substring(body, 1, prefix))
    sha, some = fresh(docs, "_sha"), fresh(docs, "_open")
    # 1. length: only lengths that rows share go on
    lengths = docs.select(size.alias("len")).groupBy("len").agg(F.count("*").alias("n")).filter("n > 1").select("len")
    rows = looked_up(docs, cut(bit_map(lengths, BITS)), place(BITS, size), some)
    # 2. hash of the prefix, within a length
    heads = rows.filter(F.col(some)).select(size.alias("len"), head.alias("head")).groupBy("len", "head").agg(F.count("*").alias("n")).filter("n > 1").select("len", "head")
    rows = looked_up(rows, cut(bit_map(heads, BITS)), F.when(F.col(some), place(BITS, size, head)), some)
    # 3. the whole content, of surviving rows only
    return rows.withColumn(sha, F.when(F.col(some), F.unhex(F.sha2(body, 256)))).drop(some), sha


def _grouped(rows: DataFrame, sha: str, id_col: str, also: list[str]) -> DataFrame:
    """(id, sha, also, group_size, keep_id) of refined rows."""
    left = cut(rows.select(F.col(id_col).alias("id"), F.col(sha).alias("sha"), *also))
    hashed = left.filter("sha is not null")
    groups = cut(hashed.groupBy("sha").agg(F.count("*").alias("group_size"), F.max("id").alias("keep_id")).filter("group_size > 1"))
    # of the rows of one text, ids tell in which task one goes
    joined = spread(hashed, groups, ["sha"], "group_size", ["id"], "left")
    alone = left.filter("sha is null").withColumns({"group_size": F.lit(None).cast("long"), "keep_id": F.lit(None).cast(left.schema["id"].dataType)})
    both = joined.unionByName(alone)
    one = F.col("group_size").isNull()
    return both.withColumns({"keep_id": F.when(one, F.col("id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, digest: bool = False) -> DataFrame:
    """One row per row of docs: id_col, keep_id (largest id of the rows with this text), group_size, kept.

    digest adds text_sha256 of every row; without it only rows that may have a copy are hashed in full.
    Null texts count as empty, and are one group.  Null ids never stay while a group has
    another id; in a group with null ids only, keep_id is null and kept is true.  Repeated rows
    with one id count in group_size and are kept together.  Extra columns of docs are not read.
    """
    rows, sha = refined(docs.select(id_col, text_col), text_col, prefix)
    full = F.when(F.col(sha).isNotNull(), F.lower(F.hex(sha))).otherwise(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    more = {"text_sha256": full} if digest else {}
    found = _grouped(rows.withColumns(more), sha, id_col, list(more))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), *more)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX) -> DataFrame:
    """docs without the rows of which another row with the same text and a larger id stays; all columns stay.

    Rows go by id and text, so an id may have several texts; null ids go where another id has the text.  Of
    exact_groups(), so the same holds for nulls and repeated rows.
    """
    rows, sha = refined(docs, text_col, prefix)
    gone = _grouped(rows, sha, id_col, []).filter(~F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "sha")
    return without_rows(rows, gone, id_col, F.col(sha)).select(docs.columns)
