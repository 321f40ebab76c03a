"""Joins in which no key meets in one task, however many rows it has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most narrow rows that spread() broadcasts (some 50 MB as a hash table).
BROADCAST = 250_000
#: It deals the rows of a key over several tasks if it has more than FEW rows and more than one in SHARE of all.
FEW, SHARE = 1_000, 100_000


def spread(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, by: list[str], how: str = "inner", most: int | None = None) -> DataFrame:
    """rows joined (inner or left) with keyed, a row per key ``on`` that has the number ``n`` of its rows; no key meets in one task.

    A small ``keyed`` is broadcast.  Else the two are shuffled, and a key with many rows is dealt over several tasks by a hash
    of the columns ``by``.  Such keys have more than one in SHARE of all rows, so there are at most SHARE of them:
    that bounds what is broadcast.  keyed has to be cut, as it is read several times.
    """
    count, total = keyed.agg(F.count("*"), F.coalesce(F.sum(n), F.lit(0))).first()
    if count <= (BROADCAST if most is None else most):
        return rows.join(F.broadcast(keyed), on, how)
    limit = max(FEW, total // SHARE)
    parts = F.ceil(F.col(n) / F.lit(limit)).cast("long")
    hot = keyed.filter(F.col(n) > limit).select(*on, parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    many = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(many, [*on, "_salt"], how).drop("_salt")
