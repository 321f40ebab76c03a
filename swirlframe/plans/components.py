"""Connected components by repeated minima over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import written
from .skew import spread

#: Most smallest neighbours that are broadcast (two ids and a number each).
SENT = 100_000


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for all ids of edges (a, b): the smallest id within reach.

    Each round hangs larger neighbours on the smallest one, then smaller ones too (large-star and
    small-star steps), so the number of rounds grows with the logarithm of the longest path.  The
    neighbours of a hub never meet in one task: their minimum is an aggregate, and spread() deals them
    over several tasks when they learn of it.  Edges with a null are no edges.  Raises if ``rounds`` do not suffice.
    """
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")  # tables: a checkpoint hands its constraints on, which grow with each round
    ids = e.select(F.col("hi").alias("id")).union(e.select("lo")).distinct()
    before = None
    for _ in range(rounds):
        both = e.union(e.select("lo", "hi"))
        least = written(both.groupBy("hi").agg(F.least(F.first("hi"), F.min("lo")).alias("m"), F.count("*").alias("n")), "least")
        e1 = spread(both.filter("lo > hi"), least, ["hi"], "n", ["lo"], most=SENT).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        e1 = written(e1, "links")
        least = written(e1.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")), "least")
        e2 = spread(e1, least, ["hi"], "n", ["lo"], most=SENT).select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
        e = written(e2.filter("hi <> lo").distinct(), "links")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == before:
            return ids.join(e.select(F.col("hi").alias("id"), F.col("lo").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        before = now
    raise RuntimeError(f"no components after {rounds} rounds")
