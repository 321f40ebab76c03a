"""Connected components against a union-find on the driver, with limits as they are and tiny ones, so that the code for large graphs runs too."""

import random

import pytest
from pyspark.sql import functions as F

from swirlframe.plans import components as m
from swirlframe.plans import skew
from swirlframe.plans.checkpoints import cut


def smallest(links):
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def graphs():
    rng = random.Random(3)
    low, high, middle = [(0, i) for i in range(1, 80)], [(i, 999) for i in range(100, 180)], [(250, i) for i in range(200, 300)]
    path = [(i, i + 1) for i in range(400, 406)]
    rest = [(rng.randrange(500, 560), rng.randrange(500, 560)) for _ in range(25)]
    return low + high + middle + path + rest + [(79, 100)] + low[:5]


@pytest.mark.parametrize("tiny", [False, True])
def test_components_with_hubs(spark, monkeypatch, tiny):
    if tiny:
        monkeypatch.setattr(m, "SENT", 0)
        monkeypatch.setattr(skew, "FEW", 7)
    links = graphs()
    got = {r.id: r.component for r in m.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == smallest([x for x in links if x[0] != x[1]])


def test_components_of_structs_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (None, 4), (5, None)], "a long, b long")
    pairs = rows.select(*(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("doc"), F.lit(0).alias("para"))).alias(c) for c in "ab"))
    assert {(r.id.doc, r.component.doc) for r in m.connected(pairs).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert m.connected(rows.limit(0)).count() == 0


def test_no_task_has_all_neighbours_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(skew, "FEW", 50)
    rows = spark.range(1, 2001).select(F.lit(0).cast("long").alias("hi"), F.col("id").alias("lo")).union(spark.range(5000, 5040).select("id", (F.col("id") + 1).alias("lo")))
    least = cut(rows.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")))
    out = skew.spread(rows, least, ["hi"], "n", ["lo"], most=0)
    sizes = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2040 and max(sizes) < 1000
