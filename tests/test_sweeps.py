"""Interval joins by plane sweep and neighbours over ranges."""

import random
import re

import pytest
from pyspark.sql import functions as F

from asofspark.operators import sweeps

POINTS, INTERVALS = "key long, at long, point_id long", "key long, start long, end long, interval_id long, value long"


@pytest.fixture(params=[1, 7])
def ranges(spark, request):
    """Few and many ranges; small ones are not put together."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    for k, x in kept.items():
        spark.conf.set(k, x)


def test_matches_are_those_of_all_pairs(spark, ranges):
    r = random.Random(ranges)
    maybe = lambda x, p=0.03: None if r.random() < p else x
    points = [(maybe(r.randrange(3)), maybe(r.randrange(40)), i) for i in range(300)]
    intervals = []
    for i in range(200):
        a = r.randrange(40)
        intervals.append((maybe(r.randrange(4)), maybe(a), maybe(a + r.choice([-2, 0, 1, 3, 30]), 0.2), i, i % 7))
    got = sweeps.interval_matches(spark.createDataFrame(points, POINTS), spark.createDataFrame(intervals, INTERVALS)).collect()
    want = {
        (p, i, x) for k, at, p in points for key, s, e, i, x in intervals
        if None not in (k, at, key, s) and k == key and s <= at and (e is None or at < e)
    }
    assert len(got) == len(want) and {tuple(g) for g in got} == want


def test_a_million_requests_on_one_symbol(spark):
    n = 1_000_000
    ids = spark.range(n)
    points = ids.select(F.lit(1).cast("long").alias("key"), (F.col("id") * 7919 % n).alias("at"), F.col("id").alias("point_id"))
    starts = F.col("id") * 104_729 % n
    intervals = ids.select(F.lit(1).cast("long").alias("key"), starts.alias("start"), (starts + 2).alias("end"), F.col("id").alias("interval_id"), starts.alias("value"))
    found = sweeps.interval_matches(points, intervals)
    assert not re.search("Join.*Nested|Cartesian", found._jdf.queryExecution().executedPlan().toString())
    got = found.groupBy("point_id").agg(F.count("*").alias("n"), F.max("value").alias("last")).join(points, "point_id")
    rows = got.agg(F.sum("n"), F.count("*"), F.count_if(F.col("last") == F.col("at"))).first()
    assert tuple(rows) == (2 * n - 1, n, n)


def test_empty_sides(spark):
    none = spark.createDataFrame([], POINTS), spark.createDataFrame([], INTERVALS)
    some = spark.createDataFrame([(1, 2, 3)], POINTS), spark.createDataFrame([(1, 2, None, 4, 5)], INTERVALS)
    assert [tuple(x) for x in sweeps.interval_matches(*some).collect()] == [(3, 4, 5)]
    for p, i in ((none[0], some[1]), (some[0], none[1]), none):
        assert sweeps.interval_matches(p, i).collect() == []


def test_next_rows_over_ranges(spark, ranges):
    r = random.Random(1)
    rows = [(r.choice([None, "a", "b", "c"]), x, r.choice([None, x])) for x in r.sample(range(10_000), 500)]
    got = sweeps.with_next(spark.createDataFrame(rows, "k string, x long, y long"), ["k"], ["x"], {"nx": "x", "ny": "y"}).collect()
    want = set()
    for k in (None, "a", "b", "c"):
        mine = sorted((x, y) for key, x, y in [(a, b, c if c is not None else -1) for a, b, c in rows] if key == k)
        want |= {(k, x, y, *after) for (x, y), after in zip(mine, [*mine[1:], (None, None)])}
    blank = lambda x, n: -1 if x is None and n is not None else x
    assert {(g["k"], g["x"], blank(g["y"], 0), g["nx"], blank(g["ny"], g["nx"])) for g in got} == want and len(got) == 500
