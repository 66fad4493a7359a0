"""Streamed folds, least squares and exact selection, on large keys and against plain computations."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from asofspark.operators import linear, ordered, selection
from asofspark.sources.readers import staged


@pytest.fixture
def many_ranges(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    kept = {k: spark.conf.get(k) for k in names}
    spark.conf.set(names[0], "7")
    spark.conf.set(names[1], "false")
    yield
    for k, x in kept.items():
        spark.conf.set(k, x)


def wilder(xs, n):
    """The recursion, one session after another."""
    a, y, gap, seen, out = 1 / n, None, 0, 0, []
    for x in xs:
        if x is not None:
            keep = (1 - a) ** (gap + 1)
            y, gap, seen = x if y is None else (keep * y + a * x) / (keep + a), 0, seen + 1
        else:
            gap += 1
        out.append(y if seen >= n else None)
    return out


def test_wilder_over_ranges(spark, many_ranges):
    r = random.Random(3)
    series = {k: [None if r.random() < 0.3 else r.uniform(1, 9) for _ in range(n)] for k, n in ((1, 900), (2, 40), (3, 5), (4, 0))}
    series[5] = [None] * 30
    series[6] = [None] * 200 + [1.0] + [None] * 300 + [2.0, 3.0]
    rows = [(k, t + 1, x) for k, xs in series.items() for t, x in enumerate(xs)]
    got = ordered.wilder(spark.createDataFrame(rows, "instrument_id int, sidx int, x double"), "instrument_id", "sidx", "x", {"y3": 3, "y14": 14}).collect()
    want = {(k, t + 1): (a, b) for k, xs in series.items() for t, (a, b) in enumerate(zip(wilder(xs, 3), wilder(xs, 14), strict=True))}
    assert len(got) == len(want)
    for g in got:
        for mine, theirs in zip((g["y3"], g["y14"]), want[g["instrument_id"], g["sidx"]], strict=True):
            assert (mine is None) == (theirs is None) and (mine is None or mine == pytest.approx(theirs, rel=1e-12))


def test_wilder_of_a_million_sessions_of_one_key(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 5 != 0, (F.col("id") * 7919 % 1000).cast("double")).alias("x"))
    got = ordered.wilder(df, "k", "t", "x", {"y": 14}).where(f"t >= {n - 3}").orderBy("t").collect()
    i = np.arange(n)
    want = pd.Series(np.where(i % 5 != 0, (i * 7919 % 1000).astype(float), np.nan)).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    assert [g["y"] for g in got] == pytest.approx(want.iloc[-3:].tolist(), rel=1e-9)


def test_chains_of_a_million_events_of_one_key(spark):
    n = 1_000_000
    e = spark.range(n).select(F.lit(7).alias("k"), (F.col("id") * 7919 % n).alias("t"), F.col("id").cast("string").alias("text"))
    chain = staged(ordered.sealed(e, ["k"], ["t"], "text"))
    last, before = None, None
    inverse = pow(7919, -1, n)
    for t in range(n):
        before, last = last, hashlib.md5(((last or "") + str(t * inverse % n)).encode()).hexdigest()
    assert [tuple(x) for x in chain.where(f"t = {n - 1}").select("previous", "hash").collect()] == [(before, last)]
    altered = chain.withColumns({"text": F.when(F.col("t") == 500, "other").otherwise(F.col("text")), "previous": F.when(F.col("t") == 900_000, "x").otherwise(F.col("previous"))})
    faults = [(x["t"], x["fault"]) for x in ordered.verified(altered, ["k"], ["t"], "text").orderBy("t").collect()]
    # the altered text, its follower whose link names the stored hash, and the altered link
    assert faults == [(500, "CONTENT"), (501, "LINK"), (900_000, "LINK")]


def test_trades_that_do_not_overlap(spark):
    r = random.Random(9)
    rows = [(r.randrange(4), t, None if r.random() < 0.01 else t + r.randrange(6)) for t in range(400)] + [(9, None, 3)]
    df = spark.createDataFrame(rows, "k int, b int, e int").repartition(5)
    for touching in (True, False):
        want = set()
        for k in range(4):
            busy = -1
            for _, b, e in sorted(x for x in rows if x[0] == k):
                if b > busy or (touching and b == busy):
                    want.add((k, b))
                    busy = float("inf") if e is None else e
        assert {tuple(x) for x in ordered.not_overlapping(df, ["k"], "b", "e", ["b"], touching).collect()} == want


def test_average_cost(spark):
    e = [(1, 1, 100, 10, 1, 0), (1, 2, 200, 10, 1, 0), (1, 3, 300, -5, 2, 4), (1, 4, 300, -100, 1, 0), (2, 1, 50, -10, 1, 0)]
    got = ordered.average_cost(spark.createDataFrame(e, "k long, t long, price long, qty long, split long, dividend long"), ["k"], ["t"])
    # 20 at 150; dividends 80; 40 at 75; 5 and then 35 sold at 300
    assert sorted(map(tuple, got.collect())) == [(1, 0, 75, 80 + 225 * 40), (2, 0, 0, 0)]


def test_least_squares_of_forty_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(50, 3, (4000, 40))
    x[:, 7] = x[:, 2] * -3 + 1  # correlates by 1
    x[:, 11] = x[:, 3] + x[:, 4] - 2 * x[:, 5]  # only the three together explain it
    x[:, 20] = 5.0  # does not vary
    y = x @ rng.normal(0, 1, 40) + rng.normal(0, 1, 4000)
    names = [f"c{i}" for i in range(40)]
    pdf = pd.DataFrame(x, columns=names).assign(y=y, id=np.arange(4000))
    pdf.loc[:9, "c0"] = np.nan
    pdf = pdf.astype(object).where(pdf.notna(), None)
    schema = ", ".join([*(f"{c} double" for c in names), "y double", "id long"])
    df = spark.createDataFrame(pdf, schema).repartition(5)
    got = {r["id"]: r["fitted"] for r in linear.least_squares(df, names, "y").select("id", "fitted").collect()}
    full = np.column_stack([np.ones(3990), x[10:]])
    want = full @ np.linalg.lstsq(full, y[10:], rcond=None)[0]
    assert [got[i + 10] for i in range(3990)] == pytest.approx(want.tolist(), abs=1e-6) and len(got) == 3990
    m = linear.moments(df, ["c1", "c2", "c7"])
    assert m.correlations() == pytest.approx(np.corrcoef(x[:, [1, 2, 7]].T), abs=1e-9)


def test_correlations_with_ties_and_gaps(spark, many_ranges):
    r = random.Random(2)
    rows = [(i, r.choice([None, 1.0, 2.0, 3.0]), r.choice([None, 5.0, r.random()]), float(i % 7), 4.0) for i in range(500)]
    pdf = pd.DataFrame(rows, columns=["id", "a", "b", "c", "d"]).astype(float)
    got = {(x["a"], x["b"]): (x["r"], x["rho"]) for x in linear.correlation_matrix(spark.createDataFrame(rows, "id long, a double, b double, c double, d double"), ["id"], ["a", "b", "c", "d"]).collect()}
    ranks = pdf[["a", "b", "c", "d"]].rank()
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        assert got[a, b] == pytest.approx((pdf[a].corr(pdf[b]), ranks[a].corr(ranks[b])), abs=1e-9)
    assert all(got[x, "d"] == (None, None) for x in "abc") and len(got) == 6


PROBABILITIES = [0.0, 0.05, 0.2, 0.5, 0.617, 0.95, 1.0]


@pytest.mark.parametrize("few", [3, 200])
def test_selection_is_exact(spark, few):
    r = random.Random(few)
    groups = {
        "normal": [r.gauss(0, 1) for _ in range(3000)], "ties": [float(r.choice([1, 1, 1, 1, 2, 9])) for _ in range(3000)], "one": [4.0], "two": [1.0, 2.0],
        "spread": [r.choice([-1, 1]) * 10.0 ** r.uniform(-300, 300) for _ in range(1500)], "heavy": [5.0] * 2000 + [r.random() * 10 for _ in range(900)],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("normal", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    got = {x["g"]: x for x in selection.exact_quantiles(df, "x", PROBABILITIES, ["g"], few).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        s = sorted(xs)
        for i, p in enumerate(PROBABILITIES):
            at = p * (len(s) - 1)
            k = int(at)
            want = s[k] + (s[min(k + 1, len(s) - 1)] - s[k]) * (at - k)
            assert got[g][f"q_{i}"] == pytest.approx(want, rel=1e-12), (g, p)


def test_selection_of_many_distinct_values(spark):
    n = 400_000
    df = spark.range(n).select((F.col("id") * 104_729 % n).cast("double").alias("x"))
    row = selection.exact_quantiles(df, "x", [0.1, 0.5], few=2000).first()
    assert tuple(row) == pytest.approx((0.1 * (n - 1), 0.5 * (n - 1)))
    assert selection.exact_quantiles(df.limit(0), "x", [0.5]).first()["q_0"] is None
