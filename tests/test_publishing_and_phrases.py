"""Two-phase publishing, file provenance, manifests, phrases, draws and sliding frames."""

import datetime
import os
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from asofspark.functions.keywords import TITLE_EXCLUDE, TITLE_INCLUDE, finance_strengths
from asofspark.operators import draws, ordered, phrases
from asofspark.sources import readers

BARS = "session date, symbol string, series string, close double"


def bars(spark, *rows):
    return spark.createDataFrame([(datetime.date(y, m, 2), s, k, x) for y, m, s, k, x in rows], BARS)


def status(df):
    return {r["year"]: (r["rows"], r["days"], r["symbols"], r["status"]) for r in df.collect()}


def test_built_years_are_skipped(spark, tmp_path):
    path = str(tmp_path / "store")
    first = bars(spark, (2019, 1, "A", "EQ", 1.0), (2020, 1, "A", "EQ", 1.0), (2020, 2, "B", "EQ", 2.0), (2020, 2, "C", "BE", 2.0))
    assert status(readers.write_years(first, path)) == {2019: (1, 1, 1, "BUILT"), 2020: (2, 2, 2, "BUILT")}
    folders = set(os.listdir(path))
    assert status(readers.write_years(first.repartition(3), path)) == {2019: (1, 1, 1, "CACHED"), 2020: (2, 2, 2, "CACHED")} and set(os.listdir(path)) == folders
    second = bars(spark, (2020, 1, "A", "EQ", 9.0), (2021, 1, "A", "EQ", 3.0))
    assert status(readers.write_years(second, path)) == {2020: (1, 1, 1, "BUILT"), 2021: (1, 1, 1, "BUILT")}
    got = readers.load_years(spark, path, "2019-01-01", "2021-12-31", ["session", "close"])
    assert sorted((r["session"].year, r["close"]) for r in got.collect()) == [(2019, 1.0), (2020, 9.0), (2021, 3.0)]
    assert status(readers.write_years(first.limit(0), path)) == {}


@pytest.mark.parametrize("years", [True, False])
def test_a_write_that_is_killed_leaves_nothing_to_read(spark, tmp_path, monkeypatch, years):
    path = str(tmp_path / "t")
    df = bars(spark, (2019, 1, "A", "EQ", 1.0))
    write = readers.write_years if years else readers.write_immutable

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(readers, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            write(df, path)
    load = (lambda: readers.load_years(spark, path, "2019-01-01", "2019-12-31", ["close"])) if years else (lambda: readers.load_immutable(spark, path))
    with pytest.raises(FileNotFoundError):
        load()
    write(df, path).collect()
    assert [r["close"] for r in load().collect()] == [1.0]


def test_altered_tables_are_told(spark, tmp_path):
    path = str(tmp_path / "t")
    readers.write_immutable(spark.range(5), path)
    assert sorted(r["id"] for r in readers.load_immutable(spark, path).collect()) == list(range(5))
    folder = next(d for d in os.listdir(path) if d.startswith("data-"))
    spark.range(1).write.mode("append").parquet(f"{path}/{folder}")
    with pytest.raises(ValueError, match="not what was published"):
        readers.load_immutable(spark, path)


def test_manifests(spark, tmp_path):
    for folder, name, text in (("a", "x.txt", "1"), ("b", "x.txt", "2"), ("a", "y.txt", "1"), ("b", "y.txt", "1")):
        os.makedirs(tmp_path / folder, exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    m = readers.manifest(spark, str(tmp_path))
    assert sorted((r["name"], r["size"], r["conflict"]) for r in m.collect()) == [("x.txt", 1, True)] * 2 + [("y.txt", 1, False)] * 2
    one = "6b86b273ff34fce19d6b804eff5a3f5747ada4eaa22f1d49c01e52ddb7875b4b"
    stored = spark.createDataFrame([("x.txt", 1, one), ("y.txt", 1, one), ("z.txt", 1, one)], "name string, size long, sha256 string")
    new = spark.createDataFrame([("n.txt", 1, one)], "name string, size long, sha256 string")
    found = m.select("name", "size", "sha256").unionByName(new)
    assert {tuple(r) for r in readers.verify_manifest(stored, found).collect()} == {("x.txt", "CHANGED"), ("y.txt", "OK"), ("z.txt", "MISSING"), ("n.txt", "NEW")}


def test_files_are_accounted_for(spark, tmp_path):
    head = "Date, Open,High,Low,Close,Volume,Turnover\r\n"
    texts = {
        "A B_DAILY.csv": head + "2020-01-02,1,1,1,1,1,\n2020-01-03,1,1,1,1,1,\n2021-01-01,1,1,1,1,1,\nbad,1\n\n", "E_DAILY.csv": head,
        "NOCLOSE_DAILY.csv": "date,open,high,low,volume\n2020-01-02,1,1,1,1\n", "other.csv": head + "2020-01-02,1,1,1,1,1,\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = {os.path.basename(r["file"]).replace("%20", " "): r for r in readers.symbol_provenance(spark, str(tmp_path), "2020-12-31").collect()}
    assert {n: (r["symbol"], r["status"], r["rows"], r["dropped"]) for n, r in got.items()} == {
        "A B_DAILY.csv": ("A B", "ACCEPTED", 2, 2), "E_DAILY.csv": ("E", "EMPTY", 0, 0),
        "NOCLOSE_DAILY.csv": ("NOCLOSE", "REFUSED_COLUMNS", 0, 1), "other.csv": (None, "REFUSED_NAME", 0, 1),
    }
    assert all(r["size"] == len(texts[n].encode()) and r["modified"] is not None for n, r in got.items())
    assert (got["A B_DAILY.csv"]["first_day"], got["A B_DAILY.csv"]["last_day"]) == (datetime.date(2020, 1, 2), datetime.date(2020, 1, 3))


def test_phrases_are_those_of_plain_search():
    lists = {"in": TITLE_INCLUDE, "out": TITLE_EXCLUDE}
    strengths = finance_strengths() | {"x-y": 7.0, "y": 3.0}
    p = phrases.Phrases(lists, strengths)
    r = random.Random(6)
    bits = ["sell", "-", "off", " ", "sell-off", "selloff", "replacement", "change", "bond", "debt", "x-y", "y", "g-sec", "é", "1", "cut", "s", "launch of", "--", ""]
    for _ in range(2000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(9)))
        total = 0.0
        for compound in re.findall(r"[a-z]+(?:-[a-z]+)*", text):
            total += strengths[compound] if compound in strengths else sum(strengths.get(w, 0.0) for w in compound.split("-"))
        counts = {name: sum(len(re.findall(f"(?={re.escape(w)})", text)) for w in words) for name, words in lists.items()}
        got = p.found(text)
        assert got[0] == counts and got[1] == pytest.approx(total), text


def test_texts_with_phrases(spark):
    df = spark.createDataFrame([(1, "Sell-off: DEBT"), (2, None), (3, "")], "i long, t string")
    got = phrases.with_phrases(df, "t", {"wanted": ["debt"]}, {"sell-off": -2.0, "sell": -1.0}, "s").orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, "Sell-off: DEBT", 1, -2.0), (2, None, 0, 0.0), (3, "", 0, 0.0)]
    assert [r["s"] for r in phrases.with_phrases(df, "t", {}, {}, "s").collect()] == [0.0] * 3


@pytest.mark.parametrize("draw", ["spread", "equal", "late"])
def test_draws_are_the_smallest(spark, draw):
    rows = [(g, i) for g, n in ((1, 400), (2, 30), (3, 5), (4, 9)) for i in range(n)]
    wanted = spark.createDataFrame([(1, 7), (2, 30), (3, 9), (9, 2), (4, 0)], "g int, n int")
    most = 1009
    # spread over the range; all alike; all above any threshold
    kinds = {"spread": lambda s, g, i: (s * 37 + g * 11 + i * 101) % most, "equal": lambda s, g, i: 0 * s, "late": lambda s, g, i: most - 1 - (i + s) % 3}
    f = kinds[draw]
    got = draws.smallest_draws(spark.createDataFrame(rows, "g int, i int"), wanted, "g", "i", 6, lambda s: F.lit(f(0, 0, 0)).cast("long") * 0 + f(s, F.col("g"), F.col("i")), most)
    want = set()
    for seed in range(1, 7):
        for g, n in ((1, 7), (2, 30), (3, 9)):
            mine = sorted((f(seed, g, i), i) for k, i in rows if k == g)[:n]
            want |= {(g, i, seed) for _, i in mine}
    found = [tuple(r) for r in got.collect()]
    assert set(found) == want and len(found) == len(want)


@pytest.mark.parametrize("n, skip", [(5, 0), (5, 1), (3, 2), (1, 0)])
def test_sliding_frames(spark, n, skip):
    r = random.Random(n + skip)
    rows = [(k, t, r.choice([None, 1.0, 2.0, r.random()]) if r.random() < 0.4 else r.random()) for k in (1, 2) for t in range(200)]
    got = ordered.sliding(spark.createDataFrame(rows, "k int, t int, x double"), ["k"], ["t"], "x", n, share="p", median="m", skip=skip).orderBy("k", "t").collect()
    for k in (1, 2):
        x = [v for key, _, v in rows if key == k]
        for t, g in enumerate([g for g in got if g["k"] == k]):
            frame = x[max(0, t - skip - n + 1) : max(0, t - skip + 1)]
            full = len(frame) == n and None not in frame
            assert (g["m"] is not None) == full and (g["p"] is not None) == (full and x[t] is not None)
            if full:
                assert g["m"] == pytest.approx(np.median(frame))
                assert x[t] is None or g["p"] == pytest.approx(100 * np.mean(np.array(frame) <= x[t]))


def test_long_frames_cost_as_short_ones(spark):
    import time

    n = 150_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"), (F.col("id") * 7919 % n).cast("double").alias("x"))
    took = []
    for frame in (26, 26, 2520):
        began = time.time()
        last = ordered.sliding(df, ["k"], ["t"], "x", frame, share="p").where(f"t = {n - 1}").first()["p"]
        took.append(time.time() - began)
    x = np.arange(n) * 7919 % n
    assert last == pytest.approx(100 * np.mean(x[-2520:] <= x[-1])) and took[2] < 3 * took[1] + 2
    assert pd.notna(last)
