"""Bars fed file by file against the batch rules for all files together."""

import datetime
import random

import pandas as pd
import pytest

from asofspark.sources import readers
from asofspark.streaming import ingest

SCHEMA = """source_record_id string, source_id string, instrument_id long, listing_id string, session_date date, event_time timestamp, published_at timestamp, retrieved_at timestamp,
available_at timestamp, open double, high double, low double, close double, volume double, turnover double, revision_number int, supersedes_record_id string"""


def bars(seed, n):
    r = random.Random(seed)
    day = datetime.datetime(2020, 1, 1)
    out = []
    for _ in range(n):
        i, d, k = r.choice([1, 2, None]), r.randrange(3), r.choice([0, 1, 1, 2, 2, 3, None])
        event = day + datetime.timedelta(days=d) if r.random() < 0.95 else None
        published = day + datetime.timedelta(days=d, hours=r.randrange(30))
        source = r.choice([None, "", *(f"r{x}" for x in range(12))])
        parent = r.choice([None, None, *(f"r{x}" for x in range(12))])
        price = r.choice([None, 1.0, -1.0])
        out.append((source, "s", i, r.choice(["L1", "L2", None]), (day + datetime.timedelta(days=d)).date(), event, published, published, published, price, 1.0, 1.0, 1.0, 5.0, 1.0, k, parent))
    return out


@pytest.mark.parametrize("seed, at_once", [(1, 1), (2, 2)])
def test_files_fed_one_by_one_give_the_batch_rows(spark, tmp_path, seed, at_once):
    rows = bars(seed, 90)
    path = str(tmp_path / "in")
    for i in range(0, len(rows), 18):
        spark.createDataFrame(rows[i : i + 18], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    listings = spark.createDataFrame([(1, "L1"), (2, "L2")], "instrument_id long, listing_id string")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        got = ingest.ingest_bars(spark, path, listings, at_once)
        want = readers.flagged_bars(spark.read.parquet(path), listings)
        order = lambda df: sorted(map(str, df.select(want.columns).collect()))
        assert order(got) == order(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


class Held:
    """State in memory with the calls that the processor makes."""

    def __init__(self):
        self.x = None

    def exists(self):
        return self.x is not None

    def get(self):
        return iter(self.x) if isinstance(self.x, list) else self.x

    def update(self, x):
        self.x = x

    def put(self, x):
        self.x = list(x)

    def appendList(self, x):
        self.x = [*(self.x or []), *x]

    def clear(self):
        self.x = None


class Handle:
    def __init__(self):
        self.ttl, self.timers = {}, []

    def getValueState(self, name, _, ttl):
        self.ttl[name] = ttl
        return Held()

    getListState = getValueState

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def getCurrentProcessingTimeInMs(self):
        return 1000


def facts(*rows):
    return iter([pd.DataFrame(rows, columns=["flag", "role", "uid", "published"])])


def told(frames):
    return [tuple(r) for f in frames for r in f.itertuples(index=False)]


def test_children_wait_for_their_parents_and_are_forgotten():
    p, h = ingest.Relations(9, 50), Handle()
    p.init(h)
    assert set(h.ttl.values()) == {9}
    run = lambda *rows: told(p.handleInputRows(("k",), facts(*rows), Clock()))
    assert run(("F", "child", "a", 5), ("F", "child", "b", 3)) == [("a", "F", True), ("b", "F", True)] and h.timers == [1050]
    assert run(("F", "parent", "x", 4)) == [("a", "F", False)]  # b was published before it
    assert run(("F", "parent", "y", 2), ("F", "child", "c", 9)) == [("b", "F", False)]
    assert run(("F", "child", "d", 1)) == [("d", "F", True)]
    assert told(p.handleExpiredTimer(("k",), None, None)) == [] and not p.waiting.exists()
    assert run(("F", "parent", "z", 0)) == []


def test_members_are_duplicates_from_the_second_on():
    p = ingest.Relations(None, None)
    p.init(Handle())
    run = lambda *uids: told(p.handleInputRows(("k",), facts(*(("D", "member", u, None) for u in uids)), Clock()))
    assert run("a") == [] and run("b") == [("a", "D", True), ("b", "D", True)] and run("c", "d") == [("c", "D", True), ("d", "D", True)]
    q = ingest.Relations(None, None)
    q.init(Handle())
    assert told(q.handleInputRows(("k",), facts(("D", "member", "a", None), ("D", "member", "b", None)), Clock())) == [("a", "D", True), ("b", "D", True)]
