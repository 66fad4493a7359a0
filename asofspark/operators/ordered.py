"""Folds over ordered rows that hold one state: rows are partitioned by key, sorted, and read once.

State and rows of a key are never collected, so a key with many rows takes linear time and constant memory. Where the
steps compose, as those of the Wilder average do, a key is cut into ranges as well.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.readers import staged

BATCH = 1 << 14


def streamed(rows: DataFrame, key: list[str], read: list[str], start: Callable[[], Any], step: Callable, fields: str, finish: Callable | None = None) -> DataFrame:
    """Folds rows, which are in order of key within each partition. step(state, *values of read) returns the next state
    and a tuple to put out (or None); finish(state) may give one more at a key's end. Put out are the key and fields."""
    schema = StructType([*[rows.schema[k] for k in key], *StructType.fromDDL(fields).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, out = None, None, []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(arrow)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for b in batches:
            keys = zip(*[b.column(k).to_pylist() for k in key], strict=True)
            values = zip(*[b.column(c).to_pylist() for c in read], strict=True)
            for k, v in zip(keys, values, strict=True):
                if k != last:
                    if last is not None and finish and (end := finish(state)) is not None:
                        out.append((*last, *end))
                    state, last = start(), k
                state, put = step(state, *v)
                if put is not None:
                    out.append((*k, *put))
                if len(out) >= BATCH:
                    yield batch()
        if last is not None and finish and (end := finish(state)) is not None:
            out.append((*last, *end))
        yield batch()

    return rows.select(*dict.fromkeys([*key, *read])).mapInArrow(run, schema)


def folded(df: DataFrame, key: list[str], order: list[str], start: Callable[[], Any], step: Callable, fields: str, finish: Callable | None = None, read: list[str] | None = None) -> DataFrame:
    """An ordered fold of each key's rows: see streamed. Sorting spills; what is held is one state."""
    read = read or order
    rows = df.select(*dict.fromkeys([*key, *order, *read])).repartition(*key).sortWithinPartitions(*key, *order)
    return streamed(rows, key, read, start, step, fields, finish)


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def not_overlapping(df: DataFrame, key: list[str], begin: str, end: str, kept: list[str], touching: bool = True) -> DataFrame:
    """Of each key's rows in order of begin those that begin when none taken before is still open: at or after its end,
    or only after it if not touching. A row without an end stays open; one without a begin is never taken. Put out are
    key and kept."""

    def step(state, b, e, *row):
        busy, forever = state
        if forever or (busy is not None and (b < busy or (b == busy and not touching))):
            return state, None
        return (e, e is None), row

    rows = df.where(F.col(begin).isNotNull())
    return folded(rows, key, [begin], lambda: (None, False), step, _fields(df, kept), read=[begin, end, *kept])


def average_cost(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Events (price, qty, split, dividend, whole numbers in the smallest unit) of each key in order -> (key, held, cost,
    realised) at its end: dividends on what is held, then the split, then the fill. A purchase moves the average cost,
    rounded half up; a sale of at most what is held realises its gain over it."""

    def step(state, price, qty, split, dividend):
        held, cost, realised = state
        realised += held * dividend
        held, cost = held * split, (cost + split - 1) // split
        if qty > 0:
            more = held + qty
            return (more, (cost * held + price * qty + more // 2) // more, realised), None
        sold = min(-qty, held)
        return (held - sold, cost, realised + (price - cost) * sold), None

    return folded(events, key, order, lambda: (0, 0, 0), step, "held long, cost long, realised long", lambda s: s, ["price", "qty", "split", "dividend"])


def _of(sorted_values: list[float], p: float) -> float:
    at = p * (len(sorted_values) - 1)
    low = int(at)
    high = min(low + 1, len(sorted_values) - 1)
    return sorted_values[low] + (sorted_values[high] - sorted_values[low]) * (at - low)


def sliding(df: DataFrame, key: list[str], order: list[str], x: str, n: int, share: str | None = None, median: str | None = None, skip: int = 0) -> DataFrame:
    """df with order statistics of the n rows of x up to skip rows before each: in `share` the percentage of them that
    are at most the row's own x, in `median` their median; null unless all n are present. key and order name a row.

    The rows of a frame are held in order of value: a step takes one out and puts one in, at places found by bisection,
    so that a row of a long frame costs about as much as one of a short frame."""

    def enter(frame: deque, values: list[float], value: float | None) -> None:
        frame.append(value)
        if value is not None:
            bisect.insort(values, value)
        if len(frame) > n and (gone := frame.popleft()) is not None:
            del values[bisect.bisect_left(values, gone)]

    def step(state, *row):
        *at, value = row
        waiting, frame, values = state
        waiting.append(value)
        if len(waiting) > skip:
            enter(frame, values, waiting.popleft())
        full = len(values) == n
        below = bisect.bisect_right(values, value) * 100.0 / n if full and value is not None else None
        return state, (*at, below, _of(values, 0.5) if full else None)

    rows = df.select(*dict.fromkeys([*key, *order]), F.col(x).cast("double").alias("_x"))
    found = folded(rows, key, order, lambda: (deque(), deque(), []), step, f"{_fields(df, order)}, _share double, _median double", read=[*order, "_x"])
    names = {"_share": share, "_median": median}
    found = found.select(*key, *order, *[F.col(c).alias(name) for c, name in names.items() if name])
    return df.join(found, [*key, *order], "left")


def _link(before: str | None, text: str | None) -> str:
    return hashlib.md5(((before or "") + (text or "")).encode()).hexdigest()


def sealed(df: DataFrame, key: list[str], order: list[str], text: str) -> DataFrame:
    """Chains each key's rows: (key, order, text, previous, hash), where hash is the md5 of the previous hash and text."""

    def step(last, *row):
        h = _link(last, row[-1])
        return h, (*row, last, h)

    kept = [*order, text]
    return folded(df, key, order, lambda: None, step, f"{_fields(df, kept)}, previous string, hash string", read=kept)


def verified(df: DataFrame, key: list[str], order: list[str], text: str) -> DataFrame:
    """Rows of sealed chains (with previous and hash, as stored) whose chain does not hold: (key, order, expected,
    fault). A row's link must be the hash of the row before, recomputed from that row's text and not read from it; then
    its hash must be that of link and text. LINK names the first fault, CONTENT the second. After a wrong link the chain
    goes on from the stored hash if that is right for the stored link, so that one fault is not told of all that follow.
    """

    def step(last, *row):
        *at, content, previous, stored = row
        h = _link(last, content)
        fault = "LINK" if previous != last else "CONTENT" if stored != h else None
        after = stored if fault == "LINK" and stored == _link(previous, content) else h
        return after, (*at, last, fault) if fault else None

    return folded(df, key, order, lambda: None, step, f"{_fields(df, order)}, expected string, fault string", read=[*order, text, "previous", "hash"])


def wilder(df: DataFrame, key: str, at: str, x: str, spans: dict[str, int]) -> DataFrame:
    """df (key and at, a session number, are unique) with Wilder averages of x: a column for each name in spans, of
    weight 1 / n.

    After k missing sessions the old value decays k + 1 times; rows without x carry the last value; values show from the
    n-th observation on. A step is an affine map of the average, so ranges of a key are reduced to one map each, these
    are chained, and each range is run from where the one before it ends: a long key is not one task.
    """
    weights = [1.0 / n for n in spans.values()]
    ranged = staged(df.select(key, at, F.col(x).cast("double").alias("_x")).repartitionByRange(key, at).withColumn("_p", F.spark_partition_id()))

    def mean(a, gap, y, value):
        keep = (1 - a) ** gap
        return (keep * y + a * value) / (keep + a)

    def reduce(state, t, value):
        """A range's observations: how many, the first and last, and, a weight each, slope and shift of the map from the
        average after the first of them to that after the last."""
        if value is None:
            return state, None
        if state is None:
            return (1, t, value, t, [1.0] * len(weights), [0.0] * len(weights)), None
        n, first, x0, last, slopes, shifts = state
        moved = [mean(a, t - last, y, value) for a, y in zip(weights, shifts, strict=True)]
        return (n + 1, first, x0, t, [mean(a, t - last, y, 0.0) for a, y in zip(weights, slopes, strict=True)], moved), None

    def chain(state, part, n, first, x0, last, slopes, shifts):
        """What stands after a range: observations so far, the last one's session, the averages."""
        seen, before, ys = state or (0, None, None)
        entered = [mean(a, first - before, y, x0) for a, y in zip(weights, ys, strict=True)] if ys else [x0] * len(weights)
        after = (seen + n, last, [p * y + q for p, q, y in zip(slopes, shifts, entered, strict=True)])
        return after, (part, after)

    def run(state, t, value, start):
        if start is not None:
            return (start["seen"], start["at"], start["y"]), None
        n, last, ys = state
        if value is not None:
            ys = [mean(a, t - last, y, value) for a, y in zip(weights, ys, strict=True)] if ys else [value] * len(weights)
            n, last = n + 1, t
        return (n, last, ys), (t, *[ys[i] if ys and n >= least else None for i, least in enumerate(spans.values())])

    read = ["_n", "_first", "_x0", "_last", "_slopes", "_shifts"]
    rows = ranged.repartitionByRange("_p", key).sortWithinPartitions("_p", key, at)
    reduced = streamed(rows, ["_p", key], [at, "_x"], lambda: None, reduce, "_n long, _first long, _x0 double, _last long, _slopes array<double>, _shifts array<double>", lambda s: s)
    after = folded(reduced, [key], ["_p"], lambda: None, chain, "_part int, _s struct<seen:long,at:long,y:array<double>>", read=["_p", *read])
    # a row for each range and key, which are as many as ranges and keys together
    held = ranged.select("_p", key).distinct().join(after.withColumnRenamed("_part", "_p"), ["_p", key], "left")
    earlier = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.withColumn("_s", F.last("_s", True).over(earlier)).where("_s is not null")
    null = lambda c: F.lit(None).cast(ranged.schema[c].dataType).alias(c)
    both = ranged.withColumn("_s", F.lit(None).cast(starts.schema["_s"].dataType)).unionByName(starts.select("_p", key, null(at), null("_x"), "_s"))
    both = both.repartitionByRange("_p", key).sortWithinPartitions("_p", key, F.asc_nulls_first(at))
    fields = f"{_fields(df, [at])}, " + ", ".join(f"`{name}` double" for name in spans)
    done = streamed(both, ["_p", key], [at, "_x", "_s"], lambda: (0, None, None), run, fields)
    return df.join(done.drop("_p"), [key, at], "left")
