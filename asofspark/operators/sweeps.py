"""Joins and neighbours in a global order, cut into ranges by sampled boundaries, so that one key is not one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import staged

CARRY, END, START, POINT = -1, 0, 1, 2  # at one instant intervals end, then begin, and then points are asked


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by range, key and instant -> a row for each point and each interval that is open there. What is held
    is the open intervals of one key."""
    held, last = {}, None
    points, found, values = [], [], []

    def out() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(points, pa.int64()), pa.array(found, pa.int64()), pa.array(values, pa.int64())], names=["point_id", "interval_id", "value"])
        points.clear(), found.clear(), values.clear()
        return b

    for b in batches:
        if not b.num_rows:
            continue
        part, key = b.column("part"), b.column("key")
        changed = pc.or_(pc.not_equal(part[1:], part[:-1]), pc.not_equal(key[1:], key[:-1])).to_pylist()
        this = (part[0].as_py(), key[0].as_py())
        changed.insert(0, this != last)
        last = (part[-1].as_py(), key[-1].as_py())
        for new, kind, i, value in zip(changed, b.column("kind").to_pylist(), b.column("id").to_pylist(), b.column("value").to_pylist(), strict=True):
            if new:
                held.clear()
            if kind == POINT:
                if held:
                    points += [i] * len(held)
                    found += held
                    values += held.values()
                    if len(points) > 1 << 16:
                        yield out()
            elif kind == END:
                held.pop(i, None)
            else:
                held[i] = value
    yield out()


def interval_matches(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """points (key, at, point_id) and intervals (key, start, end, interval_id, value) -> (point_id, interval_id, value):
    a row for each point and each interval of its key with start <= at and at < end (or end null).

    A plane sweep: starts, ends and points are one stream in the order of key and instant, which sampled boundaries cut
    into ranges of about equal size; a key or an instant with many rows is cut like any other. An interval that ends in
    a later range than it begins in is carried into the ranges between that hold points. So the rows formed are the
    matches, and each range is swept in one pass that holds the open intervals of one key. Ids and value are whole
    numbers; interval ids are unique. Rows without a key, point or start, and intervals that end before or where they
    begin, match nothing.
    """
    none, near = F.lit(None).cast("long"), F.lit(False)

    def rows(df: DataFrame, kind: int, at: str, i: str, value: Column = none, far: Column = near) -> DataFrame:
        return df.select("key", far.alias("far"), F.col(at).alias("at"), F.lit(kind).alias("kind"), F.col(i).cast("long").alias("id"), value.alias("value"))

    sound = intervals.where("key is not null and start is not null and (end is null or start < end)")
    events = rows(points.where("key is not null and at is not null"), POINT, "at", "point_id")
    events = events.unionByName(rows(sound, START, "start", "interval_id", F.col("value").cast("long")))
    events = events.unionByName(rows(sound, END, "end", "interval_id", far=F.col("end").isNull()))
    order = ["key", "far", "at", "kind", "id"]  # an interval without an end ends after all instants of its key
    ranged = staged(events.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    ends = ranged.where(F.col("kind") != POINT).groupBy("id", "key").agg(F.min("part").alias("first"), F.max("part").alias("last"), F.max("value").alias("value")).where("first < last")
    asked = ranged.where(F.col("kind") == POINT).select("key", "part").distinct()
    carried = ends.select("key", "id", "value", F.explode(F.sequence(F.col("first") + 1, "last")).alias("part")).join(asked, ["key", "part"], "left_semi")
    carried = carried.select("key", F.lit(False).alias("far"), F.lit(None).cast(ranged.schema["at"].dataType).alias("at"), F.lit(CARRY).alias("kind"), "id", "value", "part")
    swept = ranged.unionByName(carried).repartitionByRange("part").sortWithinPartitions("part", *order)
    return swept.select("part", "key", "kind", "id", "value").mapInArrow(_sweep, "point_id long, interval_id long, value long")


def with_next(df: DataFrame, key: list[str], order: list[str], taken: dict[str, str]) -> DataFrame:
    """df with a column for each name in taken: what the named column holds in the key's next row (null in its last).

    Rows are range-partitioned by key and order, which must be unique. Each range looks ahead on its own; its last row
    takes from the first row of the range that follows, of which there are as many as partitions.
    """
    rows = staged(df.repartitionByRange(*key, *order).withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p", *key).orderBy(*order)
    head = F.min(F.struct(*key, *order, *[F.col(c).alias(f"_{new}") for new, c in taken.items()]))
    heads = rows.groupBy("_p").agg(head.alias("_head"))  # one row per partition
    heads = heads.select(F.lag("_p").over(Window.orderBy("_p")).alias("_p"), "_head").where("_p is not null")
    ahead = rows.withColumn("_more", F.lead(F.lit(True)).over(w)).withColumns({f"_{new}": F.lead(c).over(w) for new, c in taken.items()})
    joined = ahead.join(heads, "_p", "left")
    same = F.lit(True)
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"_head.{k}"))
    value = lambda new: F.when(F.col("_more"), F.col(f"_{new}")).when(same, F.col(f"_head._{new}"))
    return joined.select(*df.columns, *[value(new).alias(new) for new in taken])
