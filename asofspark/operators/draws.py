"""Repeated random draws without exploding every row for every seed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def smallest_draws(rows: DataFrame, wanted: DataFrame, group: str, ident: str, seeds: int, draw: Callable[[Column], Column], most: int) -> DataFrame:
    """For each seed from 1 and each group the rows with the n smallest draws: rows with seed, where n is the group's in
    wanted (group, n), or all rows if there are fewer.

    draw gives a whole number of [0, most) for a seed and the row at hand; ties go by ident. A row is put out only for
    the seeds for which it draws below a threshold that leaves a few more than n rows of its group, so what is sorted
    grows with the rows drawn and not with seeds x rows. Where chance leaves fewer than n, all rows of that seed and
    group are taken up again.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_size")).join(wanted, group)
    sizes = sizes.select(group, F.least("n", "_size").alias("_n"), "_size").where("_n > 0")
    spare = F.col("_n") + 5 * F.sqrt(F.col("_n")) + 10
    sizes = sizes.withColumn("_below", F.ceil(F.lit(float(most)) * F.least(F.lit(1.0), spare / F.col("_size"))))
    every = F.sequence(F.lit(1), F.lit(seeds))
    marked = rows.join(sizes, group)
    near = marked.withColumn("seed", F.explode(F.filter(every, lambda s: draw(s.cast("long")) < F.col("_below"))))
    counts = near.groupBy(group, "seed").agg(F.count("*").alias("_k"))
    all_of = sizes.withColumn("seed", F.explode(every)).join(counts, [group, "seed"], "left")
    short = all_of.where(F.coalesce("_k", F.lit(0)) < F.col("_n")).select(group, "seed")
    again = marked.join(short, group)
    both = near.join(short, [group, "seed"], "left_anti").unionByName(again.select(near.columns))
    nth = F.row_number().over(Window.partitionBy(group, "seed").orderBy(draw(F.col("seed").cast("long")), ident))
    return both.withColumn("_nth", nth).where("_nth <= _n").select(*rows.columns, "seed")
