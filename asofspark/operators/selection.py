"""Exact quantiles by distributed selection: what a task holds does not grow with the number of distinct values.

Each wanted quantile lies between two order statistics. For it two bounds are kept, with the exact numbers of values up
to the lower and between the two. A round takes a sketch of the values between them (mergeable, of fixed size), moves the
bounds to the sketch's values on either side of the wanted ranks, and counts exactly. When few distinct values are left
between the bounds, they are counted one by one and the order statistics read off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import staged

FEW = 1 << 15  # values between the bounds of one quantile that are ordered in one task
STEPS = 256  # values of a round's sketch
ACCURACY = 10_000  # ranks of the sketch are off by 1 / ACCURACY of its values at most, much less than a step


def _between(x: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """A row for each value and each quantile of its group that has it between its bounds."""
    inside = (F.col("_v") > F.col("_lo")) & (F.col("_v") < F.col("_hi"))
    if by:
        return x.join(bounds, by).where(inside)
    return x.crossJoin(F.broadcast(bounds)).where(inside)  # a row for each probability asked


def _closer(x: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """bounds after a round: those with many values between them are moved, the others stay."""
    key = [*by, "_q"]
    rows = _between(x, bounds.where("_many"), by)
    grid = F.percentile_approx("_v", F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)]), F.lit(ACCURACY)).alias("_grid")
    sketched = bounds.join(rows.groupBy(*key).agg(grid), key, "left")
    local = F.col("_rank") - F.col("_upto")
    low = F.floor(local * STEPS / F.col("_inside")).cast("int") - 1
    high = F.ceil((local + 2) * STEPS / F.col("_inside")).cast("int") + 1
    moved = F.col("_grid").isNotNull()
    new_low = F.when(moved & (low >= 0), F.get("_grid", low)).otherwise(F.col("_lo"))
    new_high = F.when(moved & (high <= STEPS), F.get("_grid", high)).otherwise(F.col("_hi"))
    sketched = staged(sketched.withColumns({"_lo2": new_low, "_hi2": new_high}).drop("_grid"))
    again = _between(x, sketched.where("_many"), by)
    counted = again.groupBy(*key).agg(F.count_if(F.col("_v") <= F.col("_lo2")).alias("_passed"), F.count_if((F.col("_v") > F.col("_lo2")) & (F.col("_v") < F.col("_hi2"))).alias("_kept"))
    b = sketched.join(counted, key, "left")
    same = ["_n", "_q", "_rank", "_part"]
    return b.select(*by, *same, F.col("_lo2").alias("_lo"), F.col("_hi2").alias("_hi"), (F.col("_upto") + F.coalesce("_passed", F.lit(0))).alias("_upto"), F.coalesce("_kept", "_inside").alias("_inside"))


def _marked(bounds: DataFrame, few: int) -> DataFrame:
    """bounds with whether a wanted value lies between them and more than few values do."""
    wanted = (F.col("_rank") + 1 >= F.col("_upto")) & (F.col("_rank") < F.col("_upto") + F.col("_inside"))
    return bounds.withColumn("_many", wanted & (F.col("_inside") > few))


def exact_quantiles(df: DataFrame, value: Column | str, probabilities: list[float], by: list[str] | None = None, few: int = FEW, rounds: int = 40) -> DataFrame:
    """(by, q_0, q_1, ...): for each group and probability the quantile of value, interpolated between the two nearest
    order statistics, as quantile_cont and percentile give it. Nulls and NaN are left out; infinite values are not
    allowed; a group without values, or with a null in by, has no row; without by an empty table gives nulls. The result is exact whatever few
    and rounds are; they bound what one task orders."""
    by = by or []
    x = staged(df.select(*by, F.nanvl(F.col(value).cast("double") if isinstance(value, str) else value.cast("double"), F.lit(None)).alias("_v")).where("_v is not null"))
    sizes = x.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 0")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_q"), F.lit(float(p)).alias("_p")) for i, p in enumerate(probabilities)]))
    b = sizes.select(*by, "_n", each.alias("_w")).select(*by, "_n", "_w.*").withColumn("_at", F.col("_p") * (F.col("_n") - 1))
    b = b.select(
        *by, "_n", "_q", F.floor("_at").cast("long").alias("_rank"), (F.col("_at") - F.floor("_at")).alias("_part"),
        F.lit(float("-inf")).alias("_lo"), F.lit(float("inf")).alias("_hi"), F.lit(0).cast("long").alias("_upto"), F.col("_n").alias("_inside"),
    )
    b = staged(_marked(b, few))
    for _ in range(rounds):
        if b.where("_many").isEmpty():
            break
        b = staged(_marked(_closer(x, b, by), few))
    # the values between the bounds, where the wanted ones are among them
    key = [*by, "_q"]
    there = (F.col("_rank") + 1 >= F.col("_upto")) & (F.col("_rank") < F.col("_upto") + F.col("_inside"))
    counts = _between(x, b.where(there), by).groupBy(*key, "_v").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*key).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_run", F.sum("_c").over(w)).join(b, key)
    reached = lambda rank: F.min(F.when(F.col("_upto") + F.col("_run") > rank, F.col("_v")))
    second = F.least(F.col("_rank") + 1, F.col("_n") - 1)
    inner = ranked.groupBy(*key).agg(reached(F.col("_rank")).alias("_a"), reached(second).alias("_b"))
    at = lambda rank, found: F.when(rank < F.col("_upto"), F.col("_lo")).otherwise(F.coalesce(F.col(found), F.col("_hi")))
    both = b.join(inner, key, "left").select(*key, "_part", at(F.col("_rank"), "_a").alias("_a"), at(second, "_b").alias("_b"))
    between = F.when(F.col("_part") > 0, F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).otherwise(F.col("_a"))
    return both.groupBy(*by).agg(*[F.max(F.when(F.col("_q") == i, between)).alias(f"q_{i}") for i in range(len(probabilities))])
