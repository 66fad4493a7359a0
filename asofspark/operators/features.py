"""Rolling features on a dense grid (instrument_id, sidx, session, ...), where a row frame counts sessions.

Windows of one instrument share one partitioning and ordering, so that chained features cost one shuffle and one sort.
A rolling value is null until its frame holds the least number of observations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import wilder


def BY():
    return Window.partitionBy("instrument_id").orderBy("sidx")


def over_last(n: int, skip: int = 0, by=None):
    return (by or BY()).rowsBetween(-(n - 1) - skip, -skip)


def full(value: Column, of: Column, w, least: int) -> Column:
    """value over w where at least `least` of `of` are not null."""
    return F.when(F.count(of).over(w) >= least, value.over(w))


def close_location(high: Column, low: Column, close: Column) -> Column:
    return F.when(high - low > 0, (close - low) / (high - low))


def previous_traded(close: Column, by=None) -> Column:
    return F.last(close, True).over((by or BY()).rowsBetween(Window.unboundedPreceding, -1))


def true_range(high: Column, low: Column, close: Column, by=None) -> Column:
    """Null if high, low or the previous session's close is: greatest() alone would skip nulls."""
    pc = F.lag(close).over(by or BY())
    return F.when(high.isNotNull() & low.isNotNull() & pc.isNotNull(), F.greatest(high - low, F.abs(high - pc), F.abs(low - pc)))


def zscore(x: Column, n: int, least: int | None = None, by=None) -> Column:
    w = over_last(n, by=by)
    return F.try_divide(x - full(F.avg(x), x, w, least or n), F.when(F.stddev_samp(x).over(w) > 0, F.stddev_samp(x).over(w)))


def trailing_return(price: Column, lookback: int, skip: int, by=None) -> Column:
    then = F.lag(price, skip + lookback).over(by or BY())
    return F.when(then > 0, F.lag(price, skip).over(by or BY()) / then - 1)


def causal_percentile(x: Column, n: int, by=None) -> Column:
    """Share (in percent) of the last n values that are at most the current one; full windows only."""
    held = F.collect_list(x).over(over_last(n, by=by))
    return F.when((F.size(held) == n) & x.isNotNull(), F.size(F.filter(held, lambda v: v <= x)) * 100.0 / n)


def ewm_over_gaps(df: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """df with the Wilder average of x (weight 1/n) for each instrument, over missing sessions: see ordered.wilder."""
    return wilder(df, "instrument_id", "sidx", x, {out: n})


def with_actions(grid: DataFrame) -> DataFrame:
    """grid with prior (previous traded close), prev_close (as the exchange states it: halved on action sessions, by an
    arithmetic rule) and factor, their ratio where the two differ."""
    prior = previous_traded(F.col("close"))
    rule = (F.col("instrument_id") * 31 + F.col("sidx")) % 97 == 0
    g = grid.withColumn("prior", prior).withColumn("prev_close", F.when(F.col("close").isNotNull(), F.when(rule, F.col("prior") * 0.5).otherwise(F.col("prior"))))
    return g.withColumn("factor", F.when(F.abs(F.try_divide(F.col("prev_close"), F.col("prior")) - 1) > 0.005, F.col("prev_close") / F.col("prior")))


def detect_actions(grid: DataFrame, tolerance: float = 0.005, untrusted: float = 0.2, mass: float = 0.05) -> DataFrame:
    """Isolated corporate actions: sessions on which a large share of traded names disagree, or move by over a tenth
    at once, are not believed."""
    ratio = F.try_divide(F.col("prev_close"), F.col("prior"))
    g = with_actions(grid).withColumn("ratio", ratio).withColumn("off", F.abs(F.col("ratio") - 1) > tolerance)
    days = g.where("close is not null and ratio is not null").groupBy("sidx").agg(F.avg(F.col("off").cast("double")).alias("off_share"), F.avg((F.abs(F.col("ratio") - 1) > 0.1).cast("double")).alias("moved_share"))
    trusted = days.withColumn("trusted", ~((F.col("off_share") > untrusted) | (F.col("moved_share") > mass * 4))).select("sidx", "trusted")
    return g.where("off").join(trusted, "sidx").select("instrument_id", "sidx", "session", "ratio", "trusted")


def adjusted_close(grid: DataFrame) -> DataFrame:
    """Compounded action-free returns, anchored to the last real close."""
    g = with_actions(grid).withColumn("ret", F.col("close") / (F.col("prior") * F.coalesce("factor", F.lit(1.0))) - 1)
    growth = F.exp(F.sum(F.ln(1 + F.coalesce("ret", F.lit(0.0)))).over(BY().rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("instrument_id").orderBy("sidx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    g = g.withColumn("growth", growth)
    last = F.last(F.when(F.col("close").isNotNull(), F.struct("close", "growth")), True).over(whole)
    return g.withColumn("_last", last).withColumn("adjusted", F.when(F.col("close").isNotNull(), F.col("growth") * F.col("_last.close") / F.col("_last.growth"))).drop("_last")


def universe_stats(grid: DataFrame, window: int) -> DataFrame:
    """Sessions of history, calendar days since the last trade, and the trailing median turnover (half a window is enough)."""
    w, all_ = over_last(window), BY().rowsBetween(Window.unboundedPreceding, 0)
    t = F.col("turnover")
    return grid.select(
        "instrument_id", "session", "sidx", "close", "turnover", F.count("close").over(all_).alias("history"),
        F.datediff("session", F.last(F.when(F.col("close").isNotNull(), F.col("session")), True).over(all_)).alias("stale_days"),
        F.when(F.count(t).over(w) >= window // 2, F.percentile(t, F.lit(0.5)).over(w)).alias("liquidity"),
    )


def month_ends(calendar: DataFrame) -> DataFrame:
    return calendar.groupBy(F.trunc("session", "month").alias("month")).agg(F.max("session").alias("session"), F.max("sidx").alias("sidx"))


def universe_reasons(grid: DataFrame, calendar: DataFrame, window: int, history: int, stale: int, min_price: float) -> DataFrame:
    """At each month end: why an instrument is left out, and the rank by liquidity of those that are not."""
    s = universe_stats(grid, window).join(month_ends(calendar).select("sidx"), "sidx")
    flags = F.array(
        F.when(F.col("history") < history, "short_history"), F.when(F.coalesce("stale_days", F.lit(9999)) > stale, "stale"),
        F.when(F.col("liquidity").isNull(), "no_liquidity"), F.when(F.coalesce("close", F.lit(0.0)) < min_price, "low_price"),
    )
    s = s.withColumn("reasons", F.array_join(F.array_compact(flags), "|"))
    w = Window.partitionBy("sidx", F.col("reasons") == "").orderBy(F.desc("liquidity"), "instrument_id")
    return s.withColumn("rank", F.when(F.col("reasons") == "", F.row_number().over(w)))


def hysteresis(ranked: DataFrame, size: int, buffer: int) -> DataFrame:
    """Membership of each month end: in at rank <= size, out beyond buffer or without a rank, else as before. The
    state depends on an instrument's own ranks alone: the last decisive one holds."""
    decisive = F.when(F.col("rank") <= size, 1).when(F.col("rank").isNull() | (F.col("rank") > buffer), 0)
    return ranked.withColumn("member", F.coalesce(F.last(decisive, True).over(BY().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))


def rank_select(df: DataFrame, value: str, fraction: float, by: str = "sidx") -> DataFrame:
    """Rank (descending, ties by instrument), percentile 1 - (rank - 1) / n, and whether it is in the top fraction."""
    n = F.count("*").over(Window.partitionBy(by))
    r = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value), "instrument_id"))
    d = df.where(F.col(value).isNotNull()).withColumns({"n": n, "rank": r})
    return d.withColumns({"percentile": F.round(1 - (F.col("rank") - 1) / F.col("n"), 6), "selected": F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.col("n") * fraction))})


def asof_values(grid: DataFrame, events: DataFrame, key: str, time: str, value: str, at: str) -> DataFrame:
    """Backward as-of join: for each grid row (key, at) the last event value with time <= at. Union and one window over
    (key, time): one shuffle, and no row is matched against a range of others."""
    tagged = events.select(key, F.col(time).cast("timestamp").alias("_t"), F.lit(0).alias("_side"), F.struct("*").alias("_e"), F.lit(None).cast(grid.select(F.struct("*").alias("g")).schema[0].dataType).alias("_g"))
    asked = grid.select(key, F.col(at).cast("timestamp").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(tagged.schema["_e"].dataType).alias("_e"), F.struct("*").alias("_g"))
    w = Window.partitionBy(key).orderBy("_t", "_side", F.col("_e.filing_id") if "filing_id" in events.columns else F.lit(0)).rowsBetween(Window.unboundedPreceding, 0)
    return tagged.unionByName(asked).withColumn("_v", F.last(f"_e.{value}", True).over(w)).where("_side = 1").select("_g.*", F.col("_v").alias(value))
