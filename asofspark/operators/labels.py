"""Outcome labels: fixed horizons, first touch of stop or target, holding paths, blocking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import not_overlapping


def fixed_horizon(picks: DataFrame, grid: DataFrame, bench: DataFrame, horizon: int, cost_pct: float = 0.25) -> DataFrame:
    """Entry at the next session's open, exit at the open `horizon` sessions later, less costs and the benchmark.

    The grid has every session of every instrument, so prices ahead are leads within an instrument: one window and one
    join; the calendar and the benchmark have one row per session. A status is given for every pick; none is dropped.
    """
    ends = grid.groupBy().agg(F.max("sidx").alias("last_sidx"))
    ahead = lambda c, k: F.lead(c, k).over(by_instrument())
    prices = grid.select(
        "instrument_id", "sidx", ahead("session", 1).alias("entry_session"), ahead("open", 1).alias("entry_open"),
        ahead("session", 1 + horizon).alias("exit_session"), ahead("open", 1 + horizon).alias("exit_open"),
    )
    b_in = bench.select(F.col("session").alias("entry_session"), F.col("bench").alias("bench_in"))
    b_out = bench.select(F.col("session").alias("exit_session"), F.col("bench").alias("bench_out"))
    joined = picks.join(prices, ["instrument_id", "sidx"], "left").crossJoin(F.broadcast(ends))
    joined = joined.join(b_in, "entry_session", "left").join(b_out, "exit_session", "left")
    ok = (F.col("entry_open") > 0) & (F.col("exit_open") > 0)
    gross = (F.col("exit_open") / F.col("entry_open") - 1) * 100
    over = (F.col("bench_out") / F.col("bench_in") - 1) * 100
    status = (
        F.when(F.col("sidx") + 1 + horizon > F.col("last_sidx"), "RIGHT_CENSORED").when(F.col("entry_open").isNull(), "MISSING_ENTRY")
        .when(F.col("exit_open").isNull(), "MISSING_EXIT").when(~ok, "UNFILLABLE_PRICE").otherwise("RESOLVED")
    )
    return joined.select(
        "instrument_id", "session", "sidx", "entry_session", "exit_session", "entry_open", "exit_open", status.alias("status"),
        F.when(ok, F.round(gross, 6)).alias("gross_pct"), F.when(ok, F.lit(cost_pct)).alias("cost_pct"), F.when(ok, F.round(gross - cost_pct, 6)).alias("net_pct"),
        F.when(ok, F.round(over, 6)).alias("bench_pct"), F.when(ok, F.round(gross - cost_pct - over, 6)).alias("excess_pct"),
    )


def first_touch(picks: DataFrame, grid: DataFrame, hold: int, stop_pct: float, target_pct: float) -> DataFrame:
    """The first of up to `hold` sessions from entry on whose low reaches the stop or whose high reaches the target.

    The stop wins a tie within a bar; fills are at the level; without a touch the exit is at the next open after the
    last session held, else unresolved. The join is equi on instrument with a bounded range of ordinals: every entry
    is put out as its `hold` ordinals first, so that it is an equi join on (instrument, ordinal).
    """
    entry = grid.select("instrument_id", (F.col("sidx") - 1).alias("sidx"), F.col("open").alias("entry_open"))
    after = grid.select("instrument_id", (F.col("sidx") - 1 - hold).alias("sidx"), F.col("open").alias("time_open"))
    e = picks.select("instrument_id", "sidx").join(entry.where("entry_open > 0"), ["instrument_id", "sidx"])
    e = e.withColumns({"stop": F.col("entry_open") * (1 - stop_pct / 100), "target": F.col("entry_open") * (1 + target_pct / 100)})
    path = e.withColumn("at", F.explode(F.sequence(F.col("sidx") + 1, F.col("sidx") + hold)))
    bars = grid.where("high is not null and low is not null").select("instrument_id", F.col("sidx").alias("at"), "high", "low")
    hit = path.join(bars, ["instrument_id", "at"]).where("low <= stop or high >= target")
    first = hit.groupBy("instrument_id", "sidx").agg(F.min_by(F.struct("at", (F.col("low") <= F.col("stop")).alias("stopped")), "at").alias("h"))
    out = e.join(first, ["instrument_id", "sidx"], "left").join(after, ["instrument_id", "sidx"], "left")
    reason = F.when(F.col("h.stopped"), "stop").when(F.col("h.at").isNotNull(), "target").when(F.col("time_open") > 0, "time").otherwise("unresolved")
    price = F.when(F.col("h.stopped"), F.col("stop")).when(F.col("h.at").isNotNull(), F.col("target")).when(F.col("time_open") > 0, F.col("time_open"))
    at = F.when(F.col("h.at").isNotNull(), F.col("h.at")).when(F.col("time_open") > 0, F.col("sidx") + 1 + hold)
    return out.select("instrument_id", "sidx", "entry_open", reason.alias("exit_reason"), at.alias("exit_sidx"), F.round((price / F.col("entry_open") - 1) * 100, 6).alias("gross_pct"))


def first_touch_grid(picks: DataFrame, grid: DataFrame, holds: list[int], stops: list[float], rewards: list[float]) -> DataFrame:
    """first_touch for every cell of hold x stop x reward (target = stop x reward, in percent): a row per pick and cell
    with hold, stop_pct, rr, exit_reason and gross_pct.

    A pick's path is joined once, up to the longest hold, and reduced to the first touch of each level; the cells are
    then told from those, so neither joins nor rows of the path grow with their number.
    """
    most = max(holds)
    entry = grid.where("open > 0").select("instrument_id", (F.col("sidx") - 1).alias("sidx"), F.col("open").alias("entry_open"))
    e = picks.select("instrument_id", "sidx").join(entry, ["instrument_id", "sidx"])
    path = e.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most + 1)))).withColumn("at", F.col("sidx") + F.col("k"))
    bars = grid.select("instrument_id", F.col("sidx").alias("at"), "open", "high", "low")
    seen = path.join(bars, ["instrument_id", "at"], "left")
    both = F.col("high").isNotNull() & F.col("low").isNotNull()
    pairs = [(s, r) for s in stops for r in rewards]
    first = lambda hit: F.min(F.when(both & hit, F.col("k")))
    reduced = seen.groupBy("instrument_id", "sidx", "entry_open").agg(
        F.array(*[first(F.col("low") <= F.col("entry_open") * F.lit(1 - s / 100)) for s in stops]).alias("s"),
        F.array(*[first(F.col("high") >= F.col("entry_open") * F.lit(1 + s * r / 100)) for s, r in pairs]).alias("t"),
        F.array(*[F.max(F.when((F.col("k") == h + 1) & (F.col("open") > 0), F.col("open"))) for h in holds]).alias("o"),
    )
    # a cell's parameters and first touches are looked up by its number: written out, the cells outgrow generated code
    cell = F.explode(F.sequence(F.lit(0), F.lit(len(holds) * len(pairs) - 1)))
    pair, hold = F.col("cell") % len(pairs), F.expr(f"cell div {len(pairs)}").cast("int")
    given = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i)
    c = reduced.withColumn("cell", cell).select(
        "instrument_id", "sidx", "entry_open", given(holds, hold).alias("hold"), F.get("o", hold).alias("late"),
        given([float(s) for s, _ in pairs], pair).alias("stop_pct"), given([float(r) for _, r in pairs], pair).alias("rr"),
        F.get("s", F.expr(f"cell % {len(pairs)} div {len(rewards)}").cast("int")).alias("stop"), F.get("t", pair).alias("target"),
        (F.col("entry_open") * given([1 - s / 100 for s, _ in pairs], pair)).alias("stop_at"),
        (F.col("entry_open") * given([1 + s * r / 100 for s, r in pairs], pair)).alias("target_at"),
    )
    stopped = (F.col("stop") <= F.col("hold")) & (F.col("target").isNull() | (F.col("stop") <= F.col("target")))
    hit = F.col("target") <= F.col("hold")
    reason = F.when(stopped, "stop").when(hit, "target").when(F.col("late").isNotNull(), "time").otherwise("unresolved")
    price = F.when(stopped, F.col("stop_at")).when(hit, F.col("target_at")).otherwise(F.col("late"))
    gross = F.round((price / F.col("entry_open") - 1) * 100, 6)
    return c.select("instrument_id", "sidx", "hold", "stop_pct", "rr", reason.alias("exit_reason"), gross.alias("gross_pct"))


def non_overlapping(trades: DataFrame) -> DataFrame:
    """Trades (instrument_id, sidx, exit_sidx or null) that start at or after the exit of the last one taken.

    A trade without an exit blocks all later ones. A fold over each instrument's trades in order holds the exit of the
    last one taken and nothing else.
    """
    return not_overlapping(trades, ["instrument_id"], "sidx", "exit_sidx", ["sidx"])


def excursions(picks: DataFrame, grid: DataFrame, horizon: int) -> DataFrame:
    """Lowest low and highest high from entry to the last full session held, against the entry open, in percent."""
    entry = grid.where("open > 0").select("instrument_id", (F.col("sidx") - 1).alias("sidx"), F.col("open").alias("entry_open"))
    path = picks.select("instrument_id", "sidx").join(entry, ["instrument_id", "sidx"])
    path = path.withColumn("at", F.explode(F.sequence(F.col("sidx") + 1, F.col("sidx") + horizon)))
    bars = grid.select("instrument_id", F.col("sidx").alias("at"), "high", "low")
    g = path.join(bars, ["instrument_id", "at"]).groupBy("instrument_id", "sidx", "entry_open")
    return g.agg(F.round((F.min("low") / F.col("entry_open") - 1) * 100, 6).alias("mae_pct"), F.round((F.max("high") / F.col("entry_open") - 1) * 100, 6).alias("mfe_pct"))


def by_instrument(*order: str):
    return Window.partitionBy("instrument_id").orderBy(*(order or ("sidx",)))
