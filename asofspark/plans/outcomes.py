"""Queries of outcome labels, trade statistics and benchmark joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import labels
from .features import BREADTH, breadth
from ..operators.ranks import with_counts_before
from .registry import query

R6 = lambda c, name: F.round(c, 6).alias(name)
cnt = lambda cond: F.count_if(F.expr(cond))


@query("jn_fixed_horizon_outcome", "SELECT * FROM outcomes")
def jn_fixed_horizon_outcome(v):
    return v.outcomes


@query("flagship_momentum_economics", """WITH mo AS (SELECT instrument_id, session, sidx, round(CASE WHEN lag(close, 56) OVER w > 0 THEN lag(close, 4) OVER w / lag(close, 56) OVER w - 1 END, 9) AS ret FROM grid_w WINDOW w AS (PARTITION BY instrument_id ORDER BY sidx)),
top AS (SELECT instrument_id, session, sidx FROM mo WHERE ret IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sidx ORDER BY ret DESC, instrument_id) <= greatest(1, ceil(count(*) OVER (PARTITION BY sidx) * 0.2)))
SELECT o.session, count(*) AS n, round(avg(net_pct), 8) AS mean_net, round(avg(excess_pct), 8) AS mean_excess FROM (SELECT t.session, x.open / e.open, round((x.open / e.open - 1) * 100 - 0.25, 6) AS net_pct, round((x.open / e.open - 1) * 100 - 0.25 - (bx.bench / be.bench - 1) * 100, 6) AS excess_pct
  FROM top t JOIN grid_w e ON e.instrument_id = t.instrument_id AND e.sidx = t.sidx + 1 JOIN grid_w x ON x.instrument_id = t.instrument_id AND x.sidx = t.sidx + 5 JOIN bench_w be ON be.session = e.session JOIN bench_w bx ON bx.session = x.session WHERE e.open > 0 AND x.open > 0) o GROUP BY o.session""")
def flagship_momentum_economics(v):
    o = v.outcomes.where("status = 'RESOLVED'")
    return o.groupBy("session").agg(F.count("*").alias("n"), F.round(F.avg("net_pct"), 8).alias("mean_net"), F.round(F.avg("excess_pct"), 8).alias("mean_excess"))


@query("jn_session_outcome", """SELECT o.instrument_id, o.sidx, CASE WHEN o.sidx + 1 < f.a THEN 'NOT_LISTED' WHEN o.sidx + 1 > f.b THEN 'TERMINATED' WHEN o.status = 'MISSING_ENTRY' THEN 'SUSPENDED_AT_ENTRY' WHEN o.status = 'RESOLVED' AND o.bench_pct IS NULL THEN 'MISSING_BENCHMARK' ELSE o.status END AS status
FROM outcomes o JOIN (SELECT instrument_id, min(sidx) AS a, max(sidx) AS b FROM grid_w WHERE close IS NOT NULL GROUP BY 1) f USING (instrument_id)""")
def jn_session_outcome(v):
    span = v.grid_w.where("close is not null").groupBy("instrument_id").agg(F.min("sidx").alias("a"), F.max("sidx").alias("b"))
    status = (
        F.when(F.expr("sidx + 1 < a"), "NOT_LISTED").when(F.expr("sidx + 1 > b"), "TERMINATED").when(F.expr("status = 'MISSING_ENTRY'"), "SUSPENDED_AT_ENTRY")
        .when(F.expr("status = 'RESOLVED' and bench_pct is null"), "MISSING_BENCHMARK").otherwise(F.col("status"))
    )
    return v.outcomes.join(span, "instrument_id").select("instrument_id", "sidx", status.alias("status"))


FT = """ent AS (SELECT p.instrument_id, p.sidx, e.open AS entry_open, e.open * (1 - {s} / 100.0::DOUBLE) AS stop, e.open * (1 + {t} / 100.0::DOUBLE) AS target FROM {src} p JOIN grid_w e ON e.instrument_id = p.instrument_id AND e.sidx = p.sidx + 1 WHERE e.open > 0),
hit AS (SELECT e.instrument_id, e.sidx, min(g.sidx) AS at, arg_min(g.low <= e.stop, g.sidx) AS stopped FROM ent e JOIN grid_w g ON g.instrument_id = e.instrument_id AND g.sidx BETWEEN e.sidx + 1 AND e.sidx + {h} WHERE g.low <= e.stop OR g.high >= e.target GROUP BY 1, 2),
ft AS (SELECT e.instrument_id, e.sidx, e.entry_open, CASE WHEN h.stopped THEN 'stop' WHEN h.at IS NOT NULL THEN 'target' WHEN x.open > 0 THEN 'time' ELSE 'unresolved' END AS exit_reason,
  CASE WHEN h.at IS NOT NULL THEN h.at WHEN x.open > 0 THEN e.sidx + 1 + {h} END AS exit_sidx,
  round((CASE WHEN h.stopped THEN e.stop WHEN h.at IS NOT NULL THEN e.target WHEN x.open > 0 THEN x.open END / e.entry_open - 1) * 100, 6) AS gross_pct
  FROM ent e LEFT JOIN hit h USING (instrument_id, sidx) LEFT JOIN grid_w x ON x.instrument_id = e.instrument_id AND x.sidx = e.sidx + 1 + {h})"""


def ft_sql(h=6, s=10, t=20, src="picks"):
    return FT.format(h=h, s=s, t=t, src=src)


def touched(v, h=6, s=10.0, t=20.0):
    return labels.first_touch(v.picks, v.grid_w, h, s, t)


@query("jn_first_touch", f"WITH {ft_sql()} SELECT instrument_id, sidx, entry_open, exit_reason, exit_sidx, gross_pct FROM ft")
def jn_first_touch(v):
    return touched(v)


@query("jn_same_bar_entry", """SELECT p.instrument_id, p.sidx, b.close AS entry_close, x.close AS exit_close, round((x.close / b.close - 1) * 100, 6) AS gross_pct FROM picks p JOIN grid_w b ON b.instrument_id = p.instrument_id AND b.sidx = p.sidx AND b.close > 0 LEFT JOIN grid_w x ON x.instrument_id = p.instrument_id AND x.sidx = p.sidx + 4""")
def jn_same_bar_entry(v):
    g = v.grid_w.select("instrument_id", "sidx", "close")
    entry = v.picks.join(g.where("close > 0").withColumnRenamed("close", "entry_close"), ["instrument_id", "sidx"])
    leave = g.select("instrument_id", (F.col("sidx") - 4).alias("sidx"), F.col("close").alias("exit_close"))
    return entry.join(leave, ["instrument_id", "sidx"], "left").select("instrument_id", "sidx", "entry_close", "exit_close", R6((F.col("exit_close") / F.col("entry_close") - 1) * 100, "gross_pct"))


@query("wn_non_overlap", f"""WITH RECURSIVE {ft_sql()}, nx AS (SELECT instrument_id, sidx, coalesce(exit_sidx, 1073741824) AS ex FROM ft),
r AS (SELECT instrument_id, min(sidx) AS sidx FROM nx GROUP BY 1 UNION ALL SELECT r.instrument_id, (SELECT min(n.sidx) FROM nx n WHERE n.instrument_id = r.instrument_id AND n.sidx > r.sidx AND n.sidx >= c.ex) FROM r JOIN nx c ON c.instrument_id = r.instrument_id AND c.sidx = r.sidx WHERE r.sidx IS NOT NULL)
SELECT instrument_id, sidx FROM r WHERE sidx IS NOT NULL""")
def wn_non_overlap(v):
    return labels.non_overlapping(touched(v))


@query("wn_mae_mfe", """SELECT p.instrument_id, p.sidx, round((min(g.low) / e.open - 1) * 100, 6) AS mae_pct, round((max(g.high) / e.open - 1) * 100, 6) AS mfe_pct FROM picks p JOIN grid_w e ON e.instrument_id = p.instrument_id AND e.sidx = p.sidx + 1 AND e.open > 0 JOIN grid_w g ON g.instrument_id = p.instrument_id AND g.sidx BETWEEN p.sidx + 1 AND p.sidx + 4 GROUP BY p.instrument_id, p.sidx, e.open""")
def wn_mae_mfe(v):
    return labels.excursions(v.picks, v.grid_w, 4).select("instrument_id", "sidx", "mae_pct", "mfe_pct")


EXIT_GRID = """ce AS (SELECT h, s::DOUBLE AS s, rr FROM (VALUES (4), (8), (12), (16), (20)) a(h), (VALUES (3), (5), (8), (10), (15)) b(s), (VALUES (1.0::DOUBLE), (1.5), (2.0), (2.5), (3.0)) c(rr)),
en AS (SELECT p.instrument_id, p.sidx, e.open AS entry_open FROM picks p JOIN grid_w e ON e.instrument_id = p.instrument_id AND e.sidx = p.sidx + 1 WHERE e.open > 0),
lv AS (SELECT en.*, h, s, rr, entry_open * (1 - s / 100) AS stop, entry_open * (1 + s * rr / 100) AS target FROM en, ce),
hi AS (SELECT v.instrument_id, v.sidx, h, s, rr, arg_min(b.low <= stop, b.sidx) AS stopped FROM lv v JOIN grid_w b ON b.instrument_id = v.instrument_id AND b.sidx BETWEEN v.sidx + 1 AND v.sidx + h WHERE b.high IS NOT NULL AND b.low IS NOT NULL AND (b.low <= stop OR b.high >= target) GROUP BY ALL),
gr AS (SELECT v.h, v.s, v.rr, CASE WHEN stopped THEN 'stop' WHEN stopped IS NOT NULL THEN 'target' WHEN x.open > 0 THEN 'time' ELSE 'unresolved' END AS reason, round((CASE WHEN stopped THEN stop WHEN stopped IS NOT NULL THEN target WHEN x.open > 0 THEN x.open END / entry_open - 1) * 100, 6) AS gross
  FROM lv v LEFT JOIN hi ON hi.instrument_id = v.instrument_id AND hi.sidx = v.sidx AND hi.h = v.h AND hi.s = v.s AND hi.rr = v.rr LEFT JOIN grid_w x ON x.instrument_id = v.instrument_id AND x.sidx = v.sidx + 1 + v.h)"""


@query("ag_exit_grid", f"WITH {EXIT_GRID} SELECT h AS hold, s AS stop_pct, rr, count(*) AS n, round(avg(gross), 4) AS mean_gross, count(*) FILTER (WHERE reason = 'stop') AS stops, count(*) FILTER (WHERE reason = 'target') AS targets FROM gr GROUP BY 1, 2, 3")
def ag_exit_grid(v):
    """All 125 cells from one path join."""
    out = labels.first_touch_grid(v.picks, v.grid_w, [4, 8, 12, 16, 20], [3.0, 5.0, 8.0, 10.0, 15.0], [1.0, 1.5, 2.0, 2.5, 3.0])
    return out.groupBy("hold", "stop_pct", "rr").agg(F.count("*").alias("n"), F.round(F.avg("gross_pct"), 4).alias("mean_gross"), cnt("exit_reason = 'stop'").alias("stops"), cnt("exit_reason = 'target'").alias("targets"))


@query("jn_benchmark_window", "SELECT t.instrument_id, t.sidx, round(t.net_pct - (bx.bench / be.bench - 1) * 100, 6) AS excess FROM trades t JOIN bench_w be ON be.session = t.entry_session JOIN bench_w bx ON bx.session = t.exit_session WHERE t.net_pct IS NOT NULL")
def jn_benchmark_window(v):
    b = lambda k: v.bench_w.select(F.col("session").alias(f"{k}_session"), F.col("bench").alias(k))
    t = v.trades.where("net_pct is not null").join(b("entry"), "entry_session").join(b("exit"), "exit_session")
    return t.select("instrument_id", "sidx", R6(F.col("net_pct") - (F.col("exit") / F.col("entry") - 1) * 100, "excess"))


PEER = """pr AS (SELECT t.instrument_id, t.sidx, avg((x.close / e.close - 1) * 100) AS peer_pct FROM trades t JOIN sector s ON s.instrument_id = t.instrument_id JOIN sector o ON o.sector_id = s.sector_id AND o.instrument_id <> s.instrument_id
JOIN bars_w e ON e.instrument_id = o.instrument_id AND e.session = t.entry_session JOIN bars_w x ON x.instrument_id = o.instrument_id AND x.session = t.exit_session WHERE t.net_pct IS NOT NULL GROUP BY 1, 2)"""


def sector_peers(v):
    """Peers' mean return by sums over the sector less the own one: no pairs of peers are formed."""
    moves = v.trades.where("net_pct is not null").select("entry_session", "exit_session").distinct()
    e = v.bars_w.select("instrument_id", F.col("session").alias("entry_session"), F.col("close").alias("c0"))
    x = v.bars_w.select("instrument_id", F.col("session").alias("exit_session"), F.col("close").alias("c1"))
    m = e.join(moves, "entry_session").join(x, ["instrument_id", "exit_session"]).withColumn("m", (F.col("c1") / F.col("c0") - 1) * 100).join(v.sector, "instrument_id")
    sums = m.groupBy("sector_id", "entry_session", "exit_session").agg(F.sum("m").alias("s"), F.count("*").alias("n"))
    t = v.trades.where("net_pct is not null").join(v.sector, "instrument_id").join(sums, ["sector_id", "entry_session", "exit_session"])
    t = t.join(m.select("instrument_id", "entry_session", "exit_session", "m"), ["instrument_id", "entry_session", "exit_session"], "left")
    own = F.when(F.col("m").isNull(), 0).otherwise(1)
    return t.where(F.col("n") > own).withColumn("peer_pct", (F.col("s") - F.coalesce("m", F.lit(0.0))) / (F.col("n") - own))


@query("jn_sector_peer_window", f"WITH {PEER} SELECT instrument_id, sidx, round(peer_pct, 4) AS peer_pct FROM pr")
def jn_sector_peer_window(v):
    return sector_peers(v).select("instrument_id", "sidx", F.round("peer_pct", 4).alias("peer_pct"))


@query("ag_trade_summary", """SELECT count(*) AS n, sum((net_pct IS NOT NULL)::INT)::BIGINT AS resolved, sum((exit_reason = 'unresolved')::INT)::BIGINT AS unresolved, round(avg(net_pct), 6) AS mean_net, round(median(net_pct), 6) AS median_net, round(stddev_samp(net_pct), 6) AS std_net,
round(100.0 * sum((net_pct > 0)::INT) / count(net_pct), 6) AS win_pct, sum((exit_reason = 'target')::INT)::BIGINT AS targets, sum((exit_reason = 'stop')::INT)::BIGINT AS stops, sum((exit_reason = 'expiry')::INT)::BIGINT AS expiries, round(avg(held_days), 6) AS mean_held, round(avg(cost_pct), 6) AS mean_cost FROM trades""")
def ag_trade_summary(v):
    return v.trades.agg(
        F.count("*").alias("n"), F.count("net_pct").alias("resolved"), cnt("exit_reason = 'unresolved'").alias("unresolved"), R6(F.avg("net_pct"), "mean_net"), R6(F.median("net_pct"), "median_net"), R6(F.stddev_samp("net_pct"), "std_net"),
        R6(F.lit(100.0) * cnt("net_pct > 0") / F.count("net_pct"), "win_pct"), cnt("exit_reason = 'target'").alias("targets"), cnt("exit_reason = 'stop'").alias("stops"), cnt("exit_reason = 'expiry'").alias("expiries"), R6(F.avg("held_days"), "mean_held"), R6(F.avg("cost_pct"), "mean_cost"),
    )


def t_of_means(df, value, bucket, keys=()):
    """One-sample t of the means of buckets: the buckets do not overlap, their members may."""
    m = df.where(F.col(value).isNotNull()).groupBy(*keys, bucket.alias("_b")).agg(F.avg(value).alias("m"))
    t = F.try_divide(F.avg("m"), F.try_divide(F.stddev_samp("m"), F.sqrt(F.count("*"))))
    return m.groupBy(*keys).agg(F.count("*").alias("buckets"), F.round(t, 4).alias("t"))


@query("ag_week_tstat", "WITH m AS (SELECT date_trunc('week', entry_session) AS b, avg(net_pct) AS m FROM trades WHERE net_pct IS NOT NULL GROUP BY 1) SELECT count(*) AS buckets, round(avg(m) / (stddev_samp(m) / sqrt(count(*))), 4) AS t FROM m")
def ag_week_tstat(v):
    return t_of_means(v.trades, "net_pct", F.date_trunc("week", "entry_session"))


@query("ag_capital_day_edge", "SELECT round(avg(net_pct) / avg(held_days), 6) AS edge FROM trades WHERE net_pct IS NOT NULL")
def ag_capital_day_edge(v):
    return v.trades.where("net_pct is not null").agg(R6(F.avg("net_pct") / F.avg("held_days"), "edge"))


@query("ag_trade_economics", "SELECT round(avg(CASE WHEN net_pct > 0 THEN net_pct END), 6) AS avg_winner, round(avg(CASE WHEN net_pct <= 0 THEN net_pct END), 6) AS avg_loser, round(sum(CASE WHEN net_pct > 0 THEN net_pct END) / -sum(CASE WHEN net_pct <= 0 THEN net_pct END), 4) AS profit_factor, round(avg(gross_pct), 6) AS gross_exp, round(avg(net_pct), 6) AS net_exp, round(sum(cost_pct) / sum(abs(gross_pct)), 6) AS cost_share FROM trades WHERE net_pct IS NOT NULL")
def ag_trade_economics(v):
    won, lost = F.when(F.col("net_pct") > 0, F.col("net_pct")), F.when(F.col("net_pct") <= 0, F.col("net_pct"))
    return v.trades.where("net_pct is not null").agg(R6(F.avg(won), "avg_winner"), R6(F.avg(lost), "avg_loser"), F.round(F.sum(won) / -F.sum(lost), 4).alias("profit_factor"), R6(F.avg("gross_pct"), "gross_exp"), R6(F.avg("net_pct"), "net_exp"), R6(F.sum("cost_pct") / F.sum(F.abs("gross_pct")), "cost_share"))


PERF = "SELECT instrument_id, count(*) AS n, round(avg(net_pct), 6) AS mean_net, round(sum(net_pct), 6) AS total_net, round(100.0 * avg((net_pct > 0)::INT), 6) AS win_pct FROM trades WHERE net_pct IS NOT NULL AND session >= DATE '1996-01-01' GROUP BY 1 HAVING count(*) >= 5"


def performance(df, key="instrument_id", value="net_pct", least=5):
    g = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), R6(F.avg(value), "mean_net"), F.round(F.sum(value), 6).alias("total_net"), R6(F.avg((F.col(value) > 0).cast("double")) * 100, "win_pct"))
    return g.where(F.col("n") >= least)


@query("ag_symbol_performance", PERF)
def ag_symbol_performance(v):
    return performance(v.trades.where("session >= date '1996-01-01'"))


def legs(v):
    t = v.trades.where("net_pct is not null")
    return t.select("instrument_id", "net_pct", F.lit("long").alias("leg")).unionByName(t.select(((F.col("instrument_id") + 1) % 25).alias("instrument_id"), (-F.col("net_pct")).alias("net_pct"), F.lit("short").alias("leg")))


LEGS = "lg AS (SELECT instrument_id, net_pct, 'long' AS leg FROM trades WHERE net_pct IS NOT NULL UNION ALL SELECT (instrument_id + 1) % 25, -net_pct, 'short' FROM trades WHERE net_pct IS NOT NULL)"


@query("so_leg_union", f"WITH {LEGS} SELECT * FROM lg")
def so_leg_union(v):
    return legs(v)


@query("ag_symbol_legs", f"WITH {LEGS} SELECT instrument_id, count(*) AS n, round(avg(net_pct), 6) AS mean_net, round(sum(net_pct), 6) AS total_net, round(100.0 * avg((net_pct > 0)::INT), 6) AS win_pct FROM lg GROUP BY 1 HAVING count(*) >= 5")
def ag_symbol_legs(v):
    return performance(legs(v))


@query("ag_sector_breakdown", "WITH t AS (SELECT sector_id, net_pct, date_trunc('week', entry_session) AS b FROM trades JOIN sector USING (instrument_id) WHERE net_pct IS NOT NULL), m AS (SELECT sector_id, b, avg(net_pct) AS m FROM t GROUP BY 1, 2), w AS (SELECT sector_id, count(*) AS buckets, round(avg(m) / (stddev_samp(m) / sqrt(count(*))), 4) AS t FROM m GROUP BY 1) SELECT sector_id, count(*) AS n, round(avg(net_pct), 6) AS mean_net, round(100.0 * avg((net_pct > 0)::INT), 6) AS win_pct, any_value(w.buckets) AS buckets, any_value(w.t) AS t FROM t JOIN w USING (sector_id) GROUP BY 1")
def ag_sector_breakdown(v):
    t = v.trades.join(v.sector, "instrument_id").where("net_pct is not null")
    stats = performance(t, "sector_id", least=0).drop("total_net")
    return stats.join(t_of_means(t, "net_pct", F.date_trunc("week", "entry_session"), ("sector_id",)), "sector_id")


@query("jn_split_merge", "WITH x AS (SELECT sector_id, round(avg(net_pct) FILTER (WHERE session < DATE '1999-01-01'), 6) AS train, round(avg(net_pct) FILTER (WHERE session >= DATE '1999-01-01'), 6) AS valid FROM trades JOIN sector USING (instrument_id) GROUP BY 1) SELECT *, sign(train) = sign(valid) AS same_sign FROM x")
def jn_split_merge(v):
    t = v.trades.join(v.sector, "instrument_id")
    part = lambda cond, name: t.where(cond).groupBy("sector_id").agg(R6(F.avg("net_pct"), name))
    j = part("session < date '1999-01-01'", "train").join(part("session >= date '1999-01-01'", "valid"), "sector_id")
    return j.withColumn("same_sign", F.signum("train") == F.signum("valid"))


@query("ag_holding_period", "SELECT k * 4 AS sessions, count(*) AS n, round(avg((x.close / e.open - 1) * 100), 4) AS mean_ret FROM picks p JOIN grid_w e ON e.instrument_id = p.instrument_id AND e.sidx = p.sidx + 1 CROSS JOIN range(1, 13) r(k) JOIN grid_w x ON x.instrument_id = p.instrument_id AND x.sidx = p.sidx + 1 + k * 4 WHERE e.open > 0 AND x.close > 0 GROUP BY k")
def ag_holding_period(v):
    e = v.picks.join(v.grid_w.select("instrument_id", (F.col("sidx") - 1).alias("sidx"), "open"), ["instrument_id", "sidx"]).where("open > 0")
    at = e.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("at", F.expr("sidx + 1 + k * 4"))
    x = v.grid_w.where("close > 0").select("instrument_id", F.col("sidx").alias("at"), "close")
    return at.join(x, ["instrument_id", "at"]).groupBy((F.col("k") * 4).alias("sessions")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("close") / F.col("open") - 1) * 100), 4).alias("mean_ret"))


@query("ag_economic_report", "SELECT status, count(*) AS n, round(avg(gross_pct), 6) AS gross, round(avg(cost_pct), 6) AS cost, round(avg(net_pct), 6) AS net, round(avg(bench_pct), 6) AS bench, round(avg(excess_pct), 6) AS excess, round(avg(net_pct) + 0.1, 6) AS net_0bps, round(avg(net_pct) - 0.1, 6) AS net_10bps FROM outcomes GROUP BY status")
def ag_economic_report(v):
    means = [R6(F.avg(f"{c}_pct"), c) for c in ("gross", "cost", "net", "bench", "excess")]
    return v.outcomes.groupBy("status").agg(F.count("*").alias("n"), *means, R6(F.avg("net_pct") + 0.1, "net_0bps"), R6(F.avg("net_pct") - 0.1, "net_10bps"))


@query("ag_tail_contribution", """WITH t AS (SELECT net_pct, row_number() OVER (ORDER BY net_pct, instrument_id, sidx) AS r, count(*) OVER () AS n FROM trades WHERE net_pct IS NOT NULL)
SELECT count(*) AS n, round(avg(net_pct), 6) AS mean, round(median(net_pct), 6) AS median, round(stddev_samp(net_pct), 6) AS std, round(100.0 * avg((net_pct > 0)::INT), 6) AS positive_pct, round(avg(net_pct) FILTER (WHERE r > n - ceil(n * 0.05)), 6) AS top5, round(avg(net_pct) FILTER (WHERE r <= ceil(n * 0.05)), 6) AS bottom5, round(avg(net_pct) FILTER (WHERE r > ceil(n * 0.05) AND r <= n - ceil(n * 0.05)), 6) AS middle90 FROM t""")
def ag_tail_contribution(v):
    """Tails by rank: counts per value are summed in order of value, by range partitions, and a value at a cut counts
    with the part of its rows that lies within."""
    t = v.trades.where("net_pct is not null").select("net_pct")
    by = with_counts_before(t.groupBy("net_pct").agg(F.count("*").alias("c")), ["net_pct"], F.col("c"))
    by = by.select("net_pct", F.col("before").alias("lo"), (F.col("before") + F.col("c")).alias("hi"), F.col("total").alias("n"))
    k = F.ceil(F.col("n") * 0.05)
    part = lambda a, b: F.greatest(F.lit(0), F.least("hi", b) - F.greatest("lo", a))
    by = by.withColumns({"bot": part(F.lit(0), k), "top": part(F.col("n") - k, F.col("n")), "mid": part(k, F.col("n") - k)})
    mean = lambda c, name: R6(F.sum(F.col("net_pct") * F.col(c)) / F.sum(c), name)
    tails = by.agg(mean("top", "top5"), mean("bot", "bottom5"), mean("mid", "middle90"))
    whole = t.agg(F.count("*").alias("n"), R6(F.avg("net_pct"), "mean"), R6(F.median("net_pct"), "median"), R6(F.stddev_samp("net_pct"), "std"), R6(F.avg((F.col("net_pct") > 0).cast("double")) * 100, "positive_pct"))
    return whole.crossJoin(tails)  # one row each


REGIME = "rg AS (SELECT session, CASE WHEN m IS NULL THEN 'unknown' WHEN bench > m * 1.02 THEN 'bull' WHEN bench < m * 0.98 THEN 'bear' ELSE 'sideways' END AS regime FROM (SELECT session, bench, CASE WHEN count(*) OVER w >= 10 THEN avg(bench) OVER w END AS m FROM bench_w WINDOW w AS (ORDER BY session ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)))"


def regimes(v):
    w = Window.orderBy("session").rowsBetween(-25, 0)  # one row per session
    b = v.bench_w.withColumn("m", F.when(F.count("*").over(w) >= 10, F.avg("bench").over(w)))
    return b.select("session", F.when(F.col("m").isNull(), "unknown").when(F.expr("bench > m * 1.02"), "bull").when(F.expr("bench < m * 0.98"), "bear").otherwise("sideways").alias("regime"))


@query("px_regime_bucket", f"WITH {REGIME} SELECT session, regime FROM rg")
def px_regime_bucket(v):
    return regimes(v)


@query("jn_regime_gate", f"WITH {REGIME} SELECT p.instrument_id, p.sidx FROM picks p JOIN rg USING (session) WHERE regime = 'bull'")
def jn_regime_gate(v):
    return v.picks.join(regimes(v).where("regime = 'bull'"), "session", "left_semi").select("instrument_id", "sidx")


@query("ag_trade_context", f"WITH {PEER}, {REGIME}, {BREADTH} SELECT t.instrument_id, rg.regime, count(*) AS n, round(avg(net_pct), 4) AS own, round(avg(bench_pct), 4) AS bench, round(avg(peer_pct), 4) AS peers, round(100.0 * avg((excess_pct > 0)::INT), 4) AS beats_pct, round(avg(breadth), 4) AS breadth FROM trades t LEFT JOIN pr USING (instrument_id, sidx) JOIN rg ON rg.session = t.entry_session LEFT JOIN br ON br.sidx = t.sidx WHERE net_pct IS NOT NULL GROUP BY 1, 2")
def ag_trade_context(v):
    t = v.trades.where("net_pct is not null").join(sector_peers(v).select("instrument_id", "sidx", "peer_pct"), ["instrument_id", "sidx"], "left")
    t = t.join(regimes(v).withColumnRenamed("session", "entry_session"), "entry_session").join(breadth(v), "sidx", "left")
    r4 = lambda c, n: F.round(F.avg(c), 4).alias(n)
    # sums of six-digit numbers are exact, so that a mean halfway between two roundings does not hang on their order
    exact = lambda c, n: F.round(F.sum(F.col(c).cast("decimal(18,6)")).cast("double") / F.count(c), 4).alias(n)
    return t.groupBy("instrument_id", "regime").agg(F.count("*").alias("n"), exact("net_pct", "own"), exact("bench_pct", "bench"), r4("peer_pct", "peers"), F.round(F.avg((F.col("excess_pct") > 0).cast("double")) * 100, 4).alias("beats_pct"), r4("breadth", "breadth"))


@query("ag_buy_hold_span", "WITH s AS (SELECT instrument_id, min(entry_session) AS a, max(exit_session) AS b FROM trades WHERE net_pct IS NOT NULL GROUP BY 1) SELECT s.instrument_id, a AS first_entry, b AS last_exit, round((x.open / e.open - 1) * 100, 6) AS hold_pct, round((bx.bench / be.bench - 1) * 100, 6) AS bench_pct FROM s JOIN bars_w e ON e.instrument_id = s.instrument_id AND e.session = a JOIN bars_w x ON x.instrument_id = s.instrument_id AND x.session = b JOIN bench_w be ON be.session = a JOIN bench_w bx ON bx.session = b")
def ag_buy_hold_span(v):
    s = v.trades.where("net_pct is not null").groupBy("instrument_id").agg(F.min("entry_session").alias("first_entry"), F.max("exit_session").alias("last_exit"))
    bar = lambda at, name: v.bars_w.select("instrument_id", F.col("session").alias(at), F.col("open").alias(name))
    b = lambda at, name: v.bench_w.select(F.col("session").alias(at), F.col("bench").alias(name))
    s = s.join(bar("first_entry", "o0"), ["instrument_id", "first_entry"]).join(bar("last_exit", "o1"), ["instrument_id", "last_exit"]).join(b("first_entry", "b0"), "first_entry").join(b("last_exit", "b1"), "last_exit")
    return s.select("instrument_id", "first_entry", "last_exit", R6((F.col("o1") / F.col("o0") - 1) * 100, "hold_pct"), R6((F.col("b1") / F.col("b0") - 1) * 100, "bench_pct"))


@query("ag_short_approx", "SELECT p.instrument_id, p.sidx, round(-(x.close / e.close - 1) * 100, 6) AS short_pct FROM picks p JOIN grid_w e ON e.instrument_id = p.instrument_id AND e.sidx = p.sidx + 1 JOIN grid_w x ON x.instrument_id = p.instrument_id AND x.sidx = least(p.sidx + 1 + 4, (SELECT max(sidx) FROM cal_w)) WHERE e.close > 0 AND x.close > 0")
def ag_short_approx(v):
    g = v.grid_w.where("close > 0").select("instrument_id", "sidx", "close")
    e = v.picks.join(g.select("instrument_id", (F.col("sidx") - 1).alias("sidx"), F.col("close").alias("c0")), ["instrument_id", "sidx"])
    e = e.crossJoin(F.broadcast(v.cal_w.agg(F.max("sidx").alias("last")))).withColumn("at", F.least(F.col("sidx") + 5, F.col("last")))
    return e.join(g.select("instrument_id", F.col("sidx").alias("at"), F.col("close").alias("c1")), ["instrument_id", "at"]).select("instrument_id", "sidx", R6(-(F.col("c1") / F.col("c0") - 1) * 100, "short_pct"))


@query("tk_best_worst", f"WITH p AS ({PERF}), r AS (SELECT *, row_number() OVER (ORDER BY mean_net DESC, instrument_id) AS best, row_number() OVER (ORDER BY mean_net, instrument_id) AS worst FROM p) SELECT instrument_id, mean_net, best <= 5 AS is_best FROM r WHERE best <= 5 OR worst <= 5")
def tk_best_worst(v):
    p = performance(v.trades.where("session >= date '1996-01-01'")).select("instrument_id", "mean_net")
    top = p.orderBy(F.desc("mean_net"), "instrument_id").limit(5).withColumn("is_best", F.lit(True))
    low = p.orderBy("mean_net", "instrument_id").limit(5).withColumn("is_best", F.lit(False))
    return top.unionByName(low).groupBy("instrument_id", "mean_net").agg(F.max("is_best").alias("is_best"))


CURVE = "eq AS (SELECT session, exp(sum(ln(1 + m / 100)) OVER (ORDER BY session)) AS equity, m FROM (SELECT session, avg(net_pct) / 2000 AS m FROM trades WHERE net_pct IS NOT NULL GROUP BY 1))"


def curve(v):
    m = v.trades.where("net_pct is not null").groupBy("session").agg((F.avg("net_pct") / 2000).alias("m"))
    w = Window.orderBy("session")  # one row per rebalance
    return m.withColumn("equity", F.exp(F.sum(F.ln(1 + F.col("m") / 100)).over(w))).withColumn("peak", F.max("equity").over(w))


@query("wn_equity_curve", f"WITH {CURVE} SELECT session, round(equity, 5) AS equity, round(equity / max(equity) OVER (ORDER BY session) - 1, 5) AS drawdown FROM eq")
def wn_equity_curve(v):
    return curve(v).select("session", F.round("equity", 5).alias("equity"), F.round(F.col("equity") / F.col("peak") - 1, 5).alias("drawdown"))


@query("wn_curve_metrics", f"WITH {CURVE}, r AS (SELECT *, equity / lag(equity) OVER (ORDER BY session) - 1 AS ret, equity / max(equity) OVER (ORDER BY session) - 1 AS dd FROM eq) SELECT round(arg_max(equity, session) ** (52.0 / count(*)) - 1, 5) AS cagr, round(avg(ret) / stddev_samp(ret) * sqrt(52), 4) AS sharpe, round(min(dd), 5) AS max_drawdown FROM r")
def wn_curve_metrics(v):
    r = curve(v).withColumns({"ret": F.col("equity") / F.lag("equity").over(Window.orderBy("session")) - 1, "dd": F.col("equity") / F.col("peak") - 1})
    return r.agg(F.round(F.pow(F.max_by("equity", "session"), F.lit(52.0) / F.count("*")) - 1, 5).alias("cagr"), F.round(F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.lit(52)), 4).alias("sharpe"), F.round(F.min("dd"), 5).alias("max_drawdown"))


@query("px_position_size", """SELECT instrument_id, session, floor(100000 / close)::BIGINT AS wanted, floor(0.1 * volume)::BIGINT AS cap, CASE WHEN close IS NULL OR close <= 0 THEN 'no_price' WHEN volume IS NULL OR volume <= 0 THEN 'no_volume' WHEN least(floor(100000 / close), floor(0.1 * volume)) < 1 THEN 'too_small' END AS reject_reason,
CASE WHEN close > 0 AND volume > 0 THEN least(floor(100000 / close), floor(0.1 * volume))::BIGINT END AS shares FROM grid_d""")
def px_position_size(v):
    wanted, cap = F.floor(F.lit(100000) / F.when(F.col("close") != 0, F.col("close"))), F.floor(F.col("volume") * 0.1)
    reason = F.when(F.expr("close is null or close <= 0"), "no_price").when(F.expr("volume is null or volume <= 0"), "no_volume").when(F.least(wanted, cap) < 1, "too_small")
    return v.grid_d.select("instrument_id", "session", wanted.alias("wanted"), cap.alias("cap"), reason.alias("reject_reason"), F.when(F.expr("close > 0 and volume > 0"), F.least(wanted, cap)).alias("shares"))
