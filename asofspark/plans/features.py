"""Queries of features, universes and signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features as fx
from ..operators.features import BY
from ..operators.ordered import sliding, wilder
from .registry import query

R6 = lambda c, name: F.round(c, 6).alias(name)
KEY = ("instrument_id", "sidx")


@query("px_turnover", "SELECT instrument_id, session, round(close * volume, 6) AS turnover_cv FROM bars_w")
def px_turnover(v):
    return v.bars_w.select("instrument_id", "session", R6(F.col("close") * F.col("volume"), "turnover_cv"))


@query("px_close_location", "SELECT instrument_id, session, CASE WHEN high - low > 0 THEN round((close - low) / (high - low), 6) END AS close_location FROM bars_w")
def px_close_location(v):
    return v.bars_w.select("instrument_id", "session", R6(fx.close_location(F.col("high"), F.col("low"), F.col("close")), "close_location"))


@query("wn_grid", "SELECT instrument_id, session, sidx, close FROM grid_w")
def wn_grid(v):
    return v.grid_w.select("instrument_id", "session", "sidx", "close")


@query("wn_prev_traded_close", "SELECT instrument_id, sidx, last_value(close IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY sidx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM grid_d")
def wn_prev_traded_close(v):
    return v.grid_d.select(*KEY, fx.previous_traded(F.col("close")).alias("prior"))


ACTIONS = """a0 AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY sidx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM grid_w),
a1 AS (SELECT *, CASE WHEN close IS NOT NULL THEN CASE WHEN (instrument_id * 31 + sidx) % 97 = 0 THEN prior * 0.5::DOUBLE ELSE prior END END AS prev_close FROM a0),
acts AS (SELECT *, prev_close / nullif(prior, 0) AS ratio, CASE WHEN abs(prev_close / nullif(prior, 0) - 1) > 0.005 THEN prev_close / prior END AS factor FROM a1)"""


@query("wn_action_detect", f"""WITH {ACTIONS},
days AS (SELECT sidx, avg((abs(ratio - 1) > 0.005)::INT) AS off_share, avg((abs(ratio - 1) > 0.1)::INT) AS moved_share FROM acts WHERE close IS NOT NULL AND ratio IS NOT NULL GROUP BY sidx)
SELECT instrument_id, sidx, session, ratio, NOT (off_share > 0.2 OR moved_share > 0.2) AS trusted FROM acts JOIN days USING (sidx) WHERE abs(ratio - 1) > 0.005""")
def wn_action_detect(v):
    return fx.detect_actions(v.grid_w)


@query("wn_daily_return", f"WITH {ACTIONS} SELECT instrument_id, sidx, round(close / (prior * coalesce(factor, 1)) - 1, 6) AS ret FROM acts")
def wn_daily_return(v):
    return fx.with_actions(v.grid_w).select(*KEY, R6(F.col("close") / (F.col("prior") * F.coalesce("factor", F.lit(1.0))) - 1, "ret"))


@query("wn_adjusted_close", f"""WITH {ACTIONS},
g AS (SELECT *, exp(sum(ln(1 + coalesce(close / (prior * coalesce(factor, 1)) - 1, 0))) OVER (PARTITION BY instrument_id ORDER BY sidx)) AS growth FROM acts),
l AS (SELECT instrument_id, arg_max(close, sidx) AS lc, arg_max(growth, sidx) AS lg FROM g WHERE close IS NOT NULL GROUP BY instrument_id)
SELECT instrument_id, sidx, CASE WHEN close IS NOT NULL THEN round(ln(growth * lc / lg), 8) END AS log_adjusted FROM g LEFT JOIN l USING (instrument_id)""")
def wn_adjusted_close(v):
    return fx.adjusted_close(v.grid_w).select(*KEY, F.round(F.ln("adjusted"), 8).alias("log_adjusted"))


@query("wn_action_evidence", f"""WITH {ACTIONS} SELECT count(*) AS n, round(median(abs(close / prior - 1)), 6) AS raw_move, round(median(abs(close / (prior * factor) - 1)), 6) AS corrected_move FROM acts WHERE factor IS NOT NULL AND close IS NOT NULL""")
def wn_action_evidence(v):
    a = fx.with_actions(v.grid_w).where("factor is not null and close is not null")
    return a.agg(F.count("*").alias("n"), R6(F.median(F.abs(F.col("close") / F.col("prior") - 1)), "raw_move"), R6(F.median(F.abs(F.col("close") / (F.col("prior") * F.col("factor")) - 1)), "corrected_move"))


@query("px_split_ratio", f"""WITH {ACTIONS} SELECT instrument_id, sidx, CASE WHEN abs(factor / 0.5 - 1) <= 0.02 THEN '1/2' WHEN abs(factor / 0.2 - 1) <= 0.02 THEN '1/5' WHEN abs(factor / 0.1 - 1) <= 0.02 THEN '1/10' END AS split FROM acts WHERE factor IS NOT NULL""")
def px_split_ratio(v):
    near = lambda f, x: F.abs(F.col("factor") / x - 1) <= f
    first = F.when(near(0.02, 0.5), "1/2").when(near(0.02, 0.2), "1/5").when(near(0.02, 0.1), "1/10")
    return fx.with_actions(v.grid_w).where("factor is not null").select(*KEY, first.alias("split"))


@query("px_action_label", f"""WITH {ACTIONS} SELECT CASE WHEN abs(factor / 0.5 - 1) <= 0.03 THEN '1:2 split' WHEN abs(factor / 0.2 - 1) <= 0.03 THEN '1:5 split' ELSE 'other' END AS label, count(*) AS n FROM acts WHERE factor IS NOT NULL GROUP BY 1""")
def px_action_label(v):
    near = lambda x: F.abs(F.col("factor") / x - 1) <= 0.03
    label = F.when(near(0.5), "1:2 split").when(near(0.2), "1:5 split").otherwise("other")
    return fx.with_actions(v.grid_w).where("factor is not null").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("wn_volume_ratio", """SELECT instrument_id, sidx, CASE WHEN count(volume) OVER w = 20 THEN round(volume / nullif(quantile_cont(volume, 0.5) OVER w, 0), 6) END AS volume_ratio
FROM grid_w WINDOW w AS (PARTITION BY instrument_id ORDER BY sidx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def wn_volume_ratio(v):
    g = sliding(v.grid_w.select(*KEY, "volume"), ["instrument_id"], ["sidx"], "volume", 20, median="usual", skip=1)
    return g.select(*KEY, F.round(F.try_divide("volume", "usual"), 6).alias("volume_ratio"))


TR = "CASE WHEN high IS NOT NULL AND low IS NOT NULL AND lag(close) OVER w IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END"


@query("wn_true_range", f"SELECT instrument_id, sidx, round({TR}, 6) AS true_range FROM grid_w WINDOW w AS (PARTITION BY instrument_id ORDER BY sidx)")
def wn_true_range(v):
    return v.grid_w.select(*KEY, R6(fx.true_range(F.col("high"), F.col("low"), F.col("close")), "true_range"))


def atr_sql(n: int, name: str) -> str:
    return f"""{name} AS (
  SELECT instrument_id, sidx, x AS y, CASE WHEN x IS NULL THEN 1 ELSE 0 END AS gap, CASE WHEN x IS NULL THEN 0 ELSE 1 END AS n FROM tr WHERE sidx = 1
  UNION ALL
  SELECT t.instrument_id, t.sidx, CASE WHEN t.x IS NULL THEN a.y WHEN a.y IS NULL THEN t.x ELSE ((1 - 1.0::DOUBLE / {n}) ** (CASE WHEN a.y IS NULL THEN 0 ELSE a.gap END + 1) * a.y + t.x / {n}) / ((1 - 1.0::DOUBLE / {n}) ** (a.gap + 1) + 1.0::DOUBLE / {n}) END,
    CASE WHEN t.x IS NULL THEN a.gap + 1 ELSE 0 END, a.n + CASE WHEN t.x IS NULL THEN 0 ELSE 1 END
  FROM {name} a JOIN tr t ON t.instrument_id = a.instrument_id AND t.sidx = a.sidx + 1)"""


TR_CTE = f"tr AS (SELECT instrument_id, sidx, {TR} AS x FROM grid_w WINDOW w AS (PARTITION BY instrument_id ORDER BY sidx))"


def with_tr(v):
    return v.grid_w.withColumn("tr", fx.true_range(F.col("high"), F.col("low"), F.col("close")))


@query("wn_atr", f"WITH RECURSIVE {TR_CTE}, {atr_sql(14, 'e')} SELECT instrument_id, sidx, CASE WHEN n >= 14 THEN round(y, 4) END AS atr FROM e")
def wn_atr(v):
    return fx.ewm_over_gaps(with_tr(v), "tr", 14, "atr").select(*KEY, F.round("atr", 4).alias("atr"))


def z_sql(x: str, n: int, least: int, w: str) -> str:
    return f"CASE WHEN count({x}) OVER {w} >= {least} AND stddev_samp({x}) OVER {w} > 0 THEN ({x} - avg({x}) OVER {w}) / stddev_samp({x}) OVER {w} END"


def win(name: str, n: int, skip: int = 0) -> str:
    return f"{name} AS (PARTITION BY instrument_id ORDER BY sidx ROWS BETWEEN {n - 1 + skip} PRECEDING AND {f'{skip} PRECEDING' if skip else 'CURRENT ROW'})"


@query("wn_zscore", f"SELECT instrument_id, sidx, round({z_sql('close', 20, 15, 'w')}, 4) AS z FROM grid_w WINDOW {win('w', 20)}")
def wn_zscore(v):
    return v.grid_w.select(*KEY, F.round(fx.zscore(F.col("close"), 20, 15), 4).alias("z"))


@query("wn_trailing_return", "SELECT instrument_id, sidx, CASE WHEN lag(close, 56) OVER w > 0 THEN round(lag(close, 4) OVER w / lag(close, 56) OVER w - 1, 6) END AS ret FROM grid_w WINDOW w AS (PARTITION BY instrument_id ORDER BY sidx)")
def wn_trailing_return(v):
    return v.grid_w.select(*KEY, R6(fx.trailing_return(F.col("close"), 52, 4), "ret"))


@query("wn_momentum_feature", "SELECT instrument_id, sidx, round(a / b - 1, 6) AS momentum FROM (SELECT instrument_id, sidx, lag(close, 4) OVER w AS a, lag(close, 56) OVER w AS b FROM grid_w WHERE session <= DATE '2000-12-31' WINDOW w AS (PARTITION BY instrument_id ORDER BY sidx)) WHERE a > 0 AND b > 0")
def wn_momentum_feature(v):
    g = v.grid_w.where("session <= date '2000-12-31'")
    then, now = F.lag("close", 56).over(BY()), F.lag("close", 4).over(BY())
    return g.select(*KEY, F.when((then > 0) & (now > 0), F.round(now / then - 1, 6)).alias("momentum")).where("momentum is not null")


@query("wn_causal_percentile", """SELECT a.instrument_id, a.sidx, CASE WHEN count(b.close) = 26 THEN round(sum((b.close <= a.close)::INT) * 100.0 / 26, 6) END AS percentile
FROM grid_w a JOIN grid_w b ON a.instrument_id = b.instrument_id AND b.sidx BETWEEN a.sidx - 25 AND a.sidx GROUP BY 1, 2""")
def wn_causal_percentile(v):
    g = sliding(v.grid_w.select(*KEY, "close"), ["instrument_id"], ["sidx"], "close", 26, share="p")
    return g.select(*KEY, R6(F.col("p"), "percentile"))


BREADTH = """br AS (SELECT sidx, avg((close > m)::INT) * 100 AS breadth FROM (SELECT sidx, close, CASE WHEN count(close) OVER w >= 20 THEN avg(close) OVER w END AS m FROM grid_w WINDOW w AS (PARTITION BY instrument_id ORDER BY sidx ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)) WHERE close IS NOT NULL AND m IS NOT NULL GROUP BY sidx)"""


def breadth(v):
    w = fx.over_last(26)
    g = v.grid_w.withColumn("m", fx.full(F.avg("close"), F.col("close"), w, 20)).where("close is not null and m is not null")
    return g.groupBy("sidx").agg((F.avg((F.col("close") > F.col("m")).cast("double")) * 100).alias("breadth"))


@query("ag_breadth", f"WITH {BREADTH} SELECT sidx, round(breadth, 6) AS breadth FROM br")
def ag_breadth(v):
    return breadth(v).select("sidx", R6(F.col("breadth"), "breadth"))


@query("wn_stress_composite", f"""WITH {BREADTH},
m AS (SELECT c.sidx, b.bench, br.breadth, 100 * (b.bench / lag(b.bench, 20) OVER (ORDER BY c.sidx) - 1) AS chg FROM cal_w c LEFT JOIN bench_w b USING (session) LEFT JOIN br USING (sidx)),
p AS (SELECT a.sidx, CASE WHEN count(b.breadth) = 26 AND a.breadth IS NOT NULL THEN 100 - sum((b.breadth <= a.breadth)::INT) * 100.0 / 26 END AS s1, CASE WHEN count(b.chg) = 26 AND a.chg IS NOT NULL THEN sum((b.chg <= a.chg)::INT) * 100.0 / 26 END AS s2,
  CASE WHEN count(b.bench) = 26 AND a.bench IS NOT NULL THEN sum((b.bench <= a.bench)::INT) * 100.0 / 26 END AS s3 FROM m a JOIN m b ON b.sidx BETWEEN a.sidx - 25 AND a.sidx GROUP BY a.sidx, a.breadth, a.chg, a.bench)
SELECT sidx, round(s1, 6) AS breadth_stress, round(s2, 6) AS change_stress, round(s3, 6) AS level_stress, round((s1 + s2 + s3) / 3, 6) AS stress FROM p""")
def wn_stress_composite(v):
    one = Window.orderBy("sidx")  # one row per session
    m = v.cal_w.join(v.bench_w, "session", "left").join(breadth(v), "sidx", "left").withColumn("chg", (F.col("bench") / F.lag("bench", 20).over(one) - 1) * 100)
    m = m.select("sidx", (100 - fx.causal_percentile(F.col("breadth"), 26, one)).alias("s1"), fx.causal_percentile(F.col("chg"), 26, one).alias("s2"), fx.causal_percentile(F.col("bench"), 26, one).alias("s3"))
    return m.select("sidx", R6(F.col("s1"), "breadth_stress"), R6(F.col("s2"), "change_stress"), R6(F.col("s3"), "level_stress"), R6((F.col("s1") + F.col("s2") + F.col("s3")) / 3, "stress"))


@query("wn_percentile_last", """WITH l AS (SELECT instrument_id, arg_max(close, sidx) AS last_close, max(sidx) AS last_sidx FROM grid_w WHERE close IS NOT NULL GROUP BY 1)
SELECT l.instrument_id, last_close, CASE WHEN count(*) >= 30 THEN round(avg((g.close <= last_close)::INT) * 100, 6) END AS percentile FROM l JOIN grid_w g ON g.instrument_id = l.instrument_id AND g.sidx < last_sidx AND g.close IS NOT NULL GROUP BY 1, 2""")
def wn_percentile_last(v):
    g = v.grid_w.where("close is not null")
    last = g.groupBy("instrument_id").agg(F.max_by("close", "sidx").alias("last_close"), F.max("sidx").alias("last_sidx"))
    p = g.join(last, "instrument_id").where("sidx < last_sidx").groupBy("instrument_id", "last_close")
    return p.agg(F.when(F.count("*") >= 30, F.round(F.avg((F.col("close") <= F.col("last_close")).cast("double")) * 100, 6)).alias("percentile"))


STATS = """st AS (SELECT instrument_id, session, sidx, close, turnover, count(close) OVER a AS history,
  date_diff('day', last_value(CASE WHEN close IS NOT NULL THEN session END IGNORE NULLS) OVER a, session) AS stale_days,
  CASE WHEN count(turnover) OVER w >= 6 THEN quantile_cont(turnover, 0.5) OVER w END AS liquidity
  FROM grid_w WINDOW a AS (PARTITION BY instrument_id ORDER BY sidx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w AS (PARTITION BY instrument_id ORDER BY sidx ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)),
me AS (SELECT date_trunc('month', session)::DATE AS month, max(session) AS session, max(sidx) AS sidx FROM cal_w GROUP BY 1),
rs AS (SELECT st.*, concat_ws('|', CASE WHEN history < 52 THEN 'short_history' END, CASE WHEN coalesce(stale_days, 9999) > 10 THEN 'stale' END, CASE WHEN liquidity IS NULL THEN 'no_liquidity' END, CASE WHEN coalesce(close, 0) < 5 THEN 'low_price' END) AS reasons FROM st JOIN me USING (sidx)),
rk AS (SELECT *, CASE WHEN reasons = '' THEN row_number() OVER (PARTITION BY sidx, reasons = '' ORDER BY liquidity DESC, instrument_id) END AS rank FROM rs),
hy AS (SELECT *, coalesce(last_value(CASE WHEN rank <= 10 THEN 1 WHEN rank IS NULL OR rank > 14 THEN 0 END IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY sidx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS member FROM rk)"""


def ranked(v):
    return fx.universe_reasons(v.grid_w, v.cal_w, 13, 52, 10, 5.0)


def universe(v):
    return fx.hysteresis(ranked(v), 10, 14)


@query("wn_universe_stats", f"WITH {STATS} SELECT instrument_id, sidx, history, stale_days, round(liquidity, 4) AS liquidity FROM st")
def wn_universe_stats(v):
    return fx.universe_stats(v.grid_w, 13).select(*KEY, "history", "stale_days", F.round("liquidity", 4).alias("liquidity"))


@query("wn_universe_reasons", f"WITH {STATS} SELECT instrument_id, session, reasons, rank FROM rk")
def wn_universe_reasons(v):
    return ranked(v).select("instrument_id", "session", "reasons", "rank")


@query("wn_universe_hysteresis", f"WITH {STATS} SELECT instrument_id, session, rank, member FROM hy")
def wn_universe_hysteresis(v):
    return universe(v).select("instrument_id", "session", "rank", "member")


@query("so_entries_exits", f"WITH {STATS}, c AS (SELECT session, member, coalesce(lag(member) OVER (PARTITION BY instrument_id ORDER BY sidx), 0) AS was FROM hy) SELECT session, sum((member = 1 AND was = 0)::INT)::BIGINT AS entries, sum((member = 0 AND was = 1)::INT)::BIGINT AS exits, sum(member)::BIGINT AS members FROM c GROUP BY session")
def so_entries_exits(v):
    c = universe(v).withColumn("was", F.coalesce(F.lag("member").over(BY()), F.lit(0)))
    return c.groupBy("session").agg(F.count_if(F.expr("member = 1 and was = 0")).alias("entries"), F.count_if(F.expr("member = 0 and was = 1")).alias("exits"), F.sum("member").alias("members"))


@query("wn_month_end", "SELECT date_trunc('month', session)::DATE AS month, max(session) AS session FROM cal_d GROUP BY 1")
def wn_month_end(v):
    return fx.month_ends(v.cal_d).select("month", "session")


MEMBERS = f"{STATS}, iv AS (SELECT sidx, lead(sidx) OVER (ORDER BY sidx) AS nxt FROM me), mb AS (SELECT h.instrument_id, c.sidx, c.session FROM hy h JOIN iv USING (sidx) JOIN cal_w c ON c.sidx > iv.sidx AND c.sidx <= coalesce(iv.nxt, 1000000) WHERE h.member = 1)"


def members(v):
    """Sessions strictly after a rebalance up to and including the next one; the interval is put out by ordinal."""
    ends = v.cal_w.agg(F.max("sidx").alias("last"))
    iv = fx.month_ends(v.cal_w).withColumn("nxt", F.lead("sidx").over(Window.orderBy("sidx"))).crossJoin(F.broadcast(ends))
    iv = iv.select("sidx", F.sequence(F.col("sidx") + 1, F.greatest(F.coalesce("nxt", "last"), F.col("sidx") + 1)).alias("at"), "last")
    m = universe(v).where("member = 1").select("instrument_id", "sidx").join(iv, "sidx")
    return m.select("instrument_id", F.explode("at").alias("sidx"), "last").where("sidx <= last").join(v.cal_w, "sidx").select("instrument_id", "sidx", "session")


@query("wn_membership_ffill", f"WITH {MEMBERS} SELECT instrument_id, sidx, session FROM mb")
def wn_membership_ffill(v):
    return members(v)


@query("ag_ever_eligible", f"WITH {MEMBERS} SELECT DISTINCT instrument_id FROM mb")
def ag_ever_eligible(v):
    return members(v).select("instrument_id").distinct()


MOMENTUM = f"""{MEMBERS}, mo AS (SELECT instrument_id, sidx, CASE WHEN lag(close, 56) OVER w > 0 THEN lag(close, 4) OVER w / lag(close, 56) OVER w - 1 END AS ret FROM grid_w WINDOW w AS (PARTITION BY instrument_id ORDER BY sidx)),
el AS (SELECT m.instrument_id, m.sidx, round(ret, 9) AS ret FROM mo m JOIN mb USING (instrument_id, sidx) JOIN me USING (sidx) WHERE ret IS NOT NULL),
rr AS (SELECT *, count(*) OVER (PARTITION BY sidx) AS n, row_number() OVER (PARTITION BY sidx ORDER BY ret DESC, instrument_id) AS rank FROM el),
se AS (SELECT *, round(1 - (rank - 1) / n::DOUBLE, 6) AS percentile, rank <= greatest(1, ceil(n * 0.2)) AS selected FROM rr)"""


def momentum_ranks(v):
    mo = v.grid_w.select(*KEY, F.round(fx.trailing_return(F.col("close"), 52, 4), 9).alias("ret"))
    eligible = mo.join(members(v).select(*KEY), list(KEY), "left_semi").join(fx.month_ends(v.cal_w).select("sidx"), "sidx", "left_semi")
    return fx.rank_select(eligible, "ret", 0.2)


@query("wn_rank_select", f"WITH {MOMENTUM} SELECT instrument_id, sidx, n, rank, percentile, selected FROM se")
def wn_rank_select(v):
    return momentum_ranks(v).select(*KEY, "n", "rank", "percentile", "selected")


@query("sg_momentum", f"WITH {MOMENTUM} SELECT instrument_id, sidx FROM se WHERE selected")
def sg_momentum(v):
    return momentum_ranks(v).where("selected").select(*KEY)


@query("jn_signal_eligible", f"WITH {MEMBERS} SELECT p.instrument_id, p.sidx FROM picks p SEMI JOIN mb ON p.instrument_id = mb.instrument_id AND p.sidx = mb.sidx WHERE p.session BETWEEN DATE '1997-01-01' AND DATE '2000-12-31'")
def jn_signal_eligible(v):
    return v.picks.where("session between date '1997-01-01' and date '2000-12-31'").join(members(v), list(KEY), "left_semi").select(*KEY)


@query("tk_liquid_n", f"WITH {STATS} SELECT instrument_id, session, rank FROM rk WHERE rank <= 5")
def tk_liquid_n(v):
    return ranked(v).where("rank <= 5").select("instrument_id", "session", "rank")


@query("tk_stable_order", "SELECT session, instrument_id, row_number() OVER (PARTITION BY session ORDER BY turnover DESC NULLS LAST, instrument_id) AS pos FROM bars_w")
def tk_stable_order(v):
    return v.bars_w.select("session", "instrument_id", F.row_number().over(Window.partitionBy("session").orderBy(F.desc_nulls_last("turnover"), "instrument_id")).alias("pos"))


@query("wn_entry_delay", "SELECT instrument_id, sidx + 2 AS sidx FROM picks WHERE sidx + 2 <= (SELECT max(sidx) FROM cal_w)")
def wn_entry_delay(v):
    g = v.grid_w.join(v.picks.select(*KEY, F.lit(True).alias("signal")), list(KEY), "left")
    return g.withColumn("late", F.lag("signal", 2).over(BY())).where("late").select(*KEY)


# --- signals -----------------------------------------------------------------------------------------------------


@query("sg_mean_reversion", f"SELECT instrument_id, sidx FROM (SELECT instrument_id, sidx, {z_sql('close', 50, 40, 'w')} AS z FROM grid_w WINDOW {win('w', 50)}) WHERE round(z, 9) < -0.9")
def sg_mean_reversion(v):
    return v.grid_w.select(*KEY, F.round(fx.zscore(F.col("close"), 50, 40), 9).alias("z")).where("z < -0.9").select(*KEY)


BREAK = "close > CASE WHEN count(close) OVER b = 20 THEN max(close) OVER b END"


def breakout():
    w = fx.over_last(20, 1)
    return F.col("close") > fx.full(F.max("close"), F.col("close"), w, 20)


DELIVERY = "CASE WHEN volume IS NOT NULL THEN 100 * (instrument_id * 17 + sidx * 29) % 101 + volume / 1000 END"


def delivery():
    return F.when(F.col("volume").isNotNull(), (100 * (F.col("instrument_id") * 17 + F.col("sidx") * 29)) % 101 + F.col("volume") / 1000)


@query("sg_delivery_breakout", f"""WITH d AS (SELECT *, {DELIVERY} AS del FROM grid_w), s AS (SELECT instrument_id, sidx, {BREAK} AS br, {z_sql('del', 20, 15, 'z')} AS z FROM d WINDOW {win('b', 20, 1)}, {win('z', 20)})
SELECT instrument_id, sidx FROM s WHERE br AND round(z, 9) > 1""")
def sg_delivery_breakout(v):
    d = v.grid_w.withColumn("del", delivery())
    return d.select(*KEY, breakout().alias("br"), F.round(fx.zscore(F.col("del"), 20, 15), 9).alias("z")).where("br and z > 1").select(*KEY)


FRONT = """fr AS (SELECT instrument_id, session, expiry, settle, oi FROM contracts WHERE expiry >= session QUALIFY row_number() OVER (PARTITION BY instrument_id, session ORDER BY expiry) = 1),
fm AS (SELECT *, date_diff('day', session, expiry) AS dte, coalesce(lag(expiry) OVER w <> expiry, false) AS rollover, CASE WHEN lag(expiry) OVER w = expiry AND lag(oi) OVER w > 0 THEN 100 * (oi / lag(oi) OVER w - 1) END AS oi_chg FROM fr WINDOW w AS (PARTITION BY instrument_id ORDER BY session))"""


def front_month(v):
    w = Window.partitionBy("instrument_id", "session").orderBy("expiry")
    f = v.contracts.where("expiry >= session").withColumn("r", F.row_number().over(w)).where("r = 1")
    s = Window.partitionBy("instrument_id").orderBy("session")
    same = F.lag("expiry").over(s) == F.col("expiry")
    return f.select(
        "instrument_id", "session", "expiry", "settle", "oi", F.datediff("expiry", "session").alias("dte"), F.coalesce(~same, F.lit(False)).alias("rollover"),
        F.when(same & (F.lag("oi").over(s) > 0), (F.col("oi") / F.lag("oi").over(s) - 1) * 100).alias("oi_chg"),
    )


@query("wn_front_month", f"WITH {FRONT} SELECT instrument_id, session, expiry, settle, oi, dte, rollover, round(oi_chg, 6) AS oi_chg FROM fm")
def wn_front_month(v):
    return front_month(v).withColumn("oi_chg", F.round("oi_chg", 6))


@query("wn_contract_rank", "SELECT instrument_id, session, expiry, row_number() OVER (PARTITION BY instrument_id, session ORDER BY expiry) AS rank FROM contracts WHERE expiry >= session")
def wn_contract_rank(v):
    w = Window.partitionBy("instrument_id", "session").orderBy("expiry")
    return v.contracts.where("expiry >= session").select("instrument_id", "session", "expiry", F.row_number().over(w).alias("rank"))


@query("sg_oi_momentum", f"""WITH {FRONT}, d AS (SELECT g.*, oi_chg, dte FROM grid_w g LEFT JOIN fm USING (instrument_id, session)), s AS (SELECT instrument_id, sidx, dte, {BREAK} AS br, {z_sql('oi_chg', 20, 8, 'z')} AS z FROM d WINDOW {win('b', 20, 1)}, {win('z', 20)})
SELECT instrument_id, sidx FROM s WHERE br AND round(z, 9) > 0.5 AND dte BETWEEN 5 AND 25""")
def sg_oi_momentum(v):
    d = v.grid_w.join(front_month(v).select("instrument_id", "session", "oi_chg", "dte"), ["instrument_id", "session"], "left")
    return d.select(*KEY, "dte", breakout().alias("br"), F.round(fx.zscore(F.col("oi_chg"), 20, 8), 9).alias("z")).where("br and z > 0.5 and dte between 5 and 25").select(*KEY)


@query("sg_participant_tilt", f"""WITH f AS (SELECT sidx, sum(CASE WHEN instrument_id % 2 = 0 THEN volume ELSE -volume END) AS flow FROM grid_w GROUP BY sidx),
fz AS (SELECT sidx, CASE WHEN count(flow) OVER w >= 20 AND stddev_samp(flow) OVER w > 0 THEN (flow - avg(flow) OVER w) / stddev_samp(flow) OVER w END AS fz FROM f WINDOW w AS (ORDER BY sidx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
s AS (SELECT instrument_id, sidx, {z_sql('close', 50, 40, 'w')} AS z FROM grid_w WINDOW {win('w', 50)}) SELECT instrument_id, sidx FROM s JOIN fz USING (sidx) WHERE round(z, 9) < -0.9 AND round(fz, 9) > 0""")
def sg_participant_tilt(v):
    flow = v.grid_w.groupBy("sidx").agg(F.sum(F.when(F.col("instrument_id") % 2 == 0, F.col("volume")).otherwise(-F.col("volume"))).alias("flow"))
    gate = flow.select("sidx", F.round(fx.zscore(F.col("flow"), 20, by=Window.orderBy("sidx")), 9).alias("fz")).where("fz > 0")
    s = v.grid_w.select(*KEY, F.round(fx.zscore(F.col("close"), 50, 40), 9).alias("z")).where("z < -0.9")
    return s.join(gate, "sidx", "left_semi").select(*KEY)


@query("sg_vol_squeeze", f"""WITH RECURSIVE {TR_CTE}, {atr_sql(10, 'e1')}, {atr_sql(30, 'e2')},
q AS (SELECT e1.instrument_id, e1.sidx, round(CASE WHEN e1.n >= 10 THEN e1.y END / CASE WHEN e2.n >= 30 THEN e2.y END, 9) AS r FROM e1 JOIN e2 USING (instrument_id, sidx)),
s AS (SELECT g.instrument_id, g.sidx, {BREAK} AS br, r, lag(r) OVER (PARTITION BY g.instrument_id ORDER BY g.sidx) AS pr FROM grid_w g JOIN q USING (instrument_id, sidx) WINDOW b AS (PARTITION BY g.instrument_id ORDER BY g.sidx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT instrument_id, sidx FROM s WHERE br AND r > 1 AND pr <= 1""")
def sg_vol_squeeze(v):
    g = wilder(with_tr(v), "instrument_id", "sidx", "tr", {"a1": 10, "a2": 30})
    g = g.select(*KEY, breakout().alias("br"), F.round(F.try_divide(F.col("a1"), F.col("a2")), 9).alias("r")).withColumn("pr", F.lag("r").over(BY()))
    return g.where("br and r > 1 and pr <= 1").select(*KEY)


@query("sg_price_action", f"""WITH t AS (SELECT *, {TR} AS tr FROM grid_w WINDOW w AS (PARTITION BY instrument_id ORDER BY sidx)),
s AS (SELECT instrument_id, sidx, {z_sql('tr', 20, 15, 'w')} AS zt, {z_sql('volume', 20, 15, 'w')} AS zv, CASE WHEN high - low > 0 THEN (close - low) / (high - low) END AS cl FROM t WINDOW {win('w', 20)})
SELECT instrument_id, sidx, CASE WHEN round(cl, 9) >= 0.7 THEN 'long' ELSE 'short' END AS side FROM s WHERE round(zt, 9) > 0.8 AND round(zv, 9) > 0.3 AND (round(cl, 9) >= 0.7 OR round(cl, 9) <= 0.3)""")
def sg_price_action(v):
    g = with_tr(v).select(*KEY, F.round(fx.zscore(F.col("tr"), 20, 15), 9).alias("zt"), F.round(fx.zscore(F.col("volume"), 20, 15), 9).alias("zv"), F.round(fx.close_location(F.col("high"), F.col("low"), F.col("close")), 9).alias("cl"))
    return g.where("zt > 0.8 and zv > 0.3 and (cl >= 0.7 or cl <= 0.3)").select(*KEY, F.when(F.col("cl") >= 0.7, "long").otherwise("short").alias("side"))


# --- filings -----------------------------------------------------------------------------------------------------

PIT = """ff AS (SELECT entity_id % 25 AS instrument_id, * FROM filings WHERE NOT consolidated),
p1 AS (SELECT * FROM ff QUALIFY row_number() OVER (PARTITION BY instrument_id, period_end ORDER BY filing_ts DESC, filing_id DESC) = 1),
pit AS (SELECT * FROM p1 QUALIFY row_number() OVER (PARTITION BY instrument_id, filing_date ORDER BY filing_ts DESC, filing_id DESC) = 1)"""


def pit_series(v):
    """Standalone filings: the latest per period, then the latest per filing date."""
    f = v.filings.where("not consolidated").withColumn("instrument_id", (F.col("entity_id") % 25).cast("int"))
    for key in ("period_end", "filing_date"):
        w = Window.partitionBy("instrument_id", key).orderBy(F.desc("filing_ts"), F.desc("filing_id"))
        f = f.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return f


def FBY():
    return Window.partitionBy("instrument_id").orderBy("filing_ts", "filing_id")


FW = "PARTITION BY instrument_id ORDER BY filing_ts, filing_id"


@query("wn_pit_series", f"WITH {PIT} SELECT instrument_id, period_end, filing_date, value FROM pit")
def wn_pit_series(v):
    return pit_series(v).select("instrument_id", "period_end", "filing_date", "value")


SUE = f"""{PIT}, yo AS (SELECT *, value - lag(value, 4) OVER ({FW}) AS yoy FROM pit),
su AS (SELECT *, CASE WHEN count(yoy) OVER w >= 4 AND stddev_samp(yoy) OVER w > 0 THEN (yoy - avg(yoy) OVER w) / stddev_samp(yoy) OVER w END AS sue FROM yo WINDOW w AS ({FW} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))"""


def sue(v):
    p = pit_series(v).withColumn("yoy", F.col("value") - F.lag("value", 4).over(FBY()))
    return p.withColumn("sue", fx.zscore(F.col("yoy"), 8, 4, FBY()))


@query("wn_yoy_sue", f"WITH {SUE} SELECT instrument_id, filing_id, round(yoy, 4) AS yoy, round(sue, 4) AS sue FROM su")
def wn_yoy_sue(v):
    return sue(v).select("instrument_id", "filing_id", F.round("yoy", 4).alias("yoy"), F.round("sue", 4).alias("sue"))


TTM = f"""{PIT}, tt AS (SELECT *, CASE WHEN count(value) OVER w = 4 THEN sum(value) OVER w END AS ttm, CASE WHEN count(value) OVER w = 4 THEN sum(value * (1 + filing_id % 7) / 10) OVER w / sum(value) OVER w END AS margin FROM pit WINDOW w AS ({FW} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
tz AS (SELECT *, CASE WHEN count(margin) OVER w >= 4 AND stddev_samp(margin) OVER w > 0 THEN (margin - avg(margin) OVER w) / stddev_samp(margin) OVER w END AS trend FROM tt WINDOW w AS ({FW} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))"""


def ttm(v):
    w = fx.over_last(4, by=FBY())
    value, profit = F.col("value"), F.col("value") * (1 + F.col("filing_id") % 7) / 10
    p = pit_series(v).withColumns({"ttm": fx.full(F.sum(value), value, w, 4), "margin": F.when(F.count(value).over(w) == 4, F.sum(profit).over(w) / F.sum(value).over(w))})
    return p.withColumn("trend", fx.zscore(F.col("margin"), 8, 4, FBY()))


@query("wn_ttm_margin", f"WITH {TTM} SELECT instrument_id, filing_id, round(ttm, 2) AS ttm, round(margin, 6) AS margin, round(trend, 4) AS trend FROM tz")
def wn_ttm_margin(v):
    return ttm(v).select("instrument_id", "filing_id", F.round("ttm", 2).alias("ttm"), R6(F.col("margin"), "margin"), F.round("trend", 4).alias("trend"))


@query("jn_filing_daily", f"WITH {PIT} SELECT g.instrument_id, g.session, p.value FROM (SELECT instrument_id, session FROM grid_w) g ASOF LEFT JOIN (SELECT instrument_id, filing_ts, last(value ORDER BY filing_id) AS value FROM pit GROUP BY 1, 2) p ON g.instrument_id = p.instrument_id AND g.session >= p.filing_ts")
def jn_filing_daily(v):
    return fx.asof_values(v.grid_w.select("instrument_id", "session"), pit_series(v), "instrument_id", "filing_ts", "value", "session")


@query("jn_filing_asof", "SELECT entity_id, filing_id, value FROM filings WHERE filing_date <= DATE '1998-06-30' AND consolidated QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY filing_ts DESC, filing_id DESC) = 1")
def jn_filing_asof(v):
    f = v.filings.where("filing_date <= date '1998-06-30' and consolidated")
    return f.groupBy("entity_id").agg(F.max_by(F.struct("filing_id", "value"), F.struct("filing_ts", "filing_id")).alias("x")).select("entity_id", "x.*")


NEXT = "SELECT s.instrument_id, min(c.sidx) AS sidx FROM {src} s JOIN cal_d c ON c.session >= s.filing_date WHERE {where} GROUP BY s.instrument_id, s.filing_id"


def next_session(events, calendar):
    """Forward as-of: the first session on or after a date. Sessions are one row per day, so each event date is looked
    up in a table of dates with their next session."""
    w = Window.orderBy("d").rowsBetween(0, Window.unboundedFollowing)
    dates = calendar.select(F.col("session").alias("d"), "sidx").unionByName(events.select(F.col("filing_date").alias("d"), F.lit(None).cast("int").alias("sidx")).distinct())
    table = dates.groupBy("d").agg(F.max("sidx").alias("sidx")).withColumn("sidx", F.first("sidx", True).over(w))
    return events.join(table, events["filing_date"] == table["d"]).where("sidx is not null")


@query("jn_event_next_session", f"WITH {PIT}, f AS (SELECT filing_id, instrument_id, filing_date FROM pit) SELECT f.instrument_id, f.filing_id, min(c.session) AS session FROM f JOIN cal_d c ON c.session >= f.filing_date GROUP BY 1, 2")
def jn_event_next_session(v):
    n = next_session(pit_series(v).select("instrument_id", "filing_id", "filing_date"), v.cal_d)
    return n.join(v.cal_d, "sidx").select("instrument_id", "filing_id", "session")


@query("sg_earnings_surprise", f"WITH {SUE} SELECT DISTINCT instrument_id, sidx FROM ({NEXT.format(src='su', where='round(s.sue, 9) > 1')})")
def sg_earnings_surprise(v):
    s = sue(v).where(F.round("sue", 9) > 1).select("instrument_id", "filing_date")
    return next_session(s, v.cal_d).select("instrument_id", "sidx").distinct()


@query("sg_quality", f"WITH {TTM} SELECT DISTINCT instrument_id, sidx FROM ({NEXT.format(src='tz', where='round(s.trend, 9) > 1')})")
def sg_quality(v):
    s = ttm(v).where(F.round("trend", 9) > 1).select("instrument_id", "filing_date")
    return next_session(s, v.cal_d).select("instrument_id", "sidx").distinct()


@query("sg_value", f"""WITH {TTM}, pe AS (SELECT g.instrument_id, g.sidx, round(g.close / (p.ttm / 1000), 9) AS pe FROM grid_w g ASOF LEFT JOIN (SELECT instrument_id, filing_ts, last(ttm ORDER BY filing_id) AS ttm FROM tz WHERE ttm IS NOT NULL GROUP BY 1, 2) p ON g.instrument_id = p.instrument_id AND g.session >= p.filing_ts),
z AS (SELECT instrument_id, sidx, round({z_sql('pe', 52, 26, 'w')}, 9) AS z FROM pe WINDOW {win('w', 52)}),
c AS (SELECT *, lag(z) OVER (PARTITION BY instrument_id ORDER BY sidx) AS pz FROM z) SELECT instrument_id, sidx FROM c WHERE z < -1 AND pz >= -1""")
def sg_value(v):
    g = fx.asof_values(v.grid_w.select(*KEY, "session", "close"), ttm(v), "instrument_id", "filing_ts", "ttm", "session")
    g = g.withColumn("pe", F.round(F.col("close") / (F.col("ttm") / 1000), 9)).select(*KEY, F.round(fx.zscore(F.col("pe"), 52, 26), 9).alias("z"))
    return g.withColumn("pz", F.lag("z").over(BY())).where("z < -1 and pz >= -1").select(*KEY)


@query("jn_next_session", "SELECT session, lead(session) OVER (ORDER BY session) AS next_session FROM cal_d")
def jn_next_session(v):
    return v.cal_d.select("session", F.lead("session").over(Window.orderBy("session")).alias("next_session"))


@query("wn_calendar_quorum", """WITH span AS (SELECT instrument_id, min(session) AS a, max(session) AS b FROM bars_d GROUP BY 1), t AS (SELECT session, count(*) AS traded FROM bars_d GROUP BY 1),
al AS (SELECT c.session, count(*) AS alive FROM cal_d c JOIN span ON c.session BETWEEN a AND b GROUP BY 1) SELECT session, traded, alive FROM al JOIN t USING (session) WHERE traded >= 0.6 * alive""")
def wn_calendar_quorum(v):
    """Alive names per session from entries and exits counted by date: no range join."""
    span = v.bars_d.groupBy("instrument_id").agg(F.min("session").alias("a"), F.max("session").alias("b"))
    starts = span.groupBy(F.col("a").alias("session")).agg(F.count("*").alias("s"))
    stops = span.groupBy(F.col("b").alias("session")).agg(F.count("*").alias("e"))
    c = v.cal_d.join(starts, "session", "left").join(stops, "session", "left").na.fill(0, ["s", "e"])
    alive = F.sum("s").over(Window.orderBy("session")) - F.coalesce(F.sum("e").over(Window.orderBy("session").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    traded = v.bars_d.groupBy("session").agg(F.count("*").alias("traded"))
    return c.select("session", alive.alias("alive")).join(traded, "session").where("traded >= 0.6 * alive")


@query("wn_same_day_dedupe", """SELECT instrument_id, day, l_orderkey, l_linenumber FROM fills QUALIFY row_number() OVER (PARTITION BY instrument_id, day ORDER BY (l_extendedprice > 30000)::INT DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) = 1""")
def wn_same_day_dedupe(v):
    order = [F.desc((F.col("l_extendedprice") > 30000).cast("int"))] + [F.desc(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    w = Window.partitionBy("instrument_id", "day").orderBy(*order)
    return v.fills.withColumn("r", F.row_number().over(w)).where("r = 1").select("instrument_id", "day", "l_orderkey", "l_linenumber")


@query("wn_pivot_guard", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def wn_pivot_guard(v):
    return v.t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")
