"""Queries of pairs: selection by sector, spreads, two-leg pricing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.features import over_last
from ..operators.ordered import not_overlapping
from .registry import query

R6 = lambda c, name: F.round(c, 6).alias(name)

PAIRS = "pp AS (SELECT a.sector_id, a.instrument_id AS a, b.instrument_id AS b FROM sector a JOIN sector b ON a.sector_id = b.sector_id AND a.instrument_id < b.instrument_id)"


def sector_pairs(v):
    """Unordered pairs within a sector: sectors are small groups of names, by definition of the pairs' study."""
    a = v.sector.withColumnRenamed("instrument_id", "a")
    return a.join(v.sector.withColumnRenamed("instrument_id", "b"), "sector_id").where("a < b")


@query("jn_sector_pairs", f"WITH {PAIRS} SELECT * FROM pp")
def jn_sector_pairs(v):
    return sector_pairs(v)


SP = f"{PAIRS}, sp AS (SELECT pp.*, x.sidx, x.session, x.close AS ca, y.close AS cb, ln(x.close) - ln(y.close) AS spread FROM pp JOIN grid_w x ON x.instrument_id = pp.a JOIN grid_w y ON y.instrument_id = pp.b AND y.sidx = x.sidx)"


def spreads(v):
    x = v.grid_w.select(F.col("instrument_id").alias("a"), "sidx", "session", F.col("close").alias("ca"))
    y = v.grid_w.select(F.col("instrument_id").alias("b"), "sidx", F.col("close").alias("cb"))
    return sector_pairs(v).join(x, "a").join(y, ["b", "sidx"]).withColumn("spread", F.ln("ca") - F.ln("cb"))


@query("px_log_spread", f"WITH {SP} SELECT a, b, sidx, round(spread, 8) AS spread FROM sp WHERE spread IS NOT NULL")
def px_log_spread(v):
    return spreads(v).where("spread is not null").select("a", "b", "sidx", F.round("spread", 8).alias("spread"))


@query("tk_pairs_per_sector", f"WITH {SP}, c AS (SELECT sector_id, a, b, round(corr(ca, cb), 6) AS r FROM sp WHERE sidx <= 200 GROUP BY 1, 2, 3) SELECT sector_id, a, b, r FROM c WHERE r >= -0.2 QUALIFY row_number() OVER (PARTITION BY sector_id ORDER BY r DESC, a, b) <= 3")
def tk_pairs_per_sector(v):
    s = spreads(v).where("sidx <= 200 and ca is not null and cb is not null")
    c = s.groupBy("sector_id", "a", "b").agg(R6(F.corr("ca", "cb"), "r")).where("r >= -0.2")
    w = Window.partitionBy("sector_id").orderBy(F.desc("r"), "a", "b")
    return c.withColumn("k", F.row_number().over(w)).where("k <= 3").drop("k")


@query("tk_pairs_liquidity", f"WITH {PAIRS}, l AS (SELECT instrument_id, sum(turnover) AS t FROM bars_w GROUP BY 1), q AS (SELECT s.sector_id, s.instrument_id, t, row_number() OVER (PARTITION BY sector_id ORDER BY t DESC, s.instrument_id) AS k FROM sector s JOIN l USING (instrument_id)) SELECT pp.sector_id, a, b, round(x.t + y.t, 2) AS turnover FROM pp JOIN q x ON x.instrument_id = a AND x.k <= 3 JOIN q y ON y.instrument_id = b AND y.k <= 3")
def tk_pairs_liquidity(v):
    l = v.bars_w.groupBy("instrument_id").agg(F.sum("turnover").alias("t")).join(v.sector, "instrument_id")  # noqa: E741
    q = l.withColumn("k", F.row_number().over(Window.partitionBy("sector_id").orderBy(F.desc("t"), "instrument_id"))).where("k <= 3")
    x, y = q.select("sector_id", F.col("instrument_id").alias("a"), F.col("t").alias("ta")), q.select("sector_id", F.col("instrument_id").alias("b"), F.col("t").alias("tb"))
    return x.join(y, "sector_id").where("a < b").select("sector_id", "a", "b", F.round(F.col("ta") + F.col("tb"), 2).alias("turnover"))


ANY_PAIRS = 10  # placebo pairs over all sectors
RANDOM = """sp1 AS (SELECT sector_id, a, b FROM pp QUALIFY row_number() OVER (PARTITION BY sector_id ORDER BY (7 * 40503 + a::BIGINT * 2654435761 + b::BIGINT * 2654435858) % 1000003, a, b) <= 2),
nm AS (SELECT instrument_id, row_number() OVER (ORDER BY instrument_id) - 1 AS i, count(*) OVER () AS n FROM sector), dw AS (SELECT k, n, (7 * 40503 + k * 2654435761) % 1000003 % n AS i, (13 * 40503 + k * 2654435761) % 1000003 % (n - 1) AS step FROM (SELECT DISTINCT n FROM nm WHERE n > 1), range(0, 10) r(k)),
ap AS (SELECT DISTINCT least(x.instrument_id, y.instrument_id) AS a, greatest(x.instrument_id, y.instrument_id) AS b FROM dw JOIN nm x ON x.i = dw.i JOIN nm y ON y.i = (dw.i + 1 + dw.step) % dw.n)"""


@query("tk_pairs_random", f"WITH {PAIRS}, {RANDOM} SELECT 'sector' AS scope, sector_id, a, b FROM sp1 UNION ALL SELECT 'any', NULL, a, b FROM ap")
def tk_pairs_random(v):
    """Two pairs of each sector by an arithmetic draw, and placebo pairs over all instruments: two different ordinals are
    drawn and looked up, no pairs are formed to choose from."""
    from .evidence import arithmetic_draw

    w = Window.partitionBy("sector_id").orderBy(arithmetic_draw(F.lit(7).cast("long"), F.col("a"), F.col("b")), "a", "b")
    same = sector_pairs(v).withColumn("k", F.row_number().over(w)).where("k <= 2").select(F.lit("sector").alias("scope"), "sector_id", "a", "b")
    names = v.sector.select("instrument_id", (F.row_number().over(Window.orderBy("instrument_id")) - 1).cast("long").alias("i"))  # one row per instrument
    k = v.spark.range(ANY_PAIRS).withColumnRenamed("id", "k").crossJoin(F.broadcast(names.agg(F.count("*").alias("n")))).where("n > 1")
    i = arithmetic_draw(F.lit(7).cast("long"), F.col("k")) % F.col("n")
    j = (i + 1 + arithmetic_draw(F.lit(13).cast("long"), F.col("k")) % (F.col("n") - 1)) % F.col("n")
    drawn = k.select(i.alias("i"), j.alias("j")).join(names.withColumnRenamed("instrument_id", "x"), "i").join(names.select(F.col("i").alias("j"), F.col("instrument_id").alias("y")), "j")
    any_ = drawn.select(F.lit("any").alias("scope"), F.lit(None).cast("long").alias("sector_id"), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return same.unionByName(any_.withColumn("sector_id", F.lit(None).cast(dict(same.dtypes)["sector_id"])))


def z_spread(v):
    by = Window.partitionBy("a", "b").orderBy("sidx")
    w = over_last(20, by=by)
    s, x = spreads(v), F.col("spread")
    return s.withColumn("z", F.when((F.count(x).over(w) >= 15) & (F.stddev_samp(x).over(w) > 0), F.round((x - F.avg(x).over(w)) / F.stddev_samp(x).over(w), 9)))


ZS = f"{SP}, zs AS (SELECT *, CASE WHEN count(spread) OVER w >= 15 AND stddev_samp(spread) OVER w > 0 THEN round((spread - avg(spread) OVER w) / stddev_samp(spread) OVER w, 9) END AS z FROM sp WINDOW w AS (PARTITION BY a, b ORDER BY sidx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"

HOLD = 20


def candidates(v):
    """Every extreme of a pair's spread with its own exit: the first return within HOLD sessions, else HOLD, else the
    last session; entries do not depend on each other yet."""
    z = z_spread(v).select("sector_id", "a", "b", "sidx", "z", "ca", "cb")
    e = z.where("abs(z) >= 2").select("sector_id", "a", "b", F.col("sidx").alias("entry"), F.col("z").alias("z0"))
    path = e.withColumn("sidx", F.explode(F.sequence(F.col("entry") + 1, F.col("entry") + HOLD)))
    calm = path.join(z.where("abs(z) <= 0.5").select("a", "b", "sidx"), ["a", "b", "sidx"]).groupBy("a", "b", "entry").agg(F.min("sidx").alias("back"))
    last = v.cal_w.agg(F.max("sidx").alias("last"))
    out = e.join(calm, ["a", "b", "entry"], "left").crossJoin(F.broadcast(last))
    return out.select("sector_id", "a", "b", "entry", "z0", F.coalesce("back", F.least(F.col("entry") + HOLD, F.col("last"))).alias("exit"), F.when(F.col("back").isNotNull(), "reverted").when(F.col("entry") + HOLD <= F.col("last"), "time").otherwise("window_end").alias("reason"))


CAND = f"{ZS}, cd AS (SELECT e.sector_id, e.a, e.b, e.sidx AS entry, e.z AS z0, (SELECT max(sidx) FROM cal_w) AS last, min(x.sidx) AS back FROM zs e LEFT JOIN zs x ON x.a = e.a AND x.b = e.b AND x.sidx BETWEEN e.sidx + 1 AND e.sidx + {HOLD} AND abs(x.z) <= 0.5 WHERE abs(e.z) >= 2 GROUP BY ALL), cn AS (SELECT sector_id, a, b, entry, z0, coalesce(back, least(entry + {HOLD}, last)) AS exit, CASE WHEN back IS NOT NULL THEN 'reverted' WHEN entry + {HOLD} <= last THEN 'time' ELSE 'window_end' END AS reason FROM cd)"
TAKEN = CAND + ", tk AS (SELECT a, b, min(entry) AS entry FROM cn GROUP BY 1, 2 UNION ALL SELECT t.a, t.b, (SELECT min(n.entry) FROM cn n WHERE n.a = t.a AND n.b = t.b AND n.entry > c.exit) FROM tk t JOIN cn c ON c.a = t.a AND c.b = t.b AND c.entry = t.entry WHERE t.entry IS NOT NULL), ev AS (SELECT cn.* FROM cn JOIN tk USING (a, b, entry))"


def events(v):
    """One open position per pair: an ordered fold of a pair's candidates."""
    return not_overlapping(candidates(v), ["a", "b"], "entry", "exit", ["entry", "exit", "z0", "reason", "sector_id"], touching=False)


@query("wn_spread_events", f"WITH RECURSIVE {TAKEN} SELECT a, b, entry, exit, reason FROM ev")
def wn_spread_events(v):
    return events(v).select("a", "b", "entry", "exit", "reason")


@query("sg_pairs", f"WITH RECURSIVE {TAKEN} SELECT entry AS sidx, CASE WHEN z0 < 0 THEN a ELSE b END AS long_leg, CASE WHEN z0 < 0 THEN b ELSE a END AS short_leg FROM ev")
def sg_pairs(v):
    cheap = F.col("z0") < 0
    return events(v).select(F.col("entry").alias("sidx"), F.when(cheap, F.col("a")).otherwise(F.col("b")).alias("long_leg"), F.when(cheap, F.col("b")).otherwise(F.col("a")).alias("short_leg"))


PNL = TAKEN + ", pn AS (SELECT ev.*, ((CASE WHEN z0 < 0 THEN xa.close / ea.close ELSE xb.close / eb.close END) - (CASE WHEN z0 < 0 THEN xb.close / eb.close ELSE xa.close / ea.close END)) * 50 AS pnl_pct FROM ev JOIN grid_w ea ON ea.instrument_id = a AND ea.sidx = entry JOIN grid_w eb ON eb.instrument_id = b AND eb.sidx = entry JOIN grid_w xa ON xa.instrument_id = a AND xa.sidx = exit JOIN grid_w xb ON xb.instrument_id = b AND xb.sidx = exit)"


def pair_pnl(v):
    price = lambda leg, at, name: v.grid_w.select(F.col("instrument_id").alias(leg), F.col("sidx").alias(at), F.col("close").alias(name))
    e = events(v)
    for leg, at, name in (("a", "entry", "ea"), ("b", "entry", "eb"), ("a", "exit", "xa"), ("b", "exit", "xb")):
        e = e.join(price(leg, at, name), [leg, at])
    move_a, move_b = F.col("xa") / F.col("ea"), F.col("xb") / F.col("eb")
    return e.withColumn("pnl_pct", F.when(F.col("z0") < 0, move_a - move_b).otherwise(move_b - move_a) * 50)


@query("jn_pair_close_pnl", f"WITH RECURSIVE {PNL} SELECT a, b, entry, round(pnl_pct, 6) AS pnl_pct FROM pn")
def jn_pair_close_pnl(v):
    return pair_pnl(v).select("a", "b", "entry", R6(F.col("pnl_pct"), "pnl_pct"))


@query("ag_pair_summary", f"WITH RECURSIVE {PNL} SELECT sector_id, count(*) AS n, count(pnl_pct) AS resolved, round(avg(round(pnl_pct, 6)), 8) AS mean_pct, round(100.0 * avg((pnl_pct > 0)::INT), 6) AS win_pct, round(100.0 * avg((reason = 'reverted')::INT), 6) AS reverted_pct FROM pn GROUP BY 1")
def ag_pair_summary(v):
    p = pair_pnl(v).withColumn("p", F.round("pnl_pct", 6))
    share = lambda e: R6(F.avg(F.expr(e).cast("double")) * 100, "x")
    return p.groupBy("sector_id").agg(F.count("*").alias("n"), F.count("pnl_pct").alias("resolved"), F.round(F.avg("p"), 8).alias("mean_pct"), share("pnl_pct > 0").alias("win_pct"), share("reason = 'reverted'").alias("reverted_pct"))


@query("jn_pair_leg_prices", "WITH c AS (SELECT instrument_id, session, expiry, settle, date_diff('day', session, expiry) AS dte FROM contracts WHERE expiry >= session), r AS (SELECT *, row_number() OVER (PARTITION BY instrument_id, session ORDER BY (dte < 10)::INT, expiry) AS k FROM c), l AS (SELECT instrument_id, expiry, max(session) AS last_session, arg_max(settle, session) AS last_settle FROM c GROUP BY 1, 2) SELECT p.instrument_id, p.session, g.open AS cash_open, r.expiry, r.settle AS short_price, coalesce(r.dte < 10, false) AS near_expiry, CASE WHEN l.last_session < p.session + 28 THEN 'ROLLOVER' ELSE 'HELD' END AS exit_kind, l.last_settle FROM picks p JOIN grid_w g USING (instrument_id, session) LEFT JOIN r ON r.instrument_id = p.instrument_id AND r.session = p.session AND r.k = 1 LEFT JOIN l ON l.instrument_id = r.instrument_id AND l.expiry = r.expiry")
def jn_pair_leg_prices(v):
    c = v.contracts.where("expiry >= session").withColumn("dte", F.datediff("expiry", "session"))
    near = F.col("dte") < 10
    r = c.withColumn("k", F.row_number().over(Window.partitionBy("instrument_id", "session").orderBy(near.cast("int"), "expiry"))).where("k = 1")
    l = c.groupBy("instrument_id", "expiry").agg(F.max("session").alias("last_session"), F.max_by("settle", "session").alias("last_settle"))  # noqa: E741
    p = v.picks.select("instrument_id", "session").join(v.grid_w.select("instrument_id", "session", F.col("open").alias("cash_open")), ["instrument_id", "session"])
    j = p.join(r, ["instrument_id", "session"], "left").join(l, ["instrument_id", "expiry"], "left")
    kind = F.when(F.col("last_session") < F.date_add("session", 28), "ROLLOVER").otherwise("HELD")
    return j.select("instrument_id", "session", "cash_open", "expiry", F.col("settle").alias("short_price"), F.coalesce(near, F.lit(False)).alias("near_expiry"), kind.alias("exit_kind"), "last_settle")
