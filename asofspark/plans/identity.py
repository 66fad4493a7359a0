"""Queries of the bitemporal layer: revisions as of a cutoff, aliases, intervals, calendars and clocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.sweeps import interval_matches, with_next
from .registry import query

CUT = "2024-01-20"
CUTOFF_SQL = "(SELECT min(published_at) + INTERVAL 15 DAY FROM obs)"


def cutoff(v):
    """Fifteen days after the first publication, as a one-row table."""
    return v.obs.agg((F.min("published_at") + F.expr("interval 15 days")).alias("cut"))


def known(v):
    o = v.obs.crossJoin(F.broadcast(cutoff(v)))
    return o.where("published_at <= cut and available_at <= cut")


KEY = ["user_id", "event_type", "day"]
ASOF = f"ao AS (SELECT * FROM obs WHERE published_at <= {CUTOFF_SQL} AND available_at <= {CUTOFF_SQL} QUALIFY row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY published_at DESC, available_at DESC, revision DESC, record_id DESC) = 1)"


def latest(df, key):
    """The latest causal revision per key, by a partially aggregated maximum instead of a sort of every group."""
    order = F.struct("published_at", "available_at", "revision", "record_id")
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_x")).select(*key, "_x.*")


@query("wn_asof_revision", f"WITH {ASOF} SELECT user_id, event_type, day, record_id, revision, value FROM ao")
def wn_asof_revision(v):
    return latest(known(v), KEY).select(*KEY, "record_id", "revision", "value")


@query("wn_revision_chain", """SELECT o.record_id, CASE WHEN o.revision > 1 AND p.record_id IS NULL THEN 'NO_PARENT' WHEN p.published_at >= o.published_at THEN 'NOT_LATER' WHEN p.available_at > o.available_at THEN 'AVAILABLE_BEFORE_PARENT' ELSE 'OK' END AS state
FROM obs o LEFT JOIN obs p ON p.user_id = o.user_id AND p.event_type = o.event_type AND p.day = o.day AND p.revision = o.revision - 1""")
def wn_revision_chain(v):
    w = Window.partitionBy(*KEY).orderBy("revision")
    state = (
        F.when((F.col("revision") > 1) & (F.lag("revision").over(w) != F.col("revision") - 1), "NO_PARENT").when(F.lag("published_at").over(w) >= F.col("published_at"), "NOT_LATER")
        .when(F.lag("available_at").over(w) > F.col("available_at"), "AVAILABLE_BEFORE_PARENT").otherwise("OK")
    )
    return v.obs.select("record_id", state.alias("state"))


@query("wn_event_asof", f"WITH {ASOF}, c AS (SELECT user_id, day, count(DISTINCT round(value, 1)) AS d FROM ao GROUP BY 1, 2) SELECT record_id, day <= {CUTOFF_SQL}::DATE - 1 AS is_effective, d > 1 AS conflict FROM ao JOIN c USING (user_id, day)")
def wn_event_asof(v):
    w = Window.partitionBy("user_id", "day")
    a = latest(known(v), KEY)
    return a.select("record_id", (F.col("day") <= F.date_sub(F.to_date("cut"), 1)).alias("is_effective"), (F.size(F.collect_set(F.round("value", 1)).over(w)) > 1).alias("conflict"))


@query("jn_lifecycle_asof", f"WITH l AS (SELECT user_id, arg_max(event_type, (published_at, record_id)) AS state FROM obs WHERE published_at <= {CUTOFF_SQL} AND event_type IN ('purchase', 'signup', 'error') GROUP BY 1) SELECT u.user_id, coalesce(l.state, 'ACTIVE') AS state FROM (SELECT DISTINCT user_id FROM obs) u LEFT JOIN l USING (user_id)")
def jn_lifecycle_asof(v):
    e = v.obs.crossJoin(F.broadcast(cutoff(v))).where("published_at <= cut and event_type in ('purchase', 'signup', 'error')")
    last = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("published_at", "record_id")).alias("state"))
    return v.obs.select("user_id").distinct().join(last, "user_id", "left").select("user_id", F.coalesce("state", F.lit("ACTIVE")).alias("state"))


@query("px_publish_filter", f"SELECT record_id FROM obs WHERE published_at <= {CUTOFF_SQL}")
def px_publish_filter(v):
    return v.obs.crossJoin(F.broadcast(cutoff(v))).where("published_at <= cut").select("record_id")


@query("ag_conflicts", "WITH c AS (SELECT user_id, day, count(DISTINCT event_type) AS k FROM obs GROUP BY 1, 2) SELECT record_id, CASE WHEN k > 1 THEN 'CONFLICT' ELSE 'SINGLE' END AS state FROM obs JOIN c USING (user_id, day)")
def ag_conflicts(v):
    w = Window.partitionBy("user_id", "day")
    return v.obs.select("record_id", F.when(F.size(F.collect_set("event_type").over(w)) > 1, "CONFLICT").otherwise("SINGLE").alias("state"))


@query("wn_history_latest", "SELECT user_id, event_type, record_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY published_at DESC, record_id DESC) AS age FROM obs QUALIFY age <= 3")
def wn_history_latest(v):
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("published_at"), F.desc("record_id"))
    return v.obs.select("user_id", "event_type", "record_id", F.row_number().over(w).alias("age")).where("age <= 3")


@query("wn_sentiment_upsert", "WITH d AS (SELECT day, round(avg(value), 6) AS score, count(*) AS n FROM obs WHERE revision = 1 GROUP BY day UNION ALL SELECT day, round(avg(value), 6), count(*) FROM obs WHERE day = (SELECT max(day) FROM obs) GROUP BY day), u AS (SELECT day, score FROM d QUALIFY row_number() OVER (PARTITION BY day ORDER BY n DESC) = 1) SELECT day, score, CASE WHEN count(*) OVER (ORDER BY day) >= 10 THEN round(100 * percent_rank() OVER (ORDER BY score), 6) END AS percentile FROM u")
def wn_sentiment_upsert(v):
    agg = lambda df: df.groupBy("day").agg(F.round(F.avg("value"), 6).alias("score"), F.count("*").alias("n"))
    today = v.obs.agg(F.max("day").alias("last"))
    d = agg(v.obs.where("revision = 1")).unionByName(agg(v.obs.crossJoin(F.broadcast(today)).where("day = last")))
    u = d.groupBy("day").agg(F.max_by("score", "n").alias("score"))  # one row per day from here
    rank = F.percent_rank().over(Window.orderBy("score")) * 100
    return u.select("day", "score", F.when(F.count("*").over(Window.orderBy("day")) >= 10, F.round(rank, 6)).alias("percentile"))


# --- aliases and intervals ---------------------------------------------------------------------------------------

ASK = "ask AS (SELECT o_orderkey AS ask_id, o_custkey % 50 AS symbol, (o_orderdate + INTERVAL 3 DAY)::DATE AS d FROM orders)"


def asks(v):
    return v.t("orders").select(F.col("o_orderkey").alias("ask_id"), (F.col("o_custkey") % 50).alias("symbol"), F.date_add(F.to_date("o_orderdate"), 3).alias("d"))


RESOLVE = f"{ASK}, rz AS (SELECT ask_id, count(a.alias_id) AS n, min(a.entity_id) AS entity FROM ask LEFT JOIN aliases a ON a.symbol = ask.symbol AND a.valid_from <= d AND (a.valid_to IS NULL OR d < a.valid_to) GROUP BY ask_id)"


def resolved(v):
    """Matches of requests and alias intervals of their symbol, found by a plane sweep: rows formed are matches."""
    points = asks(v).select(F.col("symbol").alias("key"), F.col("d").alias("at"), F.col("ask_id").alias("point_id"))
    a = v.aliases.select(F.col("symbol").alias("key"), F.col("valid_from").alias("start"), F.col("valid_to").alias("end"), F.col("alias_id").alias("interval_id"), F.col("entity_id").alias("value"))
    found = interval_matches(points, a).groupBy(F.col("point_id").alias("ask_id")).agg(F.count("*").alias("n"), F.min("value").alias("entity"))
    return asks(v).select("ask_id").join(found, "ask_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("jn_alias_interval", f"WITH {RESOLVE} SELECT ask_id, CASE n WHEN 0 THEN 'UNRESOLVED' WHEN 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS state, CASE WHEN n = 1 THEN entity END AS entity FROM rz")
def jn_alias_interval(v):
    state = F.when(F.col("n") == 0, "UNRESOLVED").when(F.col("n") == 1, "RESOLVED").otherwise("AMBIGUOUS")
    return resolved(v).select("ask_id", state.alias("state"), F.when(F.col("n") == 1, F.col("entity")).alias("entity"))


@query("jn_identity_cascade", f"WITH {RESOLVE}, k AS (SELECT o_orderkey AS ask_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + (o_orderkey % 30) * 100 END AS listing, CASE WHEN o_orderkey % 3 = 1 THEN o_custkey END AS isin FROM orders) SELECT k.ask_id, CASE WHEN listing IS NOT NULL THEN 'LISTING' WHEN isin IS NOT NULL THEN 'ISIN' ELSE 'ALIAS' END AS via, CASE WHEN listing IS NOT NULL THEN l.c_custkey WHEN isin IS NOT NULL THEN i.c_custkey WHEN n = 1 THEN entity END AS entity FROM k JOIN rz USING (ask_id) LEFT JOIN customer l ON l.c_custkey = listing LEFT JOIN customer i ON i.c_custkey = isin")
def jn_identity_cascade(v):
    """A key that is supplied decides; one that misses does not fall through to the next."""
    key = F.col("o_orderkey")
    k = v.t("orders").select(key.alias("ask_id"), F.when(key % 3 == 0, F.col("o_custkey") + (key % 30) * 100).alias("listing"), F.when(key % 3 == 1, F.col("o_custkey")).alias("isin"))
    c = lambda name: v.t("customer").select(F.col("c_custkey").alias(name), F.col("c_custkey").alias(f"by_{name}"))
    j = k.join(resolved(v), "ask_id").join(c("listing"), "listing", "left").join(c("isin"), "isin", "left")
    via = F.when(F.col("listing").isNotNull(), "LISTING").when(F.col("isin").isNotNull(), "ISIN").otherwise("ALIAS")
    entity = F.when(F.col("listing").isNotNull(), F.col("by_listing")).when(F.col("isin").isNotNull(), F.col("by_isin")).when(F.col("n") == 1, F.col("entity"))
    return j.select("ask_id", via.alias("via"), entity.alias("entity"))


@query("wn_alias_overlap", "SELECT alias_id, nxt FROM (SELECT alias_id, valid_to, lead(alias_id) OVER w AS nxt, lead(valid_from) OVER w AS nf FROM aliases WINDOW w AS (PARTITION BY symbol ORDER BY valid_from, alias_id)) WHERE nf < valid_to")
def wn_alias_overlap(v):
    a = with_next(v.aliases.select("symbol", "alias_id", "valid_from", "valid_to"), ["symbol"], ["valid_from", "alias_id"], {"nxt": "alias_id", "nf": "valid_from"})
    return a.where("nf < valid_to").select("alias_id", "nxt")


@query("ag_unresolved_identity", "SELECT c_custkey AS entity_id, count(alias_id) AS n_aliases FROM customer LEFT JOIN aliases ON entity_id = c_custkey WHERE c_acctbal < 0 GROUP BY 1")
def ag_unresolved_identity(v):
    a = v.aliases.groupBy("entity_id").agg(F.count("*").alias("n"))
    c = v.t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("entity_id"))
    return c.join(a, "entity_id", "left").select("entity_id", F.coalesce("n", F.lit(0)).alias("n_aliases"))


@query("ag_recon_identity", "SELECT 'symbol_many_entities' AS check_name, count(*) AS n FROM (SELECT symbol FROM aliases GROUP BY 1 HAVING count(DISTINCT entity_id) > 1) UNION ALL SELECT 'entity_many_symbols', count(*) FROM (SELECT entity_id FROM aliases GROUP BY 1 HAVING count(DISTINCT symbol) > 1) UNION ALL SELECT 'without_alias', count(*) FROM customer ANTI JOIN aliases ON entity_id = c_custkey")
def ag_recon_identity(v):
    many = lambda a, b, name: v.aliases.groupBy(a).agg(F.countDistinct(b).alias("k")).where("k > 1").agg(F.lit(name).alias("check_name"), F.count("*").alias("n"))
    none = v.t("customer").join(v.aliases, F.col("entity_id") == F.col("c_custkey"), "left_anti").agg(F.lit("without_alias").alias("check_name"), F.count("*").alias("n"))
    return many("symbol", "entity_id", "symbol_many_entities").unionByName(many("entity_id", "symbol", "entity_many_symbols")).unionByName(none)


SCHED = "sch AS (SELECT * FROM (VALUES ('1995-01-01'::DATE, '1997-07-01'::DATE, 0.30), ('1997-07-01'::DATE, '1999-01-01'::DATE, 0.25), ('1998-12-01'::DATE, '2000-06-01'::DATE, 0.20), ('2000-09-01'::DATE, NULL, 0.15)) t(valid_from, valid_to, rate))"


def schedule(v):
    rows = [("1995-01-01", "1997-07-01", 0.30), ("1997-07-01", "1999-01-01", 0.25), ("1998-12-01", "2000-06-01", 0.20), ("2000-09-01", None, 0.15)]
    return v.spark.createDataFrame(rows, "valid_from string, valid_to string, rate double").select(F.to_date("valid_from").alias("valid_from"), F.to_date("valid_to").alias("valid_to"), "rate")


@query("jn_cost_schedule", f"WITH {SCHED} SELECT c.session, CASE count(rate) WHEN 0 THEN 'NONE' WHEN 1 THEN 'ONE' ELSE 'SEVERAL' END AS state, CASE WHEN count(rate) = 1 THEN min(rate)::DOUBLE END AS rate FROM cal_d c LEFT JOIN sch ON valid_from <= c.session AND (valid_to IS NULL OR c.session < valid_to) GROUP BY c.session")
def jn_cost_schedule(v):
    """The schedule is a short table of rules; each date meets it in a broadcast."""
    s = v.cal_d.join(F.broadcast(schedule(v)), F.expr("valid_from <= session and (valid_to is null or session < valid_to)"), "left")
    n = F.count("rate")
    return s.groupBy("session").agg(F.when(n == 0, "NONE").when(n == 1, "ONE").otherwise("SEVERAL").alias("state"), F.when(n == 1, F.min("rate")).alias("rate"))


@query("wn_schedule_gaps", f"WITH {SCHED} SELECT e AS gap_from, valid_from AS gap_to FROM (SELECT valid_from, max(coalesce(valid_to, DATE '9999-12-31')) OVER (ORDER BY valid_from ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM sch UNION ALL SELECT valid_from, e FROM (SELECT session AS valid_from, lag(session + 1) OVER (ORDER BY session) AS e FROM cal_d)) WHERE e < valid_from")
def wn_schedule_gaps(v):
    """Stretches that no interval covers: of the schedule, and of the sessions taken as one-day intervals."""
    gap = lambda df: df.withColumn("gap_from", F.max(F.coalesce("valid_to", F.lit("9999-12-31").cast("date"))).over(Window.orderBy("valid_from").rowsBetween(Window.unboundedPreceding, -1))).where("gap_from < valid_from").select("gap_from", F.col("valid_from").alias("gap_to"))
    days = v.cal_d.select(F.col("session").alias("valid_from"), F.date_add("session", 1).alias("valid_to"))
    return gap(schedule(v).select("valid_from", "valid_to")).unionByName(gap(days))


# --- calendar and clocks -----------------------------------------------------------------------------------------


@query("jn_settlement", "WITH s AS (SELECT session, row_number() OVER (ORDER BY session) AS ord FROM cal_d WHERE dayofweek(session) <> 6), t AS (SELECT c.session, CASE WHEN c.session < DATE '1998-01-01' THEN 3 ELSE 2 END AS lag, (SELECT count(*) FROM s WHERE s.session <= c.session) AS o FROM cal_d c) SELECT t.session, s.session AS settles, CASE WHEN s.session IS NULL THEN 'RIGHT_CENSORED' ELSE 'SETTLED' END AS state FROM t LEFT JOIN s ON s.ord = t.o + t.lag")
def jn_settlement(v):
    w = Window.orderBy("session")  # one row per session
    open_ = F.dayofweek("session") != 7
    c = v.cal_d.select("session", F.sum(open_.cast("int")).over(w).alias("o"), open_.alias("eligible"))
    s = c.where("eligible").select(F.col("o").alias("ord"), F.col("session").alias("settles"))
    t = c.withColumn("ord", F.col("o") + F.when(F.col("session") < "1998-01-01", 3).otherwise(2))
    return t.join(s, "ord", "left").select("session", "settles", F.when(F.col("settles").isNull(), "RIGHT_CENSORED").otherwise("SETTLED").alias("state"))


@query("jn_effective_session", "SELECT f.filing_id, min(c.session) AS session, bool_or(c.session = f.filing_date) AS exact FROM filings f JOIN cal_w c ON c.session >= f.filing_date GROUP BY f.filing_id")
def jn_effective_session(v):
    from .features import next_session

    n = next_session(v.filings.select("filing_id", "filing_date"), v.cal_w).join(v.cal_w, "sidx")
    return n.select("filing_id", "session", (F.col("session") == F.col("filing_date")).alias("exact"))


@query("jn_resolve_session", "SELECT f.filing_id, (SELECT session FROM cal_d WHERE sidx = n.sidx + 2) AS third_session, (SELECT session FROM cal_d WHERE sidx = n.sidx - 1) AS previous_session FROM filings f JOIN (SELECT f2.filing_id, min(c.sidx) AS sidx FROM filings f2 JOIN cal_d c ON c.session >= f2.filing_date GROUP BY 1) n USING (filing_id)")
def jn_resolve_session(v):
    from .features import next_session

    n = next_session(v.filings.select("filing_id", "filing_date"), v.cal_d).select("filing_id", "sidx")
    at = lambda k, name: v.cal_d.select((F.col("sidx") - k).alias("sidx"), F.col("session").alias(name))
    return n.join(at(2, "third_session"), "sidx", "left").join(at(-1, "previous_session"), "sidx", "left").select("filing_id", "third_session", "previous_session")


@query("wn_calendar_asof", f"WITH k AS (SELECT day, count(DISTINCT record_id) AS all_rows, count(DISTINCT record_id) FILTER (WHERE available_at <= {CUTOFF_SQL}) AS known_rows FROM obs GROUP BY day) SELECT day, known_rows, all_rows, CASE WHEN known_rows = 0 THEN 'UNKNOWN' WHEN known_rows < all_rows THEN 'PROVISIONAL' ELSE 'FINAL' END AS state FROM k")
def wn_calendar_asof(v):
    k = v.obs.crossJoin(F.broadcast(cutoff(v))).groupBy("day").agg(F.count("*").alias("all_rows"), F.count_if(F.expr("available_at <= cut")).alias("known_rows"))
    return k.select("day", "known_rows", "all_rows", F.when(F.col("known_rows") == 0, "UNKNOWN").when(F.expr("known_rows < all_rows"), "PROVISIONAL").otherwise("FINAL").alias("state"))


@query("wn_session_overlap", "SELECT record_id FROM (SELECT record_id, available_at, lead(published_at) OVER (PARTITION BY user_id ORDER BY published_at, record_id) AS nxt FROM obs) WHERE nxt < available_at")
def wn_session_overlap(v):
    w = Window.partitionBy("user_id").orderBy("published_at", "record_id")
    return v.obs.withColumn("nxt", F.lead("published_at").over(w)).where("nxt < available_at").select("record_id")


@query("px_session_clock", "SELECT session, session + INTERVAL '9 hours' AS pre_open, session + INTERVAL '9 hours 15 minutes' AS opens, session + INTERVAL '15 hours 30 minutes' AS closes, session + INTERVAL '16 hours' AS post_close FROM cal_d")
def px_session_clock(v):
    at = lambda x, name: (F.col("session").cast("timestamp") + F.expr(f"interval {x}")).alias(name)
    return v.cal_d.select("session", at("9 hours", "pre_open"), at("9 hours 15 minutes", "opens"), at("15 hours 30 minutes", "closes"), at("16 hours", "post_close"))


@query("px_market_session", "SELECT event_id, CASE WHEN isodow(ts) > 5 THEN 'NON_TRADING' WHEN extract(hour FROM ts) * 60 + extract(minute FROM ts) < 555 THEN 'PRE_OPEN' WHEN extract(hour FROM ts) * 60 + extract(minute FROM ts) < 930 THEN 'OPEN' ELSE 'POST_CLOSE' END AS state FROM events")
def px_market_session(v):
    m = F.hour("ts") * 60 + F.minute("ts")
    return v.t("events").select("event_id", F.when(F.weekday("ts") > 4, "NON_TRADING").when(m < 555, "PRE_OPEN").when(m < 930, "OPEN").otherwise("POST_CLOSE").alias("state"))


@query("px_availability", "SELECT f.filing_id, CASE WHEN f.filing_id % 4 = 0 THEN f.filing_ts + INTERVAL 30 MINUTE ELSE n.session + INTERVAL '9 hours 15 minutes' END AS available_at FROM filings f JOIN (SELECT f2.filing_id, min(c.session) AS session FROM filings f2 JOIN cal_d c ON c.session > f2.filing_date GROUP BY 1) n USING (filing_id)")
def px_availability(v):
    """Publications dated to the day only are known at the next session's open, others half an hour later."""
    from .features import next_session

    f = v.filings.select("filing_id", "filing_ts", F.date_add("filing_date", 1).alias("filing_date"))
    n = next_session(f, v.cal_d).join(v.cal_d, "sidx")
    exact = F.col("filing_ts") + F.expr("interval 30 minutes")
    return n.select("filing_id", F.when(F.col("filing_id") % 4 == 0, exact).otherwise(F.col("session").cast("timestamp") + F.expr("interval 9 hours 15 minutes")).alias("available_at"))


@query("ag_session_conflict_clock", "SELECT user_id, count(DISTINCT day) AS days, count(DISTINCT extract(hour FROM published_at)) AS hours, count(DISTINCT day) = 1 AS shared FROM obs GROUP BY user_id")
def ag_session_conflict_clock(v):
    return v.obs.groupBy("user_id").agg(F.countDistinct("day").alias("days"), F.countDistinct(F.hour("published_at")).alias("hours"), (F.countDistinct("day") == 1).alias("shared"))


# --- actions, terminal values ------------------------------------------------------------------------------------

EV = "ev AS (SELECT instrument_id, sidx AS effective, CASE WHEN (sidx + instrument_id) % 5 = 0 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS factor, CASE (sidx + instrument_id) % 3 WHEN 0 THEN 'SPLIT' WHEN 1 THEN 'DIVIDEND' ELSE 'BONUS' END AS type FROM cal_w CROSS JOIN (SELECT DISTINCT instrument_id FROM bars_w) WHERE (instrument_id * 31 + sidx) % 97 = 0)"


def action_events(v):
    g = v.grid_w.where((F.col("instrument_id") * 31 + F.col("sidx")) % 97 == 0)
    k = F.col("sidx") + F.col("instrument_id")
    return g.select("instrument_id", F.col("sidx").alias("effective"), F.when(k % 5 == 0, 0.5).otherwise(0.9).alias("factor"), F.when(k % 3 == 0, "SPLIT").when(k % 3 == 1, "DIVIDEND").otherwise("BONUS").alias("type"))


@query("jn_adjusted_view", f"WITH {EV}, f AS (SELECT g.instrument_id, g.sidx, exp(coalesce(sum(ln(factor)), 0)) AS f FROM grid_w g LEFT JOIN ev ON ev.instrument_id = g.instrument_id AND g.sidx < effective GROUP BY 1, 2) SELECT g.instrument_id, g.sidx, round(ln(close * f), 8) AS log_close, round(ln(volume / f), 8) AS log_volume FROM grid_w g JOIN f USING (instrument_id, sidx)")
def jn_adjusted_view(v):
    """The product of all later factors is a reverse running sum of logs over the grid: no range join."""
    w = Window.partitionBy("instrument_id").orderBy(F.desc("sidx")).rowsBetween(Window.unboundedPreceding, -1)
    g = v.grid_w.join(action_events(v).withColumnRenamed("effective", "sidx"), ["instrument_id", "sidx"], "left")
    g = g.withColumn("f", F.exp(F.coalesce(F.sum(F.ln("factor")).over(w), F.lit(0.0))))
    return g.select("instrument_id", "sidx", F.round(F.ln(F.col("close") * F.col("f")), 8).alias("log_close"), F.round(F.ln(F.col("volume") / F.col("f")), 8).alias("log_volume"))


@query("jn_action_lookup", f"WITH {EV}, m AS (SELECT instrument_id, sidx, close / lag(close) OVER (PARTITION BY instrument_id ORDER BY sidx) - 1 AS move FROM grid_w), a AS (SELECT instrument_id, effective AS sidx, count(DISTINCT type) AS k, min(type) AS type FROM (SELECT * FROM ev UNION ALL SELECT instrument_id, effective, factor, 'RIGHTS' FROM ev WHERE effective % 4 = 0) GROUP BY 1, 2) SELECT m.instrument_id, m.sidx, CASE WHEN k > 1 THEN 'AMBIGUOUS' WHEN k = 1 THEN type WHEN abs(move) >= 0.35 THEN 'UNRESOLVED' ELSE 'ORDINARY' END AS class FROM m LEFT JOIN a USING (instrument_id, sidx) WHERE move IS NOT NULL")
def jn_action_lookup(v):
    from ..operators.features import BY

    e = action_events(v)
    e = e.unionByName(e.where("effective % 4 = 0").withColumn("type", F.lit("RIGHTS")))
    a = e.groupBy("instrument_id", F.col("effective").alias("sidx")).agg(F.countDistinct("type").alias("k"), F.min("type").alias("type"))
    m = v.grid_w.select("instrument_id", "sidx", (F.col("close") / F.lag("close").over(BY()) - 1).alias("move")).where("move is not null")
    kind = F.when(F.col("k") > 1, "AMBIGUOUS").when(F.col("k") == 1, F.col("type")).when(F.abs("move") >= 0.35, "UNRESOLVED").otherwise("ORDINARY")
    return m.join(a, ["instrument_id", "sidx"], "left").select("instrument_id", "sidx", kind.alias("class"))


@query("wn_event_rules", "SELECT record_id, concat_ws('|', CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN 'UNKNOWN_TYPE' END, CASE WHEN value < 10 THEN 'LOW_VALUE' END, CASE WHEN record_id % 13 = 0 THEN 'MISSING_RATIO' END, CASE WHEN available_at < published_at THEN 'AVAILABLE_BEFORE_PUBLISHED' END) AS flags FROM obs")
def wn_event_rules(v):
    rules = {"UNKNOWN_TYPE": "event_type not in ('click', 'view', 'purchase', 'signup')", "LOW_VALUE": "value < 10", "MISSING_RATIO": "record_id % 13 = 0", "AVAILABLE_BEFORE_PUBLISHED": "available_at < published_at"}
    flags = F.array_compact(F.array(*[F.when(F.expr(e), n) for n, e in rules.items()]))
    return v.obs.select("record_id", F.array_join(flags, "|").alias("flags"))


TERM = "tm AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'CASH' WHEN 1 THEN 'SHARE' WHEN 2 THEN 'MIXED' ELSE 'ZERO' END AS kind, (c_custkey % 7) * 1.5::DOUBLE AS cash, (c_custkey % 5) / 4.0::DOUBLE AS ratio, c_custkey % 30 AS successor, 100 AS quantity FROM customer), lp AS (SELECT instrument_id AS successor, arg_max(close, session) AS price FROM bars_w GROUP BY 1)"


@query("jn_terminal_value", f"WITH {TERM} SELECT id, kind, CASE WHEN kind IN ('SHARE', 'MIXED') AND price IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS state, CASE WHEN kind = 'CASH' THEN round(quantity * cash, 4) WHEN kind = 'ZERO' THEN 0 WHEN price IS NOT NULL THEN round(floor(quantity * ratio) * price + (quantity * ratio - floor(quantity * ratio)) * price + CASE WHEN kind = 'MIXED' THEN quantity * cash ELSE 0 END, 4) END AS proceeds FROM tm LEFT JOIN lp USING (successor)")
def jn_terminal_value(v):
    k = F.col("c_custkey")
    kind = F.when(k % 4 == 0, "CASH").when(k % 4 == 1, "SHARE").when(k % 4 == 2, "MIXED").otherwise("ZERO")
    tm = v.t("customer").select(k.alias("id"), kind.alias("kind"), ((k % 7) * 1.5).alias("cash"), ((k % 5) / 4.0).alias("ratio"), (k % 30).alias("successor"), F.lit(100).alias("quantity"))
    lp = v.bars_w.groupBy(F.col("instrument_id").alias("successor")).agg(F.max_by("close", "session").alias("price"))
    shares, whole = F.col("quantity") * F.col("ratio"), F.floor(F.col("quantity") * F.col("ratio"))
    paid = whole * F.col("price") + (shares - whole) * F.col("price") + F.when(F.col("kind") == "MIXED", F.col("quantity") * F.col("cash")).otherwise(0)
    got = F.when(F.col("kind") == "CASH", F.round(F.col("quantity") * F.col("cash"), 4)).when(F.col("kind") == "ZERO", F.lit(0.0)).when(F.col("price").isNotNull(), F.round(paid, 4))
    state = F.when(F.col("kind").isin("SHARE", "MIXED") & F.col("price").isNull(), "UNRESOLVED").otherwise("RESOLVED")
    return tm.join(lp, "successor", "left").select("id", "kind", state.alias("state"), got.alias("proceeds"))


@query("jn_terminal_outcome", "SELECT o.instrument_id, o.sidx, CASE WHEN o.status = 'RIGHT_CENSORED' AND o.instrument_id % 2 = 0 THEN 'RESOLVED_TERMINAL' ELSE o.status END AS status, coalesce(o.net_pct, CASE WHEN o.status = 'RIGHT_CENSORED' AND o.instrument_id % 2 = 0 THEN -100.0 + o.instrument_id END) AS net_pct FROM outcomes o")
def jn_terminal_outcome(v):
    done = v.bars_w.where("instrument_id % 2 = 0").select("instrument_id").distinct().withColumn("terminal_pct", F.lit(-100.0) + F.col("instrument_id"))
    o = v.outcomes.join(done, "instrument_id", "left")
    ended = (F.col("status") == "RIGHT_CENSORED") & F.col("terminal_pct").isNotNull()
    return o.select("instrument_id", "sidx", F.when(ended, "RESOLVED_TERMINAL").otherwise(F.col("status")).alias("status"), F.coalesce("net_pct", F.when(ended, F.col("terminal_pct"))).alias("net_pct"))


@query("jn_successor_check", "WITH b AS (SELECT entity_id, min(valid_from) AS born FROM aliases GROUP BY 1) SELECT a.alias_id, CASE WHEN b.born IS NULL THEN 'NO_SUCCESSOR' ELSE 'BEFORE_CREATION' END AS violation FROM aliases a LEFT JOIN b ON b.entity_id = a.entity_id + 1 WHERE b.born IS NULL OR a.valid_from < b.born")
def jn_successor_check(v):
    born = v.aliases.groupBy((F.col("entity_id") - 1).alias("entity_id")).agg(F.min("valid_from").alias("born"))
    j = v.aliases.join(born, "entity_id", "left").where("born is null or valid_from < born")
    return j.select("alias_id", F.when(F.col("born").isNull(), "NO_SUCCESSOR").otherwise("BEFORE_CREATION").alias("violation"))


@query("px_missing_state", "SELECT record_id, CASE event_type WHEN 'error' THEN 'SUSPENDED' WHEN 'signup' THEN 'NOT_YET_LISTED' WHEN 'purchase' THEN 'TERMINATED' ELSE CASE WHEN day = (SELECT max(day) FROM obs) THEN 'DATASET_ENDED' ELSE 'UNEXPLAINED' END END AS state FROM obs")
def px_missing_state(v):
    last = v.obs.agg(F.max("day").alias("last"))
    kind = F.when(F.col("event_type") == "error", "SUSPENDED").when(F.col("event_type") == "signup", "NOT_YET_LISTED").when(F.col("event_type") == "purchase", "TERMINATED").when(F.col("day") == F.col("last"), "DATASET_ENDED").otherwise("UNEXPLAINED")
    return v.obs.crossJoin(F.broadcast(last)).select("record_id", kind.alias("state"))


@query("px_lifecycle_map", "SELECT session, count(*) AS n, CASE WHEN session < DATE '1999-01-01' THEN CASE WHEN avg(excess_pct) > 0 THEN 'CANDIDATE' ELSE 'REJECTED' END ELSE CASE WHEN avg(excess_pct) > 0 THEN 'CONFIRMED' ELSE 'RETIRED' END END AS lifecycle FROM outcomes WHERE excess_pct IS NOT NULL GROUP BY session")
def px_lifecycle_map(v):
    good = F.avg("excess_pct") > 0
    state = F.when(F.col("session") < "1999-01-01", F.when(good, "CANDIDATE").otherwise("REJECTED")).otherwise(F.when(good, "CONFIRMED").otherwise("RETIRED"))
    return v.outcomes.where("excess_pct is not null").groupBy("session").agg(F.count("*").alias("n"), state.alias("lifecycle"))
