"""Market-shaped views over the given tables, each as a DataFrame and as SQL for the oracle.

Instruments are supplier nations, sessions are days or weeks of shipping, prices are unit prices. All rules that
derive a case (overlaps, restatements, gaps) are arithmetic on keys, so both engines see the same rows.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def t(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def fills(self) -> DataFrame:
        s = self.t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("instrument_id"))
        # suppliers are a dimension: AQE broadcasts them while they are under the threshold, and shuffles beyond it
        out = self.t("lineitem").join(s, "l_suppkey")
        return out.withColumns({
            "day": F.to_date("l_shipdate"), "week": F.to_date(F.date_trunc("week", "l_shipdate")),
            "price": F.col("l_extendedprice") / F.col("l_quantity"),
        })

    def bars(self, period: str) -> DataFrame:
        """One row per instrument and session: open, high, low, close, volume, turnover."""
        order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        return self.fills.groupBy("instrument_id", F.col(period).alias("session")).agg(
            F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", order).alias("close"), F.sum("l_quantity").alias("volume"),
            F.round(F.sum("l_extendedprice"), 2).alias("turnover"),
        )

    @cached_property
    def bars_w(self) -> DataFrame:
        return self.bars("week")

    @cached_property
    def bars_d(self) -> DataFrame:
        return self.bars("day")

    def calendar(self, period: str) -> DataFrame:
        # sessions of a calendar are few (one row per day at most), whatever the number of bars
        days = self.fills.select(F.col(period).alias("session")).distinct()
        return days.withColumn("sidx", F.row_number().over(Window.orderBy("session")))

    @cached_property
    def cal_w(self) -> DataFrame:
        return self.calendar("week")

    @cached_property
    def cal_d(self) -> DataFrame:
        return self.calendar("day")

    def grid(self, bars: DataFrame, calendar: DataFrame) -> DataFrame:
        """Every session for every instrument: bars where there are any, else nulls."""
        names = bars.select("instrument_id").distinct()
        return names.crossJoin(calendar).join(bars, ["instrument_id", "session"], "left")

    @cached_property
    def grid_w(self) -> DataFrame:
        return self.grid(self.bars_w, self.cal_w)

    @cached_property
    def grid_d(self) -> DataFrame:
        return self.grid(self.bars_d, self.cal_d)

    @cached_property
    def bench_w(self) -> DataFrame:
        return self.bars_w.groupBy("session").agg(F.round(F.sum("turnover") / F.sum("volume"), 6).alias("bench"))

    @cached_property
    def sector(self) -> DataFrame:
        return self.t("nation").select(F.col("n_nationkey").alias("instrument_id"), F.col("n_regionkey").alias("sector_id"))

    @cached_property
    def filings(self) -> DataFrame:
        return self.t("orders").select(
            F.col("o_orderkey").alias("filing_id"), F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").cast("timestamp").alias("filing_ts"),
            F.to_date("o_orderdate").alias("filing_date"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("period_end"),
            F.col("o_totalprice").alias("value"), F.col("o_orderpriority").rlike("^[12]").alias("consolidated"),
        )

    @cached_property
    def obs(self) -> DataFrame:
        key = Window.partitionBy("user_id", "event_type", "day").orderBy("published_at", "record_id")
        rows = self.t("events").select(
            F.col("event_id").alias("record_id"), "user_id", "event_type", F.to_date("ts").alias("day"), F.col("ts").cast("timestamp").alias("published_at"), "value",
            F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) + (F.col("event_id") % 7) * 3600).alias("available_at"),
        )
        return rows.withColumn("revision", F.row_number().over(key))

    @cached_property
    def aliases(self) -> DataFrame:
        from ..operators.sweeps import with_next

        rows = self.t("orders").select(
            F.col("o_orderkey").alias("alias_id"), (F.col("o_custkey") % 50).alias("symbol"), F.col("o_custkey").alias("entity_id"), F.to_date("o_orderdate").alias("valid_from")
        )
        ends = F.col("ends")
        rows = with_next(rows, ["symbol"], ["valid_from", "alias_id"], {"ends": "valid_from"})
        return rows.withColumn("valid_to", F.when(F.col("alias_id") % 97 == 0, F.date_add(ends, 5)).otherwise(ends)).drop("ends")

    @cached_property
    def contracts(self) -> DataFrame:
        expiry = F.last_day(F.add_months("week", F.col("l_linenumber").cast("int") % 3))
        return self.fills.groupBy("instrument_id", F.col("week").alias("session"), expiry.alias("expiry")).agg(
            F.max("price").alias("settle"), F.min("price").alias("open_"), F.sum("l_quantity").alias("oi")
        )

    @cached_property
    def journal(self) -> DataFrame:
        debit = F.col("l_extendedprice").cast("decimal(18,2)")
        off = (F.col("l_orderkey") % 11 == 0) & (F.col("l_linenumber") == 1)
        return self.t("lineitem").select(
            F.col("l_orderkey").alias("event_id"), F.col("l_returnflag").alias("account"), debit.alias("debit"),
            F.when(off, debit + F.lit("0.01").cast("decimal(18,2)")).otherwise(debit).cast("decimal(18,2)").alias("credit"),
        )

    @cached_property
    def picks(self) -> DataFrame:
        """Decisions that feed labelling and evidence: each week the fifth of the instruments (one at least) with the
        highest return from 56 to 4 sessions before."""
        from ..operators import features as fx

        ranks = self.grid_w.select("instrument_id", "session", "sidx", F.round(fx.trailing_return(F.col("close"), 52, 4), 9).alias("ret"))
        return fx.rank_select(ranks, "ret", 0.2).where("selected").select("instrument_id", "session", "sidx")

    @cached_property
    def outcomes(self) -> DataFrame:
        from ..operators.labels import fixed_horizon

        return fixed_horizon(self.picks, self.grid_w, self.bench_w, horizon=4)

    @cached_property
    def trades(self) -> DataFrame:
        """Resolved and unresolved outcomes in the shape of a trade list."""
        o = self.outcomes
        done = F.col("status") == "RESOLVED"
        reason = F.when(~done, "unresolved").when((F.col("sidx") + F.col("instrument_id")) % 3 == 0, "stop").when((F.col("sidx") + F.col("instrument_id")) % 3 == 1, "target").otherwise("expiry")
        return o.select("instrument_id", "session", "sidx", "entry_session", "exit_session", "entry_open", "exit_open", "gross_pct", "cost_pct", "net_pct", "bench_pct", "excess_pct", F.when(done, F.datediff("exit_session", "entry_session")).alias("held_days"), reason.alias("exit_reason"))


def _bars_sql(period: str) -> str:
    order = "ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
    return f"""SELECT instrument_id, {period} AS session, first(price {order}) AS open, max(price) AS high, min(price) AS low,
      last(price {order}) AS close, sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS turnover
      FROM fills GROUP BY instrument_id, {period}"""


def _grid_sql(x: str) -> str:
    return f"""SELECT n.instrument_id, c.session, c.sidx, b.open, b.high, b.low, b.close, b.volume, b.turnover
      FROM (SELECT DISTINCT instrument_id FROM bars_{x}) n CROSS JOIN cal_{x} c LEFT JOIN bars_{x} b ON b.instrument_id = n.instrument_id AND b.session = c.session"""


COST_PCT = 0.25

VIEW_SQL = {
    "fills": """SELECT l.*, s.s_nationkey AS instrument_id, l_shipdate::DATE AS day, date_trunc('week', l_shipdate)::DATE AS week,
      l_extendedprice / l_quantity AS price FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey""",
    "bars_w": _bars_sql("week"),
    "bars_d": _bars_sql("day"),
    "cal_w": "SELECT session, row_number() OVER (ORDER BY session)::INT AS sidx FROM (SELECT DISTINCT week AS session FROM fills)",
    "cal_d": "SELECT session, row_number() OVER (ORDER BY session)::INT AS sidx FROM (SELECT DISTINCT day AS session FROM fills)",
    "grid_w": _grid_sql("w"),
    "grid_d": _grid_sql("d"),
    "bench_w": "SELECT session, round(sum(turnover) / sum(volume), 6) AS bench FROM bars_w GROUP BY session",
    "sector": "SELECT n_nationkey AS instrument_id, n_regionkey AS sector_id FROM nation",
    "filings": """SELECT o_orderkey AS filing_id, o_custkey AS entity_id, o_orderdate::TIMESTAMP AS filing_ts, o_orderdate::DATE AS filing_date,
      date_trunc('quarter', o_orderdate)::DATE AS period_end, o_totalprice AS value, substr(o_orderpriority, 1, 1) IN ('1', '2') AS consolidated FROM orders""",
    "obs": """SELECT event_id AS record_id, user_id, event_type, ts::DATE AS day, ts AS published_at, value,
      date_trunc('second', ts) + to_hours((event_id % 7)::INT) AS available_at,
      row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts, event_id) AS revision FROM events""",
    "aliases": """SELECT alias_id, symbol, entity_id, valid_from, CASE WHEN alias_id % 97 = 0 THEN (e + 5)::DATE ELSE e END AS valid_to FROM (
      SELECT o_orderkey AS alias_id, o_custkey % 50 AS symbol, o_custkey AS entity_id, o_orderdate::DATE AS valid_from,
      lead(o_orderdate::DATE) OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate::DATE, o_orderkey) AS e FROM orders)""",
    "contracts": """SELECT instrument_id, week AS session, last_day(week + to_months((l_linenumber % 3)::INT))::DATE AS expiry,
      max(price) AS settle, min(price) AS open_, sum(l_quantity) AS oi FROM fills GROUP BY ALL""",
    "journal": """SELECT l_orderkey AS event_id, l_returnflag AS account, l_extendedprice::DECIMAL(18,2) AS debit,
      (CASE WHEN l_orderkey % 11 = 0 AND l_linenumber = 1 THEN l_extendedprice::DECIMAL(18,2) + 0.01 ELSE l_extendedprice::DECIMAL(18,2) END)::DECIMAL(18,2) AS credit FROM lineitem""",
    "picks": """SELECT instrument_id, session, sidx FROM (SELECT instrument_id, session, sidx,
      round(CASE WHEN lag(close, 56) OVER w > 0 THEN lag(close, 4) OVER w / lag(close, 56) OVER w - 1 END, 9) AS ret
      FROM grid_w WINDOW w AS (PARTITION BY instrument_id ORDER BY sidx)) WHERE ret IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY sidx ORDER BY ret DESC, instrument_id) <= greatest(1, ceil(count(*) OVER (PARTITION BY sidx) * 0.2))""",
    "outcomes": f"""SELECT p.instrument_id, p.session, p.sidx, e.session AS entry_session, x.session AS exit_session, e.open AS entry_open, x.open AS exit_open,
      CASE WHEN ce.session IS NULL OR cx.session IS NULL THEN 'RIGHT_CENSORED' WHEN e.open IS NULL THEN 'MISSING_ENTRY'
           WHEN x.open IS NULL THEN 'MISSING_EXIT' WHEN e.open <= 0 OR x.open <= 0 THEN 'UNFILLABLE_PRICE' ELSE 'RESOLVED' END AS status,
      CASE WHEN e.open > 0 AND x.open > 0 THEN round((x.open / e.open - 1) * 100, 6) END AS gross_pct,
      CASE WHEN e.open > 0 AND x.open > 0 THEN {COST_PCT}::DOUBLE END AS cost_pct,
      CASE WHEN e.open > 0 AND x.open > 0 THEN round((x.open / e.open - 1) * 100 - {COST_PCT}, 6) END AS net_pct,
      CASE WHEN e.open > 0 AND x.open > 0 THEN round((bx.bench / be.bench - 1) * 100, 6) END AS bench_pct,
      CASE WHEN e.open > 0 AND x.open > 0 THEN round((x.open / e.open - 1) * 100 - {COST_PCT} - (bx.bench / be.bench - 1) * 100, 6) END AS excess_pct
      FROM picks p LEFT JOIN cal_w ce ON ce.sidx = p.sidx + 1 LEFT JOIN cal_w cx ON cx.sidx = p.sidx + 5
      LEFT JOIN grid_w e ON e.instrument_id = p.instrument_id AND e.sidx = p.sidx + 1
      LEFT JOIN grid_w x ON x.instrument_id = p.instrument_id AND x.sidx = p.sidx + 5
      LEFT JOIN bench_w be ON be.session = e.session LEFT JOIN bench_w bx ON bx.session = x.session""",
    "trades": """SELECT instrument_id, session, sidx, entry_session, exit_session, entry_open, exit_open, gross_pct, cost_pct, net_pct, bench_pct, excess_pct,
      CASE WHEN status = 'RESOLVED' THEN date_diff('day', entry_session, exit_session) END AS held_days,
      CASE WHEN status <> 'RESOLVED' THEN 'unresolved' WHEN (sidx + instrument_id) % 3 = 0 THEN 'stop' WHEN (sidx + instrument_id) % 3 = 1 THEN 'target' ELSE 'expiry' END AS exit_reason
      FROM outcomes""",
}


def with_views(body: str) -> str:
    """body with the views it names (and those that these name) put before it as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEW_SQL:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEW_SQL[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    ctes = [f"{n} AS ({VIEW_SQL[n]})" for n in needed]
    body = body.strip()
    if re.match(r"(?i)with\s+recursive\b", body):
        head, body = "WITH RECURSIVE ", body[len("WITH RECURSIVE") :].strip()
    elif re.match(r"(?i)with\b", body):
        head, body = "WITH ", body[4:].strip()
    else:
        return (("WITH " + ",\n".join(ctes) + "\n") if ctes else "") + body
    return head + ",\n".join([*ctes, body])
