"""Queries of data-quality audits and reconciliations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators.features import BY, over_last
from ..operators.selection import exact_quantiles
from ..sources.readers import staged
from .registry import query

R6 = lambda c, name: F.round(c, 6).alias(name)
cnt = lambda e: F.count_if(F.expr(e))

CHECKS = {
    "non_positive": "close <= 0", "range_inverted": "high < low", "open_outside": "open > high or open < low",
    "close_outside": "close > high or close < low", "zero_volume": "volume = 0", "flat_bar": "high = low",
}


def _long_checks_sql() -> str:
    return " UNION ALL ".join(f"SELECT instrument_id, '{k}' AS check_name, sum(({e})::INT)::BIGINT AS n FROM bars_d GROUP BY 1" for k, e in CHECKS.items())


def checked(v):
    g = v.bars_d.groupBy("instrument_id").agg(*[cnt(e).alias(k) for k, e in CHECKS.items()])
    return g.unpivot("instrument_id", list(CHECKS), "check_name", "n")


@query("ag_quality_checks", f"WITH q AS ({_long_checks_sql()}) SELECT check_name, sum((n > 0)::INT)::BIGINT AS symbols, sum(n)::BIGINT AS bad_rows FROM q GROUP BY 1")
def ag_quality_checks(v):
    return checked(v).groupBy("check_name").agg(F.count_if(F.col("n") > 0).alias("symbols"), F.sum("n").alias("bad_rows"))


@query("ag_recon_daily", f"SELECT check_name, sum(n)::BIGINT AS n, CASE WHEN sum(n) = 0 THEN 'PASS' ELSE 'FAIL' END AS state FROM ({_long_checks_sql()}) GROUP BY 1 UNION ALL SELECT 'duplicate_keys', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def ag_recon_daily(v):
    state = F.when(F.col("n") == 0, "PASS").otherwise("FAIL").alias("state")
    a = checked(v).groupBy("check_name").agg(F.sum("n").alias("n"))
    d = v.t("lineitem").groupBy("l_orderkey", "l_linenumber").count().where("count > 1").agg(F.lit("duplicate_keys").alias("check_name"), F.count("*").alias("n"))
    return a.unionByName(d).select("check_name", "n", state)


@query("ag_jump_candidates", "WITH j AS (SELECT instrument_id, sidx, close / lag(close) OVER (PARTITION BY instrument_id ORDER BY sidx) AS r FROM grid_w) SELECT instrument_id, sidx, round(r, 6) AS ratio, abs(r / 0.5 - 1) < 0.02 OR abs(r / 2 - 1) < 0.02 OR abs(r / 0.2 - 1) < 0.02 AS split_like FROM j WHERE abs(r - 1) > 0.35")
def ag_jump_candidates(v):
    r = F.col("r")
    near = lambda x: F.abs(r / x - 1) < 0.02
    g = v.grid_w.select("instrument_id", "sidx", (F.col("close") / F.lag("close").over(BY())).alias("r"))
    return g.where(F.abs(r - 1) > 0.35).select("instrument_id", "sidx", R6(r, "ratio"), (near(0.5) | near(2) | near(0.2)).alias("split_like"))


@query("ag_coverage", "SELECT b.instrument_id, min(b.session) AS first_session, max(b.session) AS last_session, count(*) AS n, max(sidx) - min(sidx) + 1 AS span, round(1 - count(*) / (max(sidx) - min(sidx) + 1)::DOUBLE, 6) AS gap_rate FROM bars_d b JOIN cal_d USING (session) GROUP BY 1")
def ag_coverage(v):
    span = F.max("sidx") - F.min("sidx") + 1
    g = v.bars_d.join(v.cal_d, "session").groupBy("instrument_id")
    return g.agg(F.min("session").alias("first_session"), F.max("session").alias("last_session"), F.count("*").alias("n"), span.alias("span"), R6(1 - F.count("*") / span, "gap_rate"))


@query("ag_recon_gaps", "SELECT instrument_id, max(sidx) - min(sidx) + 1 - count(*) AS missing FROM bars_d JOIN cal_d USING (session) GROUP BY 1")
def ag_recon_gaps(v):
    return v.bars_d.join(v.cal_d, "session").groupBy("instrument_id").agg((F.max("sidx") - F.min("sidx") + 1 - F.count("*")).alias("missing"))


TICK = "py AS (SELECT year(session) AS y, instrument_id, close, abs(close * 20 - round(close * 20)) < 0.1 AS usable FROM bars_d)"


@query("ag_price_precision", f"WITH {TICK}, a AS (SELECT y, count(*) AS stock_days, count(DISTINCT instrument_id) AS symbols, round(100.0 * avg(usable::INT), 6) AS usable_pct, round(median(close), 6) AS median_price, round(quantile_cont(close, 0.05), 6) AS p05 FROM py GROUP BY y) SELECT *, min(usable_pct) OVER (ORDER BY y DESC) AS floor_pct FROM a")
def ag_price_precision(v):
    p = staged(v.bars_d.select(F.year("session").alias("y"), "instrument_id", "close", (F.abs(F.col("close") * 20 - F.rint(F.col("close") * 20)) < 0.1).alias("usable")))
    q = exact_quantiles(p, "close", [0.5, 0.05], ["y"]).select("y", R6(F.col("q_0"), "median_price"), R6(F.col("q_1"), "p05"))
    a = p.groupBy("y").agg(F.count("*").alias("stock_days"), F.countDistinct("instrument_id").alias("symbols"), R6(F.avg(F.col("usable").cast("double")) * 100, "usable_pct"))
    a = a.join(q, "y")
    return a.withColumn("floor_pct", F.min("usable_pct").over(Window.orderBy(F.desc("y"))))  # one row per year


@query("ag_symbol_inventory", "WITH g AS (SELECT instrument_id, session, sidx, volume, close, sidx - lag(sidx) OVER (PARTITION BY instrument_id ORDER BY sidx) - 1 AS gap FROM bars_d JOIN cal_d USING (session)), e AS (SELECT max(sidx) AS last FROM cal_d) SELECT instrument_id, count(*) AS n, min(session) AS first_session, max(session) AS last_session, coalesce(sum(gap), 0)::BIGINT AS missing, coalesce(max(gap), 0) AS largest_gap, sum((volume = 0)::INT)::BIGINT AS zero_volume, round(avg(close), 6) AS mean_close, CASE WHEN max(sidx) >= any_value(last) - 5 THEN 'ACTIVE' ELSE 'ENDED' END AS status FROM g, e GROUP BY 1")
def ag_symbol_inventory(v):
    c = v.bars_d.join(v.cal_d, "session")
    g = c.withColumn("gap", F.col("sidx") - F.lag("sidx").over(BY()) - 1).crossJoin(F.broadcast(v.cal_d.agg(F.max("sidx").alias("last"))))
    return g.groupBy("instrument_id").agg(
        F.count("*").alias("n"), F.min("session").alias("first_session"), F.max("session").alias("last_session"), F.coalesce(F.sum("gap"), F.lit(0)).alias("missing"), F.coalesce(F.max("gap"), F.lit(0)).alias("largest_gap"),
        cnt("volume = 0").alias("zero_volume"), R6(F.avg("close"), "mean_close"), F.when(F.max("sidx") >= F.first("last") - 5, "ACTIVE").otherwise("ENDED").alias("status"),
    )


@query("ag_year_coverage", "WITH y AS (SELECT DISTINCT o_custkey AS id, year(o_orderdate) AS y FROM orders), w AS (SELECT *, lag(y) OVER (PARTITION BY id ORDER BY y) AS p, lead(y) OVER (PARTITION BY id ORDER BY y) AS n FROM y) SELECT y, count(*) AS present, sum((p IS NULL OR p < y - 1)::INT)::BIGINT AS entering, sum((n IS NULL OR n > y + 1)::INT)::BIGINT AS disappearing, round(100.0 * avg((n = y + 1 AND n IS NOT NULL)::INT), 6) AS continuing_pct FROM w GROUP BY y")
def ag_year_coverage(v):
    y = v.t("orders").select(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("y")).distinct()
    w = Window.partitionBy("id").orderBy("y")
    y = y.withColumns({"p": F.lag("y").over(w), "n": F.lead("y").over(w)})
    return y.groupBy("y").agg(F.count("*").alias("present"), cnt("p is null or p < y - 1").alias("entering"), cnt("n is null or n > y + 1").alias("disappearing"), R6(F.avg(F.expr("case when n = y + 1 then 1.0d else 0.0d end")) * 100, "continuing_pct"))


@query("ag_population_year", "WITH s AS (SELECT entity_id, min(year(valid_from)) AS a, max(year(coalesce(valid_to, (SELECT greatest(max(valid_from), max(valid_to)) FROM aliases)))) AS b, bool_or(valid_to IS NULL) AS o FROM aliases GROUP BY 1) SELECT y, count(*) AS listed, sum((a = y)::INT)::BIGINT AS new, sum((b = y AND NOT o)::INT)::BIGINT AS terminated FROM s, range(1900, 2200) r(y) WHERE y BETWEEN a AND b GROUP BY y")
def ag_population_year(v):
    """Intervals without an end go on to the last date that any alias has."""
    latest = v.aliases.agg(F.greatest(F.max("valid_from"), F.max("valid_to")).alias("latest"))
    end = F.year(F.coalesce("valid_to", "latest"))
    s = v.aliases.crossJoin(F.broadcast(latest)).groupBy("entity_id").agg(F.min(F.year("valid_from")).alias("a"), F.max(end).alias("b"), F.bool_or(F.col("valid_to").isNull()).alias("o"))
    y = s.withColumn("y", F.explode(F.sequence("a", F.greatest("a", "b")))).where("y <= b")
    return y.groupBy("y").agg(F.count("*").alias("listed"), cnt("a = y").alias("new"), cnt("b = y and not o").alias("terminated"))


@query("ag_recon_terminal_actions", "SELECT 'ended_without_record' AS check_name, count(*) AS n FROM (SELECT entity_id FROM aliases GROUP BY 1 HAVING max(valid_from) < DATE '2000-01-01') e ANTI JOIN customer ON c_custkey = entity_id AND c_acctbal > 0 UNION ALL SELECT 'unknown_types', count(*) FROM obs WHERE event_type NOT IN ('click', 'view', 'purchase') UNION ALL SELECT 'change_without_alias', count(*) FROM customer ANTI JOIN aliases ON entity_id = c_custkey")
def ag_recon_terminal_actions(v):
    one = lambda df, name: df.agg(F.lit(name).alias("check_name"), F.count("*").alias("n"))
    ended = v.aliases.groupBy("entity_id").agg(F.max("valid_from").alias("m")).where("m < date '2000-01-01'")
    a = one(ended.join(v.t("customer").where("c_acctbal > 0"), F.col("c_custkey") == F.col("entity_id"), "left_anti"), "ended_without_record")
    b = one(v.obs.where("event_type not in ('click', 'view', 'purchase')"), "unknown_types")
    c = one(v.t("customer").join(v.aliases, F.col("entity_id") == F.col("c_custkey"), "left_anti"), "change_without_alias")
    return a.unionByName(b).unionByName(c)


@query("ag_acceptance_rollup", f"WITH q AS (SELECT check_name, sum(n) AS n FROM ({_long_checks_sql()}) GROUP BY 1), s AS (SELECT CASE WHEN check_name IN ('range_inverted', 'open_outside', 'close_outside') THEN 'ohlc' WHEN check_name IN ('zero_volume', 'flat_bar') THEN 'liquidity' ELSE 'price' END AS capability, n FROM q) SELECT capability, CASE WHEN sum(n) = 0 THEN 'PASS' ELSE 'FAIL' END AS state, bool_and(sum(n) = 0) OVER () AS promotable FROM s GROUP BY capability")
def ag_acceptance_rollup(v):
    cap = F.when(F.col("check_name").isin("range_inverted", "open_outside", "close_outside"), "ohlc").when(F.col("check_name").isin("zero_volume", "flat_bar"), "liquidity").otherwise("price")
    s = checked(v).groupBy(cap.alias("capability")).agg(F.sum("n").alias("n"))
    return s.select("capability", F.when(F.col("n") == 0, "PASS").otherwise("FAIL").alias("state"), F.bool_and(F.col("n") == 0).over(Window.partitionBy()).alias("promotable"))


@query("ag_pilot_gate", "WITH c AS (SELECT year(session) AS y, count(*) AS n FROM cal_d GROUP BY 1) SELECT y, n, concat_ws('|', CASE WHEN n < 250 THEN 'TOO_FEW' END, CASE WHEN y < 1996 THEN 'TOO_EARLY' END) AS failures FROM c")
def ag_pilot_gate(v):
    c = v.cal_d.groupBy(F.year("session").alias("y")).agg(F.count("*").alias("n"))
    return c.select("y", "n", F.array_join(F.array_compact(F.array(F.when(F.col("n") < 250, "TOO_FEW"), F.when(F.col("y") < 1996, "TOO_EARLY"))), "|").alias("failures"))


@query("ag_inventory_diag", "SELECT p_brand, p_size % 5 AS segment, count(*) AS n, count(*) - count(DISTINCT p_name) AS duplicate_names FROM part GROUP BY GROUPING SETS ((p_brand), (p_size % 5), ())")
def ag_inventory_diag(v):
    p = v.t("part").withColumn("segment", F.col("p_size") % 5)
    return p.groupingSets([[F.col("p_brand")], [F.col("segment")], []], F.col("p_brand"), F.col("segment")).agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("p_name")).alias("duplicate_names")).select("p_brand", "segment", "n", "duplicate_names")


STATE = "CASE WHEN {x} IS NULL THEN 'MISSING' WHEN {x} = '' THEN 'NOT_APPLICABLE' WHEN try_cast({x} AS DOUBLE) IS NULL THEN 'MALFORMED' ELSE 'PRESENT' END"
RAWF = "rf AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN '' WHEN event_id % 7 = 2 THEN 'abc' ELSE round(value, 2)::VARCHAR END AS price, CASE WHEN event_id % 5 = 0 THEN '-' ELSE event_id::VARCHAR END AS qty FROM events)"


def raw_fields(v):
    k = F.col("event_id")
    price = F.when(k % 7 == 0, None).when(k % 7 == 1, "").when(k % 7 == 2, "abc").otherwise(F.round("value", 2).cast("string"))
    return v.t("events").select("event_id", price.alias("price"), F.when(k % 5 == 0, "-").otherwise(k.cast("string")).alias("qty"))


def field_state(x):
    return F.when(x.isNull(), "MISSING").when(x == "", "NOT_APPLICABLE").when(x.try_cast("double").isNull(), "MALFORMED").otherwise("PRESENT")


@query("px_field_state", f"WITH {RAWF} SELECT event_id, {STATE.format(x='price')} AS price_state, {STATE.format(x='qty')} AS qty_state FROM rf")
def px_field_state(v):
    return raw_fields(v).select("event_id", field_state(F.col("price")).alias("price_state"), field_state(F.col("qty")).alias("qty_state"))


@query("ag_field_states", f"WITH {RAWF} SELECT 'price' AS field, {STATE.format(x='price')} AS state, count(*) AS n FROM rf GROUP BY 2 UNION ALL SELECT 'qty', {STATE.format(x='qty')}, count(*) FROM rf GROUP BY 2")
def ag_field_states(v):
    long_ = raw_fields(v).unpivot("event_id", ["price", "qty"], "field", "x")
    return long_.groupBy("field", field_state(F.col("x")).alias("state")).agg(F.count("*").alias("n"))


@query("px_number_clean", "WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '-' WHEN 1 THEN '' WHEN 2 THEN '(' || (event_id * 1000)::VARCHAR || ')' WHEN 3 THEN '1,' || (100 + event_id % 900)::VARCHAR || '.50' ELSE 'NA' END AS raw FROM events) SELECT event_id, CASE WHEN raw IN ('', '-', 'NA') THEN NULL WHEN raw LIKE '(%)' THEN -try_cast(replace(substr(raw, 2, length(raw) - 2), ',', '') AS DOUBLE) ELSE try_cast(replace(raw, ',', '') AS DOUBLE) END AS x FROM r")
def px_number_clean(v):
    from ..functions.parsing import number

    k = F.col("event_id")
    raw = F.when(k % 5 == 0, "-").when(k % 5 == 1, "").when(k % 5 == 2, F.concat(F.lit("("), (k * 1000).cast("string"), F.lit(")"))).when(k % 5 == 3, F.concat(F.lit("1,"), (k % 900 + 100).cast("string"), F.lit(".50"))).otherwise("NA")
    return v.t("events").select("event_id", number(raw).alias("x"))


@query("px_expiry_decode", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL WHEN DATE '1980-01-01' + ((event_id * 90000) // 86400)::INT BETWEEN DATE '1990-01-01' AND DATE '2099-12-31' THEN DATE '1980-01-01' + ((event_id * 90000) // 86400)::INT END AS expiry FROM events")
def px_expiry_decode(v):
    from ..functions.parsing import expiry

    raw = F.when(F.col("event_id") % 9 == 0, "x12").otherwise((F.col("event_id") * 90000).cast("string"))
    return v.t("events").select("event_id", expiry(raw).alias("expiry"))


OHLC = """oh AS (SELECT instrument_id, session, CASE WHEN x % 37 = 0 THEN low - 1 ELSE high END AS high, low, CASE WHEN x % 11 = 0 THEN high * 1.5 ELSE open END AS open, CASE WHEN x % 13 = 0 THEN low * 0.5 ELSE close END AS close,
  CASE WHEN x % 5 = 0 THEN high * 1.25 ELSE close END AS settlement, CASE WHEN x % 29 = 0 THEN 0 WHEN x % 31 = 0 THEN -volume ELSE volume END AS volume FROM (SELECT *, instrument_id * 7 + date_diff('day', DATE '1992-01-01', session) AS x FROM bars_d)),
os AS (SELECT instrument_id, session, CASE WHEN volume < 0 THEN 'NEGATIVE_TOTAL_TRADED_QUANTITY' WHEN high < low THEN 'HIGH_BELOW_LOW' WHEN volume = 0 THEN 'ZERO_VOLUME_PRICE_STATE' ELSE concat_ws('|', CASE WHEN open NOT BETWEEN low AND high THEN 'OPEN_OUTSIDE_DAILY_RANGE_UNRESOLVED_BASIS' END,
  CASE WHEN close NOT BETWEEN low AND high THEN 'CLOSE_OUTSIDE_DAILY_RANGE_UNRESOLVED_BASIS' END, CASE WHEN settlement NOT BETWEEN low AND high THEN 'SETTLEMENT_OUTSIDE_DAILY_RANGE_SEPARATE_BASIS' END) END AS flags FROM oh)"""


@query("px_ohlc_rules", f"WITH {OHLC} SELECT instrument_id, session, flags, CASE WHEN flags IN ('NEGATIVE_TOTAL_TRADED_QUANTITY', 'HIGH_BELOW_LOW') THEN 'FATAL' WHEN contains(flags, 'UNRESOLVED_BASIS') THEN 'BLOCKING' WHEN flags <> '' THEN 'INFORMATIONAL' ELSE 'CLEAN' END AS severity FROM os")
def px_ohlc_rules(v):
    """Daily bars with a settlement price, and with faults of each kind by arithmetic on keys."""
    x = F.col("instrument_id") * 7 + F.datediff("session", F.lit("1992-01-01").cast("date"))
    odd = lambda n, then, c: F.when(x % n == 0, then).otherwise(F.col(c))
    settlement, volume = odd(5, F.col("high") * 1.25, "close"), F.when(x % 29 == 0, 0).when(x % 31 == 0, -F.col("volume")).otherwise(F.col("volume"))
    states = rules.ohlc_states(odd(11, F.col("high") * 1.5, "open"), odd(37, F.col("low") - 1, "high"), F.col("low"), odd(13, F.col("low") * 0.5, "close"), settlement, volume)
    return v.bars_d.select("instrument_id", "session", states.alias("s")).select("instrument_id", "session", F.array_join("s", "|").alias("flags"), rules.ohlc_severity(F.col("s")).alias("severity"))


@query("px_ohlc_predicates", "WITH p AS (SELECT concat_ws('+', CASE WHEN open = high THEN 'O=H' END, CASE WHEN open = low THEN 'O=L' END, CASE WHEN close = high THEN 'C=H' END, CASE WHEN close = low THEN 'C=L' END, CASE WHEN high = low THEN 'H=L' END) AS pattern, volume >= 30 AS busy FROM bars_d) SELECT pattern, busy, count(*) AS n FROM p GROUP BY 1, 2")
def px_ohlc_predicates(v):
    tests = {"O=H": "open = high", "O=L": "open = low", "C=H": "close = high", "C=L": "close = low", "H=L": "high = low"}
    pattern = F.concat_ws("+", *[F.when(F.expr(e), n) for n, e in tests.items()])
    return v.bars_d.groupBy(pattern.alias("pattern"), (F.col("volume") >= 30).alias("busy")).agg(F.count("*").alias("n"))


@query("px_isin_quality", "WITH r AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 9 = 1 THEN 'BAD' ELSE 'INE' || lpad((c_custkey % 1000000)::VARCHAR, 6, '0') || '01' || (c_custkey % 10)::VARCHAR END AS isin FROM customer) SELECT count(*) AS n, count(*) - count(isin) AS missing, sum((isin IS NOT NULL AND NOT regexp_full_match(isin, '[A-Z]{2}[A-Z0-9]{9}[0-9]'))::INT)::BIGINT AS invalid, round(100.0 * count(isin) / count(*), 6) AS coverage FROM r")
def px_isin_quality(v):
    k = F.col("c_custkey")
    isin = F.when(k % 9 == 0, None).when(k % 9 == 1, "BAD").otherwise(F.concat(F.lit("INE"), F.lpad((k % 1000000).cast("string"), 6, "0"), F.lit("01"), (k % 10).cast("string")))
    r = v.t("customer").select(isin.alias("isin"))
    bad = F.count_if(F.col("isin").isNotNull() & ~F.col("isin").rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$"))
    return r.agg(F.count("*").alias("n"), (F.count("*") - F.count("isin")).alias("missing"), bad.alias("invalid"), R6(F.count("isin") * 100.0 / F.count("*"), "coverage"))


@query("jn_population_reconcile", "WITH s AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0), p AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01') SELECT CASE WHEN p.id IS NULL THEN 'NON_TRADING' WHEN s.id IS NULL THEN 'UNRESOLVED' ELSE 'MATCHED' END AS state, count(*) AS n FROM s FULL JOIN p ON s.id = p.id GROUP BY 1")
def jn_population_reconcile(v):
    s = v.t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.lit(1).alias("s"))
    p = v.t("orders").where("o_orderdate >= timestamp '1999-01-01'").select(F.col("o_custkey").alias("id"), F.lit(1).alias("p")).distinct()
    state = F.when(F.col("p").isNull(), "NON_TRADING").when(F.col("s").isNull(), "UNRESOLVED").otherwise("MATCHED")
    return s.join(p, "id", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("jn_reference_absent", "SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-06-01'")
def jn_reference_absent(v):
    return v.t("customer").join(v.t("orders").where("o_orderdate >= timestamp '2000-06-01'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("jn_universe_symbol_split", "SELECT p_partkey, CASE WHEN p_size <= 25 THEN CASE WHEN l.k IS NULL THEN 'STOCK_MISSING_PRICE' ELSE 'STOCK' END ELSE 'INDEX' END AS kind FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01') l ON l.k = p_partkey")
def jn_universe_symbol_split(v):
    priced = v.t("lineitem").where("l_shipdate >= timestamp '2001-06-01'").select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("priced")).distinct()
    kind = F.when(F.col("p_size") > 25, "INDEX").when(F.col("priced"), "STOCK").otherwise("STOCK_MISSING_PRICE")
    return v.t("part").join(priced, "p_partkey", "left").select("p_partkey", kind.alias("kind"))


@query("jn_universe_fut", "SELECT DISTINCT instrument_id FROM bars_w SEMI JOIN (SELECT instrument_id FROM contracts WHERE oi > 300) c USING (instrument_id)")
def jn_universe_fut(v):
    return v.bars_w.select("instrument_id").distinct().join(v.contracts.where("oi > 300"), "instrument_id", "left_semi")


@query("so_snapshot_diff", "WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE year(o_orderdate) = 1998), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE year(o_orderdate) = 1999) SELECT id, 'added' AS change FROM (SELECT id FROM b EXCEPT SELECT id FROM a) UNION ALL SELECT id, 'removed' FROM (SELECT id FROM a EXCEPT SELECT id FROM b)")
def so_snapshot_diff(v):
    of = lambda y: v.t("orders").where(F.year("o_orderdate") == y).select(F.col("o_custkey").alias("id"))
    return of(1999).subtract(of(1998)).withColumn("change", F.lit("added")).unionByName(of(1998).subtract(of(1999)).withColumn("change", F.lit("removed")))


@query("so_log_divergence", "WITH f AS (SELECT event_id AS id, round(value, 3) AS x FROM events WHERE event_id % 10 <> 0), l AS (SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN -1 ELSE round(value, 3) END AS x FROM events WHERE event_id % 9 <> 0) SELECT coalesce(f.id, l.id) AS id, CASE WHEN f.id IS NULL THEN 'ADDED' WHEN l.id IS NULL THEN 'MISSING' ELSE 'MODIFIED' END AS state FROM f FULL JOIN l ON f.id = l.id WHERE f.id IS NULL OR l.id IS NULL OR f.x <> l.x")
def so_log_divergence(v):
    e = v.t("events").select(F.col("event_id").alias("id"), F.round("value", 3).alias("x"))
    h = lambda c: F.xxhash64("id", c)
    f = e.where("id % 10 <> 0").select("id", h("x").alias("f"))
    l = e.where("id % 9 <> 0").withColumn("x", F.when(F.col("id") % 11 == 0, -1.0).otherwise(F.col("x"))).select("id", h("x").alias("l"))  # noqa: E741
    state = F.when(F.col("f").isNull(), "ADDED").when(F.col("l").isNull(), "MISSING").when(F.col("f") != F.col("l"), "MODIFIED")
    return f.join(l, "id", "full_outer").select("id", state.alias("state")).where("state is not null")


@query("so_raw_equal", "WITH r AS (SELECT event_id, event_type FROM events), n AS (SELECT event_id, CASE WHEN event_id % 997 = 0 THEN 'x' ELSE event_type END AS event_type FROM events) SELECT (SELECT count(*) FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM n)) AS only_raw, (SELECT count(*) FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM r)) AS only_normal")
def so_raw_equal(v):
    r = v.t("events").select("event_id", "event_type")
    n = r.withColumn("event_type", F.when(F.col("event_id") % 997 == 0, "x").otherwise(F.col("event_type")))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(r.exceptAll(n), "only_raw").crossJoin(one(n.exceptAll(r), "only_normal"))
