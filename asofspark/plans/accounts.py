"""Queries of costs, ledgers, valuations, limits and text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.costs import delivery_leg, futures_leg
from ..functions.keywords import TITLE_EXCLUDE, TITLE_INCLUDE, finance_strengths
from ..operators.ordered import average_cost, sealed, verified
from ..operators.phrases import with_phrases
from ..operators.ranks import with_counts_before
from ..sources.readers import staged
from .registry import query

R6 = lambda c, name: F.round(c, 6).alias(name)

LEG = "(least(20.0, {v} * 0.0003) + {v} * 0.001 + {v} * 0.0000297 + {v} * 0.000001 + {stamp} + 0.18 * (least(20.0, {v} * 0.0003) + {v} * 0.0000297 + {v} * 0.000001) + {v} * 0.0005)"


@query("px_delivery_cost", "SELECT instrument_id, session, round(" + LEG.format(v="turnover", stamp="turnover * 0.00015") + ", 6) AS buy_cost, round(" + LEG.format(v="turnover", stamp="0") + ", 6) AS sell_cost FROM bars_w")
def px_delivery_cost(v):
    return v.bars_w.select("instrument_id", "session", R6(delivery_leg(F.col("turnover"), "buy"), "buy_cost"), R6(delivery_leg(F.col("turnover"), "sell"), "sell_cost"))


FUT = "(least(20.0, {v} * 0.0003) + {stt} + {v} * 0.0000173 + {v} * 0.000001 + {stamp} + 0.18 * (least(20.0, {v} * 0.0003) + {v} * 0.0000173 + {v} * 0.000001) + {v} * 0.0005)"
FB, FS = FUT.format(v="turnover", stt="0", stamp="turnover * 0.00002"), FUT.format(v="turnover", stt="turnover * 0.0002", stamp="0")


@query("px_futures_cost", f"SELECT instrument_id, session, round(CASE WHEN instrument_id % 2 = 0 THEN {FB} ELSE {FS} END, 6) AS open_cost, round(CASE WHEN instrument_id % 2 = 0 THEN {FS} ELSE {FB} END, 6) AS close_cost FROM bars_w")
def px_futures_cost(v):
    buy, sell = futures_leg(F.col("turnover"), "buy"), futures_leg(F.col("turnover"), "sell")
    long_ = F.col("instrument_id") % 2 == 0
    return v.bars_w.select("instrument_id", "session", R6(F.when(long_, buy).otherwise(sell), "open_cost"), R6(F.when(long_, sell).otherwise(buy), "close_cost"))


@query("px_round_trip_pct", "SELECT instrument_id, session, round(100 * (" + LEG.format(v="turnover", stamp="turnover * 0.00015") + " + " + LEG.format(v="turnover", stamp="0") + ") / turnover, 6) AS pct_of_position, round(50 * (" + LEG.format(v="turnover", stamp="turnover * 0.00015") + " + " + LEG.format(v="turnover", stamp="0") + ") / turnover, 6) AS pct_of_turnover FROM bars_w")
def px_round_trip_pct(v):
    both = delivery_leg(F.col("turnover"), "buy") + delivery_leg(F.col("turnover"), "sell")
    return v.bars_w.select("instrument_id", "session", R6(both * 100 / F.col("turnover"), "pct_of_position"), R6(both * 50 / F.col("turnover"), "pct_of_turnover"))


@query("ag_ledger_balance", "SELECT event_id, sum(debit)::DECIMAL(20,2) AS debits, sum(credit)::DECIMAL(20,2) AS credits FROM journal GROUP BY event_id HAVING sum(debit) <> sum(credit)")
def ag_ledger_balance(v):
    g = v.journal.groupBy("event_id").agg(F.bround(F.sum("debit"), 2).cast("decimal(20,2)").alias("debits"), F.bround(F.sum("credit"), 2).cast("decimal(20,2)").alias("credits"))
    return g.where("debits <> credits")


HOLD = "h AS (SELECT o_custkey % 20 AS book, o_custkey % 25 AS instrument_id, sum(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * (o_orderkey % 50))::BIGINT AS shares FROM orders GROUP BY 1, 2), lp AS (SELECT instrument_id, arg_max(close, session) AS price, max(session) AS seen FROM bars_w WHERE session <= DATE '2000-06-30' GROUP BY 1)"


def holdings(v):
    o = v.t("orders")
    n = F.when(F.col("o_orderstatus") == "F", -1).otherwise(1) * (F.col("o_orderkey") % 50)
    return o.groupBy((F.col("o_custkey") % 20).alias("book"), (F.col("o_custkey") % 25).alias("instrument_id")).agg(F.sum(n).alias("shares"))


def valued(v):
    lp = v.bars_w.where("session <= date '2000-06-30'").groupBy("instrument_id").agg(F.max_by("close", "session").alias("price"), F.max("session").alias("at"))
    return holdings(v).join(lp, "instrument_id", "left").withColumn("value", F.round(F.col("shares") * F.col("price"), 6))


@query("ag_valuation", f"WITH {HOLD} SELECT book, round(sum(round(shares * price, 6)), 2) AS net, round(sum(abs(round(shares * price, 6))), 2) AS gross, round(max(abs(round(shares * price, 6))) / sum(abs(round(shares * price, 6))), 6) AS concentration, bool_or(price IS NULL OR seen < DATE '2000-06-12') AS incomplete FROM h LEFT JOIN lp USING (instrument_id) GROUP BY book")
def ag_valuation(v):
    a = F.abs("value")
    return valued(v).groupBy("book").agg(F.round(F.sum("value"), 2).alias("net"), F.round(F.sum(a), 2).alias("gross"), R6(F.max(a) / F.sum(a), "concentration"), F.bool_or(F.col("price").isNull() | (F.col("at") < "2000-06-12")).alias("incomplete"))


LIMITS = f"""{HOLD}, va AS (SELECT book, h.instrument_id, sector_id, shares, shares * price AS x FROM h LEFT JOIN lp USING (instrument_id) LEFT JOIN sector USING (instrument_id)),
se AS (SELECT book, max(s) AS s FROM (SELECT book, sector_id, sum(abs(x)) AS s FROM va GROUP BY 1, 2) GROUP BY 1),
ca AS (SELECT c_custkey % 20 AS book, sum(c_acctbal) * 40 AS cash FROM customer GROUP BY 1), tv AS (SELECT o_custkey % 20 AS book, sum(o_totalprice) / 10 AS traded FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 60 DAY GROUP BY 1),
bk AS (SELECT book, max(abs(x)) AS top, sum(abs(x)) AS gross, abs(sum(x)) AS net, count(*) FILTER (WHERE shares <> 0) AS names, bool_or(shares <> 0 AND x IS NULL) AS unpriced FROM va GROUP BY 1),
li AS (SELECT book, top / gross AS position, s / gross AS sector, gross / (gross + cash) AS gross, net / gross AS net, cash / (gross + cash) AS cash, coalesce(traded, 0) / gross AS turnover, names, unpriced FROM bk JOIN se USING (book) JOIN ca USING (book) LEFT JOIN tv USING (book))"""


@query("ag_limit_checks", f"WITH {LIMITS}, y AS (SELECT book, limit_order, limit_name, CASE WHEN NOT unpriced OR limit_name = 'names' THEN x END AS x, hi, low FROM li CROSS JOIN LATERAL (VALUES (1, 'position', position, 0.2, false), (2, 'sector', sector, 0.4, false), (3, 'gross', gross, 0.9, false), (4, 'net', net, 0.5, false), (5, 'cash', cash, 0.1, true), (6, 'turnover', turnover, 0.3, false), (7, 'names', names::DOUBLE, 30.0, false)) t(limit_order, limit_name, x, hi, low)) SELECT book, limit_order, limit_name, round(x, 6) AS observed, CASE WHEN x IS NULL THEN 'UNKNOWN' WHEN low AND x < hi OR NOT low AND x > hi THEN 'BLOCK' WHEN low AND x < hi * 1.25 OR NOT low AND x > 0.8 * hi THEN 'BINDING' ELSE 'PASS' END AS state FROM y")
def ag_limit_checks(v):
    """All limits of a book in a fixed order; those that need prices are unknown while a holding has none."""
    x = F.col("shares") * F.col("price")
    a = F.abs(x)
    held = staged(valued(v).join(v.sector, "instrument_id", "left"))
    sectors = held.groupBy("book", "sector_id").agg(F.sum(a).alias("s")).groupBy("book").agg(F.max("s").alias("s"))
    cash = v.t("customer").groupBy((F.col("c_custkey") % 20).alias("book")).agg((F.sum("c_acctbal") * 40).alias("cash"))
    o = v.t("orders")
    since = o.agg((F.max("o_orderdate") - F.make_dt_interval(F.lit(60))).alias("since"))
    traded = o.crossJoin(F.broadcast(since)).where("o_orderdate > since").groupBy((F.col("o_custkey") % 20).alias("book")).agg((F.sum("o_totalprice") / 10).alias("traded"))
    b = held.groupBy("book").agg(F.max(a).alias("top"), F.sum(a).alias("g"), F.abs(F.sum(x)).alias("net"), F.count_if(F.col("shares") != 0).cast("double").alias("names"), F.bool_or((F.col("shares") != 0) & x.isNull()).alias("unpriced"))
    b = b.join(sectors, "book").join(cash, "book").join(traded, "book", "left")
    whole = F.col("g") + F.col("cash")
    limits = [("position", F.col("top") / F.col("g"), 0.2), ("sector", F.col("s") / F.col("g"), 0.4), ("gross", F.col("g") / whole, 0.9), ("net", F.col("net") / F.col("g"), 0.5), ("cash", F.col("cash") / whole, 0.1), ("turnover", F.coalesce("traded", F.lit(0.0)) / F.col("g"), 0.3), ("names", F.col("names"), 30.0)]
    seen = lambda name, value: value if name == "names" else F.when(~F.col("unpriced"), value)
    rows = [F.struct(F.lit(i + 1).alias("limit_order"), F.lit(name).alias("limit_name"), F.round(seen(name, value), 6).alias("observed"), rules.limit_state(seen(name, value), F.lit(most), name == "cash").alias("state")) for i, (name, value, most) in enumerate(limits)]
    return b.select("book", F.inline(F.array(*rows)))


RUNNING = """ev AS (SELECT instrument_id, sidx, floor(close * 1000000 + 0.5)::BIGINT AS price, CASE WHEN sidx % 3 = 0 THEN -50 ELSE 40 END::BIGINT AS qty, row_number() OVER (PARTITION BY instrument_id ORDER BY sidx) AS i FROM grid_w WHERE close IS NOT NULL),
ac AS (SELECT *, CASE WHEN sidx % 29 = 0 THEN 2 ELSE 1 END::BIGINT AS split, CASE WHEN sidx % 31 = 0 THEN 500000 ELSE 0 END::BIGINT AS dividend FROM ev),
st AS (SELECT instrument_id, 0::BIGINT AS i, 0::BIGINT AS held, 0::BIGINT AS cost, 0::BIGINT AS realised FROM (SELECT DISTINCT instrument_id FROM ev)
  UNION ALL
  SELECT x.instrument_id, x.i, CASE WHEN qty > 0 THEN h + qty ELSE h - least(-qty, h) END, CASE WHEN qty > 0 THEN (c * h + price * qty + (h + qty) // 2) // (h + qty) ELSE c END, g + CASE WHEN qty > 0 THEN 0 ELSE (price - c) * least(-qty, h) END
  FROM (SELECT a.instrument_id, a.i, a.price, a.qty, s.held * a.split AS h, (s.cost + a.split - 1) // a.split AS c, s.realised + s.held * a.dividend AS g FROM st s JOIN ac a ON a.instrument_id = s.instrument_id AND a.i = s.i + 1) x)"""


@query("wn_running_cost", f"WITH RECURSIVE {RUNNING} SELECT instrument_id, held, (cost / 1000000.0)::DOUBLE AS cost, (realised / 1000000.0)::DOUBLE AS realised FROM st QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY i DESC) = 1")
def wn_running_cost(v):
    """Weighted-average cost and realised profit per instrument in event order, with dividends on what is held, then
    splits, then fills: a streamed fold in whole millionths."""
    at = lambda n, then, other: F.when(F.col("sidx") % n == 0, then).otherwise(other).cast("long")
    price = F.floor(F.col("close") * 1000000 + 0.5).cast("long")
    events = v.grid_w.where("close is not null").select("instrument_id", "sidx", price.alias("price"), at(3, -50, 40).alias("qty"), at(29, 2, 1).alias("split"), at(31, 500000, 0).alias("dividend"))
    s = average_cost(events, ["instrument_id"], ["sidx"])
    return s.select("instrument_id", "held", (F.col("cost") / 1000000.0).alias("cost"), (F.col("realised") / 1000000.0).alias("realised"))


CHAIN = """e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
ch AS (SELECT user_id, i, event_id, NULL::VARCHAR AS prior, md5(event_id::VARCHAR) AS h FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, e.event_id, ch.h, md5(ch.h || e.event_id::VARCHAR) FROM ch JOIN e ON e.user_id = ch.user_id AND e.i = ch.i + 1)"""


@query("wn_hash_chain", f"WITH RECURSIVE {CHAIN} SELECT event_id, prior AS expected, CASE WHEN event_id % 101 = 0 THEN 'LINK' WHEN event_id % 103 = 0 THEN 'CONTENT' END AS fault FROM ch WHERE event_id % 101 = 0 OR event_id % 103 = 0")
def wn_hash_chain(v):
    """Each user's events are sealed in a chain, hash = md5(previous hash, event); some links and hashes are then
    altered. The check recomputes both, in one pass over a user's events that holds one hash."""
    order = ["ts", "event_id"]
    e = v.t("events").select("user_id", *order, F.col("event_id").cast("string").alias("content"))
    broken, forged = F.col("event_id") % 101 == 0, (F.col("event_id") % 103 == 0) & (F.col("event_id") % 101 != 0)
    stored = sealed(e, ["user_id"], order, "content").withColumns({"previous": F.when(broken, "broken").otherwise(F.col("previous")), "hash": F.when(forged, "forged").otherwise(F.col("hash"))})
    return verified(stored, ["user_id"], order, "content").select("event_id", "expected", "fault")


@query("ag_ledger_counts", "SELECT account, event_id % 3 AS stage, count(*) AS n, sum(debit)::DECIMAL(20,2) AS debits FROM journal GROUP BY GROUPING SETS ((account), (event_id % 3), (account, event_id % 3), ())")
def ag_ledger_counts(v):
    j = v.journal.withColumn("stage", F.col("event_id") % 3)
    sets = [["account"], ["stage"], ["account", "stage"], []]
    return j.groupingSets([[F.col(c) for c in s] for s in sets], F.col("account"), F.col("stage")).agg(F.count("*").alias("n"), F.sum("debit").cast("decimal(20,2)").alias("debits")).select("account", "stage", "n", "debits")


@query("ag_scoreboard", "SELECT CASE WHEN session < DATE '1999-01-01' THEN 'train' ELSE 'validation' END AS split, instrument_id % 4 AS family, count(*) AS tried, sum((excess_pct > 0)::INT)::BIGINT AS accepted, sum((excess_pct <= 0)::INT)::BIGINT AS rejected FROM outcomes WHERE excess_pct IS NOT NULL GROUP BY 1, 2")
def ag_scoreboard(v):
    split = F.when(F.col("session") < "1999-01-01", "train").otherwise("validation")
    g = v.outcomes.where("excess_pct is not null").groupBy(split.alias("split"), (F.col("instrument_id") % 4).alias("family"))
    return g.agg(F.count("*").alias("tried"), F.count_if(F.col("excess_pct") > 0).alias("accepted"), F.count_if(F.col("excess_pct") <= 0).alias("rejected"))


@query("px_tradebook", "SELECT event_id, account, debit AS buy_value, round(debit * 1.02, 2)::DECIMAL(20,2) AS sell_value, round(debit * 0.02, 2)::DECIMAL(20,2) AS profit, round(debit * 0.001, 2)::DECIMAL(20,2) AS charges FROM journal")
def px_tradebook(v):
    d = F.col("debit")
    m = lambda x, n: F.round(d * F.lit(x).cast("decimal(6,3)"), 2).cast("decimal(20,2)").alias(n)
    return v.journal.select("event_id", "account", d.alias("buy_value"), m("1.02", "sell_value"), m("0.02", "profit"), m("0.001", "charges"))


@query("px_stress_band", "SELECT record_id, CASE WHEN value < 20 THEN 'calm' WHEN value < 40 THEN 'watch' WHEN value < 60 THEN 'elevated' WHEN value < 80 THEN 'high' ELSE 'severe' END AS band FROM obs WHERE value IS NOT NULL")
def px_stress_band(v):
    x = F.col("value")
    return v.obs.where("value is not null").select("record_id", F.when(x < 20, "calm").when(x < 40, "watch").when(x < 60, "elevated").when(x < 80, "high").otherwise("severe").alias("band"))


@query("px_linear_map", "SELECT record_id, round(least(100, greatest(0, (value - 10) / 80 * 100)), 6) AS mapped FROM obs WHERE value IS NOT NULL")
def px_linear_map(v):
    return v.obs.where("value is not null").select("record_id", R6(F.least(F.lit(100.0), F.greatest(F.lit(0.0), (F.col("value") - 10) / 80 * 100)), "mapped"))


LEX_SQL = "lx AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {x}::DOUBLE)" for k, x in finance_strengths().items()) + ") t(word, s))"
HEADLINE = "hd AS (SELECT o_orderkey AS text_id, o_orderpriority || ' ' || (CASE o_orderkey % 7 WHEN 0 THEN 'Shares surge, profit beats' WHEN 1 THEN 'Stocks FELL; weak growth concerns' WHEN 2 THEN 'bank-upgrade: buy' WHEN 3 THEN 'no news' WHEN 4 THEN 'crash crash crash' WHEN 5 THEN NULL ELSE 'gains slip, gainsay; sell-off, post-sell-off losses sell-x' END) AS text FROM orders UNION ALL SELECT -1 - doc_id, text FROM documents)"


COMPOUNDS = r"c AS (SELECT text_id, unnest(regexp_extract_all(lower(text), '[a-z]+(?:-[a-z]+)*')) AS word FROM hd), w AS (SELECT text_id, s FROM c JOIN lx USING (word) UNION ALL SELECT text_id, s FROM (SELECT text_id, unnest(string_split(word, '-')) AS word FROM c WHERE word NOT IN (SELECT word FROM lx)) JOIN lx USING (word))"
SQUASHED = "coalesce(x, 0) / sqrt(coalesce(x, 0) * coalesce(x, 0) + 15)"


@query("px_lexicon_sentiment", f"WITH {LEX_SQL}, {HEADLINE}, {COMPOUNDS}, t AS (SELECT text_id, round(sum(s), 6) AS x FROM w GROUP BY 1) SELECT d.text_id, round({SQUASHED}, 6) AS score, CASE WHEN {SQUASHED} >= 0.05 THEN 'positive' WHEN {SQUASHED} <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM hd d LEFT JOIN t USING (text_id)")
def px_lexicon_sentiment(v):
    """Words of headlines and documents are weighed where the texts are read; nothing is shuffled."""
    k = F.col("o_orderkey") % 7
    said = F.when(k == 0, "Shares surge, profit beats").when(k == 1, "Stocks FELL; weak growth concerns").when(k == 2, "bank-upgrade: buy").when(k == 3, "no news").when(k == 4, "crash crash crash").when(k == 6, "gains slip, gainsay; sell-off, post-sell-off losses sell-x")
    texts = v.t("orders").select(F.col("o_orderkey").alias("text_id"), F.concat_ws(" ", "o_orderpriority", said).alias("text"), k.alias("k")).select("text_id", F.when(F.col("k") != 5, F.col("text")).alias("text"))
    texts = texts.unionByName(v.t("documents").select((-1 - F.col("doc_id")).alias("text_id"), "text"))
    x = F.round("strength", 6)
    d = with_phrases(texts, "text", {}, finance_strengths()).withColumn("score", x / F.sqrt(x * x + 15))
    return d.select("text_id", R6(F.col("score"), "score"), F.when(F.col("score") >= 0.05, "positive").when(F.col("score") <= -0.05, "negative").otherwise("neutral").alias("label"))


@query("px_upcoming_events", "SELECT record_id, day FROM obs WHERE day BETWEEN (SELECT min(day) FROM obs) + 20 AND (SELECT min(day) FROM obs) + 27")
def px_upcoming_events(v):
    t = v.obs.agg(F.min("day").alias("first"))
    return v.obs.crossJoin(F.broadcast(t)).where("day between date_add(first, 20) and date_add(first, 27)").select("record_id", "day")


NOTICES = ["Replacement in {}", "Change in methodology of {}", "Launch of {} Debt", "Inclusion and EXCLUSION of scrips from {}", "{} Fixed Income: changes", "Annual report of {}", "{} G-Sec, replacement", "Changes in {}", "Exchange holiday", None, "Bonds REPLACED in {}"]
NOTICE_SQL = "nt AS (SELECT DISTINCT o_orderdate::DATE AS day, 'INDEX ' || o_custkey % 7 AS index_name, CASE WHEN o_orderkey % 2 = 0 THEN 'ADD' ELSE 'DROP' END AS action, CASE o_orderkey % 11 " + " ".join(f"WHEN {i} THEN " + ("NULL" if t is None else f"replace('{t}', '{{}}', 'INDEX ' || o_custkey % 7)") for i, t in enumerate(NOTICES)) + " END AS title FROM orders)"
ANY = lambda words: "(" + " OR ".join(f"contains(lower(title), '{w}')" for w in words) + ")"


@query("px_title_relevance", f"WITH {NOTICE_SQL} SELECT *, row_number() OVER (ORDER BY day, index_name, action, title) - 1 AS position FROM nt WHERE {ANY(TITLE_INCLUDE)} AND NOT {ANY(TITLE_EXCLUDE)}")
def px_title_relevance(v):
    """Announcements whose title holds a word of the one list and none of the other, without repeats, numbered in the
    order of date, index and action."""
    k = F.col("o_orderkey") % 11
    index = F.concat(F.lit("INDEX "), (F.col("o_custkey") % 7).cast("string"))
    title = F.lit(None).cast("string")
    for i, t in enumerate(NOTICES):
        title = F.when(k == i, F.replace(F.lit(t), F.lit("{}"), index) if t else None).otherwise(title)
    n = v.t("orders").select(F.to_date("o_orderdate").alias("day"), index.alias("index_name"), F.when(F.col("o_orderkey") % 2 == 0, "ADD").otherwise("DROP").alias("action"), title.alias("title"))
    kept = with_phrases(n, "title", {"wanted": TITLE_INCLUDE, "unwanted": TITLE_EXCLUDE}).where("wanted > 0 and unwanted = 0").select(*n.columns).dropDuplicates()
    order = ["day", "index_name", "action", "title"]
    return with_counts_before(kept, order, F.lit(1)).select(*order, F.col("before").alias("position"))


@query("tk_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an') AND p_size > 10 ORDER BY p_name, p_partkey LIMIT 25")
def tk_search(v):
    return v.t("part").where(F.lower("p_name").contains("an") & (F.col("p_size") > 10)).select("p_partkey", "p_name").orderBy("p_name", "p_partkey").limit(25)


@query("tk_page", "SELECT record_id, published_at FROM obs ORDER BY published_at DESC, record_id LIMIT 20 OFFSET 40")
def tk_page(v):
    return v.obs.select("record_id", "published_at").orderBy(F.desc("published_at"), "record_id").offset(40).limit(20)


@query("px_instrument_id", "SELECT s_suppkey, 'ins_' || substr(sha256('NSE|' || s_name || '|' || s_nationkey), 1, 16) AS instrument_key FROM supplier")
def px_instrument_id(v):
    return v.t("supplier").select("s_suppkey", F.concat(F.lit("ins_"), F.substring(F.sha2(F.concat_ws("|", F.lit("NSE"), "s_name", "s_nationkey"), 256), 1, 16)).alias("instrument_key"))


def quality_reasons():
    rules = {"NO_USER": "user_id % 17 = 0", "BAD_PRICE": "value <= 5", "FUTURE_CLOCK": "event_id % 19 = 0", "NOT_CAUSAL": "event_id % 23 = 0"}
    return F.array_compact(F.array(*[F.when(F.expr(e), n) for n, e in rules.items()]))


REASONS = "concat_ws('|', CASE WHEN user_id % 17 = 0 THEN 'NO_USER' END, CASE WHEN value <= 5 THEN 'BAD_PRICE' END, CASE WHEN event_id % 19 = 0 THEN 'FUTURE_CLOCK' END, CASE WHEN event_id % 23 = 0 THEN 'NOT_CAUSAL' END)"


QUOTES = """q0 AS (SELECT *, (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS as_of FROM events),
q1 AS (SELECT event_id, as_of, CASE WHEN event_id % 40 = 0 THEN event_id - 1 ELSE event_id END AS k, CASE WHEN event_id % 41 = 0 THEN event_id + 1 ELSE event_id END AS token, CASE WHEN event_id % 67 = 0 THEN 'OTHER' ELSE 'SIMULATED' END AS exchange,
  CASE WHEN event_id % 71 = 0 THEN 'IX' ELSE 'EQ' END AS class, CASE WHEN event_id % 47 = 0 THEN 'USD' ELSE 'INR' END AS currency, CASE WHEN event_id % 53 = 0 THEN 'SOURCE_TIMEOUT' ELSE 'AVAILABLE' END AS source_state,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 37 = 0 THEN -value ELSE value END AS price, CASE WHEN event_id % 26 = 0 OR event_id % 43 = 0 THEN 'HALTED' END AS reason, CASE WHEN event_id % 59 = 0 THEN 'STALE_CACHE' WHEN event_id % 61 = 0 THEN 'UNKNOWN' ELSE 'FRESH' END AS cache,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts END AS quote_at, ts + CASE WHEN event_id % 19 = 0 THEN INTERVAL (-60) SECOND ELSE INTERVAL 60 SECOND END AS retrieved_at, ts + CASE WHEN event_id % 23 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL (-5) HOUR END AS inventory_at,
  CASE WHEN event_id % 31 = 0 THEN NULL ELSE ts + CASE WHEN event_id % 29 = 0 THEN INTERVAL 30 SECOND ELSE INTERVAL (-30) SECOND END END AS trade_at FROM q0),
q2 AS (SELECT *, count(*) OVER (PARTITION BY k) > 1 OR count(*) OVER (PARTITION BY token) > 1 AS twin FROM q1),
q3 AS (SELECT event_id, price, concat_ws('|', CASE WHEN twin THEN 'AMBIGUOUS_IDENTITY' END, CASE WHEN exchange <> 'SIMULATED' OR class <> 'EQ' THEN 'INELIGIBLE_IDENTITY' END, CASE WHEN currency <> 'INR' THEN 'INCOMPATIBLE_CURRENCY' END, CASE WHEN source_state <> 'AVAILABLE' THEN source_state END,
  CASE WHEN price IS NULL THEN 'MISSING_PRICE|' || coalesce(reason, 'MISSING_REASON_UNSPECIFIED') WHEN price <= 0 THEN 'INVALID_PRICE' WHEN reason IS NOT NULL THEN 'INCONSISTENT_MISSINGNESS' END, CASE WHEN cache <> 'FRESH' THEN cache END,
  CASE WHEN quote_at IS NULL THEN 'QUOTE_TIME_UNKNOWN' WHEN quote_at > as_of THEN 'QUOTE_TIME_FUTURE' WHEN quote_at < as_of - INTERVAL 20 DAY THEN 'QUOTE_STALE' END, CASE WHEN retrieved_at > as_of THEN 'RETRIEVAL_TIME_FUTURE' WHEN retrieved_at < as_of - INTERVAL 20 DAY THEN 'RETRIEVAL_STALE' END,
  CASE WHEN inventory_at > as_of THEN 'INVENTORY_TIME_FUTURE' WHEN inventory_at < as_of - INTERVAL 25 DAY THEN 'INVENTORY_STALE' END, CASE WHEN trade_at IS NULL THEN 'TRADE_TIME_UNKNOWN' WHEN trade_at > as_of THEN 'TRADE_TIME_FUTURE' END,
  CASE WHEN trade_at > quote_at THEN 'TRADE_AFTER_QUOTE' END, CASE WHEN quote_at > retrieved_at THEN 'QUOTE_AFTER_RETRIEVAL' END, CASE WHEN inventory_at > retrieved_at THEN 'INVENTORY_AFTER_RETRIEVAL' END) AS reasons FROM q2)"""


@query("px_quote_readiness", f"WITH {QUOTES} SELECT event_id, reasons, CASE WHEN reasons = '' THEN round(price, 4) END AS display_price FROM q3")
def px_quote_readiness(v):
    """Events as quote records, with faults of every kind by arithmetic on keys: ordered reasons, or a price to show."""
    k = F.col("event_id")
    e = v.t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    odd = lambda n, then, other: F.when(k % n == 0, then).otherwise(other)
    after = lambda s: F.col("ts") + F.make_dt_interval(secs=s)
    r = e.select(
        "event_id", odd(40, k - 1, k).alias("key"), odd(41, k + 1, k).alias("token"), odd(67, "OTHER", F.lit("SIMULATED")).alias("exchange"), odd(71, "IX", F.lit("EQ")).alias("instrument_class"),
        odd(47, "USD", F.lit("INR")).alias("currency"), odd(53, "SOURCE_TIMEOUT", F.lit("AVAILABLE")).alias("source_state"), F.when(k % 13 == 0, None).when(k % 37 == 0, -F.col("value")).otherwise(F.col("value")).alias("price"),
        F.when((k % 26 == 0) | (k % 43 == 0), "HALTED").alias("missing_reason"), F.when(k % 59 == 0, "STALE_CACHE").when(k % 61 == 0, "UNKNOWN").otherwise("FRESH").alias("cache_state"),
        odd(17, None, F.col("ts")).alias("quote_at"), odd(19, after(F.lit(-60.0)), after(F.lit(60.0))).alias("retrieved_at"), odd(23, after(F.lit(86400.0)), after(F.lit(-18000.0))).alias("inventory_at"),
        odd(31, None, odd(29, after(F.lit(30.0)), after(F.lit(-30.0)))).alias("trade_at"),
    )
    again = lambda c: r.groupBy(c).agg(F.count("*").alias("n")).where("n > 1").select(c, F.lit(True).alias(f"{c}_again"))
    r = r.join(again("key"), "key", "left").join(again("token"), "token", "left").withColumn("twin", F.coalesce("key_again", "token_again"))
    now = e.agg((F.max("ts") - F.make_dt_interval(F.lit(1))).alias("as_of"))
    reasons = rules.quote_reasons(F.col("as_of"), {"QUOTE": 20 * 86400, "RETRIEVAL": 20 * 86400, "INVENTORY": 25 * 86400})
    found = r.crossJoin(F.broadcast(now)).select("event_id", "price", F.array_join(reasons, "|").alias("reasons"))
    return found.select("event_id", "reasons", F.when(F.col("reasons") == "", F.round("price", 4)).alias("display_price"))


@query("px_quote_freshness", "WITH l AS (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events) SELECT user_id, date_diff('second', date_trunc('second', last_ts), date_trunc('second', now)) AS age_s, CASE WHEN epoch(now) - epoch(last_ts) < 21600 THEN 'CURRENT' WHEN epoch(now) - epoch(last_ts) < 86400 THEN 'AGING' ELSE 'STALE' END AS freshness FROM l, n")
def px_quote_freshness(v):
    e = v.t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    age = F.unix_seconds("now") - F.unix_seconds("last_ts")
    exact = (F.unix_micros("now") - F.unix_micros("last_ts")) / 1e6
    j = e.groupBy("user_id").agg(F.max("ts").alias("last_ts")).crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))
    return j.select("user_id", age.alias("age_s"), F.when(exact < 21600, "CURRENT").when(exact < 86400, "AGING").otherwise("STALE").alias("freshness"))


@query("px_snapshot_freshness", "WITH l AS (SELECT event_type, day, max(revision) AS revs, max(available_at) AS seen FROM obs GROUP BY 1, 2), n AS (SELECT max(available_at) AS now FROM obs) SELECT event_type, day, CASE WHEN revs > 5 THEN 'SUPERSEDED' WHEN epoch(now) - epoch(seen) < 172800 THEN 'CURRENT' WHEN epoch(now) - epoch(seen) < 864000 THEN 'AGING' ELSE 'STALE' END AS freshness FROM l, n")
def px_snapshot_freshness(v):
    l = v.obs.groupBy("event_type", "day").agg(F.max("revision").alias("revs"), F.max("available_at").alias("at"))  # noqa: E741
    age = F.unix_seconds("now") - F.unix_seconds("at")
    state = F.when(F.col("revs") > 5, "SUPERSEDED").when(age < 172800, "CURRENT").when(age < 864000, "AGING").otherwise("STALE")
    return l.crossJoin(F.broadcast(v.obs.agg(F.max("available_at").alias("now")))).select("event_type", "day", state.alias("freshness"))


@query("px_quote_rows", "SELECT record_id, CASE record_id % 3 WHEN 0 THEN 'ltp' WHEN 1 THEN 'ohlc' ELSE 'quote' END AS mode, value AS last, CASE WHEN record_id % 3 > 0 THEN value * 0.5 END AS open, CASE WHEN record_id % 3 = 2 THEN revision END AS depth FROM obs")
def px_quote_rows(v):
    q = v.obs.select("record_id", F.struct("value", F.struct((F.col("value") * 0.5).alias("open")).alias("ohlc"), F.struct(F.col("revision").alias("depth")).alias("book")).alias("q"))
    m = F.col("record_id") % 3
    return q.select("record_id", F.when(m == 0, "ltp").when(m == 1, "ohlc").otherwise("quote").alias("mode"), F.col("q.value").alias("last"), F.when(m > 0, F.col("q.ohlc.open")).alias("open"), F.when(m == 2, F.col("q.book.depth")).alias("depth"))


@query("ag_health_rollup", f"WITH r AS (SELECT event_type, unnest(string_split({REASONS}, '|')) AS reason FROM events) SELECT event_type, reason, count(*) AS n FROM r WHERE reason <> '' GROUP BY 1, 2")
def ag_health_rollup(v):
    return v.t("events").select("event_type", F.explode(quality_reasons()).alias("reason")).groupBy("event_type", "reason").agg(F.count("*").alias("n"))


@query("ag_quality_diagnostics", "WITH x AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT CASE WHEN x.user_id IS NULL THEN 'EXPECTED_GAP' WHEN c.c_custkey IS NULL THEN 'UNEXPECTED' ELSE 'PRESENT' END AS state, count(*) AS identities, coalesce(sum(n), 0)::BIGINT AS quotes FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c FULL JOIN x ON x.user_id = c.c_custkey GROUP BY 1")
def ag_quality_diagnostics(v):
    """Accounts with money are expected to quote: identities by whether they should and do."""
    x = v.t("events").groupBy("user_id").agg(F.count("*").alias("n"))
    c = v.t("customer").where("c_acctbal > 0").select("c_custkey")
    state = F.when(F.col("user_id").isNull(), "EXPECTED_GAP").when(F.col("c_custkey").isNull(), "UNEXPECTED").otherwise("PRESENT")
    return c.join(x, F.col("user_id") == F.col("c_custkey"), "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("identities"), F.coalesce(F.sum("n"), F.lit(0)).alias("quotes"))
