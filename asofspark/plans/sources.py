"""Queries of sources, sinks and ingest routing over text made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.parsing import date_of, number
from ..sources import readers
from .registry import query

RAW = "br AS (SELECT session, instrument_id::VARCHAR AS symbol, CASE WHEN instrument_id % 5 = 0 THEN 'BE' ELSE 'EQ' END AS series, open, high, low, close, volume, turnover FROM bars_d)"


def raw_text(v, names):
    """Daily bars as text columns of a file layout, with padding and a malformed volume here and there."""
    k, pad = F.col("instrument_id"), lambda c: F.concat(F.lit(" "), c.cast("string"), F.lit(" "))
    bad = F.when((k + F.day("session")) % 13 == 0, F.lit("n/a")).otherwise(F.col("volume").cast("long").cast("string"))
    values = [F.date_format("session", "yyyy-MM-dd"), k.cast("string"), F.when(k % 5 == 0, "BE").otherwise("EQ"), *[pad(F.round(c, 8)) for c in ("open", "high", "low", "close")], pad(F.round("close", 8)), F.lit(""), bad, pad(F.col("turnover")), F.lit("7"), F.lit("INE")]
    return v.bars_d.select(*[x.alias(n) for n, x in zip(names, values, strict=True)], F.when(k % 3 == 0, "FO").otherwise("CM").alias("Sgmt"), F.when(k % 4 == 0, "IDX").otherwise("STK").alias("FinInstrmTp"))


PARSED = "session, symbol, series, round(open, 8) AS open, round(close, 8) AS close, CASE WHEN (symbol::INT + day(session)) % 13 <> 0 THEN volume END AS volume"


@query("src_bhav_legacy", f"WITH {RAW} SELECT {PARSED} FROM br")
def src_bhav_legacy(v):
    return readers.legacy(raw_text(v, readers.LEGACY)).select("session", "symbol", "series", "open", "close", "volume")


@query("src_bhav_udiff", f"WITH {RAW} SELECT {PARSED} FROM br WHERE symbol::INT % 3 <> 0 AND symbol::INT % 4 <> 0")
def src_bhav_udiff(v):
    return readers.udiff(raw_text(v, readers.UDIFF)).select("session", "symbol", "series", "open", "close", "volume")


@query("src_symbol_csv", "SELECT instrument_id::VARCHAR AS symbol, session, round(close, 8) AS close, round(round(close, 8) * volume, 8) AS turnover FROM bars_d WHERE session <= DATE '1999-12-31'")
def src_symbol_csv(v):
    return symbol_files(v)


def symbol_files(v):
    """Writes one CSV folder per symbol into the shared folder and reads all of them back by glob."""
    path = readers.scratch(v.spark)
    b = v.bars_d.select(F.concat(F.col("instrument_id").cast("string"), F.lit("_DAILY.csv")).alias("file"), F.col("session").cast("string").alias("date"), *[F.round(c, 8).alias(c) for c in ("open", "high", "low", "close")], "volume", F.lit(None).cast("double").alias("turnover"))
    b.repartition("file").write.partitionBy("file").option("header", True).csv(path)
    df = readers.symbol_csvs(v.spark, f"{path}/*/*.csv", "1999-12-31")
    symbol = F.regexp_extract(F.input_file_name(), r"file=(\w+)_DAILY\.csv", 1)
    return df.select(symbol.alias("symbol"), "session", "close", F.round("turnover", 8).alias("turnover"))


@query("src_symbol_provenance", "SELECT instrument_id::VARCHAR AS symbol, count(*) AS \"rows\", 0 AS dropped, min(session) AS first_day, max(session) AS last_day, 'ACCEPTED' AS status FROM bars_d WHERE session <= DATE '1999-12-31' GROUP BY 1 UNION ALL SELECT 'HEADLESS', 0, 1, NULL, NULL, 'REFUSED_COLUMNS' UNION ALL SELECT NULL, 0, 1, NULL, NULL, 'REFUSED_NAME'")
def src_symbol_provenance(v):
    """The symbol files again, with two that are refused: one without a header line and one of another name."""
    path = readers.scratch(v.spark)
    b = v.bars_d.where("session <= '1999-12-31'").select(F.concat(F.col("instrument_id").cast("string"), F.lit("_DAILY.csv")).alias("file"), F.col("session").cast("string").alias("date"), "open", "high", "low", "close", "volume")
    b.repartition("file").write.partitionBy("file").option("header", True).csv(path)
    line = v.spark.range(1).select(F.lit("1995-01-02,1,1,1,1,5\n1995-01-03,1,1,1,1,5").alias("value"))
    for name in ("HEADLESS_DAILY.csv", "notes.csv"):
        line.coalesce(1).write.text(f"{path}/file={name}")
    return readers.symbol_provenance(v.spark, path, "1999-12-31").where("size > 0").select("symbol", "rows", "dropped", "first_day", "last_day", "status")


CANONICAL = "session, symbol, series, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, round(close, 8) AS last, NULL::DOUBLE AS prev_close, CASE WHEN (symbol::INT + day(session)) % 13 <> 0 THEN volume END AS volume, turnover, 7.0 AS trades, 'INE' AS isin"


@query("src_format_router", f"WITH {RAW} SELECT {CANONICAL} FROM br UNION ALL SELECT {CANONICAL} FROM br WHERE symbol::INT % 3 <> 0 AND symbol::INT % 4 <> 0")
def src_format_router(v):
    """Zips one small file per layout, symbol and month into the shared folder, and reads all by their header."""
    import io
    import zipfile

    import pyarrow as pa

    path = readers.scratch(v.spark)

    def zipped(names):
        def run(batches):
            for b in batches:
                out = []
                for text in b.column("text").to_pylist():
                    buf = io.BytesIO()
                    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                        z.writestr("day.csv", ",".join([*names, "Sgmt", "FinInstrmTp"]) + "\n" + text)
                    out.append(buf.getvalue().hex())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

        return run

    for kind, names in (("legacy", readers.LEGACY), ("udiff", readers.UDIFF)):
        line = F.concat_ws(",", *[F.trim(F.col(c)) for c in [*names, "Sgmt", "FinInstrmTp"]])
        files = raw_text(v, names).groupBy(names[1], F.substring(names[0], 1, 7)).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text")).select("text")
        files.mapInArrow(zipped(names), "value string").write.text(f"{path}/{kind}")
    hexes = v.spark.read.text([f"{path}/legacy", f"{path}/udiff"])
    return readers.routed(hexes.select(F.lit("x").alias("path"), F.unhex("value").alias("content")))


@query("src_year_store", f"WITH {RAW}, y AS (SELECT year(session) AS year, count(*) AS n, count(DISTINCT session) AS days, count(DISTINCT symbol) AS symbols FROM br WHERE series = 'EQ' GROUP BY 1) SELECT *, CASE WHEN year % 2 = 0 THEN 'CACHED' ELSE 'BUILT' END AS status FROM y")
def src_year_store(v):
    """The even years are published first, so the second run finds them there and builds the others."""
    path = readers.scratch(v.spark)
    bars = readers.staged(readers.legacy(raw_text(v, readers.LEGACY)))
    readers.write_years(bars.where(F.year("session") % 2 == 0), path)
    return readers.write_years(bars, path).withColumnRenamed("rows", "n")


@query("src_bounded_load", f"WITH {RAW} SELECT session, symbol, round(close, 8) AS close FROM br WHERE series = 'EQ' AND session BETWEEN DATE '1997-03-01' AND DATE '1998-02-15'")
def src_bounded_load(v):
    path = readers.scratch(v.spark)
    readers.write_years(readers.legacy(raw_text(v, readers.LEGACY)), path)
    return readers.load_years(v.spark, path, "1997-03-01", "1998-02-15", ["session", "symbol", "close"])


@query("src_delivery", "SELECT instrument_id, session, round(100 * (instrument_id * 17 + volume) % 101, 4) AS delivery_pct FROM bars_d WHERE session BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND instrument_id % 5 <> 0")
def src_delivery(v):
    """A table of delivered shares is written, then read within dates."""
    path = readers.scratch(v.spark)
    pct = F.round((100 * (F.col("instrument_id") * 17 + F.col("volume"))) % 101, 4)
    v.bars_d.select("instrument_id", "session", F.when(F.col("instrument_id") % 5 == 0, "BE").otherwise("EQ").alias("series"), pct.alias("delivery_pct"), "turnover").write.parquet(path)
    return readers.delivery(v.spark, path, "1996-01-01", "1999-12-31")


@query("src_participant_net", "SELECT day AS session, sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0 END) - sum(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE 0 END) AS net FROM fills WHERE l_returnflag = 'A' AND day BETWEEN DATE '1993-01-01' AND DATE '2001-12-31' GROUP BY 1")
def src_participant_net(v):
    q = lambda odd: F.sum(F.when(F.col("l_linenumber") % 2 == odd, F.col("l_quantity")).otherwise(0))
    positions = v.fills.groupBy(F.col("day").alias("session"), F.col("l_returnflag").alias("participant")).agg(q(0).alias("long_qty"), q(1).alias("short_qty"))
    return readers.participant_net(positions, "A", "1993-01-01", "2001-12-31")


FUT_ROWS = "fc AS (SELECT instrument_id, session, expiry, CASE WHEN instrument_id % 4 = 0 THEN 'INDEX' ELSE 'STOCK' END AS asset_class, CASE WHEN (instrument_id + day(session)) % 7 = 0 THEN 'OPT' ELSE 'FUT' END AS contract_type, CASE WHEN (instrument_id + month(session)) % 9 = 0 THEN 0 ELSE settle END AS settle, settle * 0.5::DOUBLE + open_ * 0.5::DOUBLE AS close, CASE WHEN (instrument_id + day(session)) % 5 = 0 THEN 0 ELSE open_ END AS open FROM contracts)"


@query("src_fut_contracts", f"WITH {FUT_ROWS} SELECT instrument_id, session, expiry, CASE WHEN settle > 0 THEN settle ELSE close END AS price, CASE WHEN open > 0 THEN open END AS open_price FROM fc WHERE asset_class = 'STOCK' AND contract_type = 'FUT' AND expiry >= session AND session BETWEEN DATE '1993-01-01' AND DATE '2001-12-31'")
def src_fut_contracts(v):
    """A contract table of all kinds is written, then read."""
    i, path = F.col("instrument_id"), readers.scratch(v.spark)
    v.contracts.select(
        "instrument_id", "session", "expiry", F.when(i % 4 == 0, "INDEX").otherwise("STOCK").alias("asset_class"), F.when((i + F.day("session")) % 7 == 0, "OPT").otherwise("FUT").alias("contract_type"),
        F.when((i + F.month("session")) % 9 == 0, 0.0).otherwise(F.col("settle")).alias("settle"), (F.col("settle") * 0.5 + F.col("open_") * 0.5).alias("close"), F.when((i + F.day("session")) % 5 == 0, 0.0).otherwise(F.col("open_")).alias("open"), "oi",
    ).write.parquet(path)
    return readers.live_contracts(v.spark.read.parquet(path), "1993-01-01", "2001-12-31")


@query("src_filing_meta", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN (o_orderdate::DATE + 1)::DATE ELSE o_orderdate::DATE END AS filing_date, o_orderpriority LIKE '1%' AS consolidated FROM orders WHERE o_orderkey % 20 <> 0")
def src_filing_meta(v):
    """JSON records; the filing date falls back to the broadcast date, and records without either go."""
    k, d = F.col("o_orderkey"), F.date_format("o_orderdate", "dd-MMM-yyyy")
    rec = F.to_json(F.struct(k.alias("id"), F.when(k % 10 == 0, "-").otherwise(d).alias("filingDate"), F.when(k % 20 != 0, F.date_format(F.date_add("o_orderdate", 1), "yyyy-MM-dd")).alias("broadCastDate"), F.col("o_orderpriority").alias("kind")))
    j = v.t("orders").select(F.from_json(rec, "id long, filingDate string, broadCastDate string, kind string").alias("j")).select("j.*")
    day = F.coalesce(date_of(F.col("filingDate"), "dd-MMM-yyyy"), date_of(F.col("broadCastDate"), "yyyy-MM-dd"))
    return j.select("id", day.alias("filing_date"), F.col("kind").startswith("1").alias("consolidated")).where("filing_date is not null and id % 20 <> 0")


@query("src_shareholding_master", "SELECT o_orderkey AS id, o_orderdate::DATE AS filing_date, o_orderkey % 7 = 0 AS revised, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 75)::DOUBLE END AS promoter_pct FROM orders")
def src_shareholding_master(v):
    k = F.col("o_orderkey")
    rec = F.to_json(F.struct(k.alias("id"), F.date_format("o_orderdate", "dd-MMM-yyyy").alias("submissionDate"), F.when(k % 7 == 0, "Y").otherwise("N").alias("revised"), F.when(k % 11 == 0, "n.a.").otherwise((k % 75).cast("string")).alias("pr")))
    j = v.t("orders").select(F.from_json(rec, "id long, submissionDate string, revised string, pr string").alias("j")).select("j.*")
    return j.select("id", date_of(F.col("submissionDate"), "dd-MMM-yyyy").alias("filing_date"), (F.col("revised") == "Y").alias("revised"), F.col("pr").try_cast("double").alias("promoter_pct"))


@query("src_insider_records", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN (1000000 + o_orderkey)::DOUBLE END AS shares, o_orderdate::DATE AS traded FROM orders")
def src_insider_records(v):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, "-").otherwise(F.format_number(k + 1000000, 0))
    rec = F.to_json(F.struct(k.alias("id"), text.alias("secAcq"), F.date_format("o_orderdate", "dd-MMM-yyyy").alias("date")))
    j = v.t("orders").select(F.from_json(rec, "id long, secAcq string, date string").alias("j")).select("j.*")
    return j.select("id", number(F.col("secAcq")).alias("shares"), date_of(F.col("date"), "dd-MMM-yyyy").alias("traded"))


@query("src_xbrl_facts", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 THEN round(o_totalprice, 2) END AS revenue, round(o_totalprice + 1, 2) AS profit FROM orders")
def src_xbrl_facts(v):
    """One context's values by tag from an XML text column."""
    rev = F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit('<x:Revenue contextRef="OneD" decimals="2">'), F.format_string("%.2f", "o_totalprice"), F.lit("</x:Revenue>"))).otherwise("")
    xml = F.concat(F.lit("<xbrl>"), rev, F.lit('<x:Profit contextRef="FourD">1</x:Profit><x:Profit contextRef="OneD">'), F.format_string("%.2f", F.col("o_totalprice") + 1), F.lit("</x:Profit></xbrl>"))
    fact = lambda tag: F.nullif(F.regexp_extract("xml", rf'<\w+:{tag}[^>]*contextRef="OneD"[^>]*>([^<]*)<', 1), F.lit("")).try_cast("double")
    return v.t("orders").select(F.col("o_orderkey").alias("id"), xml.alias("xml")).select("id", fact("Revenue").alias("revenue"), fact("Profit").alias("profit"))


@query("src_xbrl_categories", "SELECT o_orderkey AS id, (o_orderkey % 60)::DOUBLE AS promoter_pct, CASE WHEN o_orderkey % 3 = 0 THEN 5.0 WHEN o_orderkey % 3 = 1 THEN 7.0 END AS fii_pct FROM orders")
def src_xbrl_categories(v):
    """The first present of several aliases per category; shares given as fractions are scaled by the master's value."""
    k = F.col("o_orderkey")
    scale = F.when(k % 2 == 0, (k % 60) / 100.0).otherwise((k % 60).cast("double"))
    fii = F.when(k % 3 == 0, "<c n='ForeignPortfolioInvestor'>5</c>").when(k % 3 == 1, "<c n='InstitutionsForeign'>7</c>").otherwise("")
    xml = F.concat(F.lit("<c n='PromoterGroup'>"), scale.cast("string"), F.lit("</c>"), fii)
    t = v.t("orders").select(k.alias("id"), xml.alias("xml"), (k % 60).cast("double").alias("master"))
    m = F.map_from_arrays(F.regexp_extract_all("xml", F.lit("n='(\\w+)'"), F.lit(1)), F.regexp_extract_all("xml", F.lit(">([0-9.]+)<"), F.lit(1)))
    t = t.withColumn("m", m)
    p = F.col("m")["PromoterGroup"].try_cast("double")
    p = F.when(F.abs(F.try_divide(p * 100, F.col("master")) - 1) <= 0.15, F.round(p * 100, 6)).otherwise(p)
    return t.select("id", p.alias("promoter_pct"), F.coalesce(F.col("m")["InstitutionsForeign"], F.col("m")["ForeignPortfolioInvestor"]).try_cast("double").alias("fii_pct"))


LABELS_SQL = """SELECT page_id, f.field, CASE WHEN page_id % 5 = 0 THEN NULL WHEN f.field = 'revenue' THEN 1000000 + page_id + 0.5 WHEN f.field = 'total_income' AND page_id % 3 > 0 THEN 2000000 + page_id
  WHEN f.field = 'net_profit' THEN -(1000 + page_id % 1000) WHEN f.field = 'eps_basic' AND page_id % 4 > 0 THEN page_id % 100 + 0.25 END::DOUBLE AS value
FROM pages, (VALUES ('revenue'), ('total_income'), ('total_expenses'), ('profit_before_tax'), ('net_profit'), ('eps_basic'), ('eps_diluted'), ('paidup_equity_capital'), ('reserves')) f(field)"""


@query("src_html_label_value", LABELS_SQL)
def src_html_label_value(v):
    """Result tables are put at the end of the given pages, after one without the anchor; amounts have commas, losses
    brackets, and every so often a label, an amount or the anchor is missing."""
    k = F.col("page_id")
    row = lambda label, value: F.concat(F.lit(f"<tr><td> {label} </td><td>"), value, F.lit("</td></tr>"))
    table = F.concat(
        F.lit("<table><tr><td>Total Income</td><td>7</td></tr></table><table><tr><th>Particulars</th><th>Amount</th></tr>"),
        F.when(k % 5 != 0, row("Net Sales/Income from\n Operations", F.format_number(k + 1000000 + 0.5, 1))).otherwise(""),
        F.when(k % 3 > 0, row("Total  Income", F.format_number(k + 2000000, 0))).otherwise(row("Total income (net)", F.lit("3"))),
        row("<b>Net Profit</b> / (Loss) for the period", F.concat(F.lit("("), F.format_number(k % 1000 + 1000, 0), F.lit(")"))),
        F.when(k % 4 > 0, row("Basic EPS before Extraordinary items", F.lit("n.a."))).otherwise(""),
        row("Basic EPS for continued and discontinued operations", F.when(k % 4 > 0, F.format_number(k % 100 + 0.25, 2)).otherwise("-")),
        F.lit("</table></body></html>"),
    )
    pages = v.t("pages").select("page_id", F.concat(F.regexp_replace(F.coalesce("html", F.lit("")), "</body>|</html>", ""), table).alias("html"))
    return readers.html_label_values(pages)


@query("src_mii_snapshot", "SELECT s_suppkey AS id, 'NSE:' || trim(s_name) || ':' || CASE WHEN s_suppkey % 5 = 0 THEN 'BE' ELSE 'EQ' END AS listing_id, 'INE' || s_suppkey AS isin FROM supplier WHERE s_name IS NOT NULL AND s_suppkey % 11 <> 0")
def src_mii_snapshot(v):
    """Gzipped CSV files of the security master, with blanks around cells and symbols left out here and there."""
    path, k = readers.scratch(v.spark), F.col("s_suppkey")
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    rows = v.t("supplier").select(k.cast("string").alias("Id"), F.when(k % 11 != 0, pad(F.col("s_name"))).alias("TckrSymb"), pad(F.when(k % 5 == 0, "BE").otherwise("EQ")).alias("SctySrs"), F.concat(F.lit("INE"), k.cast("string")).alias("ISIN"), F.lit("x").alias("FinInstrmNm"))
    rows.write.option("header", True).option("compression", "gzip").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.security_master(v.spark, path)


FNO = "fc AS (SELECT l_orderkey * 10 + l_linenumber AS fact_id, l_partkey % 1000 AS inst, last_day(l_shipdate::DATE) AS expiry, l_quantity FROM lineitem), mc AS (SELECT p_partkey % 1100 AS inst, count(*) AS copies, min(p_size) AS tag FROM part WHERE p_partkey % 9 > 0 GROUP BY 1)"
FNO_STATE = "CASE WHEN m.inst IS NULL THEN 'UNRESOLVED' WHEN copies > 1 AND tag > 20 THEN 'AMBIGUOUS' WHEN month(expiry) % 6 = 0 THEN 'EXPIRY_MISMATCH' ELSE 'MATCHED' END"


def fact_identity(v):
    f = v.t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), (F.col("l_partkey") % 1000).alias("inst"), F.last_day("l_shipdate").alias("expiry"), "l_quantity")
    m = v.t("part").where("p_partkey % 9 > 0").groupBy((F.col("p_partkey") % 1100).alias("inst")).agg(F.count("*").alias("copies"), F.min("p_size").alias("tag"))
    state = F.when(F.col("copies").isNull(), "UNRESOLVED").when(F.expr("copies > 1 and tag > 20"), "AMBIGUOUS").when(F.month("expiry") % 6 == 0, "EXPIRY_MISMATCH").otherwise("MATCHED")
    return f.join(m, "inst", "left").withColumn("state", state)


@query("jn_fact_identity", f"WITH {FNO} SELECT {FNO_STATE} AS state, count(*) AS n FROM fc f LEFT JOIN mc m ON m.inst = f.inst GROUP BY 1")
def jn_fact_identity(v):
    return fact_identity(v).groupBy("state").agg(F.count("*").alias("n"))


@query("src_fno_pair", f"WITH {FNO} SELECT fact_id, f.inst, expiry, {FNO_STATE} AS state, CASE WHEN l_quantity > 25 THEN 'PRESENT' ELSE 'MISSING' END AS quantity_state FROM fc f LEFT JOIN mc m ON m.inst = f.inst")
def src_fno_pair(v):
    return fact_identity(v).select("fact_id", "inst", "expiry", "state", F.when(F.col("l_quantity") > 25, "PRESENT").otherwise("MISSING").alias("quantity_state"))


def routed(v):
    """Events as JSON of a versioned schema; every so often a field is missing, unknown or of another type."""
    k = F.col("event_id")
    rec = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("id").alias("k"), k.cast("string").alias("v")), F.struct(F.lit("value").alias("k"), F.when(k % 13 == 0, "oops").otherwise(F.col("value").cast("string")).alias("v")),
        F.when(k % 11 > 0, F.struct(F.lit("kind").alias("k"), F.col("event_type").alias("v"))), F.when(k % 17 == 0, F.struct(F.lit("extra").alias("k"), F.lit("1").alias("v"))),
    ), lambda x: x.isNotNull()))
    return v.t("events").select("event_id", readers.schema_reasons(rec, {"id": "long", "value": "double", "kind": "string"}, {"trades": "int"}).alias("reasons"))


@query("src_schema_route", "SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0 THEN 'quarantine' ELSE 'accepted' END AS route, concat_ws('|', CASE WHEN event_id % 11 = 0 THEN 'MISSING_REQUIRED_FIELDS' END, CASE WHEN event_id % 13 = 0 THEN 'TYPE_MISMATCH' END, CASE WHEN event_id % 17 = 0 THEN 'UNKNOWN_FIELDS' END) AS reasons FROM events")
def src_schema_route(v):
    return routed(v).select("event_id", F.when(F.size("reasons") > 0, "quarantine").otherwise("accepted").alias("route"), F.array_join("reasons", "|").alias("reasons"))


@query("src_schema_enforce", "WITH r AS (SELECT CASE WHEN event_id % 13 <> 0 THEN value END AS x, CASE WHEN event_id % 11 <> 0 THEN event_type END AS kind FROM events) SELECT count(*) AS n, count(*) - count(x) AS bad_value, count(*) - count(kind) AS null_kind FROM r")
def src_schema_enforce(v):
    k = F.col("event_id")
    r = v.t("events").select(F.when(k % 13 == 0, "oops").otherwise(F.col("value").cast("string")).try_cast("double").alias("x"), F.when(k % 11 != 0, F.col("event_type")).alias("kind"))
    return r.agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull()).alias("bad_value"), F.count_if(F.col("kind").isNull()).alias("null_kind"))


BAR_ROWS = """b0 AS (SELECT *, instrument_id * 7 + date_diff('day', DATE '1992-01-01', session) AS x, session::TIMESTAMP AS t FROM bars_d),
b1 AS (SELECT x, session AS session_date, CASE WHEN x % 101 = 0 THEN NULL WHEN x % 103 = 0 THEN instrument_id + 1000 ELSE instrument_id END::BIGINT AS instrument_id,
  CASE WHEN x % 131 = 0 THEN '' WHEN x % 113 = 0 THEN 'LX' ELSE 'L' || instrument_id END AS listing_id, CASE WHEN x % 137 = 0 THEN ' ' ELSE 'exchange' END AS source_id,
  CASE WHEN x % 139 = 0 THEN NULL WHEN x % 149 = 0 THEN 'r' || instrument_id ELSE 'r' || instrument_id || '-' || session END AS source_record_id,
  t + CASE WHEN x % 107 = 0 THEN INTERVAL 34 HOUR ELSE INTERVAL 10 HOUR END AS event_time, t + CASE WHEN x % 127 = 0 THEN INTERVAL 9 HOUR ELSE INTERVAL 36 HOUR END AS published_at,
  t + CASE WHEN x % 109 = 0 THEN INTERVAL 8 HOUR ELSE INTERVAL 37 HOUR END AS retrieved_at, t + CASE WHEN x % 97 = 0 THEN INTERVAL 7 HOUR ELSE INTERVAL 38 HOUR END AS available_at,
  CASE WHEN x % 19 = 0 OR x % 89 = 0 THEN NULL ELSE open END AS open, CASE WHEN x % 89 = 0 THEN NULL WHEN x % 83 = 0 THEN low - 1 ELSE high END AS high, CASE WHEN x % 89 = 0 THEN NULL ELSE low END AS low,
  CASE WHEN x % 89 = 0 THEN NULL WHEN x % 79 = 0 THEN -close ELSE close END AS close, CASE WHEN x % 71 = 0 THEN NULL WHEN x % 73 = 0 THEN -volume ELSE volume END AS volume, CASE WHEN x % 67 = 0 THEN NULL ELSE turnover END AS turnover,
  CASE WHEN x % 61 = 0 THEN 0 ELSE 1 END AS revision_number, CASE WHEN x % 59 = 0 THEN 'r0' END AS supersedes_record_id FROM b0),
b2 AS (SELECT * EXCLUDE (x) FROM b1 UNION ALL SELECT session_date, instrument_id, listing_id, source_id, source_record_id || '-2', event_time, published_at + CASE WHEN x % 33 = 0 THEN INTERVAL 0 HOUR ELSE INTERVAL 1 HOUR END, retrieved_at + INTERVAL 1 HOUR, available_at + INTERVAL 1 HOUR, open, high, low, close, volume, turnover,
  CASE WHEN x % 55 = 0 THEN 3 ELSE 2 END, CASE WHEN x % 22 = 0 THEN NULL ELSE source_record_id END FROM b1 WHERE x % 11 = 0),
ls AS (SELECT DISTINCT instrument_id, 'L' || instrument_id AS listing_id FROM bars_d),
di AS (SELECT *, count(*) OVER (PARTITION BY source_record_id) AS c1, count(*) OVER (PARTITION BY instrument_id, event_time, revision_number) AS c2 FROM b2),
fl AS (SELECT d.*, l.instrument_id IS NOT NULL AS known, l.listing_id AS linked, EXISTS (SELECT 1 FROM b2 p WHERE p.source_record_id = d.supersedes_record_id AND p.instrument_id = d.instrument_id AND p.event_time = d.event_time AND p.revision_number = d.revision_number - 1 AND p.published_at < d.published_at) AS fits,
  (open IS NOT NULL)::INT + (high IS NOT NULL)::INT + (low IS NOT NULL)::INT + (close IS NOT NULL)::INT AS k FROM di d LEFT JOIN ls l ON l.instrument_id = d.instrument_id),
nm AS (SELECT *, concat_ws('|', CASE WHEN available_at < published_at THEN 'AVAILABLE_BEFORE_PUBLICATION' END, CASE WHEN c2 > 1 THEN 'DUPLICATE_REVISION_IDENTITY' END, CASE WHEN c1 > 1 THEN 'DUPLICATE_SOURCE_RECORD_ID' END,
  CASE WHEN event_time::DATE <> session_date THEN 'EVENT_SESSION_MISMATCH' END, CASE WHEN k = 4 AND (high < greatest(open, low, close) OR low > least(open, high, close)) THEN 'IMPOSSIBLE_OHLC' END, CASE WHEN known AND listing_id <> linked THEN 'INVALID_LISTING_LINKAGE' END,
  CASE WHEN revision_number < 1 THEN 'INVALID_REVISION_NUMBER' END, CASE WHEN (revision_number = 1 AND supersedes_record_id IS NOT NULL) OR (revision_number > 1 AND NOT fits) THEN 'INVALID_SUPERSESSION_CHAIN' END,
  CASE WHEN instrument_id IS NULL THEN 'MISSING_INSTRUMENT_ID' END, CASE WHEN coalesce(trim(listing_id), '') = '' THEN 'MISSING_LISTING_ID' END, CASE WHEN k < 4 THEN 'MISSING_OHLC' END, CASE WHEN coalesce(trim(source_id), '') = '' THEN 'MISSING_SOURCE_ID' END,
  CASE WHEN coalesce(trim(source_record_id), '') = '' THEN 'MISSING_SOURCE_RECORD_ID' END, CASE WHEN turnover IS NULL THEN 'MISSING_TURNOVER' END, CASE WHEN volume IS NULL THEN 'MISSING_VOLUME' END, CASE WHEN volume < 0 THEN 'NEGATIVE_VOLUME' END,
  CASE WHEN least(open, high, low, close) <= 0 THEN 'NON_POSITIVE_PRICE' END, CASE WHEN k BETWEEN 1 AND 3 THEN 'PARTIAL_OHLC' END, CASE WHEN published_at < event_time THEN 'PUBLISHED_BEFORE_EVENT' END, CASE WHEN retrieved_at < published_at THEN 'RETRIEVED_BEFORE_PUBLICATION' END, CASE WHEN NOT known THEN 'UNRESOLVED_INSTRUMENT' END) AS flags FROM fl)"""


def raw_bars(v, bars=None):
    """Daily bars as a source sends them, with faults of every kind by arithmetic on keys, and second revisions."""
    x, i, s, t = F.col("x"), F.col("instrument_id"), F.col("session"), F.col("session").cast("timestamp")
    b = (bars if bars is not None else v.bars_d).withColumn("x", i * 7 + F.datediff(s, F.lit("1992-01-01").cast("date")))
    after = lambda n, odd, usual: t + F.when(x % n == 0, F.make_dt_interval(F.lit(0), F.lit(odd))).otherwise(F.make_dt_interval(F.lit(0), F.lit(usual)))
    gone = x % 89 == 0
    first = b.select(
        "x", s.alias("session_date"), F.when(x % 101 == 0, None).when(x % 103 == 0, i + 1000).otherwise(i).cast("long").alias("instrument_id"),
        F.when(x % 131 == 0, "").when(x % 113 == 0, "LX").otherwise(F.concat(F.lit("L"), i.cast("string"))).alias("listing_id"), F.when(x % 137 == 0, " ").otherwise("exchange").alias("source_id"),
        F.when(x % 139 == 0, None).when(x % 149 == 0, F.concat(F.lit("r"), i.cast("string"))).otherwise(F.concat(F.lit("r"), i.cast("string"), F.lit("-"), s.cast("string"))).alias("source_record_id"),
        after(107, 34, 10).alias("event_time"), after(127, 9, 36).alias("published_at"), after(109, 8, 37).alias("retrieved_at"), after(97, 7, 38).alias("available_at"),
        F.when(gone | (x % 19 == 0), None).otherwise(F.col("open")).alias("open"), F.when(gone, None).when(x % 83 == 0, F.col("low") - 1).otherwise(F.col("high")).alias("high"), F.when(gone, None).otherwise(F.col("low")).alias("low"),
        F.when(gone, None).when(x % 79 == 0, -F.col("close")).otherwise(F.col("close")).alias("close"), F.when(x % 71 == 0, None).when(x % 73 == 0, -F.col("volume")).otherwise(F.col("volume")).alias("volume"), F.when(x % 67 == 0, None).otherwise(F.col("turnover")).alias("turnover"),
        F.when(x % 61 == 0, 0).otherwise(1).alias("revision_number"), F.when(x % 59 == 0, "r0").alias("supersedes_record_id"),
    )
    hour = F.make_dt_interval(F.lit(0), F.lit(1))
    second = first.where(x % 11 == 0).withColumns({
        "supersedes_record_id": F.when(x % 22 == 0, None).otherwise(F.col("source_record_id")), "source_record_id": F.concat("source_record_id", F.lit("-2")), "published_at": F.col("published_at") + F.when(x % 33 == 0, F.make_dt_interval()).otherwise(hour),
        "retrieved_at": F.col("retrieved_at") + hour, "available_at": F.col("available_at") + hour, "revision_number": F.when(x % 55 == 0, 3).otherwise(2),
    })
    return first.unionByName(second).drop("x")


@query("src_bar_normalize", f"WITH {BAR_ROWS} SELECT session_date, instrument_id, listing_id, source_record_id, revision_number, flags, flags = '' AS accepted FROM nm")
def src_bar_normalize(v):
    return told(readers.flagged_bars(raw_bars(v), listings(v.bars_d)))


def listings(bars):
    return bars.select("instrument_id").distinct().withColumn("listing_id", F.concat(F.lit("L"), F.col("instrument_id").cast("string")))


def told(b):
    return b.select("session_date", "instrument_id", "listing_id", "source_record_id", "revision_number", F.array_join("flags", "|").alias("flags"), (F.size("flags") == 0).alias("accepted"))


@query("src_object_manifest")
def src_object_manifest(v):
    path = readers.scratch(v.spark)
    v.bars_w.groupBy("instrument_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("session").cast("string"))), ","), 256).alias("h")).select(F.concat_ws(" ", "instrument_id", "h")).write.text(path)
    m = readers.manifest(v.spark, f"{path}/part-*")
    return m.agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"), F.count_if("conflict").alias("conflicts"))


@query("snk_immutable_parquet")
def snk_immutable_parquet(v):
    return readers.write_immutable(v.bars_w, readers.scratch(v.spark))


@query("snk_table_fingerprint")
def snk_table_fingerprint(v):
    return readers.fingerprint(v.t("orders"))
