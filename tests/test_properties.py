"""Causality, invariants and round trips of operators that SQL does not settle."""

import datetime

import pytest
from pyspark.sql import functions as F

from asofspark.operators import features as fx
from asofspark.operators import labels
from asofspark.plans.evidence import placebos
from asofspark.plans.registry import QUERIES
from asofspark.plans.sources import symbol_files
from asofspark.plans.views import Views
from asofspark.sources import readers

SF = "/root/testdata/sf0.001"
CUT = 200


@pytest.fixture(scope="module")
def grid(spark):
    return Views(spark, SF).grid_w.cache()


def changed_after(grid):
    late = F.col("sidx") > CUT
    return grid.withColumns({c: F.when(late, F.col(c) * 3 + 1).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume", "turnover")})


FEATURES = {
    "zscore": lambda g: g.select("instrument_id", "sidx", fx.zscore(F.col("close"), 20, 8).alias("x")),
    "return": lambda g: g.select("instrument_id", "sidx", fx.trailing_return(F.col("close"), 26, 4).alias("x")),
    "percentile": lambda g: g.select("instrument_id", "sidx", fx.causal_percentile(F.col("close"), 5).alias("x")),
    "true_range": lambda g: g.select("instrument_id", "sidx", fx.true_range(F.col("high"), F.col("low"), F.col("close")).alias("x")),
    "universe": lambda g: fx.universe_stats(g, 13).select("instrument_id", "sidx", F.col("liquidity").alias("x")),
    "actions": lambda g: fx.with_actions(g).select("instrument_id", "sidx", F.col("factor").alias("x")),
}


@pytest.mark.parametrize("name", FEATURES)
def test_later_rows_do_not_matter(grid, name):
    f = FEATURES[name]
    before, after = (f(g).where(F.col("sidx") <= CUT) for g in (grid, changed_after(grid)))
    assert before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty()


def test_ewm_matches_pandas(spark):
    import numpy as np
    import pandas as pd

    x = [1.0, None, 3.0, 4.0, None, None, 2.0, 8.0, None, 5.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "instrument_id int, sidx int, x double")
    got = [r["y"] for r in fx.ewm_over_gaps(df, "x", 3, "y").orderBy("sidx").collect()]
    want = pd.Series(x, dtype=float).ewm(alpha=1 / 3, adjust=False, min_periods=3).mean()
    assert np.allclose(np.array(got, float), want, equal_nan=True)


def test_non_overlap_is_the_loop(spark):
    rows = [(1, 1, 5), (1, 3, 6), (1, 5, 9), (1, 8, None), (1, 9, None), (1, 12, 13), (2, 2, 3), (2, 3, 4)]
    got = {(r[0], r[1]) for r in labels.non_overlapping(spark.createDataFrame(rows, "instrument_id int, sidx int, exit_sidx int")).collect()}
    assert got == {(1, 1), (1, 5), (1, 9), (2, 2), (2, 3)}


def test_first_touch_prefers_the_stop(spark):
    bars = [(1, i, float(o), float(h), float(l), float(c)) for i, (o, h, l, c) in enumerate([(9, 9, 9, 9), (10, 13, 8, 10), (10, 10, 10, 10), (11, 11, 11, 11)], 1)]
    g = spark.createDataFrame(bars, "instrument_id int, sidx int, open double, high double, low double, close double")
    p = spark.createDataFrame([(1, 1), (1, 2)], "instrument_id int, sidx int")
    got = {r["sidx"]: (r["exit_reason"], r["exit_sidx"]) for r in labels.first_touch(p, g, 1, 10.0, 20.0).collect()}
    assert got == {1: ("stop", 2), 2: ("time", 4)}


def test_placebos_keep_dates_and_counts(spark):
    v = Views(spark, SF)
    real = {r[0]: r[1] for r in v.picks.groupBy("sidx").count().collect()}
    priced = {r[0]: r[1] for r in v.grid_w.where("close is not null").groupBy("sidx").count().collect()}
    drawn = placebos(v, 3).groupBy("seed", "sidx").count().collect()
    assert drawn and all(r["count"] == min(real[r["sidx"]], priced[r["sidx"]]) for r in drawn)


def test_symbol_csvs(spark, tmp_path):
    (tmp_path / "ABC_DAILY.csv").write_text("date,open,high,low,close,volume,turnover\n2020-01-01,1,2,1,2,10,\n2020-01-02,1,2,1,3,10,99\n2021-01-01,1,1,1,1,1,1\n")
    got = [tuple(r) for r in readers.symbol_csvs(spark, f"{tmp_path}/*.csv", "2020-12-31").select("symbol", "session", "turnover").orderBy("session").collect()]
    assert got == [("ABC", datetime.date(2020, 1, 1), 20.0), ("ABC", datetime.date(2020, 1, 2), 99.0)]


def test_every_symbol_is_filed(spark):
    v = Views(spark, SF)
    got = symbol_files(v)
    want = v.bars_d.where("session <= date '1999-12-31'").select(F.col("instrument_id").cast("string").alias("symbol"), "session", F.round("close", 8).alias("close"))
    assert got.select("symbol").distinct().count() == want.select("symbol").distinct().count() > 5
    assert got.select(want.columns).exceptAll(want).isEmpty() and want.exceptAll(got.select(want.columns)).isEmpty()


def test_router_returns_every_symbol(spark):
    v = Views(spark, SF)
    got = {r[0]: r[1] for r in QUERIES["src_format_router"](spark, SF).groupBy("symbol").count().collect()}
    want = {str(r[0]): r[1] * (1 + (r[0] % 3 > 0 and r[0] % 4 > 0)) for r in v.bars_d.groupBy("instrument_id").count().collect()}
    assert got == want


def test_archives_are_routed_by_header(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", "SYMBOL, SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP\nABC,EQ,1,2,1,2,2,1,10,20,01-JAN-2020\n")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("b.csv", "TradDt,Sgmt,FinInstrmTp,TckrSymb,SctySrs,ClsPric\n2024-08-01,CM,STK,XYZ,EQ,5\n2024-08-01,FO,STK,NO,EQ,5\n")
    got = {(r["symbol"], r["close"]) for r in readers.routed_archives(spark, f"{tmp_path}/*.zip").collect()}
    assert got == {("ABC", 2.0), ("XYZ", 5.0)}


def test_html_labels_give_the_next_cell(spark):
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    inner = "<table>" + row("<b>Net</b> Sales/Income  from Operations", "1,234.5") + row("Total income from operations", "9") + row("Total Income", "", "(77)") + row("Total Expenditure", "-") + row("Basic EPS after extraordinary items", "2") + row("Basic EPS for continued and discontinued", "3") + "</table>"
    pages = [
        (1, "<ul><li><a>menu</a></li><li><a>other</a></li></ul><table><tr><td>Sales/Income from Operations</td><td>n.a.</td></tr></table>" + inner),
        (2, f"<table><tr><td>{inner}</td></tr></table>"), (3, "<table><tr><td>Sales/Income from operation<td>5<tr><td>Net profit (loss) for the period<td>NA"), (4, "<ul><li><a>menu</a></li></ul>"), (5, None),
    ]
    got = readers.html_label_values(spark.createDataFrame(pages, "page_id long, html string")).collect()
    assert len(got) == 5 * len(readers.RESULT_LABELS)
    by = {i: {r["field"]: r["value"] for r in got if r["page_id"] == i and r["value"] is not None} for i in range(1, 6)}
    full = {"revenue": 1234.5, "total_income": -77.0, "eps_basic": 3.0}
    assert by == {1: full, 2: full, 3: {"revenue": 5.0}, 4: {}, 5: {}}


def test_years_are_replaced_and_pruned(spark, tmp_path):
    cols = "session date, symbol string, series string, close double"
    day = lambda y: datetime.date(y, 1, 2)
    readers.write_years(spark.createDataFrame([(day(2019), "A", "EQ", 1.0), (day(2020), "A", "EQ", 1.0), (day(2020), "B", "BE", 1.0)], cols), str(tmp_path))
    readers.write_years(spark.createDataFrame([(day(2020), "A", "EQ", 9.0)], cols), str(tmp_path))
    got = {(r["session"].year, r["close"]) for r in readers.load_years(spark, str(tmp_path), "2019-01-01", "2020-12-31", ["session", "close"]).collect()}
    assert got == {(2019, 1.0), (2020, 9.0)}


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    assert readers.fingerprint(a).collect() == readers.fingerprint(a.orderBy(F.desc("a"))).collect()
    assert readers.fingerprint(a).collect() != readers.fingerprint(a.where("a = 1")).collect()


def test_immutable_sink_refuses_to_overwrite(spark, tmp_path):
    df = spark.range(3)
    readers.write_immutable(df, f"{tmp_path}/t")
    with pytest.raises(Exception, match="already exists"):
        readers.write_immutable(df, f"{tmp_path}/t")


def test_duplicate_dates_are_refused(spark):
    rows = spark.createDataFrame([("2020-01-01", "A", 5, 2), ("2020-01-01", "B", 1, 1), ("2020-01-02", "A", 1, 4)], "session string, participant string, long_qty long, short_qty long")
    rows = rows.withColumn("session", F.to_date("session"))
    got = readers.participant_net(rows, "A", "2020-01-01", "2020-12-31").orderBy("session").collect()
    assert [r["net"] for r in got] == [3, -3]
    with pytest.raises(ValueError, match="2020-01-01"):
        readers.participant_net(rows.unionByName(rows), "A", "2020-01-01", "2020-12-31")
    assert readers.participant_net(rows.unionByName(rows), "A", "2021-01-01", "2021-12-31").count() == 0


def test_security_master_needs_its_columns(spark, tmp_path):
    spark.createDataFrame([("1", "ABC", "EQ")], "Id string, TckrSymb string, SctySrs string").write.option("header", True).option("compression", "gzip").csv(str(tmp_path / "m"))
    with pytest.raises(ValueError, match="ISIN"):
        readers.security_master(spark, str(tmp_path / "m"))


def test_bounds_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame([(1, "EQ", 5.0, 1.0)], "instrument_id int, series string, delivery_pct double, turnover double").withColumn("session", F.lit("2020-01-05").cast("date")).write.parquet(path)
    df = readers.delivery(spark, path, "2020-01-01", "2020-02-01")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)  # the plan shows all pushed filters
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(session,2020-01-01)" in plan and "EqualTo(series,EQ)" in plan and "turnover" not in plan
    assert df.count() == 1


def test_every_flag_of_daily_bars_occurs(spark):
    from asofspark.plans.registry import QUERIES

    got = QUERIES["src_bar_normalize"](spark, SF)
    flags = {r["f"] for r in got.select(F.explode(F.split("flags", r"\|")).alias("f")).distinct().collect()} - {""}
    assert len(flags) == 21 and got.where("accepted").count() > 1000


def test_exit_grid_is_first_touch_by_cell(spark):
    from asofspark.operators import labels
    from asofspark.plans.views import Views

    v = Views(spark, SF)
    picks = v.picks.where("sidx % 5 = 0").cache()
    cells = labels.first_touch_grid(picks, v.grid_w, [3, 6], [5.0, 10.0], [1.0, 2.0]).cache()
    for h, s, r in ((3, 5.0, 1.0), (6, 10.0, 2.0), (6, 5.0, 2.0)):
        want = labels.first_touch(picks, v.grid_w, h, s, s * r).select("instrument_id", "sidx", "exit_reason", "gross_pct")
        got = cells.where((F.col("hold") == h) & (F.col("stop_pct") == s) & (F.col("rr") == r)).select(want.columns)
        assert got.count() and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_counts_before_over_range_partitions(spark):
    import random

    from asofspark.operators.ranks import with_counts_before

    r = random.Random(4)
    rows = [(r.randint(0, 40), i, r.randint(0, 3)) for i in range(500)]
    got = with_counts_before(spark.createDataFrame(rows, "x int, i int, w int").repartition(6), ["x", "i"], F.col("w")).collect()
    done, total = 0, sum(w for _, _, w in rows)
    want = {}
    for x, i, w in sorted(rows):
        want[i] = done
        done += w
    assert {g["i"]: g["before"] for g in got} == want and all(g["total"] == total for g in got)


def test_folds_reach_the_calendars_end(spark):
    from asofspark.plans.evidence import folds
    from asofspark.plans.views import Views

    v = Views(spark, SF)
    last = v.cal_w.count()
    f = folds(v).orderBy("fold").collect()
    assert f[0]["valid_from"] == 100 and f[-1]["valid_to"] == last
    assert all(a["valid_to"] + 1 == b["valid_from"] for a, b in zip(f, f[1:])) and all(a["train_to"] == a["valid_from"] - 6 for a in f)


def test_altered_chains_are_found(spark):
    from asofspark.plans.registry import QUERIES

    got = {r["event_id"]: r["fault"] for r in QUERIES["wn_hash_chain"](spark, SF).collect()}
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    assert got == {i: "LINK" if i % 101 == 0 else "CONTENT" for i in range(n) if i % 101 == 0 or i % 103 == 0}


def test_nearest_rows_make_no_product(spark):
    from asofspark.plans.registry import QUERIES

    plan = QUERIES["ag_neighbor_calibration"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
