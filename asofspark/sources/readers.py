"""Readers and routers: text in exchange layouts to typed tables, with what does not fit kept apart."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parsing import date_of, number

CANONICAL = ["session", "symbol", "series", "open", "high", "low", "close", "last", "prev_close", "volume", "turnover", "trades", "isin"]
# Column names of the two daily file layouts, in the order of CANONICAL.
LEGACY = ["TIMESTAMP", "SYMBOL", "SERIES", "OPEN", "HIGH", "LOW", "CLOSE", "LAST", "PREVCLOSE", "TOTTRDQTY", "TOTTRDVAL", "TOTALTRADES", "ISIN"]
UDIFF = ["TradDt", "TckrSymb", "SctySrs", "OpnPric", "HghPric", "LwPric", "ClsPric", "LastPric", "PrvsClsgPric", "TtlTradgVol", "TtlTrfVal", "TtlNbOfTxsExctd", "ISIN"]
NUMERIC = CANONICAL[3:12]


def symbol_csvs(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """<SYMBOL>_DAILY.csv files (date, open, high, low, close, volume[, turnover]) to long bars dated up to as_of."""
    schema = "date string, open double, high double, low double, close double, volume double, turnover double"
    df = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    day = F.col("date").try_cast("date")
    symbol = F.regexp_extract(F.input_file_name(), r"([^/]+)_DAILY\.csv", 1)
    rows = df.select(symbol.alias("symbol"), day.alias("session"), "open", "high", "low", "close", "volume", F.coalesce("turnover", F.col("close") * F.col("volume")).alias("turnover"))
    return rows.where(F.col("session") <= F.lit(as_of).cast("date"))


SYMBOL_COLUMNS = ["date", "open", "high", "low", "close", "volume"]


def symbol_provenance(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """A row for each file under path: file, size, modified, symbol, rows (dated, up to as_of), dropped (other lines),
    first_day, last_day and status. REFUSED_NAME is a file that is not <SYMBOL>_DAILY.csv, REFUSED_COLUMNS one whose
    first line lacks a column, EMPTY one without rows that count; the others are ACCEPTED.

    The path, size and time are the file metadata that Spark gives with each file; it leaves out files without a byte."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    f = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"), F.split(F.col("content").cast("string"), "\r?\n").alias("lines"))
    head = F.transform(F.split(F.lower(F.get("lines", 0)), ","), lambda c: F.trim(c))
    symbol = F.nullif(F.regexp_extract(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), r"([^/=]+)_DAILY\.csv", 1), F.lit(""))
    f = f.select("file", "size", "modified", symbol.alias("symbol"), head.alias("head"), F.filter(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1))), lambda x: F.trim(x) != "").alias("lines"))
    fits = F.forall(F.array(*[F.lit(c) for c in SYMBOL_COLUMNS]), lambda c: F.array_contains(F.col("head"), c))
    at = (F.array_position("head", "date") - 1).cast("int")
    day = lambda x: F.trim(F.get(F.split(x, ","), at)).try_cast("date")
    days = F.filter(F.transform("lines", day), lambda d: d <= F.lit(as_of).cast("date"))
    f = f.withColumns({"fits": fits, "days": F.when(F.col("symbol").isNotNull() & fits, days).otherwise(F.array().cast("array<date>"))})
    status = F.when(F.col("symbol").isNull(), "REFUSED_NAME").when(~F.col("fits"), "REFUSED_COLUMNS").when(F.size("days") == 0, "EMPTY").otherwise("ACCEPTED")
    n = F.size("days")
    return f.select("file", "size", "modified", "symbol", n.cast("long").alias("rows"), (F.size("lines") - n).cast("long").alias("dropped"), F.array_min("days").alias("first_day"), F.array_max("days").alias("last_day"), status.alias("status"))


def _canonical(df: DataFrame, names: list[str], *formats: str) -> DataFrame:
    have = {c.strip().lower(): c for c in df.columns}
    text = lambda n: F.trim(F.col(f"`{have[n.lower()]}`")) if n.lower() in have else F.lit(None).cast("string")
    out = [date_of(text(names[0]), *formats).alias("session")]
    for name, n in zip(CANONICAL[1:], names[1:], strict=True):
        out.append((text(n).try_cast("double") if name in NUMERIC else text(n)).alias(name))
    return df.select(*out)


def legacy(df: DataFrame) -> DataFrame:
    """Text columns of the legacy layout to the canonical ones; trades and isin are null where the layout lacks them."""
    return _canonical(df, LEGACY, "dd-MMM-yyyy", "yyyy-MM-dd")


def udiff(df: DataFrame) -> DataFrame:
    """The modern layout: cash-market stocks only."""
    return _canonical(df.where((F.col("Sgmt") == "CM") & (F.col("FinInstrmTp") == "STK")), UDIFF, "yyyy-MM-dd")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in z.namelist():
                    head, *rest = z.read(name).decode("utf-8", "replace").splitlines() or [""]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rest), pa.string()), pa.array([head] * len(rest), pa.string()), pa.array(rest, pa.string())], names=["path", "head", "line"])


def routed_archives(spark: SparkSession, path: str) -> DataFrame:
    """Zipped daily files of either layout, told apart by their header line, as canonical rows."""
    return routed(spark.read.format("binaryFile").load(path).select("path", "content"))


def routed(archives: DataFrame) -> DataFrame:
    """Archives (path, content) of daily files of either layout as canonical rows."""
    lines = archives.mapInArrow(_lines, "path string, head string, line string")
    cell = lambda name: F.get(F.split("line", ","), (F.array_position(F.transform(F.split("head", ","), lambda c: F.trim(c)), name) - 1).cast("int"))
    pick = lambda names: lines.where(F.contains("head", F.lit(names[1]))).select(*[cell(n).alias(n) for n in [*names, *(["Sgmt", "FinInstrmTp"] if names is UDIFF else [])]])
    return legacy(pick(LEGACY)).unionByName(udiff(pick(UDIFF)))


# Labels of old result pages by field, the preferred rule first: the whole cell, or all parts in one cell.
RESULT_LABELS = {
    "revenue": [("parts", ["sales/income from operation"])],
    "total_income": [("whole", ["total income"])],
    "total_expenses": [("whole", ["total expenses"]), ("whole", ["total expenditure"])],
    "profit_before_tax": [("parts", ["activities before tax"])],
    "net_profit": [("parts", ["net profit", "for the period"])],
    "eps_basic": [("parts", ["basic eps", "continued and discontinued"]), ("parts", ["basic eps", "after extraordinary"])],
    "eps_diluted": [("parts", ["diluted eps", "continued and discontinued"]), ("parts", ["diluted eps", "after extraordinary"])],
    "paidup_equity_capital": [("parts", ["paid-up equity share capital"]), ("parts", ["paid up equity share capital"])],
    "reserves": [("parts", ["reserve", "excluding revaluation"])],
}
_HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
_CELL = r"(?is)<t[dh]\b[^>]*>(.*?)(?=</?(?:t[dhr]|table)\b|\z)"
_REFERENCES = {"&nbsp;": " ", "&#160;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def table_cells(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) -> (page_id, table_no, cell_no, cell, following): the cells with text of each table, in
    order, and each one's next. A table is what lies between its opening tag and the next one's, so one within another
    is a table of its own; scripts, styles and comments are left out, white space is one space."""
    parts = F.split(F.regexp_replace("html", _HIDDEN, ""), r"(?i)<table\b")
    tables = pages.select("page_id", F.posexplode(parts).alias("table_no", "part")).where("table_no > 0")
    text = F.regexp_replace("raw", "<[^>]*>", "")
    for name, character in _REFERENCES.items():
        text = F.replace(text, F.lit(name), F.lit(character))
    cells = tables.select("page_id", "table_no", F.posexplode(F.regexp_extract_all("part", F.lit(_CELL), F.lit(1))).alias("cell_no", "raw"))
    cells = cells.select("page_id", "table_no", "cell_no", F.trim(F.regexp_replace(text, r"[\s\x{A0}]+", " ")).alias("cell")).where("cell <> ''")
    order = Window.partitionBy("page_id", "table_no").orderBy("cell_no")
    return cells.withColumn("following", F.lead("cell").over(order))


def html_label_values(pages: DataFrame, labels: dict[str, list[tuple[str, list[str]]]] = RESULT_LABELS, anchor: str = "revenue") -> DataFrame:
    """pages (page_id, html) -> page_id, field, value: a row per page and field, from the first table whose anchor field
    has an amount. A field's value is the amount in the cell that follows the first cell of the first rule that any cell
    fits; it is null where a label or an amount is missing. The rules are a short table that each cell meets."""
    spark = pages.sparkSession
    rules = spark.createDataFrame([(f, i, kind, parts) for f, rs in labels.items() for i, (kind, parts) in enumerate(rs)], "field string, rank int, kind string, parts array<string>")
    pages = pages.select(F.col("page_id").cast("long"), "html")
    low = F.lower("cell")
    fits = F.when(F.col("kind") == "whole", low == F.get("parts", 0)).otherwise(F.forall("parts", lambda p: F.contains(low, p)))
    hits = table_cells(pages).where("following is not null").crossJoin(F.broadcast(rules)).where(fits)
    first = hits.groupBy("page_id", "table_no", "field").agg(number(F.min_by("following", F.struct("rank", "cell_no"))).alias("value"))
    first = first.where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    chosen = first.where(F.col("field") == anchor).groupBy("page_id").agg(F.min("table_no").alias("table_no"))
    values = first.join(chosen, ["page_id", "table_no"]).select("page_id", "field", "value")
    every = pages.select("page_id", F.explode(F.array(*[F.lit(f) for f in labels])).alias("field"))
    return every.join(values, ["page_id", "field"], "left")


MARKER = "folder string, part int, n long, row_hash_sum string, schema_hash string, source_hash string, days long, symbols long, published_at timestamp"


def _markers(spark: SparkSession, path: str) -> DataFrame:
    """What has been published under path. A marker file appears as a whole or not at all."""
    try:
        return spark.read.schema(MARKER).parquet(f"{path}/published")
    except AnalysisException:  # nothing is published yet
        return spark.createDataFrame([], MARKER)


def _publish(markers: DataFrame, path: str) -> None:
    columns = {c.split()[0] for c in MARKER.split(", ")}
    rows = markers.withColumn("published_at", F.current_timestamp())
    rows = rows.withColumns({c: F.lit(None) for c in columns - set(rows.columns)}).select(*[F.col(n).cast(t) for n, t in (c.split() for c in MARKER.split(", "))])
    rows.coalesce(1).write.mode("append").parquet(f"{path}/published")


def _hash_sum(df: DataFrame) -> Column:
    return F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")).cast("string")


def write_years(bars: DataFrame, path: str, keep_series: tuple[str, ...] = ("EQ",)) -> DataFrame:
    """Publishes the years that bars holds, and returns a row for each: year, rows, days, symbols and status.

    A year whose published rows have the content hash of those of bars is CACHED and not written. The others are BUILT:
    written aside, and then named by one marker, so that readers see a year as it was or as it is, and nothing of a write
    that was killed. Years that bars does not hold stay as they are."""
    spark = bars.sparkSession
    kept = bars.where(F.col("series").isin(*keep_series)).withColumn("year", F.year("session"))
    years = staged(kept.groupBy("year").agg(F.count("*").alias("n"), F.countDistinct("session").alias("days"), F.countDistinct("symbol").alias("symbols"), _hash_sum(kept).alias("source_hash")))
    there = _latest_years(spark, path).select(F.col("part").alias("year"), F.col("source_hash").alias("published"))
    states = staged(years.join(there, "year", "left").withColumn("status", F.when(F.col("published") == F.col("source_hash"), "CACHED").otherwise("BUILT")))
    built = states.where("status = 'BUILT'")
    if not built.isEmpty():
        folder = f"data-{uuid.uuid4().hex}"
        rows = kept.join(F.broadcast(built.select("year")), "year", "left_semi")  # a row per year
        rows.repartitionByRange("year", "symbol", "session").sortWithinPartitions("year", "symbol", "session").write.partitionBy("year").parquet(f"{path}/{folder}")
        _publish(built.select(F.lit(folder).alias("folder"), F.col("year").alias("part"), "n", "source_hash", "days", "symbols"), path)
    return states.select("year", F.col("n").alias("rows"), "days", "symbols", "status")


def _latest_years(spark: SparkSession, path: str) -> DataFrame:
    return _markers(spark, path).where("part is not null").groupBy("part").agg(F.max_by(F.struct("folder", "n", "source_hash"), F.struct("published_at", "folder")).alias("x")).select("part", "x.*")


def load_years(spark: SparkSession, path: str, start: str, end: str, columns: list[str]) -> DataFrame:
    """Bars of [start, end] from the years published last: only their folders are listed and read."""
    years = _latest_years(spark, path).where((F.col("part") >= int(start[:4])) & (F.col("part") <= int(end[:4])))
    found = [f"{path}/{r['folder']}/year={r['part']}" for r in years.orderBy("part").collect()]  # a row per year
    if not found:
        raise FileNotFoundError(f"no year from {start[:4]} to {end[:4]} is published in {path}")
    return spark.read.parquet(*found).where(F.col("session").between(start, end)).select(*columns)


def write_immutable(df: DataFrame, path: str) -> DataFrame:
    """Publishes a table that must not exist yet, and returns its fingerprint.

    Rows are written aside and their fingerprint is taken from what was written; one marker then names both. A write that
    is killed before it leaves no table, and can be repeated."""
    spark = df.sparkSession
    if not _markers(spark, path).isEmpty():
        raise FileExistsError(f"{path} already exists")
    folder = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    found = staged(fingerprint(spark.read.parquet(f"{path}/{folder}")))
    _publish(found.withColumn("folder", F.lit(folder)), path)
    return found


def load_immutable(spark: SparkSession, path: str) -> DataFrame:
    """A published table, after its rows were held against the fingerprint of its marker. Of two writers that published
    at once the first counts."""
    first = _markers(spark, path).orderBy("published_at", "folder").first()
    if first is None:
        raise FileNotFoundError(f"{path} is not published")
    df = spark.read.parquet(f"{path}/{first['folder']}")
    now = fingerprint(df).first()
    if any(now[c] != first[c] for c in ("n", "row_hash_sum", "schema_hash")):
        raise ValueError(f"{path} is not what was published")
    return df


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive hash of a table: rows, the decimal sum of row hashes, and a hash of the schema."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sum(h).cast("string").alias("row_hash_sum")).withColumn("schema_hash", F.sha2(F.lit(df.schema.json()), 256))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Content-addressed objects under a path: name, size, sha256, and whether one name has several contents."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    o = f.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    names = o.groupBy("name").agg(F.countDistinct("sha256").alias("k"))
    return o.join(names, "name").select("name", "size", "sha256", (F.col("k") > 1).alias("conflict"))


def verify_manifest(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Two manifests (name, size, sha256; a name once in stored) -> name and state: OK, CHANGED, MISSING (not found any
    more) or NEW (not stored), a row for each name."""
    f = found.groupBy("name").agg(F.collect_set("sha256").alias("_now"))
    s = stored.select("name", F.col("sha256").alias("_then"))
    state = F.when(F.col("_now").isNull(), "MISSING").when(F.col("_then").isNull(), "NEW").when((F.size("_now") == 1) & (F.get("_now", 0) == F.col("_then")), "OK").otherwise("CHANGED")
    return s.join(f, "name", "full_outer").select("name", state.alias("state"))


def schema_reasons(record: Column, required: dict[str, str], optional: dict[str, str]) -> Column:
    """Sorted reasons for which a JSON object (as a string map) does not fit a schema of field: type."""
    keys = F.map_keys(record)
    every = required | optional
    missing = F.size(F.array_except(F.array(*[F.lit(k) for k in required]), keys)) > 0
    unknown = F.size(F.array_except(keys, F.array(*[F.lit(k) for k in every]))) > 0
    bad = F.lit(False)
    for k, t in every.items():
        bad = bad | (record[k].isNotNull() & record[k].try_cast(t).isNull())
    return F.array_compact(F.array(F.when(missing, "MISSING_REQUIRED_FIELDS"), F.when(bad, "TYPE_MISMATCH"), F.when(unknown, "UNKNOWN_FIELDS")))


def delivery(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Delivered share of EQ names by day within [start, end]: bounds and columns reach the scan."""
    rows = spark.read.parquet(path).where(F.col("session").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.col("series") == "EQ"))
    return rows.select("instrument_id", "session", "delivery_pct")


def participant_net(positions: DataFrame, participant: str, start: str, end: str) -> DataFrame:
    """positions (session, participant, long_qty, short_qty) -> session, net of one participant within [start, end].
    A date that occurs twice is refused with an error."""
    mine = positions.where((F.col("participant") == participant) & F.col("session").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    twice = mine.groupBy("session").agg(F.count("*").alias("n")).where("n > 1").orderBy("session").limit(3).collect()
    if twice:
        raise ValueError(f"{participant} has several rows on {[str(r['session']) for r in twice]}")
    return mine.select("session", (F.col("long_qty") - F.col("short_qty")).alias("net"))


def live_contracts(contracts: DataFrame, start: str, end: str) -> DataFrame:
    """Stock futures that have not expired: price is the settlement if positive, else the close; an open of 0 or less
    is null. Filters are on plain columns, so they reach the scan."""
    some = contracts.where((F.col("asset_class") == "STOCK") & (F.col("contract_type") == "FUT") & (F.col("expiry") >= F.col("session")))
    some = some.where(F.col("session").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    price = F.when(F.col("settle") > 0, F.col("settle")).otherwise(F.col("close"))
    return some.select("instrument_id", "session", "expiry", price.alias("price"), F.when(F.col("open") > 0, F.col("open")).alias("open_price"))


SECURITY_COLUMNS = ("Id", "TckrSymb", "SctySrs", "ISIN")


def security_master(spark: SparkSession, path: str) -> DataFrame:
    """Gzipped CSV snapshots of the security master -> id, listing_id, isin. A missing column is an error; rows without
    a symbol go."""
    df = spark.read.option("header", True).csv(path)
    missing = [c for c in SECURITY_COLUMNS if c not in {x.strip() for x in df.columns}]
    if missing:
        raise ValueError(f"security master without {missing}")
    df = df.toDF(*[c.strip() for c in df.columns])
    cell = {c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in SECURITY_COLUMNS}
    rows = df.select(cell["Id"].cast("long").alias("id"), F.concat(F.lit("NSE:"), cell["TckrSymb"], F.lit(":"), cell["SctySrs"]).alias("listing_id"), cell["ISIN"].alias("isin"))
    return rows.where("listing_id is not null")


DUPLICATE_ID, DUPLICATE_REVISION, BROKEN_CHAIN = "DUPLICATE_SOURCE_RECORD_ID", "DUPLICATE_REVISION_IDENTITY", "INVALID_SUPERSESSION_CHAIN"


def flagged_bars(bars: DataFrame, listings: DataFrame) -> DataFrame:
    """Daily bars with flags, the sorted names of all 21 rules that a row breaks; rows without any are accepted.

    bars: source_record_id, source_id, instrument_id, listing_id, session_date, event_time, published_at, retrieved_at,
    available_at, open, high, low, close, volume, turnover, revision_number, supersedes_record_id. listings:
    instrument_id, listing_id, one row each. Duplicates are found by counts per key that are joined back, and a
    revision's parent by an equi join on record, instrument, event and number.
    """
    ids = bars.groupBy("source_record_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("source_record_id").alias("_dup"), F.lit(True).alias("_again"))
    key = ["instrument_id", "event_time", "revision_number"]
    revisions = bars.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(c).alias(f"_{c}") for c in key], F.lit(True).alias("_same_revision"))
    parents = bars.where("source_record_id is not null").groupBy("source_record_id", *key).agg(F.min("published_at").alias("_parent_at"))
    parents = parents.select(F.col("source_record_id").alias("_parent"), F.col("instrument_id").alias("_p_instrument"), F.col("event_time").alias("_p_event"), (F.col("revision_number") + 1).alias("_p_next"), "_parent_at")
    b = bars.join(ids, F.col("source_record_id").eqNullSafe(F.col("_dup")), "left")
    b = b.join(revisions, (F.col("instrument_id").eqNullSafe(F.col("_instrument_id"))) & (F.col("event_time") == F.col("_event_time")) & (F.col("revision_number") == F.col("_revision_number")), "left")
    b = b.join(parents, (F.col("supersedes_record_id") == F.col("_parent")) & (F.col("instrument_id") == F.col("_p_instrument")) & (F.col("event_time") == F.col("_p_event")) & (F.col("revision_number") == F.col("_p_next")), "left")
    orphan = (F.col("revision_number") > 1) & ~F.coalesce(F.col("_parent_at") < F.col("published_at"), F.lit(False))
    b = b.withColumns({DUPLICATE_ID: F.col("_again"), DUPLICATE_REVISION: F.col("_same_revision"), BROKEN_CHAIN: orphan})
    return flagged_rows(b, listings, [DUPLICATE_ID, DUPLICATE_REVISION, BROKEN_CHAIN]).select(*bars.columns, "flags")


def flagged_rows(bars: DataFrame, listings: DataFrame, given: list[str]) -> DataFrame:
    """bars with flags: the sorted names of the rules that a row breaks by itself, and of those of the flags in given
    (boolean columns) that are true; BROKEN_CHAIN is also the row's own fault if a first revision supersedes one."""
    known = listings.select(F.col("instrument_id").alias("_known"), F.col("listing_id").alias("_listing"))
    b = bars.join(known, F.col("instrument_id") == F.col("_known"), "left")
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    present = sum((p.isNotNull().cast("int") for p in prices[1:]), prices[0].isNotNull().cast("int"))
    empty = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    rules = {
        "AVAILABLE_BEFORE_PUBLICATION": F.col("available_at") < F.col("published_at"),
        "EVENT_SESSION_MISMATCH": F.to_date("event_time") != F.col("session_date"),
        "IMPOSSIBLE_OHLC": (present == 4) & ((F.col("high") < F.greatest("open", "low", "close")) | (F.col("low") > F.least("open", "high", "close"))),
        "INVALID_LISTING_LINKAGE": F.col("_known").isNotNull() & ~F.col("_listing").eqNullSafe(F.col("listing_id")),
        "INVALID_REVISION_NUMBER": F.col("revision_number") < 1,
        BROKEN_CHAIN: (F.col("revision_number") == 1) & F.col("supersedes_record_id").isNotNull(),
        "MISSING_INSTRUMENT_ID": empty("instrument_id"),
        "MISSING_LISTING_ID": empty("listing_id"),
        "MISSING_OHLC": present < 4,
        "MISSING_SOURCE_ID": empty("source_id"),
        "MISSING_SOURCE_RECORD_ID": empty("source_record_id"),
        "MISSING_TURNOVER": F.col("turnover").isNull(),
        "MISSING_VOLUME": F.col("volume").isNull(),
        "NEGATIVE_VOLUME": F.col("volume") < 0,
        "NON_POSITIVE_PRICE": F.least(*prices) <= 0,
        "PARTIAL_OHLC": (present > 0) & (present < 4),
        "PUBLISHED_BEFORE_EVENT": F.col("published_at") < F.col("event_time"),
        "RETRIEVED_BEFORE_PUBLICATION": F.col("retrieved_at") < F.col("published_at"),
        "UNRESOLVED_INSTRUMENT": F.col("_known").isNull(),
    }
    told = {f: F.coalesce(F.col(f), F.lit(False)) for f in given}
    every = {name: F.coalesce(rules.get(name, F.lit(False)), F.lit(False)) | told.get(name, F.lit(False)) for name in sorted({*rules, *told})}
    return b.withColumn("flags", F.array_compact(F.array(*[F.when(rule, name) for name, rule in every.items()]))).drop("_known", "_listing")


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: in spark.checkpoint.dir, or a temporary one where that is unset and all
    tasks run on this machine (tests). A cluster without the setting is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="asofspark-")
    return f"{base}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Writes df to a folder that all executors share and reads it again, so that later passes see the same rows in the
    same partitions, after lost executors too."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
