"""Queries of the streaming twins, drained with availableNow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.readers import scratch
from ..streaming import ingest as st
from .registry import query
from .sources import BAR_ROWS, listings, raw_bars, told


def stream(v):
    return st.event_stream(v.spark, f"{v.sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("st_bar_ingest", f"WITH {BAR_ROWS.replace('bars_d', 'bars_w')} SELECT session_date, instrument_id, listing_id, source_record_id, revision_number, flags, flags = '' AS accepted FROM nm")
def st_bar_ingest(v):
    """Weekly bars in several files, fed one by one: the rules of src_bar_normalize, also where a duplicate or a parent
    is in another file."""
    path = scratch(v.spark)
    raw_bars(v, v.bars_w).repartition(3, "session_date").write.parquet(path)
    return told(st.ingest_bars(v.spark, path, listings(v.bars_w)))


@query("st_latest_revision", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def st_latest_revision(v):
    base = st.latest(stream(v).select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"], "365 days")
    newest = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x")
    return v.spark.read.parquet(base).groupBy("user_id", "event_type").agg(newest).select("user_id", "event_type", "x.*")


@query("st_quote_freshness", "SELECT date_trunc('day', ts) AS opens, event_type, count(*) AS n, max(ts) AS last_ts FROM events GROUP BY 1, 2")
def st_quote_freshness(v):
    base = st.windowed(stream(v).select("ts", "event_type"), "365 days", "1 day", ["event_type"])
    w = v.spark.read.parquet(base).groupBy("opens", "event_type").agg(F.max("n").alias("n"), F.max("last_ts").alias("last_ts"))
    return w.select("opens", "event_type", "n", "last_ts")
