"""Structured Streaming twins of batch operators. Each runs until its source is drained and returns what it wrote."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.readers import BROKEN_CHAIN, DUPLICATE_ID, DUPLICATE_REVISION, flagged_rows, scratch


def drained(stream: DataFrame, mode: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Runs a stream over all that its source holds; checkpoints go to the shared folder."""
    path = f"{scratch(stream.sparkSession)}/progress"
    stream.writeStream.outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a folder of Parquet files, or over one file of that name."""
    batch = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    files = batch.inputFiles()
    if len(files) == 1 and files[0].rstrip("/").endswith(f"/{name}"):
        return spark.readStream.schema(batch.schema).option("pathGlobFilter", name).option("recursiveFileLookup", True).parquet(folder)
    return spark.readStream.schema(batch.schema).parquet(path)


def ingest(events: DataFrame, reasons) -> tuple[str, str]:
    """Splits a stream into accepted and quarantined rows; returns the two folders. A batch that is repeated after a
    failure replaces its own folder, so each row is written once."""
    spark = events.sparkSession
    base = scratch(spark)

    def sink(batch: DataFrame, n: int) -> None:
        flagged = batch.withColumn("reasons", reasons)
        flagged.where(F.size("reasons") == 0).write.mode("overwrite").parquet(f"{base}/accepted/batch={n}")
        flagged.where(F.size("reasons") > 0).write.mode("overwrite").parquet(f"{base}/quarantine/batch={n}")

    drained(events, "append", sink)
    return f"{base}/accepted", f"{base}/quarantine"


def latest(events: DataFrame, keys: list[str], order: list[str], delay: str) -> str:
    """Latest row per key of each batch of a stream; those of later batches replace the earlier ones downstream. What the
    stream keeps is the event ids of the last `delay`, for dropping repeats, and nothing per key."""
    spark = events.sparkSession
    base = scratch(spark)
    rows = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    newest = F.max_by(F.struct(*[c for c in events.columns if c not in keys]), F.struct(*order)).alias("x")

    def sink(batch: DataFrame, n: int) -> None:
        batch.groupBy(*keys).agg(newest).select(*keys, "x.*").write.mode("overwrite").parquet(f"{base}/batch={n}")

    drained(rows, "append", sink)
    return base


def windowed(events: DataFrame, delay: str, width: str, keys: list[str]) -> str:
    """Counts, sums and the last time per tumbling window and keys, with late rows up to delay."""
    base = scratch(events.sparkSession)
    agg = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    drained(agg, "update", lambda batch, n: batch.select(F.col("w.start").alias("opens"), *keys, "n", "last_ts").write.mode("overwrite").parquet(f"{base}/batch={n}"))
    return base


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MEMBER, PARENT, CHILD = "member", "parent", "child"


class Relations(StatefulProcessor):
    """What rows of one key have to do with each other, across micro-batches.

    Members of a key are duplicates as soon as there are two: the first is kept by its id until then, so a key's state has
    one size however many there are. A child waits until a parent that was published before it comes, or until patience
    has passed; of parents the first time of publication is kept. All state goes ttl_ms after it was last written."""

    def __init__(self, ttl_ms: int | None, patience_ms: int | None):
        self.ttl_ms, self.patience_ms = ttl_ms, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "uid string, several boolean", self.ttl_ms)
        self.parent = handle.getValueState("parent", "published long", self.ttl_ms)
        self.waiting = handle.getListState("waiting", "uid string, published long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        facts = pd.concat(list(rows))
        flag = facts["flag"].iloc[0]
        out = []
        members = facts.loc[facts["role"] == MEMBER, "uid"].tolist()
        if members:
            held = self.first.get() if self.first.exists() else None
            if held is None and len(members) == 1:
                self.first.update((members[0], False))
            else:
                if held is None or not held[1]:
                    out += [(held[0], flag, True)] if held else []
                    self.first.update((held[0] if held else members[0], True))
                out += [(uid, flag, True) for uid in members]
        parents = facts.loc[facts["role"] == PARENT, "published"].dropna()
        children = list(facts.loc[facts["role"] == CHILD, ["uid", "published"]].itertuples(index=False, name=None))
        if len(parents) or children:
            held = self.parent.get()[0] if self.parent.exists() else None
            earliest = min([int(x) for x in parents] + ([held] if held is not None else []), default=None)
            if earliest is not None and earliest != held:
                self.parent.update((earliest,))
            fits = lambda published: earliest is not None and not pd.isna(published) and earliest < published
            before = list(self.waiting.get()) if len(parents) and self.waiting.exists() else []
            freed = [(x[0], flag, False) for x in before if fits(x[1])]
            if freed:
                left = [x for x in before if not fits(x[1])]
                self.waiting.clear()
                if left:
                    self.waiting.put([tuple(x) for x in left])
            out += freed
            orphans = [(uid, None if pd.isna(p) else int(p)) for uid, p in children if not fits(p)]
            if orphans:
                self.waiting.appendList(orphans)
                out += [(uid, flag, True) for uid, _ in orphans]
                if self.patience_ms is not None:
                    self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.patience_ms)
        if out:
            yield pd.DataFrame(out, columns=["uid", "flag", "on"])

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        """Children that waited long enough keep their flag and are forgotten."""
        self.waiting.clear()
        return iter(())

    def close(self) -> None:
        pass


def _facts(bars: DataFrame) -> DataFrame:
    """(key, flag, role, uid, published) for each relation that a row can stand in."""

    def fact(kind: str, flag: str, role: str, published: Column, *parts: Column) -> Column:
        key = F.concat(F.lit(f"{kind}:"), F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])))
        return F.struct(key.alias("key"), F.lit(flag).alias("flag"), F.lit(role).alias("role"), F.col("uid").alias("uid"), published.alias("published"))

    none, at = F.lit(None).cast("long"), F.unix_micros("published_at")
    source, instrument, event, n = F.col("source_record_id"), F.col("instrument_id"), F.col("event_time"), F.col("revision_number")
    known = instrument.isNotNull() & event.isNotNull() & n.isNotNull()
    facts = F.array_compact(F.array(
        fact("id", DUPLICATE_ID, MEMBER, none, source),
        F.when(event.isNotNull() & n.isNotNull(), fact("revision", DUPLICATE_REVISION, MEMBER, none, instrument, event, n)),
        F.when(known & source.isNotNull(), fact("chain", BROKEN_CHAIN, PARENT, at, source, instrument, event, n)),
        F.when(known & (n > 1) & F.col("supersedes_record_id").isNotNull(), fact("chain", BROKEN_CHAIN, CHILD, at, F.col("supersedes_record_id"), instrument, event, n - 1)),
    ))
    return bars.select(F.explode(facts).alias("f")).select("f.*")


def ingest_bars(spark: SparkSession, path: str, listings: DataFrame, files_at_once: int = 1, ttl_ms: int | None = None, patience_ms: int | None = None) -> DataFrame:
    """Daily bars from a folder of Parquet files, taken up a few files at a time, with the flags of all rules of
    readers.flagged_bars: the same rows as that gives for all files together, in whatever order they come.

    Two queries run until the folder is drained. One writes rows with the faults they have by themselves. The other keeps
    state by record id, revision and parent, and writes a row each time a flag is put on an earlier or new row, or taken
    off one whose parent came later. A row is named by its file and place there. With ttl_ms and patience_ms what is kept
    of a key is bounded in time; relations over longer stretches are then not found."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
    stream = stream.withColumn("uid", F.concat_ws(":", "_metadata.file_name", F.col("_metadata.row_index").cast("string")))
    base = scratch(spark)
    into = lambda name: lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/{name}/batch={n}")
    lost = (F.col("revision_number") > 1) & (F.col("supersedes_record_id").isNull() | F.col("instrument_id").isNull() | F.col("event_time").isNull())
    drained(flagged_rows(stream.withColumn(BROKEN_CHAIN, lost), listings, [BROKEN_CHAIN]), "append", into("rows"))
    related = _facts(stream).groupBy("key").transformWithStateInPandas(
        statefulProcessor=Relations(ttl_ms, patience_ms), outputStructType="uid string, flag string, on boolean", outputMode="Append", timeMode="None" if ttl_ms is None and patience_ms is None else "ProcessingTime"
    )
    drained(related, "append", into("flags"))
    found = spark.read.parquet(f"{base}/flags").groupBy("uid", "flag").agg(F.bool_and("on").alias("on")).where("on").groupBy("uid").agg(F.collect_set("flag").alias("_more"))
    rows = spark.read.parquet(f"{base}/rows").drop("batch", BROKEN_CHAIN)
    joined = rows.join(found, "uid", "left")
    return joined.withColumn("flags", F.sort_array(F.array_union("flags", F.coalesce("_more", F.array().cast("array<string>"))))).drop("_more")
