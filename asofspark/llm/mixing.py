"""Mixing sources to target weights, in DataFrame functions only.

Tokens are summed per source, repetition rates follow from the weights, and each document is emitted floor(rate)
times plus one hash-seeded Bernoulli copy with probability equal to the fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a key (null counts as the text 'null'): 52 bits of md5, alike in every engine and rerun."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def draw_key(doc_id: Column, digest: Column, nth: Column) -> Column:
    """What a row's draw is seeded with: its doc_id, its text's digest and its number among rows equal in both and in
    source, so that rows without an id, and rows that repeat, draw on their own."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), digest, nth.cast("string"))


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


_SAME = ["doc_id", "source", "_digest"]


def numbered(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """rows (doc_id, source, _digest, _hash) with _nth, 0 for the first of equal rows, 1 for the next, and so on.

    repeats (_hash) holds the hashes that occur more than once; only rows with these are shuffled. They are numbered
    within each partition of rows, and counts by partition give where each one's numbers begin, so no task holds all
    rows of a large group. Rows must be read from files, so that both passes see the same partitions."""
    if repeats.isEmpty():
        return rows.withColumn("_nth", F.lit(0).cast("long"))
    single = rows.join(repeats, "_hash", "left_anti").withColumn("_nth", F.lit(0).cast("long"))
    several = rows.withColumn("_part", F.spark_partition_id()).join(repeats.hint("broadcast") if _small(repeats) else repeats, "_hash", "left_semi")
    several = several.withColumns({"_source": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")), "_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))})
    same = ["_id", "_source", "_digest"]
    counts = several.groupBy(*same, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*same).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*same, "_part", F.coalesce(before, F.lit(0)).alias("_start"))
    here = F.row_number().over(Window.partitionBy(*same, "_part").orderBy(F.lit(0)))
    found = several.withColumn("_here", here).join(starts, [*same, "_part"]).withColumn("_nth", F.col("_start") + F.col("_here") - 1)
    return single.unionByName(found.select(single.columns))


def _small(repeats: DataFrame) -> bool:
    """Whether hashes of repeated rows are few enough (2 MB) to go to every task."""
    return repeats.limit((1 << 17) + 1).count() <= 1 << 17


def repeated(rows: DataFrame) -> DataFrame:
    return staged(rows.groupBy("_hash").agg(F.count("*").alias("n")).where("n > 1").select("_hash"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes (source, size) -> (source, source_size, target), one row per source.

    Sources in code point order (null last) take the weights in turn. The level is the water line at which
    sum(least(cap * source_size, level * weight)) is `share` of all sizes; no target exceeds cap * source_size.
    The table that is ordered as a whole, in one task that spills, has one row per source, after a partially aggregated
    sum: it grows with the number of sources, not with the documents.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = by_source.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ordered = ordered.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")))
    ordered = ordered.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    every = Window.orderBy((F.col("_cap") / F.col("_w")), "_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy((F.col("_cap") / F.col("_w")), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight_left = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    leveled = ordered.withColumn("_line", left / weight_left)
    level = F.max("_line").over(Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return leveled.select("source", "source_size", F.least("_cap", level * F.col("_w")).alias("target"))


def copies(key: Column, rate: Column, seed: int) -> Column:
    return F.floor(rate) + F.when(unit_hash(key, seed) < rate - F.floor(rate), 1).otherwise(0)


def _rate() -> Column:
    return F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))


def _read(docs: DataFrame) -> DataFrame:
    """docs with _digest and _hash, which equal rows share."""
    digested = docs.withColumn("_digest", text_digest(F.col("text")))
    return digested.withColumn("_hash", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in _SAME]))


def mix_plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """documents -> doc_id, size, source_size, target, copies, taken: one row per input row.

    Null text has size 0; null source is a source of its own, last; rows with null or repeated doc_ids, and rows that
    repeat as a whole, each draw on their own (see draw_key); an empty table gives no rows; further columns are ignored.
    """
    read = _read(docs.select("doc_id", "source", "text"))
    sizes = staged(read.select(*_SAME, "_hash", word_count(F.col("text")).alias("size")))
    targets = staged(source_targets(sizes, weights, share, cap)).withColumnRenamed("source", "_source")
    joined = numbered(sizes, repeated(sizes)).join(targets, F.col("source").eqNullSafe(F.col("_source")))
    times = copies(draw_key(F.col("doc_id"), F.col("_digest"), F.col("_nth")), _rate(), seed)
    return joined.select("doc_id", "size", "source_size", "target", times.alias("copies"), (F.col("size") * times).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """documents -> the mixture itself: each row of docs once per copy taken, with its columns and copy (1, 2, ...).

    The same cases as mix_plan; a column of docs that is named copy is replaced. Texts cross no shuffle while the
    per-source table is below the broadcast threshold (beyond it the join is a shuffle with adaptive skew handling) and
    no row repeats.
    """
    kept = [c for c in docs.columns if c.lower() != "copy"]
    rows = docs.select(F.struct(*[f"`{c}`" for c in kept]).alias("_row")).select("_row", *[F.col(f"_row.{c}").alias(c) for c in ("doc_id", "source", "text")])
    sizes = staged(_read(rows.drop("_row")).select("source", "_hash", word_count(F.col("text")).alias("size")))
    targets = staged(source_targets(sizes, weights, share, cap)).select(F.struct("*").alias("_mix"))
    row = numbered(_read(rows).drop("text"), repeated(sizes))
    joined = row.join(targets, F.col("source").eqNullSafe(F.col("_mix.source")))
    rate = F.coalesce(F.try_divide(F.col("_mix.target"), F.col("_mix.source_size")), F.lit(0.0))
    times = copies(draw_key(F.col("doc_id"), F.col("_digest"), F.col("_nth")), rate, seed)
    taken = joined.withColumn("_n", times).where("_n > 0")
    return taken.select("_row.*", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("copy"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) || ':'
         || (row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) - 1)::VARCHAR AS seed
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rk FROM src),
weighed AS (SELECT *, (CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM ranked),
lined AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS line
  FROM weighed),
targets AS (SELECT source, source_size, least(cap, max(line) OVER () * w) AS target FROM lined),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / t.source_size END AS rate,
         ('0x' || substr(md5(d.seed || ':17'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sizes d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
