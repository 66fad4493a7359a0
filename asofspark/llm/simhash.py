"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at distance 3 or less agree within one bit on one of their 32-bit halves (half the radius,
rounded down). So every fingerprint emits all variants of each half within that radius (66 keys), the keys are
shuffled, and a variant that meets another fingerprint's own half makes a candidate, which is deduplicated and
verified on all 64 bits. Halves that are crowded (a large family of near copies) would make all their pairs meet;
their fingerprints instead emit full 64-bit variants within 1 (and within 2, for odd parity), where no key can hold
more fingerprints than the ball has points, and each key contributes a spanning set of verified links. Emitting
full-width variants for all would be 737 rows a fingerprint on average, which is more than the disk budget.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, sheltered, staged, table

RADIUS = 3
CROWDED = 48  # fingerprints with one and the same half, beyond which the full-width ball takes over


def fingerprint(text: bytes, words: int = 3) -> int:
    """Lower-cases A-Z, splits at ASCII white space; bit i is 1 if set in over half of the shingles' XXH64 (seed 42)."""
    import xxhash

    w = text.lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        bits = np.unpackbits(h[i : i + 8192].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        fp = [fingerprint(t.as_py() or b"") for t in texts]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, fp long), one row per input row. Null and wordless texts have fingerprint 0."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each key's fingerprints (no more than a ball has points) links that connect what verified pairs connect."""
    for b in batches:
        out_a, out_b = [], []
        for fps in b.column("fps"):
            v = np.sort(np.asarray(fps.values, np.int64)).view(np.uint64)  # of signed numbers numpy counts the bits of the absolute value
            left = np.arange(len(v))
            while len(left):
                seen, todo = np.zeros(len(v), bool), [int(left[0])]
                seen[left[0]] = True
                while todo:
                    i = todo.pop()
                    new = left[(np.bitwise_count(v[left] ^ v[i]) <= RADIUS) & ~seen[left]]
                    seen[new] = True
                    todo += new.tolist()
                    out_a += v[[i]].view(np.int64).tolist() * len(new)
                    out_b += v[new].view(np.int64).tolist()
                left = left[~seen[left]]
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def links(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """fps (fp long, distinct) -> (a, b): verified pairs at distance 1 to 3, or, among crowded fingerprints, as many
    of them as connect the same components. No link between components is lost; both orders may come."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    high = F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32).cast("long"))
    own = fps.select("fp", F.explode(F.array(low, high)).alias("half"))
    hot = staged(own.groupBy("half").agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("half"))
    own = own.join(hot, "half", "left_anti")
    near = [0] + [1 << i for i in range(32)]
    balls = fps.select("fp", F.explode(F.array(low, high)).alias("h")).select("fp", "h", F.explode(_longs(near)).alias("m"))
    balls = balls.select(F.col("fp").alias("other"), F.col("h").bitwiseXOR(F.col("m")).alias("half"))
    # the planner takes exploded rows to be as small as what they come from; they must not be broadcast
    pairs = own.join(balls.hint("merge"), "half").where((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS))
    pairs = pairs.select(F.col("fp").alias("a"), F.col("other").alias("b"))
    if hot.isEmpty():
        return pairs
    in_hot = staged(balls.join(hot, "half", "left_semi").select(F.col("other").alias("fp")).distinct())
    single = [0] + [_signed(1 << i) for i in range(64)]
    # three differing bits on a ring of 64: two of them lie 21 apart at most, so odd fingerprints need no wider pairs
    double = [_signed(1 << i | 1 << (i + g) % 64) for i in range(64) for g in range(1, 22)]
    masks = F.when(F.bit_count("fp") % 2 == 0, _longs(single)).otherwise(_longs(single + double))
    wide = in_hot.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("v"))
    groups = wide.groupBy("v").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    return pairs.unionByName(groups.mapInArrow(_spanning, "a long, b long"))


def near_duplicates(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """documents -> (doc_id, fp, component_id): fingerprints link at 3 or fewer differing bits; component_id is the
    smallest doc_id reachable.

    One row per input row. Null and wordless texts have fingerprint 0, linked like any other. Null doc_ids keep
    their row and get the component of their fingerprint (null if it holds no doc_id). Repeated rows share a
    component; an empty table gives no rows; further columns are ignored.
    """
    fp = staged(fingerprints(docs))
    distinct = staged(fp.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    comp = connected_components(links(distinct.select("fp"), crowded)).withColumnRenamed("node", "fp")
    labelled = distinct.join(comp, "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    first = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_fp = staged(labelled.join(first, "component").select("fp", "component_id"))
    return fp.join(by_fp, "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but one document (the smallest doc_id) of each group of near-duplicates.

    Rows with a null doc_id are kept. Rows that repeat a kept doc_id are kept once. All columns are returned, whatever
    their names.
    """
    found = near_duplicates(docs)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    again = staged(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    once = again.isEmpty()

    def kept(d: DataFrame) -> DataFrame:
        left = d.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
        if once:
            return left
        rest = left.join(again, "doc_id", "left_anti")
        return rest.unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))

    return sheltered(docs, kept, "doc_id")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
