"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import appended, bounded_sample, sheltered, staged, table
from .gbt import Trees, fit

SAMPLE = 6000  # labelled rows that the trees are fitted on, at most; the smallest by a hash of doc_id
REJECT_BELOW = 0.3

_GROUPS = [b"#$%&*", b"!", b"?", b"|", b".", b",", b";:", b"'\"`", b"()[]{}", b"<>=", b"_-/\\", b"@", b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" ", b"\n", b"\t\r", bytes(range(128, 256)), b"aeiou"]
_GROUP = np.zeros((256, len(_GROUPS)))
for _i, _g in enumerate(_GROUPS):
    _GROUP[list(_g), _i] = 1


def statistics(text: bytes) -> list[float]:
    """Statistics of a whole text; all finite, also of an empty one."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(float)
    share = counts / max(n, 1)
    some = share[share > 0]
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    lens = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    line_lens = np.fromiter(map(len, lines), np.float64, len(lines)) if lines else np.zeros(1)
    k = max(len(words), 1)
    pairs = len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, len(words) - 2) if len(words) > 2 else 1.0
    ends = sum(text.count(x) for x in (b". ", b".\n", b"! ", b"? "))
    return [
        np.log1p(n), np.log1p(len(words)), lens.mean(), lens.std(), lens.max(), len(set(words)) / k, pairs,
        len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)), line_lens.mean(), line_lens.std(),
        float(-(some * np.log2(some)).sum()) if n else 0.0, ends / k, (lens == 1).mean(), (lens > 15).mean(),
        sum(w[:1].isupper() for w in words) / k, sum(w.isupper() for w in words) / k, sum(w.isalpha() for w in words) / k,
        *(share @ _GROUP),
    ]


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


def _sample_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [statistics(t) for t in _texts(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from labelled rows whose crc32(doc_id) mod 5 is not 0; rows without a doc_id or label are not used."""
    known = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), 5) != 0))
    picked = known.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("y"))
    picked = staged(bounded_sample(picked, sample, "_id", "y"))
    rows = docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("_id")).select("y", "text")
    got = rows.mapInArrow(_sample_statistics, "y double, x array<double>").toArrow()
    y = got.column("y").to_numpy()
    x = np.array(got.column("x").to_pylist()).reshape(len(y), -1) if len(y) else np.zeros((0, 1))
    order = np.lexsort((*x.T, y))  # the same trees whatever order the rows come in
    return fit(x[order], y[order])


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """docs (with text) with _score, 0 to 1, from the whole text alone. Null counts as the empty text, which is
    scored like any other; equal texts score alike; one row per input row; all columns are kept, but for one named
    _score, which is replaced; an empty table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(trees)

    def scored(b: pa.RecordBatch) -> list[pa.Array]:
        x = np.array([statistics(t) for t in _texts(b.column("text"))])
        return [pa.array(held.value.score(x) if len(x) else np.zeros(0), pa.float64())]

    return appended(docs, scored, "_score double")


def drop_rejected(docs: DataFrame, all_docs: DataFrame, labels: DataFrame, reject_below: float = REJECT_BELOW) -> DataFrame:
    """docs without those that score below reject_below; the trees are fitted on labelled rows of all_docs. The columns
    of docs are returned as they are, whatever their names."""
    trees = train(all_docs, labels)
    return sheltered(docs, lambda d: score(d, trees).where(F.col("_score") >= reject_below), "text")


def op3_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    predicted = F.when(F.col("_score") >= REJECT_BELOW, 1).otherwise(0)
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), predicted.alias("predicted"))
