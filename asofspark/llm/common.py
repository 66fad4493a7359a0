"""Helpers shared by the corpus operators: shared-folder staging and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset and all tasks run on
    this machine (tests). A cluster without the setting is an error: other machines would not see a local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-staged-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, survives lost executors, and gives the
    optimizer true sizes, so that it broadcasts a side only when it is below spark.sql.autoBroadcastJoinThreshold."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def appended(df: DataFrame, columns: Callable[[pa.RecordBatch], list[pa.Array]], fields: str) -> DataFrame:
    """df with further columns (a schema string) that are computed from each Arrow batch. A column of df that has the
    name of a new one, whatever its case, is replaced."""
    new = StructType.fromDDL(fields)
    taken = {n.lower() for n in new.names}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in kept]
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *columns(b)], names=[*names, *new.names])

    return df.select(*[f"`{f.name.replace('`', '``')}`" for f in kept]).mapInArrow(run, StructType([*kept, *new.fields]))


def sheltered(docs: DataFrame, work: Callable[[DataFrame], DataFrame], *used: str) -> DataFrame:
    """work(docs), with the columns and names of docs. While it runs, all columns but those it uses have other names,
    so that none can clash with a name of its own."""
    names = [c if c in used else f"kept_{i}" for i, c in enumerate(docs.columns)]
    return work(docs.toDF(*names)).select(*names).toDF(*docs.columns)


def bounded_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n rows of df that are smallest by a hash of keys (all rows if there are fewer): the same rows on every run.

    The rows are counted first, so that only about 4 n of them, by a bound on the hash, are ordered at all and tasks
    send the driver a few rows each, whatever the table's size."""
    total = df.count()
    h = F.xxhash64(*keys)
    if total > 8 * n:
        df = df.where(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * 4 * n / total))
    return df.orderBy(F.pmod(h, F.lit(1 << 30)), *keys).limit(n)


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long), undirected -> (node, component): component is the smallest node reachable.

    Each round points every node at its smallest neighbour, jumps once along those pointers and contracts the
    edges; rounds are logarithmic in the nodes. Only plain joins and partially aggregated minima are used, so a hub
    with many links is split by adaptive skew joins and pre-aggregated before it is shuffled. Nodes without an edge
    to another node are not returned; nulls and loops are dropped; no edges give no rows.
    """
    low_high = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = staged(edges.where("a <> b").select(*low_high).distinct())
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        up = near.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        parent = staged(near.join(up, "p").select("a", F.col("pp").alias("p")))
        pa, pb = parent.select("a", F.col("p").alias("pa")), parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = staged(
            edges.join(pa, "a").join(pb, "b").where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
        if found is None:
            found = parent.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            step = parent.select(F.col("a").alias("component"), F.col("p").alias("next"))
            found = found.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
