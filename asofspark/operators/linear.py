"""Moments of any number of columns in one pass, and least squares and correlations from them.

A partition is reduced to sums of products, one row of k x k numbers for k columns; these are added up by Spark, and what
the driver gets and solves has the size of the columns, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import with_counts_before

SAME = 0.999999  # columns that correlate so much with an earlier one are dropped
TOLERANCE = 1e-9  # of a standardised column's variance, what must be left beside the columns taken before


@dataclass
class Moments:
    """Of columns less their shifts, over the rows where both of a pair are present: rows, sums of the first and of its
    squares, and sums of products. All are k x k."""

    names: list[str]
    shifts: np.ndarray
    n: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    products: np.ndarray

    def correlations(self) -> np.ndarray:
        """Pearson's, pair by pair over the rows that have both; nan where either does not vary."""
        with np.errstate(all="ignore"):
            spread = self.n * self.squares - self.sums**2
            spread[spread <= 1e-12 * self.n * self.squares] = np.nan
            return (self.n * self.products - self.sums * self.sums.T) / np.sqrt(spread * spread.T)


def moments(df: DataFrame, columns: list[str]) -> Moments:
    """The moments of columns in one pass, after one for their means; null and NaN are missing. No rows give zeros."""
    k = len(columns)
    # a number for each column, so that what is summed is small beside it
    present = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns])
    row = present.agg(*[F.avg(f"`{c}`") for c in columns]).first()
    shifts = np.array([x if x is not None else 0.0 for x in row])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k, k))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1).astype(float) - shifts
            there = ~np.isnan(x)
            x[~there] = 0.0
            seen = there.astype(float)
            total += np.stack([seen.T @ seen, x.T @ seen, (x * x).T @ seen, x.T @ x])
        yield pa.RecordBatch.from_pydict({"x": pa.array([total.ravel()], pa.list_(pa.float64()))})

    sums = present.mapInArrow(run, "x array<double>").select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    total = np.zeros(4 * k * k)
    for r in sums.collect():  # 4 k^2 numbers
        total[r["i"]] = r["x"]
    return Moments(list(columns), shifts, *total.reshape(4, k, k))


def solve(corr: np.ndarray, with_target: np.ndarray) -> np.ndarray:
    """Standardised coefficients of least squares, 0 for columns left out: those that correlate by SAME or more with an
    earlier one that is kept, those that do not vary, and those that the ones taken before them explain.

    A Cholesky factor is built with the column first that has most variance left."""
    k = len(corr)
    kept: list[int] = []
    for i in range(k):
        if not np.isnan(corr[i, i]) and all(abs(corr[i, j]) < SAME for j in kept):
            kept.append(i)
    left, taken = np.ones(len(kept)), []
    r = corr[np.ix_(kept, kept)]
    factor = np.zeros((len(kept), len(kept)))
    while len(taken) < len(kept):
        rest = [i for i in range(len(kept)) if i not in taken]
        p = max(rest, key=lambda i: left[i])
        if left[p] <= TOLERANCE:
            break
        m = len(taken)
        taken.append(p)
        factor[p, m] = np.sqrt(left[p])
        for i in rest:
            if i != p:
                factor[i, m] = (r[i, p] - factor[i, :m] @ factor[p, :m]) / factor[p, m]
                left[i] -= factor[i, m] ** 2
    low = factor[taken][:, : len(taken)]
    y = np.array([with_target[kept[i]] for i in taken])
    out = np.zeros(k)
    if taken:
        out[[kept[i] for i in taken]] = np.linalg.solve(low.T, np.linalg.solve(low, y))
    return out


def least_squares(df: DataFrame, features: list[str], target: str, out: str = "fitted") -> DataFrame:
    """The rows of df that have all features and the target, with the value that least squares on the features and a
    constant gives them. Columns that add nothing are left out: see solve."""
    rows = df.dropna(subset=[*features, target])
    m = moments(rows, [*features, target])
    c = m.correlations()
    n = max(m.n[0, 0], 1.0)
    means = m.shifts + np.diag(m.sums) / n
    spread = np.sqrt(np.maximum(np.diag(m.squares) / n - (np.diag(m.sums) / n) ** 2, 0.0))
    beta = solve(c[:-1, :-1], c[:-1, -1]) if not np.isnan(c[-1, -1]) else np.zeros(len(features))
    slopes = [b * spread[-1] / s if b else 0.0 for b, s in zip(beta, spread, strict=False)]
    fitted = F.lit(float(means[-1]))
    for f, slope, mean in zip(features, slopes, means, strict=False):
        if slope:
            fitted += F.lit(float(slope)) * (F.col(f"`{f}`") - F.lit(float(mean)))
    return rows.withColumn(out, fitted)


def with_average_rank(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """df with the rank of value among the rows equal in by, from 1, ties sharing their mean. Values are counted, the
    distinct ones are ordered over ranges, and ranks are joined back: no task holds a group."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_c"))
    ordered = with_counts_before(counts, [*by, value], F.col("_c"))
    if by:
        starts = ordered.groupBy(*by).agg(F.min("before").alias("_first"))
        ordered = ordered.join(starts, by)
    else:
        ordered = ordered.withColumn("_first", F.lit(0))
    ranks = ordered.select(*by, value, (F.col("before") - F.col("_first") + (F.col("_c") + 1) / 2).alias(out))
    return df.join(ranks, [*by, value])


def correlation_matrix(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(a, b, r, rho) for each pair of columns, the first of them first: Pearson's and Spearman's correlation over the
    rows that have both. Spearman's ranks are those among all values of a column. key names a row."""
    long = df.select(*key, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(key, columns, "_f", "_v").where("_v is not null")
    wide = with_average_rank(long, ["_f"], "_v", "_r").groupBy(*key).pivot("_f", columns).agg(F.first("_r"))
    values, ranks = moments(df, columns).correlations(), moments(wide, columns).correlations()
    number = lambda x: None if np.isnan(x) else float(x)
    pairs = [(a, b, number(values[i, j]), number(ranks[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    return df.sparkSession.createDataFrame(pairs, "a string, b string, r double, rho double")
