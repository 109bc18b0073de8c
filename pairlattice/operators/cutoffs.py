"""Cut-offs on row counts: percentiles, z-scores, order statistics, and the error percentile of a balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlattice.operators.rows import MATRIX


def _steps(start: float, step: float, end: float) -> list[float]:
    out = []
    while start < end:
        out.append(start)
        start += step
    return out


def percentile_cutoffs(counts: DataFrame, start: float, step: float, end: float, value: str = "nnz") -> DataFrame:
    """(matrix, cutoffs): 0, then the percentiles from start (in per cent) below end, of the counts above zero.

    Percentiles are Spark's exact ones, which interpolate between n - 1 gaps.
    """
    at = _steps(start, step, end)
    some = F.col(value).cast("double")
    return counts.filter(F.col(value) > 0).groupBy(*MATRIX).agg(F.concat(F.array(F.lit(0.0)), F.percentile(some, F.array(*[F.lit(p / 100) for p in at]))).alias("cutoffs"))


def zscore_cutoffs(counts: DataFrame, start: float, step: float, end: float, value: str = "nnz") -> DataFrame:
    """(matrix, cutoffs): 0, then mean + z * standard deviation (of the sample), of the counts above zero."""
    mean, sd = F.avg(value), F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return counts.filter(F.col(value) > 0).groupBy(*MATRIX).agg(F.array(F.lit(0.0), *[mean + z * sd for z in _steps(start, step, end)]).alias("cutoffs"))


def cutoff(cutoffs: Column, i: int) -> Column:
    """The i-th cut-off, or the last where there are fewer."""
    return F.get(cutoffs, F.least(F.lit(i), F.size(cutoffs) - 1))


def order_statistic(counts: DataFrame, percent: int = 10, value: str = "nnz") -> DataFrame:
    """(matrix, upper): the count at place floor(percent * n / 100), from 0, in ascending order of those above zero.

    From a histogram of the counts, so a matrix of any number of bins is combined before it is sorted.
    """
    from pyspark.sql import Window as W

    h = counts.filter(F.col(value) > 0).groupBy(*MATRIX, value).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(W.partitionBy(*MATRIX).orderBy(value))
    total = F.sum("k").over(W.partitionBy(*MATRIX))
    placed = h.withColumn("upto", upto).withColumn("place", F.floor(total * percent / 100))
    return placed.filter("upto > place").groupBy(*MATRIX).agg(F.min(value).alias("upper"))


def error_percentile(sums: DataFrame, scale: DataFrame, target: float = 1.0, percent: float = 90.0) -> DataFrame:
    """(matrix, error): the percentile of |sum * scale - target| over bins whose scale is valid."""
    s = scale.select(*MATRIX, "bin", F.col("v").alias("s"))
    both = sums.join(s, [*MATRIX, "bin"]).filter(~F.isnan("s") & (F.col("s") > 0))
    return both.groupBy(*MATRIX).agg(F.percentile(F.abs(F.col("v") * F.col("s") - target), F.lit(percent / 100)).alias("error"))
