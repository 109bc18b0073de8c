"""Symmetric sparse linear algebra on intra cells: row sums, products, normalised cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlattice.functions.scalars import inverse_or_nan

MATRIX = ("resolution", "chr")


def intra_cells(cells: DataFrame) -> DataFrame:
    return as_intra(cells.filter("chr1 = chr2"))


def as_intra(cells: DataFrame) -> DataFrame:
    """Cells that are known to be intra, as (resolution, chr, x, y, n): pairs filtered before binning need no filter after it."""
    return cells.select("resolution", F.col("chr1").alias("chr"), "x", "y", "n")


def both_halves(cells: DataFrame, *more: Column) -> DataFrame:
    """Each entry of the full symmetric matrix once: (matrix, bin, other, n); the diagonal is not doubled.

    A generator over an array of one or two structs, so the cells are scanned once.
    """
    pair = lambda a, b: F.struct(F.col(a).alias("bin"), F.col(b).alias("other"))
    sides = F.when(F.col("x") == F.col("y"), F.array(pair("x", "y"))).otherwise(F.array(pair("x", "y"), pair("y", "x")))
    return cells.select(*MATRIX, F.explode(sides).alias("side"), "n", *more).select(*MATRIX, "side.bin", "side.other", "n")


def row_sums(cells: DataFrame) -> DataFrame:
    return both_halves(cells).groupBy(*MATRIX, "bin").agg(F.sum("n").alias("v"))


def row_nonzeros(cells: DataFrame) -> DataFrame:
    return both_halves(cells).groupBy(*MATRIX, "bin").agg(F.count("*").alias("nnz"))


def matvec(cells: DataFrame, vector: DataFrame) -> DataFrame:
    """(matrix, bin, v): the full symmetric matrix times vector (matrix, bin, v)."""
    w = vector.select(*MATRIX, F.col("bin").alias("other"), F.col("v").alias("w"))
    return both_halves(cells).join(w, [*MATRIX, "other"]).groupBy(*MATRIX, "bin").agg(F.sum(F.col("n") * F.col("w")).alias("v"))


def with_vector(cells: DataFrame, vector: DataFrame) -> DataFrame:
    """Cells with vx and vy where both are valid: above zero and not NaN."""
    side = lambda a, b: vector.select(*MATRIX, F.col("bin").alias(a), F.col("v").alias(b))
    both = cells.join(side("x", "vx"), [*MATRIX, "x"]).join(side("y", "vy"), [*MATRIX, "y"])
    good = lambda c: ~F.isnan(c) & (F.col(c) > 0)
    return both.filter(good("vx") & good("vy"))


def normalized(cells: DataFrame, vector: DataFrame) -> DataFrame:
    """Cells over vx * vy; cells at an invalid bin are left out."""
    return with_vector(cells, vector).select(*MATRIX, "x", "y", (F.col("n") / (F.col("vx") * F.col("vy"))).alias("n"))


def sum_factor(cells: DataFrame, vector: DataFrame) -> DataFrame:
    """(matrix, factor): root of normalised over raw sum of the full matrix, valid bins only."""
    times = F.when(F.col("x") == F.col("y"), 1.0).otherwise(2.0)
    both = with_vector(cells, vector).groupBy(*MATRIX).agg(F.sum(times * F.col("n") / (F.col("vx") * F.col("vy"))).alias("a"), F.sum(times * F.col("n")).alias("b"))
    return both.select(*MATRIX, F.sqrt(F.col("a") / F.col("b")).alias("factor"))


def rescaled(cells: DataFrame, vector: DataFrame) -> DataFrame:
    """The vector times its sum factor, so that normalised cells keep the raw total."""
    f = F.broadcast(sum_factor(cells, vector))  # a row per matrix
    return vector.join(f, list(MATRIX)).select(*MATRIX, "bin", (F.col("v") * F.col("factor")).alias("v"))


def inverted(vector: DataFrame) -> DataFrame:
    return vector.withColumn("v", inverse_or_nan(F.col("v")))
