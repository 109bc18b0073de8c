"""Iterative balancing of a symmetric sparse matrix.

The controller below works on dense vectors and gets the matrix as a product callback, so two
back ends share it: NumPy inside one task per chromosome matrix (grouped map), and a Spark
product per half-step for matrices too large for a task (``balance_distributed``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the stopping rules.
TOLERANCE, ATTEMPT_STEPS, ALL_STEPS = 1e-4, 500, 1500
SLOWEST, LARGEST_ROW_ERROR, FEW_UNSETTLED, EXCLUDED_PERCENT = 0.05, 0.05, 1e-5, 10
#: Cells of one matrix that a single task balances; larger ones take the distributed back end.
CELLS_IN_TASK = 20_000_000


@dataclass
class Outcome:
    """What a balancing run gives: the vector (NaN on excluded bins) or None, with its course."""

    vector: np.ndarray | None
    steps: int = 0
    cutoff: int = 1
    upper: int = 0
    excluded: int = 0
    row_error: float = float("nan")


@dataclass
class _Attempt:
    """Scaling vectors of one attempt at a cutoff."""

    out: np.ndarray
    rows: np.ndarray = field(default=None)
    cols: np.ndarray = field(default=None)
    sums: np.ndarray = field(default=None)
    errors: list[float] = field(default_factory=list)


def balance(times: Callable[[np.ndarray], np.ndarray], nonzeros: np.ndarray) -> Outcome:
    """Scale rows and columns to equal sums, leaving out bins with few cells where needed.

    Rows below a cutoff of non-zero cells are left out. An attempt that stalls doubles the cutoff
    (or bisects towards the last that converged), one that converges above 1 bisects down; a
    stalled attempt with hardly any unsettled bin is tried once more without those bins. No
    solution is given if more than a tenth of the occupied bins would have to go.
    """
    occupied = np.sort(nonzeros[nonzeros > 0])
    n = len(occupied)
    if not n:
        return Outcome(None)
    upper, cutoff = int(occupied[EXCLUDED_PERCENT * n // 100]), 1
    solved: tuple[int, np.ndarray, np.ndarray, float] | None = None  # cutoff, vector, out, error
    failed: int | None = None
    patience = True
    total = 0
    attempt = _Attempt(out=nonzeros < cutoff)
    first = times((~attempt.out).astype(float))
    attempt.rows = np.sqrt(first)
    attempt.cols = attempt.rows.copy()
    attempt.sums = first * attempt.rows
    current = attempt.rows.copy()
    vector, error = current, np.inf

    def restart(out: np.ndarray) -> _Attempt:
        ones = (~out).astype(float)
        return _Attempt(out=out, rows=ones, cols=ones.copy(), sums=times(ones) * ones)

    with np.errstate(divide="ignore", invalid="ignore"):
        while error > TOLERANCE and len(attempt.errors) < ATTEMPT_STEPS and total < ALL_STEPS:
            total += 1
            a = attempt
            a.rows, col = _half_step(times, a.rows, a.sums, a.out, a.cols)
            a.cols, a.sums = _half_step(times, a.cols, col, a.out, a.rows)
            vector = np.sqrt(a.rows * a.cols)
            change = np.where(a.out, 0.0, np.abs((vector - current) / (vector + current)))
            error = float(np.nanmax(change, initial=0.0))
            a.errors.append(error)
            unsettled, previous, current = change > TOLERANCE, current, vector
            if error < TOLERANCE:
                if cutoff == 1:
                    break
                solved, patience = (cutoff, vector, a.out, error), True
                if failed is not None and cutoff - failed <= 1:
                    break
                cutoff = (cutoff + failed) // 2 if failed is not None else cutoff // 2
                attempt, error = restart(nonzeros < cutoff), np.inf
                continue
            if len(a.errors) <= 5 or a.errors[-1] * (1 + SLOWEST) < a.errors[-6]:
                continue
            failed = cutoff
            if solved is not None and solved[0] - failed <= 1:
                cutoff, vector, a.out, error = solved
                break
            if patience and unsettled.sum() / n < FEW_UNSETTLED:
                patience, drop = False, (nonzeros < cutoff) | unsettled
                attempt, error = restart(drop), np.inf
            else:
                patience = True
                cutoff = (failed + solved[0]) // 2 if solved is not None else 2 * cutoff
                attempt, error = restart(nonzeros < cutoff), np.inf
            if cutoff > upper:
                break
        out = attempt.out
        worst = float(np.nanmax(np.where(out, 0.0, np.abs(times(np.where(out, 0.0, vector)) * vector - 1)), initial=0.0))
    good = error <= TOLERANCE and worst <= LARGEST_ROW_ERROR and cutoff <= upper
    return Outcome(np.where(out, np.nan, vector) if good else None, total, cutoff, upper, int((out & (nonzeros > 0)).sum()), worst)


def _half_step(times: Callable, scale: np.ndarray, sums: np.ndarray, out: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One side's scaling to unit sums, and the other side's sums after it."""
    scale = np.where(out, 0.0, scale / np.where(out, 1.0, sums))
    return scale, times(scale) * other


def symmetric_product(x: np.ndarray, y: np.ndarray, n: np.ndarray, size: int) -> Callable[[np.ndarray], np.ndarray]:
    """v -> A v for upper-triangle cells; the diagonal counts once."""
    off = x != y
    xo, yo, no = x[off], y[off], n[off]
    return lambda v: np.bincount(x, weights=n * v[y], minlength=size) + np.bincount(yo, weights=no * v[xo], minlength=size)


def nonzeros(x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(x, minlength=size) + np.bincount(y[x != y], minlength=size)


def finished(outcome: Outcome, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray | None:
    """The normalisation vector: inverse of the balancing vector, rescaled so that the total is kept."""
    if outcome.vector is None:
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        v = 1.0 / outcome.vector
    v[~(v > 0)] = np.nan
    good = (v[x] > 0) & (v[y] > 0)
    x, y, n = x[good], y[good], n[good]
    twice = np.where(x == y, 1.0, 2.0)
    raw, norm = float((twice * n).sum()), float((twice * n / (v[x] * v[y])).sum())
    return v * np.sqrt(norm / raw) if raw > 0 else v


def scale_vectors(cells: DataFrame, bins: DataFrame) -> DataFrame:
    """(resolution, chr, bin, v) for intra cells (resolution, chr, x, y, n); bins gives (chr, resolution, n_bins).

    One task per matrix. A matrix that cannot be balanced has no rows.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        size = int(pdf["n_bins"].iloc[0])
        x, y, n = pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["n"].to_numpy(float)
        v = finished(balance(symmetric_product(x, y, n, size), nonzeros(x, y, size)), x, y, n)
        if v is None:
            v = np.empty(0)
        return pd.DataFrame({"resolution": pdf["resolution"].iloc[0], "chr": pdf["chr"].iloc[0], "bin": np.arange(len(v)), "v": v})

    return cells.join(F.broadcast(bins), ["resolution", "chr"]).groupBy("resolution", "chr").applyInPandas(one, "resolution int, chr int, bin long, v double")


def spark_product(cells: DataFrame, size: int) -> Callable[[np.ndarray], np.ndarray]:
    """v -> A v for the upper-triangle cells (x, y, n) of one matrix of any number of cells: each product is a Spark job.

    The cells are written by the caller or cached; the vector (one double a bin) is sent to tasks, which return
    sums per bin, so only vectors move. The number of bins is bounded by genome length over bin size.
    """
    spark = cells.sparkSession

    def product(v: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(v)

        def run(frames):
            total = None
            for f in frames:
                x, y, n = f["x"].to_numpy(), f["y"].to_numpy(), f["n"].to_numpy(float)
                part = symmetric_product(x, y, n, size)(sent.value)
                total = part if total is None else total + part
            if total is not None:
                bins = np.flatnonzero(total)
                yield pd.DataFrame({"bin": bins, "v": total[bins]})

        rows = cells.select("x", "y", "n").mapInPandas(run, "bin long, v double").groupBy("bin").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros(size)
        out[rows["bin"].to_numpy()] = rows["v"].to_numpy()
        sent.unpersist()
        return out

    return product


def balance_distributed(cells: DataFrame, size: int) -> Outcome:
    """The same controller for one matrix of any number of cells, by Spark products."""
    cells = cells.select("x", "y", "n").persist()
    ends = F.when(F.col("x") == F.col("y"), F.array("x")).otherwise(F.array("x", "y"))
    counted = cells.select(F.explode(ends).alias("bin")).groupBy("bin").agg(F.count("*").alias("n")).toPandas()
    nnz = np.zeros(size, np.int64)
    nnz[counted["bin"].to_numpy()] = counted["n"].to_numpy()
    try:
        return balance(spark_product(cells, size), nnz)
    finally:
        cells.unpersist()


def half_step(cells: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first half-step of balancing one matrix: the row scaling that the start (roots of row sums) turns into, and the columns' sums after it."""
    product = spark_product(cells, size)
    first = product(np.ones(size))
    start = np.sqrt(first)
    return _half_step(product, start, first * start, first == 0, start)
