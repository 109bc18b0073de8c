"""Distance decay: histograms, possible distances, smoothed density, observed over expected."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counts that a smoothing window must hold (fixed value).
WINDOW_COUNTS = 400


def distance_histogram(cells: DataFrame) -> DataFrame:
    """(resolution, dist, observed): counts by bin distance over all chromosomes; cells (resolution, chr, x, y, n)."""
    return cells.filter(~F.isnan("n") & (F.col("n") > 0)).groupBy("resolution", F.abs(F.col("x") - F.col("y")).alias("dist")).agg(F.sum("n").alias("observed"))


def chromosome_totals(cells: DataFrame) -> DataFrame:
    return cells.filter(~F.isnan("n") & (F.col("n") > 0)).groupBy("resolution", "chr").agg(F.sum("n").alias("observed"))


def possible_distances(chroms: DataFrame, resolution: int, with_data: DataFrame | None = None) -> DataFrame:
    """(resolution, dist, possible): bin pairs at each distance, over chromosomes that have data.

    A chromosome of m = length div resolution bins has m - d pairs at distance d. A closed form on
    suffix sums over the distinct m would do for millions of chromosomes; here a range per chromosome is joined.
    """
    c = chroms.select(F.col("idx").alias("chr"), F.expr(f"length div {resolution}").alias("m")).filter("m > 0")
    if with_data is not None:
        c = c.join(with_data.select("chr").distinct(), "chr", "left_semi")
    d = c.select("m", F.explode(F.expr("sequence(0L, m - 1)")).alias("dist"))
    return d.groupBy("dist").agg(F.sum(F.col("m") - F.col("dist")).alias("possible")).select(F.lit(resolution).alias("resolution"), "dist", "possible")


def raw_density(histogram: DataFrame, possible: DataFrame) -> DataFrame:
    """(resolution, dist, density): observed over possible, 0 where nothing was observed."""
    h = possible.join(histogram, ["resolution", "dist"], "left")
    return h.select("resolution", "dist", (F.coalesce("observed", F.lit(0.0)) / F.col("possible")).alias("density"))


def smooth(observed: np.ndarray, possible: np.ndarray) -> np.ndarray:
    """Density at each distance over a window that is widened until it holds WINDOW_COUNTS.

    The arrays run over the distances that have bin pairs, and one more: counts in the last,
    partial bin lie there and can only widen a window. While the window [lo, hi] holds too little
    its right end grows; else both ends close in as long as enough is left. After each distance
    the right end advances by two, as far as there is room; the left end follows by closing in.
    """
    n = len(possible) - 1
    a, b = np.concatenate(([0.0], np.cumsum(observed))), np.concatenate(([0.0], np.cumsum(possible)))
    held = lambda lo, hi: a[hi + 1] - a[lo]
    out, lo, hi = np.zeros(n), 0, 0
    for d in range(n):
        if held(lo, hi) < WINDOW_COUNTS:
            hi = max(hi, min(int(np.searchsorted(a, a[lo] + WINDOW_COUNTS, side="left")) - 1, n))
        else:
            while hi - lo > 1 and held(lo + 1, hi - 1) >= WINDOW_COUNTS:
                lo, hi = lo + 1, hi - 1
        out[d] = held(lo, hi) / (b[hi + 1] - b[lo]) if b[hi + 1] > b[lo] else 0.0
        hi = max(hi, min(hi + 2, n - 1))
    return out


def smoothed_density(histogram: DataFrame, possible: DataFrame) -> DataFrame:
    """(resolution, dist, density). The frame depends on the data, so it is a fold per resolution over one row a distance."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf.loc[pdf["possible"] > 0, "dist"].max()) + 1
        o, p = np.zeros(n + 1), np.zeros(n + 1)
        kept = pdf[pdf["dist"] <= n]
        o[kept["dist"]], p[kept["dist"]] = kept["observed"], kept["possible"]
        return pd.DataFrame({"resolution": pdf["resolution"].iloc[0], "dist": np.arange(n), "density": smooth(o, p)})

    rows = possible.join(histogram, ["resolution", "dist"], "full").select("resolution", "dist", F.coalesce("observed", F.lit(0.0)).alias("observed"), F.coalesce("possible", F.lit(0)).cast("double").alias("possible"))
    return rows.groupBy("resolution").applyInPandas(one, "resolution int, dist long, density double")


def chromosome_factors(density: DataFrame, chroms: DataFrame, totals: DataFrame) -> DataFrame:
    """(resolution, chr, factor): expected over observed total, so that density / factor fits each chromosome."""
    c = F.broadcast(chroms.select(F.col("idx").alias("chr"), "length"))
    per = density.join(c, F.col("dist") < F.expr("length div resolution"))
    want = per.groupBy("resolution", "chr").agg(F.sum((F.expr("length div resolution") - F.col("dist")) * F.col("density")).alias("expected"))
    return want.join(totals, ["resolution", "chr"]).select("resolution", "chr", (F.col("expected") / F.col("observed")).alias("factor"))


def observed_over_expected(cells: DataFrame, density: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """cells (resolution, chr, x, y, n) with oe = n / (density / factor)."""
    d = cells.withColumn("dist", F.abs(F.col("x") - F.col("y"))).join(density, ["resolution", "dist"])
    if factors is None:
        return d.select("resolution", "chr", "x", "y", "n", (F.col("n") / F.col("density")).alias("oe"))
    return d.join(F.broadcast(factors), ["resolution", "chr"]).select("resolution", "chr", "x", "y", "n", (F.col("n") * F.col("factor") / F.col("density")).alias("oe"))
