"""Pairs to cells: sparse symmetric matrices at one or many bin sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlattice.functions.genome import whole_genome_bin_size
from pairlattice.functions.pairs import canonical, genome_position

#: Size of a quantile sketch, and how far its ranks may be off, as a share of all counts (with 99 % certainty).
SKETCH_K, SKETCH_ERROR = 400, 0.008
KEYS = ("resolution", "chr1", "chr2", "x", "y")


def bin_pairs(pairs: DataFrame, resolution: int) -> DataFrame:
    """cells (resolution, chr1, chr2, x, y, n): scores summed by bin pair; rows before a chromosome's start are dropped.

    One hash aggregate; the scores are combined before the only shuffle, which is on the cell key.
    """
    p = canonical(pairs).filter("pos1 >= 0 and pos2 >= 0")
    x, y = F.expr(f"pos1 div {resolution}"), F.expr(f"pos2 div {resolution}")
    keyed = p.select(F.lit(resolution).alias("resolution"), "chr1", "chr2", x.alias("x"), y.alias("y"), "score")
    return keyed.groupBy(*KEYS).agg(F.sum("score").alias("n"))


def roll_up(cells: DataFrame, resolution: int) -> DataFrame:
    """Cells of a coarser bin size; exact where it is a multiple of the cells' own."""
    own = F.col("resolution")
    up = cells.select(F.lit(resolution).alias("resolution"), "chr1", "chr2", F.expr(f"x * resolution div {resolution}").alias("x"), F.expr(f"y * resolution div {resolution}").alias("y"), "n", (F.lit(resolution) % own).alias("rest"))
    return up.filter("rest = 0").groupBy(*KEYS).agg(F.sum("n").alias("n"))


def multi_resolution(pairs: DataFrame, resolutions: tuple[int, ...]) -> DataFrame:
    """Cells of every bin size: the pairs are binned once, at the finest sizes that divide no other, and rolled up from there.

    Rolling up cells instead of exploding pairs keeps the shuffle at the size of the cells.
    """
    out: dict[int, DataFrame] = {}
    for r in sorted(set(resolutions)):
        base = [b for b in out if r % b == 0]
        out[r] = roll_up(out[max(base)], r) if base else bin_pairs(pairs, r)
    parts = list(out.values())
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def whole_genome(pairs: DataFrame, chroms: DataFrame, total_length: int) -> DataFrame:
    """The matrix of all chromosomes as one (ordinal 0), in kilobase coordinates."""
    size = whole_genome_bin_size(total_length)
    g = genome_position(pairs, chroms).select(F.lit(0).alias("chr1"), F.lit(0).alias("chr2"), F.least("gpos1", "gpos2").alias("pos1"), F.greatest("gpos1", "gpos2").alias("pos2"), "score")
    return bin_pairs(g, size)


def at_least(cells: DataFrame, least: float) -> DataFrame:
    """Cells of at least so many counts."""
    return cells.filter(F.col("n") >= least)


def totals(cells: DataFrame) -> DataFrame:
    """Per matrix: the sum over the full symmetric matrix, occupied cells, 5th and 95th percentile."""
    off = (F.col("chr1") == F.col("chr2")) & (F.col("x") != F.col("y"))
    return cells.groupBy("resolution", "chr1", "chr2").agg(F.sum(F.when(off, 2 * F.col("n")).otherwise(F.col("n"))).alias("total"), F.count("*").alias("occupied"), F.percentile("n", F.lit(0.05)).alias("p5"), F.percentile("n", F.lit(0.95)).alias("p95"))


def count_sketches(cells: DataFrame) -> DataFrame:
    """(resolution, chr1, chr2, n, sketch): a mergeable quantile sketch of each matrix's counts, of fixed size; its ranks are within SKETCH_ERROR.

    ``totals`` gives exact percentiles, for which all distinct counts of a matrix are held together.
    """
    return cells.groupBy("resolution", "chr1", "chr2").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("n", F.lit(SKETCH_K)).alias("sketch"))


def sketched_percentiles(sketches: DataFrame, shares: tuple[float, ...] = (0.05, 0.95)) -> DataFrame:
    """(resolution, chr1, chr2, n, values): percentiles from sketches of parts of each matrix, such as days or datasets."""
    merged = sketches.groupBy("resolution", "chr1", "chr2").agg(F.sum("n").alias("n"), F.collect_list("sketch").alias("parts"))
    one = F.aggregate(F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))), F.get("parts", F.lit(0)), F.kll_sketch_merge_double)
    return merged.select("resolution", "chr1", "chr2", "n", F.kll_sketch_get_quantile_double(one, F.array(*map(F.lit, shares))).alias("values"))


def to_contacts(cells: DataFrame) -> DataFrame:
    """Cells back to base pairs: (chr1, pos1, chr2, pos2, score)."""
    return cells.select("chr1", (F.col("x") * F.col("resolution")).alias("pos1"), "chr2", (F.col("y") * F.col("resolution")).alias("pos2"), F.col("n").alias("score"))
