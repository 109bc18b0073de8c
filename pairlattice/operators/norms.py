"""Normalisation vectors: NONE, VC, VC_SQRT, SCALE, and their whole-genome and inter-chromosomal forms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlattice.functions.genome import offsets
from pairlattice.operators import balance
from pairlattice.operators.balance import balance_distributed, scale_vectors
from pairlattice.operators.expected import distance_histogram
from pairlattice.operators.rows import intra_cells, inverted, normalized, rescaled, row_sums
from pairlattice.operators.stage import settled

#: Order in which vectors are written (fixed values).
ORDER = ("GW_VC", "GW_VC_SQRT", "GW_SCALE", "INTER_VC", "INTER_VC_SQRT", "INTER_SCALE", "VC", "VC_SQRT", "SCALE")
#: Finest bin size that whole-genome vectors are made for.
WHOLE_GENOME_FLOOR = 10_000


def bins(chroms: DataFrame, resolutions: tuple[int, ...]) -> DataFrame:
    """(resolution, chr, n_bins)."""
    sizes = F.array(*map(F.lit, resolutions))
    return chroms.select(F.col("idx").alias("chr"), "length", F.explode(sizes).alias("resolution")).select("resolution", "chr", F.expr("length div resolution + 1").alias("n_bins"))


def none(chroms: DataFrame, resolutions: tuple[int, ...]) -> DataFrame:
    return bins(chroms, resolutions).select("resolution", "chr", F.explode(F.expr("sequence(0L, n_bins - 1)")).alias("bin"), F.lit(1.0).alias("v"))


def vc(intra: DataFrame) -> DataFrame:
    """Row sums, rescaled to keep the total."""
    return rescaled(intra, row_sums(intra))


def vc_sqrt(intra: DataFrame) -> DataFrame:
    """Roots of the raw row sums, with a rescaling of their own."""
    return rescaled(intra, row_sums(intra).withColumn("v", F.sqrt("v")))


def _balanced_distributed(cells: DataFrame, resolution: int, c: int, size: int) -> DataFrame:
    """(resolution, chr, bin, v) of one matrix, by Spark products; without rows if it cannot be balanced."""
    found = balance_distributed(cells, size).vector
    frame = pd.DataFrame({"resolution": resolution, "chr": c, "bin": np.arange(0 if found is None else size), "v": [] if found is None else found})
    v = inverted(cells.sparkSession.createDataFrame(frame, "resolution int, chr int, bin long, v double"))
    return v.withColumn("v", F.nanvl("v", F.lit(None).cast("double")))  # null, as from one task


def scale(intra: DataFrame, chroms: DataFrame, resolutions: tuple[int, ...]) -> DataFrame:
    """Balanced vectors per chromosome, coarse to fine: a chromosome that fails is skipped at finer sizes."""
    done, failed = None, None
    for r in sorted(set(resolutions), reverse=True):
        part = intra.filter(F.col("resolution") == r)
        if failed:
            part = part.filter(~F.col("chr").isin(*failed))
        sizes = bins(chroms, (r,))
        cells = part.groupBy("chr").count().filter(F.col("count") > balance.CELLS_IN_TASK)
        large = {x["chr"]: x["n_bins"] for x in cells.join(sizes, "chr").collect()}
        v = scale_vectors(part.filter(~F.col("chr").isin(*large)) if large else part, sizes)
        for c, size in large.items():
            v = v.unionByName(_balanced_distributed(part.filter(F.col("chr") == c), r, c, size))
        v = settled(v)
        ok = {x["chr"] for x in v.select("chr").distinct().collect()}
        failed = sorted({x["chr"] for x in part.select("chr").distinct().collect()} - ok | set(failed or ()))
        v = rescaled(part, v)
        done = v if done is None else done.unionByName(v)
    return done


def whole_genome_cells(cells: DataFrame, chroms: DataFrame, resolution: int, intra: bool = True) -> DataFrame:
    """Cells of all chromosomes in one index space: (resolution, chr = 0, x, y, n); without intra cells for INTER vectors."""
    first = F.broadcast(offsets(chroms, resolution).select("idx", "first_bin"))
    c = cells.filter(F.col("resolution") == resolution)
    if not intra:
        c = c.filter("chr1 <> chr2")
    for i, b in ((1, "x"), (2, "y")):
        c = c.join(first.select(F.col("idx").alias(f"chr{i}"), F.col("first_bin").alias(f"f{i}")), f"chr{i}").withColumn(b, F.col(b) + F.col(f"f{i}"))
    return c.select("resolution", F.lit(0).alias("chr"), F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "n")


def sliced(vector: DataFrame, chroms: DataFrame, resolution: int) -> DataFrame:
    """A whole-genome vector cut into chromosomes: (resolution, chr, bin, v)."""
    o = F.broadcast(offsets(chroms, resolution))
    v = vector.drop("chr").join(o, (F.col("bin") >= F.col("first_bin")) & (F.col("bin") < F.col("first_bin") + F.col("n_bins")))
    return v.select("resolution", F.col("idx").alias("chr"), (F.col("bin") - F.col("first_bin")).alias("bin"), "v")


def has_all_pairs(cells: DataFrame, chroms: DataFrame) -> bool:
    """Whether every pair of chromosomes has cells, without which whole-genome vectors are not made."""
    n = chroms.count()
    return cells.filter("chr1 < chr2").select("chr1", "chr2").distinct().count() == n * (n - 1) // 2


def whole_genome_vectors(cells: DataFrame, chroms: DataFrame, resolution: int, kind: str = "VC", intra: bool = True) -> DataFrame:
    """GW_ (intra) or INTER_ vectors of a kind, per chromosome. Large matrices are balanced by Spark products."""
    if resolution < WHOLE_GENOME_FLOOR:
        raise ValueError(f"whole-genome vectors need bins of {WHOLE_GENOME_FLOOR} or more")
    g = settled(whole_genome_cells(cells, chroms, resolution, intra))
    if kind == "VC":
        v = vc(g)
    elif kind == "VC_SQRT":
        v = vc_sqrt(g)
    else:
        size = offsets(chroms, resolution).agg(F.sum("n_bins")).first()[0]
        if g.count() <= balance.CELLS_IN_TASK:
            whole = cells.sparkSession.createDataFrame([(resolution, 0, size)], "resolution int, chr int, n_bins long")
            v = scale_vectors(g, whole)
        else:
            v = _balanced_distributed(g, resolution, 0, size)
        v = rescaled(g, v)
    return sliced(v, chroms, resolution)


def normed_histogram(cells: DataFrame, vector: DataFrame) -> DataFrame:
    """Distance histogram of normalised intra cells."""
    return distance_histogram(normalized(intra_cells(cells) if "chr1" in cells.columns else cells, vector))
