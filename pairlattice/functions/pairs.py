"""Column expressions on pair rows: canonical order, clamping, filters, orientation, distance classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlattice.functions.genome import offsets

#: Values of columns that a format lacks (fixed values); a MAPQ of 1000 on both ends marks a short row.
DEFAULTS = {"strand1": True, "strand2": False, "frag1": 0, "frag2": 1, "mapq1": 1000, "mapq2": 1000, "score": 1.0}
#: Upper ends of the hundred log-spaced distance classes: eleven to a power of ten, from 10.
DISTANCES = tuple(round(10 ** (1 + i / 11)) for i in range(100))
NEAR_DIAGONAL = 10_000_000


def is_upper() -> Column:
    same = F.col("chr1") == F.col("chr2")
    return (same & (F.col("pos1") <= F.col("pos2"))) | (F.col("chr1") < F.col("chr2"))


def canonical(df: DataFrame) -> DataFrame:
    """Upper triangle: position, chromosome and fragment of both ends are swapped where the first end is the later one.

    The chromosomes are the smaller and the larger one, so that a filter on them stays short where it is pushed down.
    """
    keep = is_upper()
    ends = [c for c in ("pos", "frag") if f"{c}1" in df.columns]
    flipped = {f"{c}{i}": F.when(keep, F.col(f"{c}{i}")).otherwise(F.col(f"{c}{3 - i}")) for c in ends for i in (1, 2)}
    return df.withColumns(flipped | {"chr1": F.least("chr1", "chr2"), "chr2": F.greatest("chr1", "chr2")})


def clamp(df: DataFrame, chroms: DataFrame) -> DataFrame:
    """Positions into [0, chromosome length]; chromosomes is a dictionary, so both joins are broadcast."""
    for i in (1, 2):
        d = F.broadcast(chroms.select(F.col("idx").alias(f"chr{i}"), F.col("length").alias("clamp_length")))
        df = df.join(d, f"chr{i}").withColumn(f"pos{i}", F.least(F.greatest(f"pos{i}", F.lit(0)), "clamp_length")).drop("clamp_length")
    return df


def genome_position(df: DataFrame, chroms: DataFrame) -> DataFrame:
    """Adds gpos1 and gpos2: kilobases from the genome's start."""
    starts = offsets(chroms, 1)
    for i in (1, 2):
        d = F.broadcast(starts.select(F.col("idx").alias(f"chr{i}"), "start_bp"))
        df = df.join(d, f"chr{i}").withColumn(f"gpos{i}", F.expr(f"(start_bp + pos{i}) div 1000")).drop("start_bp")
    return df


def intra() -> Column:
    return F.col("chr1") == F.col("chr2")


def near_diagonal(most: int = NEAR_DIAGONAL) -> Column:
    """Within ``most`` bases on one chromosome; pairs of two chromosomes are not near."""
    return intra() & (F.abs(F.col("pos1") - F.col("pos2")) <= most)


def on_chromosomes(*ordinals: int) -> Column:
    return F.col("chr1").isin(*ordinals) & F.col("chr2").isin(*ordinals)


def mapq_at_least(q: int) -> Column:
    return F.least("mapq1", "mapq2") >= q


def pair_type() -> Column:
    """INNER, OUTER, LL or RR by strands and positions."""
    ahead = F.col("pos1") < F.col("pos2")
    return (
        F.when(F.col("strand1") & F.col("strand2"), "RR").when(~F.col("strand1") & ~F.col("strand2"), "LL").when(F.col("strand1") == ahead, "INNER").otherwise("OUTER")
    )


def of_orientation(kind: str) -> Column:
    kind = kind.upper()
    if kind not in ("INNER", "OUTER", "LL", "RR", "TANDEM"):
        raise ValueError(f"no orientation {kind}")
    return pair_type().isin("LL", "RR") if kind == "TANDEM" else pair_type() == kind


def is_short() -> Column:
    return (F.col("mapq1") == 1000) & (F.col("mapq2") == 1000)


def select_pairs(df: DataFrame, *, intra_only: bool = False, near: int | None = None, chromosomes: tuple[int, ...] = (), orientation: str | None = None, mapq: int = 0) -> DataFrame:
    """The combined row filter; all parts are plain predicates, so they reach the scan together."""
    if intra_only:
        df = df.filter(intra())
    if near is not None:
        df = df.filter(near_diagonal(near))
    if chromosomes:
        df = df.filter(on_chromosomes(*chromosomes))
    if orientation:
        df = df.filter(of_orientation(orientation))
    return df.filter(mapq_at_least(mapq)) if mapq > 0 else df


def distance_bin(distance: Column) -> Column:
    """Index of the first distance class that is not below the distance, 100 beyond the last: from the logarithm, set right by the neighbouring ends."""
    ends = F.array(*[F.lit(x).cast("long") for x in (*DISTANCES, 1 << 62)])
    near = F.greatest(F.lit(1), F.least(F.lit(len(DISTANCES) - 1), F.ceil(11 * (F.log10(F.greatest(distance, F.lit(1))) - 1)).cast("int")))
    return F.when(distance <= F.get(ends, near - 1), near - 1).when(distance <= F.get(ends, near), near).otherwise(near + 1)


def distance_class(distance: Column) -> Column:
    return F.when(distance < 500, "<500BP").when(distance < 5000, "500BP-5kB").when(distance < 20000, "5kB-20kB").otherwise(">20kB")


def intra_block(depth: Column, x: Column, y: Column, columns: int, block_bins: int) -> Column:
    """Block of an intra cell: diagonal bands by depth, then the place along the diagonal."""
    return depth * columns + F.floor((x + y) / 2 / block_bins)


def log_depth(x: Column, y: Column, block_bins: int, base: int = 2) -> Column:
    """Depth of a diagonal band: logarithm of the distance in blocks, our own definition of the banding."""
    return F.floor(F.log(F.lit(1.0) + F.abs(x - y) / F.lit(1.4142135623730951) / block_bins) / F.log(F.lit(float(base)))).cast("long")


def inter_block(x: Column, y: Column, columns: int, block_bins: int) -> Column:
    return F.floor(y / block_bins) * columns + F.floor(x / block_bins)
