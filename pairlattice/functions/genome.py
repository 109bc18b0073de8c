"""Chromosome dictionary: names, lengths, offsets, pairs of chromosomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Default bin sizes of a matrix set, coarse to fine (fixed values).
RESOLUTIONS = (2_500_000, 1_000_000, 500_000, 250_000, 100_000, 50_000, 25_000, 10_000, 5_000, 1_000)


def chromosomes(spark: SparkSession, table: list[tuple[str, int]]) -> DataFrame:
    """(idx, name, length) with ordinals from 1, in the order given; one row per chromosome, so it can be broadcast."""
    return spark.createDataFrame([(i + 1, n, int(x)) for i, (n, x) in enumerate(table)], "idx int, name string, length long")


def with_all(chroms: DataFrame) -> DataFrame:
    """Adds ordinal 0, the whole genome in kilobases."""
    whole = chroms.agg(F.lit(0).alias("idx"), F.lit("All").alias("name"), F.expr("sum(length) div 1000").alias("length"))
    return whole.unionByName(chroms)


def offsets(chroms: DataFrame, resolution: int) -> DataFrame:
    """(idx, length, start_bp, first_bin, n_bins): where each chromosome begins in the whole genome, in bases and bins."""
    before = W.orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    n = F.expr(f"length div {resolution} + 1")
    return chroms.select("idx", "length", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("start_bp"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias("first_bin"), n.alias("n_bins"))


def chromosome_pairs(chroms: DataFrame) -> DataFrame:
    """(chr1, chr2) with chr1 <= chr2: one row per matrix."""
    a, b = chroms.select(F.col("idx").alias("chr1")), chroms.select(F.col("idx").alias("chr2"))
    return F.broadcast(a).join(b, F.col("chr1") <= F.col("chr2"))


def clean_name(name: Column) -> Column:
    """Dictionary form of a chromosome name: no chr prefix, upper case; MT and M are one."""
    bare = F.upper(F.regexp_replace(name, "(?i)^chr", ""))
    return F.when(bare == "MT", F.lit("M")).otherwise(bare)


def track_name(name: Column) -> Column:
    """Name as tracks and annotations use it: MT becomes chrM, others get the chr prefix if they lack it."""
    return F.when(name == "MT", F.lit("chrM")).when(name.startswith("chr"), name).otherwise(F.concat(F.lit("chr"), name))


def resolve(df: DataFrame, chroms: DataFrame, columns: tuple[str, ...] = ("chr1", "chr2")) -> DataFrame:
    """Names to ordinals; rows naming an unknown chromosome are dropped (inner join on the dictionary)."""
    for c in columns:
        d = F.broadcast(chroms.select(clean_name(F.col("name")).alias("dict_name"), F.col("idx").alias("dict_idx")))
        df = df.join(d, clean_name(F.col(c)) == F.col("dict_name")).withColumn(c, F.col("dict_idx")).drop("dict_name", "dict_idx")
    return df


def whole_genome_bin_size(total_length: int) -> int:
    """Bin size, in kilobases, of the whole-genome matrix: about 500 bins."""
    return max(1, total_length // 1000 // 500)


def block_columns(length: int, bin_size: int, intra: bool, capacity: int = 1000, most: int = 46_339) -> int:
    """Columns of blocks in a matrix of one bin size; finer bins than the cutoff share a block by bases."""
    bins, cutoff = length // bin_size + 1, 500 if intra else 5000
    columns = bins // capacity + 1 if bin_size >= cutoff else bins * bin_size // (capacity * cutoff) + 1
    return min(columns, most)
