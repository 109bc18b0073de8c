"""Merging: datasets of cells, statistics reports, histogram reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlattice.operators.binning import KEYS, roll_up

#: Labels of a statistics report, the text that marks each (fixed values), first match wins.
LABELS = (
    ("no_chimera", "No chimera found:"), ("three_plus", "3 or more alignments"), ("ligation_motif", "Ligation Motif Present:"), ("total_unique", "Total Unique:"), ("total_dups", "Total Duplicates:"),
    ("ignore", "Library Complexity"), ("intra_fragment", "Intra-fragment Reads:"), ("below_mapq", "Below MAPQ Threshold:"), ("contacts", "Hi-C Contacts:"), ("three_bias", "3' Bias (Long Range):"), ("pair_percents", "Pair Type %(L-I-O-R):"),
    ("convergence", "L-I-O-R Convergence:"), ("inter", "Inter-chromosomal:"), ("intra", "Intra-chromosomal:"), ("ignore", "Short Range (<20Kb):"), ("under_500", "<500BP:"), ("under_5k", "500BP-5kB:"), ("under_20k", "5kB-20kB:"), ("far", "Long Range (>20Kb):"),
)

#: Labels that only paired-end or only single-end reports have (fixed values); they are tried before the others.
OF_TYPE = {
    "Paired End": (("sequenced", "Sequenced Read Pairs:"), ("unmapped", "One or both reads unmapped:"), ("two", "2 alignments:"), ("two_ends", "2 alignments (A...B):"), ("two_split", "2 alignments (A1...A2B; A1B2...B1A2):"), ("ignore", "Average insert size:")),
    "Single End": (("sequenced", "Sequenced Reads:"), ("unmapped", "0 alignments:"), ("one", "1 alignment:"), ("two", "2 alignments:"), ("one_unique", "1 alignment unique"), ("one_dups", "1 alignment duplicates"), ("two_unique", "2 alignment unique"), ("two_dups", "2 alignment duplicates")),
}


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def sum_datasets(parts: list[DataFrame]) -> DataFrame:
    """Cells of several datasets added; a matrix that one of them lacks is taken from the others."""
    return union_all(parts).groupBy(*KEYS).agg(F.sum("n").alias("n"))


def rebin_datasets(parts: list[DataFrame], finest: int, resolutions: tuple[int, ...]) -> DataFrame:
    """The sum at the finest bin size, and rolled up from it to the coarser ones."""
    base = sum_datasets([p.filter(F.col("resolution") == finest) for p in parts])
    return union_all([base if r == finest else roll_up(base, r) for r in sorted(set(resolutions) | {finest})])


def matrices_in_all(parts: list[DataFrame]) -> DataFrame:
    """(chr1, chr2) that every dataset has: the strict form of a sum keeps only these."""
    n = len(parts)
    tagged = union_all([p.select("chr1", "chr2").distinct() for p in parts])
    return tagged.groupBy("chr1", "chr2").agg(F.count("*").alias("k")).filter(F.col("k") == n).select("chr1", "chr2")


def label_of(line, kind: str | None = None):
    """The label of a report's line; reports that do not name their read type are taken for paired-end ones."""
    out = F.lit("ignore")
    for name, mark in reversed((*OF_TYPE[kind or "Paired End"], *LABELS)):
        out = F.when(F.lower(line).contains(mark.lower()), name).otherwise(out)
    return out


def read_type(lines: DataFrame) -> str | None:
    """"Single End" or "Paired End" if reports (file, line) say so; an error if they say both."""
    said = F.lower("line")
    row = lines.agg(*[F.coalesce(F.bool_or(said.contains(f"read type: {k} end")), F.lit(False)).alias(k) for k in ("single", "paired")]).first()
    if row["single"] and row["paired"]:
        raise ValueError("single-end and paired-end reports cannot be merged")
    return "Single End" if row["single"] else "Paired End" if row["paired"] else None


def parse_stats(lines: DataFrame, kind: str | None = None) -> DataFrame:
    """(file, label, value) of report lines (file, line) of one read type; N/A and lines without a number are dropped."""
    p = lines.withColumn("label", label_of(F.col("line"), kind)).filter("label <> 'ignore'").withColumn("rest", F.element_at(F.split("line", ":"), 2)).filter(F.col("rest").isNotNull() & ~F.lower("rest").contains("n/a"))
    number = F.expr("try_cast(replace(trim(split(rest, '\\\\(')[0]), ',', '') as bigint)")
    quarter = (F.length("rest") - F.length(F.replace("rest", F.lit("25%"), F.lit("")))) == 12
    value = F.when(F.col("label") == "pair_percents", F.when(quarter, 25).otherwise(-1)).otherwise(number)
    return p.select("file", "label", value.cast("long").alias("value")).filter("value is not null")


def merge_stats(parsed: DataFrame) -> DataFrame:
    """(label, value): sums over files; the largest convergence; pair percents 25 only if all files say so."""
    how = F.when(F.col("label") == "convergence", F.max("value")).when(F.col("label") == "pair_percents", F.min("value")).otherwise(F.sum("value"))
    return parsed.groupBy("label").agg(how.alias("value"))


def parse_histograms(files: DataFrame) -> DataFrame:
    """(file, name, i, value): the arrays of histogram reports (file, content), in reading order."""
    arrays = F.regexp_extract_all("content", F.lit(r"([A-Za-z]\w* = \[[^\]]*)\]"), 1)
    named = files.select("file", F.explode(arrays).alias("a")).select("file", F.regexp_extract("a", r"^(\w+)", 1).alias("name"), F.regexp_extract_all("a", F.lit(r"(?<![\w.])(-?\d+)(?![\w.])"), 1).alias("v"))
    return named.select("file", "name", F.posexplode("v").alias("i", "value")).withColumn("value", F.col("value").cast("long"))


def merge_histograms(parsed: DataFrame) -> DataFrame:
    """(name, i, value): element-wise sums; the axis x is kept, and must agree between files."""
    axis = F.col("name") == "x"
    agree = F.when(axis & (F.min("value") != F.max("value")), F.raise_error(F.lit("histogram axes differ")).cast("long"))
    return parsed.groupBy("name", "i").agg(F.coalesce(agree, F.when(axis, F.max("value")).otherwise(F.sum("value"))).alias("value"))
