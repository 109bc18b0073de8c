"""Entry point by suffix, and the smaller text sources: norm vectors, reports, annotations, sites, tracks, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlattice.functions.genome import clean_name
from pairlattice.sources.bigwig import read_bigwig
from pairlattice.sources.pairs_binary import FULL, SHORT, read_pairs_binary, read_records
from pairlattice.sources.pairs_text import read_pairs_text


def read_pairs(spark: SparkSession, path: str, chroms: DataFrame | None = None, fmt: str = "auto") -> DataFrame:
    """Pairs of any supported file: ``.bin`` and ``.bn`` are binary, everything else is text."""
    kind = fmt if fmt != "auto" else "full" if path.endswith(".bin") else "short" if path.endswith(".bn") else "text"
    if kind == "text":
        return read_pairs_text(spark, path, chroms)
    return read_pairs_binary(spark, path, FULL if kind == "full" else SHORT)


def read_norm_vectors(spark: SparkSession, paths: str | list[str], chroms: DataFrame) -> DataFrame:
    """(norm, resolution, chr, unit, bin, v) of vector files: ``vector type chr resolution unit`` headers, then a value a line.

    ``nan`` and ``.`` are NaN; unknown chromosomes are skipped; more values than a chromosome has bins is an
    error. Values take their header by a running count along the file's lines.
    """
    lines = spark.read.text(paths.split(",") if isinstance(paths, str) else paths).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).filter(F.trim("value") != "")
    head = F.lower("value").startswith("vector")
    along = W.partitionBy("file").orderBy("at")
    marked = lines.withColumn("block", F.sum(head.cast("int")).over(along)).withColumn("head", head)
    heads = marked.filter("head").select("file", "block", F.split(F.trim("value"), r"\s+").alias("h"), F.col("at").alias("head_at"))
    heads = heads.select("file", "block", "head_at", F.upper(F.get("h", F.lit(1))).alias("norm"), clean_name(F.get("h", F.lit(2))).alias("name"), F.get("h", F.lit(3)).cast("int").alias("resolution"), F.upper(F.get("h", F.lit(4))).alias("unit"))
    named = heads.join(F.broadcast(chroms.select(clean_name(F.col("name")).alias("name"), F.col("idx").alias("chr"), "length")), "name")
    raw = F.lower(F.trim("value"))
    v = F.when(raw.isin("nan", "."), F.lit(float("nan"))).otherwise(raw.cast("double"))
    rows = marked.filter("not head").join(F.broadcast(named), ["file", "block"])
    bin_ = F.row_number().over(W.partitionBy("file", "block").orderBy("at")) - 1
    rows = rows.select("norm", "resolution", "chr", "unit", bin_.cast("long").alias("bin"), v.alias("v"), "length")
    over = F.expr("bin > length div resolution")
    checked = F.when(over, F.raise_error(F.lit("norm vector has more values than bins")).cast("double")).otherwise(F.col("v"))
    return rows.select("norm", "resolution", "chr", "unit", "bin", checked.alias("v"))


def read_report_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line) of statistics reports."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def read_whole(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, content) of small files that are attributes or histograms."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


#: What marks the numbers of an earlier report, in lower case (fixed values): label, must hold, must not hold.
EARLIER = (("sequenced", "sequenced", None), ("unique", "unique", None), ("duplicates", "duplicate", "optical"), ("complexity", "complexity", None), ("single_alignment", "single", None))


def earlier_values(lines: DataFrame) -> DataFrame:
    """(file, label, value): the first number of each kind in an existing report."""
    low = F.lower("line")
    first = F.split("line", ":")[0]
    one = (first.contains("1") | F.lower(first).contains("one")) & F.lower(first).contains("alignment")
    label = F.lit(None).cast("string")
    for name, has, lacks in reversed(EARLIER):
        cond = low.contains(has) if lacks is None else low.contains(has) & ~low.contains(lacks)
        if name == "single_alignment":
            cond = cond & low.contains("alignment")
        label = F.when(cond, F.when(one & F.lit(name in ("unique", "duplicates")), f"single_{name}").otherwise(name)).otherwise(label)
    number = F.regexp_replace(F.regexp_extract("line", r":\s*([0-9][0-9, ]*)", 1), "[, ]", "")
    rows = lines.withColumn("at", F.monotonically_increasing_id()).select("file", "at", label.alias("label"), F.expr("1").alias("one"), number.alias("number")).filter("label is not null and number <> ''")
    return rows.groupBy("file", "label").agg(F.min_by(F.col("number").cast("long"), "at").alias("value"))


def count_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, n): lines per file, counted in one scan."""
    return spark.read.text(paths).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(chr, beg, end, name, score, line) of whitespace-separated annotation lines."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("#")).select(f.alias("f"), "value")
    return rows.select(F.get("f", F.lit(0)).alias("chr"), F.get("f", F.lit(1)).cast("long").alias("beg"), F.get("f", F.lit(2)).cast("long").alias("end"), F.get("f", F.lit(3)).alias("name"), F.get("f", F.lit(4)).cast("int").alias("score"), F.col("value").alias("line"))


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """(chr, sites array) of ``chr s1 s2 ...`` lines."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(f.alias("f")).select(F.get("f", F.lit(0)).alias("chr"), F.transform(F.slice("f", F.lit(2), F.size("f")), lambda x: x.cast("long")).alias("sites"))


def read_track(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end, value) of a bigWig (``.bw``, ``.bigwig``) or else a bedGraph, of which track and browser lines are skipped."""
    if path.lower().endswith((".bw", ".bigwig")):
        return read_bigwig(spark, path)
    rows = spark.read.csv(path, sep="\t", comment="#", schema="chr string, start long, end long, value double")
    return rows.filter(~F.col("chr").startswith("track") & ~F.col("chr").startswith("browser"))


def read_range_index(spark: SparkSession, path: str) -> DataFrame:
    """(chr1, chr2, start, size) of a byte-range index; Spark splits files itself, so it serves inspection only."""
    rows = spark.read.csv(path, schema="pair string, skipped string, start long, size long")
    return rows.select(F.split_part("pair", F.lit("-"), F.lit(1)).alias("chr1"), F.split_part("pair", F.lit("-"), F.lit(2)).alias("chr2"), "start", "size")


def read_jdbc(spark: SparkSession, url: str, query: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A query over JDBC, dealt by ranges of an integer key where one is given."""
    r = spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", fetchsize="10000", **options)
    if key and bounds:
        r = r.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return r.load()


def read_coo(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, n) of temporary cell records: two ints and a float, little endian."""
    import numpy as np
    import pyarrow as pa

    kind = np.dtype([("x", "<i4"), ("y", "<i4"), ("n", "<f4")])

    def run(batches):
        for b in batches:
            if b.num_rows:
                r = np.frombuffer(b.column(0).buffers()[2], kind, b.num_rows, b.column(0).offset * kind.itemsize)
                yield pa.RecordBatch.from_pydict({n: np.ascontiguousarray(r[n]) for n in kind.names})

    return read_records(spark, path, kind).mapInArrow(run, "x int, y int, n float")
