"""Sinks: the matrix set as partitioned tables, pairs as text, reports, tables over JDBC."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pairlattice.functions.pairs import DISTANCES
from pairlattice.operators.norms import ORDER
from pairlattice.sources.placed import write_placed


def write_matrix_set(cells: DataFrame, chroms: DataFrame, path: str, attributes: dict[str, str] | None = None, least: float = 0.0) -> None:
    """``path/cells`` by resolution and chromosome pair, ``path/chromosomes``, ``path/metadata``.

    Rows are dealt by matrix and by a block of columns, so that a large matrix is many files, and
    sorted row-major inside a file, which gives tight min/max ranges for y.
    """
    spark = cells.sparkSession
    kept = cells.filter(F.col("n") >= least) if least > 0 else cells
    dealt = kept.repartition("resolution", "chr1", "chr2", F.expr("x div 4096")).sortWithinPartitions("resolution", "chr1", "chr2", "y", "x")
    dealt.write.mode("overwrite").partitionBy("resolution", "chr1", "chr2").parquet(f"{path}/cells")
    chroms.write.mode("overwrite").parquet(f"{path}/chromosomes")
    rows = [Row(key=k, value=v) for k, v in {"version": "1", **(attributes or {})}.items()]
    spark.createDataFrame(rows).write.mode("overwrite").parquet(f"{path}/metadata")


def read_cells(spark: SparkSession, path: str, resolution: int | None = None, chr1: int | None = None, chr2: int | None = None) -> DataFrame:
    """Cells of a matrix set; given keys prune the folders that are read."""
    cells = spark.read.parquet(f"{path}/cells")
    for name, value in (("resolution", resolution), ("chr1", chr1), ("chr2", chr2)):
        if value is not None:
            cells = cells.filter(F.col(name) == value)
    return cells


def write_norms(norms: DataFrame, path: str) -> None:
    """Vectors (norm, resolution, chr, bin, v) into ``path/norms``; only the (norm, resolution) folders they hold are replaced."""
    known = norms.filter(F.col("norm").isNotNull())
    (known.repartition("norm", "resolution", "chr").sortWithinPartitions("norm", "resolution", "chr", "bin").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("norm", "resolution").parquet(f"{path}/norms"))


def read_norms(spark: SparkSession, path: str, norm: str, resolution: int) -> DataFrame:
    """(resolution, chr, bin, v) of one stored kind of vector at one bin size; null values are invalid bins."""
    return spark.read.parquet(f"{path}/norms").filter((F.col("norm") == norm) & (F.col("resolution") == resolution)).select("resolution", "chr", "bin", "v").filter("v is not null")


def norm_order(norm: str) -> int:
    return ORDER.index(norm) if norm in ORDER else len(ORDER)


def write_expected(density: DataFrame, factors: DataFrame, path: str) -> None:
    density.write.mode("overwrite").partitionBy("resolution").parquet(f"{path}/expected")
    factors.write.mode("overwrite").parquet(f"{path}/chr_scale")


def pairs_as_text(pairs: DataFrame, names: DataFrame | None = None, with_mapq: bool = False) -> DataFrame:
    """(value): lines of nine columns, strand chr pos frag twice, then the score; with mapq after each frag eleven; strands as 0 and 16."""
    if names is not None:
        for c in ("chr1", "chr2"):
            pairs = pairs.join(F.broadcast(names.select(F.col("idx").alias(c), F.col("name").alias(f"{c}_name"))), c).drop(c).withColumnRenamed(f"{c}_name", c)
    strand = lambda c: F.when(F.col(c), "0").otherwise("16")
    s = lambda c: F.col(c).cast("string")
    side = lambda i: [strand(f"strand{i}"), *(s(f"{c}{i}") for c in ("chr", "pos", "frag", *(("mapq",) if with_mapq else ())))]
    return pairs.select(F.concat_ws("\t", *side(1), *side(2), s("score")).alias("value"))


def write_pairs_text(pairs: DataFrame, path: str, names: DataFrame | None = None, codec: str | None = None, with_mapq: bool = False) -> None:
    w = pairs_as_text(pairs, names, with_mapq).write.mode("overwrite")
    (w.option("compression", codec) if codec else w).text(path)


#: Lines of a statistics report: text, column of the counts, whether 0 is shown as N/A (fixed values).
REPORT = (
    ("Intra-fragment Reads: ", "intra_fragment", True), ("Below MAPQ Threshold: ", "under_mapq", True), ("Hi-C Contacts: ", "contacts", False), (None, "bias", False), ("Inter-chromosomal: ", "inter", False), ("Intra-chromosomal: ", "intra", False),
    ("Short Range (<20Kb):", None, False), ("  <500BP: ", "under_500", False), ("  500BP-5kB: ", "under_5k", False), ("  5kB-20kB: ", "under_20k", False), ("Long Range (>20Kb): ", "far", False),
)


def stats_lines(row: Row, sequenced: int | None = None, unique: int | None = None, settled_bin: int | None = None) -> list[str]:
    """A report's lines from one row of ``qc.counts`` (a row per threshold, so it fits the driver).

    sequenced and unique are those of an earlier report: shares are then of both, and unique pairs that are not in the
    input, where none was below the threshold, had been left out for their MAPQ.
    """
    if unique and not row["under_mapq"]:
        row = Row(**(row.asDict() | {"under_mapq": max(0, unique - row["n_unique"])}))
    total = unique or row["n_unique"] or 1
    part = lambda n: f"{n * 100 / sequenced:.2f}% / {n * 100 / total:.2f}%" if sequenced and unique else f"{n * 100 / total:.2f}%"
    out = []
    for text, column, blank in REPORT:
        if column is None:
            out.append(text)
        elif column == "bias":
            out.append(" 3' Bias (Long Range): N/A")
            if row["far"]:
                shares = " - ".join(f"{row[c] * 100 / row['far']:.0f}%" for c in ("far_left", "far_inner", "far_outer", "far_right"))
                out.append(f" Pair Type %(L-I-O-R): {shares}")
                out.append(f" L-I-O-R Convergence: {DISTANCES[settled_bin if settled_bin is not None else len(DISTANCES) - 1]}")
            else:
                out.append(" Pair Type %(L-I-O-R): N/A")
        else:
            out.append(f"{text}N/A" if blank and not row[column] else f"{text}{row[column]:,} ({part(row[column])})")
    return out


def histogram_lines(mapq: DataFrame, orientation: DataFrame, threshold: int) -> list[str]:
    """The histogram report: A (2000 zeros, never counted), B (MAPQ 1-200), D (100 log distances), x. Both tables are of fixed size."""
    m = {r["mapq"]: r for r in mapq.filter(F.col("threshold") == threshold).collect()}
    d = {r["bin"]: r for r in orientation.filter(F.col("threshold") == threshold).collect()}
    line = lambda r, cols: " ".join(str(r[c]) if r else "0" for c in cols)
    b = [line(m.get(i), ("n_all", "n_intra", "n_inter")) for i in range(1, 201)]
    o = [line(d.get(i), ("n_inner", "n_outer", "n_right", "n_left")) for i in range(100)]
    return ["A = [", "0 " * 2000, "];", "B = [", *b, "];", "D = [", *o, "];", "x = [", " ".join(map(str, DISTANCES)) + " ", "];"]


def complexity_lines(row: Row, optical: int = 0) -> list[str]:
    share = lambda n: f" ({n / row['n_total']:.2%})" if row["n_total"] else ""
    return [f"Unique Reads: {row['n_unique']:,}{share(row['n_unique'])}", f"PCR Duplicates: {row['n_dups'] - optical:,}{share(row['n_dups'] - optical)}", f"Optical Duplicates: {optical:,}{share(optical)}", f"Library Complexity Estimate: {row['library_size'] or 0:,}"]


#: Lines of a merged report by read type: text, label, and the label of what a second percentage is of (fixed values).
_BEFORE = {
    "Paired End": (
        ("Sequenced Read Pairs: ", "sequenced", None), ("No chimera found: ", "no_chimera", None), ("One or both reads unmapped: ", "unmapped", None), ("2 alignments: ", "two", None),
        ("\t2 alignments (A...B): ", "two_ends", None), ("\t2 alignments (A1...A2B; A1B2...B1A2): ", "two_split", None), ("3 or more alignments: ", "three_plus", None), ("Ligation Motif Present: ", "ligation_motif", None),
    ),
    "Single End": (
        ("Sequenced Reads: ", "sequenced", None), ("No chimera found: ", "no_chimera", None), ("0 alignments: ", "unmapped", None), ("1 alignment: ", "one", None), ("\t1 alignment unique: ", "one_unique", "one"), ("\t1 alignment duplicates: ", "one_dups", "one"),
        ("2 alignments: ", "two", None), ("\t2 alignment unique: ", "two_unique", "two"), ("\t2 alignment duplicates: ", "two_dups", "two"), ("3 or more alignments: ", "three_plus", None), ("Ligation Motif Present: ", "ligation_motif", None),
    ),
}
_AFTER = (
    ("Total Unique: ", "total_unique", "alignable"), ("Total Duplicates: ", "total_dups", "alignable"), ("Intra-fragment Reads: ", "intra_fragment", "contacts_of"), ("Below MAPQ Threshold: ", "below_mapq", "contacts_of"), ("Hi-C Contacts: ", "contacts", "contacts_of"), ("\t3' Bias (Long Range): ", "three_bias", "contacts_of"),
    ("pairs", "pair_percents", None), ("Inter-chromosomal: ", "inter", "contacts_of"), ("Intra-chromosomal: ", "intra", "contacts_of"), ("Short Range (<20Kb):", None, None), ("\t<500BP: ", "under_500", "contacts_of"), ("\t500BP-5kB: ", "under_5k", "contacts_of"), ("\t5kB-20kB: ", "under_20k", "contacts_of"), ("Long Range (>20Kb): ", "far", "contacts_of"),
)


def merged_report_lines(merged: dict[str, int], kind: str | None = None) -> list[str]:
    """Lines of a merged report from (label, value) of ``merge.merge_stats``: counts above 0, with their share of sequenced reads and of what they are a part of."""
    single = kind == "Single End"
    of = merged | {"alignable": merged.get("two", 0) + (merged.get("one", 0) if single else 0), "contacts_of": merged.get("two_unique" if single else "total_unique", 0)}
    sequenced = merged.get("sequenced", 0)
    out = [f"Read type: {kind}"] if kind else []
    for text, label, part in (*_BEFORE[kind or "Paired End"], *_AFTER):
        value = merged.get(label, 0)
        if label is None:
            out.append(text)
        elif label == "pair_percents":
            if value == 25:
                out.append("\tPair Type %(L-I-O-R): 25% - 25% - 25% - 25%")
                out += [f"\tL-I-O-R Convergence: {merged['convergence']:,}"] if merged.get("convergence", 0) > 0 else []
        elif value > 0:
            shares = [f"{value * 100 / n:.2f}%" for n in (sequenced, of.get(part, 0) if sequenced > 0 and label != "sequenced" else 0) if n > 0 and label != "sequenced"]
            out.append(f"{text}{value:,}" + (f" ({' / '.join(shares)})" if shares else ""))
    return out


def merged_histogram_lines(merged: DataFrame) -> list[str]:
    """Lines of a merged histogram report from (name, i, value): A in one line, B by threes, D by fours, x; of fixed size."""
    arrays: dict[str, list[int]] = {}
    for r in merged.orderBy("name", "i").collect():
        arrays.setdefault(r["name"], []).append(r["value"])
    wide = {"B": 3, "D": 4}
    out = []
    for name in ("A", "B", "D", "x"):
        v = arrays.get(name, [])
        n = wide.get(name, max(1, len(v)))
        out += [f"{name} = [", *(" ".join(map(str, v[i : i + n])) for i in range(0, len(v), n)), "];"]
    return out


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_report(spark: SparkSession, lines: list[str], path: str) -> None:
    """A report as one file of this name, through Hadoop's file system."""
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(to, True)
    try:
        stream.write(bytearray(("\n".join(lines) + "\n").encode()))
    finally:
        stream.close()


def tile_header(genome: str, chromosome: str, resolution: int, lower: float, upper: float, bins: int, side: int = 500) -> bytes:
    """Header of a tiled matrix file (fixed format): magic, version, names ended by a zero byte, bin size, the two values, rows, columns, tile side."""
    name = lambda x: x.encode() + b"\0"
    return b"hic\0" + struct.pack("<i", 1) + name(genome) + name(chromosome) * 2 + struct.pack("<iffiii", resolution, lower, upper, bins, bins, side)


def write_matrix_tiles(matrix: DataFrame, path: str, genome: str, chromosome: str, resolution: int, bins: int, value: str = "r", side: int = 500) -> None:
    """One file of a square matrix given by its cells x <= y: the header, then square tiles row by row, each row by row as floats; absent cells are NaN.

    Tiles at the right and lower edge are cut to the matrix, so a tile's place follows from its numbers. Tiles without cells are written too.
    """
    spark = matrix.sparkSession
    ends = matrix.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    header = tile_header(genome, chromosome, resolution, ends["lo"] or 0.0, ends["hi"] or 0.0, bins, side)
    full = matrix.select("x", "y", value).unionByName(matrix.filter("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"), value))
    tiles = -(-bins // side)
    grid = spark.range(tiles).select(F.col("id").alias("tx"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)).cast("array<long>")).alias("ty"))
    found = grid.join(matrix_tiles(full, value, side, bins), ["tx", "ty"], "left")
    rows = F.least(F.lit(side), F.lit(bins) - F.col("tx") * side)
    empty = F.expr(f"unhex(repeat('0000C07F', cast(least({side}, {bins} - tx * {side}) * least({side}, {bins} - ty * {side}) as int)))")
    at = len(header) + 4 * (F.col("tx") * side * bins + rows * F.col("ty") * side)
    pieces = found.select(at.alias("at"), F.coalesce("content", empty).alias("content"))
    first = spark.createDataFrame([(0, bytearray(header))], "at long, content binary")
    write_placed(pieces.unionByName(first), path, len(header) + 4 * bins * bins)


def write_vector_text(vector: DataFrame, path: str) -> None:
    """One value a line by bin, NaN where there is none: each part file is a range of bins, the parts are in order."""
    vector.orderBy("bin").select(F.coalesce(F.col("v").cast("string"), F.lit("NaN")).alias("value")).write.mode("overwrite").text(path)


def write_matrix_text(matrix: DataFrame, path: str, value: str = "r") -> None:
    """Row-major triples (x, y, value), tab separated."""
    matrix.orderBy("x", "y").select("x", "y", value).write.mode("overwrite").csv(path, sep="\t")


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 1000, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).mode(mode).save()


def matrix_tiles(matrix: DataFrame, value: str = "r", side: int = 500, bins: int | None = None) -> DataFrame:
    """(tx, ty, content): square tiles of a dense matrix as little-endian floats, row by row; absent cells are NaN; cut to the matrix where its bins are given."""
    import numpy as np
    import pandas as pd

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows, columns = (min(side, bins - k * side) if bins else side for k in key)
        tile = np.full((rows, columns), np.nan, "<f4")
        tile[pdf["x"] % side, pdf["y"] % side] = pdf[value]
        return pd.DataFrame({"tx": [key[0]], "ty": [key[1]], "content": [tile.tobytes()]})

    keyed = matrix.select("x", "y", value, F.expr(f"x div {side}").alias("tx"), F.expr(f"y div {side}").alias("ty"))
    return keyed.groupBy("tx", "ty").applyInPandas(one, "tx long, ty long, content binary")
