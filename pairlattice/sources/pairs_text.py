"""Pair text files: seven layouts told by their column count or header, as one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlattice.functions.genome import resolve

PAIRS = T.StructType(
    [T.StructField(f"{c}{i}", t) for i in (1, 2) for c, t in (("strand", T.BooleanType()), ("chr", T.StringType()), ("pos", T.LongType()), ("frag", T.IntegerType()), ("mapq", T.IntegerType()), ("seq", T.StringType()))]
    + [T.StructField("score", T.DoubleType()), T.StructField("is_short", T.BooleanType())]
)

#: Place of each field, from 0, by number of columns (fixed values).
LAYOUTS = {
    4: {"chr1": 0, "pos1": 1, "chr2": 2, "pos2": 3},
    5: {"chr1": 0, "pos1": 1, "chr2": 2, "pos2": 3, "score": 4},
    8: {"strand1": 0, "chr1": 1, "pos1": 2, "frag1": 3, "strand2": 4, "chr2": 5, "pos2": 6, "frag2": 7},
    9: {"strand1": 0, "chr1": 1, "pos1": 2, "frag1": 3, "strand2": 4, "chr2": 5, "pos2": 6, "frag2": 7, "score": 8},
    11: {"strand1": 1, "chr1": 2, "pos1": 3, "frag1": 4, "strand2": 5, "chr2": 6, "pos2": 7, "frag2": 8, "mapq1": 9, "mapq2": 10},
    16: {"strand1": 0, "chr1": 1, "pos1": 2, "frag1": 3, "strand2": 4, "chr2": 5, "pos2": 6, "frag2": 7, "mapq1": 8, "seq1": 10, "mapq2": 11, "seq2": 13},
}
HEADED = {"chr1": 1, "pos1": 2, "chr2": 3, "pos2": 4, "strand1": 5, "strand2": 6}
_DEFAULT = {"strand1": "true", "strand2": "false", "frag1": "0", "frag2": "1", "mapq1": "1000", "mapq2": "1000", "score": "1.0", "seq1": "null", "seq2": "null"}


def layout_of(lines: DataFrame) -> tuple[dict[str, int], bool]:
    """(places, headed) from the first line and, in a headed file, its #columns line. Reads a few lines only."""
    first = lines.filter(F.trim("value") != "").first()
    if first is None:
        return LAYOUTS[4], False
    if first["value"].startswith("#"):
        places = dict(HEADED)
        names = lines.filter(F.col("value").startswith("#columns:")).first()
        for i, name in enumerate(names["value"].split()[1:] if names else []):
            if name in ("frag1", "frag2", "mapq1", "mapq2"):
                places[name] = i
        return places, True
    n = len(first["value"].split())
    if n not in LAYOUTS:
        raise ValueError(f"unexpected number of columns: {n}")
    return LAYOUTS[n], False


def parse(lines: DataFrame, places: dict[str, int], headed: bool = False) -> DataFrame:
    """Lines to pairs with chromosome names; comment and blank lines are skipped, all by column expressions."""
    rows = lines.filter((F.trim("value") != "") & ~F.col("value").startswith("#")).select(F.split(F.trim("value"), r"\s+").alias("f"))

    def field(name: str, kind: T.DataType) -> Column:
        if name == "is_short":
            return F.lit("mapq1" not in places).alias(name)
        if name not in places:
            return F.expr(_DEFAULT[name]).cast(kind).alias(name)
        raw = F.get("f", F.lit(places[name]))
        if name.startswith("strand"):
            return (raw == "+" if headed else raw.cast("int") == 0).alias(name)
        return raw.cast(kind).alias(name)

    return rows.select(*[field(f.name, f.dataType) for f in PAIRS])


def read_pairs_text(spark: SparkSession, path: str, chroms: DataFrame | None = None) -> DataFrame:
    """Pairs of a text file or folder (gzip by suffix). With a dictionary, names become ordinals and unknown ones are dropped."""
    lines = spark.read.text(path)
    pairs = parse(lines, *layout_of(lines))
    return pairs if chroms is None else resolve(pairs, chroms)


def first_seen_names(pairs: DataFrame) -> DataFrame:
    """Chromosomes without a dictionary: names are compared in lower case, which is all that statistics need."""
    return pairs.withColumns({c: F.lower(c) for c in ("chr1", "chr2")})
