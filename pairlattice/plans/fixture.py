"""Pairs, fragments and tracks made from the star-schema tables, for queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlattice.functions.genome import chromosomes

CHROMOSOMES = [(f"chr{i}", 8_000_000) for i in range(1, 5)]


def chroms(spark: SparkSession) -> DataFrame:
    return chromosomes(spark, CHROMOSOMES)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read pairs on four chromosomes from order lines: 85 % on one chromosome, distances decaying."""
    return pairs_of(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def pairs_of(lines: DataFrame) -> DataFrame:
    """The same of any frame of order lines, a stream's too."""
    q, ep = F.floor("l_quantity").cast("long"), F.floor("l_extendedprice").cast("long")
    b = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", q.alias("q"), ep.alias("ep"))
    at = (F.col("l_partkey") * 7919 + F.col("l_orderkey") * 104729) % 8000000
    c1 = (F.col("l_suppkey") % 4 + 1).cast("int")
    c2 = F.when(F.col("l_partkey") % 5 == 0, (F.col("l_partkey") % 4 + 1).cast("int")).otherwise(c1)
    p = b.select("l_orderkey", "l_linenumber", c1.alias("chr1"), c2.alias("chr2"), at.alias("pos1"), ((at + F.col("q") * F.col("q") * F.col("q") * F.col("q") + F.col("ep") % 1000) % 8000000).alias("pos2"), (F.col("l_returnflag") != "A").alias("strand1"), (F.col("l_linestatus") == "F").alias("strand2"), (F.col("ep") % 61).cast("int").alias("mapq1"), ((F.col("ep") + F.col("q")) % 61).cast("int").alias("mapq2"), F.lit(1.0).alias("score"))
    return p.withColumns({"frag1": F.expr("cast(pos1 div 4000 as int)"), "frag2": F.expr("cast(pos2 div 4000 as int)")})


PAIRS_SQL = """
b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus,
        CAST(floor(l_quantity) AS BIGINT) AS q, CAST(floor(l_extendedprice) AS BIGINT) AS ep FROM lineitem),
p0 AS (SELECT l_orderkey, l_linenumber, CAST(l_suppkey % 4 + 1 AS INT) AS chr1,
        CASE WHEN l_partkey % 5 = 0 THEN CAST(l_partkey % 4 + 1 AS INT) ELSE CAST(l_suppkey % 4 + 1 AS INT) END AS chr2,
        (l_partkey*7919 + l_orderkey*104729) % 8000000 AS pos1, q, ep, l_returnflag, l_linestatus FROM b),
p1 AS (SELECT l_orderkey, l_linenumber, chr1, pos1, chr2, (pos1 + q*q*q*q + ep % 1000) % 8000000 AS pos2,
        l_returnflag <> 'A' AS strand1, l_linestatus = 'F' AS strand2,
        CAST(ep % 61 AS INT) AS mapq1, CAST((ep + q) % 61 AS INT) AS mapq2, CAST(1.0 AS DOUBLE) AS score FROM p0),
pairs AS (SELECT *, CAST(pos1 // 4000 AS INT) AS frag1, CAST(pos2 // 4000 AS INT) AS frag2 FROM p1),
k AS (SELECT *, (chr1 < chr2 OR (chr1 = chr2 AND pos1 <= pos2)) AS keep FROM pairs),
canon AS (SELECT l_orderkey, l_linenumber, CASE WHEN keep THEN chr1 ELSE chr2 END AS chr1, CASE WHEN keep THEN chr2 ELSE chr1 END AS chr2,
        CASE WHEN keep THEN pos1 ELSE pos2 END AS pos1, CASE WHEN keep THEN pos2 ELSE pos1 END AS pos2,
        CASE WHEN keep THEN frag1 ELSE frag2 END AS frag1, CASE WHEN keep THEN frag2 ELSE frag1 END AS frag2,
        mapq1, mapq2, strand1, strand2, score FROM k)
"""


def cells_sql(resolution: int, name: str = "cells", source: str = "canon", where: str = "TRUE") -> str:
    return f"""{name} AS (SELECT {resolution} AS resolution, chr1, chr2, pos1 // {resolution} AS x, pos2 // {resolution} AS y, sum(score) AS n
  FROM {source} WHERE {where} GROUP BY ALL)"""


def halves_sql(cells: str = "ic", name: str = "halves") -> str:
    return f"{name} AS (SELECT resolution, chr, x AS bin, y AS other, n FROM {cells} UNION ALL SELECT resolution, chr, y, x, n FROM {cells} WHERE x <> y)"


CHROMS_SQL = "chroms(idx, name, length) AS (VALUES " + ", ".join(f"({i + 1}, '{n}', CAST({x} AS BIGINT))" for i, (n, x) in enumerate(CHROMOSOMES)) + ")"
