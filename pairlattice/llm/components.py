"""Connected components of an edge table by repeated min-label hooking, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlattice.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component): component is the smallest id reachable; ids without an edge are absent.

    Alternates the large-star and small-star steps on (u, v) rows until they repeat; each pass
    is an aggregation and an equi-join, and is written, so that lineage stays short and a lost
    executor costs at most one pass. A hub's rows are never gathered: its least neighbour comes
    from a combined aggregate, the join that hands it out can be split where it is skewed.
    """
    pairs = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct())
    seen = None
    while True:
        # large star: neighbours above a node hook to its least neighbour (or to itself)
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u < v").distinct())
        # small star: a node and its lower neighbours hook to the least of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).filter("u < v").distinct()
        pairs = written(small)
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    nodes = pairs.select(F.col("v").alias("id"), F.col("u").alias("component"))
    return nodes.unionByName(pairs.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
