"""Read-pair quality statistics: one wide conditional aggregate per MAPQ threshold, and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlattice.functions.pairs import DISTANCES, distance_bin, is_short, pair_type
from pairlattice.functions.scalars import library_size

SETTLED, SETTLED_BINS, MAPQ_SHOWN = 0.01, 3, 200


def classified(pairs: DataFrame, thresholds: tuple[int, ...] = (1, 30), ligation: str | None = None) -> DataFrame:
    """Pairs by threshold (a literal array of one or two values is exploded) with fate, distance and orientation."""
    d = F.abs(F.col("pos1") - F.col("pos2"))
    same = F.col("chr1") == F.col("chr2")
    low = ~is_short() & (F.col("mapq1") >= 0) & (F.col("mapq2") >= 0) & (F.least("mapq1", "mapq2") < F.col("threshold"))
    fate = F.when(same & (F.col("frag1") == F.col("frag2")), "intra_fragment").when(low, "under_mapq").otherwise("contact")
    out = pairs.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    out = out.withColumns({"fate": fate, "intra": same, "dist": d, "pair_type": pair_type()})
    if ligation and "seq1" in pairs.columns:
        tail = ligation[len(ligation) // 2 :]
        both = F.col("seq1").isNotNull() & F.col("seq2").isNotNull()
        out = out.withColumns({"dangling": both & (F.col("seq1").startswith(tail) | F.col("seq2").startswith(tail)), "ligation": both & (F.col("seq1").contains(ligation) | F.col("seq2").contains(ligation))})
    else:
        out = out.withColumns({"dangling": F.lit(False), "ligation": F.lit(False)})
    return out


def counts(pairs: DataFrame, thresholds: tuple[int, ...] = (1, 30), ligation: str | None = None) -> DataFrame:
    """A row per threshold; pairs are combined to it in their tasks. Columns that no input gives are null."""
    c = classified(pairs, thresholds, ligation)
    contact = F.col("fate") == "contact"
    near = contact & F.col("intra")
    far = near & (F.col("dist") >= 20000)
    n = lambda cond: F.count_if(cond)
    aggs = {
        "n_unique": F.count("*"), "intra_fragment": n(F.col("fate") == "intra_fragment"), "under_mapq": n(F.col("fate") == "under_mapq"), "contacts": n(contact), "dangling": n(contact & F.col("dangling")), "ligation": n(contact & F.col("ligation")),
        "inter": n(contact & ~F.col("intra")), "intra": n(near), "under_500": n(near & (F.col("dist") < 500)), "under_5k": n(near & (F.col("dist") >= 500) & (F.col("dist") < 5000)), "under_20k": n(near & (F.col("dist") >= 5000) & (F.col("dist") < 20000)), "far": n(far),
        "far_left": n(far & (F.col("pair_type") == "LL")), "far_inner": n(far & (F.col("pair_type") == "INNER")), "far_outer": n(far & (F.col("pair_type") == "OUTER")), "far_right": n(far & (F.col("pair_type") == "RR")),
    }
    return c.groupBy("threshold").agg(*[v.alias(k) for k, v in aggs.items()])


def orientation_histogram(pairs: DataFrame, thresholds: tuple[int, ...] = (1,)) -> DataFrame:
    """(threshold, bin, n_inner, n_outer, n_right, n_left): intra contacts by log distance."""
    c = classified(pairs, thresholds).filter("fate = 'contact' and intra")
    n = lambda t: F.count_if(F.col("pair_type") == t)
    return c.groupBy("threshold", distance_bin(F.col("dist")).alias("bin")).agg(n("INNER").alias("n_inner"), n("OUTER").alias("n_outer"), n("RR").alias("n_right"), n("LL").alias("n_left"))


def mapq_histogram(pairs: DataFrame, thresholds: tuple[int, ...] = (1,)) -> DataFrame:
    """(threshold, mapq, n_all, n_intra, n_inter): contacts by the smaller MAPQ."""
    c = classified(pairs, thresholds).filter("fate = 'contact' and mapq1 >= 0 and mapq2 >= 0").withColumn("mapq", F.least("mapq1", "mapq2")).filter(F.col("mapq") <= MAPQ_SHOWN)
    return c.groupBy("threshold", "mapq").agg(F.count("*").alias("n_all"), F.count_if("intra").alias("n_intra"), F.count_if(~F.col("intra")).alias("n_inter"))


def convergence(hist: DataFrame, settled: float = SETTLED) -> DataFrame:
    """(threshold, bin): the first log-distance class from which the four orientations agree, for it and the next ones.

    The hundred classes are a fixed frame; absent ones have an error of 1000.
    """
    spark = hist.sparkSession
    frame = hist.select("threshold").distinct().join(F.broadcast(spark.range(len(DISTANCES)).select(F.col("id").cast("int").alias("bin"))))
    kinds = ("n_inner", "n_outer", "n_right", "n_left")
    h = frame.join(hist, ["threshold", "bin"], "left").fillna(0, list(kinds))
    total = sum((F.col(k) for k in kinds), F.lit(0))
    mean = F.log(total / 4.0)
    # a mean count of one has no logarithm to compare with, and an orientation that never occurs no agreement
    one = lambda k: F.when((F.col(k) == 0) | (total == 4), F.lit(float("inf"))).otherwise(F.abs(F.try_divide(mean - F.log(k), mean)))
    error = F.when(total < 1, F.lit(1000.0)).otherwise(F.greatest(*map(one, kinds)))
    ahead = W.partitionBy("threshold").orderBy("bin").rowsBetween(0, SETTLED_BINS)
    h = h.withColumn("error", error).withColumn("worst", F.max("error").over(ahead))
    return h.groupBy("threshold").agg(F.coalesce(F.min(F.when(F.col("worst") < settled, F.col("bin"))), F.lit(len(DISTANCES) - 1)).alias("bin"))


def complexity(keyed: DataFrame, *keys: str) -> DataFrame:
    """(n_total, n_unique, n_dups, library_size) of rows that are duplicates if they agree on keys."""
    per = keyed.groupBy(*keys).agg(F.count("*").alias("n"))
    c = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"), F.count("*").alias("n_unique"))
    return c.withColumn("n_dups", F.col("n_total") - F.col("n_unique")).withColumn("library_size", library_size(F.col("n_dups"), F.col("n_unique")))
