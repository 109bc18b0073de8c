"""Intervals and tracks: fragments, overlaps, window statistics, incremental reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sites_to_fragments(sites: DataFrame) -> DataFrame:
    """(chr, beg, end, idx) from (chr, sites array): each fragment ends at a site and begins at the one before."""
    s = sites.select("chr", F.posexplode("sites").alias("idx", "end"))
    before = F.lag("end", 1, 0).over(W.partitionBy("chr").orderBy("idx"))
    return s.select("chr", before.alias("beg"), "end", "idx")


#: Levels of nested bins; each is eight times as wide as the one before.
LEVELS = 16


def _at(position: str, width: int, level: Column) -> Column:
    """A position's bin on a level."""
    return F.call_function("shiftright", F.expr(f"{position} div {width}"), level * 3)


def _level(beg: str, end: str, width: int) -> Column:
    """The finest level on which a range meets at most nine bins; the last one if there is none."""
    narrow = lambda i: _at(end, width, F.lit(i)) - _at(beg, width, F.lit(i)) <= 8
    return F.coalesce(*[F.when(narrow(i), F.lit(i)) for i in range(LEVELS - 1)], F.lit(LEVELS - 1))


def overlap_join(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Rows of left (chr, beg, end, ...) and right (chr, r_beg, r_end, ...) whose closed ranges meet; positions from 0 to width * 2^45.

    Bins of ``width`` are nested in bins eight times as wide, and so on. A range's own level is the finest on which it meets
    at most nine bins, whatever its length; above the finest of all that is at least two, so that long ranges are spread.
    Rows meet in one equi join on bins of the wider of their two own levels: a range stands under its bins on its own level, and on those wider levels that are some range's own on the other side. ``own`` says whose own
    level it is, and the bin must be the one in which the ranges begin to meet, which makes every pair meet once.

    Both sides are shuffled and merged: Spark's estimate of their size knows nothing of the places of a row, and by it a large side would
    be sent to the driver to be broadcast. Each side is read twice, once for its levels (16 at most, broadcast), so it should be a stored table.
    """
    kept = lambda df, beg, end: df.filter(F.col(beg) <= F.col(end)).withColumn("held", _level(beg, end, width))
    mark = lambda own, level: F.struct(F.lit(own).alias("own"), F.col(level).cast("int").alias("level")).alias("place")

    def placed(df: DataFrame, beg: str, end: str, own: str, others: DataFrame, other: str, wider: Column) -> DataFrame:
        places = df.sparkSession.range(0, LEVELS, 1, 1).select(mark(own, "id")).unionByName(others.select(mark(other, "held")).distinct())
        level = F.col("place.level")
        under = df.join(F.broadcast(places), F.when(F.col("place.own") == own, level == F.col("held")).otherwise(wider))
        return under.withColumn("held", F.explode(F.sequence(_at(beg, width, level), _at(end, width, level))))

    a, b = kept(left, "beg", "end"), kept(right, "r_beg", "r_end")
    x = placed(a, "beg", "end", "left", b, "right", F.col("place.level") >= F.col("held"))
    y = placed(b, "r_beg", "r_end", "right", a, "left", F.col("place.level") > F.col("held"))
    first = _at("greatest(beg, r_beg)", width, F.col("place.level")) == F.col("held")
    return x.hint("merge").join(y, ["chr", "place", "held"]).filter(first).filter("beg <= r_end and end >= r_beg").drop("place", "held")


def window_stats(track: DataFrame, window: int) -> DataFrame:
    """(chr, win, mean, max): half-open windows by the middle of each item (chr, start, end, value); every window that has one."""
    mid = F.expr(f"(start + (end - start) div 2) div {window}")
    return track.groupBy("chr", mid.alias("win")).agg(F.avg("value").alias("mean"), F.max("value").alias("max"))


def dense_windows(stats: DataFrame) -> DataFrame:
    """Adds the windows between a chromosome's first and last that have no item, with nulls."""
    span = stats.groupBy("chr").agg(F.min("win").alias("lo"), F.max("win").alias("hi")).select("chr", F.explode(F.expr("sequence(lo, hi)")).alias("win"))
    return span.join(stats, ["chr", "win"], "left")


def after_mark(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows with a larger key than any in done: the increment since the last run."""
    mark = done.agg(F.coalesce(F.max(key), F.lit(-1)).alias("mark"))
    return rows.join(F.broadcast(mark), F.col(key) > F.col("mark")).drop("mark")


def sam_contacts(reads: DataFrame, least_insert: int = 1000) -> DataFrame:
    """The predicate of an alignment scan: paired, both ends mapped with quality, apart or on two chromosomes, first mate only."""
    return reads.filter(F.col("paired") & F.col("mapped") & F.col("mate_mapped") & (F.col("mapq") > 0)).filter((F.col("chr") != F.col("mate_chr")) | (F.abs("insert_size") > least_insert)).filter((F.col("chr") < F.col("mate_chr")) | ((F.col("chr") == F.col("mate_chr")) & (F.col("pos") <= F.col("mate_pos"))))
