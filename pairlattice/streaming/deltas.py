"""Cell counts of a stream kept as deltas: a batch writes what it adds, and a base takes the deltas up now and then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlattice.operators.binning import KEYS, bin_pairs

CELLS = "resolution int, chr1 int, chr2 int, x long, y long, n double"


def _store(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """The numbers of the whole tables named prefix=number in a folder: those that were written to their end."""
    store, at = _store(spark, folder)
    if not store.exists(at):
        return []
    found = [x.getPath().getName() for x in store.listStatus(at)]
    found = [x for x in found if x.startswith(f"{prefix}=") and store.exists(_store(spark, f"{folder}/{x}/_SUCCESS")[1])]
    return sorted(int(x.partition("=")[2]) for x in found)


def _state(spark: SparkSession, out: str) -> tuple[int, list[int]]:
    """The last batch that the newest base holds (-1: there is none), and the later batches."""
    upto = max(_numbers(spark, f"{out}/base", "upto"), default=-1)
    return upto, [b for b in _numbers(spark, f"{out}/delta", "batch") if b > upto]


def _sum(spark: SparkSession, out: str, upto: int, batches: list[int]) -> DataFrame:
    paths = ([f"{out}/base/upto={upto}"] if upto >= 0 else []) + [f"{out}/delta/batch={b}" for b in batches]
    if not paths:
        return spark.createDataFrame([], CELLS)
    parts = spark.read.schema(CELLS).parquet(*paths)
    return parts.groupBy(*KEYS).agg(F.sum("n").alias("n"))


def read_counts(spark: SparkSession, out: str) -> DataFrame:
    """The counts so far: the newest base and the deltas after it."""
    return _sum(spark, out, *_state(spark, out))


def compact(spark: SparkSession, out: str) -> None:
    """A new base of all there is; what it holds is deleted afterwards, so readers find one whole state at any time."""
    upto, batches = _state(spark, out)
    if not batches:
        return
    _sum(spark, out, upto, batches).write.mode("overwrite").parquet(f"{out}/base/upto={batches[-1]}")
    for old in [f"{out}/base/upto={b}" for b in _numbers(spark, f"{out}/base", "upto")[:-1]] + [f"{out}/delta/batch={b}" for b in batches]:
        store, at = _store(spark, old)
        store.delete(at, True)


def add_batches(resolution: int, out: str, every: int = 20) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` on a stream of pairs: writes the cells that a batch adds under its number, and a base after ``every`` batches.

    A batch that is played again replaces its own delta, or is left out if the base holds it already, so counts stay right however often a stream is
    stopped. A batch costs what it adds; only compacting reads the whole.
    """

    def add(pairs: DataFrame, batch: int) -> None:
        spark = pairs.sparkSession
        upto, batches = _state(spark, out)
        if batch <= upto:
            return
        bin_pairs(pairs, resolution).write.mode("overwrite").parquet(f"{out}/delta/batch={batch}")
        if len(set(batches) | {batch}) >= every:
            compact(spark, out)

    return add


def run_deltas(pairs: DataFrame, resolution: int, checkpoint: str, out: str, every: int = 20) -> DataFrame:
    """All there is of a stream of pairs, added to what ``out`` holds; the counts."""
    q = pairs.writeStream.foreachBatch(add_batches(resolution, out, every)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return read_counts(pairs.sparkSession, out)
