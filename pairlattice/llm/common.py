"""Shared pieces: table access, written intermediate tables, bounded broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = b" \t\n\x0b\x0c\r"
#: At most so many ids are broadcast; beyond that the same join runs as a shuffle.
BROADCAST_IDS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Folders of our own by application, where the session names none; names of the scopes that tables are written in just now.
_OWN_FOLDERS: dict[str, str] = {}
_SCOPES: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set, which a cluster cannot do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    application = spark.sparkContext.applicationId
    if application not in _OWN_FOLDERS:
        _OWN_FOLDERS[application] = "file://" + tempfile.mkdtemp(prefix="pairlattice-")
    return _OWN_FOLDERS[application]


def tables_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables are; those of a scope are in a folder of their own."""
    return "/".join((f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}", *_SCOPES))


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once its results are read or written elsewhere."""
    delete(spark, tables_folder(spark))


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are written meanwhile go at the end."""
    _SCOPES.append(uuid.uuid4().hex)
    try:
        yield
    finally:
        folder = tables_folder(spark)
        _SCOPES.pop()
        delete(spark, folder)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = path or f"{tables_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """df, written with a number of its own for every row, and that column's name: rows stay apart whatever their ids are."""
    row = own_name(df, "row")
    return written(df.withColumn(row, F.monotonically_increasing_id())), row


def by_ids(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join with a table of distinct ids, broadcast only when counted to be small."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, how)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows, as one row may hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives freed memory back to the system at its end: workers live on, beside those of other tasks."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # only the GNU library has it
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """Apply a per-batch function of column lists, made once per task, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            out = apply({name: batch.column(i) for i, name in enumerate(batch.schema.names)})
            if out is not None:
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


#: Arrays that tasks add up are sent in so many parts, first to one of so many adders each.
PARTS, ADDERS = 32, 16


def sum_parts(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's array of doubles as rows for ``sum_arrays``."""
    from pyspark import TaskContext

    spread = TaskContext.get().partitionId() % ADDERS
    yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "spread": pa.array([spread] * PARTS, pa.int32()), "counts": pa.array([zlib.compress(x.tobytes(), 1) for x in np.array_split(total, PARTS)], pa.binary())})


def _added(group: pa.Table) -> pa.Table:
    total = 0.0
    for x in group.column("counts"):
        total = total + np.frombuffer(zlib.decompress(x.as_py()), np.float64)
    return pa.table({"part": group.column("part")[:1].combine_chunks(), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def sum_arrays(rows: DataFrame) -> np.ndarray:
    """The sum over tasks of arrays of one fixed length, added in two levels; empty if there was no task."""
    rows = rows.groupBy("part", "spread").applyInArrow(_added, "part int, counts binary")
    found = {r["part"]: zlib.decompress(r["counts"]) for r in rows.groupBy("part").applyInArrow(_added, "part int, counts binary").collect()}
    return np.concatenate([np.frombuffer(found[i], np.float64) for i in range(PARTS)]) if found else np.empty(0)
