"""Binary pair files of fixed-size records, read in ranges and written per partition."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Record layouts, little endian (fixed values).
FULL = np.dtype([("strand1", "u1"), ("chr1", "<i4"), ("pos1", "<i4"), ("frag1", "<i4"), ("strand2", "u1"), ("chr2", "<i4"), ("pos2", "<i4"), ("frag2", "<i4")])
SHORT = np.dtype([("chr1", "<i4"), ("pos1", "<i4"), ("chr2", "<i4"), ("pos2", "<i4"), ("score", "<f4")])
SCHEMA = "strand1 boolean, chr1 int, pos1 long, frag1 int, mapq1 int, strand2 boolean, chr2 int, pos2 long, frag2 int, mapq2 int, score double"
_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
_DEFAULTS = {"strand1": True, "strand2": False, "frag1": 0, "frag2": 1, "mapq1": 1000, "mapq2": 1000, "score": 1.0}


def _frame(records: np.ndarray) -> pd.DataFrame:
    given = {n: records[n] for n in records.dtype.names}
    out = {c: given.get(c, _DEFAULTS.get(c)) for c in _COLUMNS}
    pdf = pd.DataFrame(out, index=range(len(records)))
    return pdf.astype({"strand1": bool, "strand2": bool, "pos1": "int64", "pos2": "int64", "score": "float64"})


def read_records(spark: SparkSession, path: str, kind: np.dtype) -> DataFrame:
    """(value binary): fixed-size records of files on any store, in splits that begin and end at record borders.

    Spark's own input for fixed-length records plans the splits and reads them in the JVM; a file is as many tasks' work as it has
    blocks. A file that ends inside a record is an error.
    """
    context = spark.sparkContext
    records = context._jsc.sc().binaryRecords(path, kind.itemsize, context._jsc.hadoopConfiguration())
    return DataFrame(spark._jsparkSession.createDataset(records, context._jvm.org.apache.spark.sql.Encoders.BINARY()), spark)


def read_pairs_binary(spark: SparkSession, path: str, layout: np.dtype | None = None) -> DataFrame:
    """Pairs of binary files: ``.bn`` holds short records, anything else full ones.

    A batch of records is one run of bytes, which NumPy reads as it is.
    """
    kind = layout if layout is not None else SHORT if path.rstrip("/").endswith(".bn") else FULL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            if len(column):
                yield _batch(np.frombuffer(column.buffers()[2], kind, len(column), column.offset * kind.itemsize))

    return read_records(spark, path, kind).mapInArrow(run, SCHEMA)


def _batch(records: np.ndarray) -> pa.RecordBatch:
    ints = {c: "int32" for c in ("chr1", "chr2", "frag1", "frag2", "mapq1", "mapq2")}
    return pa.RecordBatch.from_pandas(_frame(records).astype(ints), preserve_index=False)


class BinaryPairs(DataSource):
    """``df.write.format("binary_pairs").option("layout", "full|short").save(folder)``: a file of records per partition, shown only when all are whole.

    Tasks write under ``folder/_temporary``; committing moves the files of the tasks that count to their final names and adds
    ``_SUCCESS``, aborting deletes them. So a job that fails leaves nothing, and a task that runs twice is
    in the folder once. Folders are opened with pyarrow: local or mounted ones, or an object store's.
    """

    @classmethod
    def name(cls) -> str:
        return "binary_pairs"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:  # noqa: ANN001
        return _BinaryWriter(self.options, overwrite)


@dataclass
class _Written(WriterCommitMessage):
    staged: str
    final: str
    records: int


class _BinaryWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.short, self.overwrite, self.suffix = options.get("layout", "full") == "short", overwrite, options.get("suffix", "bin")
        path = options["path"]
        self.uri, self.job = path if "://" in path else f"file://{path}", uuid.uuid4().hex

    def _folder(self) -> tuple[fs.FileSystem, str]:
        store, folder = fs.FileSystem.from_uri(self.uri)
        return store, folder.rstrip("/")

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        store, folder = self._folder()
        context, kind, n = TaskContext.get(), SHORT if self.short else FULL, 0
        staged = f"{folder}/_temporary/{self.job}/{context.partitionId()}-{context.taskAttemptId()}"
        store.create_dir(staged.rpartition("/")[0], recursive=True)
        with store.open_output_stream(staged) as out:
            for batch in batches:
                records = np.zeros(batch.num_rows, kind)
                for c in kind.names:
                    records[c] = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                out.write(records.tobytes())
                n += len(records)
        return _Written(staged, f"{folder}/part-{context.partitionId():05d}-{self.job}.{self.suffix}", n)

    def commit(self, messages: list[_Written | None]) -> None:
        store, folder = self._folder()
        if self.overwrite:
            for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if x.is_file:
                    store.delete_file(x.path)
        for m in messages:
            if m is not None and m.records:
                store.move(m.staged, m.final)
        self._clear(store, folder)
        store.create_dir(folder, recursive=True)
        store.open_output_stream(f"{folder}/_SUCCESS").close()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*self._folder())

    def _clear(self, store: fs.FileSystem, folder: str) -> None:
        """Delete what this job staged, and the folder for it if no other job uses it."""
        held = f"{folder}/_temporary"
        for x in store.get_file_info(fs.FileSelector(held, allow_not_found=True)):
            if x.base_name == self.job:
                store.delete_dir(x.path)
        if store.get_file_info(held).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(held)):
            store.delete_dir(held)


def write_pairs_binary(pairs: DataFrame, folder: str, layout: np.dtype, suffix: str = "bin") -> None:
    """One file per partition in a folder that all executors reach; see ``BinaryPairs`` for when they show."""
    pairs.sparkSession.dataSource.register(BinaryPairs)
    kind = "short" if layout is SHORT or layout == SHORT else "full"
    columns = [F.col(c) for c in layout.names]
    pairs.select(*columns).write.format("binary_pairs").options(layout=kind, suffix=suffix).mode("overwrite").save(folder)
