"""Single files whose pieces tasks write at places known beforehand."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


class PlacedBytes(DataSource):
    """``df.write.format("placed_bytes").option("size", n).save(path)``: rows (at long, content binary) as one file of n bytes on a mounted path.

    The job makes a hidden file of that size beside the path, tasks write their pieces into it, and committing gives it its name; aborting deletes
    it. A piece has its place, so a task that runs twice writes the same bytes again.
    """

    @classmethod
    def name(cls) -> str:
        return "placed_bytes"

    def schema(self) -> str:
        return "at long, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:  # noqa: ANN001
        return _PlacedWriter(self.options)


@dataclass
class _Placed(WriterCommitMessage):
    size: int


class _PlacedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"].removeprefix("file://"), int(options["size"])
        folder, _, name = self.path.rpartition("/")
        self.held = f"{folder or '.'}/.{name}.{uuid.uuid4().hex}"
        os.makedirs(folder or ".", exist_ok=True)
        with open(self.held, "wb") as f:
            f.truncate(self.size)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Placed:
        size = 0
        with open(self.held, "r+b") as f:
            for batch in batches:
                at, content = (batch.column(batch.schema.get_field_index(c)) for c in ("at", "content"))
                for a, c in zip(at.to_pylist(), content):
                    f.seek(a)
                    size += f.write(c.as_buffer())
        return _Placed(size)

    def commit(self, messages: list[_Placed | None]) -> None:
        if (size := sum(m.size for m in messages if m is not None)) != self.size:
            self.abort(messages)
            raise ValueError(f"pieces of {size} bytes for a file of {self.size}")
        os.replace(self.held, self.path)

    def abort(self, messages: list[_Placed | None]) -> None:
        if os.path.exists(self.held):
            os.remove(self.held)


def write_placed(pieces: DataFrame, path: str, size: int) -> None:
    """Pieces (at, content) as one file of this size."""
    pieces.sparkSession.dataSource.register(PlacedBytes)
    pieces.select("at", "content").write.format("placed_bytes").option("size", size).mode("append").save(path)


def with_places(sizes: DataFrame, keys: list[str], start: int = 0, slice_key: str = "slice") -> tuple[DataFrame, int]:
    """sizes (keys, size, slice) with ``at``, the sum of the sizes before each row in the order of (slice, keys), and the end of all.

    Slices are numbers whose order agrees with the keys'; only their sums are brought together on one task, and only a slice's rows are summed in order.
    """
    sums = sizes.groupBy(slice_key).agg(F.sum("size").alias("slice_size"))
    before = F.sum("slice_size").over(W.orderBy(slice_key).rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(slice_key, "slice_size", F.coalesce(before, F.lit(0)).alias("slice_at"))
    end = start + (sums.agg(F.sum("slice_size")).first()[0] or 0)
    within = F.coalesce(F.sum("size").over(W.partitionBy(slice_key).orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("within", within).join(sums, slice_key).withColumn("at", F.col("slice_at") + F.col("within") + start).drop("within", "slice_at", "slice_size"), end
