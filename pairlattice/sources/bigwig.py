"""bigWig tracks: the data blocks of the range index, read by the index's leaves.

Files are opened with pyarrow: on local or mounted paths, or in an object store.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the format: magics of the file, its chromosome tree and its range index; kinds of data sections.
FILE, TREE, RANGES = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
GRAPH, VARIABLE, FIXED = 1, 2, 3
_SECTION = struct.Struct("<IIIIIBBH")
TRACK = "chr string, start long, end long, value double"


def _open(path: str):  # noqa: ANN202
    store, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return store.open_input_file(at)


def _chromosomes(f, at: int) -> dict[int, str]:  # noqa: ANN001
    """Number -> name, from the chromosome tree."""
    magic, _, width, _, _ = struct.unpack("<IIIIQ", f.read_at(24, at))
    if magic != TREE:
        raise ValueError("no chromosome tree")
    names, todo = {}, [at + 32]
    while todo:
        node = todo.pop()
        leaf, _, n = struct.unpack("<BBH", f.read_at(4, node))
        data = f.read_at(n * (width + 8), node + 4)
        for i in range(n):
            item = data[i * (width + 8) : (i + 1) * (width + 8)]
            if leaf:
                names[struct.unpack("<I", item[width : width + 4])[0]] = item[:width].rstrip(b"\0").decode()
            else:
                todo.append(struct.unpack("<Q", item[width:])[0])
    return names


def _header(f) -> tuple[dict[int, str], int, bool]:  # noqa: ANN001
    """Chromosomes, place of the range index, whether blocks are compressed."""
    magic, _, _, tree, _, index, _, _, _, _, buffer = struct.unpack("<IHHQQQHHQQI", f.read_at(56, 0))
    if magic != FILE:
        raise ValueError("not a little-endian bigWig file")
    return _chromosomes(f, tree), index, buffer > 0


def _leaves(f, index: int) -> list[int]:  # noqa: ANN001
    """Places of the index's leaf nodes; only its inner nodes are read."""
    if struct.unpack("<I", f.read_at(4, index))[0] != RANGES:
        raise ValueError("no range index")
    level = [index + 48]
    while level:
        kinds = [f.read_at(4, x) for x in level[:1]]
        if kinds[0][0]:
            return level
        below = []
        for node in level:
            n = struct.unpack("<H", f.read_at(4, node)[2:])[0]
            below += np.frombuffer(f.read_at(24 * n, node + 4), np.dtype([("box", "<u4", 4), ("at", "<u8")]))["at"].tolist()
        level = below
    return []


def section(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Chromosome number, starts, ends and values of one data section."""
    chromosome, start, _, step, span, kind, _, n = _SECTION.unpack_from(data)
    body = data[_SECTION.size :]
    if kind == GRAPH:
        rows = np.frombuffer(body, np.dtype([("start", "<u4"), ("end", "<u4"), ("value", "<f4")]), n)
        return chromosome, rows["start"].astype(np.int64), rows["end"].astype(np.int64), rows["value"].astype(float)
    if kind == VARIABLE:
        rows = np.frombuffer(body, np.dtype([("start", "<u4"), ("value", "<f4")]), n)
        starts = rows["start"].astype(np.int64)
        return chromosome, starts, starts + span, rows["value"].astype(float)
    if kind == FIXED:
        starts = start + step * np.arange(n, dtype=np.int64)
        return chromosome, starts, starts + span, np.frombuffer(body, "<f4", n).astype(float)
    raise ValueError(f"unknown section kind {kind}")


def read_bigwig(spark: SparkSession, path: str, leaves_a_task: int = 16) -> DataFrame:
    """(chr, start, end, value) of all data sections. The driver reads the header, the chromosomes and the index's inner nodes; tasks read leaves and blocks."""
    with _open(path) as f:
        names, index, packed = _header(f)
        leaves = _leaves(f, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _open(path) as f:
            for batch in batches:
                for leaf in batch.column(0).to_pylist():
                    n = struct.unpack("<H", f.read_at(4, leaf)[2:])[0]
                    for at, size in np.frombuffer(f.read_at(32 * n, leaf + 4), np.dtype([("box", "<u4", 4), ("at", "<u8"), ("size", "<u8")]))[["at", "size"]].tolist():
                        data = f.read_at(size, at)
                        number, start, end, value = section(zlib.decompress(data) if packed else data)
                        yield pa.RecordBatch.from_pydict({"chr": pa.array([names[number]] * len(start), pa.string()), "start": start, "end": end, "value": value})

    tasks = max(1, -(-len(leaves) // leaves_a_task))
    return spark.createDataFrame([(x,) for x in leaves], "leaf long").repartition(tasks).mapInArrow(run, TRACK)
