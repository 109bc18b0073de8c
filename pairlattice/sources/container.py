"""A matrix set as one indexed container file (format version 9), which matrix viewers open.

Only the file format is here. Tasks encode the blocks; their places are running sums of their sizes, by matrix, so that every piece is written
where it belongs (``placed``); the indexes follow from the places.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlattice.functions.pairs import inter_block, intra_block, log_depth
from pairlattice.operators import binning
from pairlattice.operators.stage import settled
from pairlattice.sources.placed import with_places, write_placed

#: Fixed values of the format: magic, version, unit, entries of a block index.
MAGIC, VERSION, UNIT = b"HIC\0", 9, b"BP\0"
INDEX = np.dtype([("block", "<i4"), ("at", "<i8"), ("size", "<i4")])
#: Fixed values of the block geometry: bins of a block, bases below which bins of one block share bases instead, columns at most.
CAPACITY, FINE_INTRA, FINE_INTER, COLUMNS = 1000, 500, 5000, 46_339
_MATRIX = ("chr1", "chr2")
_ZOOM = ("resolution", *_MATRIX)


def _text(s: str) -> bytes:
    return s.encode() + b"\0"


@dataclass
class Expected:
    """Densities by bin distance at one bin size, and each chromosome's factor; under a vector if a norm is named."""

    resolution: int
    density: np.ndarray
    factors: dict[int, float]
    norm: str = ""

    def packed(self) -> bytes:
        head = (_text(self.norm) if self.norm else b"") + UNIT + struct.pack("<iq", self.resolution, len(self.density))
        return head + self.density.astype("<f4").tobytes() + struct.pack("<i", len(self.factors)) + b"".join(struct.pack("<if", c, f) for c, f in sorted(self.factors.items()))


@dataclass
class Head:
    """What the file's head holds besides the places of its indexes; chromosomes in order, the first being the whole genome in kilobases."""

    genome: str
    chromosomes: Sequence[tuple[str, int]]
    resolutions: Sequence[int]
    attributes: dict[str, str] = field(default_factory=dict)

    def packed(self, master: int, norms: int, norms_size: int) -> bytes:
        out = [MAGIC, struct.pack("<iq", VERSION, master), _text(self.genome), struct.pack("<qq", norms, norms_size), struct.pack("<i", len(self.attributes))]
        out += [_text(k) + _text(v) for k, v in self.attributes.items()]
        out += [struct.pack("<i", len(self.chromosomes)), *(_text(n) + struct.pack("<q", x) for n, x in self.chromosomes)]
        sizes = sorted(self.resolutions, reverse=True)
        return b"".join(out) + struct.pack(f"<i{len(sizes)}ii", len(sizes), *sizes, 0)


def with_blocks(cells: DataFrame, chroms: DataFrame) -> DataFrame:
    """cells with their block, and the geometry of their matrix: columns of blocks and bins of a block; chroms (idx, length) as in the file's head."""
    for i in (1, 2):
        cells = cells.join(F.broadcast(chroms.select(F.col("idx").alias(f"chr{i}"), F.col("length").alias(f"len{i}"))), f"chr{i}")
    intra = F.col("chr1") == F.col("chr2")
    bins = F.expr("greatest(len1, len2) div resolution + 1")
    fine = F.when(intra, FINE_INTRA).otherwise(FINE_INTER)
    by_bins, by_bases = F.floor(bins / CAPACITY) + 1, F.floor(bins * F.col("resolution") / (fine * CAPACITY)) + 1
    columns = F.least(F.when((F.col("resolution") >= fine) | (F.col("chr1") == 0), by_bins).otherwise(by_bases), F.lit(COLUMNS))
    cells = cells.withColumn("columns", columns.cast("long")).withColumn("block_bins", (F.floor(bins / F.col("columns")) + 1).cast("long"))
    x, y, c, b = (F.col(k) for k in ("x", "y", "columns", "block_bins"))
    block: Column = F.when(intra, intra_block(log_depth(x, y, b), x, y, c, b)).otherwise(inter_block(x, y, c, b))
    return cells.withColumn("block", block.cast("int")).drop("len1", "len2")


def packed_block(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> bytes:
    """A block's cells as rows of bins: counts as int16 where all are whole and small, else as floats; bins as int16 where they fit."""
    order = np.lexsort((x, y))
    x, y, n = x[order], y[order], n[order]
    dx, dy = x - x.min(), y - y.min()
    small = bool((np.floor(n) == n).all() and n.max() < 32767 and n.min() >= 0)
    kinds = [small, bool(dx.max() + 1 < 32767), bool(dy.max() + 1 < 32767)]
    of_x, of_y = ("<i2" if k else "<i4" for k in kinds[1:])
    cells = np.zeros(len(n), np.dtype([("x", of_x), ("n", "<i2" if small else "<f4")]))
    cells["x"], cells["n"] = dx, n
    first = np.flatnonzero(np.diff(dy, prepend=-1))
    ends = np.append(first[1:], len(n))
    out = [struct.pack("<iii", len(n), x.min(), y.min()), bytes(0 if k else 1 for k in kinds), b"\1", np.array(len(first), of_y).tobytes()]
    for a, b in zip(first, ends):
        out += [np.array(dy[a], of_y).tobytes(), np.array(b - a, of_x).tobytes(), cells[a:b].tobytes()]
    return zlib.compress(b"".join(out))


def _blocks(cells: DataFrame) -> DataFrame:
    """(resolution, chr1, chr2, block, content, size): a row per block, encoded where its cells are brought together."""

    def one(key: tuple, group: pa.Table) -> pa.Table:
        x, y, n = (group.column(c).to_numpy() for c in ("x", "y", "n"))
        content = packed_block(x, y, n)
        keys = {name: pa.array([k.as_py()], pa.int32()) for name, k in zip((*_ZOOM, "block"), key)}
        return pa.table(keys | {"columns": pa.array([group.column("columns")[0].as_py()], pa.int64()), "block_bins": pa.array([group.column("block_bins")[0].as_py()], pa.int64()), "content": pa.array([content], pa.binary()), "size": pa.array([len(content)], pa.int64())})

    keys = [F.col(c).cast("int").alias(c) for c in (*_ZOOM, "block")]
    chosen = cells.select(*keys, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("n").cast("double").alias("n"), "columns", "block_bins")
    return chosen.groupBy(*_ZOOM, "block").applyInArrow(one, "resolution int, chr1 int, chr2 int, block int, columns long, block_bins long, content binary, size long")


def _matrix_heads() -> Callable:
    """A matrix's head: its bin sizes, coarse to fine, each with its sums, geometry and block index."""

    def one(key: tuple, group: pa.Table) -> pa.Table:
        at, rows = group.column("head_at")[0].as_py(), group.to_pandas().sort_values(["part", "block"])
        zooms = [part for _, part in rows.groupby("part")]
        out = [struct.pack("<iii", key[0].as_py(), key[1].as_py(), len(zooms))]
        for z in zooms:
            r, index = z.iloc[0], np.zeros(len(z), INDEX)
            for c in INDEX.names:
                index[c] = z[c]
            out += [UNIT, struct.pack("<iffffiiii", int(r["part"]) - 1, r["total"], r["occupied"], r["p5"], r["p95"], *(int(r[c]) for c in ("resolution", "block_bins", "columns")), len(z)), index.tobytes()]
        return pa.table({"chr1": pa.array([key[0].as_py()], pa.int32()), "chr2": pa.array([key[1].as_py()], pa.int32()), "at": pa.array([at], pa.int64()), "content": pa.array([b"".join(out)], pa.binary())})

    return one


def _vectors(norms: DataFrame) -> DataFrame:
    """(norm, resolution, chr, content, size): each vector's values from its first bin on; bins without one are NaN."""

    def one(key: tuple, group: pa.Table) -> pa.Table:
        norm, resolution, chr_ = (k.as_py() for k in key)
        values = np.full(group.column("bin").to_numpy().max() + 1, np.nan, "<f4")
        values[group.column("bin").to_numpy()] = group.column("v").to_numpy(zero_copy_only=False)
        content = struct.pack("<q", len(values)) + values.tobytes()
        return pa.table({"norm": [norm], "resolution": pa.array([resolution], pa.int32()), "chr": pa.array([chr_], pa.int32()), "content": pa.array([content], pa.binary()), "size": pa.array([len(content)], pa.int64())})

    return norms.select("norm", F.col("resolution").cast("int"), F.col("chr").cast("int"), F.col("bin").cast("long"), F.col("v").cast("double")).groupBy("norm", "resolution", "chr").applyInArrow(one, "norm string, resolution int, chr int, content binary, size long")


def write_container(path: str, head: Head, cells: DataFrame, expected: Sequence[Expected] = (), norms: DataFrame | None = None) -> None:
    """cells (resolution, chr1, chr2, x, y, n), with the whole genome's as matrix (0, 0), as one file on a path that all executors reach.

    Reaching the driver: a row per matrix and per vector, for the indexes, and the expected densities, of a value per bin distance.
    """
    spark = cells.sparkSession
    chroms = spark.createDataFrame([(i, n) for i, (_, n) in enumerate(head.chromosomes)], "idx int, length long")
    order = {r: i for i, r in enumerate(sorted(head.resolutions, reverse=True))}
    part = F.when(F.col("chr1") == 0, 1).otherwise(F.coalesce(*[F.when(F.col("resolution") == r, i + 1) for r, i in order.items()])).cast("int")
    cells = cells.filter((F.col("chr1") == 0) | F.col("resolution").isin(*order))
    blocks = settled(_blocks(with_blocks(cells, chroms)).withColumn("part", part))
    slice_ = (F.col("chr1").cast("long") * (1 << 31) + F.col("chr2")).alias("slice")
    fixed = len(UNIT) + struct.calcsize("<iffffiiii")
    heads = blocks.groupBy(*_MATRIX).agg((F.lit(12) + fixed * F.count_distinct("part") + INDEX.itemsize * F.count("*")).alias("size"))
    sizes = blocks.select(*_MATRIX, "part", "block", "size", slice_).unionByName(heads.select(*_MATRIX, F.lit(0).alias("part"), F.lit(-1).alias("block"), "size", slice_))
    start = len(head.packed(0, 0, 0))
    placed, master = with_places(sizes, ["part", "block"], start)
    placed = settled(placed.drop("slice"))
    stats = binning.totals(cells).select(F.col("resolution").cast("int"), F.col("chr1").cast("int"), F.col("chr2").cast("int"), "total", "occupied", "p5", "p95")
    at_head = placed.filter("part = 0").select(*_MATRIX, F.col("at").alias("head_at"))
    rows = blocks.drop("content", "size").join(placed, [*_MATRIX, "part", "block"]).join(stats, list(_ZOOM)).join(at_head, list(_MATRIX))
    matrix_heads = settled(rows.groupBy(*_MATRIX).applyInArrow(_matrix_heads(), "chr1 int, chr2 int, at long, content binary"))
    index = matrix_heads.select(*_MATRIX, "at", F.octet_length("content").alias("size")).orderBy("at").collect()
    raw, normed = [e for e in expected if not e.norm], [e for e in expected if e.norm]
    first = struct.pack("<i", len(index)) + b"".join(_text(f"{r['chr1']}_{r['chr2']}") + struct.pack("<qi", r["at"], r["size"]) for r in index)
    first += struct.pack("<i", len(raw)) + b"".join(e.packed() for e in raw)
    footer = struct.pack("<q", len(first)) + first + struct.pack("<i", len(normed)) + b"".join(e.packed() for e in normed)
    pieces = blocks.select(*_MATRIX, "part", "block", "content").join(placed.select(*_MATRIX, "part", "block", "at"), [*_MATRIX, "part", "block"]).select("at", "content").unionByName(matrix_heads.select("at", "content"))
    nvi, nvi_size, end = 0, 0, master + len(footer)
    if norms is not None:
        vectors = settled(_vectors(norms))
        nvi = end
        known = vectors.select("norm", "resolution", "chr", "size").orderBy("norm", "resolution", "chr").collect()
        nvi_size = 4 + sum(len(_text(r["norm"])) + 4 + len(UNIT) + 4 + 16 for r in known)
        spots, end = with_places(vectors.select("norm", "resolution", "chr", "size", F.col("chr").alias("slice")), ["norm", "resolution"], nvi + nvi_size)
        spots = settled(spots)
        entries = spots.orderBy("norm", "resolution", "chr").collect()
        footer += struct.pack("<i", len(entries)) + b"".join(_text(r["norm"]) + struct.pack("<i", r["chr"]) + UNIT + struct.pack("<iqq", r["resolution"], r["at"], r["size"]) for r in entries)
        pieces = pieces.unionByName(vectors.join(spots.select("norm", "resolution", "chr", "at"), ["norm", "resolution", "chr"]).select("at", "content"))
    ends = spark.createDataFrame([(0, bytearray(head.packed(master, nvi, nvi_size))), (master, bytearray(footer))], "at long, content binary")
    write_placed(pieces.unionByName(ends), path, end)
