"""Correlation matrix of observed over expected, and its first eigenvector."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlattice.operators.balance import spark_product
from pairlattice.operators.stage import settled

#: Bins of a matrix that one task holds densely; of larger ones correlations come from products of tiles, and eigenvectors from Spark products.
MOST_BINS = 6000
#: Rows and columns of a tile.
TILE = 1024
#: Vectors of the eigenvector's Krylov basis at most, those a restart keeps, and the relative residual at which it ends.
BASIS, KEPT, RESIDUAL = 40, 8, 1e-10
#: Bin sizes below this are refused unless asked for (fixed value).
FINEST = 50_000


def check_resolution(resolution: int, finest: int = FINEST) -> int:
    if resolution < finest:
        raise ValueError(f"bin size {resolution} is below {finest}")
    return resolution


def _dense(pdf: pd.DataFrame, value: str) -> np.ndarray:
    size = int(pdf[["x", "y"]].to_numpy().max()) + 1
    m = np.zeros((size, size))
    m[pdf["x"], pdf["y"]] = m[pdf["y"], pdf["x"]] = pdf[value].to_numpy()
    return m


def _correlation(m: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.corrcoef(m)


def _by_size(cells: DataFrame) -> tuple[DataFrame, list[tuple[DataFrame, int]]]:
    """Cells of the matrices that a task holds, and those of each larger one with its number of bins; a row per matrix reaches the driver."""
    sizes = cells.groupBy("resolution", "chr").agg((F.max(F.greatest("x", "y")) + 1).alias("size")).filter(F.col("size") > MOST_BINS).collect()
    of = lambda r: (F.col("resolution") == r["resolution"]) & (F.col("chr") == r["chr"])
    small = cells
    for r in sizes:
        small = small.filter(~of(r))
    return small, [(cells.filter(of(r)), r["size"]) for r in sizes]


def pearson(cells: DataFrame, value: str = "oe") -> DataFrame:
    """(resolution, chr, x, y, r) for x <= y: correlation of matrix rows, absent cells being 0; NaN rows are left out."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r = _correlation(_dense(pdf, value))
        x, y = np.triu_indices(len(r))
        keep = ~np.isnan(r[x, y])
        return pd.DataFrame({"resolution": pdf["resolution"].iloc[0], "chr": pdf["chr"].iloc[0], "x": x[keep], "y": y[keep], "r": r[x, y][keep]})

    small, large = _by_size(cells)
    out = small.groupBy("resolution", "chr").applyInPandas(one, "resolution int, chr int, x long, y long, r double")
    for part, size in large:
        key = part.select(F.col("resolution").cast("int"), F.col("chr").cast("int")).first()
        out = out.unionByName(pearson_by_tiles(part, value, size).select(F.lit(key[0]).cast("int").alias("resolution"), F.lit(key[1]).cast("int").alias("chr"), "x", "y", "r"))
    return out


def eigenvector(cells: DataFrame, value: str = "oe") -> DataFrame:
    """(resolution, chr, bin, v, residual): first eigenvector of the correlation matrix, centred; its largest entry is positive; null for rows without a correlation.

    The residual is |C w - l w| / l of the vector before it was centred.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r = _correlation(_dense(pdf, value))
        good = ~np.isnan(r).all(axis=1)
        v, residual = np.full(len(r), np.nan), np.nan
        if good.any():
            c = r[np.ix_(good, good)]
            values, vectors = np.linalg.eigh(c)
            residual = np.linalg.norm(c @ vectors[:, -1] - values[-1] * vectors[:, -1]) / values[-1]
            v[good] = _oriented(vectors[:, -1])
        return pd.DataFrame({"resolution": pdf["resolution"].iloc[0], "chr": pdf["chr"].iloc[0], "bin": np.arange(len(v)), "v": v, "residual": residual})

    small, large = _by_size(cells)
    schema = "resolution int, chr int, bin long, v double, residual double"
    out = small.groupBy("resolution", "chr").applyInPandas(one, schema)
    for part, size in large:
        key = part.select("resolution", "chr").first()
        v, residual = eigenvector_by_products(part.select("x", "y", F.col(value).cast("double").alias("n")), size)
        frame = pd.DataFrame({"resolution": int(key["resolution"]), "chr": int(key["chr"]), "bin": np.arange(size), "v": v, "residual": residual})
        out = out.unionByName(cells.sparkSession.createDataFrame(frame, schema).withColumn("v", F.nanvl("v", F.lit(None).cast("double"))))
    return out


def _oriented(w: np.ndarray) -> np.ndarray:
    w = w * np.sign(w[np.argmax(np.abs(w))])
    return w - w.mean()


def first_eigenvector(times: Callable[[np.ndarray], np.ndarray], start: np.ndarray) -> tuple[np.ndarray, float]:
    """Eigenvector of the largest eigenvalue of a symmetric matrix given by its product, with its relative residual: Lanczos steps with thick restarts.

    A basis of BASIS vectors is cut down to the KEPT best approximations and the direction that is
    left, and grows again, until the residual is below RESIDUAL. There is no cap on the steps; an error is raised
    where restarts no longer lessen the residual.
    """
    basis, h = [start / np.linalg.norm(start)], np.zeros((BASIS + 1, BASIS + 1))
    ends: list[float] = []
    while True:
        w, k = times(basis[-1]), len(basis)
        known = np.array(basis)
        h[:k, k - 1] = h[k - 1, :k] = known @ w
        for _ in range(2):
            w = w - known.T @ (known @ w)
        left = float(np.linalg.norm(w))
        values, vectors = np.linalg.eigh(h[:k, :k])
        residual = left * abs(vectors[-1, -1]) / max(values[-1], 1e-300)
        if residual <= RESIDUAL or left <= 1e-14 * max(values[-1], 1e-300):
            return vectors[:, -1] @ known, residual
        if k == BASIS:
            ends.append(residual)
            if len(ends) > 20 and min(ends[-10:]) >= min(ends[:-10]):
                raise ArithmeticError(f"the eigenvector does not settle: relative residual {min(ends):.3g}")
            basis = list(vectors[:, -KEPT:].T @ known)
            h[:] = 0.0
            h[range(KEPT), range(KEPT)] = values[-KEPT:]
        basis.append(w / left)


def eigenvector_by_products(cells: DataFrame, size: int) -> tuple[np.ndarray, float]:
    """The same vector and residual of one matrix (x, y, n) without its correlations: every step takes two Spark products with the cells.

    With row sums s, sums of squares q and d = sqrt(q - s^2 / m) the correlation matrix is D (A A - s s^T / m) D, D = 1 / d;
    A A v is two products. BASIS vectors of one double a bin are on the driver at most, orthogonalised against each other.
    """
    cells = settled(cells)
    product, m = spark_product(cells, size), float(size)
    s, q = product(np.ones(size)), spark_product(cells.withColumn("n", F.col("n") * F.col("n")), size)(np.ones(size))
    spread = q - s * s / m
    good = spread > 1e-12 * np.maximum(q, 1e-300)
    out = np.full(size, np.nan)
    if not good.any():
        return out, float("nan")
    scale = np.where(good, 1.0 / np.sqrt(np.where(good, spread, 1.0)), 0.0)

    def times(v: np.ndarray) -> np.ndarray:
        u = scale * v
        return scale * (product(product(u)) - s * (s @ u) / m)

    v, residual = first_eigenvector(times, np.where(good, np.cos(np.arange(size) * 0.7) + 0.5, 0.0))
    out[good] = _oriented(v[good])
    return out, residual


def _pack(side: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """One tile's cells as bytes: places in the tile as int32, values as doubles."""

    def one(key: tuple, cells: pa.Table) -> pa.Table:
        i, k = (x.as_py() for x in key)
        x, y, v = (cells.column(c).to_numpy() for c in ("x", "y", "v"))
        at = ((x - i * side) * side + y - k * side).astype("<i4")
        return pa.table({"i": pa.array([i], pa.int64()), "k": pa.array([k], pa.int64()), "tile": pa.array([zlib.compress(at.tobytes() + v.astype("<f8").tobytes(), 1)], pa.binary())})

    return one


def _unpacked(data: bytes, side: int) -> np.ndarray:
    raw = zlib.decompress(data)
    n = len(raw) // 12
    tile = np.zeros(side * side)
    tile[np.frombuffer(raw, "<i4", n)] = np.frombuffer(raw, "<f8", n, 4 * n)
    return tile.reshape(side, side)


class _Block:
    """Correlations of the rows of block p with those of block q, added up from the tiles of both, column block by column block."""

    def __init__(self, p: int, q: int, side: int) -> None:
        self.p, self.q, self.side, self.k, self.held = p, q, side, -1, {}
        self.product = np.zeros((side, side))
        self.sums = {i: [np.zeros(side), np.zeros(side)] for i in {p, q}}

    def add(self, i: int, k: int, tile: np.ndarray) -> None:
        if k != self.k:
            self.k, self.held = k, {}
        self.held[i] = tile
        self.sums[i][0] += tile.sum(axis=1)
        self.sums[i][1] += (tile * tile).sum(axis=1)
        if self.p in self.held and self.q in self.held:
            self.product += self.held[self.p] @ self.held[self.q].T

    def rows(self, m: float) -> Iterator[pa.RecordBatch]:
        """(x, y, r) for x <= y, some rows of the block at a time."""
        spread = {i: m * q - s * s for i, (s, q) in self.sums.items()}
        good = {i: spread[i] > 1e-12 * m * self.sums[i][1] for i in spread}
        y = np.flatnonzero(good[self.q])
        for first in range(0, self.side, 64):
            x = first + np.flatnonzero(good[self.p][first : first + 64])
            r = (m * self.product[np.ix_(x, y)] - np.outer(self.sums[self.p][0][x], self.sums[self.q][0][y])) / np.sqrt(np.outer(spread[self.p][x], spread[self.q][y]))
            u, v = np.meshgrid(x + self.p * self.side, y + self.q * self.side, indexing="ij")
            keep = u <= v
            if keep.any():
                yield pa.RecordBatch.from_pydict({"x": u[keep], "y": v[keep], "r": r[keep]})


def pearson_by_tiles(cells: DataFrame, value: str, n_bins: int, tile: int = TILE) -> DataFrame:
    """(x, y, r): the same correlations of one matrix with more bins than a task should hold, from a product of its tiles.

    Cells are packed into square tiles once. The tile (i, k) is dealt to every pair of row blocks that i is part
    of; a pair's tiles come in order of k, so a task holds one product and two tiles, multiplies them and
    adds them up. Row sums and squares of both blocks come from the same tiles. Absent cells are 0.
    """
    blocks = -(-n_bins // tile)
    half = lambda a, b: cells.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y"), F.col(value).cast("double").alias("v"))
    full = half("x", "y").unionByName(half("y", "x").filter("x <> y"))
    tiles = settled(full.groupBy(F.expr(f"x div {tile}").alias("i"), F.expr(f"y div {tile}").alias("k")).applyInArrow(_pack(tile), "i long, k long, tile binary"))
    dealt = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))).select(F.least("i", "other").alias("p"), F.greatest("i", "other").alias("q"), "k", "i", "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for p, q, k, i, data in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4)):
                if block is None or (block.p, block.q) != (p, q):
                    if block is not None:
                        yield from block.rows(float(n_bins))
                    block = _Block(p, q, tile)
                block.add(i, k, _unpacked(data.as_py(), tile))
        if block is not None:
            yield from block.rows(float(n_bins))

    parts = max(1, min(blocks * (blocks + 1) // 2, 20_000))
    return dealt.repartition(parts, "p", "q").sortWithinPartitions("p", "q", "k").mapInArrow(run, "x long, y long, r double")
