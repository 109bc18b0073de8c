"""Approximate nearest neighbours: inverted lists scanned dimension block by dimension block.

Index: k-means centroids are fitted on a bounded sample (``SAMPLE`` rows or ``PER_LIST`` a list, the least hashes of
vec_id; a model only, every row is indexed); there are as many lists as the root of the number of rows. Each
vector goes to its nearest centroid's list. A list is dealt in slices by
hash, so that one that holds any part of the rows is many tasks' work; so are the queries that probe it.

Search: a query probes the lists of its nearest centroids, as many as found ``RECALL`` of the
true neighbours, among all rows, of ``PROBED_QUERIES`` sample rows (``true_lists``), more if they hold under ``REACH``
rows. Data without clusters thus probe many lists, clustered data few. The lists are scanned nearest first, in
two rounds: the nearest ones, with ``FIRST`` of the rows to be probed, give each query a k-th distance that
it carries to its other lists. In each slice the queries that probe it meet its
vectors, randomly rotated and in column blocks: coordinates are added block by block, and after each block a candidate is
dropped if its partial squared distance is too large for one within the current k-th distance r: of a vector at
distance r, b of d rotated coordinates hold a share of r^2 with mean b/d and variance
2b(d-b) / (d^2 (d+2)), so the hypothesis that the candidate is nearer is rejected above the mean plus
``EPSILON`` deviations. What stays gets its exact distance in double precision from the
original vectors. The k best of each slice meet in one ranking per query.

Defined cases: vectors that are null, zero, of another length than the most common, or that
hold null or non-finite components take no part, nor do rows without a vec_id; repeated vec_ids are separate candidates,
and a query's own vec_id is none; ties go to the smaller vec_id; fewer candidates than k
are all returned (then all lists are probed); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlattice.llm.common import written

K = 10
#: Rows of the sample, or so many a list where there are more lists; centroids and sample grow as the root of the rows.
SAMPLE, PER_LIST, ROUNDS, SEED = 20_000, 8, 12, 7
REACH, RECALL, PROBED_QUERIES, FIRST = 500, 0.985, 400, 0.1
#: Vectors and queries that meet in one task, coordinates in a block, deviations of the test.
SLICE_ROWS, SLICE_QUERIES, BLOCK, EPSILON = 20_000, 2_000, 8, 2.0


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector as doubles, without rows that take no part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.filter(F.coalesce(fine, F.lit(False)))
    common = v.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    return v.filter(F.size("v") == (common["n"] if common else 0))


def fit_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Lloyd's rounds from spread-out starts; the sample is bounded."""
    rng = np.random.default_rng(SEED)
    distinct = np.unique(sample, axis=0)
    c = distinct[rng.permutation(len(distinct))[:lists]]
    for _ in range(ROUNDS):
        at = nearest(sample, c)
        n = np.bincount(at, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, at, sample)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(1)
    return np.concatenate([np.argmin(half - x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, int)


def calibrate(sample: np.ndarray, centroids: np.ndarray, k: int) -> int:
    """Lists to probe: so many that RECALL of the true k nearest of some sample rows, within the sample, lie in them."""
    at = nearest(sample, centroids)
    queries = sample[:PROBED_QUERIES]
    place = np.argsort(np.argsort(0.5 * (centroids * centroids).sum(1) - queries @ centroids.T, axis=1, kind="stable"), axis=1)
    half = 0.5 * (sample * sample).sum(1)
    ranks = []
    for i, q in enumerate(queries):
        d = half - sample @ q
        d[i] = np.inf
        ranks.append(place[i][at[np.argpartition(d, min(k, len(d) - 1))[:k]]])
    return int(np.quantile(np.concatenate(ranks), RECALL, method="higher")) + 1


def true_lists(placed: DataFrame, queries: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query numbers, lists): the lists of the true k nearest of these few queries among all rows of placed (vec_id, v, list), by brute force in Spark."""
    sent = placed.sparkSession.sparkContext.broadcast((queries, query_ids, (queries * queries).sum(1)))

    def nearest_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, ids, size = sent.value
        best_d, best_l, best_i = np.empty((len(q), 0)), np.empty((len(q), 0), np.int32), np.empty((len(q), 0), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x, own = _matrix(part.column(1)), part.column(0).to_numpy()
                d = size[:, None] - 2 * q @ x.T + (x * x).sum(1)
                d[ids[:, None] == own] = np.inf
                d = np.concatenate((best_d, d), axis=1)
                keep = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
                wide = lambda old, new: np.take_along_axis(np.concatenate((old, np.broadcast_to(new, (len(q), len(new)))), axis=1), keep, axis=1)  # noqa: E731, B023
                best_d, best_l, best_i = np.take_along_axis(d, keep, axis=1), wide(best_l, part.column(2).to_numpy()), wide(best_i, own)
        n = np.isfinite(best_d)
        yield pa.RecordBatch.from_pydict({"q": np.nonzero(n)[0].astype(np.int32), "d": best_d[n], "vec_id": best_i[n], "list": best_l[n]})

    found = placed.select("vec_id", "v", "list").mapInArrow(nearest_of_each, "q int, d double, vec_id long, list int")
    rank = F.row_number().over(W.partitionBy("q").orderBy("d", "vec_id"))
    rows = found.withColumn("rank", rank).filter(F.col("rank") <= k).select("q", "list").toArrow()  # k rows a query
    return rows["q"].to_numpy(), rows["list"].to_numpy()


def probes_for(queries: np.ndarray, centroids: np.ndarray, at: np.ndarray, lists: np.ndarray) -> int:
    """Lists to probe: so many that RECALL of the queries' true neighbours, by query number and list, lie in them."""
    place = np.argsort(np.argsort(0.5 * (centroids * centroids).sum(1) - queries @ centroids.T, axis=1, kind="stable"), axis=1)
    return int(np.quantile(place[at, lists], RECALL, method="higher")) + 1 if len(at) else 1


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def scan(queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, base: np.ndarray, base_ids: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(queries, candidates, distances) of each query's k nearest in one slice that are within its bound, by the adaptive scan; and the coordinates read."""
    dim = base.shape[1]
    cuts = [*range(0, dim, BLOCK), dim]
    columns = [np.ascontiguousarray((base @ turn)[:, a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    limits = [b / dim + EPSILON * np.sqrt(2 * b * (dim - b) / (dim + 2)) / dim for b in cuts[1:]]
    turned = queries @ turn
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    read = 0
    for qi, qid in enumerate(query_ids):
        own = np.flatnonzero(base_ids != qid)
        best_d, best_i = np.empty(0), np.empty(0, int)
        # growing runs of candidates, so that the tests soon have a bound where none is carried
        at, step = 0, max(32, 2 * k)
        while at < len(own):
            cand = own[at : at + step]
            at, step = at + step, step * 4
            bound = min(bounds[qi], best_d[-1] if len(best_d) >= k else np.inf)
            part = np.zeros(len(cand))
            for col, limit, a, b in zip(columns, limits, cuts, cuts[1:], strict=False):
                read += len(cand) * (b - a)
                diff = col[cand] - turned[qi, a:b]
                part += np.einsum("ij,ij->i", diff, diff)
                if np.isfinite(bound) and b < dim:
                    # a margin for rounding keeps candidates at exactly the bound
                    go = part <= limit * bound * bound * (1 + 1e-9) + 1e-18
                    cand, part = cand[go], part[go]
                    if not len(cand):
                        break
            if not len(cand):
                continue
            diff = base[cand] - queries[qi]
            d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            best_d, best_i = np.concatenate((best_d, d)), np.concatenate((best_i, cand))
            keep = np.lexsort((base_ids[best_i], best_d))[:k]
            best_d, best_i = best_d[keep], best_i[keep]
        near = best_d <= bounds[qi]
        out.append((np.full(near.sum(), qid, np.int64), base_ids[best_i[near]], best_d[near]))
    found = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    return found[0], found[1], found[2], read


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 1))


_FOUND = "query_id long, vec_id long, score double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: str = "vec_id % 100 = 0", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that is_query selects."""
    spark = vectors.sparkSession
    rows = written(usable(vectors))
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = max(1, int(np.sqrt(total)))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(SAMPLE, PER_LIST * lists)).select("vec_id", "v").toArrow()
    sample, sample_ids = _matrix(chosen["v"]), chosen["vec_id"].to_numpy()
    turn = rotation(sample.shape[1])
    centroids = fit_centroids(sample, lists)
    model = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nearest(_matrix(b.column(1)), model.value), pa.int32())], ["vec_id", "v", "list"])

    placed = written(rows.mapInArrow(assign, "vec_id long, v array<double>, list int"))
    few = sample[:PROBED_QUERIES]
    probes = probes_for(few, centroids, *true_lists(placed, few, sample_ids[:PROBED_QUERIES], k))
    sizes = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    held_by = spark.sparkContext.broadcast(np.array([sizes.get(i, 0) for i in range(len(centroids))]))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per list that a query probes; round 0 are the nearest lists."""
        c, n = model.value, held_by.value
        half = 0.5 * (c * c).sum(1)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # a block of rows by lists at a time
                b = batch.slice(start, 256)
                order = np.argsort(half - _matrix(b.column(1)) @ c.T, axis=1, kind="stable")
                held = np.cumsum(n[order], axis=1)
                need = np.minimum(np.maximum((held < max(REACH, 4 * k)).sum(1) + 1, probes), len(c))
                first = np.maximum(4 * k, FIRST * held[np.arange(len(held)), need - 1])
                place = np.arange(len(c))
                at, column = np.nonzero((place < need[:, None]) & (n[order] > 0))
                late = column > 0
                late &= held[at, column - 1] >= first[at]
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(order[at, column], pa.int32()), pa.array(late.astype(np.int32))], ["query_id", "q", "list", "round"])

    asked = written(rows.filter(is_query).mapInArrow(probe, "query_id long, q array<double>, list int, round int"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            q, i, d, _ = scan(_matrix(left["q"]), left["query_id"].to_numpy(), left["bound"].to_numpy(), _matrix(right["v"]), right["vec_id"].to_numpy(), turn, k)
        else:
            q, i, d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        return pa.table({"query_id": q, "vec_id": i, "score": d})

    def scanned(queries: DataFrame) -> DataFrame:
        """What queries (query_id, q, list, bound) find. Their lists' vectors are dealt in slices, the queries too, and every slice meets every other."""
        asking = {r["list"]: r["n"] for r in queries.groupBy("list").agg(F.count("*").alias("n")).collect()}
        parts = [(i, -(-sizes[i] // SLICE_ROWS), -(-n // SLICE_QUERIES)) for i, n in asking.items()]
        if not parts:
            return spark.createDataFrame([], _FOUND)
        # a row per list that is asked: as many as the root of all rows at most
        deal = F.broadcast(spark.createDataFrame(parts, "list int, slices int, query_slices int"))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        mine = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        q = queries.join(deal, "list").select("list", mine("query_id", "query_slices").alias("b"), each("slices").alias("a"), "query_id", "q", "bound")
        x = placed.join(deal, "list").select("list", mine("vec_id", "slices").alias("a"), each("query_slices").alias("b"), "vec_id", "v")
        keys = ("list", "a", "b")
        return q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInArrow(meet, _FOUND)

    near = written(_ranked(scanned(asked.filter("round = 0").withColumn("bound", F.lit(float("inf")))), k))
    reached = near.filter(F.col("rank") == k).select("query_id", F.col("score").alias("bound")).distinct()
    far = scanned(asked.filter("round = 1").join(reached, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))))
    return _ranked(near.drop("rank").unionByName(far), k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
