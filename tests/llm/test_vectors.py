"""The adaptive scan: what it reads, and what it finds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlattice.llm import ann


@pytest.mark.parametrize("clusters", [0, 40])
def test_scan_reads_under_half_of_the_probed_coordinates(clusters):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((20_000, 64))
    if clusters:
        x = 0.7 * x + 1.5 * rng.standard_normal((clusters, 64))[rng.integers(0, clusters, len(x))]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, lists, turn = np.arange(len(x)), 141, ann.rotation(64)
    sample = x[rng.permutation(len(x))[:8000]]
    centroids = ann.fit_centroids(sample, lists)
    at = ann.nearest(x, centroids)
    probes = min(lists, ann.calibrate(sample, centroids, 10))
    read = whole = 0
    hits = []
    for q in rng.choice(len(x), 60, replace=False):
        order = np.argsort(0.5 * (centroids**2).sum(1) - x[q] @ centroids.T, kind="stable")[:probes]
        first = max(1, int(ann.FIRST * probes))
        found, bound = [], np.inf
        for part in (order[:first], order[first:]):
            for i in part:
                inside = np.flatnonzero(at == i)
                _, near, d, n = ann.scan(x[[q]], ids[[q]], np.array([bound]), x[inside], ids[inside], turn, 10)
                found += zip(d, near)
                read, whole = read + n, whole + 64 * len(inside)
            found.sort()
            bound = found[9][0]
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits.append(len({i for _, i in found[:10]} & set(np.argsort(d)[:10].tolist())) / 10)
    assert read < (0.6 if clusters else 0.5) * whole and np.mean(hits) >= 0.95


def test_slices_of_vectors_and_queries_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 16)).round(1)
    x[100:200] = x[5]  # a hot list of copies
    d = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = lambda: sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(d, "vec_id % 3 = 0").collect())
    whole = found()
    monkeypatch.setattr(ann, "SLICE_ROWS", 40)
    monkeypatch.setattr(ann, "SLICE_QUERIES", 20)
    sliced = found()
    assert {(q, r) for q, r, *_ in whole} == {(q, r) for q, r, *_ in sliced} == {(q, r) for q in range(0, 300, 3) for r in range(1, 11)}
    same = sum(a == b for a, b in zip(whole, sliced)) / len(whole)
    assert same > 0.9  # runs of candidates differ, so tests near the bound may
    for q, _, i, s in sliced[:200]:
        assert s == pytest.approx(float(np.sqrt(((x[q] - x[i]) ** 2).sum())), abs=1e-12)


def test_lists_grow_with_the_rows(spark):
    assert not hasattr(ann, "MOST_LISTS")
    d = spark.range(50).select(F.col("id").alias("vec_id"), F.array((F.col("id") * 1.0 + 1), F.lit(1.0)).alias("embedding"))
    got = ann.search(d, "vec_id % 10 = 0", k=3).collect()
    assert len(got) == 15 and {r["vec_id"] for r in got if r["query_id"] == 20} == {18, 19, 21}


def test_probes_go_by_the_true_neighbours_of_all_rows(spark):
    rng = np.random.default_rng(9)
    x = np.repeat(rng.standard_normal((400, 16)), 12, axis=0) + 0.01 * rng.standard_normal((4800, 16))
    centroids = ann.fit_centroids(x[::12], 40)
    at = ann.nearest(x, centroids)
    placed = spark.createDataFrame([(i, [float(y) for y in v], int(c)) for i, (v, c) in enumerate(zip(x, at))], "vec_id long, v array<double>, list int").repartition(3)
    queries, ids = x[5:4800:100], np.arange(5, 4800, 100)
    q, lists = ann.true_lists(placed, queries, ids, 10)
    for i, own in enumerate(ids):
        d = ((x - x[own]) ** 2).sum(1)
        d[own] = np.inf
        assert sorted(lists[q == i].tolist()) == sorted(at[np.argsort(d)[:10]].tolist())
    assert ann.probes_for(queries, centroids, q, lists) <= 3 < ann.calibrate(x[::12], centroids, 10)
