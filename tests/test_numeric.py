"""Balancing, smoothing and correlation against straight-line restatements and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlattice.operators import balance, binning, corr, expected, norms, rows
from pairlattice.plans.fixture import chroms, pairs

SF = "/root/testdata/sf0.001"


def matrix(core, pend):
    cells = {}
    for i in range(core):
        for s in range(6):
            j = (i + s * s) % core
            cells[min(i, j), max(i, j)] = 1 + (i * 7 + s) % 11
    for k in range(pend):
        cells[0, core + k] = 5
    x, y = np.array([k[0] for k in cells]), np.array([k[1] for k in cells])
    return x, y, np.array(list(cells.values()), float), core + pend


@pytest.mark.parametrize("core,pend,steps,cutoff,upper,excluded,solved", [(100, 0, 6, 1, 11, 0, True), (100, 5, 13, 2, 11, 5, True), (100, 9, 13, 2, 11, 9, True), (100, 30, 7, 2, 1, 30, False)])
def test_balancing_course_on_built_matrices(core, pend, steps, cutoff, upper, excluded, solved):
    x, y, n, size = matrix(core, pend)
    out = balance.balance(balance.symmetric_product(x, y, n, size), balance.nonzeros(x, y, size))
    assert (out.steps, out.cutoff, out.upper, out.vector is not None) == (steps, cutoff, upper, solved)
    if solved:
        assert out.excluded == excluded
        good = ~np.isnan(out.vector)
        v = np.where(good, out.vector, 0)
        sums = balance.symmetric_product(x, y, n, size)(v) * v
        assert np.allclose(sums[good], 1, atol=2e-3)


def test_empty_matrix_has_no_vector():
    none = np.empty(0, int)
    assert balance.balance(balance.symmetric_product(none, none, np.empty(0), 3), np.zeros(3, int)).vector is None


def test_distributed_balancing_equals_the_one_task_form(spark):
    x, y, n, size = matrix(60, 4)
    cells = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(x, y, n)], "x long, y long, n double").repartition(3)
    near = balance.balance(balance.symmetric_product(x, y, n, size), balance.nonzeros(x, y, size))
    far = balance.balance_distributed(cells, size)
    assert far.steps == near.steps and np.allclose(far.vector, near.vector, equal_nan=True)


def test_scaled_rows_are_even(spark):
    c = rows.intra_cells(binning.bin_pairs(pairs(spark, SF).filter("chr1 = chr2"), 1_000_000)).persist()
    v = norms.scale(c, chroms(spark), (1_000_000,))
    for _, g in rows.row_sums(rows.normalized(c, v)).toPandas().groupby("chr"):
        assert g["v"].std() / g["v"].mean() < 0.05


def smooth_slowly(observed, possible):
    n, top = len(possible) - 1, len(possible) - 1
    lo = hi = 0
    num, den, out = observed[0], possible[0], []
    for _ in range(n):
        if num < 400:
            while num < 400 and hi < top:
                hi += 1
                num, den = num + observed[hi], den + possible[hi]
        else:
            while hi > lo and num - observed[lo] - observed[hi] >= 400:
                num, den = num - observed[lo] - observed[hi], den - possible[lo] - possible[hi]
                lo, hi = lo + 1, hi - 1
        out.append(num / den)
        for _ in range(2):
            if hi + 1 < n:
                hi += 1
                num, den = num + observed[hi], den + possible[hi]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_smoothing_equals_the_step_by_step_form(seed):
    rng = np.random.default_rng(seed)
    n = 60
    observed = rng.integers(0, 900, n + 1).astype(float) * (rng.random(n + 1) < 0.6) / (1 + seed * 3)
    possible = np.append(np.arange(n, 0, -1.0), 0)
    assert np.allclose(expected.smooth(observed, possible), smooth_slowly(observed, possible))


def test_expected_totals_meet_observed(spark):
    c = rows.intra_cells(binning.bin_pairs(pairs(spark, SF).filter("chr1 = chr2"), 500_000))
    density = expected.smoothed_density(expected.distance_histogram(c), expected.possible_distances(chroms(spark), 500_000))
    factors = expected.chromosome_factors(density, chroms(spark), expected.chromosome_totals(c))
    total = density.crossJoin(factors.select("chr", "factor")).groupBy("chr").agg(F.sum((16 - F.col("dist")) * F.col("density") / F.col("factor")).alias("t"))
    seen = {r["chr"]: r["observed"] for r in expected.chromosome_totals(c).collect()}
    assert all(abs(r["t"] - seen[r["chr"]]) < 1e-6 * seen[r["chr"]] for r in total.collect())


def test_large_matrices_of_a_chromosome_are_balanced_by_products(spark, monkeypatch):
    x, y, n, _ = matrix(100, 5)
    cells = spark.createDataFrame([(1, 1, int(a), int(b), float(v)) for a, b, v in zip(x, y, n)], "resolution int, chr int, x long, y long, n double")
    sizes = spark.createDataFrame([(1, 104)], "idx int, length long")
    vector = lambda: {r["bin"]: r["v"] for r in norms.scale(cells, sizes, (1,)).collect()}
    want = vector()
    monkeypatch.setattr(balance, "CELLS_IN_TASK", 100)
    monkeypatch.setattr(norms, "scale_vectors", lambda part, b: balance.scale_vectors(part.filter(F.lit(part.isEmpty())), b))
    got = vector()
    assert len(want) == 105 and set(got) == set(want) and np.allclose(np.array([got[k] for k in want], float), np.array(list(want.values()), float), equal_nan=True)
    assert [k for k in got if got[k] is None] == [k for k in want if want[k] is None]


@pytest.mark.parametrize("tile", [3, 8, 16])
def test_correlation_by_tiles_equals_the_dense_form(spark, tile):
    c = rows.intra_cells(binning.bin_pairs(pairs(spark, SF).filter("chr1 = chr2"), 1_000_000)).filter("chr = 2")
    dense = {(r["x"], r["y"]): r["r"] for r in corr.pearson(c, "n").collect()}
    tiled = {(r["x"], r["y"]): r["r"] for r in corr.pearson_by_tiles(c, "n", 8, tile).collect()}
    assert set(tiled) == set(dense) and all(abs(v - dense[k]) < 1e-9 for k, v in tiled.items())


def test_first_eigenvector_by_restarts():
    """Eigenvalues so close that one basis of BASIS vectors does not settle."""
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.normal(size=(400, 400)))[0]
    values = np.linspace(1, 100, 400)
    values[-1] = values[-2] + 0.05
    a, steps = (basis * values) @ basis.T, []
    v, residual = corr.first_eigenvector(lambda x: steps.append(1) or a @ x, np.ones(400))
    assert len(steps) > 3 * corr.BASIS and residual <= corr.RESIDUAL
    assert abs(abs(v @ basis[:, -1]) - 1) < 1e-8


def test_an_eigenvector_that_does_not_settle_is_an_error():
    rng = np.random.default_rng(1)
    with pytest.raises(ArithmeticError):
        corr.first_eigenvector(lambda x: rng.normal(size=300), np.ones(300))


def test_eigenvector_is_centred_and_signed(spark):
    c = rows.intra_cells(binning.bin_pairs(pairs(spark, SF).filter("chr1 = chr2"), 1_000_000))
    for _, g in corr.eigenvector(c, "n").toPandas().groupby("chr"):
        v = g["v"].dropna()
        assert abs(v.mean()) < 1e-9


def test_fine_bins_are_refused():
    with pytest.raises(ValueError):
        corr.check_resolution(10_000)


def test_correlations_of_matrices_beyond_one_task(spark, monkeypatch):
    rng = np.random.default_rng(4)
    m = np.triu(rng.poisson(1.2, (40, 40)).astype(float))
    m[:, 7] = m[7, :] = 0  # a row without cells
    m[20:, 20:][np.triu_indices(20)] += 3
    rows = [(1000, c, int(x), int(y), float(m[x, y])) for c in (1, 2) for x, y in zip(*np.nonzero(m)) if c == 1 or x < 30 and y < 30]
    d = spark.createDataFrame(rows, "resolution int, chr int, x long, y long, oe double")
    small = {(r["chr"], r["x"], r["y"]): r["r"] for r in corr.pearson(d).collect()}
    vectors = {(r["chr"], r["bin"]): r["v"] for r in corr.eigenvector(d).collect()}
    monkeypatch.setattr(corr, "MOST_BINS", 35)
    large = {(r["chr"], r["x"], r["y"]): r["r"] for r in corr.pearson(d).collect()}
    assert set(small) == set(large) and len([k for k in small if k[0] == 1]) == 39 * 40 // 2
    assert all(abs(small[k] - large[k]) < 1e-9 for k in small)
    again = {(r["chr"], r["bin"]): r["v"] for r in corr.eigenvector(d).collect()}
    assert set(vectors) == set(again)
    assert all(vectors[k] is again[k] is None or abs(vectors[k] - again[k]) < 1e-6 for k in vectors)
