"""Queries of the contact-matrix engine by name, and the SQL each must agree with.

A query is written with the library's DataFrame functions, its SQL from the definitions alone.
Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlattice.functions import genome, pairs as P
from pairlattice.functions.genome import offsets
from pairlattice.functions.scalars import percent, with_commas
from pairlattice.operators import balance, binning, corr, cutoffs, expected, intervals, merge, norms, qc, rows
from pairlattice.operators.stage import settled, stage_folder
from pairlattice.plans.fixture import CHROMOSOMES, CHROMS_SQL, PAIRS_SQL, cells_sql, chroms, halves_sql, pairs, pairs_of
from pairlattice.sources import readers, sinks
from pairlattice.sources.pairs_binary import FULL, SHORT, write_pairs_binary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BIN = 250_000
TOTAL = sum(x for _, x in CHROMOSOMES)


def query(sql: str | None = None, parts: tuple[str, ...] = ()):
    """Registers a query under its function's name; parts are WITH clauses that its SQL begins with."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = ("WITH RECURSIVE " if any(x.startswith("fold(") for x in parts) else "WITH ") + ",\n".join((PAIRS_SQL, *parts)) + "\n" + sql
        return f

    return add


def r6(c: str, name: str | None = None):
    return F.round(F.col(c), 6).alias(name or c)


def _intra(spark: SparkSession, sf: str, resolution: int = BIN) -> DataFrame:
    """Intra cells; queries that read them several times settle them first."""
    return rows.as_intra(binning.bin_pairs(pairs(spark, sf).filter(P.intra()), resolution))


INTRA = cells_sql(BIN, "c", where="chr1 = chr2") + ", ic AS (SELECT resolution, chr1 AS chr, x, y, n FROM c)"
HALVES = halves_sql()
VC = """vc0 AS (SELECT resolution, chr, bin, sum(n) AS v FROM halves GROUP BY ALL),
fac AS (SELECT resolution, chr, sqrt(sum(CASE WHEN x = y THEN 1.0 ELSE 2.0 END * n / (a.v * b.v)) / sum(CASE WHEN x = y THEN 1.0 ELSE 2.0 END * n)) AS factor
  FROM ic JOIN vc0 a USING (resolution, chr) JOIN vc0 b USING (resolution, chr) WHERE a.bin = x AND b.bin = y AND a.v > 0 AND b.v > 0 GROUP BY ALL),
vc AS (SELECT resolution, chr, bin, v * factor AS v FROM vc0 JOIN fac USING (resolution, chr))"""
HIST = "h AS (SELECT resolution, abs(x - y) AS dist, sum(n) AS observed FROM ic GROUP BY ALL)"
POSSIBLE = f"poss AS (SELECT d AS dist, CAST(sum(m - d) AS BIGINT) AS possible FROM (SELECT length // {BIN} AS m, unnest(range(0, length // {BIN})) AS d FROM chroms) GROUP BY d)"
TYPE = "CASE WHEN strand1 AND strand2 THEN 'RR' WHEN NOT strand1 AND NOT strand2 THEN 'LL' WHEN strand1 = (pos1 < pos2) THEN 'INNER' ELSE 'OUTER' END"


# ---- filters and projections


@query("SELECT chr1, chr2, x, y, n FROM cells", (cells_sql(BIN, where="least(mapq1, mapq2) >= 10"),))
def contact_bins_250k(spark, sf):
    return binning.bin_pairs(P.select_pairs(pairs(spark, sf), mapq=10), BIN).select("chr1", "chr2", "x", "y", "n")


@query("SELECT l_orderkey, l_linenumber, chr1, pos1, chr2, pos2, mapq1, mapq2 FROM pairs WHERE least(mapq1, mapq2) >= 30")
def filter_mapq(spark, sf):
    return pairs(spark, sf).filter(P.mapq_at_least(30)).select("l_orderkey", "l_linenumber", "chr1", "pos1", "chr2", "pos2", "mapq1", "mapq2")


@query("SELECT chr1, count(*) AS n FROM pairs WHERE chr1 = chr2 GROUP BY ALL")
def filter_intra(spark, sf):
    return P.select_pairs(pairs(spark, sf), intra_only=True).groupBy("chr1").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, pos1, pos2 FROM pairs WHERE chr1 = chr2 AND abs(pos1 - pos2) <= 100000")
def filter_near_diagonal(spark, sf):
    return P.select_pairs(pairs(spark, sf), near=100_000).select("l_orderkey", "l_linenumber", "pos1", "pos2")


@query("SELECT chr1, chr2, count(*) AS n FROM pairs WHERE chr1 IN (1, 3) AND chr2 IN (1, 3) GROUP BY ALL")
def filter_chromosomes(spark, sf):
    return P.select_pairs(pairs(spark, sf), chromosomes=(1, 3)).groupBy("chr1", "chr2").agg(F.count("*").alias("n"))


@query(f"SELECT {TYPE} AS pair_type, count(*) AS n FROM pairs GROUP BY ALL")
def pair_type_counts(spark, sf):
    return pairs(spark, sf).groupBy(P.pair_type().alias("pair_type")).agg(F.count("*").alias("n"))


@query(f"SELECT l_orderkey, l_linenumber, strand1, strand2 FROM pairs WHERE {TYPE} IN ('LL', 'RR')")
def filter_tandem(spark, sf):
    return P.select_pairs(pairs(spark, sf), orientation="TANDEM").select("l_orderkey", "l_linenumber", "strand1", "strand2")


@query("SELECT l_orderkey, l_linenumber, chr1, pos1, frag1, chr2, pos2, frag2 FROM canon")
def canonical_pairs(spark, sf):
    return P.canonical(pairs(spark, sf)).select("l_orderkey", "l_linenumber", "chr1", "pos1", "frag1", "chr2", "pos2", "frag2")


@query("SELECT l_orderkey, l_linenumber, least(greatest(pos1 - 100000, 0), 8000000) AS pos1, least(greatest(pos2 + 100000, 0), 8000000) AS pos2 FROM pairs")
def clamped_positions(spark, sf):
    moved = pairs(spark, sf).withColumns({"pos1": F.col("pos1") - 100000, "pos2": F.col("pos2") + 100000})
    return P.clamp(moved, chroms(spark)).select("l_orderkey", "l_linenumber", "pos1", "pos2")


@query("SELECT l_orderkey, l_linenumber, ((chr1 - 1) * 8000000 + pos1) // 1000 AS gpos1, ((chr2 - 1) * 8000000 + pos2) // 1000 AS gpos2 FROM pairs")
def genome_wide_position(spark, sf):
    return P.genome_position(pairs(spark, sf), chroms(spark)).select("l_orderkey", "l_linenumber", "gpos1", "gpos2")


@query("SELECT block, count(*) AS n_cells, sum(n) AS n FROM (SELECT 1 * (y // 10) + x // 10 AS block, n FROM cells) GROUP BY ALL", (cells_sql(BIN, where="chr1 <> chr2"),))
def block_number_inter(spark, sf):
    cells = binning.bin_pairs(pairs(spark, sf).filter(~P.intra()), BIN)
    columns = genome.block_columns(8_000_000, BIN, intra=False)
    block = P.inter_block(F.col("x"), F.col("y"), columns, 10)
    return cells.groupBy(block.alias("block")).agg(F.count("*").alias("n_cells"), F.sum("n").alias("n"))


@query("SELECT block, count(*) AS n_cells FROM (SELECT CAST(floor(ln(1.0 + abs(x - y) / 1.4142135623730951 / 10) / ln(2.0)) AS BIGINT) * 1 + CAST(floor((x + y) / 2 / 10) AS BIGINT) AS block FROM cells) GROUP BY ALL", (cells_sql(BIN, where="chr1 = chr2"),))
def block_number_intra(spark, sf):
    cells = binning.bin_pairs(pairs(spark, sf).filter(P.intra()), BIN)
    depth = P.log_depth(F.col("x"), F.col("y"), 10)
    return cells.groupBy(P.intra_block(depth, F.col("x"), F.col("y"), genome.block_columns(8_000_000, BIN, True), 10).alias("block")).agg(F.count("*").alias("n_cells"))


@query("SELECT chr1, x * resolution AS pos1, chr2, y * resolution AS pos2, n AS score FROM cells", (cells_sql(BIN),))
def cell_contacts(spark, sf):
    return binning.to_contacts(binning.bin_pairs(pairs(spark, sf), BIN))


@query("SELECT idx, length, coalesce(sum(length) OVER o, 0)::BIGINT AS start_bp, coalesce(sum(length // 250000 + 1) OVER o, 0)::BIGINT AS first_bin, length // 250000 + 1 AS n_bins FROM chroms WINDOW o AS (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", (CHROMS_SQL,))
def genome_offsets(spark, sf):
    return genome.offsets(chroms(spark), BIN)


@query("SELECT a.idx AS chr1, b.idx AS chr2 FROM chroms a JOIN chroms b ON a.idx <= b.idx", (CHROMS_SQL,))
def chromosome_pairs(spark, sf):
    return genome.chromosome_pairs(chroms(spark))


@query("SELECT l_orderkey, l_linenumber, chr1, chr2 FROM pairs WHERE chr1 <= 3 AND chr2 <= 3")
def names_resolved(spark, sf):
    named = pairs(spark, sf).withColumns({c: F.concat(F.when(F.col("pos1") % 2 == 0, F.lit("chr")).otherwise(F.lit("")), F.col(c).cast("string")) for c in ("chr1", "chr2")})
    return genome.resolve(named, chroms(spark).filter("idx <= 3")).select("l_orderkey", "l_linenumber", "chr1", "chr2")


# ---- cells


@query("SELECT 250000 AS resolution, * FROM r250 UNION ALL SELECT 1000000, * FROM r1m UNION ALL SELECT 2500000, * FROM r25m", tuple(f"{n} AS (SELECT chr1, chr2, pos1 // {r} AS x, pos2 // {r} AS y, sum(score) AS n FROM canon GROUP BY ALL)" for n, r in (("r250", 250000), ("r1m", 1000000), ("r25m", 2500000))))
def multi_resolution_cells(spark, sf):
    return binning.multi_resolution(pairs(spark, sf), (250_000, 1_000_000, 2_500_000))


@query("SELECT chr1, chr2, x, y, n FROM cells", (cells_sql(1_000_000),))
def rollup_equals_direct(spark, sf):
    return binning.roll_up(binning.bin_pairs(pairs(spark, sf), BIN), 1_000_000).select("chr1", "chr2", "x", "y", "n")


@query("SELECT x, y, sum(score) AS n FROM (SELECT least(a, b) // 64 AS x, greatest(a, b) // 64 AS y, score FROM (SELECT ((chr1 - 1) * 8000000 + pos1) // 1000 AS a, ((chr2 - 1) * 8000000 + pos2) // 1000 AS b, score FROM pairs)) GROUP BY ALL")
def genome_wide_matrix(spark, sf):
    return binning.whole_genome(pairs(spark, sf), chroms(spark), TOTAL).select("x", "y", "n")


@query("SELECT chr1, chr2, x, y, n FROM cells WHERE n >= 3", (cells_sql(BIN),))
def count_threshold_cells(spark, sf):
    return binning.at_least(binning.bin_pairs(pairs(spark, sf), BIN), 3).select("chr1", "chr2", "x", "y", "n")


@query("SELECT chr1, chr2, sum(CASE WHEN chr1 = chr2 AND x <> y THEN 2 * n ELSE n END) AS total, count(*) AS occupied FROM cells GROUP BY ALL", (cells_sql(BIN),))
def matrix_totals(spark, sf):
    return binning.totals(binning.bin_pairs(pairs(spark, sf), BIN)).select("chr1", "chr2", "total", "occupied")


@query("SELECT chr1, chr2, round(quantile_cont(n, 0.05), 6) AS p5, round(quantile_cont(n, 0.95), 6) AS p95 FROM cells GROUP BY ALL", (cells_sql(BIN),))
def cell_percentiles(spark, sf):
    return binning.totals(binning.bin_pairs(pairs(spark, sf), BIN)).select("chr1", "chr2", r6("p5"), r6("p95"))


# ---- matrix rows


@query("SELECT chr1, chr2, count(*) AS n, TRUE AS within FROM cells GROUP BY ALL", (cells_sql(50_000),))
def cell_percentile_sketches(spark, sf):
    """Whether percentiles of merged sketches, one of each seventh of a matrix's cells, are within the stated error of their share of the cells."""
    cells = settled(binning.bin_pairs(pairs(spark, sf), 50_000))
    parts = cells.withColumn("part", F.pmod(F.col("x") + F.col("y"), F.lit(7)))
    sketches = merge.union_all([binning.count_sketches(parts.filter(F.col("part") == i)) for i in range(7)])
    shares = (0.05, 0.5, 0.95)
    found = binning.sketched_percentiles(sketches, shares)
    rank = [(F.avg((F.col("n") <= F.col("values")[i]).cast("double")), F.avg((F.col("n") < F.col("values")[i]).cast("double")), q) for i, q in enumerate(shares)]
    fine = [(upto >= q - binning.SKETCH_ERROR) & (below <= q + binning.SKETCH_ERROR) for upto, below, q in rank]
    both = cells.join(found.select("resolution", "chr1", "chr2", F.col("n").alias("held"), "values"), ["resolution", "chr1", "chr2"])
    return both.groupBy("chr1", "chr2").agg(F.first("held").alias("n"), (fine[0] & fine[1] & fine[2]).alias("within"))


@query("SELECT chr, bin, sum(n) AS v FROM halves GROUP BY ALL", (INTRA, HALVES))
def row_sums_vc(spark, sf):
    return rows.row_sums(_intra(spark, sf)).select("chr", "bin", "v")


@query("SELECT chr, bin, count(*) AS nnz FROM halves GROUP BY ALL", (INTRA, HALVES))
def row_nonzeros(spark, sf):
    return rows.row_nonzeros(_intra(spark, sf)).select("chr", "bin", "nnz")


@query("SELECT chr, round(factor, 6) AS factor FROM fac", (INTRA, HALVES, VC))
def norm_sum_factor(spark, sf):
    c = settled(_intra(spark, sf))
    return rows.sum_factor(c, rows.row_sums(c)).select("chr", r6("factor"))


@query("SELECT chr, x, y, round(n / (a.v * b.v), 6) AS n FROM ic JOIN vc a USING (resolution, chr) JOIN vc b USING (resolution, chr) WHERE a.bin = x AND b.bin = y", (INTRA, HALVES, VC))
def vc_normalized_cells(spark, sf):
    c = settled(_intra(spark, sf))
    return rows.normalized(c, norms.vc(c)).select("chr", "x", "y", r6("n"))


@query("SELECT chr, bin, round(w.v * sqrt(q), 6) AS v FROM w JOIN (SELECT chr, sum(CASE WHEN x = y THEN 1.0 ELSE 2.0 END * n / (a.v * b.v)) / sum(CASE WHEN x = y THEN 1.0 ELSE 2.0 END * n) AS q FROM ic JOIN w a USING (chr) JOIN w b USING (chr) WHERE a.bin = x AND b.bin = y GROUP BY chr) USING (chr)", (INTRA, HALVES, "w AS (SELECT chr, bin, sqrt(sum(n)) AS v FROM halves GROUP BY ALL)"))
def vc_sqrt_vector(spark, sf):
    return norms.vc_sqrt(settled(_intra(spark, sf))).select("chr", "bin", r6("v"))


@query("SELECT h.chr, h.bin, round(sum(n * sqrt(s.v)), 6) AS v FROM halves h JOIN (SELECT chr, bin, sum(n) AS v FROM halves GROUP BY ALL) s ON h.chr = s.chr AND h.other = s.bin GROUP BY ALL", (INTRA, HALVES))
def sparse_matvec(spark, sf):
    c = _intra(spark, sf)
    return rows.matvec(c, rows.row_sums(c).withColumn("v", F.sqrt("v"))).select("chr", "bin", r6("v"))


def _half_steps(spark, sf, which: int):
    """A half-step of the balancing operator for each chromosome, as rows of occupied bins."""
    c, out = settled(_intra(spark, sf)), []
    for r in norms.bins(chroms(spark), (BIN,)).collect():
        step = balance.half_step(c.filter(F.col("chr") == r["chr"]), r["n_bins"])
        out += [(r["chr"], i, round(float(step[which][i]), 6)) for i in range(r["n_bins"]) if step[0][i] > 0]
    return spark.createDataFrame(out, "chr int, bin long, v double")


@query("SELECT chr, bin, round(sqrt(v) / (v * sqrt(v)), 6) AS v FROM (SELECT chr, bin, sum(n) AS v FROM halves GROUP BY ALL)", (INTRA, HALVES))
def sinkhorn_step(spark, sf):
    """First half-step of balancing: the row scaling that the start (roots of row sums) turns into."""
    return _half_steps(spark, sf, 0)


@query("SELECT h.chr, h.bin, round(sum(h.n / o.v) * sqrt(any_value(b.v)), 6) AS v FROM halves h JOIN s o ON h.chr = o.chr AND h.other = o.bin JOIN s b ON h.chr = b.chr AND h.bin = b.bin GROUP BY h.chr, h.bin",
       (INTRA, HALVES, "s AS (SELECT chr, bin, sum(n) AS v FROM halves GROUP BY ALL)"))
def sinkhorn_sums(spark, sf):
    """The columns' sums after the first half-step of balancing."""
    return _half_steps(spark, sf, 1)


@query("SELECT chr, bin, CASE WHEN v > 20 THEN round(1 / v, 9) END AS v FROM (SELECT chr, bin, sum(n) AS v FROM halves GROUP BY ALL)", (INTRA, HALVES))
def inverted_vector(spark, sf):
    s = rows.row_sums(_intra(spark, sf)).withColumn("v", F.when(F.col("v") > 20, F.col("v")).otherwise(F.lit(float("nan"))))
    return rows.inverted(s).select("chr", "bin", F.round(F.nanvl("v", F.lit(None).cast("double")), 9).alias("v"))


@query("SELECT idx AS chr, unnest(range(0, length // 1000000 + 1)) AS bin, CAST(1.0 AS DOUBLE) AS v FROM chroms", (CHROMS_SQL,))
def none_vector(spark, sf):
    return norms.none(chroms(spark), (1_000_000,)).select("chr", "bin", "v")


NNZ = "nz AS (SELECT chr, bin, count(*) AS nnz FROM halves GROUP BY ALL)"


@query("SELECT chr, 0.0::DOUBLE AS c0, round(quantile_cont(nnz::DOUBLE, 0.1), 6) AS c1, round(quantile_cont(nnz::DOUBLE, 0.2), 6) AS c2 FROM nz GROUP BY chr", (INTRA, HALVES, NNZ))
def percentile_cutoffs(spark, sf):
    c = cutoffs.percentile_cutoffs(rows.row_nonzeros(_intra(spark, sf)), 10, 10, 30)
    return c.select("chr", *[F.round(cutoffs.cutoff(F.col("cutoffs"), i), 6).alias(f"c{i}") for i in range(3)])


@query("SELECT chr, round(avg(nnz) - 2 * stddev_samp(nnz), 6) AS c1, round(avg(nnz) - stddev_samp(nnz), 6) AS c2 FROM nz GROUP BY chr", (INTRA, HALVES, NNZ))
def zscore_cutoffs(spark, sf):
    c = cutoffs.zscore_cutoffs(rows.row_nonzeros(_intra(spark, sf)), -2, 1, 0)
    return c.select("chr", *[F.round(cutoffs.cutoff(F.col("cutoffs"), i), 6).alias(f"c{i}") for i in (1, 2)])


@query("SELECT chr, list_sort(list(nnz))[1 + CAST(floor(count(*) * 10 / 100) AS INT)] AS upper FROM nz GROUP BY chr", (INTRA, HALVES, NNZ))
def row_order_statistic(spark, sf):
    return cutoffs.order_statistic(rows.row_nonzeros(_intra(spark, sf))).select("chr", "upper")


@query("SELECT chr, round(quantile_cont(abs(v * (1 / v0) - 1), 0.9), 6) AS error FROM (SELECT chr, bin, sum(n) AS v, sum(n) + 5 AS v0 FROM halves GROUP BY ALL) GROUP BY chr", (INTRA, HALVES))
def row_error_percentile(spark, sf):
    s = rows.row_sums(_intra(spark, sf))
    return cutoffs.error_percentile(s, s.withColumn("v", 1 / (F.col("v") + 5))).select("chr", r6("error"))


# ---- distance decay


@query("SELECT dist, observed FROM h", (INTRA, HIST))
def distance_histogram(spark, sf):
    return expected.distance_histogram(_intra(spark, sf)).select("dist", "observed")


@query("SELECT dist, possible FROM poss", (CHROMS_SQL, POSSIBLE))
def possible_distances(spark, sf):
    return expected.possible_distances(chroms(spark), BIN).select("dist", "possible")


@query("SELECT dist, round(coalesce(observed, 0) / possible, 6) AS density FROM poss LEFT JOIN h USING (dist)", (INTRA, HIST, CHROMS_SQL, POSSIBLE))
def expected_raw_density(spark, sf):
    return expected.raw_density(expected.distance_histogram(_intra(spark, sf)), expected.possible_distances(chroms(spark), BIN)).select("dist", r6("density"))


@query("SELECT chr, x, y, round(n / (observed / possible), 6) AS oe FROM ic JOIN h ON abs(x - y) = h.dist JOIN poss USING (dist)", (INTRA, HIST, CHROMS_SQL, POSSIBLE))
def observed_over_expected(spark, sf):
    c = settled(_intra(spark, sf))
    density = expected.raw_density(expected.distance_histogram(c), expected.possible_distances(chroms(spark), BIN))
    return expected.observed_over_expected(c, density).select("chr", "x", "y", r6("oe"))


@query("SELECT abs(x - y) AS dist, round(sum(n / (a.v * b.v)), 6) AS observed FROM ic JOIN vc a USING (resolution, chr) JOIN vc b USING (resolution, chr) WHERE a.bin = x AND b.bin = y GROUP BY ALL", (INTRA, HALVES, VC))
def normed_distance_histogram(spark, sf):
    c = settled(_intra(spark, sf))
    return norms.normed_histogram(c, norms.vc(c)).select("dist", r6("observed"))


@query("SELECT chr, round(expected / observed, 6) AS factor FROM (SELECT idx AS chr, sum((length // 250000 - dist) * coalesce(observed, 0) / possible) AS expected FROM chroms JOIN poss ON dist < length // 250000 LEFT JOIN h USING (dist) GROUP BY idx) JOIN (SELECT chr, sum(n) AS observed FROM ic GROUP BY chr) USING (chr)", (INTRA, HIST, CHROMS_SQL, POSSIBLE))
def chromosome_factors(spark, sf):
    c = settled(_intra(spark, sf))
    density = expected.raw_density(expected.distance_histogram(c), expected.possible_distances(chroms(spark), BIN))
    return expected.chromosome_factors(density, chroms(spark), expected.chromosome_totals(c)).select("chr", r6("factor"))


def _smoothed(observed: str, resolution: int) -> tuple[str, ...]:
    """WITH clauses of the widening window as recursion over distances; lists of running sums begin with 0."""
    n = 8_000_000 // resolution
    return (
        f"o AS (SELECT coalesce(dist, d) AS dist, coalesce(observed, 0) AS observed, 4 * greatest(0, {n} - d) AS possible FROM range({n + 1}) r(d) LEFT JOIN ({observed}) ON dist = d)",
        "acc AS (SELECT dist, sum(observed) OVER w AS a, sum(possible) OVER w AS b FROM o WINDOW w AS (ORDER BY dist))",
        f"sums AS (SELECT list_prepend(CAST(0 AS DOUBLE), list(CAST(a AS DOUBLE) ORDER BY dist)) AS a, list_prepend(CAST(0 AS DOUBLE), list(CAST(b AS DOUBLE) ORDER BY dist)) AS b, {n} AS n FROM acc)",
        """fold(d, lo, hi, density) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE)
  UNION ALL SELECT d + 1, lo2, greatest(hi2, least(hi2 + 2, n - 1)), CASE WHEN b[hi2 + 2] > b[lo2 + 1] THEN (a[hi2 + 2] - a[lo2 + 1]) / (b[hi2 + 2] - b[lo2 + 1]) ELSE 0.0 END
  FROM (SELECT d, a, b, n, CASE WHEN short THEN lo ELSE lo + k END AS lo2, CASE WHEN short THEN greatest(hi, least(reach, n)) ELSE hi - k END AS hi2
    FROM (SELECT d, lo, hi, a, b, n, a[hi + 2] - a[lo + 1] < 400 AS short, len(list_filter(a, lambda x: x < a[lo + 1] + 400)) - 1 AS reach,
            len(list_filter(range(1, n + 2), lambda j: hi - lo - 2 * (j - 1) > 1 AND a[hi - j + 2] - a[lo + j + 1] >= 400)) AS k
          FROM fold, sums WHERE d < n)))""",
    )


@query("SELECT 50000 AS resolution, d - 1 AS dist, round(density, 6) AS density FROM fold WHERE d > 0", (cells_sql(50_000, "c50"), *_smoothed("SELECT y - x AS dist, sum(n) AS observed FROM c50 WHERE chr1 = chr2 GROUP BY ALL", 50_000)))
def expected_smoothed(spark, sf):
    c = _intra(spark, sf, 50_000)
    return expected.smoothed_density(expected.distance_histogram(c), expected.possible_distances(chroms(spark), 50_000)).withColumn("density", F.round("density", 6))


# ---- quality statistics

FATES = f"""f AS (SELECT t.threshold, chr1 = chr2 AS intra, abs(pos1 - pos2) AS dist, {TYPE} AS pt, least(mapq1, mapq2) AS mapq,
  CASE WHEN chr1 = chr2 AND frag1 = frag2 THEN 'intra_fragment' WHEN NOT (mapq1 = 1000 AND mapq2 = 1000) AND least(mapq1, mapq2) >= 0 AND least(mapq1, mapq2) < threshold THEN 'under_mapq' ELSE 'contact' END AS fate
  FROM pairs, (VALUES (1), (30)) t(threshold))"""
_EDGES = ", ".join(map(str, P.DISTANCES))
LOG_BIN = f"len(list_filter([{_EDGES}], lambda e: e < dist))"


@query("""SELECT threshold, count(*) AS n_unique, count(*) FILTER (fate = 'intra_fragment') AS intra_fragment, count(*) FILTER (fate = 'under_mapq') AS under_mapq,
  count(*) FILTER (fate = 'contact') AS contacts, count(*) FILTER (fate = 'contact' AND NOT intra) AS inter, count(*) FILTER (fate = 'contact' AND intra) AS intra,
  count(*) FILTER (fate = 'contact' AND intra AND dist >= 20000) AS far, count(*) FILTER (fate = 'contact' AND intra AND dist >= 20000 AND pt = 'INNER') AS far_inner,
  count(*) FILTER (fate = 'contact' AND intra AND dist >= 20000 AND pt = 'LL') AS far_left FROM f GROUP BY threshold""", (FATES,))
def qc_counts(spark, sf):
    return qc.counts(pairs(spark, sf)).select("threshold", "n_unique", "intra_fragment", "under_mapq", "contacts", "inter", "intra", "far", "far_inner", "far_left")


@query("SELECT CASE WHEN dist < 500 THEN '<500BP' WHEN dist < 5000 THEN '500BP-5kB' WHEN dist < 20000 THEN '5kB-20kB' ELSE '>20kB' END AS class, count(*) AS n FROM f WHERE threshold = 1 AND fate = 'contact' AND intra GROUP BY ALL", (FATES,))
def qc_distance_classes(spark, sf):
    c = qc.classified(pairs(spark, sf), (1,)).filter("fate = 'contact' and intra")
    return c.groupBy(P.distance_class(F.col("dist")).alias("class")).agg(F.count("*").alias("n"))


@query(f"SELECT threshold, {LOG_BIN} AS bin, count(*) FILTER (pt = 'INNER') AS n_inner, count(*) FILTER (pt = 'OUTER') AS n_outer, count(*) FILTER (pt = 'RR') AS n_right, count(*) FILTER (pt = 'LL') AS n_left FROM f WHERE fate = 'contact' AND intra GROUP BY ALL", (FATES,))
def qc_lior_hist(spark, sf):
    return qc.orientation_histogram(pairs(spark, sf), (1, 30)).withColumn("bin", F.col("bin").cast("long"))


@query("SELECT threshold, mapq, count(*) AS n_all, count(*) FILTER (intra) AS n_intra, count(*) FILTER (NOT intra) AS n_inter FROM f WHERE fate = 'contact' AND mapq <= 200 GROUP BY ALL", (FATES,))
def qc_mapq_hist(spark, sf):
    return qc.mapq_histogram(pairs(spark, sf), (1, 30))


@query(f"""SELECT threshold, CAST(coalesce(min(bin) FILTER (worst < 0.5), 99) AS INT) AS bin FROM (
  SELECT threshold, bin, max(err) OVER (PARTITION BY threshold ORDER BY bin ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS worst FROM (
    SELECT threshold, bin, CASE WHEN i + o + r + l < 1 THEN 1000 WHEN least(i, o, r, l) = 0 OR i + o + r + l = 4 THEN 'inf'::DOUBLE ELSE list_max(list_transform([i, o, r, l], lambda k: abs((ln((i + o + r + l) / 4.0) - ln(k)) / ln((i + o + r + l) / 4.0)))) END AS err
    FROM (SELECT t.threshold, b.bin, count(*) FILTER (pt = 'INNER') AS i, count(*) FILTER (pt = 'OUTER') AS o, count(*) FILTER (pt = 'RR') AS r, count(*) FILTER (pt = 'LL') AS l
          FROM (VALUES (1), (30)) t(threshold) CROSS JOIN range(100) b(bin) LEFT JOIN (SELECT *, {LOG_BIN} AS lb FROM f WHERE fate = 'contact' AND intra) f ON f.threshold = t.threshold AND f.lb = b.bin GROUP BY ALL))) GROUP BY threshold""", (FATES,))
def qc_convergence(spark, sf):
    """With an error of 0.5, as the fixture's orientations do not agree closely anywhere."""
    return qc.convergence(qc.orientation_histogram(pairs(spark, sf), (1, 30)), 0.5)


@query("""SELECT CAST(t AS BIGINT) AS n_total, CAST(u AS BIGINT) AS n_unique, CAST(t - u AS BIGINT) AS n_dups FROM (SELECT count(*) AS t, count(DISTINCT (l_orderkey, l_linenumber)) AS u FROM lineitem)""")
def library_complexity_counts(spark, sf):
    return qc.complexity(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_orderkey", "l_linenumber").select("n_total", "n_unique", "n_dups")


_HALF = "(a.lo + a.hi) / 2"


@query(f"""SELECT CAST(floor(u * (r.lo + r.hi) / 2) AS BIGINT) AS library_size FROM (
  SELECT u, list_reduce(list_transform(range(0, 201), lambda i: {{'lo': CAST(1 AS DOUBLE), 'hi': CAST(100 AS DOUBLE)}}),
    lambda a, b: CASE WHEN 1 / ({_HALF}) - 1 + exp(-n / (({_HALF}) * u)) > 0 THEN {{'lo': {_HALF}, 'hi': a.hi}} ELSE {{'lo': a.lo, 'hi': {_HALF}}} END) AS r
  FROM (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT (l_orderkey, l_linenumber)) AS DOUBLE) AS u FROM lineitem))""")
def library_complexity(spark, sf):
    return qc.complexity(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_orderkey", "l_linenumber").select("library_size")


@query("SELECT chr1, CAST(count(*) AS BIGINT) AS n, printf('%.2f%%', count(*) * 100.0 / sum(count(*)) OVER ()) AS share, format('{:,}', count(*)) AS shown FROM pairs GROUP BY chr1")
def formatted_shares(spark, sf):
    per = pairs(spark, sf).groupBy("chr1").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    return per.join(F.broadcast(total)).select("chr1", "n", percent(F.col("n"), F.col("total")).alias("share"), with_commas(F.col("n")).alias("shown"))


# ---- datasets and reports


@query("SELECT chr1, chr2, x, y, n FROM cells", (cells_sql(BIN),))
def sum_datasets(spark, sf):
    p = pairs(spark, sf)
    return merge.sum_datasets([binning.bin_pairs(p.filter(F.col("l_orderkey") % 3 == i), BIN) for i in range(3)]).select("chr1", "chr2", "x", "y", "n")


@query("SELECT 250000 AS resolution, chr1, chr2, x, y, n FROM c0 UNION ALL SELECT 1000000, chr1, chr2, x, y, n FROM c1", (cells_sql(BIN, "c0"), cells_sql(1_000_000, "c1")))
def rebinned_sum(spark, sf):
    p = pairs(spark, sf)
    return merge.rebin_datasets([binning.bin_pairs(p.filter(F.col("l_orderkey") % 2 == i), BIN) for i in range(2)], BIN, (1_000_000,))


@query("SELECT CASE p_size % 4 WHEN 0 THEN 'total_unique' WHEN 1 THEN 'contacts' WHEN 2 THEN 'inter' ELSE 'convergence' END AS label, CAST(CASE WHEN p_size % 4 = 3 THEN max(p_partkey) ELSE sum(p_partkey) END AS BIGINT) AS value FROM part GROUP BY p_size % 4")
def merge_stats_labels(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("Total Unique: ", "Hi-C Contacts: ", "Inter-chromosomal: ", " L-I-O-R Convergence: "))), F.col("p_size") % 4 + 1)
    lines = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("file"), F.concat(kind, with_commas(F.col("p_partkey")), F.lit(" (1.00% / 2.00%)")).alias("line"))
    return merge.merge_stats(merge.parse_stats(lines))


@query("SELECT label, CAST(CASE WHEN label = 'convergence' THEN max(p_partkey) ELSE sum(p_partkey) END AS BIGINT) AS value FROM (SELECT p_partkey, [NULL, 'sequenced', 'unmapped', 'one', 'one_unique', 'one_dups', 'two', 'two_unique', 'two_dups', 'three_plus', 'convergence'][p_size % 11 + 1] AS label FROM part) WHERE label IS NOT NULL GROUP BY label")
def merge_single_end_labels(spark, sf):
    """Labels of single-end reports, with a line that is to be ignored."""
    texts = ("Library Complexity", "Sequenced Reads", "0 alignments", "1 alignment", "\t1 alignment unique", "\t1 alignment duplicates", "2 alignments", "\t2 alignment unique", "\t2 alignment duplicates", "3 or more alignments (>2)", "\tL-I-O-R Convergence")
    kind = F.element_at(F.array(*map(F.lit, texts)), (F.col("p_size") % 11 + 1).cast("int"))
    lines = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("file"), F.concat(kind, F.lit(": "), with_commas(F.col("p_partkey")), F.lit(" (1.00%)")).alias("line"))
    return merge.merge_stats(merge.parse_stats(lines, "Single End"))


@query("SELECT label, CAST(sum(p_partkey) AS BIGINT) AS value FROM (SELECT p_partkey, [NULL, 'sequenced', 'unmapped', 'two', 'two_ends', 'two_split', 'total_dups'][p_size % 7 + 1] AS label FROM part) WHERE label IS NOT NULL GROUP BY label")
def merge_paired_end_labels(spark, sf):
    """Labels of paired-end reports, with a line that is to be ignored."""
    texts = ("Average insert size", "Sequenced Read Pairs", "One or both reads unmapped", "2 alignments", "\t2 alignments (A...B)", "\t2 alignments (A1...A2B; A1B2...B1A2)", "Total Duplicates")
    kind = F.element_at(F.array(*map(F.lit, texts)), (F.col("p_size") % 7 + 1).cast("int"))
    lines = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("file"), F.concat(kind, F.lit(": "), with_commas(F.col("p_partkey"))).alias("line"))
    return merge.merge_stats(merge.parse_stats(lines, "Paired End"))


@query("SELECT 'A' AS name, CAST(i AS INT) AS i, CAST(sum((p_partkey * (i + 1)) % 97) AS BIGINT) AS value FROM part, range(5) t(i) GROUP BY i")
def merge_histograms(spark, sf):
    values = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: ((F.col("p_partkey") * i) % 97).cast("string")), " ")
    files = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").cast("string").alias("file"), F.concat(F.lit("A = [\n"), values, F.lit(" \n];\n")).alias("content"))
    return merge.merge_histograms(merge.parse_histograms(files)).select("name", "i", "value")


# ---- balancing and correlation


@query()
def scale_vectors_intra(spark, sf):
    return norms.scale(settled(_intra(spark, sf)), chroms(spark), (BIN,))


@query()
def scale_vectors_gw(spark, sf):
    return norms.whole_genome_vectors(binning.bin_pairs(pairs(spark, sf), BIN), chroms(spark), BIN, "SCALE")


@query()
def scale_vectors_inter(spark, sf):
    return norms.whole_genome_vectors(binning.bin_pairs(pairs(spark, sf), BIN), chroms(spark), BIN, "SCALE", intra=False)


GENOME = "gc AS (SELECT least(x + (chr1 - 1) * 33, y + (chr2 - 1) * 33) AS x, greatest(x + (chr1 - 1) * 33, y + (chr2 - 1) * 33) AS y, n FROM cells)"


def _even(cells: DataFrame, vector: DataFrame) -> DataFrame:
    """Whether each occupied row of a matrix sums to the same once cells are divided by its balanced vector, and all rows to what the raw ones do."""
    s, raw = rows.row_sums(rows.normalized(cells, vector)), rows.row_sums(cells).groupBy(*rows.MATRIX).agg(F.sum("v").alias("raw"))
    mean = s.groupBy(*rows.MATRIX).agg(F.avg("v").alias("mean"), F.sum("v").alias("total")).join(raw, list(rows.MATRIX))
    even = (F.abs(F.col("v") / F.col("mean") - 1) < 1e-3) & (F.abs(F.col("total") / F.col("raw") - 1) < 1e-6)
    return s.join(mean, list(rows.MATRIX)).select("chr", "bin", even.alias("even"))


def _even_whole(spark, sf, intra: bool):
    c = binning.bin_pairs(pairs(spark, sf), BIN)
    v = norms.whole_genome_vectors(c, chroms(spark), BIN, "SCALE", intra)
    first = offsets(chroms(spark), BIN).select(F.col("idx").alias("chr"), "first_bin")
    whole = v.join(first, "chr").select("resolution", F.lit(0).alias("chr"), (F.col("bin") + F.col("first_bin")).alias("bin"), "v")
    return _even(norms.whole_genome_cells(c, chroms(spark), BIN, intra), whole).select("bin", "even")


@query("SELECT DISTINCT chr, bin, TRUE AS even FROM halves", (INTRA, HALVES))
def scale_rows_even_intra(spark, sf):
    c = settled(_intra(spark, sf))
    return _even(c, norms.scale(c, chroms(spark), (BIN,)))


@query("SELECT DISTINCT unnest([x, y]) AS bin, TRUE AS even FROM gc", (cells_sql(BIN), GENOME))
def scale_rows_even_gw(spark, sf):
    return _even_whole(spark, sf, True)


@query("SELECT DISTINCT unnest([x, y]) AS bin, TRUE AS even FROM gc WHERE x // 33 <> y // 33", (cells_sql(BIN), GENOME))
def scale_rows_even_inter(spark, sf):
    return _even_whole(spark, sf, False)


@query("SELECT chr, bin, round(v * sqrt(q), 6) AS v FROM (SELECT g // 33 + 1 AS chr, g % 33 AS bin, v, q FROM w, (SELECT sum(t * n / (a.v * b.v)) / sum(t * n) AS q FROM (SELECT *, CASE WHEN x = y THEN 1.0 ELSE 2.0 END AS t FROM gc) gc JOIN w a ON a.g = gc.x JOIN w b ON b.g = gc.y))",
       (cells_sql(BIN), "gc AS (SELECT least(x + (chr1 - 1) * 33, y + (chr2 - 1) * 33) AS x, greatest(x + (chr1 - 1) * 33, y + (chr2 - 1) * 33) AS y, n FROM cells)", "w AS (SELECT g, sum(n) AS v FROM (SELECT x AS g, n FROM gc UNION ALL SELECT y, n FROM gc WHERE x <> y) GROUP BY g)"))
def gw_vc_vector(spark, sf):
    return norms.whole_genome_vectors(binning.bin_pairs(pairs(spark, sf), BIN), chroms(spark), BIN, "VC").select("chr", "bin", r6("v"))


@query("SELECT x, y, round(corr(a.v, b.v), 6) AS r FROM (SELECT p.b AS x, q.b AS y FROM range(8) p(b) JOIN range(8) q(b) ON p.b <= q.b) JOIN d a ON a.i = x JOIN d b ON b.i = y AND a.j = b.j GROUP BY ALL",
       (cells_sql(1_000_000, "c", where="chr1 = 1 AND chr2 = 1"), "d AS (SELECT p.b AS i, q.b AS j, coalesce(max(n), 0) AS v FROM range(8) p(b) CROSS JOIN range(8) q(b) LEFT JOIN c ON (x = p.b AND y = q.b) OR (x = q.b AND y = p.b) GROUP BY ALL)"))
def pearson_matrix(spark, sf):
    c = rows.as_intra(binning.bin_pairs(pairs(spark, sf).filter("chr1 = 1 and chr2 = 1"), corr.check_resolution(1_000_000)))
    return corr.pearson(c, "n").select("x", "y", r6("r"))


@query()
def eigenvector(spark, sf):
    c = settled(_intra(spark, sf))
    density = expected.raw_density(expected.distance_histogram(c), expected.possible_distances(chroms(spark), BIN))
    return corr.eigenvector(expected.observed_over_expected(c, density))


@query("SELECT DISTINCT chr, TRUE AS settled FROM ic", (INTRA,))
def eigenvector_residual(spark, sf):
    """Whether each chromosome's vector w, with its mean put back, is the correlation matrix's first eigenvector: |C w - l w| < 1e-6 with l = w C w, and no l' = |C u| / |u| is larger, for u = z, C z, C^2 z, C^3 z and a fixed z."""
    c = settled(_intra(spark, sf))
    oe = expected.observed_over_expected(c, expected.raw_density(expected.distance_histogram(c), expected.possible_distances(chroms(spark), BIN)))
    r, v = corr.pearson(oe), corr.eigenvector(oe).filter(~F.isnan("v"))
    sums = v.groupBy("chr").agg(F.sum(F.col("v") * F.col("v")).alias("q"), F.count("*").alias("m"))
    shift = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("q")) / F.col("m"))
    w = v.join(sums, "chr").select("chr", "bin", F.explode(F.array(F.struct(F.lit(1).alias("sign"), (F.col("v") + shift).alias("w")), F.struct(F.lit(-1).alias("sign"), (F.col("v") - shift).alias("w")))).alias("z")).select("chr", "bin", "z.sign", "z.w")
    full = settled(r.select("chr", F.col("x").alias("bin"), F.col("y").alias("other"), "r").unionByName(r.filter("x <> y").select("chr", F.col("y").alias("bin"), F.col("x").alias("other"), "r")))
    cw = full.join(w.withColumnRenamed("bin", "other"), ["chr", "other"]).groupBy("chr", "sign", "bin").agg(F.sum(F.col("r") * F.col("w")).alias("cw"))
    both = cw.join(w, ["chr", "sign", "bin"])
    top = both.groupBy("chr", "sign").agg(F.sum(F.col("cw") * F.col("w")).alias("l"))
    rest = both.join(top, ["chr", "sign"]).groupBy("chr", "sign").agg(F.sqrt(F.sum((F.col("cw") - F.col("l") * F.col("w")) ** 2)).alias("rest"))
    z, larger = full.groupBy("chr", "bin").agg(F.cos(F.first("bin") * 1.3).alias("z")), None
    for _ in range(4):
        cz = settled(full.join(z.withColumnRenamed("bin", "other"), ["chr", "other"]).groupBy("chr", "bin").agg(F.sum(F.col("r") * F.col("z")).alias("cz")))
        norm = cz.join(z, ["chr", "bin"]).groupBy("chr").agg(F.sqrt(F.sum(F.col("cz") ** 2) / F.sum(F.col("z") ** 2)).alias("quotient"))
        larger = norm if larger is None else larger.unionByName(norm)
        z = cz.withColumnRenamed("cz", "z")
    best = rest.join(top, ["chr", "sign"]).groupBy("chr").agg(F.min_by("l", "rest").alias("l"), F.min("rest").alias("rest"))
    known = larger.groupBy("chr").agg(F.max("quotient").alias("quotient"))
    return best.join(known, "chr").select("chr", ((F.col("rest") < 1e-6) & (F.col("l") > F.col("quotient") * (1 - 1e-9))).alias("settled"))


@query(f"SELECT {BIN} AS resolution, d - 1 AS dist, round(density, 6) AS density FROM fold WHERE d > 0",
       (INTRA, HALVES, "w AS (SELECT chr, bin, sqrt(sum(n)) AS v FROM halves GROUP BY ALL)", *_smoothed("SELECT y - x AS dist, sum(n / (p.v * q.v)) AS observed FROM ic JOIN w p ON ic.chr = p.chr AND x = p.bin JOIN w q ON ic.chr = q.chr AND y = q.bin GROUP BY ALL", BIN)))
def custom_norm_expected(spark, sf):
    """Expected density under a vector given from outside: here roots of row sums."""
    c = settled(_intra(spark, sf))
    given = rows.row_sums(c).withColumn("v", F.sqrt("v"))
    return expected.smoothed_density(norms.normed_histogram(c, given), expected.possible_distances(chroms(spark), BIN)).withColumn("density", F.round("density", 6))


# ---- intervals, tracks, streams


@query("SELECT f.chr, f.beg, f.end, p_partkey FROM (SELECT DISTINCT chr1 AS chr, pos1 // 4000 * 4000 AS beg, pos1 // 4000 * 4000 + 3999 AS end FROM pairs) f JOIN (SELECT CAST(p_partkey % 4 + 1 AS INT) AS chr, p_partkey * 3500 % 8000000 AS r_beg, p_partkey * 3500 % 8000000 + p_size * 500 AS r_end, p_partkey FROM part) a ON f.chr = a.chr AND f.beg <= r_end AND f.end >= r_beg")
def fragment_overlap_join(spark, sf):
    b = F.expr("pos1 div 4000 * 4000")
    frags = settled(pairs(spark, sf).select(F.col("chr1").alias("chr"), b.alias("beg"), (b + 3999).alias("end")).distinct())
    start = F.col("p_partkey") * 3500 % 8000000
    notes = spark.read.parquet(f"{sf}/part.parquet").select((F.col("p_partkey") % 4 + 1).cast("int").alias("chr"), start.alias("r_beg"), (start + F.col("p_size") * 500).alias("r_end"), "p_partkey")
    return intervals.overlap_join(frags, notes, 20_000).select("chr", "beg", "end", "p_partkey")


@query("SELECT f.chr, f.beg, f.end, p_partkey FROM (SELECT DISTINCT chr1 AS chr, pos1 // 4000 * 4000 AS beg, pos1 // 4000 * 4000 + 3999 AS end FROM pairs) f JOIN (SELECT CAST(p_partkey % 4 + 1 AS INT) AS chr, CASE WHEN p_partkey % 500 = 0 THEN 0 ELSE p_partkey * 3500 % 8000000 END AS r_beg, CASE WHEN p_partkey % 500 = 0 THEN 7999999 ELSE p_partkey * 3500 % 8000000 + CAST(10 ** (p_size % 6) AS BIGINT) - 1 END AS r_end, p_partkey FROM part) a ON f.chr = a.chr AND f.beg <= r_end AND f.end >= r_beg")
def nested_overlap_join(spark, sf):
    """Fragments and ranges of one base to a whole chromosome."""
    b, whole = F.expr("pos1 div 4000 * 4000"), F.col("p_partkey") % 500 == 0
    frags = settled(pairs(spark, sf).select(F.col("chr1").alias("chr"), b.alias("beg"), (b + 3999).alias("end")).distinct())
    start = F.col("p_partkey") * 3500 % 8000000
    end = start + F.pow(F.lit(10.0), F.col("p_size") % 6).cast("long") - 1
    ranges = spark.read.parquet(f"{sf}/part.parquet").select((F.col("p_partkey") % 4 + 1).cast("int").alias("chr"), F.when(whole, 0).otherwise(start).alias("r_beg"), F.when(whole, 7_999_999).otherwise(end).alias("r_end"), "p_partkey")
    return intervals.overlap_join(frags, ranges, 2_000).select("chr", "beg", "end", "p_partkey")


@query("SELECT chr, coalesce(lag(site) OVER (PARTITION BY chr ORDER BY site), 0) AS beg, site AS end, CAST(row_number() OVER (PARTITION BY chr ORDER BY site) - 1 AS INT) AS idx FROM (SELECT DISTINCT chr1 AS chr, pos1 // 4000 * 4000 AS site FROM pairs)")
def sites_to_fragments(spark, sf):
    sites = pairs(spark, sf).groupBy(F.col("chr1").alias("chr")).agg(F.array_sort(F.collect_set(F.expr("pos1 div 4000 * 4000"))).alias("sites"))
    return intervals.sites_to_fragments(sites)


@query("SELECT event_id, event_type FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE event_id % 2 = 0 AND event_id < (SELECT max(event_id) // 2 FROM events))")
def incremental_annotations(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    half = e.agg(F.expr("max(event_id) div 2").alias("half"))
    done = e.join(F.broadcast(half), F.col("event_id") < F.col("half")).filter("event_id % 2 = 0")
    return intervals.after_mark(e, done, "event_id").select("event_id", "event_type")


@query("SELECT event_type AS chr, event_id // 100 AS win, round(avg(value), 6) AS mean, round(max(value), 6) AS max FROM events GROUP BY ALL")
def track_window_mean_max(spark, sf):
    track = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("chr"), F.col("event_id").alias("start"), F.col("event_id").alias("end"), "value")
    return intervals.window_stats(track, 100).select("chr", "win", r6("mean"), r6("max"))


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def windowed_event_counts(spark, sf):
    from pairlattice.streaming.contacts import windowed_counts

    return windowed_counts(spark.read.parquet(f"{sf}/events.parquet"), "1 hour", "2 hours", "event_type").select("event_type", "start", "n")


@query("SELECT chr1, chr2, x, y, n FROM cells", (cells_sql(1_000_000),))
def stream_contact_counts(spark, sf):
    """The batch form of the streamed cell counts; tests run the stream itself to its end."""
    from pairlattice.streaming.contacts import stream_cells

    return stream_cells(pairs(spark, sf), 1_000_000).select("chr1", "chr2", "x", "y", "n")


@query("SELECT chr1, chr2, x, y, n FROM cells", (cells_sql(1_000_000),))
def stream_delta_counts(spark, sf):
    """Cell counts of a stream of order lines that is run to its end, kept as deltas by batch and a base."""
    from pairlattice.streaming.deltas import run_deltas

    schema = spark.read.parquet(f"{sf}/lineitem.parquet").schema
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{sf}/lineitem.parquet*")
    folder = stage_folder(spark, "stream")
    return run_deltas(pairs_of(lines), 1_000_000, f"{folder}/log", f"{folder}/counts", 3).select("chr1", "chr2", "x", "y", "n")


# ---- files: what a sink writes, its source reads back


def _sums(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("pos1").alias("pos1"), F.sum("pos2").alias("pos2"))


PAIR_SUMS = "count(*) AS n, CAST(sum(pos1) AS BIGINT) AS pos1, CAST(sum(pos2) AS BIGINT) AS pos2"


@query(f"SELECT chr1, chr2, strand1, strand2, {PAIR_SUMS}, CAST(sum(frag1 + frag2) AS BIGINT) AS frags FROM pairs GROUP BY ALL")
def text_pairs_round_trip(spark, sf):
    """Pairs written as gzipped lines, read back through the dictionary of names."""
    path = stage_folder(spark, "text")
    sinks.write_pairs_text(pairs(spark, sf), path, chroms(spark), "gzip")
    back = readers.read_pairs(spark, path, chroms(spark))
    return back.groupBy("chr1", "chr2", "strand1", "strand2").agg(F.count("*").alias("n"), F.sum("pos1").alias("pos1"), F.sum("pos2").alias("pos2"), F.sum((F.col("frag1") + F.col("frag2")).cast("long")).alias("frags"))


@query(f"SELECT 'chr' || chr1 AS chr1, 'chr' || chr2 AS chr2, {PAIR_SUMS} FROM pairs GROUP BY ALL")
def first_seen_names(spark, sf):
    """Pairs of a text file without a dictionary keep the names that stand there."""
    path = stage_folder(spark, "text")
    sinks.write_pairs_text(pairs(spark, sf), path, chroms(spark))
    return _sums(readers.read_pairs(spark, path), "chr1", "chr2")


@query(f"SELECT chr1, chr2, strand1, strand2, {PAIR_SUMS} FROM pairs GROUP BY ALL")
def binary_pairs_round_trip(spark, sf):
    """Full binary records, written by a committed sink and read in splits at record borders."""
    path = stage_folder(spark, "binary")
    write_pairs_binary(pairs(spark, sf), path, FULL)
    return _sums(readers.read_pairs(spark, f"{path}/*.bin"), "chr1", "chr2", "strand1", "strand2")


@query(f"SELECT chr1, chr2, {PAIR_SUMS}, CAST(sum(score) AS DOUBLE) AS score FROM pairs GROUP BY ALL")
def short_binary_pairs_round_trip(spark, sf):
    path = stage_folder(spark, "binary")
    write_pairs_binary(pairs(spark, sf), path, SHORT, "bn")
    return readers.read_pairs(spark, f"{path}/*.bn").groupBy("chr1", "chr2").agg(F.count("*").alias("n"), F.sum("pos1").alias("pos1"), F.sum("pos2").alias("pos2"), F.sum("score").alias("score"))


@query("SELECT resolution, chr1, chr2, x, y, n FROM cells WHERE chr1 = 1 AND chr2 IN (1, 3) AND n >= 2", (cells_sql(BIN),))
def matrix_set_round_trip(spark, sf):
    """Two matrices of a stored set, read by the folders of their keys and put together."""
    path = stage_folder(spark, "set")
    sinks.write_matrix_set(binning.bin_pairs(pairs(spark, sf), BIN), chroms(spark), path, least=2.0)
    keys = ("resolution", "chr1", "chr2", "x", "y", "n")
    return merge.union_all([sinks.read_cells(spark, path, BIN, 1, c).select(*keys) for c in (1, 3)])


@query("SELECT CAST(250000 AS INT) AS resolution, chr, bin, round(v, 6) AS v FROM (SELECT chr, bin, sum(n) AS v FROM halves GROUP BY ALL)", (INTRA, HALVES))
def stored_vectors_round_trip(spark, sf):
    path = stage_folder(spark, "norms")
    sums = rows.row_sums(_intra(spark, sf))
    sinks.write_norms(sums.select(F.lit("VC").alias("norm"), "resolution", "chr", "bin", "v"), path)
    return sinks.read_norms(spark, path, "VC", BIN).select(F.col("resolution").cast("int").alias("resolution"), "chr", "bin", r6("v"))


@query("SELECT idx AS chr, CAST(b AS BIGINT) AS bin, s.v FROM chroms CROSS JOIN range(33) r(b) LEFT JOIN (SELECT chr, bin, sum(n) AS v FROM halves GROUP BY ALL) s ON s.chr = idx AND s.bin = b", (INTRA, HALVES, CHROMS_SQL))
def vector_file_scan(spark, sf):
    """A file of vectors, a header and a value a line; bins without cells are written as a point."""
    path = stage_folder(spark, "vectors")
    sums = norms.none(chroms(spark), (BIN,)).drop("v").join(rows.row_sums(_intra(spark, sf)), ["resolution", "chr", "bin"], "left")
    values = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bin", F.coalesce(F.col("v").cast("string"), F.lit(".")).alias("v")))), lambda x: x["v"]), "\n")
    blocks = sums.groupBy("chr").agg(values.alias("values")).select(F.concat(F.lit("vector vc chr"), F.col("chr").cast("string"), F.lit(f" {BIN} bp\n"), "values").alias("value"))
    blocks.write.text(path)
    return readers.read_norm_vectors(spark, path, chroms(spark)).select("chr", "bin", F.nanvl("v", F.lit(None).cast("double")).alias("v"))


@query("SELECT u.label, u.value FROM (SELECT count(*) FILTER (fate = 'contact') AS contacts, count(*) FILTER (fate = 'contact' AND NOT intra) AS inter, count(*) FILTER (fate = 'contact' AND intra) AS intra FROM f WHERE threshold = 1) UNPIVOT (value FOR label IN (contacts, inter, intra)) u", (FATES,))
def report_round_trip(spark, sf):
    """Counts of a printed report, read back as an earlier report is."""
    path = stage_folder(spark, "report")
    row = qc.counts(pairs(spark, sf), (1,)).first()  # a row per threshold
    sinks.write_report(spark, sinks.stats_lines(row), path)
    return merge.parse_stats(readers.read_report_lines(spark, path)).filter(F.col("label").isin("contacts", "inter", "intra")).select("label", "value")


@query("SELECT name, CAST(sum(value) AS BIGINT) AS total FROM (SELECT 'D' AS name, count(*) AS value FROM f WHERE threshold = 1 AND fate = 'contact' AND intra) GROUP BY name", (FATES,))
def histogram_report_round_trip(spark, sf):
    """All distances of a histogram report: each intra contact stands in one class of one orientation."""
    path = stage_folder(spark, "hists")
    p = pairs(spark, sf)
    sinks.write_report(spark, sinks.histogram_lines(qc.mapq_histogram(p, (1,)), qc.orientation_histogram(p, (1,)), 1), path)
    return merge.parse_histograms(readers.read_whole(spark, path)).filter("name = 'D'").groupBy("name").agg(F.sum("value").alias("total"))


@query("SELECT count(*) AS n FROM pairs")
def line_counts(spark, sf):
    path = stage_folder(spark, "text")
    sinks.write_pairs_text(pairs(spark, sf), path)
    return readers.count_lines(spark, [path]).agg(F.sum("n").alias("n"))


@query("SELECT 'chr' || chr AS chr, coalesce(lag(site) OVER (PARTITION BY chr ORDER BY site), 0) AS beg, site AS end, CAST(row_number() OVER (PARTITION BY chr ORDER BY site) - 1 AS INT) AS idx FROM (SELECT DISTINCT chr1 AS chr, pos1 // 40000 * 40000 AS site FROM pairs)")
def site_file_scan(spark, sf):
    """Fragments from a file of a chromosome's sites in a line."""
    path = stage_folder(spark, "sites")
    sites = pairs(spark, sf).groupBy("chr1").agg(F.array_sort(F.collect_set(F.expr("pos1 div 40000 * 40000"))).alias("s"))
    sites.select(F.concat(F.lit("chr"), F.col("chr1").cast("string"), F.lit(" "), F.array_join(F.transform("s", lambda x: x.cast("string")), " ")).alias("value")).write.text(path)
    return intervals.sites_to_fragments(readers.read_sites(spark, path))


@query("SELECT 'chr' || (p_partkey % 4 + 1) AS chr, CAST(p_partkey * 100 AS BIGINT) AS beg, CAST(p_partkey * 100 + p_size AS BIGINT) AS end, 'part' || p_partkey AS name, CAST(p_size AS INT) AS score FROM part")
def annotation_file_scan(spark, sf):
    path = stage_folder(spark, "notes")
    s = lambda c: c.cast("string")
    k = F.col("p_partkey")
    lines = spark.read.parquet(f"{sf}/part.parquet").select(F.concat_ws(" ", F.concat(F.lit("chr"), s(k % 4 + 1)), s(k * 100), s(k * 100 + F.col("p_size")), F.concat(F.lit("part"), s(k)), s(F.col("p_size"))).alias("value"))
    lines.write.text(path)
    return readers.read_annotations(spark, path).select("chr", "beg", "end", "name", "score")


@query("SELECT event_type AS chr, event_id // 100 AS win, round(avg(CAST(value AS DOUBLE)), 6) AS mean, round(max(CAST(value AS DOUBLE)), 6) AS max FROM events GROUP BY ALL")
def bedgraph_scan(spark, sf):
    path = stage_folder(spark, "track")
    spark.read.parquet(f"{sf}/events.parquet").select("event_type", "event_id", F.col("event_id").alias("end"), "value").write.csv(path, sep="\t")
    return intervals.window_stats(readers.read_track(spark, path), 100).select("chr", "win", r6("mean"), r6("max"))


@query("SELECT a.x, a.y, round(a.n, 6) AS n FROM (SELECT x, y, n FROM c WHERE chr1 = 1 AND chr2 = 1) a", (cells_sql(BIN, "c"),))
def matrix_text_round_trip(spark, sf):
    path = stage_folder(spark, "matrix")
    sinks.write_matrix_text(rows.as_intra(binning.bin_pairs(pairs(spark, sf).filter("chr1 = 1 and chr2 = 1"), BIN)), path, "n")
    return spark.read.csv(path, sep="\t", schema="x long, y long, n double").select("x", "y", r6("n"))


@query("SELECT count(*) AS n, round(sum(v), 4) AS total FROM (SELECT bin, sum(n) AS v FROM halves WHERE chr = 2 GROUP BY ALL)", (INTRA, HALVES))
def vector_text_round_trip(spark, sf):
    path = stage_folder(spark, "vector")
    sinks.write_vector_text(rows.row_sums(_intra(spark, sf)).filter("chr = 2"), path)
    return spark.read.text(path).agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("double")), 4).alias("total"))


@query("SELECT x, y, round(r, 3) AS r FROM (SELECT x, y, corr(a.v, b.v) AS r FROM (SELECT p.b AS x, q.b AS y FROM range(8) p(b) CROSS JOIN range(8) q(b)) JOIN d a ON a.i = x JOIN d b ON b.i = y AND a.j = b.j GROUP BY ALL)",
       (cells_sql(1_000_000, "c", where="chr1 = 1 AND chr2 = 1"), "d AS (SELECT p.b AS i, q.b AS j, coalesce(max(n), 0) AS v FROM range(8) p(b) CROSS JOIN range(8) q(b) LEFT JOIN c ON (x = p.b AND y = q.b) OR (x = q.b AND y = p.b) GROUP BY ALL)"))
def tiled_matrix_round_trip(spark, sf):
    """Correlations as one tiled file, whose floats are read as records."""
    path = f"{stage_folder(spark, 'tiles')}/matrix.bin"
    c = rows.as_intra(binning.bin_pairs(pairs(spark, sf).filter("chr1 = 1 and chr2 = 1"), 1_000_000))
    sinks.write_matrix_tiles(corr.pearson(c, "n"), path, "g", "chr1", 1_000_000, 8, side=3)
    head = len(sinks.tile_header("g", "chr1", 1_000_000, 0.0, 0.0, 8, 3))
    whole = spark.read.format("binaryFile").load(path).select(F.substring("content", head + 1, 4 * 64).alias("body"))
    tile = F.expr("transform(sequence(0, 63), k -> k)")
    at = whole.select("body", F.explode(tile).alias("k")).select(F.substring("body", F.col("k") * 4 + 1, F.lit(4)).alias("f"), "k")

    def floats(frames):
        import struct

        for f in frames:
            f["r"] = [struct.unpack("<f", x)[0] for x in f.pop("f")]
            yield f

    # the k-th float lies in the tile whose rows and columns begin at multiples of 3 and are cut at 8
    spots = [(tx * 3 + i, ty * 3 + j) for tx in range(3) for ty in range(3) for i in range(min(3, 8 - 3 * tx)) for j in range(min(3, 8 - 3 * ty))]
    place = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(spots)], "k int, x long, y long")
    return at.mapInPandas(floats, "k int, r float").join(place, "k").filter(~F.isnan("r")).select("x", "y", F.round(F.col("r").cast("double"), 3).alias("r"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'chrM' ELSE 'chr' || p_partkey END AS name FROM part")
def track_names(spark, sf):
    """Names as tracks use them, from bare and prefixed ones."""
    key = F.col("p_partkey")
    name = F.when(key % 3 == 0, "MT").when(key % 3 == 1, F.concat(F.lit("chr"), key.cast("string"))).otherwise(key.cast("string"))
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", genome.track_name(name).alias("name"))
