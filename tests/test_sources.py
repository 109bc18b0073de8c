"""Every text and binary layout, norm vectors, reports, sinks."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlattice.functions.genome import block_columns, chromosomes, whole_genome_bin_size, with_all
from pairlattice.functions.pairs import DISTANCES, clamp, distance_bin
from pairlattice.functions.scalars import library_size
from pairlattice.operators import binning, intervals, merge, qc
from pairlattice.plans.fixture import pairs
from pairlattice.sources import readers, sinks
from pairlattice.sources.pairs_binary import FULL, SHORT, write_pairs_binary

SF = "/root/testdata/sf0.001"
LAYOUTS = {
    "super_short": "chr1 100 chr1 5000",
    "scored": "chr1 100 chr2 5000 2.5",
    "short": "0 chr1 100 0 16 chr1 5000 1",
    "short_scored": "0 chr1 100 0 16 chr1 5000 1 3.0",
    "medium": "r1 0 chr1 100 0 16 chr1 5000 1 60 30",
    "long": "0 chr1 100 0 16 chr1 5000 1 60 5M GATCA 30 5M TTGAT r1 r1",
    "headed": "## pairs format v1.0\n#columns: readID chr1 pos1 chr2 pos2 strand1 strand2 mapq1 mapq2\n#another\nr1 chr1 100 chr1 5000 + - 60 30",
}


@pytest.fixture
def dictionary(spark):
    return chromosomes(spark, [("chr1", 1000), ("chr2", 8_000_000)])


@pytest.mark.parametrize("name", sorted(LAYOUTS))
@pytest.mark.parametrize("zipped", [False, True])
def test_text_layouts(name, zipped, spark, tmp_path, dictionary):
    path = tmp_path / ("p.txt.gz" if zipped else "p.txt")
    text = (LAYOUTS[name] + "\n").encode()
    path.write_bytes(gzip.compress(text) if zipped else text)
    r = readers.read_pairs(spark, str(path), dictionary).collect()
    assert len(r) == 1 and (r[0]["chr1"], r[0]["pos1"], r[0]["pos2"]) == (1, 100, 5000)
    assert r[0]["strand1"] is True and r[0]["strand2"] is False
    assert r[0]["mapq1"] == (60 if name in ("medium", "long", "headed") else 1000)
    assert r[0]["is_short"] == (name not in ("medium", "long", "headed"))
    assert r[0]["score"] == {"scored": 2.5, "short_scored": 3.0}.get(name, 1.0)
    assert r[0]["seq1"] == ("GATCA" if name == "long" else None)


def test_odd_column_count_is_refused(spark, tmp_path):
    (tmp_path / "p.txt").write_text("a b c d e f g\n")
    with pytest.raises(ValueError):
        readers.read_pairs(spark, str(tmp_path / "p.txt"))


def test_unknown_chromosomes_are_dropped_and_positions_clamped(spark, tmp_path, dictionary):
    (tmp_path / "p.txt").write_text("chr1 -5 1 5000\nchrUn 1 chr1 2\n\n")
    r = clamp(readers.read_pairs(spark, str(tmp_path / "p.txt"), dictionary), dictionary).collect()
    assert [(x["pos1"], x["pos2"]) for x in r] == [(0, 1000)]


@pytest.mark.parametrize("layout,suffix", [(FULL, "bin"), (SHORT, "bn")])
def test_binary_round_trip(layout, suffix, spark, tmp_path):
    p = pairs(spark, SF).repartition(3)
    write_pairs_binary(p, str(tmp_path / "out"), layout, suffix)
    keys = [c for c in layout.names]
    for f in sorted((tmp_path / "out").glob("part-*")):
        assert f.stat().st_size % layout.itemsize == 0
    back = readers.read_pairs(spark, f"{tmp_path}/out/*.{suffix}")
    want = p.select(*keys).groupBy(*keys).count()
    assert back.select(*keys).groupBy(*keys).count().exceptAll(want).isEmpty() and back.count() == p.count()


def test_binary_files_are_split_at_record_borders(spark, tmp_path):
    path = tmp_path / "large.bin"
    with open(path, "wb") as f:
        f.truncate(3_000_000_000 // FULL.itemsize * FULL.itemsize)  # a sparse file
    assert readers.read_pairs(spark, str(path)).rdd.getNumPartitions() > 50
    small = tmp_path / "small.bn"
    records = np.zeros(10_000, SHORT)
    records["pos1"] = np.arange(10_000)
    small.write_bytes(records.tobytes())
    conf, key = spark.sparkContext._jsc.hadoopConfiguration(), "mapreduce.input.fileinputformat.split.maxsize"
    conf.set(key, "7777")
    try:
        back = readers.read_pairs(spark, str(small))
        assert back.rdd.getNumPartitions() == -(-10_000 // (7777 // SHORT.itemsize))
        assert sorted(r["pos1"] for r in back.select("pos1").collect()) == list(range(10_000))
    finally:
        conf.unset(key)


def test_a_failed_binary_write_leaves_nothing(spark, tmp_path):
    p = pairs(spark, SF).repartition(3)
    broken = p.withColumn("pos1", F.when(F.col("l_orderkey") == p.agg(F.max("l_orderkey")).first()[0], F.raise_error(F.lit("broken"))).otherwise(F.col("pos1")).cast("long"))
    folder = tmp_path / "out"
    with pytest.raises(Exception, match="broken"):
        write_pairs_binary(broken, str(folder), FULL)
    assert not folder.exists() or not [x for x in folder.rglob("*") if x.is_file()]
    write_pairs_binary(p, str(folder), FULL)
    once = {x.name for x in folder.iterdir()}
    assert "_SUCCESS" in once and len(once) == 4
    with pytest.raises(Exception, match="broken"):
        write_pairs_binary(broken, str(folder), FULL)
    assert {x.name for x in folder.iterdir()} == once  # what was there before stays
    write_pairs_binary(p, str(folder), FULL)
    assert readers.read_pairs(spark, f"{folder}/*.bin").count() == p.count()


def test_text_sink_round_trip(spark, tmp_path):
    names = chromosomes(spark, [(f"chr{i}", 8_000_000) for i in range(1, 5)])
    p = pairs(spark, SF)
    sinks.write_pairs_text(p, str(tmp_path / "t"), names)
    cells = lambda d: binning.bin_pairs(d, 1_000_000)
    assert cells(readers.read_pairs(spark, str(tmp_path / "t"), names)).exceptAll(cells(p)).isEmpty()


def test_norm_vectors(spark, tmp_path):
    d = chromosomes(spark, [("chr1", 1000), ("chr2", 2000)])
    (tmp_path / "v.txt").write_text("vector KR chr1 500 BP\n1.5\nnan\n.\nvector KR chrX 500 BP\n1\nvector VC 2 1000 BP\n2\n3\n")
    r = readers.read_norm_vectors(spark, str(tmp_path / "v.txt"), d).orderBy("norm", "chr", "bin").collect()
    assert [(x["norm"], x["chr"], x["bin"]) for x in r] == [("KR", 1, 0), ("KR", 1, 1), ("KR", 1, 2), ("VC", 2, 0), ("VC", 2, 1)]
    assert r[0]["v"] == 1.5 and r[1]["v"] != r[1]["v"] and r[2]["v"] != r[2]["v"]
    (tmp_path / "w.txt").write_text("vector KR chr1 500 BP\n1\n1\n1\n1\n")
    with pytest.raises(Exception, match="more values"):
        readers.read_norm_vectors(spark, str(tmp_path / "w.txt"), d).collect()


def test_matrix_set_and_norms(spark, tmp_path):
    names = chromosomes(spark, [(f"chr{i}", 8_000_000) for i in range(1, 5)])
    cells = binning.multi_resolution(pairs(spark, SF), (1_000_000, 2_500_000))
    sinks.write_matrix_set(cells, with_all(names), str(tmp_path / "m"), {"genome": "x"})
    back = sinks.read_cells(spark, str(tmp_path / "m"), 1_000_000, 1, 2)
    assert "PartitionFilters: [isnotnull" in back._jdf.queryExecution().toString()
    want = cells.filter("resolution = 1000000 and chr1 = 1 and chr2 = 2")
    assert back.select("x", "y", "n").exceptAll(want.select("x", "y", "n")).isEmpty() and back.count() == want.count()
    v = lambda norm, x: spark.createDataFrame([(norm, 1, 1, 0, x)], "norm string, resolution int, chr int, bin long, v double")
    for norm, x in (("VC", 1.0), ("SCALE", 2.0), ("VC", 3.0)):
        sinks.write_norms(v(norm, x), str(tmp_path / "m"))
    assert {(r["norm"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/m/norms").collect()} == {("VC", 3.0), ("SCALE", 2.0)}


def test_reports(spark, tmp_path):
    p = pairs(spark, SF)
    row = qc.counts(p, (1,)).first()
    lines = sinks.stats_lines(row, settled_bin=5)
    assert any(x.startswith("Hi-C Contacts: ") for x in lines) and f" L-I-O-R Convergence: {DISTANCES[5]}" in lines
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("\n".join(lines))
    merged = {r["label"]: r["value"] for r in merge.merge_stats(merge.parse_stats(readers.read_report_lines(spark, str(tmp_path / "*.txt")))).collect()}
    assert merged["contacts"] == 2 * row["contacts"] and merged["convergence"] == DISTANCES[5] and merged["inter"] == 2 * row["inter"]
    assert any("Hi-C Contacts: " in x for x in sinks.merged_report_lines(merged))
    hist = sinks.histogram_lines(qc.mapq_histogram(p), qc.orientation_histogram(p), 1)
    (tmp_path / "h.m").write_text("\n".join(hist))
    arrays = merge.parse_histograms(readers.read_whole(spark, str(tmp_path / "h.m")))
    assert {r["name"]: r["n"] for r in arrays.groupBy("name").agg(F.count("*").alias("n")).collect()} == {"A": 2000, "B": 600, "D": 400, "x": 100}


def test_earlier_report_values(spark, tmp_path):
    (tmp_path / "s.txt").write_text("Sequenced Read Pairs:  1,234\n Unique: 99 (8%)\n1 Alignment Unique: 5\nOptical Duplicates: 7\nTotal Duplicates: 8\nUnique again: 1\n")
    got = {r["label"]: r["value"] for r in readers.earlier_values(readers.read_report_lines(spark, str(tmp_path / "s.txt"))).collect()}
    assert got == {"sequenced": 1234, "unique": 99, "single_unique": 5, "duplicates": 8}


def test_small_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("chr1 5 10 name 3\n")
    (tmp_path / "s.txt").write_text("chr1 100 250 300\nchr2 7\n")
    (tmp_path / "t.bg").write_text("track x\nchr1\t0\t10\t1.5\n")
    (tmp_path / "i.csv").write_text("chr1-chr2,x,10,20\n")
    assert readers.read_annotations(spark, str(tmp_path / "a.txt")).first()["score"] == 3
    f = intervals.sites_to_fragments(readers.read_sites(spark, str(tmp_path / "s.txt"))).orderBy("chr", "idx").collect()
    assert [(r["beg"], r["end"]) for r in f] == [(0, 100), (100, 250), (250, 300), (0, 7)]
    assert readers.read_track(spark, str(tmp_path / "t.bg")).collect()[0]["value"] == 1.5
    assert readers.read_range_index(spark, str(tmp_path / "i.csv")).first()["start"] == 10


def test_windows_include_the_last_and_the_empty(spark):
    t = spark.createDataFrame([("c", 0, 10, 1.0), ("c", 305, 306, -2.0)], "chr string, start long, end long, value double")
    d = {r["win"]: r["max"] for r in intervals.dense_windows(intervals.window_stats(t, 100)).collect()}
    assert d == {0: 1.0, 1: None, 2: None, 3: -2.0}


def test_scalars(spark):
    r = spark.range(1).select(library_size(F.lit(20000), F.lit(80000)).alias("a"), library_size(F.lit(0), F.lit(5)).alias("b"), distance_bin(F.lit(10)).alias("c"), distance_bin(F.lit(11)).alias("d"), distance_bin(F.lit(10**11)).alias("e")).first()
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == (215418, 0, 0, 1, 100)
    assert len(DISTANCES) == 100 and DISTANCES[:5] == (10, 12, 15, 19, 23) and DISTANCES[-1] == 10**10
    assert whole_genome_bin_size(32_000_000) == 64 and block_columns(8_000_000, 250_000, True) == 1
    assert block_columns(249_250_621, 100, True) == 499


def test_matrix_tiles(spark):
    import numpy as np

    m = spark.createDataFrame([(0, 0, 1.0), (3, 1, 2.5), (4, 4, 3.0)], "x long, y long, r double")
    tiles = {(r["tx"], r["ty"]): np.frombuffer(r["content"], "<f4").reshape(4, 4) for r in sinks.matrix_tiles(m, side=4).collect()}
    assert set(tiles) == {(0, 0), (1, 1)} and tiles[0, 0][3, 1] == 2.5 and np.isnan(tiles[1, 1][1, 1]) and tiles[1, 1][0, 0] == 3


def test_a_tiled_matrix_is_one_file(spark, tmp_path):
    rng = np.random.default_rng(2)
    m = np.triu(rng.normal(size=(23, 23)))
    m[:, 9] = m[9, :] = np.nan
    full = np.triu(m) + np.triu(m, 1).T
    cells = spark.createDataFrame([(int(x), int(y), float(m[x, y])) for x, y in zip(*np.triu_indices(23)) if not np.isnan(m[x, y]) and not (x < 5 and 10 <= y < 15)], "x long, y long, r double").repartition(3)
    full[:5, 10:15] = full[10:15, :5] = np.nan
    path = tmp_path / "m.bin"
    sinks.write_matrix_tiles(cells, str(path), "g1", "chrX", 1000, 23, side=5)
    data = path.read_bytes()
    lo, hi = np.nanmin(full), np.nanmax(full)
    header = b"hic\0" + struct.pack("<i", 1) + b"g1\0chrX\0chrX\0" + struct.pack("<iffiii", 1000, lo, hi, 23, 23, 5)
    body = b"".join(full[i : i + 5, j : j + 5].astype("<f4").tobytes() for i in range(0, 23, 5) for j in range(0, 23, 5))
    assert data[: len(header)] == header and len(data) == len(header) + len(body)
    assert np.array_equal(np.frombuffer(data[len(header) :], "<f4"), np.frombuffer(body, "<f4"), equal_nan=True)
    assert [x.name for x in tmp_path.iterdir()] == ["m.bin"]


def test_overlaps_of_ranges_of_any_length(spark):
    rng = np.random.default_rng(8)
    ranges = lambda n: [(int(c), int(a), int(a + 10 ** rng.uniform(0, 7) - 1)) for c, a in zip(rng.integers(1, 3, n), rng.integers(0, 5_000_000, n))] + [(1, 0, 10_000_000), (2, 7, 7), (2, 9, 3), (1, 16_384, 16_384), (1, 16_383, 16_384)]
    left, right = ranges(300), ranges(200)
    a = spark.createDataFrame([(*r, i) for i, r in enumerate(left)], "chr int, beg long, end long, i int")
    b = spark.createDataFrame([(*r, j) for j, r in enumerate(right)], "chr int, r_beg long, r_end long, j int")
    got = [(r["i"], r["j"]) for r in intervals.overlap_join(a, b, 16).collect()]
    want = {(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1] and x[1] <= x[2] and y[1] <= y[2]}
    assert len(got) == len(set(got)) and set(got) == want


def test_long_ranges_meet_in_several_tasks(spark):
    a = spark.range(2000).selectExpr("1 chr", "id * 4000 beg", "id * 4000 + 3999 end")
    b = spark.range(40).selectExpr("1 chr", "0L r_beg", "7999999L r_end", "id j")
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        counts = [r["count"] for r in intervals.overlap_join(a, b, 2000).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(counts) == 80_000 and max(counts) <= 40_000
