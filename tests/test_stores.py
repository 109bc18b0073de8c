"""Repeatable JDBC inserts, stream deltas, bigWig scans, quantile sketches."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlattice.operators import binning, intervals, norms
from pairlattice.plans.fixture import pairs
from pairlattice.sources import jdbc, readers
from pairlattice.sources.bigwig import read_bigwig
from pairlattice.streaming import deltas
from pairlattice.streaming.contacts import stream_pairs

SF = "/root/testdata/sf0.001"


def test_inserts_may_be_repeated(spark):
    url = "jdbc:derby:memory:inserts;create=true"
    rows = lambda a, b: spark.range(a, b, 1, 3).select("id", F.concat(F.lit("n"), "id").alias("name"))
    ids = lambda: sorted(r["id"] for r in readers.read_jdbc(spark, url, 'SELECT "id", "name" FROM notes').collect())
    assert jdbc.insert_new(rows(0, 50), url, "notes", "id") == 50 and ids() == list(range(50)) and jdbc.mark_of(spark, url, "notes") == 49
    broken = rows(0, 90).withColumn("name", F.when(F.col("id") == 88, F.raise_error(F.lit("broken"))).otherwise(F.col("name")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        jdbc.insert_new(broken, url, "notes", "id")
    assert ids() == list(range(50))
    twice = rows(0, 90).unionByName(rows(60, 75))  # a task that wrote and was run again
    assert jdbc.insert_new(twice, url, "notes", "id") == 40 and ids() == list(range(90))
    assert jdbc.insert_new(twice, url, "notes", "id") == 0 and ids() == list(range(90)) and jdbc.mark_of(spark, url, "notes") == 89
    assert jdbc.insert_new(rows(0, 5), url, "others", "id") == 5
    dealt = readers.read_jdbc(spark, url, 'SELECT "id" FROM notes', '"id"', (0, 90), 4)
    assert dealt.rdd.getNumPartitions() == 4 and dealt.count() == 90


def test_a_stopped_stream_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    p = pairs(spark, SF)
    p.repartition(9).write.parquet(str(tmp_path / "in"))
    stream = lambda: stream_pairs(spark, str(tmp_path / "in"), p.schema, 1)
    out, real, seen = str(tmp_path / "out"), deltas.add_batches, []

    def failing(*args):
        add = real(*args)

        def run(batch, number):
            add(batch, number)
            seen.append(number)
            if number in (2, 4) and seen.count(number) == 1:  # after its delta, or the base that holds it, was written
                raise RuntimeError("stopped")

        return run

    monkeypatch.setattr(deltas, "add_batches", failing)
    for _ in range(2):
        with pytest.raises(Exception, match="stopped"):
            deltas.run_deltas(stream(), 1_000_000, str(tmp_path / "ck"), out, 5)
    counts = deltas.run_deltas(stream(), 1_000_000, str(tmp_path / "ck"), out, 5)
    assert seen.count(2) == seen.count(4) == 2 and max(seen) == 8
    want = binning.bin_pairs(p, 1_000_000)
    assert counts.exceptAll(want).isEmpty() and want.exceptAll(counts).isEmpty()
    assert sorted(x.name for x in (tmp_path / "out/base").iterdir()) == ["upto=4"]
    deltas.compact(spark, out)
    assert deltas.read_counts(spark, out).exceptAll(want).isEmpty() and not list((tmp_path / "out/delta").iterdir())
    (tmp_path / "out/base/upto=99").mkdir()  # a base that was not finished
    assert deltas.read_counts(spark, out).count() == want.count()


def bigwig(path, sections, names, per_leaf, packed):
    """Writes sections (chromosome, kind, step, span, rows) with an index of leaves of per_leaf entries, and one inner node above."""
    width = max(map(len, names)) + 1
    tree = struct.pack("<IIIIQQ", 0x78CA8C91, 256, width, 8, len(names), 0) + struct.pack("<BBH", 1, 0, len(names)) + b"".join(n.encode().ljust(width, b"\0") + struct.pack("<II", i, 10**6) for i, n in enumerate(names))
    at, data, blocks = 64 + len(tree), b"", []
    for chrom, kind, step, span, rows in sections:
        body = b"".join(struct.pack("<IIf", *r) if kind == 1 else struct.pack("<If", r[0], r[2]) if kind == 2 else struct.pack("<f", r[2]) for r in rows)
        raw = struct.pack("<IIIIIBBH", chrom, rows[0][0], rows[-1][1], step, span, kind, 0, len(rows)) + body
        raw = zlib.compress(raw) if packed else raw
        blocks.append((chrom, rows[0][0], chrom, rows[-1][1], at + len(data), len(raw)))
        data += raw
    index = at + len(data)
    leaves = [blocks[i : i + per_leaf] for i in range(0, len(blocks), per_leaf)]
    inner = 4 + 24 * len(leaves)
    places = np.cumsum([index + 48 + inner] + [4 + 32 * len(x) for x in leaves])
    tree2 = struct.pack("<BBH", 0, 0, len(leaves)) + b"".join(struct.pack("<IIIIQ", *x[0][:2], *x[-1][2:4], p) for x, p in zip(leaves, places))
    tree2 += b"".join(struct.pack("<BBH", 1, 0, len(x)) + b"".join(struct.pack("<IIIIQQ", *b) for b in x) for x in leaves)
    head = struct.pack("<IHHQQQHHQQIQ", 0x888FFC26, 4, 0, 64, at, index, 0, 0, 0, 0, 32768 if packed else 0, 0)
    path.write_bytes(head + tree + data + struct.pack("<IIQIIIIQII", 0x2468ACE0, 256, len(blocks), 0, 0, 1, 10**6, index, per_leaf, 0) + tree2)


@pytest.mark.parametrize("packed", [True, False])
def test_a_bigwig_gives_the_rows_of_its_bedgraph(spark, tmp_path, packed):
    rng, sections, rows = np.random.default_rng(3), [], []
    for i in range(23):
        chrom, kind, start = i // 12, i % 3 + 1, 1000 * i
        n = int(rng.integers(1, 9))
        step = 7
        at = start + step * np.arange(n) if kind != 1 else np.sort(rng.choice(500, n, replace=False)) + start
        own = [(int(a), int(a) + (5 if kind != 1 else 1), float(np.float32(rng.normal()))) for a in at]
        sections.append((chrom, kind, step, 5, own))
        rows += [(f"chr{chrom + 1}", *r) for r in own]
    bigwig(tmp_path / "t.bw", sections, ["chr1", "chr2"], 4, packed)
    (tmp_path / "t.bg").write_text("".join(f"{c}\t{a}\t{b}\t{v!r}\n" for c, a, b, v in rows))
    assert readers.read_track(spark, str(tmp_path / "t.bw")).count() == len(rows)
    got = read_bigwig(spark, str(tmp_path / "t.bw"), leaves_a_task=2)
    assert got.rdd.getNumPartitions() == 3
    bed = readers.read_track(spark, str(tmp_path / "t.bg"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bed.collect())) == sorted(rows)
    assert sorted(map(tuple, intervals.window_stats(got, 500).collect())) == sorted(map(tuple, intervals.window_stats(bed, 500).collect()))
    with pytest.raises(ValueError):
        read_bigwig(spark, str(tmp_path / "t.bg"))


def test_sketched_percentiles_are_within_their_error(spark):
    rng = np.random.default_rng(2)
    values = rng.lognormal(1, 1.5, 60_000)
    cells = spark.createDataFrame([(1, 1, 1, i, i, float(v)) for i, v in enumerate(values)], "resolution int, chr1 int, chr2 int, x long, y long, n double").repartition(5)
    exact = binning.totals(cells).first()
    sketches = [binning.count_sketches(part) for part in cells.randomSplit([0.3, 0.7], 1)]
    got = binning.sketched_percentiles(sketches[0].unionByName(sketches[1]), (0.05, 0.5, 0.95)).first()
    for q, v in zip((0.05, 0.5, 0.95), got["values"]):
        assert abs((values <= v).mean() - q) <= binning.SKETCH_ERROR
    assert got["n"] == exact["occupied"] and abs(np.searchsorted(np.sort(values), exact["p95"]) / len(values) - 0.95) < 1e-3


def test_alignment_predicate_of_every_case(spark):
    good = {"paired": True, "mapped": True, "mate_mapped": True, "mapq": 5, "chr": "1", "mate_chr": "1", "insert_size": 5000, "pos": 10, "mate_pos": 5010}
    odd = [{"paired": False}, {"mapped": False}, {"mate_mapped": False}, {"mapq": 0}, {"insert_size": 1000}, {"insert_size": -900}, {"pos": 9000}, {"mate_chr": "0"}]
    fine = [{}, {"insert_size": -1001}, {"mate_chr": "2", "insert_size": 0, "pos": 9000}, {"pos": 5010}]
    df = spark.createDataFrame([(i, *(good | x).values()) for i, x in enumerate(odd + fine)], "i int, paired boolean, mapped boolean, mate_mapped boolean, mapq int, chr string, mate_chr string, insert_size long, pos long, mate_pos long")
    assert sorted(r["i"] for r in intervals.sam_contacts(df).collect()) == list(range(len(odd), len(odd) + len(fine)))


def test_a_chromosome_that_fails_is_left_out_at_finer_sizes(spark):
    """A core and a tenth or more of bins that hang on it by one cell: no balancing at the coarse size, so none at the fine one."""
    size, pendants = 60, 12
    core = [(x, y, 5.0) for x in range(size) for y in range(x, size)]
    hanging = [(0, size + i, 1.0) for i in range(pendants)]
    fine = [(x, y, 4.0) for x in range(30) for y in range(x, 30)]
    rows = [(2000, 1, *c) for c in core + hanging] + [(1000, 1, *c) for c in fine] + [(r, 2, *c) for r in (1000, 2000) for c in fine]
    cells = spark.createDataFrame(rows, "resolution int, chr int, x long, y long, n double")
    chroms = spark.createDataFrame([(1, 2000 * (size + pendants) - 1), (2, 60_000)], "idx int, length long")
    done = {(r["resolution"], r["chr"]) for r in norms.scale(cells, chroms, (1000, 2000)).select("resolution", "chr").distinct().collect()}
    assert done == {(1000, 2), (2000, 2)}
    alone = {(r["resolution"], r["chr"]) for r in norms.scale(cells, chroms, (1000,)).select("resolution", "chr").distinct().collect()}
    assert alone == {(1000, 1), (1000, 2)}
