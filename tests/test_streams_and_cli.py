import re
import struct

import numpy as np
import pytest

from pairlattice import cli
from pairlattice.operators.binning import bin_pairs
from pairlattice.plans.fixture import pairs
from pairlattice.sources import sinks
from pairlattice.streaming.contacts import run_to_end, stream_cells, stream_pairs

SF = "/root/testdata/sf0.001"


def test_streamed_cells_equal_the_batch(spark, tmp_path):
    p = pairs(spark, SF)
    p.repartition(5).write.parquet(str(tmp_path / "in"))
    cells = stream_cells(stream_pairs(spark, str(tmp_path / "in"), p.schema, 2), 1_000_000)
    got = run_to_end(cells, str(tmp_path / "ck"), str(tmp_path / "out"))
    want = bin_pairs(p, 1_000_000)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_commands_run_end_to_end(spark, tmp_path, capsys):
    p = pairs(spark, SF)
    (tmp_path / "g.txt").write_text("".join(f"{i}\t8000000\n" for i in range(1, 5)))
    sinks.write_pairs_text(p, str(tmp_path / "pairs"))
    out = str(tmp_path / "set")
    assert cli.main(["pre", str(tmp_path / "pairs"), out, "-g", str(tmp_path / "g.txt"), "-r", "1000000,2500000", "-k", "VC,SCALE,GW_VC", "-q", "0"]) == 0
    whole = sinks.read_cells(spark, out).filter("chr1 = 0")
    assert whole.agg({"n": "sum"}).first()[0] == p.count() and spark.read.parquet(f"{out}/chromosomes").filter("idx = 0").first()["name"] == "All"
    for name in ("raw", "VC", "SCALE", "GW_VC"):
        assert spark.read.parquet(f"{out}/{name}_1000000/expected").filter("density > 0").count() > 0
    assert {r["norm"] for r in spark.read.parquet(f"{out}/norms").select("norm").distinct().collect()} == {"VC", "SCALE", "GW_VC"}
    assert cli.main(["sum", str(tmp_path / "twice"), out, out]) == 0
    a, b = sinks.read_cells(spark, out, 1_000_000).agg({"n": "sum"}).first()[0], sinks.read_cells(spark, str(tmp_path / "twice"), 1_000_000).agg({"n": "sum"}).first()[0]
    assert b == 2 * a
    assert cli.main(["eigenvector", out, "1", "1000000", str(tmp_path / "e")]) == 0
    assert cli.main(["pearsons", out, "1", "1000000", str(tmp_path / "r")]) == 0
    assert cli.main(["pearsons", out, "1", "1000000", str(tmp_path / "t"), "-b"]) == 0
    data = (tmp_path / "t").read_bytes()
    header = len(data) - 4 * 9 * 9
    assert data[:4] == b"hic\0" and data[header - 12 : header] == struct.pack("<iii", 9, 9, 500)
    tile = np.frombuffer(data[header:], "<f4").reshape(9, 9)
    assert np.allclose(tile[:8, :8], tile[:8, :8].T) and np.allclose(np.diag(tile)[:8], 1)
    assert cli.main(["statistics", str(tmp_path / "pairs"), "-o", str(tmp_path / "report")]) == 0
    assert "Hi-C Contacts" in capsys.readouterr().out
    reports = [str(tmp_path / f"report_{q}{x}") for q in (1, 30) for x in (".txt", "_hists.m")]
    assert cli.main(["mergestats", str(tmp_path / "m.txt"), reports[0], reports[2]]) == 0
    assert cli.main(["mergehists", str(tmp_path / "m_hists.m"), reports[1], reports[3]]) == 0
    number = lambda path: int(re.search(r"Hi-C Contacts: *([0-9,]+)", open(path).read())[1].replace(",", ""))
    assert number(tmp_path / "m.txt") == number(reports[0]) + number(reports[2])
    rows = lambda path, name: np.array([list(map(int, x.split())) for x in re.search(name + r" = \[\n(.*?)\n\]", open(path).read(), re.S)[1].split("\n")])
    for name, shape in (("B", (200, 3)), ("D", (100, 4))):
        assert rows(tmp_path / "m_hists.m", name).shape == shape
        assert (rows(tmp_path / "m_hists.m", name) == rows(reports[1], name) + rows(reports[3], name)).all()
    assert (rows(tmp_path / "m_hists.m", "x") == rows(reports[1], "x")).all()


def test_reports_of_two_read_types_do_not_mix(spark, tmp_path):
    for name, kind in (("a", "Single End"), ("b", "Paired End"), ("c", "Paired End")):
        (tmp_path / name).write_text(f"Read type: {kind}\nHi-C Contacts: 1,000 (5%)\n")
    with pytest.raises(ValueError):
        cli.main(["mergestats", str(tmp_path / "m"), str(tmp_path / "a"), str(tmp_path / "b")])
    assert cli.main(["mergestats", str(tmp_path / "m"), str(tmp_path / "b"), str(tmp_path / "c")]) == 0
    assert (tmp_path / "m").read_text().splitlines()[:2] == ["Read type: Paired End", "Hi-C Contacts: 2,000"]


SINGLE = """Read type: Single End
Sequenced Reads: 1,000
No chimera found: 10 (1.00%)
0 alignments: 100 (10.00%)
1 alignment: 400 (40.00%)
	1 alignment unique: 300 (30.00% / 75.00%)
	1 alignment duplicates: 100 (10.00% / 25.00%)
2 alignments: 480 (48.00%)
	2 alignment unique: 400 (40.00% / 83.33%)
	2 alignment duplicates: 80 (8.00% / 16.67%)
3 or more alignments: 10 (1.00%)
Ligation Motif Present: 200 (20.00%)
Total Unique: 700 (70.00% / 79.55%)
Total Duplicates: 180 (18.00% / 20.45%)
Below MAPQ Threshold: 40 (4.00% / 10.00%)
Hi-C Contacts: 360 (36.00% / 90.00%)
	Pair Type %(L-I-O-R): 25% - 25% - 25% - 25%
	L-I-O-R Convergence: 1,000
Inter-chromosomal: 60 (6.00% / 15.00%)
Intra-chromosomal: 300 (30.00% / 75.00%)
Short Range (<20Kb):
	<500BP: 50 (5.00% / 12.50%)
Long Range (>20Kb): 250 (25.00% / 62.50%)
"""


def test_merged_single_end_report(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_text(SINGLE)
    assert cli.main(["mergestats", str(tmp_path / "m"), str(tmp_path / "a"), str(tmp_path / "b")]) == 0
    double = re.sub(r"(: )([\d,]+)(?= \(|$)", lambda m: f"{m[1]}{2 * int(m[2].replace(',', '')):,}", SINGLE, flags=re.M)
    assert (tmp_path / "m").read_text() == double.replace("Convergence: 2,000", "Convergence: 1,000")


def test_shares_of_an_earlier_report(spark, tmp_path, capsys):
    (tmp_path / "g.txt").write_text("".join(f"chr{i}\t8000000\n" for i in range(1, 5)))
    sinks.write_pairs_text(pairs(spark, SF), str(tmp_path / "pairs"))
    (tmp_path / "old.txt").write_text("Sequenced Read Pairs: 20,000\nUnique Reads: 10,000\n")
    assert cli.main(["statistics", str(tmp_path / "pairs"), "--mapqs", "1", "--earlier", str(tmp_path / "old.txt")]) == 0
    out = capsys.readouterr().out
    n = int(re.search(r"Hi-C Contacts: *([0-9,]+)", out)[1].replace(",", ""))
    assert "Sequenced Read Pairs: 20,000" in out and f"Hi-C Contacts: {n:,} ({n / 200:.2f}% / {n / 100:.2f}%)" in out


def test_normalised_matrices_vectors_and_export(spark, tmp_path):
    (tmp_path / "g.txt").write_text("".join(f"chr{i}\t8000000\n" for i in range(1, 5)))
    sinks.write_pairs_text(pairs(spark, SF), str(tmp_path / "pairs"))
    set_ = str(tmp_path / "set")
    assert cli.main(["pre", str(tmp_path / "pairs"), set_, "-g", str(tmp_path / "g.txt"), "-r", "1000000", "-k", "VC,SCALE"]) == 0
    chrom = spark.read.parquet(f"{set_}/chromosomes").filter("idx = 1").first()["name"]
    for norm in ("NONE", "VC"):
        assert cli.main(["pearsons", set_, chrom, "1000000", str(tmp_path / norm), "-k", norm]) == 0
    table = lambda name: spark.read.csv(str(tmp_path / name), sep="\t", schema="x long, y long, r double")
    both = table("NONE").alias("a").join(table("VC").alias("b"), ["x", "y"]).selectExpr("a.r as r", "b.r as s").collect()
    assert len(both) == 36 and all(abs(x["s"]) <= 1 + 1e-9 for x in both) and any(abs(x["r"] - x["s"]) > 1e-3 for x in both)
    assert cli.main(["testnorm", set_, chrom, "1000000", str(tmp_path / "v")]) == 0
    stored = {r["bin"]: r["v"] for r in sinks.read_norms(spark, set_, "SCALE", 1_000_000).filter("chr = 1").collect()}
    text = [float(r["value"]) for r in spark.read.text(str(tmp_path / "v")).collect()]
    assert len(text) == 9 and all(np.isclose(text[b], v) for b, v in stored.items()) and np.isnan([text[b] for b in range(9) if b not in stored]).all()
    assert cli.main(["sum", str(tmp_path / "near"), set_, "--near-diagonal"]) == 0
    near = sinks.read_cells(spark, str(tmp_path / "near")).filter("chr1 > 0")
    assert near.filter("chr1 <> chr2").isEmpty() and not near.isEmpty()
    assert cli.main(["export", set_, str(tmp_path / "one")]) == 0
    from test_container import Reader

    r = Reader((tmp_path / "one").read_bytes())
    r.head()
    r.footer()
    assert {k[0] for k in r.vectors()} == {"VC", "SCALE"} and len(r.raw) == 1 and {e[0] for e in r.normed} == {"VC", "SCALE"}
    assert "0_0" in r.index and "1_1" in r.index


def test_complexity_of_a_folder(spark, tmp_path, capsys):
    for name, n in (("merged_nodups", 900), ("dups", 100), ("opt_dups", 10)):
        (tmp_path / f"{name}.txt").write_text("x\n" * n)
    assert cli.main(["librarycomplexity", str(tmp_path)]) == 0
    scanned = capsys.readouterr().out
    assert cli.main(["librarycomplexity", str(tmp_path / "merged_nodups.txt"), str(tmp_path / "dups.txt"), "--optical", "10"]) == 0
    assert capsys.readouterr().out == scanned and "Optical Duplicates: 10 (1.00%)" in scanned


def test_binary_pairs_back_to_text(spark, tmp_path):
    p = pairs(spark, SF).limit(50)
    (tmp_path / "g.txt").write_text("".join(f"chr{i}\t8000000\n" for i in range(1, 5)))
    sinks.write_pairs_text(p, str(tmp_path / "text"))
    assert sinks.pairs_as_text(p, with_mapq=True).first()["value"].count("\t") == 10
    assert sinks.pairs_as_text(p).first()["value"].count("\t") == 8


def test_thread_rule():
    assert cli.threads(-2, 4) == 8 and cli.threads(3, 4) == 3
