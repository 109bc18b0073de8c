"""Command line: ``python -m pairlattice.cli COMMAND ...``, one command per pipeline of the library."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlattice.functions import genome, pairs as P
from pairlattice.operators import binning, corr, expected, intervals, merge, norms, qc, rows
from pairlattice.sources import container, readers, sinks
from pairlattice.sources.pairs_binary import FULL, SHORT, write_pairs_binary


def _numbers(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in text.split(",") if x)


def threads(n: int, cores: int) -> int:
    """A thread count as given; a negative one is so many times the cores."""
    return -n * cores if n < 0 else max(1, n)


def _chromosomes(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary from ``name length`` lines, in order."""
    lines = [x.split() for x in (r["value"] for r in spark.read.text(path).collect()) if x.strip() and not x.startswith("#")]
    return genome.chromosomes(spark, [(x[0], int(x[1])) for x in lines])


def _selected(a: argparse.Namespace, pairs: DataFrame, chroms: DataFrame) -> DataFrame:
    names = tuple(r["idx"] for r in chroms.filter(F.col("name").isin(*a.chromosomes.split(","))).collect()) if a.chromosomes else ()
    return P.select_pairs(pairs, intra_only=a.intra, near=a.near_diagonal, chromosomes=names, orientation=a.orientation, mapq=a.mapq)


def pre(spark: SparkSession, a: argparse.Namespace) -> None:
    """Cells of every bin size, and the whole genome as one matrix (ordinal 0, "All")."""
    chroms = _chromosomes(spark, a.genome)
    pairs = _selected(a, P.clamp(readers.read_pairs(spark, a.input, chroms), chroms), chroms)
    total = chroms.agg(F.sum("length")).first()[0]
    cells = binning.multi_resolution(pairs, a.resolutions).unionByName(binning.whole_genome(pairs, chroms, total))
    sinks.write_matrix_set(cells, genome.with_all(chroms), a.output, {"genome": a.genome, "scaling": str(a.scaling)}, a.min_count)
    if not a.no_norm:
        add_norm(spark, argparse.Namespace(path=a.output, resolutions=a.resolutions, norms=a.norms, vectors=None))


def add_norm(spark: SparkSession, a: argparse.Namespace) -> None:
    """Vectors, and the expected of raw cells and of cells under each vector.

    Balanced vectors are made for all bin sizes at once, coarse to fine, so that a chromosome that fails is left out below.
    """
    chroms, cells = spark.read.parquet(f"{a.path}/chromosomes").filter("idx > 0"), sinks.read_cells(spark, a.path).filter("chr1 > 0")
    balanced = None if a.vectors or "SCALE" not in a.norms else norms.scale(rows.intra_cells(cells).filter(F.col("resolution").isin(*a.resolutions)), chroms, a.resolutions)
    for r in sorted(a.resolutions, reverse=True):
        part = cells.filter(F.col("resolution") == r)
        intra = rows.intra_cells(part)
        made: dict[str, DataFrame] = {}
        if a.vectors:
            given = readers.read_norm_vectors(spark, a.vectors, chroms).filter(F.col("resolution") == r)
            made = {n["norm"]: given.filter(F.col("norm") == n["norm"]) for n in given.select("norm").distinct().collect()}
        else:
            kinds = {"VC": lambda i=intra: norms.vc(i), "VC_SQRT": lambda i=intra: norms.vc_sqrt(i), "SCALE": lambda r=r: balanced.filter(F.col("resolution") == r)}
            made = {k: f() for k, f in kinds.items() if k in a.norms}
            if r >= norms.WHOLE_GENOME_FLOOR and norms.has_all_pairs(part, chroms):
                for k in a.norms:
                    for prefix, with_intra in (("GW_", True), ("INTER_", False)):
                        if k.startswith(prefix):
                            made[k] = norms.whole_genome_vectors(part, chroms, r, k.removeprefix(prefix), with_intra)
        for name in sorted(made, key=sinks.norm_order):
            sinks.write_norms(made[name].select(F.lit(name).alias("norm"), "resolution", "chr", "bin", "v"), a.path)
        _expected(spark, a.path, r, intra, chroms, "raw")
        for name in made:
            vector = sinks.read_norms(spark, a.path, name, r)
            _expected(spark, a.path, r, rows.normalized(intra, vector), chroms, name)


def _expected(spark: SparkSession, path: str, resolution: int, intra: DataFrame, chroms: DataFrame, name: str) -> None:
    """Smoothed density and chromosome factors of cells into ``path/name_resolution``."""
    density = expected.smoothed_density(expected.distance_histogram(intra), expected.possible_distances(chroms, resolution))
    sinks.write_expected(density, expected.chromosome_factors(density, chroms, expected.chromosome_totals(intra)), f"{path}/{name}_{resolution}")


def statistics(spark: SparkSession, a: argparse.Namespace) -> None:
    """Reports per MAPQ threshold: printed, and with an output name as files, the histograms beside them.

    An earlier report gives the sequenced and unique reads that shares are of; the new lines follow its own.
    """
    before = [r["line"] for r in readers.read_report_lines(spark, a.earlier).collect()] if a.earlier else []
    known = {r["label"]: r["value"] for r in readers.earlier_values(readers.read_report_lines(spark, a.earlier)).collect()} if a.earlier else {}
    pairs = readers.read_pairs(spark, a.input)
    hist, mapq = qc.orientation_histogram(pairs, a.mapqs), qc.mapq_histogram(pairs, a.mapqs)
    settled = {r["threshold"]: r["bin"] for r in qc.convergence(hist).collect()}
    for row in qc.counts(pairs, a.mapqs, a.ligation).orderBy("threshold").collect():
        lines = before + sinks.stats_lines(row, known.get("sequenced"), known.get("unique"), settled.get(row["threshold"]))
        print(f"MAPQ >= {row['threshold']}")
        print("\n".join(lines))
        if a.output:
            sinks.write_report(spark, lines, f"{a.output}_{row['threshold']}.txt")
            sinks.write_report(spark, sinks.histogram_lines(mapq, hist, row["threshold"]), f"{a.output}_{row['threshold']}_hists.m")


def merge_statistics(spark: SparkSession, a: argparse.Namespace) -> None:
    """One report of several; single-end and paired-end ones do not mix."""
    lines = readers.read_report_lines(spark, a.inputs)
    kind = merge.read_type(lines)
    merged = {r["label"]: r["value"] for r in merge.merge_stats(merge.parse_stats(lines, kind)).collect()}  # a row per label
    sinks.write_report(spark, sinks.merged_report_lines(merged, kind), a.output)


def merge_histograms(spark: SparkSession, a: argparse.Namespace) -> None:
    merged = merge.merge_histograms(merge.parse_histograms(readers.read_whole(spark, a.inputs)))
    sinks.write_report(spark, sinks.merged_histogram_lines(merged), a.output)


def sum_sets(spark: SparkSession, a: argparse.Namespace) -> None:
    """Sums per matrix, of intra cells near the diagonal only if asked for; the whole genome's matrix has a bin size of its own and is summed as it is."""
    parts = [sinks.read_cells(spark, p) for p in a.inputs]
    own, whole = [p.filter("chr1 > 0") for p in parts], [p.filter("chr1 = 0") for p in parts]
    if a.near_diagonal:
        own = [p.filter((F.col("chr1") == F.col("chr2")) & (F.abs(F.col("x") - F.col("y")) * F.col("resolution") <= P.NEAR_DIAGONAL)) for p in own]
    finest = a.resolution or own[0].agg(F.min("resolution")).first()[0]
    sizes = tuple(r[0] for r in own[0].select("resolution").distinct().collect() if r[0] >= finest and r[0] % finest == 0)
    cells = merge.rebin_datasets(own, finest, sizes).unionByName(merge.sum_datasets(whole))
    sinks.write_matrix_set(cells, spark.read.parquet(f"{a.inputs[0]}/chromosomes"), a.output)


def _one_matrix(spark: SparkSession, a: argparse.Namespace, chroms: DataFrame) -> DataFrame:
    idx = chroms.first()["idx"]
    return rows.as_intra(sinks.read_cells(spark, a.path, a.resolution, idx, idx))


def matrix(spark: SparkSession, a: argparse.Namespace) -> None:
    """Correlations or their first eigenvector, of raw cells or of those under a stored vector."""
    corr.check_resolution(a.resolution, 1 if a.any_resolution else corr.FINEST)
    chroms = spark.read.parquet(f"{a.path}/chromosomes").filter((F.col("name") == a.chromosome) & (F.col("idx") > 0))
    c = _one_matrix(spark, a, chroms)
    if a.norm != "NONE":
        c = rows.normalized(c, sinks.read_norms(spark, a.path, a.norm, a.resolution))
    density = expected.smoothed_density(expected.distance_histogram(c), expected.possible_distances(chroms, a.resolution))
    oe = expected.observed_over_expected(c, density)
    if a.command == "pearsons":
        r = corr.pearson(oe)
        if a.tiles:
            bins = chroms.first()["length"] // a.resolution + 1
            meta = {x["key"]: x["value"] for x in spark.read.parquet(f"{a.path}/metadata").collect()}
            sinks.write_matrix_tiles(r, a.output, meta.get("genome", ""), a.chromosome, a.resolution, bins)
        else:
            sinks.write_matrix_text(r, a.output)
    else:
        sinks.write_vector_text(corr.eigenvector(oe), a.output)


def test_norm(spark: SparkSession, a: argparse.Namespace) -> None:
    """The balanced vector of one chromosome at one bin size, as text."""
    chroms = spark.read.parquet(f"{a.path}/chromosomes").filter((F.col("name") == a.chromosome) & (F.col("idx") > 0))
    sinks.write_vector_text(norms.scale(_one_matrix(spark, a, chroms), chroms, (a.resolution,)), a.output)


def export(spark: SparkSession, a: argparse.Namespace) -> None:
    """A matrix set, with its vectors and expected densities, as one container file."""
    chroms = [(r["name"], r["length"]) for r in spark.read.parquet(f"{a.path}/chromosomes").orderBy("idx").collect()]
    meta = {r["key"]: r["value"] for r in spark.read.parquet(f"{a.path}/metadata").collect()}
    cells = sinks.read_cells(spark, a.path)
    sizes = tuple(r[0] for r in cells.filter("chr1 > 0").select("resolution").distinct().collect())
    vectors = spark.read.parquet(f"{a.path}/norms") if sinks.exists(spark, f"{a.path}/norms") else None
    names = sorted({r[0] for r in vectors.select("norm").distinct().collect()}, key=sinks.norm_order) if vectors is not None else []
    known = []
    for size in sorted(sizes, reverse=True):
        for name in ("raw", *names):
            held = f"{a.path}/{name}_{size}"
            if sinks.exists(spark, f"{held}/expected"):
                density = spark.read.parquet(f"{held}/expected").orderBy("dist").select("density").toPandas()["density"].to_numpy()  # a value per bin distance
                factors = {r["chr"]: r["factor"] for r in spark.read.parquet(f"{held}/chr_scale").collect()}
                known.append(container.Expected(size, density, factors, "" if name == "raw" else name))
    container.write_container(a.output, container.Head(meta.get("genome", ""), chroms, sizes, meta), cells, known, vectors)


def convert(spark: SparkSession, a: argparse.Namespace) -> None:
    chroms = _chromosomes(spark, a.genome)
    pairs = readers.read_pairs(spark, a.input, chroms)
    if a.command == "pairstobin":
        write_pairs_binary(pairs, a.output, SHORT if a.short else FULL, "bn" if a.short else "bin")
    else:
        sinks.write_pairs_text(pairs, a.output, chroms, with_mapq=a.mapq)


def complexity(spark: SparkSession, a: argparse.Namespace) -> None:
    """From two files of pairs, or from a folder with merged_nodups, dups and opt_dups, which gives the optical duplicates too."""
    from pairlattice.functions.scalars import library_size

    scan = a.dups is None
    unique, dups, optical = (f"{a.unique}/{x}.txt" for x in ("merged_nodups", "dups", "opt_dups")) if scan else (a.unique, a.dups, None)
    n = {r["file"]: r["n"] for r in readers.count_lines(spark, [x for x in (unique, dups, optical) if x]).collect()}
    u, d, o = (n.get(p.rpartition("/")[2], 0) if p else a.optical for p in (unique, dups, optical))
    row = spark.range(1).select(F.lit(u + d).alias("n_total"), F.lit(u).alias("n_unique"), F.lit(d).alias("n_dups"), library_size(F.lit(d), F.lit(u)).alias("library_size")).first()
    print("\n".join(sinks.complexity_lines(row, o)))


def track(spark: SparkSession, a: argparse.Namespace) -> None:
    intervals.window_stats(readers.read_track(spark, a.input), a.window).orderBy("chr", "win").write.mode("overwrite").csv(a.output, sep="\t")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pairlattice")
    s = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *args: tuple) -> None:
        c = s.add_parser(name)
        c.set_defaults(run=run)
        for flags, options in args:
            c.add_argument(*flags.split(), **options)

    path, out = ("path", {}), ("output", {})
    sizes = ("-r --resolutions", {"type": _numbers, "default": genome.RESOLUTIONS})
    kinds = ("-k --norms", {"type": lambda x: x.split(","), "default": ["VC", "VC_SQRT", "SCALE"]})
    command("pre", pre, ("input", {}), out, ("-g --genome", {"required": True}), sizes, kinds, ("-q --mapq", {"type": int, "default": 0}), ("-m --min-count", {"type": float, "default": 0.0}), ("-c --chromosomes", {}), ("--intra", {"action": "store_true"}), ("--near-diagonal", {"type": int}), ("--orientation", {}), ("-z --scaling", {"type": float, "default": 1.0}), ("-n --no-norm", {"action": "store_true"}))
    command("addnorm", add_norm, path, sizes, kinds, ("--vectors", {}))
    command("statistics", statistics, ("input", {}), ("--mapqs", {"type": _numbers, "default": (1, 30)}), ("--ligation", {}), ("-o --output", {}), ("--earlier", {}))
    command("mergestats", merge_statistics, out, ("inputs", {"nargs": "+"}))
    command("mergehists", merge_histograms, out, ("inputs", {"nargs": "+"}))
    command("sum", sum_sets, out, ("inputs", {"nargs": "+"}), ("-r --resolution", {"type": int}), ("--near-diagonal", {"action": "store_true"}))
    for name in ("pearsons", "eigenvector"):
        command(name, matrix, path, ("chromosome", {}), ("resolution", {"type": int}), out, ("-p --any-resolution", {"action": "store_true"}), ("-b --tiles", {"action": "store_true"}), ("-k --norm", {"default": "NONE"}))
    command("testnorm", test_norm, path, ("chromosome", {}), ("resolution", {"type": int}), out)
    command("export", export, path, out)
    command("pairstobin", convert, ("input", {}), out, ("-g --genome", {"required": True}), ("--short", {"action": "store_true"}))
    command("bintopairs", convert, ("input", {}), out, ("-g --genome", {"required": True}), ("--mapq", {"action": "store_true"}))
    command("librarycomplexity", complexity, ("unique", {}), ("dups", {"nargs": "?"}), ("--optical", {"type": int, "default": 0}))
    command("track", track, ("input", {}), out, ("window", {"type": int}))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    a.run(SparkSession.builder.appName(f"pairlattice {a.command}").getOrCreate(), a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
