"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Each document gets a vector of six transformed statistics. Per group the minimum-covariance-
determinant estimate is sought by concentration steps on DataFrames, from several starts that
are computed from all rows (``starts``). A step takes the ``SUBSET`` of the group's rows with
the smallest distances and makes the next mean and covariance of them. Rows of equal distance
stay together, so subsets differ in size and a step can raise the determinant again; steps that
go on regardless can go round for ever. Each start therefore ends by itself, with the first step
that does not lower its determinant, and keeps the lower of the two. Of the starts the
least determinant wins, and the estimate is reweighted: mean and covariance of the rows within
the 0.975 quantile of chi-square, made consistent for normal samples. Where a statistic hardly
varies in a group, its deviation is raised to ``FLOOR``; other deviations stay as estimated. A document
is rejected if its squared Mahalanobis distance is above ``CUTOFF`` (the 0.9999 quantile of
chi-square with six degrees).

Statistics, centres and start vectors are multiples of 1/1024, so sums of them and of their products are
exact in double precision and do not depend on the order of rows; quantiles come from counts
per step of a fixed grid. So partitions do not change what is kept. Counts and sums are
combined before they are shuffled, so a group may hold any part of the rows.

Groups are (lang, source); one with under ``LEAST_ROWS`` documents that pass the base rules
takes its language's estimate, a language with fewer takes that of all documents, and under
``LEAST_ROWS`` documents in all none is rejected by this rule. A null language or source is a
value of its own.

Defined cases: a null, empty or blank text has no words and fails the base rules; every row is
judged by its own text, language and source, whatever its doc_id is or who shares it; repeated
rows each count and each get a row; an empty table gives an empty result; further columns
are ignored by ``judge`` and kept by ``keep_good``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlattice.llm.common import BROADCAST_IDS, bounded_batches, by_ids, own_name, tidy, written

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: The estimate: statistics, share of rows in the subset, rows a group needs.
STATS = ("z_length", "z_symbols", "z_upper", "z_marks", "z_lines", "z_repeats")
SUBSET, LEAST_ROWS, STARTS = 0.75, 100, 3
#: A start ends when its determinant does not fall by more than this share of itself; as the ridge keeps it above 0, that ends.
SETTLED = 5e-3
#: Least standard deviation per statistic, so that one that is constant in a group rejects only large departures.
FLOOR = (0.3, 0.05, 0.06, 0.06, 0.1, 0.12)
#: Share of the floor that keeps covariances invertible during the steps.
RIDGE = 0.1
CUTOFF, REWEIGHT, REWEIGHT_SHARE = 27.86, 14.45, 0.975
#: Statistics and centres are whole numbers of this part; steps of the grids of distances per doubling.
UNIT, GRID = 1024, 256

_ASCII = {name: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for name, chars in {"space": b" \t\n\x0b\x0c\r", "symbols": SYMBOLS, "upper": bytes(range(65, 91)), "marks": b"!?\"'()+-/0123456789:;=@[]\\^_`{}~"}.items()}
_CONTINUES = (np.arange(256) & 0xC0) == 0x80


def statistics(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, *STATS) of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    of = lambda name: int(count[_ASCII[name]].sum())
    chars = len(raw) - int(count[_CONTINUES].sum()) - of("space")
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    n_dup = len(lines) - len(set(lines))
    repeated = 0
    if n >= 3:
        number: dict[bytes, int] = {}
        h = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n).view(np.uint64)
        # words are numbered, so windows are told apart exactly: a pair's number, then the pair with the third word
        base = np.uint64(len(number))
        pair = np.unique(h[:-1] * base + h[1:], return_inverse=True)[1].astype(np.uint64)
        w = pair[:-1] * base + h[2:]
        order = np.argsort(w)
        s = w[order]
        same = s[1:] == s[:-1]
        if same.any():
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(n, bool)
            cover[:-2] |= twice
            cover[1:-1] |= twice
            cover[2:] |= twice
            repeated = int(cover.sum())
    symbols, upper, marks = of("symbols"), of("upper"), of("marks")
    # shares are shrunk a little, so that short texts scatter less
    z = (chars / (n + 1), math.sqrt(symbols / (chars + 50)), math.sqrt(upper / (chars + 50)), math.sqrt(marks / (chars + 50)), math.sqrt(n_dup / (len(lines) + 4)), math.sqrt(repeated / (n + 20)))
    return (n, chars, symbols, n_dup, repeated, *(round(x * UNIT) / UNIT for x in z))


def verdict_key(docs: DataFrame):
    """A digest of all that a row's verdict depends on: its language, source and text; an empty text counts as a null one."""
    mark = lambda c: F.coalesce(F.concat(F.lit("="), docs[c].cast("string")), F.lit("-"))
    return F.md5(F.concat_ws("\n", F.md5(mark("lang")), F.md5(mark("source")), F.coalesce(docs["text"], F.lit(""))))


def measure(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id, lang, source, the base figures, base_failed and the vector, a row per row of docs; if asked for, its verdict's key too."""
    bounded_batches(docs.sparkSession)
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*map(statistics, batch.column(4).to_pylist()), strict=True))
            if rows:
                kinds = [pa.int64()] * len(base) + [pa.float64()] * len(STATS)
                yield pa.RecordBatch.from_pydict({k: batch.column(i) for i, k in enumerate(("doc_id", "lang", "source", "key"))} | {k: pa.array(v, kind) for k, v, kind in zip((*base, *STATS), rows, kinds, strict=True)})

    schema = "doc_id long, lang string, source string, key string, " + ", ".join([f"{k} long" for k in base] + [f"{k} double" for k in STATS])
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), (verdict_key(docs) if keyed else F.lit(None).cast("string")).alias("key"), "text").mapInArrow(tidy(run), schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def consistency(p: int, share: float) -> float:
    """The factor that makes the subset's covariance that of a normal sample; p is even, so both integrals are finite sums."""
    below = lambda k, x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        lo, hi = (mid, hi) if below(p, mid := (lo + hi) / 2) < share else (lo, mid)
    return share / below(p + 2, lo)


P = len(STATS)
_TRIANGLE = [(i, j) for i in range(P) for j in range(i, P)]


def _symmetric(flat: np.ndarray) -> np.ndarray:
    m = np.zeros((P, P))
    m[np.triu_indices(P)] = flat
    return m + m.T - np.diag(m.diagonal())


def moments(sums: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean (about the sums' centre) and covariance from sums of coordinates and of their products."""
    mean = sums[:P] / n
    return mean, _symmetric(sums[P:] / n) - np.outer(mean, mean)


def floored(cov: np.ndarray) -> np.ndarray:
    """cov with every deviation at least FLOOR: only what a statistic lacks is added."""
    return cov + np.diag(np.maximum(np.square(FLOOR) - cov.diagonal(), 0.0))


def _shape(centre, cov: np.ndarray, scale: float = 1.0) -> tuple[list[float], list[float], float]:
    """(centre, upper triangle of the inverse with off-diagonal entries doubled, log of the determinant)."""
    k = scale * cov + np.diag(np.square(RIDGE * np.array(FLOOR)))
    inverse = np.linalg.inv(k)
    flat = [float(inverse[i, j]) * (1 if i == j else 2) for i, j in _TRIANGLE]
    return [float(x) for x in centre], flat, float(np.linalg.slogdet(k)[1])


def _distance():
    """The squared distance of a row's statistics by the columns centre and inverse."""
    d = [f"({c} - centre[{i}])" for i, c in enumerate(STATS)]
    return F.expr(" + ".join(f"{d[i]} * {d[j]} * inverse[{t}]" for t, (i, j) in enumerate(_TRIANGLE)))


def _with(rows: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(groups) if few else groups, "grp")


def _sums(x: list[str]):
    """An array of the sums of these expressions and of their products."""
    return F.expr("array(" + ", ".join([f"sum({v})" for v in x] + [f"sum({x[i]} * {x[j]})" for i, j in _TRIANGLE]) + ")")


#: Statistics about their group's median.
_CENTRED = [f"({c} - median[{i}])" for i, c in enumerate(STATS)]


def _at_counts(counts: DataFrame, keys: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """(*keys, q): per key the least values at which the running count reaches these shares of all rows."""
    run = W.partitionBy(*keys).orderBy(value)
    held = counts.withColumn("held", F.sum("n").over(run)).withColumn("all", F.sum("n").over(W.partitionBy(*keys)))
    return held.groupBy(*keys).agg(F.array(*[F.min(F.when(F.col("held") >= F.ceil(F.col("all") * s), F.col(value))) for s in shares]).alias("q"))


def centres(rows: DataFrame) -> DataFrame:
    """(grp, rows, median, spread): exact medians per group, and deviations from quartiles, at least FLOOR."""
    counts = rows.select("grp", F.posexplode(F.array(*STATS)).alias("i", "z")).groupBy("grp", "i", "z").agg(F.count("*").alias("n"))
    q = _at_counts(counts, ["grp", "i"], "z", (0.25, 0.5, 0.75)).withColumn("s", F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, F.array(*map(F.lit, FLOOR))[F.col("i")]))
    flat = q.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("i", F.col("q")[1].alias("m"), "s"))).alias("a"))
    sizes = counts.filter("i = 0").groupBy("grp").agg(F.sum("n").alias("rows"))
    return flat.select("grp", F.col("a.m").alias("median"), F.col("a.s").alias("spread")).join(sizes, "grp")


def starts(rows: DataFrame, middles: DataFrame, few: bool) -> DataFrame:
    """(grp, start, median, centre, inverse, logdet, falls): three starts per group, all about its median, of all its rows.

    0: deviations from quartiles, without correlation; 1: the correlation of hyperbolic tangents of the standardised
    statistics; 2: the covariance of their directions (spatial signs). 1 and 2 are scaled to the deviations.
    As no subset made them, their determinants do not count: logdet is infinite.
    """
    at = _with(rows, middles, few)
    u = [f"({x} / spread[{i}])" for i, x in enumerate(_CENTRED)]
    length = "greatest(sqrt(" + " + ".join(f"{x} * {x}" for x in u) + "), 1e-9)"
    whole = lambda x, name: f"round({x} * {UNIT}) / {UNIT} AS {name}"
    forms = at.selectExpr("grp", *[whole(f"tanh({x})", f"t{i}") for i, x in enumerate(u)], *[whole(f"{x} / {length}", f"s{i}") for i, x in enumerate(u)])
    both = [_sums([f"{k}{i}" for i in range(P)]).alias(k) for k in "ts"]
    sums = forms.groupBy("grp").agg(*both).join(middles, "grp")

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                spread = np.array(r.spread, float)
                for start, flat in enumerate((None, r.t, r.s)):
                    cov = np.eye(P)
                    if flat is not None:
                        cov = moments(np.array(flat, float), r.rows)[1]
                        own = np.sqrt(np.maximum(cov.diagonal(), 1e-6))
                        cov = cov / np.outer(own, own) + 1e-3 * np.eye(P)
                    out.append((r.grp, start, r.median, *_shape(r.median, cov * np.outer(spread, spread))[:2], math.inf, True))
            yield pd.DataFrame(out, columns=_COLUMNS)

    return sums.mapInPandas(tidy(make), _ESTIMATE)


_ESTIMATE = "grp string, start int, median array<double>, centre array<double>, inverse array<double>, logdet double, falls boolean"
_COLUMNS = [x.split()[0] for x in _ESTIMATE.split(", ")]


def _refined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per group and start: the estimate of its subset, from the subset's sums about the group's median, or the one before if that is lower."""
    scale = consistency(P, SUBSET)
    for f in frames:
        out = []
        for r in f.itertuples(index=False):
            mean, cov = moments(np.array(r.sums, float), r.n)
            new = _shape(np.array(r.median) + mean, cov, scale)
            kept = new if new[2] <= r.logdet else (list(r.centre), list(r.inverse), r.logdet)
            out.append((r.grp, r.start, r.median, *kept, new[2] < r.logdet - SETTLED))
        yield pd.DataFrame(out, columns=_COLUMNS)


def step(rows: DataFrame, now: DataFrame, few: bool) -> DataFrame:
    """One concentration step of every group and start in now.

    Distances are counted per step of a fixed grid (``GRID`` a doubling); the subset is all rows up to the grid step
    at which the running count reaches SUBSET of the group, so rows of equal distance stay together.
    """
    far = _with(rows, now, few).withColumn("cell", F.floor(F.log2(_distance() + 1e-9) * GRID))
    counts = far.groupBy("grp", "start", "cell").agg(F.count("*").alias("n"))
    cut = _at_counts(counts, ["grp", "start"], "cell", (SUBSET,)).select("grp", "start", F.col("q")[0].alias("cut"))
    near = far.join(F.broadcast(cut) if few else cut, ["grp", "start"]).filter("cell <= cut")
    # arrays are joined afterwards, so that the sums are made by a hash aggregate of doubles
    sums = near.groupBy("grp", "start").agg(F.count("*").alias("n"), _sums(_CENTRED).alias("sums"))
    sums = sums.join(now.drop("falls"), ["grp", "start"])
    return sums.mapInPandas(tidy(_refined), _ESTIMATE)


def fit(rows: DataFrame) -> DataFrame:
    """(grp, centre, inverse, logdet): the reweighted estimate of each group of rows (grp, *STATS); logdet is that of the subset that won."""
    middles = written(centres(rows))
    few = middles.count() * STARTS <= BROADCAST_IDS
    now = written(starts(rows, middles, few))
    while not now.filter("falls").isEmpty():
        now = written(step(rows, now.filter("falls"), few).unionByName(now.filter("not falls")))
    best = now.groupBy("grp").agg(F.min_by(F.struct("median", "centre", "inverse", "logdet"), F.struct("logdet", "start")).alias("e")).select("grp", "e.*")
    won = written(best)
    at = _with(rows, won, few)
    near = at.filter(_distance() <= REWEIGHT)
    sums = near.groupBy("grp").agg(F.count("*").alias("n"), _sums(_CENTRED).alias("sums")).join(won.select("grp", "median", "logdet"), "grp")
    scale = consistency(P, REWEIGHT_SHARE)

    def reweighted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                mean, cov = moments(np.array(r.sums, float), r.n)
                inverse = np.linalg.inv(floored(scale * cov))
                out.append((r.grp, (np.array(r.median) + mean).tolist(), [float(inverse[i, j]) * (1 if i == j else 2) for i, j in _TRIANGLE], r.logdet))
            yield pd.DataFrame(out, columns=["grp", "centre", "inverse", "logdet"])

    return sums.mapInPandas(reweighted, "grp string, centre array<double>, inverse array<double>, logdet double")


def judge(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """The rows of ``measure`` with d2 (null where no estimate applies) and kept."""
    rows = written(measure(docs, keyed))
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    names = F.array(F.lit("*"), F.concat_ws("\t", F.lit("l"), part("lang")), F.concat_ws("\t", F.lit("s"), part("lang"), part("source")))
    good = rows.filter("not base_failed")
    sizes = written(good.groupBy("lang", "source").agg(F.count("*").alias("n")).select("lang", "source", "n", F.posexplode(names).alias("depth", "grp")))
    large = sizes.groupBy("grp").agg(F.sum("n").alias("rows")).filter(F.col("rows") >= LEAST_ROWS).select("grp")
    # each (lang, source) takes the finest of its groups that is large enough; only groups that are taken get an estimate
    keys = rows.select("lang", "source").distinct().select("lang", "source", F.posexplode(names).alias("depth", "grp"))
    places = written(keys.join(large, "grp").groupBy("lang", "source").agg(F.max_by("grp", "depth").alias("grp")))
    taken = written(places.select("grp").distinct())
    levels = written(by_ids(good.select(F.explode(names).alias("grp"), *STATS), taken, "grp", "inner"))
    estimates = fit(levels).select("grp", "centre", "inverse")
    places = written(places.join(estimates, "grp", "left").drop("grp"))
    if places.count() <= 50_000:
        places = F.broadcast(places)
    at = rows.join(places, [rows["lang"].eqNullSafe(places["lang"]), rows["source"].eqNullSafe(places["source"])], "left").drop(places["lang"]).drop(places["source"])
    return at.withColumn("d2", _distance()).drop("centre", "inverse").withColumn("kept", ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF))


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the rejected rows; rows of one language, source and text share their verdict."""
    names, key = docs.columns, own_name(docs, "verdict")
    gone = written(judge(docs, keyed=True).filter("not kept").select(F.col("key").alias(key)).distinct())
    return by_ids(docs.withColumn(key, verdict_key(docs)), gone, key, "left_anti").select(*names)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", "kept")
