"""Rows that share a doc_id or have none, and columns named like the operators' own."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairlattice.llm import jaccard_join, mixing, quality, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
OWN = (
    "row", "row_", "tag", "removed", "cuts", "verdict", "key", "grp", "centre", "inverse", "median", "spread", "start", "cell", "cut", "d", "p", "i", "s", "tie", "tie_", "nth", "copies", "mix_tie", "mix_nth", "mix_copy",
    "mix_copies", "cdc_removed", "survivor", "component", "component_id", "representative", "size", "digest", "u", "v", "a", "b", "packed", "place", "rate", "offset", "same", "upto", "several", "n", "kept", "rows",
)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    w = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8))) for _ in range(n)]
    return " ".join(x + ("." if i % 11 == 10 else "") for i, x in enumerate(w))


def rows_of(df):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())


@pytest.fixture(scope="module")
def make(spark):
    def of(rows):
        d = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)
        return d.withColumns({c: F.lit("clash") for c in OWN})

    return of


def test_passages_of_rows_with_one_doc_id(make):
    shared, own = prose(1, 60), prose(2, 100)
    same = make([(1, shared, "a"), (1, shared, "a")])
    got = substring_dedup.repeated_passages(same.select("doc_id", "text")).collect()
    assert [(r["doc_id"], r["n_words"]) for r in got] == [(1, 60)] * 2
    out = substring_dedup.deduplicate(same)
    assert out.columns == same.columns and sorted(r["text"] for r in out.collect()) == ["", shared]
    mixed = make([(1, shared + " " + own, "a"), (1, own[:300], "a"), (2, prose(3, 90), "a"), (None, prose(4, 90), "a"), (None, prose(5, 90), "a")])
    texts = {r["text"] for r in substring_dedup.deduplicate(mixed).collect()}
    assert {prose(3, 90), prose(4, 90), prose(5, 90)} <= texts  # no row loses what another one repeats
    words = Counter(w for t in texts for w in t.split())
    assert set(Counter(shared.split())) <= set(words)


def test_removed_ranges_of_texts_by_brute_force(make):
    texts = [prose(s, 80) for s in range(6)]
    a, b, c = prose(20, 40), prose(21, 70), prose(22, 120)
    rows = [(i % 4, t, "a") for i, t in enumerate([texts[0] + " " + b, b + " " + texts[1], texts[2] + " " + c + " " + texts[3], a + " " + c, texts[4] + " " + a, texts[5]])]
    d = make(rows)
    found = substring_dedup.repeated_passages(d.select("doc_id", "text")).collect()
    for r in found:
        text = [t for i, t, _ in rows if i == r["doc_id"]]
        others = [t for _, t, _ in rows]
        for span in r["spans"]:
            # every window of 16 words inside a span stands twice in the table; a span may be joined from overlapping ones
            assert any(sum(t.count(x[span["start"] : span["finish"]]) for t in others) >= 2 for x in text if len(x) >= span["finish"])
    kept = sorted(r["text"] for r in substring_dedup.deduplicate(d).collect())
    all_text = " ".join(kept)
    for piece in (a, b, c, *texts):
        for k in range(0, len(piece) - 200, 40):
            assert piece[k : k + 60] in all_text or any(piece[k + j : k + j + 20] in all_text for j in range(0, 40, 10))
    assert sum(map(len, kept)) < sum(len(t) for _, t, _ in rows) - 0.6 * (len(a) + len(b) + len(c))


def test_one_row_of_each_component_stays(make):
    x, y = prose(1, 80), prose(2, 80)
    d = make([(1, x, "a"), (1, x, "a"), (1, y, "a"), (None, y + " end", "a"), (None, prose(3, 80), "b"), (None, None, "b"), (None, "", "b"), (7, x + " more", "c")])
    out = jaccard_join.keep_one(d)
    assert out.columns == d.columns
    assert rows_of(out) == Counter([(1, x, "a"), (1, y, "a"), (None, prose(3, 80), "b"), (None, None, "b"), (None, "", "b")])
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.link_components(d).collect())
    assert got == Counter({(1, 76, 1): 3, (None, 77, 1): 1, (7, 77, 1): 1, (None, 76, None): 1, (None, 0, None): 2})


def test_slices_of_long_lists_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "_slices", lambda levels: np.full(len(levels), 3, np.uint64))
    rng = np.random.default_rng(5)
    rows = []
    for base in range(12):
        w = prose(base, 40).split()
        for _ in range(9):
            u = list(w)
            u[rng.integers(0, 40)] = f"t{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(u)))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                lo, hi = sorted((root[i], root[j]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    assert got == root


def test_verdicts_go_by_row(make):
    good, bad = prose(1, 120), "word word word " * 60
    d = make([(1, good, "a"), (1, bad, "a"), (None, bad, "a"), (None, good, "a"), (None, None, "a"), (2, good, None)])
    out = quality.keep_good(d)
    assert out.columns == d.columns and rows_of(out) == Counter([(1, good, "a"), (None, good, "a"), (2, good, None)])


def test_mix_of_rows_alike(make):
    text = prose(1, 30)
    d = make([(i, text, s) for i in range(100) for s in "AB"] + [(i % 3, prose(2, 20), "C") for i in range(60)] + [(None, prose(3, 25), "C")] * 20)
    d = d.withColumn("nth", F.when(F.col("source") == "C", F.expr("cast(doc_id as string)")))
    plan = mixing.plan_copies(d)
    per = {r["source"]: r["n"] for r in plan.groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    out = mixing.mix(d)
    assert out.columns == d.columns
    assert {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()} == per
    planned = Counter()
    for r in plan.collect():
        planned[r["doc_id"], r["source"]] += r["copies"]
    assert Counter((r["doc_id"], r["source"]) for r in out.collect()) == +planned


def test_mix_does_not_depend_on_partitions(make):
    d = make([(i % 50, prose(i % 7, 10 + i % 13), "AB"[i % 2]) for i in range(200)])
    assert rows_of(mixing.mix(d)) == rows_of(mixing.mix(d.repartition(7)))


def test_pipeline_stages_keep_foreign_columns(make):
    d = make([(i % 9, prose(i, 70), "ab"[i % 2]) for i in range(24)] + [(None, prose(50, 80), None)] * 2 + [(3, None, "a"), (3, "", None)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(d.sparkSession, d, "")
        assert set(OWN) < set(d.columns)
    assert 20 <= d.count() and not [r for r in d.collect() if not re.search(r"\w", r["text"])]


def test_estimate_is_the_least_determinant(spark):
    """Against brute force: of many random starts with concentration steps, none is better; outliers do not move the estimate."""
    rng = np.random.default_rng(3)
    mixing_matrix = rng.standard_normal((6, 6)) * 0.4 + np.eye(6)
    z = rng.standard_normal((400, 6)) @ mixing_matrix
    z[:80] = rng.standard_normal((80, 6)) * 0.3 + 9
    z = np.round(z * quality.UNIT) / quality.UNIT
    d = spark.createDataFrame([("g", *map(float, r)) for r in z], ["grp", *quality.STATS])
    r = quality.fit(d).first()
    h = int(np.ceil(len(z) * quality.SUBSET))
    ridge = np.diag(np.square(quality.RIDGE * np.array(quality.FLOOR)))
    scale = quality.consistency(6, quality.SUBSET)

    def steps(at):
        last = np.inf
        while True:  # the few rows of the start do not count themselves
            mean, cov = z[at].mean(0), scale * np.cov(z[at].T, bias=True) + ridge
            det = np.linalg.slogdet(cov)[1]
            if len(at) == h:
                if det > last - 1e-9:
                    return last, mean, cov
                last = det
            dist = np.einsum("ij,jk,ik->i", z - mean, np.linalg.inv(cov), z - mean)
            at = np.argsort(dist)[:h]

    best = min((steps(rng.permutation(len(z))[:7]) for _ in range(200)), key=lambda x: x[0])
    assert r["logdet"] <= best[0] + 0.05
    near = np.einsum("ij,jk,ik->i", z - best[1], np.linalg.inv(best[2]), z - best[1]) <= quality.REWEIGHT
    mean = z[near].mean(0)
    cov = quality.floored(quality.consistency(6, quality.REWEIGHT_SHARE) * np.cov(z[near].T, bias=True))
    assert np.allclose(r["centre"], mean, atol=0.1)
    inverse = np.array([r["inverse"][t] / (1 if i == j else 2) for t, (i, j) in enumerate(quality._TRIANGLE)])
    assert np.allclose(inverse, np.linalg.inv(cov)[np.triu_indices(6)], rtol=0.1, atol=0.1)
    assert np.abs(np.array(r["centre"])).max() < 0.4


def test_steps_that_go_round_end(spark, monkeypatch):
    """On a coarse grid subsets differ in size, and the determinants of these rows rise and fall for ever, not all at once."""
    monkeypatch.setattr(quality, "GRID", 2)
    rows = lambda seeds: spark.createDataFrame([(str(s), *map(float, r)) for s in seeds for r in np.round(np.random.default_rng(s).standard_normal((100, 6)) * quality.UNIT) / quality.UNIT], ["grp", *quality.STATS])
    both, alone = ({r["grp"]: r for r in quality.fit(rows(seeds)).collect()} for seeds in ((6, 52), (6,)))
    assert set(both) == {"6", "52"} and both["6"] == alone["6"]
    assert all(np.isfinite([r["logdet"], *r["centre"], *r["inverse"]]).all() for r in both.values())


def test_floors_only_raise_what_lacks():
    wide = np.diag([4.0] * 6) + 0.5
    assert np.array_equal(quality.floored(wide), wide)
    assert np.allclose(np.sqrt(quality.floored(np.zeros((6, 6))).diagonal()), quality.FLOOR)


def test_a_document_odd_in_one_statistic_is_rejected(spark):
    rows = [(i, prose(i, 120 + i % 50), "en", "a", 0) for i in range(150)]
    lines = prose(900, 60).split()
    odd = [
        (1000, " ".join(w + "#$%" for w in prose(901, 150).split()), "en", "a", 0),
        (1001, prose(902, 150).upper(), "en", "a", 0),
        (1002, "\n".join(" ".join(lines[k : k + 6]) for k in range(0, 60, 6)) + "\n" + "\n".join(["the same line"] * 8), "en", "a", 0),
    ]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.judge(spark.createDataFrame(rows + odd, SCHEMA)).collect()}
    assert [got[i] for i in (1000, 1001, 1002)] == [(False, False)] * 3
    assert sum(got[i][1] for i in range(150)) >= 148


def test_verdicts_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = lambda d: {(r["doc_id"], r["kept"], r["d2"]) for r in quality.judge(d).select("doc_id", "kept", "d2").collect()}
    assert kept(docs) == kept(docs.repartition(13, "text"))
