"""Operators against brute force, on the small tables and on odd ones."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pairlattice.llm import ann, bpe, hmm, html_text, jaccard_join, mixing, pii, quality, quotation, registry, substring_dedup
from pairlattice.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("size", "digest", "n", "tie", "h", "grp", "row", "c", "component", "u", "v", "key", "words", "rank", "parts", "removed", "nth", "copy")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", None, 6), (4, LONG, "en", "a", len(LONG)), (5, LONG, "en", "a", len(LONG)), (5, LONG, "en", "a", len(LONG)),
    (None, "one two three four five six", None, "b", 3), (6, "one two three four", "de", "b", 1), (7, "ONE two\x0bthree four", "de", "b", 1), (8, "é ü 中文 🙂 " * 30, "xx", "b", 1), (9, "x" * 100_000, "en", "c", 9),
    (10, "mail a@b.co or a [at] b [dot] co, 10.0.0.1, 4111 1111 1111 1111, +1 (555) 010-9999 <|endoftext|>", "en", "c", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(ODD, SCHEMA)
    return d.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_give_what_their_sql_gives(name, spark):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda x: None if x is None or x is pd.NA or x != x else float(x) if isinstance(x, (int, float)) else x
    rows = lambda f: sorted((tuple(map(plain, r)) for r in f[sorted(f.columns)].astype(object).values.tolist()), key=str)
    assert rows(got) == rows(want)


# ---- 1


def brute_nearest(x, ids, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def test_nearest_neighbours_recall_and_scores(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    pdf = v.toPandas()
    x, ids = np.array(pdf["embedding"].tolist(), float), pdf["vec_id"].to_numpy()
    got = defaultdict(list)
    for r in ann.query(spark, SF).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = []
    for q in np.flatnonzero(ids % 100 == 0):
        want = brute_nearest(x, ids, q, 10)
        hits.append(len({i for i, _ in want} & {i for i, _ in got[ids[q]]}) / 10)
        exact = dict((int(ids[i]), float(np.sqrt(((x[i] - x[q]) ** 2).sum()))) for i in range(len(ids)))
        assert all(abs(exact[i] - s) < 1e-12 for i, s in got[ids[q]])
        assert got[ids[q]] == sorted(got[ids[q]], key=lambda p: (p[1], p[0]))
    assert np.mean(hits) >= 0.9


def test_scan_is_exact_on_ties_and_copies():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 48))
    x[100:900] = x[7]
    ids = rng.permutation(3000)
    found = list(zip(*ann.scan(x[[7, 5, 2000]], ids[[7, 5, 2000]], np.full(3, np.inf), x, ids, ann.rotation(48), 10)[:3]))
    for q in (7, 5, 2000):
        mine = [(i, d) for a, i, d in found if a == ids[q]]
        assert [i for i, _ in mine][: 10 if q == 7 else 5] == [i for i, _ in brute_nearest(x, ids, q, 10)][: 10 if q == 7 else 5]


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [1.0, 1.0]), (6, [1.0, 1.0]), (6, [1.0, 1.0]), (7, []), (8, [1.0]), (100, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "list": F.lit(2)})
    got = ann.search(v).collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 5), (0, 6), (0, 6)]
    assert ann.search(v.limit(0)).count() == 0


# ---- 2


def test_chunks_cover_texts_and_resist_shifts():
    raw = " ".join(f"tok{i * 7919 % 1000}" for i in range(3000)).encode()
    for text in (b"", b"a", b"z" * 5000, raw):
        ends = substring_dedup.chunk_ends(text)
        assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == len(text)
        assert all(b - a <= substring_dedup.MOST for a, b in zip([0, *ends], ends))
    pieces = lambda t: {t[a:b] for a, b in zip([0, *substring_dedup.chunk_ends(t)], substring_dedup.chunk_ends(t))}
    a, b = pieces(raw), pieces(b"something new in front " + raw)
    assert len(a & b) > 0.97 * len(a)
    period = b"Same!! words again,!! " * 60
    assert len(pieces(b"abc" + period) & pieces(b"something else" + period)) >= 1 and len(pieces(period)) < 12


def test_gear_hash_is_the_rolling_one():
    raw = np.frombuffer(LONG.encode()[:500], np.uint8)
    h, out = 0, []
    for x in raw:
        h = ((h << 1) + int(substring_dedup._GEAR[x])) & 0xFFFF
        out.append(h)
    assert substring_dedup.gear_hashes(raw).tolist() == out


def test_long_repeats_are_caught_and_clean_texts_left(spark, docs, texts):
    windows = defaultdict(set)
    for i, t in texts.items():
        w = t.split()
        for j in range(len(w) - 49):
            windows[tuple(w[j : j + 50])].add(i)
    shared = set().union(*[s for s in windows.values() if len(s) > 1])
    rows = substring_dedup.query(spark, SF).collect()
    caught = {r["doc_id"] for r in rows}
    assert shared <= caught
    short = defaultdict(set)
    for i, t in texts.items():
        w = t.split()
        for j in range(len(w) - 7):
            short[tuple(w[j : j + 8])].add((i, j))
    repeated = {i for s in short.values() if len(s) > 1 for i, _ in s}
    assert caught <= repeated
    left = {r["doc_id"]: r["text"] for r in substring_dedup.deduplicate(docs).collect()}
    assert set(left) == set(texts) and all(left[i] == t for i, t in texts.items() if i not in caught)
    assert sum(map(len, left.values())) < sum(map(len, texts.values()))


def test_passages_stand_elsewhere_in_one_piece(spark):
    rng = np.random.default_rng(8)
    some = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(n))
    phrases = [some(14) for _ in range(4)]
    pieces = [b"".join(x[a:b] for a, b in zip(ends[:-1], ends[1:-1])).decode() for x in (p.encode() for p in phrases) if (ends := substring_dedup.chunk_ends(x))]
    assert all(len(p.split()) < 16 for p in pieces) and len(" ".join(pieces).split()) >= 16
    copied = some(60)
    rows = [(i, f"{some(20)} {p} {some(20)}") for i, p in enumerate(phrases)] + [(10, f"{some(9)} {' '.join(phrases)} {some(9)}"), (20, f"{some(30)} {copied} {some(30)}"), (21, f"{some(8)} {copied}")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.repeated_passages(d).collect()}
    assert set(got) == {20, 21} and got[21]["first_docs"] == [20] and got[20]["n_removed_words"] == 0
    texts = dict(rows)
    for i, r in got.items():
        (s,) = r["spans"]
        assert texts[i][s["start"] : s["finish"]] in texts[41 - i]
        starts = [m.start() for m in re.finditer(r"\S+", texts[i])]
        assert r["n_words"] == sum(s["start"] <= x < s["finish"] for x in starts) <= 61
    assert {r["doc_id"]: r["text"] for r in substring_dedup.deduplicate(d).collect()}[10] == texts[10]
    copies = spark.createDataFrame([(2 * i + k, t) for i, t in enumerate(some(n) for n in range(16, 56)) for k in (0, 1)], "doc_id long, text string")
    assert [r["text"] == "" for r in substring_dedup.deduplicate(copies).orderBy("doc_id").collect()] == [False, True] * 40


def test_substring_odd_rows(odd, none):
    rows = {r["doc_id"]: r for r in substring_dedup.repeated_passages(odd).collect()}
    assert {4, 5} <= set(rows) and not {1, 2, 3, 6, 7, 10} & set(rows)
    kept = substring_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert substring_dedup.repeated_passages(none).count() == 0


# ---- 3


def test_language_model_scores(spark, texts):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    rows = hmm.query(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_forward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(1)
    k, c = hmm.STATES, 5
    norm = lambda a, axis: a / a.sum(axis, keepdims=True)
    m = hmm.Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), np.vstack((norm(rng.random((c, k)), 0), np.ones(k))))
    text = np.array([3, 1, 4, 1])
    log = hmm.forward(m, hmm.padded([text, text[:2]], c))
    a = m.start * m.emit[text[0]]
    for x in text[1:]:
        a = np.array([sum(a[i] * m.move[i, j] for i in range(k)) * m.emit[x, j] for j in range(k)])
    assert np.isclose(log[0], np.log(a.sum()))
    counts = np.zeros(k + k * k + c * k)
    hmm.expected_counts(m, [text, text[:2]], counts)
    brute = np.zeros((k, k))  # posterior moves of the longer text, by its forward and backward values
    f, g = [m.start * m.emit[text[0]]], [np.ones(k)]
    for x in text[1:]:
        f.append((f[-1] @ m.move) * m.emit[x])
    for x in text[:0:-1]:
        g.insert(0, m.move @ (m.emit[x] * g[0]))
    for t in range(3):
        brute += np.outer(f[t], m.emit[text[t + 1]] * g[t + 1]) * m.move / a.sum()
    alone = np.zeros_like(counts)
    hmm.expected_counts(m, [text], alone)
    assert np.allclose(alone[k : k + k * k].reshape(k, k), brute)
    long = np.zeros_like(counts)
    hmm.expected_counts(m, [np.tile(text, 3000)], long)
    assert np.isclose(long[k + k * k :].sum(), 12000) and np.isclose(long[k : k + k * k].sum(), 11999)
    blocks = np.zeros_like(counts)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(hmm, "TOGETHER", 12)
        assert np.isclose(hmm.expected_counts(m, [np.tile(text, 3000)], blocks), hmm.forward(m, hmm.padded([np.tile(text, 3000)], c))[0])
    assert np.allclose(blocks, long)
    assert np.isclose(counts[:k].sum(), 2) and np.isclose(counts[k : k + k * k].sum(), 4) and np.isclose(counts[k + k * k :].sum(), 6)


def test_each_class_and_the_whole_model_are_distributions(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(("a b a c", "b a", "c c d e", None, ""))], "doc_id long, text string")
    counts = hmm.word_counts(d)
    lex = hmm.lexicon(counts, 5)
    assert lex.tokens == 15 and lex.types == 6 and np.isclose(lex.unigram.sum(), 1)
    m = hmm.baum_welch(d, lex, hmm.first_model(lex), 3)
    assert np.isclose(m.start.sum(), 1) and np.allclose(m.move.sum(1), 1) and np.allclose(m.emit[:-1].sum(0), 1)


def test_language_model_odd_rows(odd, none):
    rows = hmm.score(odd).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)] == [1, 1, 1]
    assert hmm.score(none).count() == 0


# ---- 4


def plain_spans(t):
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, lo, hi in (("card", r"[0-9]([\x20-]?[0-9])+", 14, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            if lo <= len(digits) <= hi and (kind == "phone" or pii.luhn(digits)):
                found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_plain_personal_data(spark, texts):
    rows = pii.query(spark, SF).collect()
    for r in rows:
        want = plain_spans(texts[r["doc_id"]] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]
    assert sum(r["n_email"] for r in rows) > 0


@pytest.mark.parametrize(
    "text,kind,span",
    [
        ("write jane.doe [at] mail (dot) example (dot) com now", "email", "jane.doe [at] mail (dot) example (dot) com"),
        ("bob AT example DOT org.", "email", "bob AT example DOT org"),
        ("jаne@exаmple.com", "email", "jаne@exаmple.com"),
        ("alice@ex​ample.org", "email", "alice@ex​ample.org"),
        ("ip 10 dot 0 dot 0 dot 1", "ip", "10 dot 0 dot 0 dot 1"),
        ("no four one one one 1111 one one one one one one one one!", "card", "four one one one 1111 one one one one one one one one"),
        ("call plus four four two zero seven nine four six zero nine five eight", "phone", "plus four four two zero seven nine four six zero nine five eight"),
        ("４" + "１" * 15, "card", "４" + "１" * 15),
    ],
)
def test_disguised_personal_data(text, kind, span):
    found = pii.all_spans(text)[1]
    assert (kind, span) in [(k, text[a:b]) for k, a, b in found]
    assert span not in pii.masked(text)


@pytest.mark.parametrize("text", ["he is at the cafe. Then he left", "one two three go", "meet at noon dot", "look, a [b] (c)", "naïve café"])
def test_clean_texts_have_no_spans(text):
    assert pii.all_spans(text) == ([], []) and pii.masked(text) == text


def test_personal_data_odd_rows(odd, none):
    rows = {r["doc_id"]: r["spans"] for r in pii.find(odd).collect()}
    assert len(pii.find(odd).collect()) == len(ODD) and rows[1] == [] and len(rows[10]) == 5
    m = pii.mask(odd)
    assert m.columns == odd.columns and m.filter("doc_id = 10").first()["text"].startswith("mail [EMAIL] or [EMAIL], [IP], [CARD], [PHONE]")
    assert pii.mask(none).count() == 0


# ---- 5


def brute_links(sets):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= 75 * len(sets[a] | sets[b]):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {i: root(i) for i in ids}


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("boundary", [None, 4, 40])
def test_links_of_small_and_large_sets(spark, boundary, monkeypatch):
    if boundary:
        monkeypatch.setattr(jaccard_join, "choose_boundary", lambda *a, **k: boundary)
    rng = np.random.default_rng(4)
    rows = []
    for base in range(40):
        w = [f"t{x}" for x in rng.integers(0, 60, rng.integers(3, 90))]
        for _ in range(6):
            u = list(w)
            for _ in range(rng.integers(0, 4)):
                at = rng.integers(0, len(u))
                u[at : at + rng.integers(0, 2)] = [f"t{rng.integers(0, 60)}"]
            rows.append((len(rows), " ".join(u)))
    got = {r["doc_id"]: r for r in jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    assert {i: r["component_id"] for i, r in got.items()} == brute_links(sets)
    assert all(r["n_shingles"] == len(sets[i]) for i, r in got.items())


def test_jaccard_odd_rows(odd, none):
    rows = jaccard_join.link_components(odd).collect()
    assert len(rows) == len(ODD)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got[1] == (0, 1) and got[3] == (0, 3) and got[5][1] == 4 and got[7] == (1, 6)
    one = jaccard_join.keep_one(odd)
    assert one.columns == odd.columns and sorted(str(r["doc_id"]) for r in one.collect()) == sorted(map(str, (None, 1, 2, 3, 4, 6, 8, 9, 10)))
    assert jaccard_join.link_components(none).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(200, 200), (7, 3), (3, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


# ---- 6


def test_encoding_is_the_librarys(spark, texts):
    ref = Tokenizer.from_file(bpe.default_vocabulary())
    for r in bpe.query(spark, SF).collect():
        ids = ref.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encoding_of_random_texts():
    ref, table = Tokenizer.from_file(bpe.default_vocabulary()), bpe.coder(bpe.default_vocabulary())
    cache, rng = bpe.PieceCache(table), np.random.default_rng(2)
    odd = [t for _, t, *_ in ODD if t] + ["ab" * 2000, " " * 300 + "a", "<|endoftext|><|endoftext|> x", "\u0000­\U0001f600"]
    for t in odd + ["".join(rng.choice(list("enthrisoad '\n1é中"), rng.integers(0, 80))) for _ in range(1500)]:
        ids = np.frombuffer(table.encode(t, cache), "<u4")
        assert ids.tolist() == ref.encode(t, add_special_tokens=False).ids
        assert table.decode(ids.astype(np.int64)).decode() == t


def test_encoding_odd_rows(odd, none):
    rows = bpe.encode(odd).collect()
    assert len(rows) == len(ODD) and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert bpe.encode(none).count() == 0


# ---- 7


def test_base_figures(spark, texts):
    for r in quality.query(spark, SF).collect():
        t = texts[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        c = Counter(zip(w, w[1:], w[2:]))
        cover = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])


def test_labels_agree(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed")
    n = {(r["quality"], r["kept"]): r["n"] for r in got.groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert n.get((1, False), 0) <= 0.02 * n[(1, True)] and n.get((0, True), 0) <= 0.1 * n[(0, False)]


def test_quality_odd_rows(odd, none):
    rows = quality.judge(odd).collect()
    assert len(rows) == len(ODD) and not any(r["kept"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert quality.keep_good(odd).columns == odd.columns
    assert quality.judge(none).count() == 0


# ---- 8


def test_mix_meets_its_targets(spark, docs):
    rows = mixing.query(spark, SF).toPandas()
    assert (rows["taken"] <= 2 * rows["size"]).all()
    src = docs.select("doc_id", "source").toPandas().merge(rows, on="doc_id")
    per = src.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), top=("size", "max"))
    assert (abs(per["taken"] - per["target"]) <= 2 * per["top"]).all()
    assert abs(per["target"].sum() - 1.5 * rows["size"].sum()) < 1e-6 * rows["size"].sum()
    again = mixing.query(spark, SF).toPandas()
    assert rows.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()


def test_mix_repeats_rows_as_planned(docs, odd, none):
    plan = {r["doc_id"]: r["copies"] for r in mixing.plan_copies(docs).collect()}
    got = {r["doc_id"]: r["n"] for r in mixing.mix(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {i: n for i, n in plan.items() if n}
    p = mixing.plan_copies(odd)
    assert p.count() == len(ODD) and mixing.mix(odd).columns == odd.columns
    assert mixing.mix(odd).count() == p.agg(F.sum("copies")).first()[0]
    assert mixing.plan_copies(none).count() == 0 and mixing.mix(none).count() == 0


# ---- 9


def test_quotes_are_linked_and_dropped(spark):
    rows = [
        (1, 0, "u", "Hello there\nHow are  you?"), (1, 1, "a", "> hello there\nHi!\nFine"), (1, 2, "u", "unrelated\nmore"), (1, 3, "u", "> > Hello There\n> Fine\nGood"), (1, 4, "u", "> more\nyes"),
        (1, 5, "a", "> nowhere\nx"), (2, 0, "u", None), (2, 1, "u", ""), (None, 3, "u", "> Hello there"), (2, None, "u", "y"), (1, 2000, "c", ">z\nend"), (1, 2000, "c", ">z\nend"),
    ]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(0) for c in ("level", "n", "parts", "position", "rank")})
    got = {(r["conv_id"], r["turn"]): r for r in quotation.reply_order(d).collect()}
    assert [got[1, t]["parent_turn"] for t in range(6)] == [None, 0, None, 1, 2, None]
    assert [got[1, t]["thread_turn"] for t in range(6)] == [0, 0, 2, 0, 2, 5]
    assert [got[1, t]["position"] for t in range(6)] == [1, 2, 4, 3, 5, 6]
    assert got[1, 3]["own_text"] == "Good" and got[1, 3]["n_quoted"] == 2 and got[2, 0]["own_text"] == ""
    assert quotation.reply_order(d).count() == len(rows) and quotation.reply_order(d.limit(0)).count() == 0


def test_quotes_of_lines_that_several_messages_hold(spark):
    rows = [
        (1, 1, "Hi all\nfirst\nBest, J"), (1, 7, "Hi all\nthe point\nBest, J"), (1, 8, "> Hi all\n> the point\n> Best, J\nyes"), (1, 9, "> hi  all\nwhom?"),
        (2, 0, "Hi all\na1\na2\na3"), (2, 1, "a1\na2\na3\nalone"), (2, 2, "one"), (2, 3, "> a1\n> a2\n> a3\n> alone\nx"), (2, 4, "> a1\n> a2\n> a3\n> one\nx"),
    ]
    rng = np.random.default_rng(6)
    for turn in range(120):
        own = [f"l{x}" for x in (rng.integers(0, 40, 3) ** 2) // 40]
        rows.append((3, turn, "\n".join([*own, *(f"{'>' * rng.integers(1, 3)} l{x}" for x in (rng.integers(0, 44, rng.integers(0, 6)) ** 2) // 40)])))
    d = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["parent_turn"], r["n_linked"]) for r in quotation.link_quotes(d).collect()}
    want, own = {}, defaultdict(set)
    for c, t, x in rows:
        own[c] |= {(" ".join(y.lower().split()), t) for y in x.split("\n") if y[0] != ">"}
    for c, t, x in rows:
        quoted = [(len(y) - len(y.lstrip(">")), " ".join(y.lstrip(">").lower().split())) for y in x.split("\n") if y[0] == ">"]
        quoted = [(level, y) for level, y in quoted if any(z == y and u < t for z, u in own[c])]
        sums = Counter()
        for level, y in quoted:
            if level == min(quoted)[0]:
                at = [u for z, u in own[c] if z == y]
                sums.update({u: (1 << 32) // len(at) for u in at if u < t})
        if sums:
            want[c, t] = (min(sums, key=lambda u: (-sums[u], u)), len(quoted))
    assert got == want
    assert [got[k][0] for k in ((1, 8), (1, 9), (2, 3), (2, 4))] == [7, 1, 1, 0]


# ---- 10


def test_main_text_of_the_pages(spark):
    import html

    for r in html_text.query(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        a = r["html"].split("<article>", 1)[1].split("</article>", 1)[0]
        a = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", "\0", a))
        want = "\n".join(y for y in (" ".join(html.unescape(z).split()) for z in a.split("\0")) if y)
        assert r["text"] == want and r["n_chars"] == len(want)


def test_main_text_leaves_the_rest_out():
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies.</div><nav><ul><li>Home</li></ul></nav>'
        '<div class="sidebar"><p>Long sidebar text, with commas, and more. And so on, really.</p></div><div class="post"><h2>Title</h2><p>First para, with text &amp; more &#233;. It goes on, on and on.</p>'
        '<p>Be.</p><form><p>sign up</p></form><div class="advert">Buy!</div><script>if (a < b) "</p>";</script><p>Last <i>para</i>graph.</div><section id="comments"><p>I think, therefore. A lot, a lot of text, here!</p></section><footer>(c)</footer>'
    )
    assert html_text.extract(page) == "Title\nFirst para, with text & more é. It goes on, on and on.\nBe.\nLast paragraph."
    assert [html_text.extract(x) for x in (None, "", "<nav>x</nav>", "plain", "<p>a<p>b", "<div>a<div>b</div>c", "<<>a", "<p")] == ["", "", "", "plain", "a\nb", "a\nb\nc", "<<>a", "<p"]


def test_main_text_of_several_containers_is_whole():
    text = lambda name, n: "".join(f"<p>{name} para {i}, with text, and more. It goes on, on and on.</p>" for i in range(n))
    lines = lambda page: re.findall(r">([^<>]+)<", page)
    rest = "<nav>Home</nav><div><a>Log</a></div>"
    for split in ((6, 4), (19, 1)):
        a, b = (text(x, n) for x, n in zip("ab", split))
        for part in (
            f"<main><h1>Title</h1><div class='text'>{a}</div><div class='text'>{b}</div></main>",
            f"<div class='content'><h1>Title</h1><div class='text'>{a}</div><div class='text'>{b}</div></div>",
            f"<article><h2>One</h2>{a}</article><article><h2>Two</h2>{b}</article>",
            f"<article><h1>Title</h1><article>{a}</article>{b}</article>",
            f"<div class='x1'>{a}</div><div class='x2'>{b}</div>",
        ):
            got = html_text.extract(f"<html><body>{part}</body></html>").split("\n")
            assert got == lines(part)
            if "<main>" in part or "<article>" in part or "content" in part:
                assert html_text.extract(f"<html><body>{rest}{part}{rest}</body></html>").split("\n") == lines(part)
    page = f"<html><body><div><a>Log</a></div><div class='post'><h1>Title</h1>{text('a', 19)}</div><div class='x'><p>Elsewhere, a <b>bold</b> text, and more. It goes on, on and on.</p></div></body></html>"
    assert html_text.extract(page).split("\n") == ["Title", *lines(text("a", 19)), "Elsewhere, a bold text, and more. It goes on, on and on."]


def test_pages_odd_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "u", "<p>x</p>"), (3, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (4, "u", "<p>" + "long text, " * 30000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.main_text(d).collect()
    assert len(got) == 6 and {r["text"] for r in got if r["page_id"] in (1, 2)} == {""} and [r["text"] for r in got if r["page_id"] == 3] == ["deep"]
    assert html_text.main_text(d.limit(0)).count() == 0


# ---- pipeline


def test_pipeline_stages_take_effect(spark, docs, texts):
    rows = corpus_pipeline.run(spark, SF).collect()
    judged = {r["doc_id"]: r["kept"] for r in quality.query(spark, SF).collect()}
    kept = {i: t for i, t in texts.items() if judged[i]}
    roots = brute_links({i: shingles(t) for i, t in kept.items()})
    kept = {i: pii.masked(t) for i, t in kept.items() if roots[i] == i}
    ref = Tokenizer.from_file(bpe.default_vocabulary())
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    d = spark.createDataFrame([(i, t, sources[i]) for i, t in kept.items()], "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.plan_copies(d).collect()}
    assert Counter(r["doc_id"] for r in rows) == {i: n for i, n in copies.items() if n}
    for r in rows:
        assert r["ids"] == ref.encode(kept[r["doc_id"]], add_special_tokens=False).ids


def test_pipeline_contract(spark):
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5 and corpus_pipeline.ORACLE_SQL is None
    d = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns and [f.dataType for f in out.schema] == [f.dataType for f in d.schema]
