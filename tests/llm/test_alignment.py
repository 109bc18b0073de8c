"""Aligned tokens against whole texts' tokens, matched by their byte offsets in plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairlattice.llm import alignment
from pairlattice.llm.bpe import _byte_letters

SF = "/root/testdata/sf0.001"
A, B = alignment.vocabulary("byte_bpe_50k.json"), alignment.vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def whole():
    """text -> its A and B ids with their bytes, encoded in one go."""
    a, b, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), _byte_letters()
    a.encode_special_tokens = True
    piece = lambda s: bytes([int(s[3:5], 16)]) if len(s) == 6 and s.startswith("<0x") else s.replace("▁", " ").encode()

    def encoded(text):
        x = a.encode(" " + text, add_special_tokens=False)
        ids = b.encode(text)
        return [(i, bytes(letters[c] for c in t)) for i, t in zip(x.ids, x.tokens)], [(i, piece(b.id_to_piece(i))) for i in ids]

    return encoded


def brute(rows, encoded):
    out, links = [], []
    for doc_id, text in rows:
        a, b = encoded(text) if text else ([], [])
        goal = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != goal or b"".join(x for _, x in b) != goal:
            out.append([doc_id, 0, 0, 0, 0, ""])
            links.append([])
            continue
        ends = [{int(e): t[0] for e, t in zip(np.cumsum([len(x) for _, x in side]), side)} for side in (a, b)]
        both = sorted(ends[0].keys() & ends[1].keys())
        cut = [np.split([str(i) for i in side.values()], np.searchsorted(list(side), both, "right"))[:-1] for side in ends]
        groups = ["|".join(map(",".join, pair)) for pair in zip(*cut)]
        links.append([(ends[0][e], ends[1][e]) for e in both])
        out.append([doc_id, len(a), len(b), len(both), len(both), hashlib.sha256(";".join(groups).encode()).hexdigest()])
    count = Counter(x for y in links for x in y)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [(*o[:5], sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own), o[5]) for o, own in zip(out, links)]


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()), key=str)


def test_documents_by_whole_texts(spark, whole):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(alignment.query(spark, SF)) == sorted(brute(docs, whole), key=str)


def random_text(rng):
    bits = ["the", "Word", "don't", "é", "中文字", "🙂", "12345", "...", "<|endoftext|>", "<0x41>", "<s>", "\x1c", " ", "▁", "x\0y", "aaaaaaaaaaaaaaaaaaaa", "　", "\x85"]
    return "".join(rng.choice(bits[:13] if rng.random() < 0.97 else bits) + rng.choice([" ", " ", " ", "", "  ", "\n", " \n\t ", "  "]) for _ in range(rng.choice([1, 3, 30])))


@pytest.mark.parametrize("part, kept", [(1 << 20, 128 << 20), (20, 2000), (1, 1)])
def test_odd_texts_in_parts(spark, whole, monkeypatch, part, kept):
    rng = random.Random(part)
    rows = [(i, random_text(rng)) for i in range(150)] + [(None, None), (1, ""), (1, " "), (2, " lead and trail "), (3, "same text"), (3, "same text"), (None, "a▁b c"), (7, "long words " * 3000), (8, "z" * 20_000)]
    monkeypatch.setattr(alignment, "PART", part)
    monkeypatch.setattr(alignment, "KEPT_BYTES", kept)
    paths, known = (A, B), {}
    monkeypatch.setattr(alignment, "_KNOWN", known)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in some], "text": [r[1] for r in some]}) for some in (rows[:70], rows[70:])]
    aligned = list(alignment._aligned_rows(paths, True)(batches))
    out = [x for b in aligned for x in alignment._partial_counts([b.select(["n_groups", "links"])])]
    merged = alignment.summed(*(np.concatenate([x.column(i).to_numpy() for x in out]) for i in (0, 1)))
    table = pa.RecordBatch.from_arrays([pa.array(x) for x in merged], ["key", "n"])
    shards = [np.frombuffer(x, np.int64).reshape(3, -1) for x in next(alignment._run_lengths([table.slice(0, 5), table.slice(5)])).column(1).to_pylist()]
    looked = alignment.CountShards([])
    looked.shards, looked.first = shards, np.array([s[0, 0] for s in shards])
    monkeypatch.setattr(alignment, "CountShards", lambda files: looked)
    got = [r for x in alignment._looked_up([])(aligned) for r in x.to_pylist()]
    assert [tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in got] == brute(rows, whole)
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in got if r["groups"])


def test_odd_rows_on_spark(spark, whole):
    rng = random.Random(3)
    rows = [(i, random_text(rng)) for i in range(60)] + [(None, None), (4, ""), (4, "twice the same"), (4, "twice the same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n_a", "key", "n", "groups", "first", "shard")})
    assert rows_of(alignment.align(df.repartition(5))) == sorted(brute(rows, whole), key=str)
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_of_one_key_over_batches():
    import pyarrow as pa

    keys, n = np.repeat(np.array([1, 2, 1 << 32, (1 << 32) + 5]), [3, 1, 4, 2]), np.arange(1, 11)
    whole = pa.RecordBatch.from_pydict({"key": keys, "n": n})
    for step in (1, 3, 10):
        out = next(alignment._run_lengths(whole.slice(i, step) for i in range(0, 10, step)))
        shard = np.frombuffer(out.column(1)[0].as_py(), np.int64).reshape(3, -1)
        assert shard.tolist() == [[1, 2, 1 << 32, (1 << 32) + 5], [6, 4, 26, 19], [1, 0, 1, 0]]


def test_pairs_are_bounded_by_the_vocabularies():
    assert alignment.coders(A, B).most_pairs() < 500_000
