"""Fill-in-the-middle documents against a plain cut with the contract's pattern."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlattice.llm import fill_middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n, h = len(tokens), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:lo]), "".join(tokens[lo:hi]), "".join(tokens[hi:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def random_text(rng):
    kinds = rng.choice([" a", " \n\tab", "é中 🙂x", " ", "a", "a   <P>"])
    return "".join(rng.choice(kinds) for _ in range(rng.choice([0, 1, 2, 7, 8, 9, 40, 300])))


@pytest.mark.parametrize("chunk, block", [(1, 1), (3, 6), (8, 16), (1 << 14, 1 << 22)])
def test_random_texts_at_any_chunk_size(monkeypatch, chunk, block):
    rng = random.Random(chunk)
    texts = [random_text(rng) for _ in range(300)]
    monkeypatch.setattr(fill_middle, "CHUNK", chunk)
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    run = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    starts, first = fill_middle.chunk_starts(offsets)
    sums = np.concatenate(([0], np.cumsum(fill_middle.count_ends(run, offsets, starts))))
    for i, t in enumerate(texts):
        tokens = TOKEN.findall(t)
        assert sums[first[i + 1]] - sums[first[i]] == len(tokens)
        for k in range(len(tokens) + 1) if t else ():
            at = fill_middle.cut_places(run, starts, sums, first[i], first[i + 1], offsets[i + 1], (k, k))[0]
            assert at - offsets[i] == len("".join(tokens[:k]).encode())


def test_documents_by_plain_cuts(spark):
    rng = random.Random(5)
    rows = [(i, random_text(rng)) for i in range(400)] + [(None, "one two three"), (7, None), (3, "x" * 300_000), (4, "a b\n" * 200_000), (5, " " * 100_000), (5, " " * 100_000), (9, "clean <M> text of a few words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n", "form", "document", "prefix_chars")})
    got, order = fill_middle.transform(docs).collect(), lambda r: (str(r[0]), r[5])
    assert sorted(map(tuple, got), key=order) == sorted(((i, *brute(i, t)) for i, t in rows), key=order)
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}


def test_documents_give_their_texts_back():
    for i in range(200):
        text = random_text(random.Random(i)).replace("<", "")
        for form in ("spm", "psm", "plain"):
            cut = sorted(random.Random(i).choices(range(len(text.encode()) + 1), k=2))
            document = fill_middle.arranged(text.encode(), *cut, form)
            assert b"".join(fill_middle.restored(document, form)) == text.encode()


def test_empty_table(spark):
    assert fill_middle.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0
