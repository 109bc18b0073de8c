"""Passages planted into texts are found by their chunks."""

import numpy as np
import pytest

from pairlattice.llm import substring_dedup


@pytest.mark.parametrize("words, least", [(51, 0.985), (80, 0.995)])
def test_planted_passages_are_found(spark, words, least):
    rng, pairs = np.random.default_rng(words), 800
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(20_000)]
    some = lambda n: " ".join(vocabulary[i] for i in rng.integers(0, len(vocabulary), n))
    rows = []
    for i in range(pairs):
        passage = some(words)
        for k in (0, 1):
            before = int(rng.integers(0, 100))
            rows.append((2 * i + k, f"{some(before)} {passage} {some(100 - before)}".strip(), passage))
    found = {r["doc_id"]: r["spans"] for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string, passage string")).collect()}
    inside = 0
    for doc_id, text, passage in rows:
        at = text.index(passage)
        for s in found.get(doc_id, ()):  # nothing but the passage is repeated
            assert at - 1 <= s["start"] and s["finish"] <= at + len(passage) + 1
        inside += doc_id in found
    assert inside >= least * len(rows)
