"""Scores of the language model, end to end, by plain recursion and plain counts."""

import math
import zlib
from collections import Counter

import numpy as np
import xxhash

from pairlattice.llm import hmm


def test_scores_by_plain_recursion(spark, monkeypatch):
    rng = np.random.default_rng(7)
    words = [f"{a}{b}" for a in ("sta", "ber", "lin", "mor", "qua", "tes") for b in ("ing", "ed", "ly", "er", "s", "7!")]
    texts = {i: " ".join(rng.choice(words[: 36 if i % 4 else 20], rng.integers(0, 60))) + (f" only{i}" if i % 3 == 0 else "") for i in range(60)}
    texts[60], texts[61] = None, ""
    kept = {}

    def train(encoded, lex, model, real=hmm.train_model):
        kept.update(lex=lex, model=real(encoded, lex, model))
        return kept["model"]

    monkeypatch.setattr(hmm, "train_model", train)
    rows = hmm.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    lex, model = kept["lex"], kept["model"]
    n_own = lex.n_classes - 1 - hmm.SHARED_CLASSES
    known = dict(zip(lex.hashes.tolist(), lex.classes.tolist()))
    class_of = lambda w: known.get(xxhash.xxh64_intdigest(w) - (1 << 64 if xxhash.xxh64_intdigest(w) >> 63 else 0), n_own + hmm.shared_class(w))
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    count = Counter(w for i, t in texts.items() if not held[i] for w in hmm.words_of(t))
    total, types = Counter(), Counter()
    for w, c in count.items():
        total[class_of(w)] += c
        types[class_of(w)] += 1
    assert len(rows) == len(texts)
    for r in rows:
        tokens = hmm.words_of(texts[r["doc_id"]])
        classes = [class_of(w) for w in tokens] + [hmm.lex_end(lex)]
        shares = sum(math.log10((count[w] + 0.5) / (total[c] + 0.5 * (types[c] + 1))) for w, c in zip(tokens, classes) if c >= n_own)
        a = [float(model.start[k] * model.emit[classes[0], k]) for k in range(hmm.STATES)]
        for c in classes[1:]:
            a = [sum(a[j] * model.move[j, k] for j in range(hmm.STATES)) * model.emit[c, k] for k in range(hmm.STATES)]
        assert math.isclose(r["score"], math.log10(sum(a)) + shares, rel_tol=1e-9)


def test_every_row_is_in_one_part_and_in_every_full_round(spark, monkeypatch):
    seen = []

    def count(encoded, lex, model, real=hmm.train_round):
        seen.append(encoded.count())
        return real(encoded, lex, model)

    monkeypatch.setattr(hmm, "train_round", count)
    hmm.score(spark.createDataFrame([(i, f"a{i % 5} b{i % 3} c") for i in range(90)], "doc_id long, text string"), "false").count()
    assert sum(seen[: hmm.PARTS_FIRST]) == 90 and len(seen) > hmm.PARTS_FIRST and set(seen[hmm.PARTS_FIRST :]) == {90}
