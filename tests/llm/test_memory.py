"""Very long texts and odd runs take bounded memory, each in a process of its own."""

import subprocess
import sys
import textwrap
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
LANGUAGE_MODEL = """
    import numpy as np, pyarrow as pa
    from pairlattice.llm import hmm
    text = " ".join(f"w{i % 90_000}" for i in range(10_000_000))
    lex = hmm.Lexicon(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(hmm.SHARED_CLASSES), hmm.SHARED_CLASSES + 1, 1, 1, 1, np.full(hmm.SHARED_CLASSES + 1, 1 / (hmm.SHARED_CLASSES + 1)))
    known, held = hmm.Words(lex), []
    for words in hmm.word_parts(text):
        held.append(known.classes[known.of(words)].astype(np.uint16))
    del text, words
    classes = np.concatenate(held)
    assert len(classes) == 10_000_000
    model = hmm.first_model(lex)
    counts = np.zeros(hmm.STATES + hmm.STATES**2 + lex.n_classes * hmm.STATES)
    some = classes[:2_000_000]  # the recursion's memory does not depend on the length; its time does
    likely = hmm.expected_counts(model, [some], counts)
    assert np.isclose(counts[hmm.STATES + hmm.STATES**2 :].sum(), len(some))
"""
JUNK_WORDS = """
    import random
    from pairlattice.llm import hmm, bpe
    import numpy as np
    lex = hmm.Lexicon(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(hmm.SHARED_CLASSES), hmm.SHARED_CLASSES + 1, 1, 1, 1, np.full(hmm.SHARED_CLASSES + 1, 1 / (hmm.SHARED_CLASSES + 1)))
    known, cache, coder = hmm.Words(lex), bpe.piece_cache(bpe.default_vocabulary()), bpe.coder(bpe.default_vocabulary())
    for i in range(1500):
        word = ("%09d" % i) * 100_000
        for words in hmm.word_parts(word):
            known.of(words)
        if i < 30:
            coder.encode("".join(chr(97 + i % 26)) * 100_000, cache)
    assert known.held < 2 * hmm.KEPT_BYTES and not any(len(x) > 64 for x in cache)
"""


@pytest.mark.parametrize("code", [LANGUAGE_MODEL, JUNK_WORDS], ids=["language model", "junk words"])
def test_peak_memory_is_under_a_gigabyte(code):
    peak = "\nimport resource\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code) + peak], cwd=ROOT, capture_output=True, text=True, timeout=600, check=False)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split()[-1]) < 1000
