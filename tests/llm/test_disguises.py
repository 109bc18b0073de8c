"""Disguised identifiers: each case that was missed once, source ranges by brute force, long texts."""

import random
import resource
import subprocess
import sys

import pytest

from pairlattice.llm import pii

CASES = [
    ("write to j4ne at example.com today", "email", "j4ne at example.com"),
    ("mail jane at example.com", "email", "jane at example.com"),
    ("𝐣𝐚𝐧𝐞@example.com", "email", "𝐣𝐚𝐧𝐞@example.com"),
    ("by john (a) example.com", "email", "john (a) example.com"),
    ("jane&#64;example.com", "email", "jane&#64;example.com"),
    ("jane&commat;example&period;com", "email", "jane&commat;example&period;com"),
    ("jane＿doe@example.com", "email", "jane＿doe@example.com"),
    ("a dot b dot c dot d dot e dot f [at] s dot t dot u dot v dot w dot x dot y dot com", "email", "a dot b dot c dot d dot e dot f [at] s dot t dot u dot v dot w dot x dot y dot com"),
    ("ruf an: plus vier neun drei null eins zwei drei vier fünf sechs sieben acht", "phone", "plus vier neun drei null eins zwei drei vier fünf sechs sieben acht"),
    ("appelez plus trois trois un quatre deux cinq six sept huit neuf zéro", "phone", "plus trois trois un quatre deux cinq six sept huit neuf zéro"),
    ("llama +tres cuatro seis cero cero uno dos tres cuatro cinco seis", "phone", "+tres cuatro seis cero cero uno dos tres cuatro cinco seis"),
    ("+forty-four 20 7946 0958", "phone", "+forty-four 20 7946 0958"),
    ("plus vierundvierzig zwanzig 7946 0958", "phone", "plus vierundvierzig zwanzig 7946 0958"),
    ("+44 double two 7946 0958", "phone", "+44 double two 7946 0958"),
    ("+44 20 7946 O958", "phone", "+44 20 7946 O958"),
    ("no 4l11 1111 1111 1111.", "card", "4l11 1111 1111 1111"),
    ("host 10.O.0.l is up", "ip", "10.O.0.l"),
]


@pytest.mark.parametrize("text,kind,span", CASES)
def test_disguises_are_found_and_masked(text, kind, span):
    found = pii.all_spans(text)[1]
    assert (kind, span) in [(k, text[a:b]) for k, a, b in found]
    assert span not in pii.masked(text) and f"[{kind.upper()}]" in pii.masked(text)


def test_spans_keep_their_places_among_other_text():
    rng = random.Random(2)
    for _ in range(200):
        picked = [rng.choice(CASES) for _ in range(rng.randint(1, 6))]
        text = "\n".join(f"{rng.choice(['naïve words', 'clean words', 'ﬁne words'])}.\n{t}" for t, _, _ in picked)
        found = {(k, text[a:b]) for k, a, b in pii.all_spans(text)[1]}
        assert {(k, s) for _, k, s in picked} <= found


@pytest.mark.parametrize("text", ["meet me at example.com", "one of two, three or four", "he sat at home.He slept", "1 or 2 of 10.0 l", "see B2B and 4x4, O2", "R&D &amp; more", "the un deux trois of it", "look at 3.5 or 4.1.2"])
def test_clean_texts_stay_clean(text):
    assert pii.all_spans(text) == ([], []) and pii.masked(text) == text


def test_a_tape_goes_back_through_all_its_edits():
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choice("abcdef") for _ in range(30))
        tape, source = pii.Tape(text), [(i, i + 1) for i in range(30)]
        for _ in range(3):
            n, edits, at = len(tape.text), [], 0
            while at < n - 3:
                at += rng.randint(0, 4)
                end = min(n, at + rng.randint(1, 3))
                edits.append((at, end, "xyz"[: rng.randint(1, 3)]))
                at = end
            edits = [x for x in edits if x[0] < x[1]]
            out, done = [], 0
            for a, b, new in edits:
                out += source[done:a] + [(source[a][0], source[b - 1][1])] * len(new)
                done = b
            source = out + source[done:]
            tape.rewrite(edits)
        assert len(source) == len(tape.text)
        for _ in range(20):
            a, b = sorted(rng.sample(range(len(source) + 1), 2))
            assert tape.back(a, b) == (source[a][0], source[b - 1][1])


def test_a_longer_hidden_span_stands_beside_the_base_span():
    text = "jane＿doe@example.com"
    assert pii.all_spans(text) == ([("email", 5, 20)], [("email", 0, 20), ("email", 5, 20)]) and pii.masked(text) == "[EMAIL]"


def test_long_texts_take_bounded_memory():
    code = "import resource; from pairlattice.llm import pii; t='one two three '*900000+' end'; pii.all_spans(t); pii.all_spans('a dot b '*1000000); print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    used = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) // 1024
    assert used < 400  # MB, for 12.6 million characters


@pytest.mark.parametrize("piece", ["one ", "a dot ", "a at b ", "a [at] ", "0-", "+1 ", "l0", "&#64;", "dot ", "x@"])
def test_long_lines_take_linear_time(piece):
    def seconds(n):
        start = resource.getrusage(resource.RUSAGE_SELF).ru_utime
        pii.all_spans(piece * (n // len(piece)))
        return resource.getrusage(resource.RUSAGE_SELF).ru_utime - start

    small, large = seconds(40_000), seconds(320_000)
    assert large < 16 * small + 1.0
