"""Personal data in whole texts: plain patterns, and an offset-preserving deobfuscation.

``base_spans`` finds e-mail addresses, IPv4 addresses, card and phone numbers as written.
``hidden_spans`` looks at the lines in which something looks disguised (no pattern crosses a line) and
runs a chain of transducers over each. A transducer gives edits, ranges of its input and what
stands for them; a tape keeps the edits, not positions of characters, so it is as long as what was disguised.

1. ``plain_letters``: characters whose compatibility form (Unicode NFKC) is ASCII, homoglyphs of
   other scripts (``HOMOGLYPHS``) and character references become ASCII, format characters vanish;
2. ``plain_digits``: number words of English, German, French and Spanish (digits, teens, tens with their units,
   "double" and "triple") become digits where four or more digits stand in a row; in numbers of mostly digits
   letters that look like digits become those;
3. ``plain_signs``: "[at]", "(dot)", " AT x DOT y" and the like become "@" and ".", between parts
   of an address of any number of labels. A spoken "at" before a plain domain counts only if the
   part before holds a digit or a sign, or a word like "mail" or "contact" stands shortly before;
   what is left out: addresses spelled letter by letter, and those without any "at"; network addresses whose numbers are
   spelled digit by digit in words or with spaces between their digits. "at 10.30 dot com" is taken for an address.

The same patterns then run on the normalised line, and what they find is mapped back through the
edits. A hidden span is added unless a base span, or another hidden one, holds all of it; so an address of which the
plain pattern sees a part only is given whole, beside that part. Base spans always stay.

Defined cases: a null or empty text has no spans; repeated rows each get a row; an empty
table gives an empty result; very long lines and digit, letter or label runs take linear time; further
columns are ignored by ``find`` and kept by ``mask``.
"""

from __future__ import annotations

import io
import re
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlattice.llm.common import bounded_batches

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only start where a digit run starts, so the look-behind keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_ANY = re.compile(r"[0-9@]")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """By the at signs: the longest local part before one that no earlier match holds, then a domain."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        end = _DOMAIN.match(text, at + 1) if start < at else None
        if end:
            yield start, end.end()
            done = end.end()
        at += 1
        done = max(done, at) if not end else done


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    if not _ANY.search(text):
        return []
    found: list[Span] = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 3 or len(p) == 3 and p <= "255" for part in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# Letters of other scripts that look like ASCII ones and have no compatibility form.
HOMOGLYPHS = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТУХЬаеорсухіјѕԁԛԝһӏѵгт", "ABESIJKMHOPCTYXbaeopcyxijsdqwhlvrt"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγικνορυωϲϳ", "ABEZHIKMNOPTYXayiKvopuwcj"),
    "Armenian": ("օոսցհԼՏՕ", "onughLSO"),
    "Latin": ("ıɑɡɩʏᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡᴢℓ", "iagiYABCDEFGHIJKLMNOPRSTUVWZl"),
    "signs": ("‐‑‒–—−∙·․。｡٫ꓸ", "------......."),
}


def _compatible() -> dict[int, str]:
    """Characters outside ASCII that stand for ASCII ones by NFKC, or by the table above, and format characters, which stand for nothing."""
    found = {}
    for start, stop in ((0xA0, 0x3400), (0xA640, 0xAC00), (0xFB00, 0x10000), (0x1D400, 0x1D800), (0x1F100, 0x1F200), (0x1FBF0, 0x1FBFA)):
        for code in range(start, stop):
            c = chr(code)
            if unicodedata.category(c) in ("Cf", "Mn") and (unicodedata.category(c) == "Cf" or 0xFE00 <= code <= 0xFE0F):
                found[code] = ""
            elif (digit := unicodedata.digit(c, None)) is not None and unicodedata.category(c) == "Nd":
                found[code] = str(digit)
            elif (plain := unicodedata.normalize("NFKC", c)) != c and plain.isascii() and plain.isprintable() and c not in "ªº¹²³":
                found[code] = plain
    for ours, plain in HOMOGLYPHS.values():
        found |= {ord(c): p for c, p in zip(ours, plain, strict=True)}
    return found


_PLAIN = _compatible()
_ONE_TO_ONE = {c: p for c, p in _PLAIN.items() if len(p) == 1}


def _class(codes: list[int]) -> str:
    """A character class of ranges."""
    out, codes = [], sorted(codes)
    for i, c in enumerate(codes):
        if i and codes[i - 1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" if a < b else re.escape(chr(a)) for a, b in out) + "]"


_STRANGE = re.compile(_class(list(_PLAIN)))
_LENGTHENED = re.compile(_class([c for c, p in _PLAIN.items() if len(p) != 1]))
_REFERENCE = re.compile(r"&(?:#[xX]0*+([0-9A-Fa-f]{2})|#0*+([0-9]{2,3})|(commat|period|lowbar|hyphen|dash|plus|nbsp));?")
_NAMED = {"commat": "@", "period": ".", "lowbar": "_", "hyphen": "-", "dash": "-", "plus": "+", "nbsp": " "}

#: Number words per language, digits, then ten to nineteen, then tens.
DIGIT_WORDS = {
    "en": ("zero one two three four five six seven eight nine", "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen", "twenty thirty forty fifty sixty seventy eighty ninety"),
    "de": ("null eins zwei drei vier fünf sechs sieben acht neun", "zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn", "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig"),
    "fr": ("zéro un deux trois quatre cinq six sept huit neuf", "dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf", "vingt trente quarante cinquante soixante"),
    "es": ("cero uno dos tres cuatro cinco seis siete ocho nueve", "diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve", "veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa"),
}
_MORE_DIGITS = {"oh": "0", "nought": "0", "zwo": "2", "fuenf": "5", "zero": "0", "une": "1"}


def _number_words() -> tuple[dict[str, str], dict[str, str]]:
    """Words of one digit, and words of two; tens take the unit after them, German units come first."""
    units, two = dict(_MORE_DIGITS), {}
    for digits, teens, tens in DIGIT_WORDS.values():
        units |= {w: str(i) for i, w in enumerate(digits.split())}
        two |= {w: str(10 + i) for i, w in enumerate(teens.split())}
        two |= {w: str(20 + 10 * i) for i, w in enumerate(tens.split())}
    german = DIGIT_WORDS["de"]
    for i, unit in enumerate(["ein", *german[0].split()[2:]], 1):
        two |= {f"{unit}und{w}": str(20 + 10 * j + i) for j, w in enumerate(german[2].split())}
    return units, two


_UNITS, _TWO = _number_words()
_TENS = {w for w, v in _TWO.items() if v[1] == "0" and v != "10"}
_words = lambda words: "|".join(sorted(map(re.escape, words), key=len, reverse=True))
_NUMBER = re.compile(rf"(?<![^\W0-9_])(?:({_words(_TENS)})(?:-et-|-|\x20(?:et|y)\x20|\x20)({_words(_UNITS)})|({_words([*_UNITS, *_TWO])}|double|triple))(?![^\W0-9_])|([0-9]+)")
_GAP = re.compile(r"[\x20().,-]*+")
_NUMBER_WORDS = frozenset(y for x in (*_UNITS, *_TWO, "double", "triple") for y in x.split("-"))


_CAPITALS = {c: c + 32 for c in (*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF))}


def _lower(text: str) -> str:
    """Small letters, place by place."""
    return text.lower() if text.isascii() else text.translate(_CAPITALS)


def _spells(text: str) -> bool:
    """Whether a number word is followed by another one or by digits; long texts are read piece by piece."""
    at, words = 0, []
    while at < len(text):
        end = text.find(" ", at + (1 << 20))
        plain = text[at : len(text) if end < 0 else end].lower()
        for sign in "-,.()":
            plain = plain.replace(sign, " ")
        words = words[-2:] + plain.split()
        hits, i = bytes(map(_NUMBER_WORDS.__contains__, words)), -1
        while (i := hits.find(1, i + 1)) >= 0:
            after = words[i + 1 : i + 3]
            if after and (after[0] in _NUMBER_WORDS or after[0][:1].isdigit() or (after[0] in ("et", "y") and after[-1] in _NUMBER_WORDS)):
                return True
        at = len(text) if end < 0 else end
    return False


#: Letters that are written for digits.
_LIKE_DIGITS = str.maketrans("OoQIl|SBZ", "000111582")
_MIXED = re.compile(r"(?<![A-Za-z0-9])[0-9OoQIl|SBZ](?:[\x20().-]*+[0-9OoQIl|SBZ])++(?![A-Za-z0-9])")
_MIXED_HINT = re.compile(r"[0-9][OoQIl|SBZ]|[OoQIl|SBZ][0-9]|[OoQIl|][.\x20-][0-9]|[0-9][.\x20-][OoQIl|](?![A-Za-z])")

_DOT_WORD = r"(?:dot|d0t|punkt|punto|point)"
_DOT = rf"(?:[ \t]*+[\[({{<][ \t]*+(?:{_DOT_WORD}|\.)[ \t]*+[\])}}>][ \t]*+|[ \t]++{_DOT_WORD}[ \t]++|(?<=[ \t\])}}>])\.(?=[A-Za-z0-9])|\.)"
_LOCAL_CHAIN = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+)*+", re.I)
_DOMAIN_CHAIN = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)++(?![A-Za-z0-9_@])", re.I)
_AT = re.compile(r"[ \t]*+[\[({<][ \t]*+(?:at|@|arroba|ät|a|chez|bei)[ \t]*+[\])}>][ \t]*+|[ \t]++(?:at|@|arroba|ät)[ \t]++|[ \t]++@|@[ \t]*+", re.I)
_HINT = re.compile(rf"[\[({{<][ \t]*(?:at|@|arroba|ät|a|chez|bei|{_DOT_WORD}|\.)[ \t]*[\])}}>]|[ \t]{_DOT_WORD}[ \t]|[ \t]@|@[ \t]|[ \t](?:at|arroba)[ \t]+[A-Za-z0-9-]+\.[A-Za-z]", re.I)
_CUE = re.compile(r"(?i)(?:mail|courriel|correo|contact|kontakt|write|reach|adress|address|adresse)[a-z]*[^A-Za-z0-9]+(?:[a-z]+[^A-Za-z0-9]+)?(?:[a-z]+[^A-Za-z0-9]+)?$")
_DOTTED_NUMBERS = re.compile(rf"(?<![0-9])[0-9]++(?:{_DOT}[0-9]++){{3}}(?![0-9])", re.I)
_INNER_DOT = re.compile(_DOT, re.I)

Edit = tuple[int, int, str]


class Tape:
    """A line as rewritten so far, and how to get back: per rewrite, where its edits stand in its output and its input."""

    def __init__(self, text: str) -> None:
        self.text, self.layers = text, []

    def rewrite(self, edits: Iterable[Edit]) -> None:
        """Edits come in order and do not overlap; they are kept as four numbers each."""
        out, done, size = io.StringIO(), 0, 0
        layer = begin, finish, source, upto = tuple(array("i") for _ in range(4))
        for a, b, new in edits:
            out.write(self.text[done:a])
            out.write(new)
            size += a - done
            begin.append(size)
            size += len(new)
            finish.append(size)
            source.append(a)
            upto.append(b)
            done = b
        if begin:
            out.write(self.text[done:])
            self.text = out.getvalue()
            self.layers.append(layer)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The range of the first text that a range of the last one came from; an edit counts whole."""
        for begin, finish, source, upto in reversed(self.layers):
            # edits that vanish may lie at a border; they count as outside
            i = bisect_right(begin, start) - 1
            j = bisect_left(begin, end) - 1
            at = start if i < 0 else source[i] if start < finish[i] else start - finish[i] + upto[i]
            end = end if j < 0 else upto[j] if end <= finish[j] and begin[j] < finish[j] else end - finish[j] + upto[j]
            start = at
        return start, end


def plain_letters(tape: Tape) -> None:
    """Look-alike characters; those that keep the length need no edit. Then character references."""
    if not tape.text.isascii():
        tape.rewrite((m.start(), m.end(), _PLAIN[ord(m[0])]) for m in _LENGTHENED.finditer(tape.text))
        tape.text = tape.text.translate(_ONE_TO_ONE)

    def references(text: str) -> Iterator[Edit]:
        for m in _REFERENCE.finditer(text):
            code = int(m[1], 16) if m[1] else int(m[2]) if m[2] else None
            if m[3] or 32 < code < 127:
                yield m.start(), m.end(), _NAMED[m[3]] if m[3] else chr(code)

    tape.rewrite(references(tape.text))


def _number_edits(text: str) -> Iterator[Edit]:
    """Edits of a text in small letters: in runs of numbers, of which some are words, with four digits or more."""
    waiting: list[Edit] = []  # until the run has a word and four digits
    last: tuple[int, int, bool, str] | None = None  # the number before: where it starts and ends, whether it is a word, its digits
    word, digits, sure, times = False, 0, False, 1
    for x in _NUMBER.finditer(text):
        start, is_word, name = x.start(), not x[4], x[3] or ""
        if last is None or not _GAP.fullmatch(text, last[1], start):
            if sure and last[2]:
                yield last[:2] + last[3:]
            word, digits, sure, last, times, waiting = False, 0, False, None, 1, []
            if text[max(0, start - 5) : start] in ("plus ", "plus-") and not text[max(0, start - 6) : start - 5].isalnum():
                waiting.append((start - 5, start, "+"))
        if last and (last[2] or is_word):  # a number takes the separators after it into its range, up to a word or from one
            waiting.append((last[0], start, last[3]))
        if name in ("double", "triple"):
            value, times = "", 2 if name == "double" else 3
        else:
            value = (x[4] or (_TWO[x[1]][0] + _UNITS[x[2]] if x[1] else _UNITS.get(name) or _TWO[name])) * times
            times = 1
        word, digits = word or is_word, digits + max(1, len(value))
        sure = sure or (word and digits >= 4)
        if sure:
            yield from waiting
            waiting.clear()
        last = (start, x.end(), is_word, value)
    if sure and last and last[2]:
        yield last[:2] + last[3:]


def plain_digits(tape: Tape) -> None:
    """Runs of at least four digits of which some are words; separators at words inside a run vanish. Letters for digits keep their places."""
    if _spells(tape.text):
        tape.rewrite(_number_edits(_lower(tape.text)))
    if _MIXED_HINT.search(tape.text):
        out, done = io.StringIO(), 0
        for m in _MIXED.finditer(tape.text):
            digits = sum(map(str.isdigit, m[0]))
            letters = sum(map(str.isalpha, m[0])) + m[0].count("|")
            if letters and (digits >= 2 * letters and digits + letters >= 8 or digits >= letters and m[0].count(".") == 3):
                out.write(tape.text[done : m.start()])
                out.write(m[0].translate(_LIKE_DIGITS))
                done = m.end()
        tape.text = out.getvalue() + tape.text[done:]


def _sign_edits(text: str) -> Iterator[Edit]:
    dots = lambda m: ((m.start() + d.start(), m.start() + d.end(), ".") for d in _INNER_DOT.finditer(m[0]) if d[0] != ".")
    done = left_from = 0
    for mark in _AT.finditer(text):
        right, left = _DOMAIN_CHAIN.match(text, mark.end()), None
        if right:
            for left in _LOCAL_CHAIN.finditer(text, left_from, mark.start()):
                pass
        if right and left and left.end() == mark.start() and left.start() >= done and _is_address(text, left, right, mark[0].strip(" \t").lower()):
            yield from dots(left)
            if mark[0] != "@":
                yield mark.start(), mark.end(), "@"
            yield from dots(right)
            done = right.end()
        left_from = mark.end()


def plain_signs(tape: Tape) -> None:
    """Signs of addresses, then dots between four numbers."""
    tape.rewrite(_sign_edits(tape.text))
    tape.rewrite((m.start() + d.start(), m.start() + d.end(), ".") for m in _DOTTED_NUMBERS.finditer(tape.text) for d in _INNER_DOT.finditer(m[0]) if d[0] != ".")


def _is_address(text: str, left: re.Match, right: re.Match, sign: str) -> bool:
    """Whether the parts around a sign make an address: the last label is a word of two letters or more; a spoken sign needs more."""
    labels = _INNER_DOT.split(right[0])
    if len(labels[-1]) < 2 or not labels[-1].isalpha():
        return False
    if sign not in ("at", "arroba", "ät") or any(d[0] != "." for d in _INNER_DOT.finditer(right[0])):
        return True
    return bool(re.search(r"[0-9._+%-]", left[0].strip("._-"))) or bool(_CUE.search(text, max(0, left.start() - 60), left.start()))


def _disguised(text: str) -> Iterator[tuple[int, int]]:
    """Lines in which something may be disguised, in order, each once."""
    tests = [_HINT, _MIXED_HINT]
    if not text.isascii():
        tests.append(_STRANGE)
    if "&" in text:
        tests.append(_REFERENCE)
    lines, at = set(), 0
    while at <= len(text) and (at or _spells(text)):  # lines with number words, looked at only where the text has some in a row
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if _spells(text[at:end]):
            lines.add((at, end))
        at = end + 1
    for test in tests:
        at = 0
        while m := test.search(text, at):
            end = text.find("\n", m.end())
            lines.add((text.rfind("\n", 0, m.start()) + 1, end := len(text) if end < 0 else end))
            at = end
    return sorted(lines)


def hidden_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans of disguised identifiers, in source code points, that no base span holds."""
    found: list[Span] = []
    for start, end in _disguised(text):
        tape = Tape(text[start:end])
        line = tape.text
        plain_letters(tape)
        plain_digits(tape)
        if _HINT.search(tape.text):
            plain_signs(tape)
        if tape.text == line:
            continue
        for kind, a, b in base_spans(tape.text):
            a, b = tape.back(a, b)
            found.append((kind, start + a, start + b))
    if not found:
        return []
    # of spans that begin together the longest comes first: what ends no later than an earlier one lies in it
    out, upto, plain = [], -1, sorted(((s, -e) for _, s, e in base))
    most, k = -1, 0
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        while k < len(plain) and plain[k][0] <= s:
            most, k = max(most, -plain[k][1]), k + 1
        if e > most and e > upto:
            out.append((kind, s, e))
            upto = e
    return out


def all_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans)."""
    if not text:
        return [], []
    base = base_spans(text)
    hidden = hidden_spans(text, base)
    return base, sorted(base + hidden, key=lambda s: (s[1], KINDS.index(s[0]))) if hidden else base


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping spans the union becomes one mark."""
    if not text:
        return text
    out, done, upto = [], 0, 0
    for kind, a, b in all_spans(text)[1]:
        if a >= upto:
            out += [text[done:a], f"[{kind.upper()}]"]
            done = b
        upto = max(upto, b)
        done = max(done, b)
    out.append(text[done:])
    return "".join(out)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): spans is an array of (kind, begin, finish, hidden) per document."""
    bounded_batches(docs.sparkSession)
    item = pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("finish", pa.int32()), ("hidden", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = all_spans(text)
                plain = set(base)
                rows.append([{"kind": k, "begin": a, "finish": b, "hidden": (k, a, b) not in plain} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(item))], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,begin:int,finish:int,hidden:boolean>>")


def mask(docs: DataFrame) -> DataFrame:
    """docs with the text masked, and n_chars, where there is one, counted again."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(at, "text", pa.array(map(masked, batch.column(at).to_pylist()), pa.string()))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark, sf_dir: str) -> DataFrame:
    spans = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: ~s["hidden"])
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["finish"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: (s["kind"] == kind) & ~s["hidden"]))
    counts = [count(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["hidden"])).cast("long").alias("n_hidden"))
