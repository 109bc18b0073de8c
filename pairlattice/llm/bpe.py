"""Byte-level BPE: a backtracking encoder over an Aho-Corasick automaton, and an offset-table decoder.

Encoding a piece (one match of the pre-tokenizer's pattern) takes the longest token at the
current position (the automaton over all tokens gives it), and accepts it after the previous
token only if the pair is compatible: merging the two tokens' text from scratch must give
exactly these two tokens, which is checked by undoing merges along the boundary and kept in
a table. If it is not, the next shorter token is tried; if none is left, the last accepted
token is given up and shortened. A mark of the positions already refused makes every
position be left at most once, so the work is linear in the text, and the first sequence
that reaches the end is the one that exact merging gives.

Decoding gathers byte ranges: one blob holds all tokens' bytes, a table their offsets.

Defined cases: a null text is empty and has no tokens; a special token's string in a text is
its id, as the tokenizers library reads it; lone surrogates cannot occur in Spark strings;
bytes that are not UTF-8 after decoding become U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pairlattice.llm.common import bounded_batches

#: The pattern and the byte alphabet of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CACHED_PIECES, _CACHED_LENGTH, _KEPT_PAIRS = 250_000, 64, 1_000_000


def default_vocabulary() -> str:
    """The vocabulary file's path: that of the public tokenizers, unless PAIRLATTICE_TOKENIZERS names another folder."""
    if folder := os.environ.get("PAIRLATTICE_TOKENIZERS"):
        return os.path.join(folder, "byte_bpe_50k.json")
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _byte_letters() -> dict[str, int]:
    """Letter -> byte: printable Latin-1 bytes stand for themselves, the others for U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Backtracker:
    """The tables of one vocabulary: ids, bytes, splits, automaton, compatible pairs, offsets."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items() if all(c in letters for c in s)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {b: i for b, i in vocab.items() if i not in self.special.values()}
        top = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * top
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        # rank and parts of each merge; a token's own merge is the first that makes it
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair = (self.ids[raw(a)], self.ids[raw(b)])
            whole = self.ids[raw(a) + raw(b)]
            self.rank.setdefault(pair, r)
            self.merged.setdefault(pair, whole)
            self.parts.setdefault(whole, pair)
        self.compatible: dict[tuple[int, int], bool] = {}
        automaton = ahocorasick.Automaton()
        # tokens that exact merging of their own bytes gives; the others can't occur in its output
        self.usable = {i for b, i in self.ids.items() if self._merge(b) == [i]}
        for i in self.usable:
            automaton.add_word(self.bytes[i].decode("latin-1"), i)
        automaton.make_automaton()
        self.automaton = automaton
        self.prefix: dict[int, int] = {}
        for i in self.usable:  # the next shorter token that starts it
            b = self.bytes[i]
            self.prefix[i] = next((t for k in range(len(b) - 1, 0, -1) if (t := self.ids.get(b[:k])) in self.usable), -1)
        lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PATTERN)

    def _merge(self, text: bytes) -> list[int]:
        """Merging by rank, for building the tables: tokens are short."""
        seq = [self.ids[text[k : k + 1]] for k in range(len(text))]
        while len(seq) > 1:
            best = min(range(len(seq) - 1), key=lambda k: self.rank.get((seq[k], seq[k + 1]), 1 << 60))
            pair = (seq[best], seq[best + 1])
            if pair not in self.rank:
                break
            out, k = [], 0
            while k < len(seq):
                if k + 1 < len(seq) and (seq[k], seq[k + 1]) == pair:
                    out.append(self.merged[pair])
                    k += 2
                else:
                    out.append(seq[k])
                    k += 1
            seq = out
        return seq

    def fits(self, left: int, right: int) -> bool:
        """Whether exact merging keeps the border between the two tokens; kept in the table."""
        if (known := self.compatible.get((left, right))) is None:
            if len(self.compatible) >= _KEPT_PAIRS:  # a bound for the life of a worker; pairs are worked out anew
                self.compatible.clear()
            known = self.compatible[(left, right)] = self._border_stays(left, right)
        return known

    def _border_stays(self, a: int, b: int) -> bool:
        """Undo the later of both sides' merges again and again: no merge across may come before it."""
        limit = 1 << 60
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < limit:
                return False
            ra = self.rank[self.parts[a]] if a in self.parts else -1
            rb = self.rank[self.parts[b]] if b in self.parts else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit = ra
                a = self.parts[a][1]
                # the left token's merge happens at this rank: a pair across of equal rank would come after it
            else:
                # on the right a pair across of the same rank stands further left and comes first
                limit = rb + 1
                b = self.parts[b][0]

    def longest(self, text: str) -> list[int]:
        """For each position, the longest token that starts there (the automaton's matches by their start)."""
        best = [-1] * len(text)
        size = [0] * len(text)
        for end, token in self.automaton.iter(text):
            n = len(self.bytes[token])
            start = end - n + 1
            if n > size[start]:
                best[start], size[start] = token, n
        return best

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None and whole in self.usable:
            return [whole]
        text = piece.decode("latin-1")
        n, starts = len(text), self.longest(text)
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        pos, token = 0, starts[0] if n else -1
        while pos < n:
            last = out[-1] if out else -1
            while True:
                end = pos + len(self.bytes[token])
                if open_[end] and (last < 0 or self.fits(last, token)):
                    out.append(token)
                    pos = end
                    token = starts[pos] if pos < n else -1
                    break
                token = self.prefix[token]
                if token < 0:  # nothing fits here: give up the token before
                    open_[pos] = 0
                    token = out.pop()
                    pos -= len(self.bytes[token])
                    token_next = self.prefix[token]
                    last = out[-1] if out else -1
                    token = token_next
                    while token < 0:
                        open_[pos] = 0
                        token = out.pop()
                        pos -= len(self.bytes[token])
                        last = out[-1] if out else -1
                        token = self.prefix[token]
        return out

    def encode(self, text: str | None, cache: dict[str, bytes]) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.split is not None and self.split.search(text):
            return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else self.encode(x, cache) for x in self.split.split(text) if x)
        return b"".join(map(cache.__getitem__, self.pieces.findall(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens in order: ranges of the blob by the offset table."""
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        total = int(size.sum())
        shift = start - (np.cumsum(size) - size)
        return self.blob[np.arange(total) + np.repeat(shift, size)].tobytes()


class PieceCache(dict):
    """piece -> its ids as bytes; long pieces are not kept, and it starts anew when it holds too many."""

    def __init__(self, coder: Backtracker) -> None:
        self.coder = coder

    def __missing__(self, piece: str) -> bytes:
        out = np.array(self.coder.encode_piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= _CACHED_LENGTH:
            if len(self) >= _CACHED_PIECES:
                self.clear()
            self[piece] = out
        return out


@lru_cache(maxsize=2)
def coder(path: str) -> Backtracker:
    """One per worker process and file."""
    return Backtracker(path)


@lru_cache(maxsize=2)
def piece_cache(path: str) -> PieceCache:
    return PieceCache(coder(path))


def encode(docs: DataFrame, path: str | None = None, decode: bool = True) -> DataFrame:
    """docs (doc_id, text) as (doc_id, n_tokens, ids, decoded): ids is array<int>, decoded (if asked for) the text they give."""
    if not decode:
        return _encoded(docs, path, "ids array<int>", lambda ids, text: {"ids": np.frombuffer(ids, "<i4")}, False)
    return _encoded(docs, path, "ids array<int>, decoded string", lambda ids, text: {"ids": np.frombuffer(ids, "<i4"), "decoded": text.decode("utf-8", "replace")})


def _encoded(docs: DataFrame, path: str | None, columns: str, finish: Callable[[bytes, bytes | None], dict], decode: bool = True) -> DataFrame:
    bounded_batches(docs.sparkSession)
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cache = coder(path), piece_cache(path)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                ids = table.encode(text, cache)
                rows.append({"n_tokens": len(ids) // 4} | finish(ids, table.decode(np.frombuffer(ids, "<u4").astype(np.int64)) if decode else None))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {k: [r[k] for r in rows] for k in (rows[0] if rows else {})})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_tokens long, {columns}")


def _digests(ids: bytes, text: bytes) -> dict:
    whole = text.decode("utf-8", "replace").encode()
    return {"ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(whole).hexdigest()}


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _encoded(docs, None, "ids_sha256 string, decoded_sha256 string", _digests)
