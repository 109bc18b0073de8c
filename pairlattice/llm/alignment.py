"""Alignment of two tokenizers' tokens, and how often each pair of ids is linked in the whole corpus.

A (byte-level BPE) encodes a space and the text, B (pieces with byte fallback) the text, to which
it adds that space itself. Where a token of each ends at the same byte, a group ends and the two
tokens are linked. A single space between two characters that are no white space starts a token
in both: A's pattern takes it with what follows, and none of B's pieces holds a space after
anything else (checked when the files are read). So a text is the row of its segments between such spaces, each
encoded with a space before it, and a segment is encoded and aligned once for all its places.

The aligned rows, with their links as packed ids, are written once; later steps read these. Pairs are counted as one 64-bit key, B's
id in the upper half. Every partition adds its links up (``np.unique``), the partial counts are sorted by range of B's
id over the cluster, and runs of one key are summed; a range holds all pairs of its B ids, so their highest counts
are known there. In linked tokens the shorter one's bytes end the longer one's, so the pairs number at most ``most_pairs`` whatever
the corpus is (324,302 for the two files, 8 MB): the sorted ranges are written as shards to the shared
folder, Spark hands them to every executor, and the rows' links are looked up in them by binary search, mapped into memory.
Nothing else leaves the executors.

Defined cases: texts that are null or empty, or that either tokenizer does not give back byte for
byte (such as those with U+2581), have no tokens: zeros and an empty groups column, and their links are not counted;
special tokens' strings are plain text; rows are aligned one by one, so repeated rows count each; an empty table gives an empty
result; columns beyond doc_id and text are ignored, whatever their names. A long text is taken in parts
of about ``PART`` characters, so memory is bounded but for a run of text without single spaces, which is encoded whole.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlattice.llm.bpe import _byte_letters as byte_letters
from pairlattice.llm.common import bounded_batches, tables_folder, written

#: Characters of a text that are held as segments at a time; bytes of segments and alignments that a worker keeps.
PART, KEPT_BYTES = 1 << 20, 128 << 20
#: Ranges of B ids that counts are sorted in, and shards at most.
SHARDS = 16
_SPLIT = re.compile(r"(?<=\S) (?=\S)")
_LOW = (1 << 32) - 1
_CODEC = pa.Codec("zstd")


def vocabulary(name: str) -> str:
    """A public tokenizer's file, in the folder that PAIRLATTICE_TOKENIZERS names where it is set."""
    if folder := os.environ.get("PAIRLATTICE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Coders:
    """Both tokenizers and their tokens' bytes."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        vocab = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            self.bytes_a[i] = bytes(letters[c] for c in s) if all(c in letters for c in s) else s.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(s[3:5], 16)]) if self.b.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(pieces)]
        if any(re.search("[^▁]▁", s) for s in pieces):
            raise ValueError(f"pieces of {path_b} hold a space after something else, so texts can't be encoded by segments")

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = self.a.encode_batch_fast([" " + s for s in segments], add_special_tokens=False)
        return [x.ids for x in a], self.b.encode(segments, num_threads=1)

    def most_pairs(self) -> int:
        """Pairs of ids whose tokens can be linked: those where one's bytes end with the other's."""
        found = 0
        for ours, others, own in ((self.bytes_a, self.bytes_b, True), (self.bytes_b, self.bytes_a, False)):
            of: dict[bytes, int] = {}
            for x in others:
                of[x] = of.get(x, 0) + 1
            # equal bytes count in the first turn only
            found += sum(of.get(x[k:], 0) for x in ours for k in range(0 if own else 1, len(x)))
        return found


@lru_cache(maxsize=1)
def coders(path_a: str, path_b: str) -> Coders:
    """One per worker process."""
    return Coders(path_a, path_b)


class Aligned(NamedTuple):
    """Rows of tokens matched by their ends: group texts and link counts by row, and all rows' keys."""

    groups: list[str]
    links: np.ndarray
    keys: np.ndarray


class Aligner:
    """Matches many short rows of A and B tokens at once; the two rows of a pair are over the same bytes."""

    def __init__(self, both: Coders) -> None:
        self.size_a, self.size_b = (np.array([len(x) for x in side], np.int64) for side in (both.bytes_a, both.bytes_b))
        # an id's text after each mark that can stand before it
        self.text_a = np.array([[f"{mark}{i}" for i in range(len(self.size_a))] for mark in ("", ";", ",")], object)
        self.text_b = np.array([[f"{mark}{i}" for i in range(len(self.size_b))] for mark in ("|", ",")], object)

    def __call__(self, a: list[list[int]], b: list[list[int]]) -> Aligned:
        if not a:
            return Aligned([], np.zeros(0, np.int64), np.zeros(0, np.int64))
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        at = np.searchsorted(ends_b, ends_a)
        last_a = ends_b[at] == ends_a  # the last of its group
        last_b = np.zeros(len(ids_b), bool)
        last_b[at[last_a]] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        first_a, first_b = np.diff(group_a, prepend=-1) > 0, np.diff(group_b, prepend=-1) > 0
        starts = np.zeros(len(ids_a), bool)
        starts[np.cumsum(n_a) - n_a] = True
        marked_a = self.text_a[np.where(starts, 0, np.where(first_a, 1, 2)), ids_a]
        marked_b = self.text_b[np.where(first_b, 0, 1), ids_b]
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        texts, ends = np.concatenate((marked_a, marked_b))[order].tolist(), np.cumsum(n_a + n_b).tolist()
        links = np.add.reduceat(last_a, np.cumsum(n_a) - n_a, dtype=np.int64)
        return Aligned(["".join(texts[i:j]) for i, j in zip([0, *ends], ends)], links, ids_b[last_b] << 32 | ids_a[last_a])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts' sums."""
    distinct, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, at, counts)
    return distinct, total


class Segments:
    """Segments met so far: their numbers, token counts, groups and keys; of segment i the keys from start[i] to start[i + 1]."""

    def __init__(self, both: Coders) -> None:
        self.both, self.align = both, Aligner(both)
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.groups: list[str] = []
        self.n_a, self.n_b, self.good, self.keys, self.start = array("q"), array("q"), array("b"), array("q"), array("q", [0])
        self.kept = 0

    def codes(self, segments: list[str]) -> np.ndarray:
        """Each segment's number; those not met before are encoded together."""
        new = [s for s in dict.fromkeys(segments) if s not in self.code]
        if new:
            a, b = self.both.encode(new)
            whole, good = [b" " + s.encode() for s in new], [True] * len(new)
            join = lambda table, rows: b"".join(map(table.__getitem__, chain.from_iterable(rows)))
            if not join(self.both.bytes_a, a) == b"".join(whole) == join(self.both.bytes_b, b):
                good = [join(self.both.bytes_a, [x]) == w == join(self.both.bytes_b, [y]) for x, y, w in zip(a, b, whole)]
            fine = self.align([x for x, g in zip(a, good) if g], [y for y, g in zip(b, good) if g])
            groups, links = np.full(len(new), "", object), np.zeros(len(new), np.int64)
            groups[good], links[good] = fine.groups, fine.links
            self.code.update(zip(new, range(len(self.groups), len(self.groups) + len(new))))
            self.groups += groups.tolist()
            self.n_a.extend(map(len, a))
            self.n_b.extend(map(len, b))
            self.good.extend(good)
            self.keys.frombytes(fine.keys.tobytes())
            self.start.extend((len(self.keys) - len(fine.keys) + np.cumsum(links)).tolist())
            self.kept += 300 * len(new) + sum(map(len, whole)) + sum(map(len, fine.groups)) + 8 * len(fine.keys)
        return np.fromiter(map(self.code.__getitem__, segments), np.int64, len(segments))

    def make_room(self) -> None:
        if self.kept > KEPT_BYTES:
            self.clear()

    def linked(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys of segments of these numbers in a row, and how many each has."""
        start = np.array(self.start)
        links = start[codes + 1] - start[codes]
        shift = start[codes] - (np.cumsum(links) - links)
        return np.array(self.keys, np.int64)[np.arange(links.sum()) + np.repeat(shift, links)], links


def parts(text: str) -> Iterator[list[str]]:
    """A text's segments, about PART characters of them at a time."""
    start = 0
    while len(text) - start > PART and (cut := _SPLIT.search(text, start + PART)):
        yield _SPLIT.split(text[start : cut.start()])
        start = cut.end()
    yield _SPLIT.split(text[start:])


class Round(NamedTuple):
    """Segments that are worked on together: those of whole texts (by number), or a part of one long text."""

    rows: list[int]
    segments: list[list[str]]
    first: bool = True
    last: bool = True


def _rounds(texts: list[str | None]) -> Iterator[Round]:
    """All texts' segments, about PART characters at a time."""
    rows: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        if text and len(text) > PART:
            some = parts(text)
            part, first = next(some), True
            while part is not None:
                following = next(some, None)
                yield Round([i], [part], first, following is None)
                part, first = following, False
        elif text:
            rows.append(i)
            size += len(text)
        if rows and (size >= PART or i + 1 == len(texts)):
            yield Round(rows, [_SPLIT.split(texts[k]) for k in rows])
            rows, size = [], 0
    if rows:
        yield Round(rows, [_SPLIT.split(texts[k]) for k in rows])


_KNOWN: dict[tuple[str, str], Segments] = {}


def _segments(paths: tuple[str, str]) -> Segments:
    """The worker's segments, kept from task to task as far as they are few enough."""
    if paths not in _KNOWN:
        _KNOWN[paths] = Segments(coders(*paths))
    return _KNOWN[paths]


def _packed(keys: np.ndarray) -> bytes:
    """Keys as their A ids and then their B ids, compressed."""
    return _CODEC.compress(np.concatenate((keys & _LOW, keys >> 32)).astype("<u4"), asbytes=True)


def _keys(links: pa.Array, counts: np.ndarray) -> np.ndarray:
    """The keys of all rows of a batch, from their packed links."""
    out = [np.empty(0, np.int64)]
    for x, n in zip(links, counts.tolist()):
        if n:
            a, b = np.frombuffer(_CODEC.decompress(x.as_buffer(), 8 * n), "<u4").astype(np.int64).reshape(2, n)
            out.append(b << 32 | a)
    return np.concatenate(out)


def _aligned_rows(paths: tuple[str, str], with_groups: bool) -> Callable:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, links, groups if asked for)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _segments(paths)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sums, good = np.zeros((3, len(texts)), np.int64), np.array([bool(t) for t in texts])
            digests, links, groups = ([empty] * len(texts) for empty in ("", b"", ""))
            for r in _rounds(texts):
                known.make_room()
                codes, sizes = known.codes(list(chain.from_iterable(r.segments))), np.array([len(x) for x in r.segments])
                at = np.cumsum(sizes) - sizes
                keys, own = known.linked(codes)
                good[r.rows] &= np.logical_and.reduceat(np.array(known.good, bool)[codes], at)
                for k, values in enumerate((np.array(known.n_a)[codes], np.array(known.n_b)[codes], own)):
                    sums[k, r.rows] += np.add.reduceat(values, at)
                ends, listed = np.cumsum(np.add.reduceat(own, at)).tolist(), codes.tolist()
                for i, a, n, begin, end in zip(r.rows, at.tolist(), sizes.tolist(), [0, *ends], ends):
                    text = ";".join(map(known.groups.__getitem__, listed[a : a + n]))
                    if r.first:
                        digest, held = hashlib.sha256(), []
                    digest.update(text.encode() if r.first else b";" + text.encode())
                    held.append(keys[begin:end])
                    if with_groups:
                        groups[i] += text if r.first else ";" + text
                    if r.last:
                        digests[i], links[i] = digest.hexdigest(), _packed(np.concatenate(held)) if good[i] else b""
            sums[:, ~good] = 0
            row = {"doc_id": batch.column(0), "n_a": sums[0], "n_b": sums[1], "n_groups": sums[2], "groups_sha256": [x if g else "" for x, g in zip(digests, good)], "links": pa.array(links, pa.binary())}
            yield pa.RecordBatch.from_pydict(row | ({"groups": [x if g else "" for x, g in zip(groups, good)]} if with_groups else {}))

    return apply


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: (key, n) of the links of rows (n_groups, links)."""
    total = (np.empty(0, np.int64), np.empty(0, np.int64))
    for batch in batches:
        keys, n = np.unique(_keys(batch.column(1), batch.column(0).to_numpy()), return_counts=True)
        total = summed(np.concatenate((total[0], keys)), np.concatenate((total[1], n)))
    yield pa.RecordBatch.from_pydict({"key": total[0], "n": total[1]})


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted range as a shard: distinct keys, summed counts, and whether a count is its B id's highest."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        k = np.concatenate((keys[-1:], batch.column(0).to_numpy()))
        n = np.concatenate((counts[-1:], batch.column(1).to_numpy()))
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        keys, counts = np.concatenate((keys[:-1], k[first])), np.concatenate((counts[:-1], np.add.reduceat(n, first)))
    if len(keys):
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] >> 32 != keys[:-1] >> 32)))
        best = np.repeat(np.maximum.reduceat(counts, begin), np.diff(np.append(begin, len(keys)))) == counts
        yield pa.RecordBatch.from_pydict({"first": [int(keys[0])], "shard": [np.stack((keys, counts, best.astype(np.int64))).tobytes()]})


def pair_counts(rows: DataFrame) -> DataFrame:
    """Aligned rows (n_groups, links) as (first, shard): ranges of sorted keys with their counts, each three rows of int64 (keys, counts, 1 for a B id's highest)."""
    partial = written(rows.select("n_groups", "links").mapInArrow(_partial_counts, "key long, n long"))
    ranges = partial.repartitionByRange(SHARDS, F.shiftright("key", 32)).sortWithinPartitions("key")
    return ranges.mapInArrow(_run_lengths, "first long, shard binary")


def _handed_out(spark: SparkSession, shards: list[np.ndarray]) -> list[str]:
    """Names under which the shards are files on every executor: written to the shared folder, from which Spark copies them."""
    names = []
    for shard in shards:
        names.append(f"pairs-{uuid.uuid4().hex}.npy")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{tables_folder(spark)}/{names[-1]}")
        out, data = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path), io.BytesIO()
        np.save(data, shard)
        out.write(bytearray(data.getvalue()))
        out.close()
        spark.sparkContext.addFile(path.toString())
    return names


class CountShards:
    """Counts by key from shards mapped into memory."""

    def __init__(self, files: list[str]) -> None:
        self.shards = [np.load(f, mmap_mode="r") for f in files]
        self.first = np.array([s[0, 0] for s in self.shards], np.int64)

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's count, and whether it is its B id's highest; both 0 for keys that were not counted."""
        counts, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        owner = np.searchsorted(self.first, keys, "right") - 1
        for i in set(np.unique(owner).tolist()) - {-1}:
            own, shard = np.flatnonzero(owner == i), self.shards[i]
            at = np.minimum(np.searchsorted(shard[0], keys[own]), shard.shape[1] - 1)
            own, at = own[hit := shard[0][at] == keys[own]], at[hit]
            counts[own], best[own] = shard[1][at], shard[2][at]
        return counts, best


def _looked_up(names: list[str]) -> Callable:
    """Aligned rows with their links' number, those that are their B id's most frequent, and the sum of their counts."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = CountShards([SparkFiles.get(x) for x in names])
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            n = columns["n_groups"].to_numpy()
            counts, best = shards.look_up(_keys(columns.pop("links"), n))
            ends = np.cumsum(n)
            per_row = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], ends))])  # noqa: E731, B023
            yield pa.RecordBatch.from_pydict(columns | {"n_links": n, "n_best": per_row(best), "count_sum": per_row(counts)})

    return apply


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, with_groups: bool = True) -> DataFrame:
    """docs (doc_id, text) as doc_id, the token, group and link counts, groups_sha256 and, if asked for, groups ("a1,a2|b1;a3|b2,b3")."""
    bounded_batches(docs.sparkSession)
    paths = (path_a or vocabulary("byte_bpe_50k.json"), path_b or vocabulary("piece_bpe_32k.model"))
    groups = ", groups string" if with_groups else ""
    rows = written(docs.select("doc_id", "text").mapInArrow(_aligned_rows(paths, with_groups), f"doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary{groups}"))
    # bounded by the vocabularies: see most_pairs
    ranges = sorted((r["first"], bytes(r["shard"])) for r in pair_counts(rows).collect())
    shards = [np.frombuffer(x, np.int64).reshape(3, -1) for _, x in ranges]
    step = -(-len(shards) // SHARDS) or 1
    names = _handed_out(docs.sparkSession, [np.concatenate(shards[i : i + step], axis=1) for i in range(0, len(shards), step)])
    return rows.mapInArrow(_looked_up(names), f"doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string{groups}, n_links long, n_best long, count_sum long")


def query(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_groups=False)
