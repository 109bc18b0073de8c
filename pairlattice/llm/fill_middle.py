"""Fill-in-the-middle transformation: texts cut at two token ranks by overlapping chunks.

A token is a word with the white space before it, or white space at the end of a text. So a
token ends where a character that is no white space is followed by one that is: a predicate of
two adjacent characters. A batch of texts is one run of UTF-8 bytes (white space is ASCII, and
a byte inside a longer character is none), and this run is cut into chunks of ``CHUNK`` bytes,
each seen with one byte of the next chunk, also at every text's start. The predicate is counted
for all chunks at once; the counts' prefix sums within a text give its number of tokens and route
the ranks of both cuts to the chunks that hold them, and only these chunks are scanned again, for
the cut's place. Everything happens where a text is read: there is no shuffle, no table is
written, and beside the texts themselves memory is bounded by ``BLOCK``.

The cut ranks and the form come from a SHA-256 of the seed and doc_id, so reruns agree.

Defined cases: a null text is empty; an empty text has 0 tokens and is plain; white space alone
is one token; a text that contains a sentinel is plain, since it could not be rebuilt; a null
doc_id has no digits, so all such rows draw alike; rows are transformed one by one, so repeated
rows give repeated results; an empty table gives an empty result; columns beyond doc_id and text
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairlattice.llm.common import SPACE, bounded_batches

#: Bytes of a chunk, and of the chunks whose predicates are held at a time.
CHUNK, BLOCK = 1 << 14, 1 << 22
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 documents so many are transformed, and of 100 of these so many have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 50, 80
_IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACE, np.uint8))


def token_ends(run: np.ndarray, start: int, stop: int, end: int) -> np.ndarray:
    """For the bytes from start to stop of a text that ends at end: whether a token ends after each.

    Reads one byte beyond stop, where the text goes on; the last byte of a text ends a token in any case.
    """
    space = _IS_SPACE[run[start : min(stop + 1, end)]]
    ends = ~space[: stop - start]
    if stop < end:
        return ends & space[1:]
    ends[:-1] &= space[1:]
    ends[-1] = True
    return ends


def chunk_starts(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of every chunk of the texts between the offsets, and each text's first chunk (with one more entry for the end)."""
    chunks = -(-np.diff(offsets) // CHUNK)
    first = np.concatenate(([0], np.cumsum(chunks)))
    within = np.arange(first[-1]) - np.repeat(first[:-1], chunks)
    return np.repeat(offsets[:-1], chunks) + within * CHUNK, first


def count_ends(run: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Tokens that end in each chunk, some blocks of chunks at a time."""
    counts = np.zeros(len(starts), np.int64)
    last = offsets[1:][np.diff(offsets) > 0] - 1  # every text's last byte ends a token
    for a in range(0, len(starts), BLOCK // CHUNK):
        some = starts[a : a + BLOCK // CHUNK]
        upto = starts[a + len(some)] if a + len(some) < len(starts) else offsets[-1]
        for b in range(int(some[0]), int(upto), BLOCK):  # short texts make many small chunks, long ones few large ones
            stop = min(b + BLOCK, int(upto))
            space = _IS_SPACE[run[b : min(stop + 1, int(offsets[-1]))]]
            ends = ~space[: stop - b]
            ends[: len(space) - 1] &= space[1:]
            ends[last[np.searchsorted(last, b) : np.searchsorted(last, stop)] - b] = True
            own = some[(some >= b) & (some < stop)]
            at = np.concatenate(([b], own[own > b])) if len(own) == 0 or own[0] > b else own
            counts[np.searchsorted(starts, at, "right") - 1] += np.add.reduceat(ends, at - b, dtype=np.int64)
    return counts


def cut_places(run: np.ndarray, starts: np.ndarray, sums: np.ndarray, first: int, upto: int, end: int, ranks: tuple[int, int]) -> list[int]:
    """Where the tokens of these ranks (from 1; 0 is the text's start) end in one text, whose chunks are first to upto; sums are of all chunks."""
    out = []
    for rank in ranks:
        if rank == 0:
            out.append(int(starts[first]))
            continue
        before = sums[first]
        owner = first + int(np.searchsorted(sums[first + 1 : upto + 1], before + rank))
        a, b = int(starts[owner]), int(starts[owner + 1]) if owner + 1 < upto else end
        hits = np.flatnonzero(token_ends(run, a, b, end))
        out.append(a + int(hits[rank - 1 - int(sums[owner] - before)]) + 1)
    return out


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return np.frombuffer(digest[:16], ">u4").tolist()


def arranged(text: bytes, a: int, b: int, form: str) -> bytes:
    """The document of a text cut at bytes a and b."""
    if form == "plain":
        return text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    parts = (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle) if form == "psm" else (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    return b"".join(parts)


def restored(document: bytes, form: str) -> list[bytes]:
    """The pieces of the text in order, found by the sentinels of the document."""
    if form == "plain":
        return [document]
    middle = document.index(MIDDLE)
    if form == "psm":
        suffix = document.index(SUFFIX)
        prefix, suffix = document[len(PREFIX) : suffix], document[suffix + len(SUFFIX) : middle]
    else:
        at = document.index(PREFIX)
        prefix, suffix = document[at + len(PREFIX) : middle], document[len(SUFFIX) : at]
    return [prefix, document[middle + len(MIDDLE) :], suffix]


def _characters(run: np.ndarray, a: int, b: int) -> int:
    """Code points of the bytes from a to b: those that do not continue one."""
    return sum(int(np.count_nonzero((run[x : min(x + BLOCK, b)] & 0xC0) != 0x80)) for x in range(a, b, BLOCK))


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch's texts in one run, and the offsets of the texts in it; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    run = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.empty(0, np.uint8)
    return run, offsets - offsets[0]


def _transformed(docs: DataFrame, seed: int, columns: str, finish: Callable[[bytes, str], dict]) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def rows(ids: list, run: np.ndarray, offsets: np.ndarray) -> Iterator[dict]:
        starts, first = chunk_starts(offsets)
        sums = np.concatenate(([0], np.cumsum(count_ends(run, offsets, starts)))) if len(starts) else np.zeros(1, np.int64)
        for i, doc_id in enumerate(ids):
            a, b = int(offsets[i]), int(offsets[i + 1])
            text, n = run[a:b].tobytes(), int(sums[first[i + 1]] - sums[first[i]])
            h1, h2, h3, h4 = draws(seed, doc_id)
            plain = not text or h3 % 100 >= TRANSFORMED or any(x in text for x in (PREFIX, SUFFIX, MIDDLE))
            form = "plain" if plain else "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
            row = {"doc_id": doc_id, "n": n, "form": form, "prefix_chars": None, "middle_chars": None}
            u = v = a
            if not plain:
                u, v = cut_places(run, starts, sums, int(first[i]), int(first[i + 1]), b, tuple(sorted((h1 % (n + 1), h2 % (n + 1)))))
                row |= {"prefix_chars": _characters(run, a, u), "middle_chars": _characters(run, u, v)}
            yield row | finish(arranged(text, u - a, v - a, form), form)

    schema = f"doc_id long, n long, form string, prefix_chars long, middle_chars long, {columns}"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(rows(batch.column(0).to_pylist(), *_texts(batch.column(1))))
            if out:
                longs = {k: pa.array([r[k] for r in out], pa.int64()) for k in ("doc_id", "n", "prefix_chars", "middle_chars")}
                yield pa.RecordBatch.from_pydict({k: longs[k] if k in longs else [r[k] for r in out] for k in out[0]})

    return docs.select("doc_id", "text").mapInArrow(apply, schema)


def transform(docs: DataFrame, seed: int = 42) -> DataFrame:
    """docs (doc_id, text) as (doc_id, n, form, prefix_chars, middle_chars, document): the rearranged texts."""
    return _transformed(docs, seed, "document string", lambda document, form: {"document": document.decode()})


def _digests(document: bytes, form: str) -> dict:
    whole = hashlib.sha256()
    for piece in restored(document, form):
        whole.update(piece)
    return {"output_sha256": hashlib.sha256(document).hexdigest(), "restored_sha256": whole.hexdigest()}


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _transformed(docs, 42, "output_sha256 string, restored_sha256 string", _digests)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tok,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (
  SELECT *, CAST(len(tok) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g),
c AS (
  SELECT *, array_to_string(tok[1:lo], '') AS p, array_to_string(tok[lo + 1:hi], '') AS m, array_to_string(tok[hi + 1:n], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form = 'plain' THEN NULL ELSE CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form = 'plain' THEN NULL ELSE CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM c
"""
