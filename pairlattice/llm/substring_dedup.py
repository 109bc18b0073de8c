"""Substring deduplication by content-defined chunks.

A gear hash rolls over a text's UTF-8 bytes (each step doubles the hash and adds the byte's
random number, so 16 bits see the last 16 bytes). A chunk ends where the hash's upper
``CUT_BITS`` bits are zero, at least ``LEAST`` bytes after its start; where ``MOST`` bytes have
no such place, as in periodic text, it ends at the least hash among them. Ends depend on
nearby bytes only, so text that moves keeps its chunks. From each chunk's start, and
back from each chunk's end, a window goes over as many whole chunks as it takes to hold
``LEAST_WORDS`` words. Windows are known by a 64-bit digest of their bytes; digests are counted with combined aggregates, and only those that occur
more than once are joined back to their places.

So every window that counts stands elsewhere in one piece. Overlapping ones form a repeated
passage. The windows that first occur elsewhere (smaller doc_id, or earlier in the same text)
are the ones removed, so one occurrence of every chunk stays. A word counts where its first byte
is; a window that begins inside a word counts that part, a passage of fewer words does not count.

Defined cases: a null or empty text has no chunks; in exact copies of LEAST_WORDS words or more the whole text is a passage;
every row is a text of its own, also where rows share a doc_id or have none (such rows are told apart by
their number in the input; a null doc_id comes before all others), and gets a row of its own; texts that share
nothing get no row in ``repeated_passages`` and are kept unchanged by ``deduplicate``; an empty table gives an
empty result; further columns are ignored, or kept by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlattice.llm.common import bounded_batches, by_ids, numbered, own_name, written

CUT_BITS, LEAST, MOST = 4, 16, 160
LEAST_WORDS = 16
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_GEAR = np.random.default_rng(11).integers(0, 1 << 16, 256).astype(np.uint16)


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: sums of shifted gear numbers, doubled window by doubled window."""
    h = _GEAR[raw]
    for k in (1, 2, 4, 8):
        shifted = h[:-k] << np.uint16(k)
        h = h.copy()
        h[k:] += shifted
    return h


def chunk_ends(raw: bytes) -> list[int]:
    """Ends of the chunks of a text; the last is its length."""
    n = len(raw)
    if not n:
        return []
    h = gear_hashes(np.frombuffer(raw, np.uint8))
    ends, start = [], 0
    for end in [*(np.flatnonzero(h >> np.uint16(16 - CUT_BITS) == 0) + 1).tolist(), n]:
        while end - start > MOST:
            start += LEAST + int(np.argmin(h[start + LEAST - 1 : start + MOST]))
            ends.append(start)
        if end - start >= LEAST or (end == n and start < n):
            ends.append(end)
            start = end
    return ends


def windows(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, finish, before, upto) of a text's windows; before and upto are the words that begin before start and finish."""
    ends = np.array(chunk_ends(raw), np.int32)
    starts = np.append(np.int32(0), ends)[: len(ends)]
    solid = ~_SPACE[np.frombuffer(raw, np.uint8)]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    count = np.append(0, np.cumsum(first)).astype(np.int32)
    inside = solid[starts] & ~first[starts]
    upto, n = count[ends], len(ends)
    held = count[starts] - inside
    ahead = np.searchsorted(upto, held + LEAST_WORDS)
    back = np.searchsorted(held, upto - LEAST_WORDS, side="right") - 1
    at = np.arange(n)
    both = np.unique(np.append((at * n + ahead)[ahead < n], (back * n + at)[back >= 0]))
    start, finish = starts[both // max(n, 1)], ends[both % max(n, 1)]
    return start, finish, count[start], count[finish]


def tagged(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, text): tag is 0 where a doc_id has one row, else the row's own number (it compresses to nothing in most rows)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    several = written(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", F.lit(True).alias("several")))
    number = F.monotonically_increasing_id() + 1
    if several.isEmpty():
        return docs.select("doc_id", F.when(F.col("doc_id").isNull(), number).otherwise(0).alias("tag"), "text")
    return by_ids(docs, several, "doc_id", "left").select("doc_id", F.when(F.col("doc_id").isNull() | F.col("several"), number).otherwise(0).alias("tag"), "text")


def places(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, tag, start, finish, before, upto): a row per window of docs (doc_id, tag, text); offsets in bytes of UTF-8."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, found, lengths = [], [], []
            for text in batch.column(2).to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                found.append(windows(raw))
                lengths.append(len(found[-1][0]))
                digest += [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(found[-1][0].tolist(), found[-1][1].tolist(), strict=True)]
            at = pa.array(np.repeat(np.arange(len(lengths)), lengths))
            columns = [np.concatenate(x) if found else np.empty(0, np.int32) for x in (zip(*found, strict=True) if found else [()] * 4)]
            yield pa.RecordBatch.from_pydict({"digest": np.array(digest, np.uint64).view(np.int64), "doc_id": batch.column(0).take(at), "tag": batch.column(1).take(at)} | dict(zip(("start", "finish", "before", "upto"), columns, strict=True)))

    return docs.mapInArrow(run, "digest long, doc_id long, tag long, start int, finish int, before int, upto int")


def repeated_passages(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(doc_id, tag, n_passages, n_words, n_removed_words, spans, removed, first_docs): a row per row with a repeated passage.

    spans are the passages' byte ranges; removed those of their windows that occur before; first_docs
    the documents that hold the windows' first occurrences. A column that numbers the rows may be named; it is then the tag.
    """
    texts = tagged(docs) if row is None else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("tag"), "text")
    rows = written(places(texts))
    place = F.struct("doc_id", "tag", "start")
    # written, as a join whose sides are both exchanges can be split where a digest is hot
    twice = written(rows.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"))
    repeated = written(rows.join(twice, "digest", "left_semi"))
    firsts = written(repeated.groupBy("digest").agg(F.min(place).alias("first")))
    met = repeated.join(firsts, "digest").select("doc_id", "tag", F.struct("start", "finish", "before", "upto", F.col("first.doc_id").alias("first_doc"), (~place.eqNullSafe(F.col("first"))).alias("later")).alias("c"))
    return met.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_list("c")).alias("cs")).mapInArrow(_runs, _RUNS)


_SPAN = "array<struct<start:int,finish:int>>"
_RUNS = f"doc_id long, tag long, n_passages int, n_words long, n_removed_words long, spans {_SPAN}, removed {_SPAN}, first_docs array<long>"


def _joined(windows: list[dict]) -> list[dict]:
    """Overlapping windows as one; they come by start."""
    out: list[dict] = []
    for c in windows:
        if out and c["start"] < out[-1]["finish"]:
            if c["finish"] > out[-1]["finish"]:
                out[-1] |= {"finish": c["finish"], "upto": c["upto"]}
        else:
            out.append({k: c[k] for k in ("start", "finish", "before", "upto")})
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: its passages and what to remove of them."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("finish", pa.int32())]))
    words = lambda spans: sum(x["upto"] - x["before"] for x in spans)
    for batch in batches:
        out = []
        for doc, tag, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            runs = [x for x in _joined(found) if x["upto"] - x["before"] >= LEAST_WORDS]
            begins = [x["start"] for x in runs]
            # passages do not overlap: a window is in the last one that begins before it, or in none
            inside = [c for c in found if (k := bisect_right(begins, c["start"])) and c["finish"] <= runs[k - 1]["finish"]]
            later = _joined([c for c in inside if c["later"]])
            firsts = sorted({c["first_doc"] for c in inside if c["first_doc"] != doc and c["first_doc"] is not None})
            if runs:
                ranges = [[{k: x[k] for k in ("start", "finish")} for x in y] for y in (runs, later)]
                out.append((doc, tag, len(runs), words(runs), words(later), *ranges, firsts))
        cols = list(zip(*out, strict=True)) or [[]] * 8
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), span, span, pa.list_(pa.int64()))
        names = ("doc_id", "tag", "n_passages", "n_words", "n_removed_words", "spans", "removed", "first_docs")
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], list(names))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with removed ranges cut out of their texts; only texts that lose something are moved."""
    docs, row = numbered(docs)
    cuts = written(repeated_passages(docs, row).filter(F.size("removed") > 0).select(F.col("tag").alias(row), F.col("removed").alias(own_name(docs, "removed"))))
    names = [c for c in docs.columns if c != row]
    at = names.index("text")
    same = by_ids(docs, cuts.select(row), row, "left_anti").select(*names)
    met = docs.join(cuts, row).select(*names, F.col(cuts.columns[1]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, removed in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                raw, done, out = (text or "").encode("utf-8", "surrogatepass"), 0, []
                for r in removed:
                    out.append(raw[done : r["start"]])
                    done = r["finish"]
                # a cut may fall inside a character of several bytes: its rest goes with the removed range
                texts.append((b"".join(out) + raw[done:]).decode("utf-8", "ignore"))
            yield batch.select(range(len(names))).set_column(at, "text", pa.array(texts, pa.string()))

    return same.unionByName(met.mapInArrow(cut, same.schema))


def query(spark, sf_dir: str) -> DataFrame:
    found = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["finish"].cast("string"))), ",")
    return found.select("doc_id", "n_passages", "n_words", "n_removed_words", joined("spans").alias("spans"), joined("removed").alias("removed"), "first_docs")
