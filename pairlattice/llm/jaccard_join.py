"""N-gram Jaccard self-join: a size-aware heavy-light join, exact, and its components.

A document's set holds its distinct 5-word shingles (64-bit hashes). Sets link when their
Jaccard similarity is at least 3/4. Two linked sets of sizes r and s share at least
o = ceil(3 (r + s) / 7) shingles, so in any one order of all shingles the first r - o + c of
the one and the first s - o + c of the other share at least c. As o is at least 3/4 of
either size, prefixes of ``size - ceil(0.75 size) + c`` are enough to post; the place of a
shingle in its set is posted too, and two sets meet in a list only if both places are within
what their two sizes allow. That gives two kinds of inverted list:

* small sets enumerate all 2-subsets of their prefix for c = 2; a list is keyed by a subset;
* large sets post each shingle of their prefix for c = 1; a list is keyed by a shingle;
* sets above the boundary that a small set could still link with post both kinds.

The boundary is the size at which the summed cost of subset rows and list scans over the
table's own size histogram is least (``choose_boundary``).

The order puts shingles that many sets hold last, so that a passage shared by many texts
does not make long lists. How many hold one comes from a sketch of fixed size, counted over
all documents; it steers cost only, any order gives the same links.

Work that would grow with the square of a group is avoided, not capped:

1. documents with equal sets form a class, represented by one row;
2. in each list all members are compared with the list's centre only (linear), components
   are built from what links;
3. only lists that still span several components are joined with themselves, across
   components only; those pairs are compared exactly too, and components are built again.

A pair left out has both ends in one component already, so components are exact.

Defined cases: a null or wordless text has an empty set, size 0, and links with nothing;
fewer than five words make one shingle; every row is a document of its own, also where rows
share a doc_id or have none (a component's id is null only if none of its rows has a doc_id);
of a component ``keep_one`` keeps the row of smallest doc_id, of equal ones the first, one without a
doc_id last; an empty table gives an empty result; further columns, whatever their names, are
ignored by ``link_components`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlattice.llm.common import bounded_batches, by_ids, numbered, tidy, written
from pairlattice.llm.components import components
from pairlattice.llm.shingles import WordHashes, shingle_set

NUM, DEN, WORDS = 3, 4, 5
#: Counters of the shared-shingle sketch, and the rows it is sent in.
SKETCH_BITS, SKETCH_PARTS = 23, 32
#: A list of more sets than SLICE_ROWS, by the sketch, is dealt in slices; a key's low bits tell the slice, from 1, and are 0 in an undivided list.
SLICE_ROWS, SLICE_MASK = 1 << 14, (1 << 12) - 1
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _share(n: int) -> int:
    """Shingles that a set of n shares with any set it links with, at least."""
    return -(-NUM * n // DEN)


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _pack(counts: np.ndarray) -> bytes:
    return zstandard.compress(counts.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), np.uint32)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document (size, digest of its set); at the end the task's sketch in parts."""
    hashes, sketch, task = WordHashes(), np.zeros(1 << SKETCH_BITS, np.uint32), 0
    none = lambda n, kind: pa.nulls(n, kind)
    seen = False
    for batch in batches:
        ids, size, digest = batch.column(0), [], []
        task = task or hash(str(ids[0] if len(ids) else 0)) & 15
        for text in batch.column(1).to_pylist():
            s = shingle_set(text, hashes, WORDS)
            size.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            np.add.at(sketch, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        n, seen = len(size), True
        yield pa.RecordBatch.from_pydict({"doc_id": ids, "size": pa.array(size, pa.int64()), "digest": pa.array(digest, pa.binary()), "part": none(n, pa.int32()), "spread": none(n, pa.int32()), "counts": none(n, pa.binary())})
    if seen:
        n = SKETCH_PARTS
        yield pa.RecordBatch.from_pydict({"doc_id": none(n, pa.int64()), "size": none(n, pa.int64()), "digest": none(n, pa.binary()), "part": pa.array(range(n), pa.int32()), "spread": pa.array([task] * n, pa.int32()), "counts": pa.array([_pack(x) for x in np.split(sketch, n)], pa.binary())})


def _add_counts(group: pa.Table) -> pa.Table:
    total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.uint64)
    for x in group.column("counts"):
        total += _unpack(x.as_py())
    return pa.table({"part": group.column("part")[:1].combine_chunks(), "counts": pa.array([_pack(np.minimum(total, 0xFFFFFFFF).astype(np.uint32))], pa.binary())})


def _sum_sketch(rows: DataFrame) -> np.ndarray:
    """Adds the tasks' sketches in two levels; 32 MB at most reach the driver, whatever the input."""
    rows = rows.groupBy("part", "spread").applyInArrow(_add_counts, "part int, counts binary")
    rows = rows.groupBy("part").applyInArrow(_add_counts, "part int, counts binary")
    found = {r["part"]: _unpack(r["counts"]) for r in rows.collect()}
    return np.concatenate([found[i] for i in range(SKETCH_PARTS)]) if found else np.zeros(1 << SKETCH_BITS, np.uint32)


def _shared_levels(sketch: np.ndarray) -> np.ndarray:
    """A byte per counter: 0 while its count is what unshared shingles give, else the excess on a log scale."""
    mean = float(np.median(sketch))
    excess = sketch - (mean + 6 * np.sqrt(mean + 1))
    return np.where(excess > 0, 1 + np.log2(np.maximum(excess, 1)).astype(np.int64) // 2, 0).astype(np.uint8)


def _slices(levels: np.ndarray) -> np.ndarray:
    """Into how many slices lists of these levels are dealt; 0 for undivided ones. A level bounds the count within a factor of 4."""
    n = np.left_shift(np.uint64(1), np.minimum(2 * levels.astype(np.uint64), np.uint64(62))) // np.uint64(SLICE_ROWS)
    return np.where(n > 1, np.minimum(n, np.uint64(SLICE_MASK)), np.uint64(0))


def _whole_key(key: str):
    return F.col(key).bitwiseAND(~SLICE_MASK)


def choose_boundary(histogram: dict[int, int], list_length: float, post: float = 1.0, scan: float = 1.0, most: int = 64) -> int:
    """The size up to which sets enumerate subsets: least rows posted and list entries scanned over the histogram."""

    def cost(boundary: int) -> float:
        total = 0.0
        for n, sets in histogram.items():
            prefix = n - _share(n) + 1
            if 2 < n and n * NUM <= boundary * DEN:
                total += sets * post * (prefix + 1) * prefix / 2
            if n > boundary:
                total += sets * prefix * (post + scan * list_length)
        return total

    return min(range(3, most + 1), key=cost)


def _postings(levels: np.ndarray, boundary: int):
    """Tasks' function: (doc_id, text) -> (key, doc_id, size, place, rare), a row per list that a set is in.

    place is how many shingles of the set come before the shared one; for a subset, before its first
    possible position as a pair, so that one test serves both kinds.
    """
    shift, mask = np.uint64(64 - SKETCH_BITS), np.uint64(SLICE_MASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keys, places, ids, sizes, rare, lengths = [], [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(text, hashes, WORDS)
                n = len(s)
                if n < 3:  # links with its equals only
                    continue
                level = levels[(s >> shift).astype(np.int64)]
                ordered = s if not level.any() else s[np.lexsort((s, level))]
                prefix, out = n - _share(n) + 1, []
                # rare shingles come first, so a set's least levels lead
                slices = _slices(np.sort(level)[: prefix + 1])
                own = np.uint64(xxhash.xxh64_intdigest(s.tobytes()))
                nth = np.where(slices > 0, own % np.maximum(slices, np.uint64(1)) + np.uint64(1), np.uint64(0))
                if n > boundary:
                    out.append(ordered[:prefix] & ~mask | nth[:prefix])
                    places.append(np.arange(prefix, dtype=np.int32))
                if n * NUM <= boundary * DEN:
                    i, j = np.triu_indices(prefix + 1, 1)
                    # a pair's list is no longer than that of its rarer shingle, which comes first
                    out.append((((ordered[i] ^ (ordered[i] >> np.uint64(31))) * _GOLD) ^ ordered[j]) & ~mask | nth[i])
                    places.append((j - 1).astype(np.int32))
                keys += out
                lengths.append(sum(map(len, out)))
                ids.append(doc)
                sizes.append(n)
                rare.append(int((level == 0).sum()))
            if ids:
                yield pa.RecordBatch.from_pydict({"key": _signed(np.concatenate(keys)), "doc_id": np.repeat(np.array(ids, np.int64), lengths), "size": np.repeat(np.array(sizes, np.int32), lengths), "place": np.concatenate(places), "rare": np.repeat(np.array(rare, np.int32), lengths)})

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, a list's centre first -> its lists of two or more: (key, doc_id, size, place, centre, centre_size, centre_place)."""
    last_key, centre, centre_size, centre_place, waiting = None, None, None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc, size, place = (batch.column(i).to_numpy() for i in range(4))
        if waiting is not None:
            key, doc, size, place = (np.concatenate((np.array([w], x.dtype), x)) for w, x in zip(waiting, (key, doc, size, place), strict=True))
        new = np.concatenate(([key[0] != last_key], key[1:] != key[:-1]))
        start = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        at = np.maximum(start, 0)
        c = np.where(start < 0, centre if centre is not None else 0, doc[at])
        cs = np.where(start < 0, centre_size if centre is not None else 0, size[at])
        cp = np.where(start < 0, centre_place if centre is not None else 0, place[at])
        # a list of one set links nothing, but for a slice of a longer list
        alone = new & np.concatenate((new[1:], [False])) & (key & SLICE_MASK == 0)
        # a list that may have ended with this batch, or go on, waits for the next; a slice's first set is given at once
        waiting = (key[-1], doc[-1], size[-1], place[-1]) if new[-1] and key[-1] & SLICE_MASK == 0 else None
        keep = ~alone
        if waiting is not None:
            keep[-1] = False
            last_key, centre, centre_size, centre_place = (key[-2], c[-2], cs[-2], cp[-2]) if len(key) > 1 else (last_key, centre, centre_size, centre_place)
        else:
            last_key, centre, centre_size, centre_place = key[-1], c[-1], cs[-1], cp[-1]
        if keep.any():
            yield pa.RecordBatch.from_pydict({"key": key[keep], "doc_id": doc[keep], "size": size[keep], "place": place[keep], "centre": c[keep].astype(np.int64), "centre_size": cs[keep].astype(np.int32), "centre_place": cp[keep].astype(np.int32)})


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts, compressed: a third of the size of their shingles' hashes."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "packed"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact test of (u, v, a, b): the two texts, packed. Rows come by u, so its set is kept."""
    hashes, unpack, kept, of_kept = WordHashes(), zstandard.ZstdDecompressor(), None, None
    of = lambda packed: shingle_set(unpack.decompress(packed).decode("utf-8", "surrogatepass"), hashes, WORDS)
    for batch in batches:
        ok = []
        for u, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if u != kept:
                kept, of_kept = u, of(a)
            x, y = of_kept, of(b)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            shared = int((y[at] == x).sum())
            ok.append(DEN * shared >= NUM * (len(x) + len(y) - shared))
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) that link, by their whole texts; only documents that occur in a pair are moved."""
    needed = written(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct())
    packed = written(by_ids(texts, needed, "doc_id", "left_semi").mapInArrow(tidy(_packed), "doc_id long, packed binary"))
    half = pairs.join(packed.select(F.col("doc_id").alias("v"), F.col("packed").alias("b")), "v")
    full = half.join(packed.select(F.col("doc_id").alias("u"), F.col("packed").alias("a")), "u")
    return full.select("u", "v", "a", "b").mapInArrow(tidy(_linked), "u long, v long")


def _may_link(size: str, place: str, other_size: str, other_place: str):
    """Whether two sets that meet in a list can share enough: both places leave room for the overlap that the sizes ask for."""
    least = F.ceil((F.col(size) + F.col(other_size)) * NUM / (NUM + DEN))
    return (F.col(place) + least <= F.col(size)) & (F.col(other_place) + least <= F.col(other_size))


def link_rows(texts: DataFrame) -> DataFrame:
    """(row, n_shingles, component_id, survivor) of texts (row, doc_id, text), row being a number of its own per row of a written table."""
    spark = texts.sparkSession
    bounded_batches(spark)
    ids, texts = texts.select("row", "doc_id"), texts.select(F.col("row").alias("doc_id"), "text")  # a row number is the id from here on
    first = written(texts.mapInArrow(tidy(_profiles), "doc_id long, size long, digest binary, part int, spread int, counts binary"))
    profile = first.filter("part is null").select("doc_id", "size", "digest")
    levels = _shared_levels(_sum_sketch(first.filter("part is not null").select("part", "spread", "counts")))
    classes = written(profile.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("representative"), F.min("size").alias("size"), F.count("*").alias("copies")))
    histogram = {r["size"]: r["n"] for r in classes.filter("size < 200").groupBy("size").agg(F.count("*").alias("n")).collect()}
    boundary = choose_boundary(histogram, list_length=1.0 + float((levels > 0).mean()) * 8)
    copied = profile.join(classes.filter("copies > 1").select("digest", "representative"), "digest").filter("doc_id <> representative").select("doc_id")
    own = by_ids(texts, written(copied), "doc_id", "left_anti")

    spread = spark.sparkContext.broadcast(levels)
    postings = own.mapInArrow(tidy(lambda it: _postings(spread.value, boundary)(it)), "key long, doc_id long, size int, place int, rare int")
    by_key = postings.repartition("key").sortWithinPartitions("key", "rare", "size", "doc_id").select("key", "doc_id", "size", "place")
    lists = written(by_key.mapInArrow(tidy(_stars), "key long, doc_id long, size int, place int, centre long, centre_size int, centre_place int"))
    stars = lists.filter("doc_id <> centre").filter(_may_link("size", "place", "centre_size", "centre_place")).select(F.least("doc_id", "centre").alias("u"), F.greatest("doc_id", "centre").alias("v"))
    if _slices(levels).any():  # some list is dealt in slices: their centres meet the least of them
        heads = lists.filter(F.col("key").bitwiseAND(SLICE_MASK) > 0).select(_whole_key("key").alias("list"), F.struct(F.col("centre_size").alias("size"), F.col("centre").alias("id"), F.col("centre_place").alias("place")).alias("head")).distinct()
        met = heads.join(heads.groupBy("list").agg(F.min("head").alias("least")), "list").filter("head.id <> least.id").filter(_may_link("head.size", "head.place", "least.size", "least.place"))
        stars = stars.unionByName(met.select(F.least("head.id", "least.id").alias("u"), F.greatest("head.id", "least.id").alias("v")))
    stars = written(stars.distinct())
    links = written(_verify(stars, own))
    comp = written(components(links))

    # lists that still span components: pairs across them
    member = lists.select(_whole_key("key").alias("key"), "doc_id", "size", "place").join(comp.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    member = written(member)
    mixed = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    open_ = written(member.join(mixed, "key", "left_semi"))  # written, so that the join deals its rows anew and a long list can be split
    a, b = open_.alias("a"), open_.alias("b")
    cross = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.component") < F.col("b.component")) & _may_link("a.size", "a.place", "b.size", "b.place"))
    cross = cross.select(F.least("a.doc_id", "b.doc_id").alias("u"), F.greatest("a.doc_id", "b.doc_id").alias("v")).distinct()
    cross = written(cross.join(stars, ["u", "v"], "left_anti"))
    more = _verify(cross, own)
    comp = written(components(links.unionByName(written(more))))

    # rows of one component, and the one of smallest doc_id among them
    of_class = classes.join(comp.withColumnRenamed("id", "representative"), "representative", "left").select("digest", F.coalesce("component", "representative").alias("component"))
    rows = written(profile.join(of_class, "digest", "left").select(F.col("doc_id").alias("row"), "size", F.coalesce("component", "doc_id").alias("component")).join(ids, "row"))
    # written, so that the join deals its rows anew and a large component can be split
    least = written(rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")))
    return rows.join(least, "component").select("row", "doc_id", F.col("size").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("survivor"))


def link_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of docs (doc_id, text)."""
    texts, row = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return link_rows(texts.select(F.col(row).alias("row"), "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the one of smallest doc_id."""
    names = docs.columns
    docs, row = numbered(docs)
    linked = link_rows(docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    gone = linked.filter("row <> survivor").select(F.col("row").alias(row))
    return by_ids(docs, written(gone), row, "left_anti").select(*names)


def query(spark, sf_dir: str) -> DataFrame:
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The same rows by comparing every pair that shares a shingle.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '', ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
  SELECT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+4], ' ') END AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM o JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
g AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
"""
ORACLE = (
    ORACLE.replace("WITH w", "WITH RECURSIVE w", 1)
    + """
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT g.v, r.c FROM r JOIN g ON g.u = r.doc_id)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, coalesce(min(r.c), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY w.doc_id
"""
)
