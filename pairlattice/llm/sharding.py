"""Sharding by a hierarchical weighted hash tree, with DataFrame expressions only.

The tree has regions, racks in regions and shards in racks; a shard has a weight, a rack or
region the sum of those below it. A document descends from the root: at every level each child
draws ln(u) / weight, where u in (0, 1) is a hash of the document's id and the child's own
identity, and the greatest draw wins, so a child is chosen in proportion to its weight. A draw
depends on nothing but that child. So when weights change in a subtree, documents move only into
nodes that became heavier or out of nodes that became lighter, and those elsewhere keep
their places in all subtrees left alone. A shard that ``grown`` adds stands in a region
of its own: no other node's weight changes, and documents move into that shard only.

Shards follow from expressions on a row, without a shuffle. Slots (0, 1, 2, ... in a shard) are ranks
by a hash, found without a window over a whole shard: equal rows are counted first, a
shard's kinds of rows are cut into slices by that hash, counts per slice are summed up, and only a
slice's kinds are ranked together. A kind with very many copies is spread again before its slots are made.

Defined cases: a null text has no bytes and the checksum of the empty text; a null doc_id is a
key of its own, so its rows share a shard; rows alike in doc_id, size and checksum take as many
neighbouring slots; shards of weight 0 take nothing; an empty table gives an empty
result; columns beyond doc_id and text are ignored by ``plan_slots`` and kept by ``assign``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlattice.llm.common import own_name, written

#: Added to every document's bytes.
OVERHEAD = 16
#: Kinds of rows ranked together at most, in expectation; copies of one kind whose slots one task makes.
SLICE_KINDS, COPIES = 20_000, 10_000


class Shard(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(shards: int = 40, per_rack: int = 4, racks: int = 2) -> list[Shard]:
    """Shards of equal weight, so many a rack and racks a region; rack numbers run over all regions."""
    return [Shard(i // per_rack // racks, i // per_rack, i) for i in range(shards)]


def grown(tree: Sequence[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region and a rack of its own."""
    return [*tree, Shard(*(max(x[i] for x in tree) + 1 for i in range(3)), weight)]


def _levels(tree: Sequence[Shard]) -> list[list[list[dict]]]:
    """Per level, the children of each node of the level above in order: id, weight, place in the order of their own level."""
    alive = sorted(x for x in tree if x.weight > 0)
    if not alive:
        raise ValueError("a tree needs a shard of weight above 0")
    paths = [sorted({x[:depth] for x in alive}) for depth in range(4)]
    weight = {p: sum(x.weight for x in alive if x[: len(p)] == p) for level in paths for p in level}
    return [[[{"id": p[-1], "weight": weight[p], "place": i} for i, p in enumerate(paths[d + 1]) if p[:-1] == parent] for parent in paths[d]] for d in range(3)]


def _unit(*parts: Column) -> Column:
    """A double in (0, 1) from the parts' MD5."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("double") + 0.5) / float(1 << 60)


def _draw(seed: int, level: int, key: Column) -> Callable[[Column], Column]:
    """A child with its draw, which orders children."""

    def draw(child: Column) -> Column:
        u = _unit(F.lit(str(seed)), F.lit(str(level)), child["id"].cast("string"), key)
        return F.struct((F.ln(u) / child["weight"]).alias("draw"), child["id"].alias("id"), child["place"].alias("place"))

    return draw


def shard_of(tree: Sequence[Shard], key: Column, seed: int = 1) -> Column:
    """The shard that a document with this key (a string) descends to."""
    place = F.lit(0)
    for depth, children in enumerate(_levels(tree)):
        nodes = F.from_json(F.lit(json.dumps(children)), "array<array<struct<id:int,weight:double,place:int>>>")
        best = F.array_max(F.transform(F.element_at(nodes, place + 1), _draw(seed, depth, key)))
        place = best["place"]
    return best["id"]


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def assign(docs: DataFrame, tree: Sequence[Shard] | None = None, seed: int = 1) -> DataFrame:
    """docs with their shard, in a column ``shard`` (or the next free name); no shuffle."""
    return docs.withColumn(own_name(docs, "shard"), shard_of(tree or layout(), _key(), seed))


def write_shards(docs: DataFrame, path: str, tree: Sequence[Shard] | None = None, seed: int = 1, rows: int = 200_000) -> None:
    """docs as Parquet, a folder for each shard, in files of about so many rows: a large shard is many tasks' work."""
    tree = tree or layout()
    placed = assign(docs, tree, seed)
    shard, part = placed.columns[-1], own_name(placed, "part")
    parts = max(1, docs.count() // (len(tree) * rows))
    # by row and not by document, so that copies of one document are spread as well
    placed = placed.withColumn(part, F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
    placed.repartition(shard, part).drop(part).write.partitionBy(shard).parquet(path)


def plan_slots(docs: DataFrame, tree: Sequence[Shard] | None = None, seed: int = 1) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard: one row per row of docs (doc_id, text)."""
    tree = tree or layout()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"))
    kinds = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    tie = F.md5(F.concat_ws("|", F.lit(f"{seed}|slot"), _key(), F.col("size").cast("string"), F.col("text_crc32").cast("string")))
    kinds = written(kinds.withColumns({"shard": shard_of(tree, _key(), seed), "grown_shard": shard_of(grown(tree), _key(), seed), "tie": tie}))
    slices = max(1, kinds.count() // (SLICE_KINDS * len(tree)))
    kinds = kinds.withColumn("slice", (F.conv(F.substring("tie", 1, 7), 16, 10).cast("long") * slices / F.lit(1 << 28)).cast("long"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    cells = kinds.groupBy("shard", "slice").agg(F.sum("n").alias("n")).select("shard", "slice", F.coalesce(before, F.lit(0)).alias("before"))
    within = W.partitionBy("shard", "slice").orderBy("tie", "doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, 0)
    placed = kinds.withColumn("upto", F.sum("n").over(within)).join(cells, ["shard", "slice"]).withColumn("first", F.col("before") + F.col("upto") - F.col("n"))
    out = lambda df, first, last: df.withColumn("slot", F.explode(F.sequence(first, last))).select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")
    last = F.col("first") + F.col("n") - 1
    if kinds.filter(F.col("n") > COPIES).isEmpty():
        return out(placed, F.col("first"), last)
    placed = written(placed)
    runs = placed.filter(F.col("n") > COPIES).withColumn("from", F.explode(F.sequence(F.col("first"), last, F.lit(COPIES)))).repartition("shard", "from")
    return out(placed.filter(F.col("n") <= COPIES), F.col("first"), last).unionByName(out(runs, F.col("from"), F.least(F.col("from") + COPIES - 1, last)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan_slots(docs).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


_DRAW = "ln((CAST(CAST('0x' || substr(md5('1|{level}|' || {node} || '|' || doc), 1, 15) AS BIGINT) AS DOUBLE) + 0.5) / 1152921504606846976.0) / {weight}"


def _descent(name: str, source: str, regions: str) -> str:
    """SQL: each document's region, rack and shard by the greatest draws, in the tree of regions (id, weight)."""
    return f"""{name}0 AS (SELECT doc, arg_max(id, {_DRAW.format(level=0, node="id", weight="weight")}) AS region FROM {source}, ({regions}) GROUP BY doc),
{name}1 AS (SELECT doc, region, arg_max(rack, {_DRAW.format(level=1, node="rack", weight="weight")}) AS rack FROM {name}0 JOIN racks USING (region) GROUP BY ALL),
{name} AS (SELECT doc, arg_max(shard, {_DRAW.format(level=2, node="shard", weight="1.0")}) AS shard FROM {name}1 JOIN shards USING (rack) GROUP BY doc)"""


#: The checksum's rule (polynomial 0xEDB88320, a bit at a time) over a text's bytes, read as hex pairs.
_CRC = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(txt)), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))))"

ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS doc, coalesce(text, '') AS txt FROM documents),
rows_ AS (SELECT doc_id, doc, CAST(strlen(txt) + 16 AS BIGINT) AS size, CAST({_CRC} AS BIGINT) AS crc FROM d),
ids AS (SELECT DISTINCT doc FROM d),
shards AS (SELECT CAST(i AS INT) AS shard, CAST(i // 4 AS INT) AS rack FROM range(41) r(i)),
racks AS (SELECT rack, CAST(rack // 2 AS INT) AS region, CAST(count(*) AS DOUBLE) AS weight FROM shards GROUP BY ALL),
{_descent("now_", "ids", "SELECT CAST(i AS INT) AS id, 8.0 AS weight FROM range(5) r(i)")},
{_descent("next_", "ids", "SELECT CAST(i AS INT) AS id, CASE WHEN i < 5 THEN 8.0 ELSE 1.0 END AS weight FROM range(6) r(i)")}
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, now_.shard AS shard,
       row_number() OVER (PARTITION BY now_.shard ORDER BY md5('1|slot|' || doc || '|' || CAST(size AS VARCHAR) || '|' || CAST(crc AS VARCHAR)), doc_id, size, crc) - 1 AS slot,
       next_.shard AS grown_shard
FROM rows_ JOIN now_ USING (doc) JOIN next_ USING (doc)
"""
