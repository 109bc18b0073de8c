"""Mixing sources to target weights by systematic sampling, with DataFrame expressions only.

Every source gets a word budget: its weight's share of ``share`` times all words, at most
``cap`` times its own words, the excess going to the others by weight until none is above.
Each document's expected copies are its source's target over its source's words. Within a
source the documents are ordered by size (then by a hash), the expected copies are summed
up along that order, one offset per source is added, and a document is emitted once for
each whole number its step crosses. Neighbours in that order have like sizes, so the words
taken stay near the target.

The running position of a document is its rank, found without a window over a whole
source: counts per (source, size) and per (source, size, slice) are summed first, and only
documents of one slice are ranked together. A source, or copies of one document, may hold
any part of the rows.

Defined cases: a null text has size 0; a null source is a source of its own and comes
last; a document of size 0 has its copies counted like the others, they take no words;
rows repeated exactly stay separate rows, each with a place of its own, also where they share a doc_id or
have none; one text in two sources counts in each; an empty table gives an empty result; columns
beyond those named are ignored by ``plan_copies`` and kept by ``mix``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlattice.llm.common import WORD, own_name, written

WEIGHTS = (3, 1, 2)
#: Rows ranked together at most, in expectation, whatever a source or a size holds.
SLICE_ROWS = 20_000


def _hash60(x: Column) -> Column:
    return F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")


def _tie(seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """(source, source_size, target): one row per source, from (source, size) rows.

    A source is capped if cap * source_size / weight is small: with the sources in the order of
    that ratio, the first k are capped for the least k at which the next one's share fits.
    The table has a row per source, not per document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long"))
    per = per.withColumn("limit", cap * F.col("source_size"))
    order = W.orderBy((F.col("limit") / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumn("capped_before", F.coalesce(F.sum("limit").over(order), F.lit(0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(order), F.lit(0)))
    per = per.withColumn("all_words", F.sum("source_size").over(whole)).withColumn("all_weight", F.sum("weight").over(whole))
    # fits: if all before this source are capped and none after, its share is within its limit
    left, over = share * F.col("all_words") - F.col("capped_before"), F.col("all_weight") - F.col("weight_before")
    per = per.withColumn("fits", F.col("weight") * left <= F.col("limit") * over)
    first = F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    level = F.min(F.when(F.col("fits"), F.struct(first.alias("at"), left.alias("left"), over.alias("over")))).over(whole)
    per = per.withColumn("level", level).withColumn("at", first)
    uncapped = F.col("level").isNotNull() & (F.col("at") >= F.col("level.at"))
    target = F.when(uncapped, F.col("weight") * F.col("level.left") / F.col("level.over")).otherwise(F.col("limit").cast("double"))
    return per.select("source", "source_size", target.alias("target"))


def _planned(docs: DataFrame, seed: int, targets: dict) -> DataFrame:
    """docs (doc_id, source, text) as (doc_id, source, size, source_size, target, place, rate, offset, tie), row by row."""
    sized = written(docs.select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).alias("n"), _tie(seed).alias("tie")).select("doc_id", "source", F.coalesce("n", F.lit(0)).cast("long").alias("size"), "tie"))
    slices = max(8, sized.count() // SLICE_ROWS)
    sized = sized.withColumn("slice", (F.conv(F.substring("tie", 1, 7), 16, 10).cast("long") * slices / F.lit(1 << 28)).cast("long"))
    cells = sized.groupBy("source", "size", "slice").agg(F.count("*").alias("n"))
    per_size = cells.groupBy("source", "size").agg(F.sum("n").alias("n_size"))
    before = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    per_size = per_size.select("source", "size", F.coalesce(F.sum("n_size").over(before), F.lit(0)).alias("before_size"))
    within = W.partitionBy("source", "size").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("source", "size", "slice", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("before_slice"))
    rank = F.row_number().over(W.partitionBy("source", "size", "slice").orderBy("tie", "doc_id"))
    ranked = sized.withColumn("rank", rank)
    same = lambda a, b, *keys: [a[k].eqNullSafe(b[k]) for k in keys]
    goal = source_targets(sized, **targets)
    out = ranked.alias("d").join(cells.alias("c"), same(ranked, cells, "source", "size", "slice"))
    out = out.join(per_size.alias("p"), [F.col("d.source").eqNullSafe(F.col("p.source")), F.col("d.size") == F.col("p.size")])
    out = out.join(goal.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
    place = F.col("rank") + F.col("before_slice") + F.col("before_size")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = (_hash60(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("d.source"), F.lit("")))) % 1048576) / F.lit(1048576.0)
    return out.select("d.doc_id", "d.source", "d.size", "source_size", "target", place.alias("place"), rate.alias("rate"), offset.alias("offset"), "tie")


def _copies(first, last) -> Column:
    """Whole numbers crossed by the steps of the documents after place first, up to place last."""
    return (F.floor(last * F.col("rate") + F.col("offset")) - F.floor(first * F.col("rate") + F.col("offset"))).cast("long")


def plan_copies(docs: DataFrame, seed: int = 1, **targets) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, tie: one row per row of docs (doc_id, text, source)."""
    out = _planned(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text"), seed, targets)
    out = out.withColumn("copies", _copies(F.col("place") - 1, F.col("place")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "tie")


def mix(docs: DataFrame, seed: int = 1, **targets) -> DataFrame:
    """docs with every row repeated as often as the mix takes it.

    Rows of one doc_id, source and text have neighbouring places. Where there are several, equal rows are
    counted (combined before they are shuffled), and each kind of row takes the copies of as many of these places.
    """
    names = docs.columns
    tie, nth = own_name(docs, "tie"), own_name(docs, "nth")
    plan = _planned(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text"), seed, targets)
    plan = plan.groupBy("doc_id", "source", "tie").agg(F.count("*").alias("rows"), (F.min("place") - 1).alias("before"), F.first("rate").alias("rate"), F.first("offset").alias("offset"))
    plan = written(plan.filter((F.col("rows") > 1) | (_copies(F.col("before"), F.col("before") + 1) > 0)))
    place = plan.select("before", "rate", "offset", F.struct("doc_id", "source", "tie").alias("p"), "rows")
    keyed = docs.withColumn(tie, _tie(seed))
    met = keyed.select(F.struct(*names).alias("d"), tie, F.col("doc_id").alias("i"), F.col("source").cast("string").alias("s")).join(place, [F.col("i").eqNullSafe(F.col("p.doc_id")), F.col("s").eqNullSafe(F.col("p.source")), F.col(tie) == F.col("p.tie")])
    single = met.filter("rows = 1").withColumn("copies", _copies(F.col("before"), F.col("before") + 1))
    out = single.select("d", "copies")
    if not plan.filter("rows > 1").isEmpty():
        kinds = met.filter("rows > 1").groupBy("d", "p", "before", "rate", "offset").agg(F.count("*").alias("same"))
        upto = F.sum("same").over(W.partitionBy("p").orderBy(F.to_json("d")).rowsBetween(W.unboundedPreceding, 0))
        kinds = kinds.withColumn("upto", upto).withColumn("copies", _copies(F.col("before") + F.col("upto") - F.col("same"), F.col("before") + F.col("upto")))
        out = out.unionByName(kinds.filter("copies > 0").select("d", "copies"))
    return out.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("d.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return plan_copies(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('1|' || CAST(doc_id AS VARCHAR) || '|' || md5(coalesce(text, ''))) AS tie
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight FROM per),
ordered AS (
  SELECT *, coalesce(sum(2 * source_size) OVER o, 0) AS capped_before, coalesce(sum(weight) OVER o, 0) AS weight_before,
         sum(source_size) OVER () AS all_words, sum(weight) OVER () AS all_weight,
         row_number() OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, source ASC NULLS LAST) AS k
  FROM weighed
  WINDOW o AS (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fitted AS (
  SELECT *, CAST(1.5 AS DOUBLE) * all_words - capped_before AS lft, all_weight - weight_before AS over_w FROM ordered),
lev AS (
  SELECT min(k) AS k0, arg_min(lft, k) AS lft0, arg_min(over_w, k) AS over0 FROM fitted
  WHERE weight * lft <= CAST(2 * source_size AS DOUBLE) * over_w),
goal AS (
  SELECT source, source_size,
         CASE WHEN k0 IS NOT NULL AND k >= k0 THEN weight * lft0 / CAST(over0 AS DOUBLE) ELSE CAST(2 * source_size AS DOUBLE) END AS target
  FROM fitted, lev),
placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.tie, d.doc_id) AS place,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(md5('1|' || coalesce(d.source, '')), 1, 15) AS BIGINT) % 1048576 AS DOUBLE) / 1048576.0 AS off
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(floor(place * rate + off) - floor((place - 1) * rate + off) AS BIGINT) * size AS taken,
       CAST(floor(place * rate + off) - floor((place - 1) * rate + off) AS BIGINT) AS copies
FROM placed
"""
