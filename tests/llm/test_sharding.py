"""Shards by a weighted hash tree: laws of movement, shares, slots."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pairlattice.llm import sharding
from pairlattice.llm.sharding import Shard, grown, layout, plan_slots, shard_of


def unit(*parts):
    return (int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16) + 0.5) / (1 << 60)


def brute(tree, key, seed=1):
    """Down the tree, a level at a time."""
    at = ()
    for depth in range(3):
        weights = defaultdict(float)
        for x in tree:
            if x[:depth] == at and x.weight > 0:
                weights[x[: depth + 1]] += x.weight
        at = max(weights, key=lambda p: (math.log(unit(seed, depth, p[-1], key)) / weights[p], p[-1]))
    return at[-1]


def shards(spark, tree, n=4000):
    return {r[0]: r[1] for r in spark.range(n).select("id", shard_of(tree, F.col("id").cast("string"))).collect()}


def test_descent_by_plain_loop(spark):
    tree = [Shard(0, 0, 0, 2.0), Shard(0, 0, 1, 0.5), Shard(0, 1, 2), Shard(1, 2, 3, 3.0), Shard(1, 2, 4, 0.0), Shard(4, 7, 9, 1.5)]
    got = shards(spark, tree, 500)
    assert got == {i: brute(tree, i) for i in range(500)}


def test_shares_follow_the_weights(spark):
    tree = [Shard(0, 0, 0, 4.0), Shard(0, 0, 1, 1.0), Shard(0, 1, 2, 1.0), Shard(1, 2, 3, 2.0)]
    got, n = Counter(shards(spark, tree, 20_000).values()), 20_000
    for x in tree:
        share = x.weight / 8
        assert abs(got[x.shard] / n - share) < 4 * math.sqrt(share / n)


@pytest.mark.parametrize("count", [1, 5, 40, 41, 43])
def test_one_more_shard_takes_rows_only_into_itself(spark, count):
    tree = layout(min(count, 40))
    while len(tree) < count:
        tree = grown(tree)
    now, after = shards(spark, tree), shards(spark, grown(tree))
    moved = [i for i in now if now[i] != after[i]]
    assert moved and all(after[i] == count for i in moved)
    assert abs(len(moved) / len(now) - 1 / (count + 1)) < 0.03


def test_movement_stays_in_the_subtree_whose_weight_changes(spark):
    tree = layout(24)
    heavier = [x._replace(weight=3.0) if x.shard == 9 else x for x in tree]  # rack 2, region 1
    now, after = shards(spark, tree), shards(spark, heavier)
    place = {x.shard: x for x in tree}
    for i in now:
        a, b = place[now[i]], place[after[i]]
        if a.region != b.region:
            assert b.region == 1
        elif a.rack != b.rack:
            assert (b.region, b.rack) == (1, 2)
        elif a.shard != b.shard:
            assert b.shard == 9
    lighter = [x for x in tree if x.shard != 9]
    after = shards(spark, lighter)
    assert all(place[now[i]].region == 1 for i in now if now[i] != after[i])


def check_slots(rows, docs, copies=Counter()):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        key = "" if r["doc_id"] is None else r["doc_id"]
        assert r["shard"] == brute(layout(), key) and r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("kinds, copies", [(20_000, 10_000), (3, 2), (1, 1)])
def test_slots_have_no_gaps(spark, monkeypatch, kinds, copies):
    monkeypatch.setattr(sharding, "SLICE_KINDS", kinds)
    monkeypatch.setattr(sharding, "COPIES", copies)
    docs = [(i, f"text {i % 7}") for i in range(300)] + [(None, None), (None, "é"), (5, None), (5, ""), (6, "x" * 100_000)] + [(11, "same")] * 57 + [(None, "hot")] * 40
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("shard", "slot", "n", "tie", "slice")})
    check_slots(plan_slots(df).collect(), docs)


def test_slots_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = lambda x: sorted(map(tuple, plan_slots(x).collect()))
    assert rows(df.repartition(1)) == rows(df.repartition(7, "text"))


def test_written_shards_hold_every_row(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(1).alias("shard"))
    sharding.write_shards(df, str(tmp_path / "out"), rows=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["doc_id"], r["shard_"]) for r in back.collect()} == {(i, brute(layout(), i)) for i in range(300)} and back.count() == 300


def test_empty_table_and_trees_without_weight(spark):
    assert plan_slots(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        shard_of([Shard(0, 0, 0, 0.0)], F.lit("1"))
