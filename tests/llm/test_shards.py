"""Sharding of levels, against a hash written out in Python."""

import math
import struct

import pytest
import xxhash

from terralake.llm.shards import shard_levels


def expected(key, shards):
    """Shard of a key, by Spark's documented xxHash64 chain: every column's hash is the seed of the next."""
    h = xxhash.xxh64_intdigest(struct.pack("<i", 0), seed=42)
    if key is not None:
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=h)
    signed = h - (1 << 64) if h >> 63 else h
    best = []
    for shard, weight in shards:
        bits = xxhash.xxh64_intdigest(struct.pack("<i", shard), seed=xxhash.xxh64_intdigest(struct.pack("<q", signed), seed=42)) >> 11
        best.append((-math.log((bits + 0.5) / 2**53) / weight, shard))
    return min(best)[1]


SHARDS = [(0, 1.0), (1, 2.0), (5, 0.5)]


def test_against_python(spark):
    maps = spark.range(400).selectExpr("id AS map_id", "id % 3 AS score", "'x' AS _n")
    rows = shard_levels(maps, SHARDS, [*SHARDS, (7, 1.0)], carry=["score", "_n"]).collect()
    assert len(rows) == 400
    for r in rows:
        assert r["shard"] == expected(r["map_id"], SHARDS)
        assert r["grown_shard"] == expected(r["map_id"], [*SHARDS, (7, 1.0)])
        assert r["grown_shard"] in (r["shard"], 7)
        assert r["score"] == r["map_id"] % 3


def test_slots_are_gapless_even_for_one_hot_key(spark):
    maps = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN NULL ELSE id END AS map_id").repartition(9)
    rows = shard_levels(maps, SHARDS).collect()
    assert len(rows) == 3000
    for s, _ in SHARDS:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert len({r["shard"] for r in rows if r["map_id"] == 7}) == 1
    assert {r["shard"] for r in rows if r["map_id"] is None} == {expected(None, SHARDS)}


def test_weights_and_removal(spark):
    maps = spark.range(8000).selectExpr("id AS map_id")
    full = {r["map_id"]: r["shard"] for r in shard_levels(maps, SHARDS).collect()}
    share = sum(s == 1 for s in full.values()) / 8000
    assert abs(share - 2 / 3.5) < 0.03
    fewer = {r["map_id"]: r["shard"] for r in shard_levels(maps, SHARDS[:2]).collect()}
    assert all(fewer[k] == s for k, s in full.items() if s != 5)


def test_edges(spark):
    empty = spark.createDataFrame([], "map_id long, shard int")
    assert shard_levels(empty, SHARDS).collect() == []
    with pytest.raises(ValueError):
        shard_levels(empty, SHARDS, carry=["shard"])
    for wrong in ([], [(1, 0.0)], [(1, 1.0), (1, 2.0)]):
        with pytest.raises(ValueError):
            shard_levels(empty, wrong)
    names = spark.createDataFrame([("berlin",), (None,), ("",)], "map_id string")
    assert len(shard_levels(names, [(3, 1.0)]).filter("shard = 3").collect()) == 3
