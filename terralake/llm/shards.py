"""Weighted rendezvous hashing of stable record keys, with gapless slots inside every shard."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

TWO_53 = float(1 << 53)


def rendezvous_shard(key: Column, shards: Sequence[tuple[int, float]]) -> Column:
    """Shard of a key among ``shards``, pairs of shard number and weight.

    Every shard draws a number u in (0, 1) from a hash of the key and its own number and scores ``-ln(u) / weight``; the lowest
    score takes the key. Scores of a shard never depend on the other shards, so a new shard takes keys only into itself, and a
    removed one gives up only its own. A null key is a key like any other. Equal scores go to the lower shard number.
    """
    if not shards or any(not w > 0 or math.isinf(w) for _, w in shards) or len({s for s, _ in shards}) < len(shards):
        raise ValueError("shards need distinct numbers and positive finite weights")
    mixed = F.coalesce(F.xxhash64(F.lit(0), key), F.lit(0))
    scores = []
    for shard, weight in shards:
        bits = F.shiftrightunsigned(F.xxhash64(mixed, F.lit(int(shard))), 11)
        u = (bits.cast("double") + 0.5) / TWO_53
        scores.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("score"), F.lit(int(shard)).alias("shard")))
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def shard_levels(maps: DataFrame, shards: Sequence[tuple[int, float]], grown: Sequence[tuple[int, float]] | None = None,
                 key: str = "map_id", carry: Sequence[str] = ()) -> DataFrame:
    """Place level records into weighted shards: ``<carry>, <key>, shard, grown_shard, slot``.

    ``maps`` is any table with a stable record key (levels by ``map_id``, objects, zones). ``carry`` names the columns to keep,
    which may be called anything but ``shard``, ``grown_shard`` and ``slot``. ``grown`` is the shard list after a change; null
    where not given. Slots count from 0 without gaps inside a shard.

    Rows with one key share a shard, whatever their number, so slots aren't numbered by a window over a shard: the narrow
    result is written once, every file split of it is numbered on its own, and the splits' row counts are summed up in front
    of it. Null keys are placed together, repeated rows get a slot each, an empty table gives an empty result.
    """
    taken = {"shard", "grown_shard", "slot", "_part", "_seq"}
    if clash := taken & {key, *carry}:
        raise ValueError(f"columns {sorted(clash)} are results")
    kept = [key, *(c for c in carry if c != key)]
    placed = cut(
        maps.select(
            *kept, rendezvous_shard(F.col(key), shards).alias("shard"),
            (rendezvous_shard(F.col(key), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        ).withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()),
        "shards",
    )
    group = ["shard", "_part"]
    sizes = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.select(*group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    local = F.row_number().over(W.partitionBy(*group).orderBy("_seq")) - 1
    return placed.withColumn("_local", local).join(shift, group).select(
        *kept, "shard", "grown_shard", (F.col("_local") + F.col("_shift")).cast("long").alias("slot")
    )
