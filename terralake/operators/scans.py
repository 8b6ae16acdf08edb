"""Building blocks that keep one hot key from landing in one task.

Running totals are computed in chunks of the ordering value: each chunk is scanned on its own and
receives the total of the chunks before it, so no window ever holds a whole hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 1 << 16
SALTS = 32
#: Bytes of a row in memory for each byte the planner counts: it goes by compressed files.
UNPACKED = 16


def join_keyed(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where a null key equals a null key, so that no row is lost; the keys appear once."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def _scan(df: DataFrame, part: Sequence[str], order: str, value, out: str, agg, inclusive: bool,
          chunk: int) -> DataFrame:
    keys = [*part, "_chunk"]
    # a row without a place in the order has no running value: better to stop than to leave it out
    place = f"coalesce(`{order}`, cast(raise_error('column {order} orders a running value and must not be null') AS BIGINT))"
    tagged = df.withColumn("_chunk", F.expr(f"{place} div {chunk}")).withColumn("_value", value)
    before = W.partitionBy(*part).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        tagged.groupBy(*keys).agg(agg("_value").alias("_total"))
        .withColumn("_carry", agg("_total").over(before))
        .drop("_total")
    )
    frame = W.partitionBy(*keys).orderBy(order).rowsBetween(
        W.unboundedPreceding, W.currentRow if inclusive else -1
    )
    local = tagged.withColumn("_local", agg("_value").over(frame))
    return join_keyed(local, carry, keys)


def fan_out(df: DataFrame, *by) -> DataFrame:
    """Spread rows that are about to multiply over all cores.

    The number of partitions is given, because adaptive execution would otherwise merge these small
    partitions by their size before the rows multiply.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *by)


def running_sum(df: DataFrame, part: Sequence[str], order: str, value, out: str,
                inclusive: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Running sum over ``part`` in the order of the integer column ``order`` (unique per part)."""
    scanned = _scan(df, part, order, F.col(value) if isinstance(value, str) else value, out, F.sum,
                    inclusive, chunk)
    total = F.coalesce("_carry", F.lit(0)) + F.coalesce("_local", F.lit(0))
    return scanned.withColumn(out, total).drop("_chunk", "_value", "_local", "_carry")


def running_max(df: DataFrame, part: Sequence[str], order: str, value, out: str,
                inclusive: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Running maximum, null where nothing precedes."""
    scanned = _scan(df, part, order, F.col(value) if isinstance(value, str) else value, out, F.max,
                    inclusive, chunk)
    return scanned.withColumn(out, F.greatest("_carry", "_local")).drop(
        "_chunk", "_value", "_local", "_carry"
    )


def delta_decode(df: DataFrame, part: Sequence[str], order: str, value: str, modulus: int,
                 out: str = "run", chunk: int = CHUNK) -> DataFrame:
    """Undo delta coding: running sum of the deltas, modulo 256 or 65536."""
    summed = running_sum(df, part, order, F.col(value).cast("long"), out, True, chunk)
    return summed.withColumn(out, F.pmod(F.col(out), F.lit(modulus)).cast("int"))


def running_max_slope(rays: DataFrame, part: Sequence[str] = ("map_id", "observer", "ray"), order: str = "step",
                      slope: str = "slope", out: str = "max_before") -> DataFrame:
    """Largest slope of the earlier steps of a ray, -1e10 at the first one.

    A ray has a fixed number of steps, which bounds the window.
    """
    before = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rays.withColumn(out, F.coalesce(F.max(slope).over(before), F.lit(-1e10)))


def sticky_block(rays: DataFrame, part: Sequence[str] = ("map_id", "observer", "ray"), order: str = "step",
                 flag: str = "blocked", out: str = "hidden") -> DataFrame:
    """True from the first blocked step of a ray onwards."""
    upto = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rays.withColumn(out, F.max(F.coalesce(F.col(flag), F.lit(False))).over(upto))


def head_per_group(df: DataFrame, by: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """First n rows per group. The limit is applied before the shuffle as well as after it."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def first_match(df: DataFrame, keys: Sequence[str], rank: Sequence[str]) -> DataFrame:
    """The row with the lowest rank per key, reduced on the map side."""
    rest = [c for c in df.columns if c not in keys and c not in rank]
    best = F.min_by(F.struct(*rank, *rest), F.struct(*rank)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def _known_small(df: DataFrame) -> bool:
    """True where the planner's own size estimate, as rows in memory, is below its broadcast limit."""
    limit = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    try:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
        low = str(limit).lower().rstrip("b")
        unit = {"k": 1024, "m": 1024**2, "g": 1024**3}.get(low[-1], 1)
        return 0 <= size * UNPACKED <= int(low.rstrip("kmg")) * unit
    except Exception:
        return False


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast, whatever the planner takes its size for."""
    return df.hint("merge")


def join_dim(facts: DataFrame, dim: DataFrame, on: Sequence[str], spread: Sequence[str],
             how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join a large table with a dimension whose keys may be very unevenly used.

    A small dimension is left to the planner, which broadcasts it.  Otherwise the facts of one key
    are spread over ``salts`` groups by the columns ``spread`` and the dimension is repeated once per
    group, so that a key with a third of all rows still uses many tasks.  Such a dimension is never broadcast:
    the planner goes by file sizes and by the columns that are left, and doesn't see that it is repeated.
    """
    if _known_small(dim):
        return facts.join(dim, list(on), how)
    if salts <= 1:
        return facts.join(shuffled(dim), list(on), how)
    salted = facts.withColumn("_salt", F.pmod(F.hash(*spread), F.lit(salts)))
    repeated = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(shuffled(repeated), [*on, "_salt"], how).drop("_salt")


def ordinal(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "ordinal",
            parts: int | None = None) -> DataFrame:
    """1-based position within ``by`` in the order of any columns, without one task per group.

    Rows are range-partitioned and written with their partition number; positions are then counted
    per partition and shifted by the sizes of the earlier partitions of the same group.
    """
    from ..session import cut

    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *by, *order).withColumn("_chunk", F.spark_partition_id())
    placed = cut(ranged, "ordinal")
    keys = [*by, "_chunk"]
    before = W.partitionBy(*by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    shift = sizes.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return (
        join_keyed(placed.withColumn("_local", local), shift, keys)
        .withColumn(out, F.col("_local") + F.col("_shift")).drop("_chunk", "_local", "_shift")
    )
