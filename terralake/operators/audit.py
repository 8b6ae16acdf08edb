"""Byte-range audits and build results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scans import CHUNK, join_keyed


def _reached(spans: DataFrame, chunk: int) -> DataFrame:
    """Longest span per start with ``reach``, the furthest end of all earlier ones, and ``island``, the start of the union it belongs to.

    One scan in chunks of the starts carries both: within a chunk, an island begins where a start lies beyond all ends before it in the chunk. It is an island
    of the file if it also lies beyond what earlier chunks reach, which one row per chunk tells.
    """
    longest = spans.groupBy("file", "start").agg(F.max("end").alias("end")).withColumn("_chunk", F.expr(f"start div {chunk}"))
    keys = ["file", "_chunk"]
    earlier = W.partitionBy(*keys).orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*keys).orderBy("start").rowsBetween(W.unboundedPreceding, W.currentRow)
    local = longest.withColumn("_reach", F.max("end").over(earlier))
    local = local.withColumn("_island", F.max(F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach")), F.col("start"))).over(upto))
    before = W.partitionBy("file").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = local.groupBy(*keys).agg(F.max("end").alias("_end"), F.max("_island").alias("_last")).withColumn("_carry", F.max("_end").over(before))
    fresh = F.when(F.col("_carry").isNull() | (F.col("_last") > F.col("_carry")), F.col("_last"))
    chunks = chunks.withColumn("_begun", F.max(fresh).over(before)).select(*keys, "_carry", "_begun")
    own = F.when(F.col("_carry").isNull() | (F.col("_island") > F.col("_carry")), F.col("_island"))
    return join_keyed(local, chunks, keys).select(
        "file", "start", "end", F.greatest("_carry", "_reach").alias("reach"), F.coalesce(own, "_begun").alias("island"))


def merge_intervals(spans: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Union of overlapping or touching [start, end) spans per file."""
    named = _reached(spans.filter("end > start"), chunk)
    return named.groupBy("file", F.col("island").alias("start")).agg(F.max("end").alias("end"))


def gaps(spans: DataFrame, totals: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Uncovered ranges of each file (``file, total``), with their share of it in percent."""
    inside = join_keyed(spans, totals.select("file", "total"), ["file"]).select(
        "file", "start", F.least("end", "total").alias("end")
    ).filter("end > start")
    begun = _reached(inside, chunk).select("file", F.coalesce("reach", F.lit(0)).cast("long").alias("start"), F.col("start").alias("end"))
    last = inside.groupBy("file").agg(F.max("end").alias("start"))
    tail = join_keyed(totals.select("file", "total"), last, ["file"], "left").select(
        "file", F.coalesce("start", F.lit(0)).cast("long").alias("start"), F.col("total").cast("long").alias("end")
    )
    found = begun.unionByName(tail).filter("end > start")
    return join_keyed(found, totals.select("file", "total"), ["file"]).select(
        "file", "start", "end", (F.col("end") - F.col("start")).alias("bytes"),
        F.round((F.col("end") - F.col("start")) * 100.0 / F.col("total"), 2).alias("percent"),
    )


def tag_summary(blocks: DataFrame) -> DataFrame:
    """Blocks, bytes and flag values per file and tag, with totals per file (tag null)."""
    return blocks.rollup("file", "tag").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum("len").alias("bytes"),
        F.array_sort(F.collect_set("flags")).alias("flags"),
    ).filter(F.col("file").isNotNull())


def latest_result(results: DataFrame) -> DataFrame:
    """Last build result of every map."""
    rest = [c for c in results.columns if c != "map_id"]
    order = F.struct("ts", *[c for c in ("event_id",) if c in rest])
    return results.groupBy("map_id").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("map_id", "_r.*")


def build_summary(results: DataFrame, by: list[str], total: DataFrame | None = None) -> DataFrame:
    """Completed, succeeded, failed, percent done, elapsed seconds and expected rest per run.

    ``total`` (run columns and ``total``) gives the planned number of maps; without it all are done.
    """
    done = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("completed"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"),
        F.sum("seconds").alias("elapsed"),
    )
    joined = done.withColumn("total", F.col("completed")) if total is None else total.join(done, by, "left").fillna(
        0, ["completed", "succeeded", "failed"]
    )
    percent = F.when(F.col("total") > 0, F.col("completed") * 100.0 / F.col("total")).otherwise(0.0)
    eta = F.when(
        F.col("completed") > 0, F.col("elapsed") / F.col("completed") * (F.col("total") - F.col("completed"))
    )
    return joined.withColumn("percent", percent).withColumn("eta", eta)


def failure_report(results: DataFrame, lines: int = 3) -> DataFrame:
    """Failed maps with the first lines of their error text."""
    parts = F.split("error", "\n")
    more = F.size(parts) - lines
    shown = F.slice(parts, 1, lines)
    full = F.when(more > 0, F.concat(shown, F.array(F.concat(F.lit("... ("), more.cast("string"), F.lit(" more lines)"))))).otherwise(shown)
    return results.filter(~F.col("ok")).withColumn("error_lines", full)
