"""Structured Streaming: index upkeep and build progress."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.catalog import upsert_index

VERSION, WHOLE = "v", "whole"
COMPACT_EVERY = 16
#: Setting and class of the state store that keyed state needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_index(spark: SparkSession, path: str, before: int | None = None, key: str = "name") -> DataFrame | None:
    """Latest entries of a versioned index (or those before a given version); None where nothing is written yet.

    A version holds the entries that its batch changed, or the whole index; only versions from the last whole one on are read.
    """
    try:
        table = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":  # any other failure must not restart the index
            raise
        return None
    if before is not None:
        table = table.filter(F.col(VERSION) < before)
    first, last = table.agg(F.max(F.when(F.col(WHOLE) == 1, F.col(VERSION))), F.max(VERSION)).first()
    if last is None:
        return None
    values = [c for c in table.columns if c not in (key, VERSION, WHOLE)]
    recent = table.filter(F.col(VERSION) >= first) if first is not None else table
    return recent.groupBy(key).agg(F.max_by(F.struct(*values), VERSION).alias("_e")).select(key, "_e.*")


def apply_batch(batch: DataFrame, batch_id: int, path: str, key: str = "name", compact_every: int = COMPACT_EVERY) -> None:
    """Merge a batch of entries into the index as version ``batch_id``.

    Only changed entries are written, and the whole index in every ``compact_every``-th version. A repeated batch starts from
    the versions before it and overwrites its own output, so delivering it again changes nothing. Of several entries with the
    same key the latest (``seq``) counts. An index belongs to one checkpoint: versions are its batch numbers.
    """
    spark = batch.sparkSession
    values = [c for c in batch.columns if c not in (key, "seq")]
    newest = batch.groupBy(key).agg(F.max_by(F.struct(*values), "seq").alias("_e")).select(key, "_e.*")
    current = read_index(spark, path, batch_id, key)
    if current is None:
        current = newest.limit(0).withColumn("pos", F.lit(0).cast("long"))
    merged = upsert_index(current, newest, key)
    whole = int(batch_id % compact_every == 0)
    if not whole:
        merged = merged.join(newest.select(key), key, "left_semi")
    merged.write.mode("overwrite").parquet(f"{path}/{VERSION}={batch_id}/{WHOLE}={whole}")


def stream_index(stream: DataFrame, index_path: str, checkpoint: str, key: str = "name"):
    """Keep the index up to date with arriving manifests; returns the writer, ready to start."""
    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: apply_batch(batch, batch_id, index_path, key))
    )


class LatestEntry(StatefulProcessor):
    """Keeps the highest sequence number of a key and passes on the entries that raise it. Entries come as rows: a frame for each key costs more than its work."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "seq long")

    def handleInputRows(self, key, rows, timerValues):
        best = max(rows, key=lambda row: row["seq"])
        old = self.latest.get()
        if old is None or best["seq"] > old[0]:
            self.latest.update((best["seq"],))
            yield Row(**best.asDict(), fresh=old is None)

    def close(self) -> None:
        pass


def stream_keyed_index(stream: DataFrame, index_path: str, checkpoint: str, key: str = "name"):
    """Keep an index up to date with entries that may come late, twice or out of order; returns the writer, ready to start.

    State by key holds the latest ``seq``: an entry with a lower one, or one seen before, changes nothing, in whichever batch it comes. A batch writes
    what it changes as a version of its own and reads nothing back, so its cost doesn't follow the size of the index. ``read_keyed_index`` puts
    versions together. Entries without ``seq`` are left out: they have no place in the order. The session needs the RocksDB state store (``STATE_STORE``).
    """
    kinds = dict(stream.dtypes)
    changed = (
        stream.filter(F.col("seq").isNotNull()).groupBy(key).transformWithState(
            statefulProcessor=LatestEntry(), outputStructType=", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", fresh boolean",
            outputMode="Update", timeMode="None")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{index_path}/{VERSION}={batch_id}")

    return changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)


def read_keyed_index(spark: SparkSession, path: str, key: str = "name") -> DataFrame:
    """Latest entry of every key of a keyed index, with ``pos``: keys count in the order of the batch that brought them, then by name."""
    from ..operators.scans import ordinal

    table = spark.read.parquet(path)
    values = [c for c in table.columns if c not in (key, VERSION, "fresh")]
    entries = table.groupBy(key).agg(F.max_by(F.struct(*values), "seq").alias("_e"), F.min(VERSION).alias("_first")).select(key, "_e.*", "_first")
    return ordinal(entries.withColumn("_all", F.lit(0)), ["_all"], ["_first", key], "pos").drop("_all", "_first")


def stream_progress(stream: DataFrame, window: str | None = None, watermark: str | None = None,
                    by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Running completed, succeeded and failed counts per run, optionally per time window.

    The same expression serves batch and stream; with a watermark finished windows leave the state.
    """
    source = stream.withWatermark("ts", watermark) if watermark and stream.isStreaming else stream
    keys = ([F.window("ts", window).alias("window")] if window else []) + [F.col(c) for c in by]
    return source.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("completed"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed")
    )
