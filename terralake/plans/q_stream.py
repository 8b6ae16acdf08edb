"""Streaming jobs, driven to completion over the given tables."""

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import jobs
from .base import query, table, view


def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query("stream_index", """
WITH e AS (SELECT *, event_type || '_' || user_id AS name, event_id % 3 AS part FROM events)
SELECT name, CAST(row_number() OVER (ORDER BY min(part), name) AS BIGINT) AS pos, arg_max(value, part * 1000000000 + event_id) AS value FROM e GROUP BY name""")
def stream_index(spark, sf):
    """Three files arrive one after the other, hence three batches."""
    source = scratch_path(spark, "arriving")
    events = table(spark, sf, "events").withColumn("name", F.concat_ws("_", "event_type", F.col("user_id").cast("string")))
    for part in range(3):
        rows = events.filter(F.col("event_id") % 3 == part).select("name", F.col("event_id").alias("seq"), "value")
        rows.coalesce(1).write.mode("append").parquet(source)
    path = scratch_path(spark, "index")
    entries = spark.readStream.schema("name string, seq long, value double").option("maxFilesPerTrigger", 1).parquet(source)
    jobs.stream_index(entries, path, scratch_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return jobs.read_index(spark, path).select("name", "pos", "value")


@query("stream_keyed_index", """
WITH e AS (SELECT *, event_type || '_' || user_id AS name, event_id % 3 AS part FROM events)
SELECT name, CAST(row_number() OVER (ORDER BY min(part), name) AS BIGINT) AS pos, arg_max(value, event_id) AS value FROM e GROUP BY name""")
def stream_keyed_index(spark, sf):
    """Three batches out of order, the last of them with all entries of the first once more."""
    source, path = scratch_path(spark, "arriving"), scratch_path(spark, "index")
    events = table(spark, sf, "events").withColumn("name", F.concat_ws("_", "event_type", F.col("user_id").cast("string")))
    for parts in ([0], [1], [2, 0]):
        rows = events.filter((F.col("event_id") % 3).isin(parts)).select("name", F.col("event_id").alias("seq"), "value")
        rows.coalesce(1).write.mode("append").parquet(source)
    before = spark.conf.get(jobs.STATE_STORE[0])
    spark.conf.set(*jobs.STATE_STORE)
    entries = spark.readStream.schema("name string, seq long, value double").option("maxFilesPerTrigger", 1).parquet(source)
    jobs.stream_keyed_index(entries, path, scratch_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    spark.conf.set(jobs.STATE_STORE[0], before)
    return jobs.read_keyed_index(spark, path).select("name", "pos", "value")


@query("stream_progress", """
SELECT event_id % 20 AS run, date_trunc('hour', ts) AS started, count(*) AS completed, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed
FROM events GROUP BY ALL""")
def stream_progress(spark, sf):
    source = _stream(spark, sf, "events").select(
        (F.col("event_id") % 20).alias("run"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok")
    )
    out = scratch_path(spark, "progress")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    counts = jobs.stream_progress(source, "1 hour", "2 hours")
    writer = counts.writeStream.outputMode("update").option("checkpointLocation", scratch_path(spark, "stream")).foreachBatch(keep)
    writer.trigger(availableNow=True).start().awaitTermination()
    values = F.struct("completed", "succeeded", "failed")
    last = spark.read.parquet(out).groupBy("run", "window").agg(F.max_by(values, "b").alias("_v"))
    return last.select("run", F.col("window.start").cast("timestamp_ntz").alias("started"), "_v.*")


@query("build_progress", """
SELECT run, count(*) AS completed, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed FROM fx_builds GROUP BY run""")
def build_progress(spark, sf):
    return jobs.stream_progress(view(spark, sf, "fx_builds"))
