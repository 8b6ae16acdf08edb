"""Session defaults and the shared scratch area used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a job on a large cluster wants; every one of them may be overridden by the caller.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows with tiles or whole texts are large: batches for Python are bounded by bytes too
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def build_session(app: str = "terralake", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or fetch) a session with the library's defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Rows and bytes of a batch for Python where rows hold whole files or texts.
CONTENT_ROWS, CONTENT_BYTES = 1000, 4 * 1024 * 1024


def content_batches(spark: SparkSession) -> None:
    """Hand file contents to Python in small batches: a worker holds several copies of one, and the default of 10,000 rows is meant for rows of numbers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", CONTENT_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", CONTENT_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own: on a cluster a machine-local folder
    would lose data together with the executor that wrote it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.conf.get("spark.master", "") or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="terralake-")
    return _LOCAL[app]


_LOCAL: dict[str, str] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/terralake/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Unlike a cached frame it survives the loss of executors, and unlike a checkpointed RDD it keeps
    column statistics, so that later joins can still choose their strategy by size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
