"""From documents to packed training sequences: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralake.llm.contamination import contaminated
from terralake.llm.copies import near_copies
from terralake.llm.filters import listed, without
from terralake.llm.packing import pack_texts
from terralake.llm.personal import label_runs, redact_personal, train_crf
from terralake.llm.quality import feature_bins, fit_quality, judge_quality
from terralake.llm.queries import tokenizer_path
from terralake.llm.tables import fresh, read, text_batches
from terralake.session import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it is fitted on ``labels``, its site priors on all documents."""
    text_batches(spark)
    bins = cut(docs.select("doc_id", "source", "lang", feature_bins("text").alias("bins")), "features")
    evidence, priors = fit_quality(bins, read(spark, sf_dir, "labels"), host="source", path="lang")
    judged = judge_quality(docs, evidence, cut(priors, "priors"), host="source", path="lang", text="text")
    return judged.filter("keep").select(docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Rows that share an id are one document."""
    text_batches(spark)
    classes = cut(near_copies(docs, key="doc_id", text="text"), "classes")
    kept = without(docs, classes.filter("NOT kept").select("doc_id"), "doc_id")
    repeated = cut(classes.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    token = F.xxhash64("doc_id")
    maybe = listed(repeated.select(token.alias("token")), token) & F.col("doc_id").isNotNull()
    return kept.filter(~maybe).unionByName(kept.filter(maybe).dropDuplicates(["doc_id"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Texts decide, so documents are compared by a digest of their text."""
    text_batches(spark)
    digest = fresh("_text", docs)
    keyed = docs.withColumn(digest, F.md5(F.coalesce("text", F.lit(""))))
    found = contaminated(keyed.select(digest, "text"), read(spark, sf_dir, "benchmark"), key=digest)
    return without(keyed, cut(found.filter("contaminated").select(digest).distinct(), "contaminated"), digest).drop(digest)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars`` counted anew."""
    text_batches(spark)
    redacted = redact_personal(docs, train_crf(label_runs(docs, "text").toPandas()), "text")
    length = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
    return redacted.withColumn("n_chars", length.cast("long")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    text_batches(spark)
    return pack_texts(docs, tokenizer_path(), key="doc_id", text="text")


STAGES = [("quality", quality), ("dedup", dedup), ("decontaminate", decontaminate), ("personal", personal), ("packing", packing)]

#: Neither the classifier nor the tokenizer can be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
