"""Quality: held-out accuracy, shrinkage and edges."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terralake.llm.quality import N_FEATURES, feature_bins, fit_quality, judge_quality, site_priors, text_features


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/labels.parquet")
    bins = docs.select("doc_id", "source", "lang", feature_bins("text").alias("bins"))
    odd = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    evidence, priors = fit_quality(bins, labels.filter(~odd), host="source", path="lang")
    judged = judge_quality(bins, evidence, priors, host="source", path="lang").select("doc_id", "keep")
    held = judged.join(labels.filter(odd).select("doc_id", "quality"), "doc_id").toPandas()
    good = held["quality"] == 1
    assert len(held) > 80
    assert (held["keep"] == good).mean() > 0.95
    assert held.loc[good, "keep"].mean() > 0.97


def test_sparse_sites_are_shrunk(spark):
    rows = [("big", "a", 1.0)] * 400 + [("big", "b", 0.0)] * 400 + [("bad", "a", 0.0)] * 300 + [("bad", "b", 0.0)] * 300 + [("one", "a", 0.0), ("two", None, 1.0), (None, None, 0.0), ("big", "c", 0.0)]
    table = spark.createDataFrame(rows, "host string, path string, share double")
    got = {(r["host"], r["path"]): r["site_prior"] for r in site_priors(table, 0.3).collect()}
    assert got[("big", "a")] > 0.9 and got[("big", "b")] < 0.1 and got[("bad", "a")] < 0.1
    assert 0.1 < got[("big", "c")] < 0.5  # one row can't outweigh its host
    assert got[("one", "a")] > 0.02 and got[("two", None)] < 0.9 and (None, None) in got
    assert len(got) == 8


def test_features_of_odd_texts():
    got = text_features(pa.array([None, "", "a", "\n", "é" * 10, "x" * 3_000_000], pa.string()))
    assert got.shape == (6, N_FEATURES) and (got >= 0).all() and (got < 32).all()
    assert (got[0] == got[1]).all()
    assert text_features(pa.array([], pa.string())).shape == (0, N_FEATURES)


def test_without_labels_and_with_nulls(spark):
    docs = spark.createDataFrame(
        [(1, "one two", "h", "p", "x"), (None, None, None, None, "x"), (1, "one two", "h", "p", "x"), (2, "", "h", None, "x")],
        "doc_id long, text string, host string, path string, keep string")
    bins = docs.withColumn("bins", feature_bins("text"))
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, quality int")
    for known in (labels, labels.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int")):
        evidence, priors = fit_quality(bins, known)
        judged = judge_quality(bins, evidence, priors).collect()
        assert len(judged) == 4 and all(0 < r["quality"] < 1 and r["keep"] is not None for r in judged)
    evidence, priors = fit_quality(bins.limit(0), labels)
    assert judge_quality(bins.limit(0), evidence, priors).collect() == []


def test_columns_with_inner_names_and_counted_rows(spark):
    """A text copied many times weighs as much as its rows, whatever the bound on distinct rows; inner names of columns are free."""
    texts = [("good words of a calm text here", 1)] * 60 + [("good words of a calm text here", 0)] * 20 + [("!!! $$$ 1", 0)] * 40 + [("another fine text of words", 1)] * 40
    docs = spark.createDataFrame([(i, t, "h", "p", 1, 2, 3) for i, (t, _) in enumerate(texts)], "doc_id long, text string, host string, path string, _host int, _prior int, _evidence int")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, quality int")
    bins = docs.withColumn("bins", feature_bins("text"))
    evidence, priors = fit_quality(bins, labels)
    judged = {r["doc_id"]: r for r in judge_quality(bins, evidence, priors).collect()}
    assert judged[0]["quality"] > 0.5 > judged[90]["quality"] and (judged[0]["_host"], judged[0]["_prior"], judged[0]["_evidence"]) == (1, 2, 3)
