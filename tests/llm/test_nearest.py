"""Exact search against a loop over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terralake.llm.nearest import Tree, highest_products
import numpy as np

SCHEMA = "entry_idx long, features array<float>, score string, v int"


def brute(rows, asked, k):
    vectors = sorted((i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v))
    out = []
    for i, q in sorted({*vectors}):
        if asked(i):
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,block_rows,leaf", [(1 << 14, 1 << 11, 128), (40, 3, 4)])
def test_against_all_pairs(spark, shard_rows, block_rows, leaf):
    rng = random.Random(7)
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(rng.gauss(0, 0.3)) for _ in range(6)]) for i in range(150)]
    rows += [(i, [0.5] * 6) for i in range(150, 220)]  # one very common vector: ties everywhere
    rows += [(220, None), (221, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (222, [float("nan")] * 6), (223, [float("inf")] + [0.0] * 5), (None, [0.5] * 6), (224, [0.25, -0.25]), (225, [0.25, 0.5]),
             (226, []), (150, [0.5] * 6), (5, rows[5][1]), (230, [2000000.0] * 6), (240, [-3.5] * 6)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = highest_products(table, F.col("entry_idx") % 5 == 0, k=4, shard_rows=shard_rows, block_rows=block_rows, leaf=leaf).collect()
    assert sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in got) == brute(rows, lambda i: i % 5 == 0, 4)


def test_few_or_no_rows(spark):
    table = spark.createDataFrame([(0, [1.0], "", 1), (1, [2.0], "", 1)], SCHEMA)
    assert [tuple(r) for r in highest_products(table, F.col("entry_idx") == 0).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert highest_products(table, F.lit(False)).collect() == []
    assert highest_products(table.limit(0), F.lit(True)).collect() == []


def test_boxes_are_tight_and_bounds_hold():
    rng = np.random.default_rng(5)
    vectors = rng.integers(-1000, 1000, (500, 4)).astype(float)
    tree = Tree(np.arange(500), vectors, leaf=16)
    for node, (start, end) in enumerate(tree.span):
        own = tree.vectors[start:end]
        assert (own.min(axis=0) == tree.low[node]).all() and (own.max(axis=0) == tree.high[node]).all()
        q = rng.integers(-1000, 1000, 4)
        assert tree.reach(q, [node])[0] >= (own @ q).max()
