"""Toxic spans: marginals against all label strings, held-out accuracy, offsets, odd rows."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terralake.llm.toxicity import BLOCK, forward_backward, label_words, tag_toxic, toxicity_sample, train_toxicity, word_keys, words_of

CLEAN = "capture the northern airfield before dawn and hold zone alpha while convoy tanks move across river valley hills".split()
BAD = ["blithering", "blitherer", "numpty", "numpties", "nincompoop"]


def missions(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words, toxic = rng.choices(CLEAN, k=rng.randint(4, 40)), int(rng.random() < 0.3)
        for _ in range(3 if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(BAD))
        rows.append((f"mission_{i}", " ".join(words).capitalize() + ".", toxic))
    return rows


@pytest.fixture(scope="module")
def model():
    return train_toxicity(pd.DataFrame(missions(600, 1), columns=["mission", "text", "toxic"])[["text", "toxic"]])


def test_marginals_of_all_label_strings():
    rng = np.random.default_rng(5)
    model = {"move": rng.normal(size=(2, 2)), "first": rng.normal(size=2)}
    score, first = rng.normal(size=9) * 3, np.array([0, 4, 4, 5])
    toxic, pairs = forward_backward(score, first, model)
    want, want_pairs, total = np.zeros(9), np.zeros((2, 2)), 0
    for y in itertools.product((0, 1), repeat=9):
        w = sum(score[i] * y[i] for i in range(9)) + sum(model["first"][y[i]] for i in (0, 4, 5))
        w = math.exp(w + sum(model["move"][y[i - 1], y[i]] for i in range(1, 9) if i not in (4, 5)))
        total += w
        want += w * np.array(y)
        for i in range(1, 9):
            if i not in (4, 5):
                want_pairs[y[i - 1], y[i]] += w
    assert np.allclose(toxic, want / total) and np.allclose(pairs, want_pairs / total)


def test_blocks_agree_with_one_text_at_a_time():
    rng = np.random.default_rng(6)
    model = {"move": rng.normal(size=(2, 2)), "first": rng.normal(size=2)}
    sizes = [1, 0, BLOCK, 3 * BLOCK + 5, 2]
    first = np.cumsum([0, *sizes])
    score = rng.normal(size=first[-1]) * 40
    whole, _ = forward_backward(score, first[:-1], model)
    parts = [forward_backward(score[a:b], np.zeros(1, int), model)[0] for a, b in zip(first, first[1:])]
    assert np.allclose(whole, np.concatenate(parts)) and np.isfinite(whole).all()


def test_copies_of_a_text_make_no_labels():
    texts = ["quite harmless words stand here"] * 30 + [f"you are a numpty {w} {v}" for w in CLEAN for v in "abc"] + [f"plain {w} {v} talk" for w in CLEAN for v in CLEAN]
    toxic = np.array([1.0] * (30 + 3 * len(CLEAN)) + [0.0] * len(CLEAN) ** 2)
    data, starts, ends, first = words_of(pa.array(texts))
    found = label_words(word_keys(data, starts, ends, first), first, toxic)
    words = {data[s:e].tobytes().decode() for s, e in zip(starts[found], ends[found])}
    assert "numpty" in words and not words & {"quite", "harmless", "words", "stand", "here"}


def test_held_out_accuracy_and_offsets(spark, model):
    rows = missions(300, 2)
    table = spark.createDataFrame(rows, "mission string, label string, toxic int").withColumn("score", F.lit("clash")).withColumn("key", F.lit(1))
    got = {r["mission"]: r for r in tag_toxic(table, model).collect()}
    assert sum(got[m]["predicted"] == y for m, _, y in rows) >= 0.98 * len(rows)
    for m, text, y in rows:
        r = got[m]
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["n_words"] == len(text.split())
        named = [text[slice(*map(int, s.split(":")))] for s in r["spans"].split(",") if s]
        assert all(w.lower() in BAD for span in named for w in span.split())
        assert y == 0 or len(" ".join(named).split()) >= 2


def test_code_points_and_long_texts(spark, model):
    text = "Größe \U0001F600 – you numpty! " + "zone alpha " * 50_000 + "NUMPTY"
    r = tag_toxic(spark.createDataFrame([("m", text)], "mission string, label string"), model).first()
    spans = [tuple(map(int, s.split(":"))) for s in r["spans"].split(",")]
    assert [text[s:e].lower() for s, e in spans] == ["numpty", "numpty"] and spans[-1][1] == len(text)


def test_null_empty_repeated_and_no_rows(spark, model):
    schema = "mission string, label string"
    rows = tag_toxic(spark.createDataFrame([(None, None), ("a", ""), ("b", " .,"), ("c", "numpty"), ("c", "numpty")], schema), model).collect()
    assert [(r["n_words"], r["spans"], r["predicted"]) for r in rows[:3]] == [(0, "", 0)] * 3 and rows[3] == rows[4]
    assert tag_toxic(spark.createDataFrame([], schema), model).collect() == []


def test_samples_are_bounded_and_labels_may_be_missing(spark):
    table = spark.createDataFrame([(f"m{i}", f"word{i}") for i in range(50)] + [("m1", None)], "mission string, label string")
    verdicts = spark.createDataFrame([(f"m{i}", i % 2) for i in range(40)] + [(None, 1), ("m41", None)], "mission string, toxic int")
    few, again = (toxicity_sample(t, verdicts, most=10) for t in (table, table.repartition(7)))
    assert len(few) == 10 and few.equals(again)
    for rows in ([], [("x", 0)], [("x", 1)]):
        model = train_toxicity(pd.DataFrame(rows, columns=["text", "toxic"]))
        r = tag_toxic(table.limit(1), model).first()
        assert r["predicted"] == (rows == [("x", 1)])
