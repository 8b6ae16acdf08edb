"""Repeated bytes against a count of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from terralake.llm import repeats
from terralake.llm.repeats import remove_repeats, repeated_windows


def brute(rows, length):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[s:s + length] for _, b in bodies for s in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s:s + length]] > 1:
                gone[s:s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (not p or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefgé 日") for _ in range(n))
    passage, other = noise(300), noise(260)
    rows = [(i, noise(rng.randrange(0, 400)) + passage + noise(rng.randrange(0, 300))) for i in range(12)]
    rows += [(20 + i, noise(150) + passage[i * 9:i * 9 + 210] + noise(90)) for i in range(9)]
    rows += [(40, other), (41, other), (41, other), (42, "x" + other), (43, "a" * 900), (44, None), (45, ""), (None, noise(50) + other[:205]), (46, "ab" * 300), (47, noise(199)), (48, noise(700))]
    rows += [(49, passage[:250] * 3)]
    return rows


@pytest.mark.parametrize("pieces", [4000, 2])
def test_against_count(spark, monkeypatch, pieces):
    whole = repeats.repeated_spans
    monkeypatch.setattr(repeats, "repeated_spans", lambda k, n=200, **more: whole(k, n, block_pieces=pieces, **more))
    rows = corpus()
    files = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "file long, body string, k1 int, spans string").repartition(3)
    got = remove_repeats(files).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, 200)


def test_long_text_in_blocks(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_200_000))
    rows = [(1, long), (2, "zz" + long[1_043_000:1_049_500] + "yy"), (3, long[:199])]
    got = {r["file"]: (r["n_removed"], r["n_spans"]) for r in remove_repeats(spark.createDataFrame(rows, "file long, body string")).collect()}
    assert got == {1: (6500, 1), 2: (6500, 1), 3: (0, 0)}


def test_columns():
    rng = np.random.default_rng(4)
    grams = bytes(rng.integers(97, 100, 32, dtype=np.uint8))
    pieces, ahead = [], []
    for _ in range(60):
        left, right = int(rng.integers(0, 20)), int(rng.integers(8, 20))
        pieces.append(bytes(rng.integers(97, 99, left, dtype=np.uint8)) + grams + bytes(rng.integers(97, 99, right, dtype=np.uint8)))
        ahead.append(left)
    ahead = np.minimum(np.array(ahead), 40 - 32)
    pieces = [p[len(p) - len(p):] for p in pieces]
    pieces = [p[max(0, p.index(grams) - 8):] for p in pieces]
    ahead = np.array([p.index(grams) for p in pieces])
    got = repeated_windows(pieces, ahead, 40)
    where = Counter((s - a, p[s:s + 40]) for p, a in zip(pieces, ahead) for s in range(len(p) - 39))
    for p, a, flags in zip(pieces, ahead, got):
        assert flags.tolist() == [where[(s - a, p[s:s + 40])] > 1 for s in range(len(p) - 39)]


def test_texts_and_empty_table(spark):
    files = spark.createDataFrame([(1, "q" * 250), (2, "ok")], "file long, body string")
    assert {r["file"]: r["kept"] for r in remove_repeats(files, texts=True).collect()} == {1: "", 2: "ok"}
    assert remove_repeats(files.limit(0)).collect() == []


def test_keys_with_inner_names(spark):
    for name in ("text", "k1", "key", "body"):
        got = remove_repeats(spark.createDataFrame([(5, "short"), (6, None)], f"{name} long, value string"), key=name, content="value").collect()
        assert sorted((r[name], r["n_bytes"]) for r in got) == [(5, 5), (6, 0)]
