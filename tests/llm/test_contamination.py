"""Benchmark windows in documents against a plain loop."""

import hashlib
import re

import pytest

from terralake.llm.contamination import contaminated

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, size=10):
    windows = []
    for item, t in items:
        w = words(t)
        if item is not None and w:
            n = min(size, len(w))
            windows += [(str(item), w[i:i + n]) for i in range(len(w) - n + 1)]
    out = []
    for doc, t in docs:
        w, hit, found = words(t), set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if w[i:i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(item)
        ids = ",".join(sorted(found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


P = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
ITEMS = [(1, P), (2, "One two"), (10, "solo"), (3, None), (4, ""), (5, "?!"), (None, P), (6, P.upper() + " NU"), (6, P), (7, "día ñandú über 42 日本語 x y z a b c"), (8, "the the the the the the the the the the the")]
DOCS = [
    (1, "x " + P + " y"), (2, P[:40]), (3, "ALPHA-beta.gamma delta\nepsilon zeta eta theta iota kappa! lambda"), (4, None), (5, ""), (6, "one two one two, one"), (7, "Solo solo"),
    (None, P), (1, P), (1, P), (8, "día ñandú über 42 日本語 x y z a b c"), (9, "the " * 300), (10, "alpha beta gamma " * 20), (11, P.replace("theta", "thet")), (12, "kappa lambda mu " + P * 2),
    (13, " ".join(P.split()[1:] + P.split())),
]


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_against_loop(spark, bits):
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in DOCS], "doc_id long, text string, hits string, token int")
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, words int")
    got = contaminated(docs.repartition(3), items, filter_bits=bits).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contaminated(docs.limit(0), items).collect() == []
    got = contaminated(docs, items.limit(0)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(DOCS, [])
