"""Near copies against all pairs of whole shingle sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from terralake.llm.copies import near_copies, shingle_sets, signatures

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else [])


def brute(rows, percent=80):
    nodes = {}
    for i, t in rows:
        if i is not None:
            nodes.setdefault(i, set()).add(shingles(t))
    parent = {i: i for i in nodes}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    items = [(i, s) for i, sets in nodes.items() for s in sets if s]
    for x, (i, s) in enumerate(items):
        for j, t in items[:x]:
            if 100 * len(s & t) >= percent * len(s | t):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    out = []
    for i, t in rows:
        root = None if i is None else find(i)
        out.append((i, len(shingles(t)), root, i is None or root == i))
    return sorted(out, key=repr)


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 6)))
    rows = []
    for family in range(30):
        base = [word() for _ in range(rng.randrange(3, 120))]
        for copy in range(rng.choice([1, 1, 2, 3, 12])):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 15)):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows) * 7 % 1009, " ".join(own)))
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (2003, "solo"), (2004, "SOLO"), (2005, "Ärger"), (2006, "ärger"), (2007, "a b"), (2008, "A\x0bB"), (2009, "a b"),
                   (2010, rows[0][1]), (2010, rows[0][1]), (None, rows[0][1]), (None, None), (2011, "x y " * 5000)]


@pytest.mark.parametrize("small", [1000, 4])
def test_against_all_pairs(spark, small):
    rows = corpus()
    files = spark.createDataFrame([(i, t, 1) for i, t in rows], "file long, value string, cluster int").repartition(3)
    got = near_copies(files, small_cluster=small, all_pairs=64 if small > 4 else 0).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows)


def test_large_family_of_near_copies(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        own = list(base)
        own[rng.randrange(60)] = f"v{i}"
        own[rng.randrange(60)] = f"u{i}"
        rows.append((i, " ".join(own)))
    files = spark.createDataFrame(rows, "file long, value string").repartition(4)
    got = near_copies(files, small_cluster=50).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows)


def template_family(texts, seed=5):
    """Pages of one template in groups of close links; two groups are joined by one link each at J of just over 0.8, most not at all."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(120)]
    rows = []
    while len(rows) < texts:
        cut, n = rng.randrange(0, 100), rng.randrange(13, 17)
        own = template[:cut] + [f"g{len(rows)}x{i}" for i in range(n)] + template[cut + n:]
        rows.append(" ".join(own))
        if rng.random() < 0.3:  # at J 0.8 to 0.83 of the last one
            at = rng.choice([p for p in range(0, 105) if p + 14 < cut or p > cut + n] or [0])
            rows.append(" ".join(own[:at] + [f"h{len(rows)}x{i}" for i in range(12)] + own[at + 12:]))
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows))


def fast_brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    number = {}
    m = np.zeros((len(rows), len({x for s in sets for x in s})), np.float32)
    for i, s in enumerate(sets):
        for x in s:
            m[i, number.setdefault(x, len(number))] = 1
    m = m[:, m.sum(0) > 1]
    n, common = np.array([len(s) for s in sets]), m @ m.T
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = [i for i, _ in rows]
    for i, j in zip(*np.nonzero(np.triu(100 * common >= percent * (n[:, None] + n[None] - common), 1))):
        a, b = sorted((find(i), find(j)), key=lambda x: ids[x])
        parent[b] = a
    return sorted([(ids[i], len(sets[i]), ids[find(i)], find(i) == i) for i in range(len(rows))], key=repr)


def test_template_family_of_thousands(spark):
    rows = template_family(3000)
    files = spark.createDataFrame(rows, "file long, value string").repartition(4)
    got, want = sorted([tuple(r) for r in near_copies(files).collect()], key=repr), fast_brute(rows)
    assert 300 < sum(not k for *_, k in want) < 2000
    assert got == want


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    a, b = (np.concatenate([shared, rng.integers(0, 1 << 63, 100, dtype=np.uint64)]) for _ in range(2))
    s = signatures([a, b])
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.13


def test_sets_are_exact():
    texts = [t for _, t in corpus()] + ["x" * 3_000_000 + " y z"]
    assert [len(s) for s in shingle_sets(pa.array(texts, pa.string()))] == [len(shingles(t)) for t in texts]


def test_a_key_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (9, b), (8, a), (7, c), (9, c), (3, ""), (7, ""), (12, b + " more"), (20, "x y"), (21, "x y"), (21, "z"), (22, "z"), (None, a)]
    files = spark.createDataFrame(rows, "file long, value string").repartition(3)
    assert sorted([tuple(r) for r in near_copies(files).collect()], key=repr) == brute(rows)


def test_empty_table(spark):
    assert near_copies(spark.createDataFrame([], "file long, value string")).collect() == []


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_regions_in_batches_of_any_size(step):
    """Small regions give all pairs, crowded ones their rows and size, those at the ends of a partition their rows; batches may cut them anywhere."""
    from terralake.llm.copies import LEAF, SMALL, _regions

    sizes = [1, 2, SMALL, 1, SMALL + 1, 5, 1, 30, 3, 1, 2]
    rows = np.array([(0, r, 100 * r + i, 0, 0) for r, n in enumerate(sizes) for i in range(n)], np.int64)
    batches = (pa.record_batch([pa.array(rows[at:at + step, c]) for c in range(5)], LEAF) for at in range(0, len(rows), step))
    found = [r for b in _regions(batches) for r in b.to_pylist()]
    pairs = sorted((r["a"], r["b"]) for r in found if r["a"] is not None)
    inner = range(1, len(sizes) - 1)
    assert pairs == sorted((100 * r + i, 100 * r + j) for r in inner if sizes[r] <= SMALL for j in range(sizes[r]) for i in range(j))
    assert sorted((r["id"], r["n"]) for r in found if r["n"]) == [(100 * r + i, sizes[r]) for r in inner if sizes[r] > SMALL for i in range(sizes[r])]
    assert sorted(r["id"] for r in found if r["a"] is None and r["n"] is None) == [0] + [100 * (len(sizes) - 1) + i for i in range(2)]
