"""Personal data: patterns against plain regular expressions, the field against held-out labels."""

import hashlib
import re
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terralake.llm.personal import KINDS, LABELS, find_personal, label_runs, luhn, pattern_spans, redact_personal, runs, token_features, train_crf, viterbi

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="aZ09.@+-() 1é\n", max_size=40))
def test_patterns(text):
    assert pattern_spans(text) == plain_spans(text)


def test_patterns_on_whole_numbers():
    text = "x 4111 1111 1111 1111 y +1 (017) 555-7713, a.b@c-d.example.org. 001.2.3.4.5.6.7.8 1.2.3.256 " + "9" * 5000 + " " + "a" * 200000 + "@" + "." * 1000
    assert pattern_spans(text) == plain_spans(text)
    assert [k for *_, k in pattern_spans(text)] == ["card", "phone", "email", "ip", "ip"]


def rows(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        kind = i % 6
        value = [
            "%d.%d.%d.%d" % tuple(rng.randrange(256) for _ in range(4)), "user%d@mail%d.example.com" % (rng.randrange(99), rng.randrange(9)),
            "+1 (%03d) 555-%04d" % (rng.randrange(1000), rng.randrange(10000)), "build %d of %d" % (rng.randrange(99), rng.randrange(99)),
            "version %d.%d" % (rng.randrange(9), rng.randrange(9)), "token %016x" % rng.getrandbits(64),
        ][kind]
        out.append((i, f"level failed {value} while reading the raster."))
    return out


def test_field_learns_held_out_runs(spark):
    errors = spark.createDataFrame(rows(600, 1), "map_id long, error string")
    model = train_crf(label_runs(errors).toPandas())
    right = total = 0
    for _, text in rows(300, 2):
        spans = pattern_spans(text)
        for before, words in runs(text):
            tags = viterbi(model, [np.array(token_features(before, [text[s:e] for s, e in words]))])[0]
            for (s, e), tag in zip(words, tags):
                want = next((k for a, b, k in spans if s < b and a < e), "O")
                right += LABELS[tag].split("-")[-1] == want
                total += 1
    assert right / total > 0.98


def test_field_adds_what_patterns_miss(spark):
    texts = rows(600, 3)
    model = train_crf(label_runs(spark.createDataFrame(texts, "map_id long, error string")).toPandas())
    errors = spark.createDataFrame([(1, "level failed (017) 555-7713 while"), (2, "build 7 of 9")], "map_id long, error string")
    got = {r["map_id"]: r for r in find_personal(errors, model).collect()}
    assert got[1]["n_phone"] == 0 and got[1]["n_added"] == 1 and got[1]["spans"].startswith("phone:13:")
    assert got[2]["spans"] == ""
    shown = {r["map_id"]: r["error"] for r in redact_personal(errors, model).collect()}
    assert "<phone>" in shown[1] and "555" not in shown[1] and shown[2] == "build 7 of 9"


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    model = {"emit": rng.normal(size=(1 << 13, len(LABELS))), "move": rng.normal(size=(len(LABELS),) * 2), "first": rng.normal(size=len(LABELS))}
    features = [rng.integers(0, 1 << 13, (n, 9)) for n in (1, 3, 3, 4)]
    import itertools
    for f, got in zip(features, viterbi(model, features)):
        emit = model["emit"][f].sum(axis=1)
        score = lambda p: model["first"][p[0]] + sum(emit[i, y] for i, y in enumerate(p)) + sum(model["move"][a, b] for a, b in zip(p, p[1:]))
        assert score(got) == pytest.approx(max(score(p) for p in itertools.product(range(len(LABELS)), repeat=len(f))))


def test_edges(spark):
    model = train_crf(pd.DataFrame(columns=["before", "words", "tags"]))
    texts = [(1, None, "a"), (2, "", "b"), (None, "mail a@b.cc", "c"), (3, "a@b.cc", "d"), (3, "a@b.cc", "d"), (4, "\U0001f600 a@b.cc", "e")]
    errors = spark.createDataFrame(texts, "map_id long, error string, spans string")
    got = find_personal(errors, model).collect()
    assert sorted((r["map_id"] or 0, r["n_email"], r["spans"]) for r in got) == [
        (0, 1, "email:5:11"), (1, 0, ""), (2, 0, ""), (3, 1, "email:0:6"), (3, 1, "email:0:6"), (4, 1, "email:2:8")
    ]
    assert next(r["base_sha256"] for r in got if r["map_id"] == 2) == hashlib.sha256(b"").hexdigest()
    assert find_personal(errors.limit(0), model).collect() == []
    assert redact_personal(errors, model).columns == errors.columns
    assert next(r["error"] for r in redact_personal(errors, model).collect() if r["map_id"] == 1) is None
