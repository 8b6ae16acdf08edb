"""Aligned tokens against plain encoders and a walk over all byte offsets."""

import collections
import random
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))

from terralake.llm.alignment import GROUPS, ByteLevel, Pieces, _align, align_ends, align_tokens, link_counts, merge_piece, score_links, splits

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """The tokenizers as their libraries give them."""

    def __init__(self):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer, decoders

        self.a, self.b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        assert decoders

    def tokens(self, text):
        first = [(i, bytes(self.letters[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        second = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            second.append((i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()))
        return first, second

    def groups(self, text):
        """Groups as lists of A and B ids; none where the bytes differ."""
        if not text:
            return [], 0, 0
        first, second = self.tokens(text)
        said = (" " + text).encode()
        if b"".join(t for _, t in first) != said or b"".join(t for _, t in second) != said:
            return [], 0, 0
        ends = [np.cumsum([len(t) for _, t in side]).tolist() for side in (first, second)]
        out, i, j = [], 0, 0
        for end in sorted({*ends[0]} & {*ends[1]}):
            p, q = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            out.append(([x for x, _ in first[i:p]], [x for x, _ in second[j:q]]))
            i, j = p, q
        return out, len(first), len(second)


def brute(rows):
    """``key: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)`` for rows with distinct keys."""
    plain = Plain()
    found = {k: plain.groups(t) for k, t in rows}
    links = {k: collections.Counter((a[-1], b[-1]) for a, b in g) for k, (g, _, _) in found.items()}
    counts = sum(links.values(), collections.Counter())
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = {}
    for k, (g, n_a, n_b) in found.items():
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out[k] = (n_a, n_b, len(g), len(g), sum(n for p, n in links[k].items() if counts[p] == best[p[1]]),
                  sum(n * counts[p] for p, n in links[k].items()), text)
    return out


TEXTS = [
    "Landing zone at 12.5 km, don't.", "", None, "  double  spaces ", "line\n\nbreaks\ttabs\r\n", "<|endoftext|> </s> <0x41> <unk>", "é ﬁ ▁  x",
    "\U0001F600‍\U0001F680 漢字 да ß", "x" * 3000, " ", "a" + " " * 300 + "b", "\x00\x01 ﻿", "Landing zone at 12.5 km, don't.",
]


@pytest.mark.parametrize("work", [1, 2, 3, 7, 1 << 16])
def test_pieces_of_any_size(work):
    rng = np.random.default_rng(work)
    for n in (1, 2, 30):
        ends = [np.unique(np.append(rng.integers(1, 60, n), 60)) for _ in range(2)]
        last_a, last_b, overlaps = align_ends(*ends, work)
        both = np.intersect1d(*ends)
        assert ends[0][last_a].tolist() == both.tolist() == ends[1][last_b].tolist()
        starts = [np.append(0, e[:-1]) for e in ends]
        want = [i for i in range(len(ends[0])) for j in range(len(ends[1])) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]]
        assert overlaps.tolist() == want
        at_a, at_b = splits(*ends, work)
        assert (np.diff(at_a) + np.diff(at_b)).max() <= work + 1 and at_a[-1] == len(ends[0]) and at_b[-1] == len(ends[1])
        assert sum(len(merge_piece(*ends, (at_a[i], at_a[i + 1]), (at_b[i], at_b[i + 1]))[0]) for i in range(len(at_a) - 1)) == len(want)


def test_odd_texts():
    plain, first, second = Plain(), ByteLevel(A), Pieces(B)
    sizes = tuple(np.array([len(x) for x in t.bytes], np.int64) for t in (first, second))
    for work in (5, 1 << 16):
        columns = [c.to_pylist() for c in _align(pa.array(TEXTS), first, second, sizes, work)]
        for text, n_a, n_b, n_groups, n_overlaps, groups, links in zip(TEXTS, *columns):
            want, want_a, want_b = plain.groups(text)
            assert (n_a, n_b, n_groups) == (want_a, want_b, len(want)), text
            assert groups == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)
            assert {x["pair"]: x["times"] for x in links} == collections.Counter(a[-1] << 32 | b[-1] for a, b in want)
            # each new overlap starts where one of two tokens ends
            assert n_overlaps == (n_a + n_b - n_groups if n_a else 0)


def test_mission_files(spark):
    """Counts over all files; extra columns with the names of results don't matter."""
    rng = random.Random(3)
    words = ["spawn", "zone", "capture_area", "t1", "hardcore", "Unité", "1500.0", "Straße", "\n"]
    rows = [(f"m{i}", " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(40)] + [("null", None)]
    from pyspark.sql import functions as F

    files = spark.createDataFrame(rows, "file string, value string").withColumn("links", F.lit(1)).withColumn("key", F.lit("x"))
    aligned = align_tokens(files, A, B).withColumn("row", F.col("file"))
    scored = score_links(aligned, link_counts(aligned), "row").withColumnRenamed("row", "file")
    got = {r["file"]: r for r in aligned.join(scored, "file", "left").collect()}
    for key, want in brute(rows).items():
        r = got[key]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"] or 0, r["n_best"] or 0, r["count_sum"] or 0, r["groups"]) == want


def test_empty_repeated_and_null_keys(spark):
    empty = spark.createDataFrame([], "file string, value string")
    assert align_tokens(empty, A, B).collect() == [] and align_tokens(empty, A, B).columns == ["file", *(c.split()[0] for c in GROUPS.split(", "))]
    rows = [(None, "one two"), (None, "one two"), ("x", "word " * 100_000)]
    got = align_tokens(spark.createDataFrame(rows, "file string, value string"), A, B).collect()
    assert sorted(r["n_groups"] for r in got)[:2] == [2, 2] and max(r["n_a"] for r in got) > 100_000


def test_links_are_not_shuffled(spark):
    """Pair counts are bounded by the vocabularies: they go to the links, whose number is that of all tokens, not the other way round."""
    from pyspark.sql import functions as F

    links = spark.range(50).select("id", F.array(F.struct((F.col("id") % 3).alias("pair"), F.lit(2).cast("long").alias("times"))).alias("links"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = score_links(links, link_counts(links), "id")
        assert "SortMergeJoin" not in scored._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in scored.filter("id < 3").collect()) == [(0, 2, 2, 68), (1, 2, 2, 68), (2, 2, 2, 64)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
