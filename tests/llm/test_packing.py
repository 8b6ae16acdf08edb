"""Packing: every id once, in order, and the ids of the plain tokenizer."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from terralake.llm.packing import assign, attention_cost, capacities, pack_texts, word_encoder
from terralake.llm.queries import tokenizer_path

TEXTS = [
    "The quick brown fox, it's FINE... don't stop! #1,000.50%", None, "", " \n\t ", "Ärger über Öl; ñandú—¿qué? ÇA\u00a0va", "e\u0301te\u0301 \u212b A\u030a. x\u0301, ", "日本語 テキスト 123",
    "\x1c a\x1fb \u2028c", "a" * 5000, "word " * 6000, "$$$%%% &&&!!! |x| x|y,z", "<|endoftext|> <|startoftext|>x", "x×y, ÷. ÿ. İstanbul. ΟΔΟΣ ΣΑΣ.", "the, the, the,",
    "ǅungla ſtraße ŉ ﬃ ªº ʰ İi ıI Σς naïve nai\u0308ve ΐ", "x2y _a_ don't l'été 12ab \u200bz",
]


def test_ids_are_those_of_the_tokenizer():
    plain = Tokenizer.from_file(tokenizer_path())
    for most in (400_000, 3):
        ids, sizes = word_encoder(tokenizer_path(), most)(pa.array(TEXTS, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [plain.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def test_assign_balances_and_fills():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 300, 500)
    placed = assign(lengths, 256, 1.0, 1 / 256)
    room = capacities(int(lengths.sum()), 256)
    used = np.zeros(len(room), int)
    for d, s, n, k in placed:
        used[k] += n
    assert used.tolist() == room
    cost = np.zeros(len(room))
    for d, s, n, k in placed:
        cost[k] += attention_cost(n, 1.0, 1 / 256)
    full = cost[np.array(room) == 256]
    naive = np.zeros(len(room))  # the same pieces in the order they came
    at = 0
    for d, n in enumerate(lengths):
        naive[min(at // 256, len(room) - 1)] += attention_cost(n, 1.0, 1 / 256)
        at += n
    assert full.std() / full.mean() < naive[:-8].std() / naive[:-8].mean()
    assert sum(1 << b for b in range(8) if sum(lengths) % 256 >> b & 1) == sum(c for c in room if c < 256)


@pytest.mark.parametrize("group", [1 << 22, 500])
def test_pieces_are_whole(spark, group):
    files = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)] + [(None, "x y", 1), (3, "again", 1), (3, "again", 1)], "file long, value string, length int")
    rows = pack_texts(files.coalesce(2), tokenizer_path(), most=64, group_tokens=group).collect()
    plain = Tokenizer.from_file(tokenizer_path())
    for i, t in enumerate(TEXTS):
        if i == 3:
            continue
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows if r["file"] == i)
        at = 0
        for start, n, crc, total in own:
            assert (start, total) == (at, len(ids)) and 0 < n <= 64
            assert crc == zlib.crc32(ids[start:start + n].tobytes())
            at += n
        assert at == len(ids)
    assert sum(r["file"] == 3 for r in rows) >= 3 and sum(r["file"] is None for r in rows) >= 1
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 64 or at & (at - 1) == 0


def test_empty_table(spark):
    assert pack_texts(spark.createDataFrame([], "file long, value string"), tokenizer_path()).collect() == []
