"""Cost-balanced packing of token sequences."""

from __future__ import annotations

import heapq
import json
import os
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import LOWER, row_groups, text_bytes, word_bounds, word_hashes

PIECES = "length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[9, 10, 32]] = False
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
CHUNK = 1 << 13  # words encoded at once
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[list(b",.|%$&#*!")] = True


def _segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words between blanks; punctuation behind a letter of a plain alphabet is a segment of its own."""
    letter = LETTER[data]
    if len(data) > 1:
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cuts = np.zeros(len(data), bool)
    cuts[1:] = letter[:-1] & PUNCTUATION[data[1:]]
    return word_bounds(data, offsets, NOT_BLANK, cuts)


class KnownWords:
    """Ids of distinct words by their hash, one after the other in one array; at most ``most`` words, then it starts anew."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.number: dict[int, int] = {}
        self.ids = np.empty(1 << 16, "<u4")
        self.ends = np.zeros(1 << 14, np.int64)  # of word i at i + 1

    def add(self, keys: list[int], words: list[list[int]]) -> None:
        n = len(self.number)
        ends = self.ends[n] + np.cumsum([len(w) for w in words])
        for name, need in (("ids", int(ends[-1])), ("ends", n + len(words) + 1)):
            array = getattr(self, name)
            if len(array) < need:
                setattr(self, name, np.concatenate([array, np.empty(max(need, 2 * len(array)) - len(array), array.dtype)]))
        self.ids[self.ends[n]:ends[-1]] = np.fromiter(chain.from_iterable(words), "<u4", int(ends[-1] - self.ends[n]))
        self.ends[n + 1:n + 1 + len(words)] = ends
        self.number.update(zip(keys, range(n, n + len(words))))


def _word_model(tokenizer) -> Callable[[str], list[int]] | None:
    """Ids of a word by the tokenizer's model alone, where its own splitting leaves a run of letters whole; None for any other tokenizer."""
    stages = (json.loads(tokenizer.to_str()).get("pre_tokenizer") or {}).get("pretokenizers") or []
    if [x["type"] for x in stages] != ["Split", "ByteLevel"] or stages[1]["add_prefix_space"]:
        return None
    if r"[\p{L}]+" not in stages[0]["pattern"].get("Regex", ""):
        return None
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: b for b in own} | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*own}))}
    tokenize = tokenizer.model.tokenize
    return lambda word: [t.id for t in tokenize(word.encode().decode("latin-1").translate(letters))]


def _plain(word: str) -> bool:
    """Letters only, which no normal form and no lower case would change."""
    return word.isalpha() and (word.isascii() or unicodedata.is_normalized("NFC", word)) and word == word.lower()


def word_encoder(path: str, most: int = 400_000) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Ids of whole texts and their number per text, for tokenizers that ignore blanks and case and never span a blank, nor a letter
    and the punctuation behind it.

    Words repeat: each distinct one of a group of texts is encoded once, unless it is among the (at most ``most``) words known. Words of plain letters
    go to the tokenizer's model directly, past its normalizer and splitting, which would leave them as they are.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the other cores have tasks of their own
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    known, model = KnownWords(most), _word_model(tokenizer)
    special = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data = text_bytes(texts)[0].tobytes()
        if not any(s in data for s in special):
            return by_words(texts)
        # strings of special tokens are found before words are, so that their texts are encoded as they are
        parts = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4") for t in texts.to_pylist()]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def by_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_bytes(texts)
        data = LOWER[data]
        starts, ends = _segments(data, offsets)
        hashes, first, inverse = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        keys = hashes.tolist()
        if len(known.number) + len(keys) > most:
            known.clear()
        numbers = np.fromiter(map(known.number.get, keys, repeat(-1)), np.int64, len(keys))
        unseen = np.flatnonzero(numbers < 0)
        text = data.tobytes()
        for low in range(0, len(unseen), CHUNK):
            some = unseen[low:low + CHUNK]
            fresh = [text[s:e].decode("utf-8", "replace") for s, e in zip(starts[first[some]].tolist(), ends[first[some]].tolist())]
            numbers[some] = np.arange(len(some)) + len(known.number)
            found = [model(w) if model and _plain(w) else None for w in fresh]
            other = [i for i, ids in enumerate(found) if ids is None]
            for i, e in zip(other, tokenizer.encode_batch_fast([fresh[i] for i in other], add_special_tokens=False)):
                found[i] = e.ids
            known.add(hashes[some].tolist(), found)
        word = numbers[inverse]
        begin = known.ends[word]
        count = known.ends[word + 1] - begin
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = known.ids[np.repeat(begin - upto[:-1], count) + np.arange(upto[-1])]
        per_text = np.diff(upto[np.searchsorted(starts, offsets)])
        return ids, per_text

    return encode


def attention_cost(length, linear: float, quadratic: float):
    """Estimated cost of a piece: attention is quadratic in its length, all else linear."""
    return linear * length + quadratic * length * length


def capacities(total: int, most: int) -> list[int]:
    """Sequence lengths that hold ``total`` tokens without padding: full ones, then the powers of two of what is left."""
    rest = total % most
    return [most] * (total // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: np.ndarray, most: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """``(document, start, length, sequence)`` of every piece.

    Documents are first cut into pieces of at most ``most`` tokens. Pieces go, from the longest to the shortest, to the sequence of
    the lowest cost so far among those with room for the whole piece. A piece that fits nowhere is cut: the sequence with the
    most room takes what it can, and the rest is placed again at its own length. Ties go to the earlier document and sequence.
    """
    room = np.array(capacities(int(lengths.sum()), most), np.int64)
    cost = np.zeros(len(room))
    waiting = [(-min(most, n - s), d, s) for d, n in enumerate(lengths.tolist()) for s in range(0, n, most)]
    heapq.heapify(waiting)
    placed = []
    while waiting:
        n, d, s = heapq.heappop(waiting)
        n = -n
        fits = room >= n
        k = int(np.where(fits, cost, np.inf).argmin())
        if not fits[k]:
            k = int(room.argmax())
        took = min(n, int(room[k]))
        placed.append((d, s, took, k))
        room[k] -= took
        cost[k] += attention_cost(took, linear, quadratic)
        if took < n:
            heapq.heappush(waiting, (took - n, d, s + took))
    return placed


def _pack(keys: list, ids: list[np.ndarray], first: int, most: int, linear: float, quadratic: float, schema: pa.Schema) -> tuple[pa.RecordBatch, int]:
    lengths = np.array([len(x) for x in ids], np.int64)
    placed = sorted(assign(lengths, most, linear, quadratic), key=lambda p: (p[3], p[0], p[1]))
    used = np.zeros(max((p[3] for p in placed), default=-1) + 1, np.int64)
    rows = []
    for d, s, n, k in placed:
        rows.append((keys[d], s, n, zlib.crc32(ids[d][s:s + n].tobytes()), int(lengths[d]), first + k, int(used[k])))
        used[k] += n
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema), first + len(used)


def pack_texts(mission_files: DataFrame, tokenizer: str, key: str = "file", text: str = "value", end_id: int = 2, most: int = 4096,
               group_tokens: int = 1 << 21, linear: float = 1.0, quadratic: float = 1 / 4096) -> DataFrame:
    """Pack texts (mission files by ``file``) into sequences: one row ``<key>, start, length, ids_crc32, doc_tokens, sequence_id, offset`` a piece.

    ``tokenizer`` is the path of a tokenizer file on the executors. A text's ids are those of its whole text followed by
    ``end_id``; a null or empty text has that id alone. ``ids_crc32`` is the CRC-32 of the piece's ids as little-endian 32-bit numbers.

    Every task packs its own rows, about ``group_tokens`` tokens at a time, so nothing is shuffled, memory is bounded by one group
    and one text, and a lost task is simply run again. The cost of a piece is ``linear * n + quadratic * n * n``; see ``assign``.
    A group's last, incomplete sequence becomes sequences whose lengths are powers of two, which need no padding. Sequence
    numbers carry the task's number in their upper bits: unique, and gapless within a task. Repeated rows and null keys are
    packed like all others, an empty table gives an empty result; other columns of the table don't matter.
    """
    kind = dict(mission_files.dtypes)[key]
    named = mission_files.select(mission_files[key].alias("key"), mission_files[text].alias("text"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, first = word_encoder(tokenizer), TaskContext.get().partitionId() << 33
        keys, ids, held = [], [], 0
        for batch in batches:
            schema = pa.schema([pa.field("key", batch.schema.field(0).type), *[pa.field(n, pa.int64()) for n in
                               ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]])
            for low, high in row_groups(text_bytes(batch.column(1))[1]):
                flat, sizes = encode(batch.column(1).slice(low, high - low))
                ends = np.cumsum(sizes)
                for k, start, end in zip(batch.column(0).slice(low, high - low).to_pylist(), ends - sizes, ends):
                    keys.append(k)
                    ids.append(np.append(flat[start:end], np.array([end_id], "<u4")))
                    held += len(ids[-1])
                    if held >= group_tokens:
                        out, first = _pack(keys, ids, first, most, linear, quadratic, schema)
                        yield out
                        keys, ids, held = [], [], 0
        if keys:
            yield _pack(keys, ids, first, most, linear, quadratic, schema)[0]

    return named.mapInArrow(packed, f"key {kind}, start long, {PIECES}").withColumnRenamed("key", key)
