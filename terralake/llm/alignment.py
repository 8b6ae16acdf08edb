"""Alignment of two tokenizers' tokens by merging their ends along merge-path pieces."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .words import row_groups, text_bytes

#: How byte-level vocabularies write words: pre-tokens of contractions, letters, digits, other signs and blanks.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GROUPS = "n_a long, n_b long, n_groups long, n_overlaps long, groups string, links array<struct<pair:long,times:long>>"


def _byte_letters() -> dict[str, int]:
    """Byte of every letter of a byte-level vocabulary: printable Latin-1 letters stand for themselves, the rest follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class ByteLevel:
    """A byte-level BPE file (``.json``). Its ids rank its merges, so that bytes by id are all the merging needs."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, special = _byte_letters(), {t["content"] for t in file.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        # a special token's string is ordinary text, hence no special tokens here
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """A piece model (``.model``) with byte fallback, which puts a space in front of a text by itself."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = ((i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()))
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return self.model.encode(list(texts), num_threads=1)


def splits(ends_a: np.ndarray, ends_b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where every piece of ``work`` merged ends begins in either list, by binary searches on the diagonals of the merge path.

    Of equal ends, A's comes first; a pair of equal ends stays in one piece.
    """
    n_a, n_b = len(ends_a), len(ends_b)
    diagonal = np.append(np.arange(0, n_a + n_b, work), n_a + n_b)
    low, high = np.maximum(diagonal - n_b, 0), np.minimum(diagonal, n_a)
    while (low < high).any():
        open_ = low < high
        middle = (low + high) // 2
        other = diagonal - 1 - middle
        goes_on = np.zeros(len(diagonal), bool)
        goes_on[open_] = ends_a[middle[open_]] <= ends_b[other[open_]]
        low, high = np.where(open_ & goes_on, middle + 1, low), np.where(open_ & ~goes_on, middle, high)
    of_b = diagonal - low
    inner = (low > 0) & (of_b < n_b)
    of_b[inner] += ends_a[low[inner] - 1] == ends_b[of_b[inner]]
    return low, of_b


def merge_piece(ends_a: np.ndarray, ends_b: np.ndarray, a: tuple[int, int], b: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping token pairs that end in one piece, in the order of their ends, and which of them end together.

    An overlap ends where one of its tokens does. A token that goes on into the next piece is named by its number there.
    """
    own_a, own_b = ends_a[a[0]:a[1]], ends_b[b[0]:b[1]]
    b_of_a, a_of_b = np.searchsorted(own_b, own_a), np.searchsorted(own_a, own_b)
    both = np.zeros(len(own_a), bool)
    inside = b_of_a < len(own_b)
    both[inside] = own_b[b_of_a[inside]] == own_a[inside]
    alone = np.ones(len(own_b), bool)
    alone[b_of_a[both]] = False
    at = np.concatenate([np.arange(len(own_a)) + b_of_a, (np.arange(len(own_b)) + a_of_b)[alone]])
    order = np.argsort(at, kind="stable")
    pick = lambda x, y: np.concatenate([x, y[alone]])[order]
    return (pick(np.arange(*a), a[0] + a_of_b), pick(b[0] + b_of_a, np.arange(*b)), pick(both, np.zeros(len(own_b), bool)))


def align_ends(ends_a: np.ndarray, ends_b: np.ndarray, work: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Last A and last B token of every group, and the A token of every overlap, from pieces merged independently of each other.

    Groups are stitched from the pieces in their order: one that is open at the end of a piece ends with the first common end after it.
    """
    at_a, at_b = splits(ends_a, ends_b, work)
    merged = [merge_piece(ends_a, ends_b, (at_a[i], at_a[i + 1]), (at_b[i], at_b[i + 1])) for i in range(len(at_a) - 1)]
    if not merged:
        return (np.zeros(0, np.int64),) * 3
    a, b, both = (np.concatenate(x) for x in zip(*merged))
    return a[both], b[both], a


def _decimals(numbers: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal numbers, each followed by its byte of ``after`` (0: none), and where each one ends."""
    width = np.ones(len(numbers), np.int64)
    for k in range(1, len(str(int(numbers.max(initial=0))))):
        width += numbers >= 10 ** k
    ends = np.cumsum(width + (after > 0))
    last = ends - 1 - (after > 0)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(width.max(initial=0))):
        some = width > k
        out[last[some] - k] = 48 + numbers[some] // 10 ** k % 10
    out[ends[after > 0] - 1] = after[after > 0]
    return out, ends


def _align(texts: pa.Array, a: ByteLevel, b: Pieces, sizes: tuple[np.ndarray, np.ndarray], work: int) -> list[pa.Array]:
    """Columns of ``GROUPS`` for some texts, aligned as one sequence: their bytes follow each other on both sides."""
    whole = [t or "" for t in texts.to_pylist()]
    found, lists = [], []
    filled = [i for i, t in enumerate(whole) if t]
    for i, ids_a, ids_b in zip(filled, a.encode([whole[i] for i in filled]), b.encode([whole[i] for i in filled])):
        said = b" " + whole[i].encode()
        if b"".join(map(a.bytes.__getitem__, ids_a)) == said and b"".join(map(b.bytes.__getitem__, ids_b)) == said:
            found.append(i)
            lists.append((ids_a, ids_b))
    flat = [np.fromiter((x for pair in lists for x in pair[side]), np.int64) for side in (0, 1)]
    upto = [np.cumsum([0, *(len(pair[side]) for pair in lists)]) for side in (0, 1)]
    ends = [np.cumsum(size[ids]) for size, ids in zip(sizes, flat)]
    last_a, last_b, overlap_a = align_ends(*ends, work)

    n = np.zeros((4, len(whole)), np.int64)
    n[0, found], n[1, found] = np.diff(upto[0]), np.diff(upto[1])
    n[2, found] = np.diff(np.searchsorted(last_a, upto[0]))
    n[3, found] = np.diff(np.searchsorted(overlap_a, upto[0]))

    # groups one after the other, A's tokens in front of B's
    group_a, group_b = np.searchsorted(last_a, np.arange(len(flat[0]))), np.searchsorted(last_b, np.arange(len(flat[1])))
    at_a = np.arange(len(flat[0])) + np.append(0, last_b + 1)[group_a]
    at_b = np.arange(len(flat[1])) + (last_a + 1)[group_b]
    numbers, after = np.empty(len(at_a) + len(at_b), np.int64), np.full(len(at_a) + len(at_b), ord(","), np.uint8)
    numbers[at_a], numbers[at_b] = flat[0], flat[1]
    after[at_a[last_a]], after[at_b[last_b]] = ord("|"), ord(";")
    after[upto[0][1:] + upto[1][1:] - 1] = 0
    data, number_ends = _decimals(numbers, after)
    offsets = np.zeros(len(whole) + 1, np.int64)
    offsets[np.array(found, int) + 1] = np.diff(np.append(0, number_ends)[upto[0] + upto[1]])
    groups = pa.LargeStringArray.from_buffers(len(whole), pa.py_buffer(np.cumsum(offsets)), pa.py_buffer(data)).cast(pa.string())

    # how often a text links each pair of ids
    text = np.searchsorted(upto[0], last_a, "right") - 1
    pair = flat[0][last_a] << 32 | flat[1][last_b]
    order = np.lexsort((pair, text))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(text[order]) != 0) | (np.diff(pair[order]) != 0)
    first = np.flatnonzero(fresh)
    times = np.diff(np.append(first, len(order)))
    per_text = np.zeros(len(whole) + 1, np.int64)
    per_text[np.array(found, int) + 1] = np.bincount(text[order][first], minlength=len(found))
    struct = pa.StructArray.from_arrays([pa.array(pair[order][first]), pa.array(times)], ["pair", "times"])
    return [*map(pa.array, n), groups, pa.ListArray.from_arrays(pa.array(np.cumsum(per_text), pa.int32()), struct)]


def align_tokens(mission_files: DataFrame, a: str, b: str, key: str = "file", text: str = "value", work: int = 1 << 16) -> DataFrame:
    """Groups of tokens of two tokenizers for every text (mission files by ``file``).

    ``a`` is the path of a byte-level BPE file and ``b`` that of a piece model, on the executors. A encodes a space and the text, B
    the text, to which it adds a space itself; strings of special tokens are plain text. One row per row of ``mission_files``: ``<key>``;
    ``n_a, n_b``, its tokens; ``n_groups``, the shortest runs of A and B tokens over the same bytes; ``n_overlaps``, pairs of tokens that share a
    byte; ``groups``, the ids as ``a1,a2|b1;a3|b2,b3``; ``links``, the pairs of tokens that end together (``pair``: A's id times 2^32 plus B's)
    and how often each occurs in the text (``times``).

    The ends of some texts, about half a megabyte at a time or one longer text, are merged in pieces of ``work`` ends each, which the
    diagonals of the merge path cut to equal size wherever tokens are long or short. Nothing is shuffled; memory holds such a set of texts.

    Null and empty texts, and those that either tokenizer changes (so that its tokens aren't the text's bytes), have no tokens. Repeated rows
    and null keys give a row each, an empty table none; further columns are ignored.
    """
    kind = dict(mission_files.dtypes)[key]
    named = mission_files.select(mission_files[key].alias("key"), mission_files[text].alias("text"))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = ByteLevel(a), Pieces(b)
        sizes = tuple(np.array([len(x) for x in t.bytes], np.int64) for t in (first, second))
        for batch in batches:
            for low, high in row_groups(text_bytes(batch.column(1))[1]):
                some = batch.slice(low, high - low)
                columns = _align(some.column(1), first, second, sizes, work)
                yield pa.record_batch([some.column(0), *columns], ["key", *(c.split()[0] for c in GROUPS.split(", "))])

    return named.mapInArrow(aligned, f"key {kind}, {GROUPS}").withColumnRenamed("key", key)


def link_counts(aligned: DataFrame) -> DataFrame:
    """How often all texts link each pair of ids: ``pair, n, best``; ``best`` marks the most frequent A id of each B id, ties included."""
    counts = aligned.select(F.explode("links").alias("link")).groupBy(F.col("link.pair").alias("pair")).agg(F.sum("link.times").alias("n"))
    # a B id has at most as many rows as A has ids
    highest = F.max("n").over(W.partitionBy(F.expr("pair & 4294967295L")))
    return counts.withColumn("best", F.col("n") == highest)


def score_links(aligned: DataFrame, counts: DataFrame, row: str) -> DataFrame:
    """``<row>, n_links, n_best, count_sum`` of every text with links; ``row`` numbers the rows of ``aligned``.

    ``counts`` has a row for each pair in use. Of two tokens that end together the shorter is the end of the longer, so there are at most as many
    pairs as both vocabularies have bytes, however many texts there are: ``counts`` is broadcast, and no link is shuffled.
    """
    links = aligned.select(F.col(row), F.explode("links").alias("link")).select(row, "link.pair", "link.times")
    return links.join(F.broadcast(counts), "pair").groupBy(row).agg(
        F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
