"""Byte strings that occur twice among files, by column-wise construction of sorted suffixes over anchored pieces."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .filters import listed
from .words import BLOCK, mix, powers, row_groups, text_bytes

GRAM = 32  # bytes of an anchor
LOW_BITS = np.uint64((1 << 21) - 1)


# ---- anchors ---------------------------------------------------------------------------------


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima inside blocks of that size."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def _range_hash(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * down[start])


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: row, first window, number of windows, distance of the anchor, hash of the anchor, hash of the bytes.

    The anchor of a window of ``length`` bytes is its first 32-byte string of the smallest hash. Equal windows have equal anchors at
    the same distance, wherever they stand, and about 85 neighbouring windows share one.
    """
    up, down = powers()
    n, width = len(data), length - GRAM + 1
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[:n - GRAM + 1])
    least = _sliding_min((grams & ~LOW_BITS) | np.arange(len(grams), dtype=np.uint64), width)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(least)]
    windows = np.flatnonzero(np.arange(len(least)) + length <= offsets[row + 1])
    if not len(windows):
        return anchored_runs(data[:0], offsets[:1], length)
    key = least[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (key[1:] != key[:-1]) | (windows[1:] != windows[:-1] + 1)
    at = np.flatnonzero(new)
    first, count = windows[at], np.diff(np.append(at, len(windows)))
    anchor = (key[at] & LOW_BITS).astype(np.int64)
    whole = _range_hash(sums, down, first, first + count - 1 + length)
    whole = mix(whole + count.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + (anchor - first).astype(np.uint64))
    return row[first], first - offsets[row[first]], count, anchor - first, grams[anchor], whole


def _blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """First row, bytes, row offsets and place in the row: groups of rows, and a longer row in overlapping blocks."""
    for low, high in row_groups(text_bytes(texts)[1], BLOCK):
        data, offsets = text_bytes(texts.slice(low, high - low))
        for at in range(0, max(1, len(data)), BLOCK - 4096):
            if len(data) <= BLOCK:
                yield low, data, offsets, 0
                break
            block = data[at:at + BLOCK]
            yield low, block, np.array([0, len(block)]), at


RUNS = "k1 long, k2 long, start int, windows int, ahead int, anchor long, piece long"


def find_runs(keyed: DataFrame, length: int) -> DataFrame:
    """Runs of all texts of ``keyed`` (``k1, k2, text``)."""
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (np.asarray(batch.column(i)) for i in (0, 1))
            for low, data, offsets, place in _blocks(batch.column(2)):
                row, first, count, ahead, anchor, piece = anchored_runs(data, offsets, length)
                if place:  # windows that end in the overlap belong to the block before
                    new = first + count > 4096 - length + 1
                    skip = np.maximum(0, 4096 - length + 1 - first)
                    row, first, count, ahead, anchor = (x[new] for x in (row, first + skip, count - skip, ahead - skip, anchor))
                    piece = mix(piece[new] + skip[new].astype(np.uint64))
                yield pa.record_batch(
                    [pa.array(k1[low + row]), pa.array(k2[low + row]), pa.array((first + place).astype(np.int32)), pa.array(count.astype(np.int32)),
                     pa.array(ahead.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(piece.view(np.int64))],
                    ["k1", "k2", "start", "windows", "ahead", "anchor", "piece"],
                )

    return keyed.select("k1", "k2", "text").mapInArrow(runs, RUNS)


# ---- columns ---------------------------------------------------------------------------------


def repeated_windows(pieces: list[bytes], ahead: np.ndarray, length: int) -> list[np.ndarray]:
    """For every piece, which of its windows also stand in another piece at the same distance from the anchor.

    Pieces are aligned at their anchors and read from the right, one symbol of every piece in each round. A round puts its symbols in
    front of the suffixes of the round before: a stable sort by symbol of the old order is the new order (the symbols in the old order are
    the column's part of the Burrows-Wheeler transform), and the common prefix of two neighbours is one more than the least one
    between them in the old order. Neighbours with a common prefix of ``length`` share a window.
    """
    reach = length - GRAM
    left, size = reach - ahead, np.array([len(p) for p in pieces])
    right = left + size
    symbols = np.zeros((len(pieces), int(right.max(initial=0))), np.uint8)
    for i, p in enumerate(pieces):
        symbols[i, left[i]:right[i]] = np.frombuffer(p, np.uint8)
    found = np.zeros((len(pieces), symbols.shape[1] + 1), bool)
    entering = np.split(np.argsort(right, kind="stable"), np.searchsorted(np.sort(right), np.arange(1, symbols.shape[1] + 1)))
    order, common = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for x in range(symbols.shape[1] - 1, -1, -1):
        new = entering[x + 1]
        before = np.concatenate([new, order])
        shared = np.concatenate([np.zeros(len(new), np.int64), common, [0]])
        at = np.flatnonzero(left[before] <= x)
        if not len(at):
            order, common = np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        symbol = symbols[before[at], x]
        by = np.argsort(symbol, kind="stable")
        at, symbol = at[by], symbol[by]
        order, common = before[at], np.zeros(len(at), np.int64)
        same = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
        if len(same):
            ranges = np.column_stack([at[same - 1] + 1, at[same] + 1]).reshape(-1)
            common[same] = np.minimum(np.minimum.reduceat(shared, ranges)[::2] + 1, length)
            twins = same[common[same] >= length]
            found[order[twins], x] = True
            found[order[twins - 1], x] = True
    return [found[i, left[i]:left[i] + size[i] - length + 1] for i in range(len(pieces))]


def _intervals(flags: np.ndarray) -> np.ndarray:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges.reshape(-1, 2)


ENTRY = np.dtype([("window", "<u8"), ("anchor", "<i8"), ("piece", "<i8"), ("at", "<i4")])


def _compare(length: int, buckets: int):
    """Repeated windows of a block of pieces, as intervals; windows of pieces that other blocks share are packed for an exchange."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        pieces, ahead = rows["body"].to_list(), rows["ahead"].to_numpy(np.int64)
        found = repeated_windows(pieces, ahead, length)
        out, sent = [], []
        up, down = powers()
        for flags, body, anchor, piece, n, blocks in zip(found, pieces, rows["anchor"], rows["piece"], rows["n"], rows["blocks"]):
            if n > 1:
                flags = np.ones_like(flags)
            out += [(anchor, piece, a, b, None, None) for a, b in _intervals(flags).tolist()]
            if blocks > 1:
                data = np.frombuffer(body, np.uint8)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])])
                starts = np.arange(len(flags))
                own = np.empty(len(flags), ENTRY)
                own["window"] = mix(_range_hash(sums, down, starts, starts + length) + np.uint64(anchor & 0xFFFFFFFFFFFFFFFF))
                own["anchor"], own["piece"], own["at"] = anchor, piece, np.where(flags, -1, starts)
                sent.append(own)
        if sent:
            entries = np.concatenate(sent)
            known = entries["at"] < 0
            entries = np.concatenate([entries[~known], entries[known][np.unique(entries["window"][known], return_index=True)[1]]])
            bucket = (entries["window"] % np.uint64(buckets)).astype(int)
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                out.append((None, None, None, None, int(bucket[part[0]]), entries[part].tobytes()))
        kinds = {"anchor": "Int64", "piece": "Int64", "from": "Int32", "to": "Int32", "bucket": "Int32", "packed": "object"}
        columns = zip(*out) if out else [()] * len(kinds)
        return pd.DataFrame({n: pd.array(list(c), dtype=k) for (n, k), c in zip(kinds.items(), columns)})  # never by way of floats

    return run


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    entries = np.concatenate([np.frombuffer(p, ENTRY) for p in rows["packed"]])
    _, inverse, count = np.unique(entries["window"], return_inverse=True, return_counts=True)
    hit = entries[(count[inverse] > 1) & (entries["at"] >= 0)]
    return pd.DataFrame({"anchor": hit["anchor"], "piece": hit["piece"], "from": hit["at"], "to": hit["at"] + 1})


# ---- on tables -------------------------------------------------------------------------------


def _keyed(files: DataFrame, content: str) -> DataFrame:
    text = F.coalesce(F.col(content).cast("string"), F.lit(""))
    return files.withColumns({"text": text, "k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)})


def repeated_spans(keyed: DataFrame, length: int = 200, block_pieces: int = 4000, filter_bits: int = 1 << 22) -> DataFrame:
    """``k1, k2, spans`` for the texts of ``keyed`` (``k1, k2, text``) with bytes that a string of ``length`` bytes covers which also starts elsewhere.

    The plain method takes as many rounds over the whole collection as its longest text has symbols. Here texts are first cut into runs
    of windows with one anchor, so that only windows whose anchors occur twice are looked at and a column-wise construction ends after
    ``2 * length - 32`` rounds. Runs whose anchor occurs once are unique. Runs whose anchor has one and the same surroundings everywhere are
    repeated as a whole. The pieces of all other anchors, each distinct one once, are sorted column by column in blocks of about
    ``block_pieces``. An anchor with more pieces than that spans several blocks; their distinct windows then meet by hash.
    """
    runs = cut(find_runs(keyed, length), "runs")
    anchors = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("piece").alias("low"), F.max("piece").alias("high"))
    twice = anchors.filter("n > 1").select("anchor", (F.col("low") == F.col("high")).alias("uniform"))
    shared = cut(runs.join(twice, "anchor"), "shared")
    whole = shared.filter("uniform").select("k1", "k2", F.col("start").alias("a"), (F.col("start") + F.col("windows") - 1 + length).alias("b"))
    mixed = shared.filter("NOT uniform")
    pieces = mixed.groupBy("anchor", "piece").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "start", "windows", "ahead")).alias("r"))
    pieces = cut(pieces.select("anchor", "piece", "n", "r.*"), "pieces")
    crowd = pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("pieces"))
    crowd = crowd.select("anchor", F.ceil(F.col("pieces") / block_pieces).cast("int").alias("blocks"))
    sized = pieces.join(crowd, "anchor")
    wanted = sized.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "piece", "n", "start", "windows", "ahead", "blocks")).alias("own"))
    once = keyed.filter(listed(pieces.select(F.col("k1").alias("token")), F.col("k1"), filter_bits)).select("k1", "k2", "text").dropDuplicates(["k1", "k2"])

    def bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, own in zip(batch["text"], batch["own"]):
                data = text.encode("utf-8", "surrogatepass")
                rows += [(o["anchor"], o["piece"], o["n"], o["ahead"], o["blocks"], data[o["start"]:o["start"] + o["windows"] - 1 + length]) for o in own]
            yield pd.DataFrame(rows, columns=["anchor", "piece", "n", "ahead", "blocks", "body"])

    groups = max(1, -(-pieces.count() // block_pieces))
    # sorted pieces of one group stay small: a row holds at most 2 * length bytes
    cutout = once.join(wanted, ["k1", "k2"]).select("text", "own").mapInPandas(bodies, "anchor long, piece long, n long, ahead int, blocks int, body binary")
    group = F.pmod(F.xxhash64("anchor", F.pmod(F.xxhash64("piece"), F.col("blocks"))), F.lit(groups))
    compared = cut(cutout.groupBy(group).applyInPandas(
        _compare(length, groups), "anchor long, piece long, from int, to int, bucket int, packed binary"), "columns")
    met = compared.filter("bucket IS NOT NULL").groupBy("bucket").applyInPandas(_meet, "anchor long, piece long, from int, to int")
    covered = compared.filter("bucket IS NULL").select("anchor", "piece", "from", "to").unionByName(met)
    start = F.col("start")
    parts = mixed.join(covered, ["anchor", "piece"]).select("k1", "k2", (start + F.col("from")).alias("a"), (start + F.col("to") - 1 + length).alias("b"))
    return whole.unionByName(parts).groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def remove_repeats(files: DataFrame, key: str = "file", content: str = "body", length: int = 200, filter_bits: int = 1 << 22,
                   texts: bool = False) -> DataFrame:
    """Remove what files repeat (block bodies or mission files by ``file``): one row ``<key>, n_bytes, n_removed, n_spans, kept_sha256`` a row.

    Every byte goes that is covered by a string of ``length`` bytes which also starts anywhere else, in the same file or another; strings
    overlap, never cross files and are judged on what came in. ``n_spans`` counts maximal removed runs, ``kept_sha256`` is the SHA-256 of
    the remaining bytes; with ``texts`` they are returned as ``kept``. Content is UTF-8 text or bytes that are valid UTF-8.

    A null content is empty. Repeated rows repeat each other; null keys are allowed, an empty table gives an empty result, and other
    columns don't matter. Anchors and pieces are told apart by 64-bit hashes of bytes. Texts with no repeated bytes aren't shuffled.
    """
    keyed = _keyed(files.select(files[key].alias("key"), files[content].alias("body")), "body")
    spans = cut(repeated_spans(keyed, length, filter_bits=filter_bits), "spans")
    named = keyed.select("key", "text", "k1", "k2")
    maybe = listed(spans.select(F.col("k1").alias("token")), F.col("k1"), filter_bits)
    marked = named.filter(maybe).join(spans, ["k1", "k2"], "left").select("key", "text", "spans")
    rest = named.filter(~maybe).select("key", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    kind = dict(files.dtypes)[key]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for low, high in row_groups(text_bytes(batch.column(1))[1]):
                some = batch.slice(low, high - low)
                data, offsets = text_bytes(some.column(1))
                data = data.tobytes()
                for at, end, own in zip(offsets[:-1].tolist(), offsets[1:].tolist(), some.column(2).to_pylist()):
                    kept, upto, removed, runs = [], 0, 0, 0
                    for s in sorted(own or [], key=lambda s: (s["a"], s["b"])):
                        if s["a"] > upto or not runs:
                            kept.append(data[at + upto:at + s["a"]])
                            runs += 1
                            upto = s["a"]
                        removed += max(0, s["b"] - upto)
                        upto = max(upto, s["b"])
                    kept.append(data[at + upto:end])
                    kept = b"".join(kept)
                    rows.append((end - at, removed, runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if texts else None))
            columns = list(zip(*rows)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = rest.unionByName(marked).mapInArrow(finish, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    return done.withColumnRenamed("key", key) if texts else done.drop("kept").withColumnRenamed("key", key)
