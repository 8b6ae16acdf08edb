"""Benchmark items that occur in documents, by a prefix-filtered set join over windows of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .filters import bit_filter, in_filter
from .words import ALNUM, LOWER, row_groups, shingle_hashes, text_bytes, word_bounds, word_hashes


def _worded(texts: pa.Array) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per group of rows: first row, lower-case bytes, word starts, ends and hashes, and the first word of every row (and the end)."""
    offsets = text_bytes(texts)[1]
    for low, high in row_groups(offsets):
        data, rows = text_bytes(texts.slice(low, high - low))
        data = LOWER[data]
        starts, ends = word_bounds(data, rows, ALNUM)
        yield low, data.tobytes(), starts, ends, word_hashes(data, starts, ends), np.searchsorted(starts, rows)


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = 10, shingle: int = 3) -> DataFrame:
    """Windows of benchmark items: ``item, words, shingles``, each (item, words) once.

    A window is ``window`` consecutive words of an item; an item with fewer words, but not none, is one window. ``shingles`` are the
    hashes of its runs of ``shingle`` words, or of all its words where it has fewer. Items without an id are left out.
    """
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, items, grams = batch.column(0).to_pylist(), [], []
            out = []
            for low, text_, starts, ends, hashes, first in _worded(batch.column(1)):
                for row in range(len(first) - 1):
                    a, b = int(first[row]), int(first[row + 1])
                    words = [text_[s:e].decode("utf-8", "replace") for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]
                    n = min(window, b - a)
                    for at in range(b - a - n + 1 if n else 0):
                        out.append(words[at:at + n])
                        items.append(names[low + row])
                        grams.append(shingle_hashes(hashes[a + at:a + at + n], min(shingle, n)).view(np.int64).tolist())
            yield pa.record_batch([pa.array(items, pa.string()), pa.array(out, pa.list_(pa.string())), pa.array(grams, pa.list_(pa.int64()))],
                                  ["item", "words", "shingles"])

    named = benchmark.filter(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    return named.mapInArrow(windows, "item string, words array<string>, shingles array<long>").dropDuplicates(["item", "words"])


def _listed_shingles(starts: np.ndarray, hashes: np.ndarray, first: np.ndarray, sizes: list[int], filter_: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and hashes of the shingles in the filter that don't cross from one row into the next."""
    last = np.repeat(first[1:], np.diff(first))  # end of the row of every word
    for n in sizes:
        grams = shingle_hashes(hashes, n)
        at = np.flatnonzero(in_filter(grams, filter_) & (np.arange(len(grams)) + n <= last[:len(grams)]))
        if len(at):
            yield at, grams[at]


def shingle_counts(documents: DataFrame, text: str, sizes: list[int], listed: np.ndarray) -> DataFrame:
    """``token, n``: how often the listed shingles occur in all documents."""
    shared = documents.sparkSession.sparkContext.broadcast(listed)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for _, _, starts, _, hashes, first in _worded(batch.column(0)):
                found += [g for _, g in _listed_shingles(starts, hashes, first, sizes, shared.value)]
            tokens, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.record_batch([pa.array(tokens.view(np.int64)), pa.array(n, pa.int64())], ["token", "n"])

    return documents.select(text).mapInArrow(counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """The necessary prefix of every window: its rarest shingle, as ``token`` at word ``at`` of the window.

    A window is contained only where all its shingles are, so a prefix of one shingle is enough, and the rarest one yields the fewest
    candidates. A window with a shingle that no document has can't occur and is dropped. Ties go to the smaller token, then position.
    """
    each = windows.select("item", "words", F.posexplode("shingles").alias("at", "token"))
    ranked = each.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return (
        ranked.groupBy("item", "words").agg(F.min(F.struct("n", "token", "at")).alias("best"))
        .filter("best.n > 0").select("item", "words", "best.token", "best.at")
    )


def prefix_hits(documents: DataFrame, key: str, text: str, window: int, sizes: list[int], listed: np.ndarray) -> DataFrame:
    """Per document ``key, n_words, hits``: positions of listed shingles with the words around them that a window could cover."""
    shared = documents.sparkSession.sparkContext.broadcast(listed)
    kind = dict(documents.dtypes)[key]
    hit = pa.struct([("token", pa.int64()), ("pos", pa.int32()), ("left", pa.int32()), ("around", pa.list_(pa.string()))])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits: list[list] = [[] for _ in range(batch.num_rows)]
            n_words = np.zeros(batch.num_rows, np.int64)
            for low, text_, starts, ends, hashes, first in _worded(batch.column(1)):
                n_words[low:low + len(first) - 1] = np.diff(first)
                for at, grams in _listed_shingles(starts, hashes, first, sizes, shared.value):
                    rows = np.searchsorted(first, at, "right") - 1
                    for p, row, token in zip(at.tolist(), rows.tolist(), grams.view(np.int64).tolist()):
                        a, b = max(int(first[row]), p - window + 1), min(int(first[row + 1]), p + window)
                        words = [text_[s:e].decode("utf-8", "replace") for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]
                        hits[low + row].append({"token": token, "pos": p - int(first[row]), "left": p - a, "around": words})
            yield pa.record_batch([batch.column(0), pa.array(n_words), pa.array(hits, pa.list_(hit))], ["key", "n_words", "hits"])

    named = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    return named.mapInArrow(found, f"key {kind}, n_words long, hits array<struct<token: long, pos: int, left: int, around: array<string>>>")


def contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                 item_text: str = "text", window: int = 10, shingle: int = 3, filter_bits: int = 1 << 22) -> DataFrame:
    """Words of documents inside an occurrence of a benchmark window: one row ``<key>, n_words, n_hit, n_items, items_sha256, contaminated`` a row.

    The studied project has no benchmark records; this operator is general. A-Z is lower-cased; words are runs of digits, letters
    and characters beyond ASCII. ``n_items`` counts items with a window that occurs, ``items_sha256`` is the SHA-256 of their ids, sorted as
    strings and comma-joined.

    One pass counts the shingles of the windows in all documents; a second one finds the rarest shingle of each window. A hit is
    joined to the windows with that prefix, kept where the window fits into the document around it, and verified word for word.
    Documents are compared with shingles through a filter of ``filter_bits`` bits; a benchmark that fills it costs time, not results.

    Null and empty texts have no words. Repeated rows and null keys get a row each; further columns don't matter; an empty benchmark
    hits nothing. A shingle in a third of all documents is picked only where a window has no rarer one; its hits are pre-joined rows of
    bounded size whose join Spark may split.
    """
    windows = cut(item_windows(benchmark, item, item_text, window, shingle), "windows")
    grams = windows.select(F.size("shingles").alias("s"), F.size("words").alias("w")).select((F.col("w") - F.col("s") + 1).alias("n"))
    sizes = sorted(r[0] for r in grams.distinct().collect())
    listed = bit_filter(windows.select(F.explode("shingles").alias("token")), filter_bits)
    prefix = cut(prefixes(windows, shingle_counts(documents, text, sizes, listed)), "prefixes")
    rare = bit_filter(prefix.select("token"), filter_bits)
    hits = prefix_hits(documents, key, text, window, sizes, rare).withColumn("_row", F.monotonically_increasing_id())
    hits = cut(hits, "hits")
    n, start = F.size("words"), F.col("hit.pos") - F.col("at")
    verified = (
        hits.select("_row", "n_words", F.explode("hits").alias("hit")).withColumn("token", F.col("hit.token")).join(prefix, "token")
        .filter((start >= 0) & (start + n <= F.col("n_words")))
        .filter(F.slice("hit.around", F.col("hit.left") - F.col("at") + 1, n) == F.col("words"))
        .select("_row", "item", F.struct(start.alias("start"), (start + n).alias("end")).alias("span"))
    )
    covered = F.aggregate(
        F.sort_array("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["reach"], s["start"]))).alias("n"),
            F.greatest(acc["reach"], s["end"]).alias("reach"),
        ), lambda acc: acc["n"],
    )
    found = (
        verified.groupBy("_row").agg(F.collect_set("span").alias("spans"), F.collect_set("item").alias("items"))
        .select("_row", covered.cast("long").alias("n_hit"), F.array_sort("items").alias("items"))
    )
    n_hit, items = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return hits.select("_row", F.col("key"), "n_words").join(found, "_row", "left").select(
        F.col("key").alias(key), "n_words", n_hit.cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
