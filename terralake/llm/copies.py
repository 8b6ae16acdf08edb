"""Near copies among texts: MinHash signatures in an LSH forest of sorted orders, links verified on whole shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.flood import component_roots
from ..operators.scans import join_dim
from ..session import cut
from .filters import listed
from .words import INK, LOWER, mix, row_groups, shingle_hashes, text_bytes, word_bounds, word_hashes

TREES = 24
DEPTH = 4  # values of a signature that two neighbours share at least
HASHES = TREES * DEPTH
NEIGHBOURS = 3
SMALL = 2 * NEIGHBOURS + 1  # a region of so many texts needs no order
COMMON = 32  # a shingle of more texts of a block than this is counted by a product of matrices
_DRAWN = np.random.default_rng(20240607)
TURNS = _DRAWN.integers(0, 1 << 32, HASHES, dtype=np.uint32)
FACTORS = _DRAWN.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
#: Of 96 single bits, texts of similarity 0.8 agree in 86 on average, with a deviation of 3; unrelated ones in 48.
LEAST_BITS = 66


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct hashes of the 2-word shingles of every text; of its only word, where it has one."""
    out: list[np.ndarray] = []
    for low, high in row_groups(text_bytes(texts)[1]):
        data, rows = text_bytes(texts.slice(low, high - low))
        data = LOWER[data]
        starts, ends = word_bounds(data, rows, INK)
        words = word_hashes(data, starts, ends)
        pairs, first = shingle_hashes(words, 2), np.searchsorted(starts, rows).tolist()
        for a, b in zip(first[:-1], first[1:]):
            out.append(np.unique(pairs[a:b - 1]) if b - a > 1 else mix(words[a:b] + np.uint64(1)))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """``HASHES`` minima of 32-bit hashes for every set that isn't empty, in order."""
    full = [s for s in sets if len(s)]
    if not full:
        return np.zeros((0, HASHES), np.uint32)
    flat = (np.concatenate(full) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in full])[:-1]])
    out = np.empty((len(full), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((flat ^ TURNS[k]) * FACTORS[k], starts)
    return out


def _packed(signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per tree four 16-bit values in a long, and one bit of every value in two longs."""
    parts = (signature >> np.uint32(8)).astype(np.uint64).reshape(len(signature), TREES, DEPTH) & np.uint64(0xFFFF)
    trees = sum(parts[:, :, i] << np.uint64(16 * (DEPTH - 1 - i)) for i in range(DEPTH))
    bits = np.packbits((signature >> np.uint32(4)).astype(np.uint8) & 1, axis=1)
    bits = np.pad(bits, ((0, 0), (0, 16 - bits.shape[1])))
    return trees.view(np.int64), np.ascontiguousarray(bits).view(np.int64)


SKETCHED = "id long, n_shingles long, print1 long, print2 long, bits1 long, bits2 long, trees array<long>, n_bytes long, of_text long"


def sketch(mission_files: DataFrame, key: str, text: str) -> DataFrame:
    """Per text: size of its shingle set, fingerprint of the set, sketch and signature by tree (null for an empty set)."""
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in row_groups(text_bytes(batch.column(1))[1]):
                some = batch.slice(low, high - low)
                sets = shingle_sets(some.column(1))
                n = np.array([len(s) for s in sets], np.int64)
                trees, bits = _packed(signatures(sets))
                prints = np.array([(int(np.add.reduce(mix(s))), int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5BD1E995))))) for s in sets], np.uint64)
                prints = prints.reshape(-1, 2).view(np.int64)
                row = np.cumsum(n > 0) - 1
                take = lambda column: pa.array(column, pa.int64()).take(pa.array(row, mask=n == 0))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(trees) + 1) * TREES, pa.int32()), pa.array(trees.reshape(-1)))
                yield pa.record_batch(
                    [some.column(0).cast(pa.int64()), pa.array(n), pa.array(prints[:, 0]), pa.array(prints[:, 1]), take(bits[:, 0]), take(bits[:, 1]),
                     lists.take(pa.array(row, mask=n == 0)), pa.array(np.diff(text_bytes(some.column(1))[1])), some.column(2)],
                    ["id", "n_shingles", "print1", "print2", "bits1", "bits2", "trees", "n_bytes", "of_text"],
                )

    named = mission_files.select(mission_files[key].cast("long").alias("id"), mission_files[text].alias("text"))
    return named.withColumn("of_text", F.xxhash64("text")).mapInArrow(sketched, SKETCHED)


# ---- candidates ------------------------------------------------------------------------------


def _agreeing(a1, a2, b1, b2) -> np.ndarray:
    differing = [np.bitwise_count((a ^ b).view(np.uint64)).astype(int) for a, b in ((a1, b1), (a2, b2))]  # counts bits of unsigned numbers
    return HASHES - differing[0] - differing[1]


def _pairs_within(rows: np.ndarray, d: int, start: int = 0) -> np.ndarray:
    """Pairs ``a < b`` of rows ``tree, hi, id, bits1, bits2`` that are ``d`` places apart in one region and agree in enough bits."""
    if len(rows) <= start + d:
        return np.zeros((0, 2), np.int64)
    x, y = rows[start:len(rows) - d], rows[start + d:]
    near = (x[:, 0] == y[:, 0]) & (x[:, 1] == y[:, 1])
    x, y = x[near], y[near]
    if len(x):
        near = _agreeing(x[:, 3], x[:, 4], y[:, 3], y[:, 4]) >= LEAST_BITS
        x, y = x[near], y[near]
    return np.column_stack([np.minimum(x[:, 2], y[:, 2]), np.maximum(x[:, 2], y[:, 2])])


LEAF = ["tree", "hi", "id", "bits1", "bits2"]
FOUND = ["a", "b", *LEAF, "n"]


def _found(pairs: np.ndarray, rows: np.ndarray, n: np.ndarray | None) -> pa.RecordBatch:
    """Pairs, and rows that need more than their own region: ``n`` is the size of a crowded one, null where the region may go on elsewhere."""
    null = lambda k: pa.nulls(k, pa.int64())
    columns = [pa.concat_arrays([pa.array(pairs[:, i]), null(len(rows))]) for i in (0, 1)]
    columns += [pa.concat_arrays([null(len(pairs)), pa.array(rows[:, i])]) for i in range(5)]
    return pa.record_batch([*columns, pa.concat_arrays([null(len(pairs)), null(len(rows)) if n is None else pa.array(n)])], FOUND)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions of rows sorted by tree and first values: all pairs of small ones, the rows of crowded ones, and those at the ends of the partition.

    A region may be longer than a batch: its rows beyond the first few go out at once, with the size counted so far.
    """
    none, held, first, sent = np.zeros((0, 2), np.int64), np.zeros((0, 5), np.int64), True, None
    for batch in batches:
        rows = np.concatenate([held, np.column_stack([np.asarray(batch.column(n)) for n in LEAF]).astype(np.int64)])
        if not len(rows):
            continue
        new = np.ones(len(rows), bool)
        new[1:] = (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(rows)))
        first = first and (sent is None or (rows[0, :2] == sent).all())
        if first:  # the first region may have begun in another partition, or earlier and gone out already
            if len(starts) == 1:
                yield _found(none, rows, None)
                held, sent = rows[:0], rows[0, :2]
                continue
            yield _found(none, rows[:starts[1]], None)
            first = False
            starts, sizes = starts[1:], sizes[1:]
        own = np.repeat(sizes, sizes)
        body = rows[starts[0]:]
        last = starts[-1] - starts[0]
        whole, size = body[:last], own[:last]
        crowded = size > SMALL
        small = whole[~crowded]
        pairs = [_pairs_within(small, d) for d in range(1, SMALL)] if len(small) > 1 else []
        yield _found(np.unique(np.concatenate(pairs), axis=0) if pairs else none, whole[crowded], size[crowded])
        held = body[last:]
        if len(held) > 1 << 16:  # goes on for long: its place among the regions at the ends is found later
            yield _found(none, held, None)
            held, first, sent = held[:0], True, held[0, :2]
    if len(held):
        yield _found(none, held, None)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbours in sorted rows ``tree, hi, id, bits1, bits2``; the first and last rows of a partition also go on, with their place."""
    part = TaskContext.get().partitionId()

    def ends(rows: np.ndarray, first: int) -> pa.RecordBatch:
        place = [pa.array(np.full(len(rows), part)), pa.array(np.arange(first, first + len(rows)))]
        return pa.record_batch([pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()), *place, *[pa.array(rows[:, i]) for i in range(5)]], ["a", "b", "part", "at", *LEAF])

    held, total = np.zeros((0, 5), np.int64), 0
    for batch in batches:
        own = np.column_stack([np.asarray(batch.column(n)) for n in LEAF]).astype(np.int64)
        if not total and len(own):
            yield ends(own[:NEIGHBOURS], 0)
        total += len(own)
        rows = np.concatenate([held, own])
        # pairs within the held rows were made with the last batch
        pairs = np.concatenate([_pairs_within(rows, d, max(0, len(held) - d)) for d in range(1, NEIGHBOURS + 1) if len(rows) > d] or [np.zeros((0, 2), np.int64)])
        once = np.unique(pairs, axis=0)
        yield pa.record_batch([pa.array(once[:, 0]), pa.array(once[:, 1]), *[pa.nulls(len(once), pa.int64()) for _ in range(7)]], ["a", "b", "part", "at", *LEAF])
        held = rows[-NEIGHBOURS:]
    if len(held):
        yield ends(held, total - len(held))


def candidates(distinct: DataFrame) -> DataFrame:
    """Pairs ``a < b`` that are neighbours in some tree of the forest.

    A tree is the sorted order of all signatures, read from one position on to the end and around. Neighbours share the longest prefix that any
    text shares with them; pairs with fewer than ``DEPTH`` common values, or too few common sketch bits, are left out.

    The depth of the order follows each region, the texts that share a tree's first ``DEPTH`` values. Most hold one text. In those of up to
    ``SMALL`` all pairs are taken, no order is needed, and nothing but these values travels. Only rows of crowded regions get deeper values
    of their signatures: as many groups of them as leave about ``SMALL`` texts of similarity 0.8 together, which grows with the logarithm of the region.
    Rows are range-partitioned, so a region may span tasks; what lies at the ends of partitions is counted once more.
    """
    bits = ["bits1", "bits2"]
    leaves = distinct.select("id", *bits, F.posexplode("trees").alias("tree", "hi")).select(F.col("tree").cast("long").alias("tree"), "hi", "id", *bits)
    order, schema = ["tree", "hi", "id"], ", ".join(f"{n} long" for n in FOUND)
    found = cut(leaves.repartitionByRange(*order).sortWithinPartitions("tree", "hi").mapInArrow(_regions, schema), "regions")
    ends = found.filter("id IS NOT NULL AND n IS NULL").drop("n")
    whole = cut(ends.groupBy("tree", "hi").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "ends")
    ends = join_dim(ends, whole, ["tree", "hi"], ["id"], "inner")
    near = ends.filter(F.col("n") <= SMALL).groupBy("tree", "hi").agg(F.array_sort(F.collect_list(F.struct("id", *bits))).alias("o"))
    near = near.select(F.explode("o").alias("x"), "o").select("x", F.explode("o").alias("y")).filter("x.id < y.id")
    differing = lambda x, y: sum(F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in bits)
    near = near.filter(differing("x", "y") <= HASHES - LEAST_BITS).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    pairs = found.filter("a IS NOT NULL").select("a", "b").unionByName(near)

    columns = ["tree", "hi", "id", *bits, "n"]
    crowded = cut(found.filter(F.col("n") > SMALL).select(columns).unionByName(ends.filter(F.col("n") > SMALL).select(columns)), "crowded")
    if not crowded.isEmpty():
        depth = F.least(F.lit(TREES - 1), F.ceil(F.log(F.col("n") / SMALL) / F.lit(-DEPTH * math.log(0.8)))).cast("int")
        deep = crowded.join(distinct.select("id", "trees"), "id").withColumn("tree_", F.col("tree").cast("int")).select(
            "tree", "hi", F.slice(F.expr(f"concat(slice(trees, tree_ + 2, {TREES}), slice(trees, 1, tree_))"), F.lit(1), depth).alias("rest"), "id", *bits)
        order = ["tree", "hi", "rest", "id"]
        kinds = "a long, b long, part long, at long, " + ", ".join(f"{n} long" for n in LEAF)
        sorted_ = deep.repartitionByRange(*order).sortWithinPartitions(*order).select(*LEAF).mapInArrow(_neighbours, kinds)
        sorted_ = cut(sorted_, "neighbours")
        seams = sorted_.filter("a IS NULL").select("part", "at", *LEAF).distinct()
        here, w = F.struct("id", "hi", *bits), W.partitionBy("tree").orderBy("part", "at")
        ahead = seams.withColumn("others", F.array(*[F.lead(here, d).over(w) for d in range(1, NEIGHBOURS + 1)]))
        ahead = ahead.select(F.struct("id", "hi", *bits).alias("x"), F.explode("others").alias("y"))
        across = ahead.filter((F.col("x.hi") == F.col("y.hi")) & (differing("x", "y") <= HASHES - LEAST_BITS))
        pairs = pairs.unionByName(sorted_.filter("a IS NOT NULL").select("a", "b")).unionByName(
            across.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")))
    return pairs.filter("a < b").distinct()


# ---- verification ----------------------------------------------------------------------------


def _verified(percent: int, all_pairs: int):
    def run(pairs: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        sets = dict(zip(texts["id"], shingle_sets(pa.array(texts["text"], pa.string(), from_pandas=True))))
        parent = {i: i for i in sets}

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def link(a: int, b: int) -> None:
            x, y = find(a), find(b)
            if x == y:
                return
            s, t = sets[a], sets[b]
            if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                return
            both = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
            if 100 * both >= percent * (len(s) + len(t) - both):
                parent[max(x, y)] = min(x, y)

        for a, b in zip(pairs["a"].tolist(), pairs["b"].tolist()):
            link(a, b)
        for _, own in pairs.groupby("cluster"):
            members = sorted({*own["a"], *own["b"]})
            if len(members) <= all_pairs and len({find(i) for i in members}) > 1:
                for i, a in enumerate(members):
                    for b in members[i + 1:]:
                        link(a, b)
        out = [(i, find(i)) for i in parent if find(i) != i]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def texts_of(wanted: DataFrame, mission_files: DataFrame, distinct: DataFrame, key: str, text: str) -> DataFrame:
    """The text (``id, text``) of every node of ``wanted``: of its smallest key, that text which has its set.

    Only texts that are needed are shuffled, whatever join Spark picks.
    """
    wanted = wanted.distinct().join(distinct.select("id", "first", "of_text"), "id")
    named = mission_files.select(mission_files[key].cast("long").alias("first"), mission_files[text].alias("text")).withColumn("of_text", F.xxhash64("text"))
    token = F.xxhash64("first", "of_text")
    named = named.filter(F.col("first").isNotNull()).filter(listed(wanted.select(token.alias("token")), token))
    return wanted.join(named, ["first", "of_text"]).dropDuplicates(["id"]).select("id", "text")


def verified_links(pairs: DataFrame, mission_files: DataFrame, distinct: DataFrame, key: str, text: str, percent: int,
                   task_bytes: int, all_pairs: int) -> DataFrame:
    """Links ``a, b`` that join up the same texts as all pairs of ``pairs`` (``cluster, part, a, b``) that hold on their whole sets.

    Texts travel once to every (cluster, part) that needs them. Several small ones share a group of about ``task_bytes``.
    """
    needed = pairs.select("cluster", "part", F.explode(F.array("a", "b")).alias("id")).distinct()
    sized = needed.join(distinct.select("id", "n_bytes"), "id")
    total = sized.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    group = F.pmod(F.xxhash64("cluster", "part"), F.lit(max(1, -(-total // task_bytes)))).alias("group")
    wanted = sized.select(group, "id").distinct()
    texts = wanted.join(texts_of(wanted.select("id"), mission_files, distinct, key, text), "id").select("group", "id", "text")
    return pairs.select(group, "cluster", "a", "b").groupBy("group").cogroup(texts.groupBy("group")).applyInPandas(
        _verified(percent, all_pairs), "a long, b long"
    )


# ---- clusters with texts that are still apart ------------------------------------------------


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets: hashes of few sets pair by pair, those of many as a product of matrices."""
    n = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    often = np.diff(np.concatenate([starts, [len(flat)]]))
    of_row = np.repeat(often, often)
    out = np.zeros((n, n), np.int64)
    rare = (of_row > 1) & (of_row <= COMMON)
    values, who = flat[rare], owner[rare]
    for d in range(1, COMMON):
        same = values[d:] == values[:-d]
        if not same.any():
            break
        out += np.bincount(who[:-d][same] * n + who[d:][same], minlength=n * n).reshape(n, n)
    out += out.T
    number = np.repeat(np.cumsum(often > COMMON) - 1, often)
    number, who = number[of_row > COMMON], owner[of_row > COMMON]
    for low in range(0, int((often > COMMON).sum()), 4096):
        own = slice(*np.searchsorted(number, [low, low + 4096]))
        holds = np.zeros((n, 4096), np.float32)
        holds[who[own], number[own] - low] = 1
        out += (holds @ holds.T).astype(np.int64)
    return out


def _joined(percent: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        sets = shingle_sets(pa.array(block["text"], pa.string(), from_pandas=True))
        ids, roots, size = block["id"].to_numpy(), block["root"].to_numpy(), np.array([len(s) for s in sets])
        while len(sets):  # prefix filter: whoever shares fewer hashes with all others together than a link needs is out
            values, often = np.unique(np.concatenate(sets), return_counts=True)
            shared = np.array([(often[np.searchsorted(values, s)] > 1).sum() for s in sets])
            keep = np.flatnonzero((100 * shared >= percent * size) & (size > 0))
            if len(keep) == len(sets):
                break
            ids, roots, size, sets = ids[keep], roots[keep], size[keep], [sets[i] for i in keep]
        out = []
        if len({*roots}) > 1:
            common = common_counts(sets)
            linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
            parent = {r: r for r in roots.tolist()}

            def find(i: int) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked & (roots[:, None] != roots[None, :]))))):
                x, y = find(int(roots[i])), find(int(roots[j]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((min(x, y), max(x, y)))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def apart_links(members: DataFrame, mission_files: DataFrame, distinct: DataFrame, key: str, text: str, percent: int,
                block_texts: int, block_bytes: int) -> DataFrame:
    """Links ``a, b`` between components, from all pairs of texts of a cluster that are still apart; ``members`` holds ``cluster, id, root``.

    Linked texts are equal or next in the classes of their sizes. A class of a cluster is dealt into salted blocks of bounded texts
    and bytes, those of the cluster's largest component into blocks of their own, which aren't compared among themselves. Each
    pair of blocks is one group, compared on whole sets.
    """
    step = max(math.log(100 / percent), 0.001) * 1.0001  # a bit more, for rounding
    parts = members.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(
        F.max_by("root", F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("parts")
    )
    open_ = members.join(parts.filter("parts > 1"), "cluster").join(distinct.select("id", "n_shingles", "n_bytes"), "id").select(
        "cluster", "id", "root", "n_bytes", F.floor(F.log("n_shingles") / step).alias("class"), (F.col("root") == F.col("most")).alias("most")
    )
    dealt = ["cluster", "class", "most"]
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block_texts), F.ceil(F.sum("n_bytes") / block_bytes)).cast("int")
    open_ = cut(open_, "apart")
    stock = cut(open_.groupBy(*dealt).agg(blocks.alias("blocks")), "blocks")
    salted = open_.join(stock, dealt).withColumn("salt", F.pmod(F.xxhash64("id", F.lit(5)), "blocks").cast("int"))
    x = stock.select("cluster", F.struct("class", "most").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    y = stock.select("cluster", F.struct("class", "most").alias("y"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    ahead, within = F.col("y.class") - F.col("x.class"), F.col("x.most") == F.col("y.most")
    pairs = x.join(y, "cluster").filter(~(F.col("x.most") & F.col("y.most"))).filter(
        (ahead == 1) | (ahead == 0) & (within & (F.col("i") <= F.col("j")) | (F.col("x.most") < F.col("y.most")))
    )
    sides = pairs.select(
        "cluster", F.xxhash64("cluster", "x", "i", "y", "j").alias("pair"),
        F.explode(F.array_distinct(F.array(F.struct("x.*", F.col("i").alias("salt")), F.struct("y.*", F.col("j").alias("salt"))))).alias("side"),
    ).select("cluster", "pair", "side.*")
    compared = salted.join(sides, [*dealt, "salt"]).select("pair", "id", "root")
    texts = texts_of(open_.select("id"), mission_files, distinct, key, text)
    return compared.join(texts, "id").groupBy("pair").applyInPandas(_joined(percent), "a long, b long")


def near_copies(mission_files: DataFrame, key: str = "file", text: str = "value", percent: int = 80, task_bytes: int = 1 << 23,
                small_cluster: int = 1000, all_pairs: int = 64, block_texts: int = 512, block_bytes: int = 1 << 21) -> DataFrame:
    """Classes of near copies among texts (mission files by a numeric ``file``): ``<key>, n_shingles, component_id, kept``, one row per row.

    A-Z is lower-cased, words are split at blanks, and a text's set holds its distinct 2-word shingles (the word itself, if it has one;
    sets are kept as 64-bit hashes). Texts are linked where ``100 * intersection >= percent * union``; ``component_id`` is the smallest key
    reachable over links and ``kept`` marks its row.

    Texts with equal sets are one class from the start, so copies never multiply. Neighbours in the LSH forest are candidates; a pair
    of similarity 0.8 shares a prefix in some tree with probability 1 - 3e-6. Candidates form clusters; those of up to ``small_cluster``
    texts are verified in one task each, including all pairs of clusters of up to ``all_pairs`` texts that fall apart. In a larger cluster every
    text is first compared with the cluster's smallest key, and only what isn't linked with it is compared with its own neighbours. In
    every cluster of over ``all_pairs`` texts all pairs that are then still apart are compared too, in blocks of about ``block_texts`` texts or
    ``block_bytes``: work that grows with the square of what stays apart in one cluster, within classes of like size.

    Null and empty texts have an empty set and are linked with nothing. Rows without a key take no part: their ``component_id`` is null
    and they are kept. Repeated rows get a row each; a repeated key is one node. An empty table gives an empty result.
    """
    sketched = cut(sketch(mission_files, key, text), "sketches")
    full = sketched.filter("n_shingles > 0 AND id IS NOT NULL")
    sets = ["print1", "print2", "n_shingles"]
    first = full.groupBy(*sets).agg(F.min_by(F.struct(F.col("id").alias("first"), "of_text", "bits1", "bits2", "trees", "n_bytes"), "id").alias("f"))
    # a node is a set; its number is unique once it is written
    distinct = cut(first.select(*sets, "f.*", F.monotonically_increasing_id().alias("id")), "distinct")
    pairs = cut(candidates(distinct), "pairs")
    roots = component_roots(pairs.select(F.lit(0).alias("map_id"), "a", "b")).select(F.col("a").alias("id"), F.col("root").alias("cluster"))
    of_pair = pairs.join(roots, pairs["b"] == roots["id"]).select("cluster", "a", "b")
    sizes = roots.groupBy("cluster").agg((F.count(F.lit(1)) + 1).alias("size"))
    large = sizes.filter(F.col("size") > small_cluster)
    parts = lambda of: F.pmod(F.xxhash64(of, F.lit(3)), F.greatest(F.lit(1), F.ceil(F.col("size") / 256))).cast("int").alias("part")
    verify = lambda p: verified_links(p, mission_files, distinct, key, text, percent, task_bytes, all_pairs)
    of_small = of_pair.join(large, "cluster", "left_anti").select("cluster", F.lit(0).alias("part"), "a", "b")
    of_large = roots.join(large, "cluster").select("cluster", parts("id"), F.col("cluster").alias("a"), F.col("id").alias("b"))
    links = cut(verify(cut(of_small.unionByName(of_large), "checks")), "links")
    if not large.isEmpty():
        linked = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        alone = roots.join(large, "cluster", "left_semi").join(linked, "id", "left_anti").select(F.col("id").alias("alone"))
        open_ = of_pair.join(large, "cluster").select("cluster", "size", "a", "b", F.explode(F.array("a", "b")).alias("alone"))
        rest = open_.join(alone, "alone", "left_semi").select("cluster", parts("a"), "a", "b").distinct()
        links = cut(links.unionByName(verify(cut(rest, "checks"))), "links")
    joined = component_roots(links.select(F.lit(0).alias("map_id"), "a", "b")).select(F.col("a").alias("id"), F.col("root"))
    crowded = sizes.filter(F.col("size") > all_pairs).select("cluster")
    if not crowded.isEmpty():
        members = roots.select("cluster", "id").unionByName(roots.select("cluster", F.col("cluster").alias("id")).distinct())
        members = members.join(crowded, "cluster", "left_semi").join(joined, "id", "left").withColumn("root", F.coalesce("root", "id"))
        more = cut(apart_links(members, mission_files, distinct, key, text, percent, block_texts, block_bytes), "apart-links")
        if not more.isEmpty():
            both = joined.select(F.lit(0).alias("map_id"), F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more.select(F.lit(0).alias("map_id"), "a", "b"))
            joined = component_roots(both).select(F.col("a").alias("id"), F.col("root"))
    # sets that share a key are one class too
    ends = [f(c).alias(f"{n}_{c}") for c in sets for n, f in (("least", F.min), ("most", F.max))]
    several = full.groupBy("id").agg(*ends).filter(" OR ".join(f"least_{c} <> most_{c}" for c in sets)).select("id")
    several = cut(several, "several")
    if not several.isEmpty():
        held = full.join(several, "id", "left_semi").select(F.col("id").alias("key"), *sets).join(distinct.select(*sets, "id"), sets).select("key", "id").distinct()
        held = cut(held, "held")
        star = held.join(held.groupBy("key").agg(F.min("id").alias("b")), "key").filter("id <> b").select(F.lit(0).alias("map_id"), F.col("id").alias("a"), "b")
        joined = component_roots(joined.select(F.lit(0).alias("map_id"), F.col("id").alias("a"), F.col("root").alias("b")).unionByName(star.distinct()))
        joined = joined.select(F.col("a").alias("id"), F.col("root"))
    rooted = distinct.select(*sets, "first", "id").join(joined, "id", "left").withColumn("root", F.coalesce("root", "id"))
    rooted = cut(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    classes = rooted.join(smallest, "root").select(*sets, "component")
    # an empty text belongs to the class of the other texts of its key
    bare = sketched.filter("n_shingles = 0 AND id IS NOT NULL").select("id").distinct()
    of_key = full.join(bare, "id", "left_semi").select("id", *sets).join(classes, sets).groupBy("id").agg(F.min("component").alias("of_key"))
    some, none = sketched.filter("n_shingles > 0"), sketched.filter("n_shingles = 0")
    kept = some.select("id", *sets).join(classes, sets, "left").unionByName(
        none.select("id", *sets).join(cut(of_key, "of-key"), "id", "left").withColumn("component", F.coalesce("of_key", "id")).drop("of_key")
    ).withColumn("component_id", F.when(F.col("id").isNotNull(), F.col("component")))
    return kept.select(
        F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
