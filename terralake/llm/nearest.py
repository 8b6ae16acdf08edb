"""Exact search for the highest inner products, with a KD-tree per shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def whole_steps(vector: Column, scale: float = 1024.0) -> Column:
    """``floor(scale * x)`` of every component as BIGINT; null where the vector, or a component, is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long")))


class Tree:
    """KD-tree over the rows of ``vectors``: median splits along the widest side of tight bounding boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = 128):
        order = np.lexsort((ids,))
        ids, vectors = ids[order], vectors[order]
        low, high, span, children, least = [], [], [], [], []
        at = np.arange(len(ids))
        waiting = [(0, len(ids), -1, 0)]
        while waiting:
            start, end, parent, side = waiting.pop()
            own = vectors[at[start:end]]
            node = len(span)
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            span.append((start, end))
            children.append([-1, -1])
            least.append(int(ids[at[start:end]].min()))
            if parent >= 0:
                children[parent][side] = node
            width = high[node] - low[node]
            if end - start > leaf and own.shape[1] and width.max() > 0:
                middle = (end - start) // 2
                at[start:end] = at[start:end][np.argpartition(own[:, int(width.argmax())], middle)]
                waiting += [(start, start + middle, node, 0), (start + middle, end, node, 1)]
        self.ids, self.vectors = ids[at], vectors[at]
        self.low, self.high, self.span, self.children, self.least = np.array(low), np.array(high), span, children, least

    def reach(self, query: np.ndarray, nodes: list[int]) -> np.ndarray:
        """No vector inside a node's box has a higher inner product with the query."""
        return np.maximum(self.low[nodes] * query, self.high[nodes] * query).sum(axis=1)

    def search(self, own: int, query: np.ndarray, k: int, bound: tuple[int, int] | None) -> list[tuple[int, int]]:
        """The up to ``k`` best ``(score, id)`` that beat ``bound``, a k-th score and id found elsewhere; ties go to smaller ids.

        Best-first: the open node that could hold the highest score comes next, until none can beat the k-th result.
        """
        best: list[tuple[int, int]] = []  # heap of (score, -id), worst first
        worst = (bound[0], -bound[1]) if bound else (-np.inf, 0)
        waiting = [(-self.reach(query, [0])[0], 0)]
        while waiting and -waiting[0][0] >= worst[0]:
            top, node = heapq.heappop(waiting)
            if (-top, -self.least[node]) <= worst:
                continue
            if self.children[node][0] >= 0:
                for score, child in zip(self.reach(query, self.children[node]), self.children[node]):
                    if (score, -self.least[child]) > worst:
                        heapq.heappush(waiting, (-score, child))
                continue
            start, end = self.span[node]
            scores = self.vectors[start:end] @ query
            for i in np.flatnonzero(scores >= worst[0]):
                found = (int(scores[i]), -int(self.ids[start + i]))
                if found > worst and -found[1] != own:
                    (heapq.heappush if len(best) < k else heapq.heappushpop)(best, found)
                    if len(best) == k:
                        worst = max(worst, best[0])
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _search(k: int, leaf: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            vectors, asked = np.stack(rows["v"].to_list()), np.stack(queries["q_v"].to_list())
            largest = max(int(np.abs(vectors).max(initial=0)), 1) * max(int(np.abs(asked).max(initial=0)), 1)
            if largest * max(1, vectors.shape[1]) < 1 << 53:  # then doubles are exact, and fast
                vectors, asked = vectors.astype(float), asked.astype(float)
            tree = Tree(rows["id"].to_numpy(np.int64), vectors, leaf)
            for own, q, s, i in zip(queries["q_id"], asked, queries["bound"], queries["bound_id"]):
                out += [(own, i2, s2) for s2, i2 in tree.search(own, q, k, None if pd.isna(s) else (int(s), int(i)))]
        return pd.DataFrame(out, columns=["query", "id", "score"]).astype("int64")

    return run


def highest_products(textures: DataFrame, queries: Column, key: str = "entry_idx", vector: str = "features", k: int = 10,
                     scale: float = 1024.0, shard_rows: int = 1 << 14, block_rows: int = 1 << 11, leaf: int = 128) -> DataFrame:
    """The ``k`` texture records whose feature vectors have the highest inner product with each query's: ``query_id, rank, id, score``.

    ``queries`` is a condition on the rows of ``textures``. Components become ``floor(scale * x)``, so scores are exact integers, which
    must fit 64 bits. Candidates of a query are all records but those with its own key; ranks count from 1, ties go to the smaller key.
    Records without a key or a finite vector take no part. A record given twice is two candidates, a query given twice one query. Vectors are compared with
    vectors of their own length only. An empty table, or one without queries, gives an empty result.

    Records are spread over shards of about ``shard_rows`` rows and queries over blocks of ``block_rows``; a task searches one shard for one
    block. First every query searches one shard; its k-th score and key are then passed on to all other shards, which return
    only what beats them.
    """
    steps = whole_steps(F.col(vector), scale)
    records = cut(
        textures.select(F.col(key).cast("long").alias("id"), steps.alias("v"), queries.alias("asked"))
        .filter("id IS NOT NULL AND v IS NOT NULL").withColumn("dims", F.size("v")), "vectors",
    )
    counts = records.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("asked").cast("long")), F.lit(0)).alias("q")).first()
    shards, blocks = max(1, -(-counts["n"] // shard_rows)), max(1, -(-counts["q"] // block_rows))
    spread = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    rows = records.withColumn("shard", spread(shards, 1)).select("dims", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v")
    asked = records.filter("asked").select(
        F.col("dims").alias("q_dims"), spread(shards, 1).alias("home"), spread(blocks, 2).alias("q_block"), F.col("id").alias("q_id"), F.col("v").alias("q_v")
    ).dropDuplicates(["q_id", "q_v"])
    none = {"bound": F.lit(None).cast("long"), "bound_id": F.lit(None).cast("long")}

    def search(some: DataFrame) -> DataFrame:
        return some.groupBy("q_dims", "q_shard", "q_block").cogroup(rows.groupBy("dims", "shard", "block")).applyInPandas(_search(k, leaf), "query long, id long, score long")

    first = cut(search(asked.withColumnsRenamed({"home": "q_shard"}).withColumns(none)), "first")
    if shards > 1:
        kth = first.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("score", (-F.col("id")).alias("id"))).alias("w"))
        kth = kth.filter(F.col("n") >= k).select(F.col("query").alias("q_id"), F.col("w.score").alias("bound"), (-F.col("w.id")).alias("bound_id"))
        others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))
        bounded = asked.join(kth, "q_id", "left").withColumn("q_shard", F.explode(others)).drop("home")
        first = first.unionByName(search(bounded))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "id", "score")
