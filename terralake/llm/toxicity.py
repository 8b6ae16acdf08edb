"""Toxic spans in mission texts by a linear-chain conditional random field, and scores of whole texts from its marginals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, LOWER, mix, row_groups, text_bytes, word_bounds, word_hashes

SLOTS = 1 << 17
PREFIXES = (3, 4, 5, 6)
OWN = 1 + len(PREFIXES)  # word and prefixes: what token labels are derived from
BLOCK = 32
TINY = 1e-9


# ---- words and their features ----------------------------------------------------------------


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes of all texts, starts and ends of their words, and the number of the first word of every text (and of none)."""
    data, offsets = text_bytes(texts)
    starts, ends = word_bounds(data, offsets, ALNUM)
    return LOWER[data], starts, ends, np.searchsorted(starts, offsets)


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of 64-bit feature keys per word: the word, its beginnings, its end, its length, and the words next to it in its text."""
    if not len(starts):
        return np.zeros((0, OWN + 4), np.uint64)
    words = word_hashes(data, starts, ends)
    out = np.empty((len(starts), OWN + 4), np.uint64)

    def put(i: int, key: np.ndarray) -> None:
        out[:, i] = mix(key * np.uint64(16) + np.uint64(i))

    put(0, words)
    key, kept = np.zeros(len(starts), np.uint64), 1
    for k in range(max(PREFIXES)):
        key = key << np.uint64(8) | np.where(starts + k < ends, data[np.minimum(starts + k, len(data) - 1)], 0).astype(np.uint64)
        if k + 1 in PREFIXES:
            put(kept, key)
            kept += 1
    key[:] = 0
    for k in range(1, 4):
        key = key << np.uint64(8) | np.where(ends - k >= starts, data[np.maximum(ends - k, 0)], 0).astype(np.uint64)
    put(OWN, key)
    put(OWN + 1, np.minimum(ends - starts, 24).astype(np.uint64))
    edge = first[first < len(words)]
    key[0], key[1:] = 0, words[:-1]
    key[edge] = 0
    put(OWN + 2, key)
    key[-1], key[:-1] = 0, words[1:]
    key[edge[edge > 0] - 1] = 0
    put(OWN + 3, key)
    return out


def slots(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(SLOTS - 1)).astype(np.int32)


def scores(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Sum of the weights of every word's features."""
    out = np.zeros(len(features))
    for k in range(features.shape[1]):
        out += weights[features[:, k]]
    return out


# ---- forward and backward --------------------------------------------------------------------


def _products(m: list[np.ndarray], reverse: bool) -> list[np.ndarray]:
    """Products of the 2 x 2 matrices ``m`` (entries as arrays of blocks by steps) from the start, or the end, of each block up to every step."""
    out = [np.empty_like(x) for x in m]
    steps = range(m[0].shape[1] - 1, -1, -1) if reverse else range(m[0].shape[1])
    last = None
    for t in steps:
        a = [x[:, t] for x in m]
        if last is not None:
            p, q = (a, last) if reverse else (last, a)
            a = [p[0] * q[0] + p[1] * q[2], p[0] * q[1] + p[1] * q[3], p[2] * q[0] + p[3] * q[2], p[2] * q[1] + p[3] * q[3]]
            top = np.maximum(np.maximum(a[0], a[1]), np.maximum(a[2], a[3]))
            a = [x / top for x in a]
        for x, y in zip(out, a):
            x[:, t] = y
        last = a
    return out


def forward_backward(score: np.ndarray, first: np.ndarray, model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Marginal probability of the toxic label of every word, and expected numbers of label pairs of neighbours.

    All texts are one chain: the first word of a text (numbers in ``first``) forgets what was before it. The chain is cut into blocks of equal
    length; products inside all blocks are taken at once, then the blocks are passed in order, in either direction.
    """
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    blocks = -(-n // BLOCK)
    emit = [np.exp(np.minimum(0, -score)), np.exp(np.minimum(0, score))]
    move, start = np.exp(model["move"]), np.exp(model["first"])
    begins = np.zeros(n, bool)
    begins[first[first < n]] = True
    m = []
    for i in (0, 1):
        for j in (0, 1):
            x = np.full(blocks * BLOCK, float(i == j))
            x[:n] = np.where(begins, start[j], move[i, j]) * emit[j]
            m.append(x.reshape(blocks, BLOCK))
    ahead, behind = _products(m, False), _products(m, True)

    def chain(whole: list[np.ndarray], order: range, row: bool) -> np.ndarray:
        """Vector at the edge of every block."""
        out, v = np.empty((blocks, 2)), (0.5, 0.5)
        parts = [x.tolist() for x in whole]
        for c in order:
            out[c] = v
            a, b, d, e = (x[c] for x in parts)
            v = (v[0] * a + v[1] * d, v[0] * b + v[1] * e) if row else (a * v[0] + b * v[1], d * v[0] + e * v[1])
            total = v[0] + v[1]
            v = (v[0] / total, v[1] / total)
        return out

    left = chain([x[:, -1] for x in ahead], range(blocks), True)
    right = chain([x[:, 0] for x in behind], range(blocks - 1, -1, -1), False)
    alpha = [left[:, :1] * ahead[j] + left[:, 1:] * ahead[2 + j] for j in (0, 1)]
    beta = []
    for i in (0, 1):
        x = np.empty((blocks, BLOCK))
        x[:, :-1] = behind[2 * i][:, 1:] * right[:, :1] + behind[2 * i + 1][:, 1:] * right[:, 1:]
        x[:, -1] = right[:, i]
        beta.append(x)
    alpha, beta = [x.reshape(-1)[:n] for x in alpha], [x.reshape(-1)[:n] for x in beta]
    both = [a * b for a, b in zip(alpha, beta)]
    toxic = both[1] / (both[0] + both[1])
    pairs = [alpha[i][:-1] * m[2 * i + j].reshape(-1)[1:n] * beta[j][1:] for i in (0, 1) for j in (0, 1)]
    inner = ~begins[1:]
    total = sum(pairs)
    return toxic, np.array([(p[inner] / total[inner]).sum() for p in pairs]).reshape(2, 2)


# ---- training --------------------------------------------------------------------------------


def label_words(keys: np.ndarray, first: np.ndarray, toxic: np.ndarray, surprise: float = 10.0, share: float = 0.9) -> np.ndarray:
    """Labels of all words from labels of whole texts.

    A word of a toxic text is labelled where it, or one of its beginnings, occurs almost only in toxic texts (``share``), and in more of them than
    chance explains: ``surprise`` is the log-likelihood ratio against the share of toxic texts among all, in nats. Texts count by the
    different words around it, so that copies of a toxic text don't make all its words suspicious.
    """
    text = np.searchsorted(first[1:], np.arange(len(keys)), "right")
    prior = min(max(toxic.mean() if len(toxic) else 0.0, TINY), 1 - TINY)
    found = np.zeros(len(keys), bool)
    context = mix(keys[:, -2] * np.uint64(3) + keys[:, -1])
    for k in range(OWN):
        names, number = np.unique(keys[:, k], return_inverse=True)
        seen = np.unique(number.astype(np.int64) * max(1, len(toxic)) + text)
        name, where = seen // max(1, len(toxic)), seen % max(1, len(toxic))
        n, bad = np.bincount(name, minlength=len(names)), np.bincount(name, toxic[where], minlength=len(names))
        q = bad / np.maximum(n, 1)
        gain = bad * np.log(np.maximum(q, TINY) / prior) + (n - bad) * np.log(np.maximum(1 - q, TINY) / (1 - prior))
        held = np.flatnonzero(((q >= share) & (gain >= surprise))[number] & toxic[text].astype(bool))
        around = np.unique(np.stack([number[held].astype(np.uint64), context[held]]), axis=1)[0].astype(np.int64)
        places = np.bincount(around, minlength=len(names))
        found[held] |= (gain * np.minimum(1, places / np.maximum(bad, 1)) >= surprise)[number[held]]
    return found


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 25, ridge: float = 0.01) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4.0 / max(TINY, np.abs(step).max()))
    return w


def evidence(toxic: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected number of toxic words, and the highest marginal, of every text."""
    sums = np.append(0, np.cumsum(toxic))
    total = np.maximum(sums[first[1:]] - sums[first[:-1]], 0)
    top = np.zeros(len(first) - 1)
    filled = np.flatnonzero(first[1:] > first[:-1])
    if len(filled):
        top[filled] = np.maximum.reduceat(toxic, first[:-1][filled])
    return total, top


def _features(total: np.ndarray, top: np.ndarray) -> np.ndarray:
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.column_stack([np.log(total + 1e-3), np.log(top / (1 - top)), top])


def train_toxicity(labelled: pd.DataFrame, rounds: int = 25, rate: float = 0.3, decay: float = 1e-5) -> dict[str, np.ndarray]:
    """The field and the weights of its evidence, from rows ``text, toxic``.

    Words are labelled by ``label_words`` over all rows. The field is fitted to the toxic rows and as many others, by AdaGrad steps on the
    gradient of the likelihood (forward-backward over all of them at once); the logistic weights that turn the evidence of a text into
    its score are fitted to all rows. Without rows of both kinds, scores are the share of toxic rows (0 without any).
    """
    y = labelled["toxic"].to_numpy(float)
    texts = pa.array(labelled["text"].tolist(), pa.string())
    data, starts, ends, first = words_of(texts)
    keys = word_keys(data, starts, ends, first)
    tags = label_words(keys, first, y)
    own = slots(keys)
    del keys

    model = {"emit": np.zeros(SLOTS), "move": np.zeros((2, 2)), "first": np.zeros(2), "score": np.array([-30.0, 0, 0, 0])}
    if len(y) and not 0 < y.sum() < len(y):
        model["score"][0] = 30.0 if y.all() else -30.0
    if not 0 < y.sum() < len(y):
        return model
    bad = np.flatnonzero(y == 1)
    chosen = np.zeros(len(y), bool)
    chosen[bad] = True
    chosen[np.flatnonzero(y == 0)[:len(bad)]] = True
    text = np.searchsorted(first[1:], np.arange(len(own)), "right")
    part = chosen[text]
    x, t = own[part], tags[part].astype(int)
    begins = np.searchsorted(np.flatnonzero(part), first[:-1][chosen])
    start_of = np.unique(begins[begins < len(x)])
    inner = np.ones(len(x), bool)
    inner[start_of] = False
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (t[:-1][inner[1:]], t[1:][inner[1:]]), 1)
    seen = {n: np.full_like(model[n], 1e-6) for n in ("emit", "move", "first")}
    for _ in range(rounds if len(x) else 0):
        p, moves = forward_backward(scores(model["emit"], x), start_of, model)
        wrong = p - t
        grads = {"emit": np.zeros(SLOTS), "move": moves - pairs}
        for k in range(x.shape[1]):
            grads["emit"] += np.bincount(x[:, k], wrong, minlength=SLOTS)
        bias = wrong[start_of].sum()
        grads["first"] = np.array([-bias, bias])
        for n, g in grads.items():
            g = g / len(bad) + decay * model[n]
            seen[n] += g * g
            model[n] -= rate * g / np.sqrt(seen[n])
    toxic, _ = forward_backward(scores(model["emit"], own), first[:-1], model)
    model["score"] = _logistic(_features(*evidence(toxic, first)), y)
    return model


def toxicity_sample(missions: DataFrame, verdicts: DataFrame, key: str = "mission", text: str = "label", toxic: str = "toxic",
                    most: int = 2500) -> pd.DataFrame:
    """Labelled rows ``text, toxic`` to train on: those of at most ``most`` verdicts, and at most as many rows, with the smallest hashes of their keys.

    The bound is a number of rows, not a share; the sample doesn't depend on how the tables lie in files.
    """
    asked = verdicts.select(verdicts[key].alias("key"), verdicts[toxic].cast("int").alias("toxic")).filter("key IS NOT NULL AND toxic IN (0, 1)")
    few = asked.distinct().orderBy(F.xxhash64("key"), "key", "toxic").limit(most)
    rows = missions.select(missions[key].alias("key"), F.coalesce(missions[text], F.lit("")).alias("text")).join(F.broadcast(few), "key")
    return rows.orderBy(F.xxhash64("key"), "key", "toxic", F.xxhash64("text")).limit(most).select("text", "toxic").toPandas()


# ---- on tables -------------------------------------------------------------------------------


def tag_toxic(missions: DataFrame, model: dict[str, np.ndarray], key: str = "mission", text: str = "label") -> DataFrame:
    """Toxic words in the texts that people write for missions (labels by ``mission``), and a score of every text.

    One row per row of ``missions``: ``<key>``; ``n_words``, its runs of letters and digits; ``expected``, the expected number of toxic ones, and ``top``, the
    highest marginal probability; ``spans``, the offending offsets as ``start:end``, comma-joined, in code points, end exclusive: neighbouring words
    whose marginal is at least a half are one span; ``score``, between 0 and 1, from ``expected`` and ``top``; ``predicted``, 1 if it is at least a half.

    The whole text counts, whatever its length. Null and empty texts have no words and get the score of a text without evidence. Repeated rows
    and null keys give a row each, an empty table none; further columns are ignored. Memory holds about half a megabyte of texts, or one longer one.
    """
    kind = dict(missions.dtypes)[key]
    shared = missions.sparkSession.sparkContext.broadcast(model)

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for low, high in row_groups(text_bytes(batch.column(1))[1]):
                some = batch.slice(low, high - low)
                raw, offsets = text_bytes(some.column(1))
                data, starts, ends, first = words_of(some.column(1))
                x = slots(word_keys(data, starts, ends, first))
                toxic, _ = forward_backward(scores(fitted["emit"], x), first[:-1], fitted)
                total, top = evidence(toxic, first)
                z = np.column_stack([np.ones(len(total)), _features(total, top)]) @ fitted["score"]
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                columns = [some.column(0), pa.array(np.diff(first)), pa.array(total), pa.array(top),
                           pa.array(_spans(raw, offsets, starts, ends, first, toxic >= 0.5)), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
                yield pa.record_batch(columns, ["key", "n_words", "expected", "top", "spans", "score", "predicted"])

    named = missions.select(missions[key].alias("key"), missions[text].alias("text"))
    columns = f"key {kind}, n_words long, expected double, top double, spans string, score double, predicted int"
    return named.mapInArrow(tagged, columns).withColumnRenamed("key", key)


def _spans(raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hit: np.ndarray) -> list[str]:
    """Runs of marked words as code point offsets, one string per text."""
    out: list[list[str]] = [[] for _ in offsets[1:]]
    marked = np.flatnonzero(hit)
    if len(marked):
        points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
        text = np.searchsorted(first[1:], marked, "right")
        fresh = np.ones(len(marked), bool)
        fresh[1:] = (np.diff(marked) != 1) | (np.diff(text) != 0)
        begin = np.flatnonzero(fresh)
        end = np.append(begin[1:], len(marked)) - 1
        for t, s, e in zip(text[begin], starts[marked[begin]], ends[marked[end]]):
            out[t].append(f"{points[s] - points[offsets[t]]}:{points[e] - points[offsets[t]]}")
    return [",".join(o) for o in out]
