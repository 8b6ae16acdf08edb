"""Document quality by hierarchical empirical Bayes: classifier evidence, and host and path priors that borrow from each other."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import fresh
from .words import INK, row_groups, text_bytes, word_bounds, word_hashes

#: Classes of bytes whose shares of a text are features.
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".", b",;:", b"!?", b"|", b"#$%&*@^~", b"<>[]{}()/\\=_+-", b"\"'`"]
CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _i, _c in enumerate(CLASSES):
    CLASS_OF[list(_c)] = _i
N_CLASSES = len(CLASSES) + 1
N_FEATURES = N_CLASSES + 6
BINS = 32


def _log_bin(share: np.ndarray) -> np.ndarray:
    """Half powers of two of a share, from 2^-15 up."""
    return np.clip(np.floor(2 * np.log2(np.maximum(share, 2.0**-15.5)) + BINS - 1), 0, BINS - 1)


def _per_row(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Number of distinct values in every row."""
    if not len(values):
        return np.zeros(rows, np.int64)
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=rows)


def text_features(texts: pa.Array) -> np.ndarray:
    """Feature bins of whole texts, ``N_FEATURES`` a row: shares of byte classes, lengths of the text, its words and lines, and repetition."""
    out = []
    for low, high in row_groups(text_bytes(texts)[1]):
        data, offsets = text_bytes(texts.slice(low, high - low))
        rows, size = high - low, np.diff(offsets)
        row = np.repeat(np.arange(rows), size)
        shares = np.bincount(row * N_CLASSES + CLASS_OF[data], minlength=rows * N_CLASSES).reshape(rows, N_CLASSES) / np.maximum(size, 1)[:, None]
        starts, ends = word_bounds(data, offsets, INK)
        own = np.searchsorted(offsets, starts, "right") - 1
        words = np.bincount(own, minlength=rows)
        not_newline = np.ones(256, bool)
        not_newline[10] = False
        line_starts, line_ends = word_bounds(data, offsets, not_newline)
        line_of = np.searchsorted(offsets, line_starts, "right") - 1
        lines = np.bincount(line_of, minlength=rows)
        letters = np.isin(CLASS_OF[data[ends - 1]], (0, 1, N_CLASSES - 1))
        plain = np.bincount(own[letters], minlength=rows)
        ratio = lambda a, b: a / np.maximum(b, 1)
        more = [
            np.clip(np.floor(2 * np.log2(size + 1.0)), 0, BINS - 1), np.clip(np.floor(4 * np.log2(ratio(np.bincount(own, ends - starts, rows), words) + 1)), 0, BINS - 1),
            np.clip(np.floor(2 * np.log2(ratio(words, lines) + 1)), 0, BINS - 1), np.floor(ratio(_per_row(word_hashes(data, starts, ends), own, rows), words) * (BINS - 1)),
            np.floor(ratio(_per_row(word_hashes(data, line_starts, line_ends), line_of, rows), lines) * (BINS - 1)), np.floor(ratio(plain, words) * (BINS - 1)),
        ]
        out.append(np.column_stack([_log_bin(shares), *more]))
    return np.concatenate(out).astype(np.int8) if out else np.zeros((0, N_FEATURES), np.int8)


def feature_bins(text: str) -> Column:
    """Feature bins of a text column; a null text counts as empty."""
    @F.pandas_udf("array<tinyint>")
    def bins(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(list(text_features(pa.array(batch, pa.string(), from_pandas=True))), index=batch.index, dtype=object)

    return bins(F.col(text))


@dataclass
class Evidence:
    """Log-odds of every feature bin (``N_FEATURES`` x ``BINS``), and the prior odds' share."""

    weights: np.ndarray
    bias: float
    prior: float

    def log_odds(self, bins: str | None = None, text: str | None = None) -> Column:
        """Evidence of a document, without any prior, from its feature bins or from its text."""
        weights, bias = self.weights, self.bias

        @F.pandas_udf("double")
        def evidence(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype=float)
            own = text_features(pa.array(values, pa.string(), from_pandas=True)) if bins is None else np.stack(values.to_list())
            return pd.Series(weights[np.arange(N_FEATURES), own.astype(int)].sum(axis=1) + bias, index=values.index)

        return evidence(F.col(bins or text))


def fit_evidence(labelled: DataFrame, rounds: int = 300, rate: float = 0.5, ridge: float = 2e-3, most: int = 20_000) -> Evidence:
    """Weights of feature bins from all rows ``bins, label`` (label 0 or 1): a logistic fit whose input is grouped.

    A distributed pass per feature gives the bins' counts, from which a naive Bayes start is made. For the logistic refinement equal rows are
    counted first; it runs on at most ``most`` distinct rows, the ones with the smallest hash of their bins, each weighted by its count.
    """
    each = labelled.select("label", F.posexplode("bins").alias("feature", "bin"))
    counts = each.groupBy("label", "feature", "bin").count().toPandas()  # at most 2 x N_FEATURES x BINS rows
    table = np.zeros((2, N_FEATURES, BINS))
    table[counts["label"].to_numpy(int), counts["feature"].to_numpy(int), counts["bin"].to_numpy(int)] = counts["count"]
    totals = table.sum(axis=2, keepdims=True)
    if not totals.all():
        share = float(totals[1, 0, 0] / max(1, totals[:, 0, 0].sum())) if totals.any() else 0.5
        return Evidence(np.zeros((N_FEATURES, BINS)), 0.0, min(max(share, 0.01), 0.99))
    prior = float(totals[1, 0, 0] / totals[:, 0, 0].sum())
    log = np.log((table + 0.5) / (totals + 0.5 * BINS))
    weights, bias = (log[1] - log[0]) / N_FEATURES, 0.0
    rows = labelled.groupBy("label", "bins").count().orderBy(F.xxhash64("bins"), "label").limit(most).toPandas()
    x, y = np.stack(rows["bins"].to_list()).astype(int), rows["label"].to_numpy(float)
    share = rows["count"].to_numpy(float) / rows["count"].sum()
    columns, squares = np.arange(N_FEATURES), np.full((N_FEATURES, BINS), 1e-6)
    base, bias_square = np.log(prior / (1 - prior)), 1e-6
    for _ in range(rounds):
        wrong = (1 / (1 + np.exp(-(weights[columns, x].sum(axis=1) + bias + base))) - y) * share
        grad = np.zeros_like(weights)
        np.add.at(grad, (np.broadcast_to(columns, x.shape), x), np.broadcast_to(wrong[:, None], x.shape))
        grad += ridge * weights / N_FEATURES
        squares += grad * grad
        weights = weights - rate * grad / np.sqrt(squares)
        bias_square += wrong.sum() ** 2
        bias -= rate * wrong.sum() / np.sqrt(bias_square)
    return Evidence(weights, float(bias), prior)


def _strength(spread: float, noise: float, groups: float, weight: float) -> float:
    """Pseudo-rows of a Beta prior by the method of moments: large where groups differ no more than chance has it."""
    between = (spread - groups * noise) / weight if weight > 0 else 0.0
    return float(min(max(noise / between - 1, 1.0), 1e6)) if between > 0 else 1e6


def site_priors(judged: DataFrame, prior: float, host: str = "host", path: str = "path") -> DataFrame:
    """``host, path, host_prior, site_prior`` from rows ``host, path, share``, where ``share`` is a document's chance to be good.

    A path is shrunk toward its host and a host toward the global prior, as strongly as the spread between paths and between hosts
    tells. Only sums per path are shuffled, then sums per host, and one row of totals reaches the driver.
    """
    paths = judged.groupBy(host, path).agg(F.count(F.lit(1)).alias("n"), F.sum("share").alias("s"))
    hosts = paths.groupBy(host).agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum(F.col("n") * F.col("n")).alias("hnn"), F.count(F.lit(1)).alias("k"))
    both = paths.join(hosts, paths[host].eqNullSafe(hosts[host])).drop(hosts[host])
    own, mean = F.col("s") / F.col("n"), F.col("hs") / F.col("hn")
    t = hosts.agg(
        F.sum("hn").alias("n"), F.sum(F.col("hn") * (mean - prior) ** 2).alias("spread"), F.sum(F.col("hn") ** 2).alias("squares"),
        F.count(F.lit(1)).alias("groups"), F.sum("k").alias("paths"), F.sum(F.col("hnn") / F.col("hn")).alias("inner"),
    ).first()
    within = both.agg(F.sum(F.col("n") * (own - mean) ** 2).alias("spread")).first()["spread"] or 0.0
    n, noise = t["n"] or 0, prior * (1 - prior)
    strong = _strength(t["spread"] or 0.0, noise, max(0, (t["groups"] or 0) - 1), n - (t["squares"] or 0) / n if n else 0)
    weak = _strength(within, noise, (t["paths"] or 0) - (t["groups"] or 0), n - (t["inner"] or 0))
    host_prior = (F.col("hs") + strong * prior) / (F.col("hn") + strong)
    return both.withColumn("host_prior", host_prior).select(
        host, path, "host_prior", ((F.col("s") + weak * F.col("host_prior")) / (F.col("n") + weak)).alias("site_prior")
    )


def judge_quality(documents: DataFrame, evidence: Evidence, priors: DataFrame, host: str = "host", path: str = "path", bins: str = "bins",
                  text: str | None = None, least: float = 0.5) -> DataFrame:
    """All columns of ``documents`` but ``bins``, plus ``evidence, site_prior, quality, keep``.

    The evidence comes from ``bins``, or from the column ``text`` where that is given. ``quality`` is the chance that a document is good: its site's prior odds times the odds of its evidence; ``keep`` where it is ``least``
    or more. A site without priors has the global one. Columns with the names of results are replaced.
    """
    results = ("evidence", "host_prior", "site_prior", "quality", "keep", bins)
    kept = [c for c in documents.columns if c not in results]
    h, p, prior, found = (fresh(n, documents) for n in ("_host", "_path", "_prior", "_evidence"))
    sites = priors.select(priors[host].alias(h), priors[path].alias(p), priors["site_prior"].alias(prior))
    scored = documents.withColumn(found, evidence.log_odds(None if text else bins, text))
    joined = scored.join(sites, F.col(host).eqNullSafe(F.col(h)) & F.col(path).eqNullSafe(F.col(p)), "left")
    site = F.coalesce(prior, F.lit(evidence.prior))
    site = F.least(F.greatest(site, F.lit(1e-6)), F.lit(1 - 1e-6))
    quality = 1 / (1 + F.exp(-(F.col(found) + F.log(site / (1 - site)))))
    return joined.select(*kept, F.col(found).alias("evidence"), site.alias("site_prior"), quality.alias("quality")).withColumn("keep", F.col("quality") >= least)


def fit_quality(documents: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", host: str = "host",
                path: str = "path", bins: str = "bins") -> tuple[Evidence, DataFrame]:
    """Classifier and site priors of ``documents`` (``key, host, path, bins``) from the labels of some of them.

    The studied project has no hosts or rated texts; this operator is general. Any two columns can be host and path. Labels other than 0
    and 1, and null keys, are ignored; without labels of both kinds the evidence is 0. Labelled documents count in their site with their
    label, all others with the classifier's chance under the global prior. Null hosts or paths form a site of their own.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("label"))
    rated = documents.join(known, key, "left")
    evidence = fit_evidence(rated.filter("label IS NOT NULL").select("label", F.col(bins).alias("bins")))
    base = float(np.log(evidence.prior / (1 - evidence.prior)))
    share = F.coalesce(F.col("label").cast("double"), 1 / (1 + F.exp(-(evidence.log_odds(bins) + base))))
    return evidence, site_priors(rated.select(host, path, share.alias("share")), evidence.prior, host, path)
