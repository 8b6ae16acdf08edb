"""Personal data in texts: fixed patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
FEATURES = 1 << 13

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
HIT = re.compile(r"[0-9@]\S*+")
DIGIT = re.compile("[0-9]")
EDGES = ".,;:!?\"'|*#%$&<>[]{}"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the fixed patterns, by start, then kind as listed; leftmost and non-overlapping per kind.

    A pattern is searched once from the left; a match that fails its own test (a part over 255, the number of digits, the check
    digit) is dropped and not tried again. Every search takes time in proportion to the text.
    """
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end, "email"))
        at = text.find("@", at + 1)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                found.append((*m.span(), "ip"))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(DIGIT.findall(m[0])) <= 15:
                    found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def shape(word: str) -> str:
    return re.sub("a+", "a", re.sub("A+", "A", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", word)))))


def _feature(text: str) -> int:
    return int.from_bytes(hashlib.blake2s(text.encode("utf-8", "replace"), digest_size=4).digest(), "little") % FEATURES


def token_features(before: str, words: Sequence[str]) -> list[list[int]]:
    """Features of the words of one run; ``before`` is the word in front of it.

    The shape of a word is that of its first 200 characters, a bound on the cost of one feature; its length, digits and check digit are those of the
    whole word. Patterns always see whole texts.
    """
    shapes = [shape(w[:200]) for w in words]
    out = []
    for i, word in enumerate(words):
        core, digits = word.strip(EDGES), len(DIGIT.findall(word))
        names = [
            "shape " + shapes[i], "core " + re.sub("9+", "9", shape(core[:200])), "digits %d" % min(digits, 20), "length %d" % min(len(core), 24),
            "before " + (shapes[i - 1] if i else before.lower()), "after " + (shapes[i + 1] if i + 1 < len(words) else ""),
            "at %s dots %d plus %s" % ("@" in core, min(core.count("."), 4), core[:1] == "+"),
            "check %s" % (core.isascii() and core.isdigit() and 14 <= len(core) <= 19 and luhn(core)),
            "parts %s" % (core.count(".") == 3 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in core.split("."))),
        ]
        out.append([_feature(n) for n in names])
    return out


def runs(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Runs of neighbouring words with a digit or an ``@``, and the word in front of each run.

    Only such words can carry a label. A word between them is O for certain, which makes the runs independent of each other:
    decoding them one by one decodes the whole text.
    """
    words: list[tuple[int, int]] = []
    for m in HIT.finditer(text):
        start = m.start()
        while start and not text[start - 1].isspace():
            start -= 1
        if words and text[words[-1][1]:start].strip():
            yield _before(text, words[0][0]), words
            words = []
        words.append((start, m.end()))
    if words:
        yield _before(text, words[0][0]), words


def _before(text: str, at: int) -> str:
    """The word in front of a place, or its end where it is longer than 32 characters: a feature, compared as it is."""
    return (text[max(0, at - 32):at].split() or [""])[-1]


# ---- the model -------------------------------------------------------------------------------


def _scores(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    return weights[features].sum(axis=-2)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _batches(features: list[np.ndarray], size: int) -> Iterator[np.ndarray]:
    """Indices of sequences of one length, so that no batch is padded."""
    lengths = np.array([len(f) for f in features])
    for n in np.unique(lengths):
        same = np.flatnonzero(lengths == n)
        step = max(1, size // int(n))
        for at in range(0, len(same), step):
            yield same[at:at + step]


def train_crf(labelled: pd.DataFrame, rounds: int = 12, rate: float = 0.3, decay: float = 1e-4) -> dict[str, np.ndarray]:
    """Maximum-likelihood weights from rows ``before, words, tags``: forward-backward on batches of equal length, AdaGrad steps."""
    k = len(LABELS)
    model = {"emit": np.zeros((FEATURES, k)), "move": np.zeros((k, k)), "first": np.zeros(k)}
    seen = {name: np.full_like(w, 1e-6) for name, w in model.items()}
    features = [np.array(token_features(b, w)) for b, w in zip(labelled["before"], labelled["words"])]
    tags = [np.array([LABELS.index(t) for t in ts]) for ts in labelled["tags"]]
    for _ in range(rounds):
        for batch in _batches(features, 512):
            x, y = np.stack([features[i] for i in batch]), np.stack([tags[i] for i in batch])
            emit, n = _scores(model["emit"], x), x.shape[1]
            alpha, beta = np.empty_like(emit), np.zeros_like(emit)
            alpha[:, 0] = emit[:, 0] + model["first"]
            for t in range(1, n):
                alpha[:, t] = emit[:, t] + _logsumexp(alpha[:, t - 1][:, :, None] + model["move"], 1)
            for t in range(n - 2, -1, -1):
                beta[:, t] = _logsumexp(model["move"] + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            total = _logsumexp(alpha[:, -1], 1)
            wrong = np.exp(alpha + beta - total[:, None, None])
            moves = np.zeros((k, k))
            for t in range(1, n):
                moves += np.exp(
                    alpha[:, t - 1][:, :, None] + model["move"] + (emit[:, t] + beta[:, t])[:, None, :] - total[:, None, None]
                ).sum(axis=0)
                np.subtract.at(moves, (y[:, t - 1], y[:, t]), 1)
            np.subtract.at(wrong, (np.arange(len(batch))[:, None], np.arange(n)[None, :], y), 1)
            grads = {"move": moves, "first": wrong[:, 0].sum(axis=0), "emit": np.zeros_like(model["emit"])}
            np.add.at(grads["emit"], x.reshape(-1), np.repeat(wrong.reshape(-1, k), x.shape[2], axis=0))
            for name, g in grads.items():
                g = g / len(batch) + decay * model[name]
                seen[name] += g * g
                model[name] -= rate * g / np.sqrt(seen[name])
    return model


def viterbi(model: dict[str, np.ndarray], features: list[np.ndarray]) -> list[np.ndarray]:
    """Best label sequence of every run, in numpy batches of runs of one length; ties go to the earlier label."""
    out: list[np.ndarray] = [np.zeros(0, int)] * len(features)
    for batch in _batches(features, 1 << 15):
        x = np.stack([features[i] for i in batch])
        emit = _scores(model["emit"], x)
        best, back = emit[:, 0] + model["first"], []
        for t in range(1, x.shape[1]):
            paths = best[:, :, None] + model["move"]
            back.append(paths.argmax(axis=1).astype(np.int8))
            best = paths.max(axis=1) + emit[:, t]
        path = [best.argmax(axis=1)]
        for step in reversed(back):
            path.append(step[np.arange(len(batch)), path[-1]])
        for i, labels in zip(batch, np.stack(path[::-1], axis=1)):
            out[i] = labels
    return out


def label_spans(text: str, words: list[tuple[int, int]], labels: Sequence[int]) -> list[tuple[int, int, str]]:
    """Spans of labelled words, without punctuation at their edges."""
    spans: list[list] = []
    for (start, end), label in zip(words, labels):
        tag = LABELS[label]
        if tag == "O":
            continue
        core = text[start:end]
        start, end = start + len(core) - len(core.lstrip(EDGES)), end - len(core) + len(core.rstrip(EDGES))
        if tag[0] == "I" and spans and spans[-1][2] == tag[2:] and not text[spans[-1][1]:start].strip(EDGES + " \t"):
            spans[-1][1] = end
        elif start < end:
            spans.append([start, end, tag[2:]])
    return [tuple(s) for s in spans]


# ---- on tables -------------------------------------------------------------------------------


def label_runs(results: DataFrame, text: str = "error", most: int = 4000) -> DataFrame:
    """A small labelled table ``before, words, tags``: runs of at most ``most`` texts, tagged with the patterns they hold.

    Every run with a phone number also appears without its country code, so that the field learns numbers which the pattern leaves
    out by what surrounds and shapes them. Runs of over 24 words are left out of the table (not of the search). The bound is a number of texts, not a share: it
    doesn't grow with the input; which texts are taken follows the order of the table's files.
    """
    def tagged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch["text"]:
                spans = pattern_spans(t)
                for before, words in runs(t):
                    tags = ["O"] * len(words)
                    for start, end, kind in spans:
                        own = [i for i, (s, e) in enumerate(words) if s < end and start < e]
                        for j, i in enumerate(own):
                            tags[i] = f"{'I' if j else 'B'}-{kind}"
                    named = [t[s:e] for s, e in words]
                    if len(words) <= 24:
                        rows.append((before, named, tags))
                        at = tags.index("B-phone") if "B-phone" in tags else -1
                        if at >= 0 and at + 2 < len(tags) and named[at].startswith("+") and tags[at + 2] == "I-phone":
                            rows.append((named[at - 1] if at else before, named[at + 1:], ["B-phone", *tags[at + 2:]]))
            yield pd.DataFrame(rows, columns=["before", "words", "tags"])

    sample = results.select(F.col(text).alias("text")).filter(F.col("text").rlike("[0-9@]")).limit(most)
    return sample.mapInPandas(tagged, "before string, words array<string>, tags array<string>")


def _spans(texts: Sequence[str | None], model: dict[str, np.ndarray]) -> tuple[list[list], list[list]]:
    """Spans of the patterns, and those that the field adds, for every text."""
    texts = [t if isinstance(t, str) else "" for t in texts]
    bases, added = [pattern_spans(t) for t in texts], [[] for _ in texts]
    where, features = [], []
    for i, t in enumerate(texts):
        for before, words in runs(t):
            where.append((i, words))
            features.append(np.array(token_features(before, [t[s:e] for s, e in words])))
    for (i, words), labels in zip(where, viterbi(model, features)):
        if labels.any():
            added[i] += [s for s in label_spans(texts[i], words, labels) if not any(s[0] < e and b < s[1] for b, e, _ in bases[i])]
    return bases, added


def all_spans(texts: Sequence[str | None], model: dict[str, np.ndarray]) -> list[list[tuple[int, int, str]]]:
    """All spans of every text, by start, then kind as listed."""
    return [sorted([*b, *a], key=lambda s: (s[0], KINDS.index(s[2]))) for b, a in zip(*_spans(texts, model))]


def find_personal(results: DataFrame, model: dict[str, np.ndarray], key: str = "map_id", text: str = "error") -> DataFrame:
    """Personal data in the texts of build results (error texts by ``map_id``, which quote addresses and accounts).

    One row per row of ``results``: ``<key>``; ``n_email, n_ip, n_card, n_phone``, the number of pattern matches; ``base_sha256`` of their
    list ``kind:start:end``, by start, then kind as in ``KINDS``, comma-joined, in code points, end exclusive; ``spans``, the list with the
    spans that the field adds; ``n_added``. The field's spans never replace pattern matches: one that overlaps a match is left out.

    Null and empty texts have no spans. Repeated rows and null keys give a row each, an empty table none; further columns are
    ignored. A batch of runs is decoded at once; memory holds one Arrow batch of texts.
    """
    kind = dict(results.dtypes)[key]

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bases, added = _spans(batch["text"], model)
            rows = []
            for k, base, more in zip(batch["key"], bases, added):
                both = sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2])))
                text_of = lambda spans: ",".join(f"{n}:{s}:{e}" for s, e, n in spans)
                counts = [sum(s[2] == n for s in base) for n in KINDS]
                rows.append((k, *counts, hashlib.sha256(text_of(base).encode()).hexdigest(), text_of(both), len(more)))
            yield pd.DataFrame(rows, columns=["key", *(f"n_{n}" for n in KINDS), "base_sha256", "spans", "n_added"])

    named = results.select(results[key].alias("key"), results[text].alias("text"))
    counts = ", ".join(f"n_{n} long" for n in KINDS)
    return named.mapInPandas(found, f"key {kind}, {counts}, base_sha256 string, spans string, n_added long").withColumnRenamed("key", key)


def redact_personal(results: DataFrame, model: dict[str, np.ndarray], text: str = "error") -> DataFrame:
    """``results`` with every span of personal data, of the patterns and of the field, replaced by its kind in angle brackets.

    Overlapping spans become one replacement, with the kind of the first. Null texts stay null; all other columns stay as they are.
    """
    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(texts, all_spans(texts, model)):
            parts, upto = [], 0
            for start, end, kind in spans if isinstance(t, str) else []:
                if start >= upto:
                    parts += [t[upto:start], f"<{kind}>"]
                upto = max(upto, end)
            out.append("".join([*parts, t[upto:]]) if parts else t)
        return pd.Series(out, index=texts.index, dtype=object)

    return results.withColumn(text, redacted(F.col(text)))
