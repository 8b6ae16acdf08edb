"""Repaired conversations against all edit strings, in one piece and in chunks of any size."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from terralake.llm.repair import Survivors, repair_conversations, summarise_repairs

SCHEMA = "conv_id long, turn long, role string, text string"
ROLES = {"u": "user", "a": "assistant"}


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faulty(rows):
    out, seen = [], set()
    for turn, role, text in ordered(rows):
        ink = text.strip(" \t\n\v\f\r")
        fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def follow(rows, edits):
    """Cost and rows of an edit string; None where it isn't allowed."""
    said, state, cost, rest = [], "", 0, list(rows)
    for e in edits:
        row = rest.pop(0) if e != "I" else None
        if e == "D":
            cost += 2
            continue
        if e != "I" and row[3] in ("blank", "duplicate"):
            return None
        new = row[1][:1] if e == "K" else "a" if state == "u" else "u"
        if (state, new) not in (("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
            return None
        state = new
        cost += {"K": 0, "R": 1, "I": 5}[e] + (5 if row and row[3] == "truncated" else 0)
        said.append(f"{row[1]}:{row[2]}" if e == "K" else f"{ROLES[new]}:{row[2] if row else ''}")
    return (cost, edits, said) if state in ("", "a") else None


def brute(rows):
    rows = faulty(rows)
    found = []
    for own in itertools.product("DKR", repeat=len(rows)):
        for gaps in itertools.product(("", "I", "II"), repeat=len(rows) + 1):
            got = follow(rows, "".join(g + o for g, o in zip(gaps, own)) + gaps[-1])
            if got:
                found.append(got)
    cost, audit, said = min(found)
    turns = {r[0] for r in rows} - {None}
    count = [sum(r[3] == f for r in rows) for f in ("blank", "duplicate", "truncated")]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def conversations(seed, n, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t\n", "Why?", "Well. "]
    return {c: [(rng.choice([None, *range(6)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", " "]), rng.choice(texts))
                for _ in range(rng.randint(1, longest))] for c in range(n)}


def table(spark, found):
    return spark.createDataFrame([(c, *r) for c, rows in found.items() for r in rows], SCHEMA)


def result(df):
    return {r["conv_id"]: tuple(r)[1:] for r in summarise_repairs(df).collect()}


def test_all_edit_strings(spark):
    found = conversations(1, 60, 4)
    assert result(repair_conversations(table(spark, found))) == {c: brute(rows) for c, rows in found.items()}


@pytest.mark.parametrize("most", [1, 2, 7])
def test_chunks_change_nothing(spark, most):
    """A conversation spread over chunks and partitions gives the same edits in the same order as in one piece."""
    found = conversations(2, 8, 60) | {None: conversations(3, 1, 90)[0]}
    turns = table(spark, found).withColumn("place", F.lit("clash"))
    whole = sorted((tuple(r)[:1] + tuple(r)[2:] for r in repair_conversations(turns).orderBy("conv_id", "place").collect()), key=repr)
    parted = repair_conversations(turns, most=most, parts=5)
    assert sorted((tuple(r)[:1] + tuple(r)[2:] for r in parted.collect()), key=repr) == whole
    assert result(parted) == result(repair_conversations(turns))


def test_long_strings_of_ties(spark):
    """Rows of one role: the survivors share no edit until the end, and the least string still wins."""
    rows = [(i, "assistant", f"{i}.") for i in range(31)]
    audit = result(repair_conversations(table(spark, {1: rows}), most=4, parts=3))[1][6]
    assert audit == "D" + "RK" * 15


def test_memory_holds_the_unresolved_part():
    tracker, final = Survivors(), 0
    for i in range(10_000):
        final += len(tracker.push("ua"[i % 2], "" if i % 50 else "truncated"))
        depth, node = 0, tracker.tips[tracker.best()]
        while node is not tracker.root:
            depth, node = depth + 1, node.parent
        assert depth < 12 and final + depth == i + 1


def test_empty_null_and_repeated_rows(spark):
    assert repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, None, None), (1, None, None, None), (None, 0, "user", "Hm."), (None, 0, "user", "Hm."), (2, 0, "assistant", "x" * 200_000)]
    got = result(repair_conversations(spark.createDataFrame(rows, SCHEMA)))
    assert got[1][:7] == (0, 2, 0, 0, 1, 4, "DD") and got[2][:7] == (0, 0, 0, 1, 0, 2, "D") and got[None][6] == "DD"


def test_a_system_row_is_kept_only_in_front(spark):
    rows = [(0, "user", "Hi."), (1, "system", "Be kind."), (2, "assistant", "Hello.")]
    assert result(repair_conversations(table(spark, {1: rows, 2: rows[1:2] + rows[:1] + rows[2:]})))[1][6] == "KDK"
    assert result(repair_conversations(table(spark, {1: [(0, "system", "Be kind."), (1, "user", "Hi.")]})))[1][6] == "RR"
