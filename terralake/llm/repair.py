"""Repair of conversations by the cheapest edits: Viterbi over role states with coalescing survivors."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.scans import join_keyed
from ..session import cut

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
INF = 1 << 60
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAULTS = ("", "blank", "duplicate", "truncated")
#: State after a row of that role initial, where a repaired conversation may go on with it.
AFTER = {
    (EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
#: Inserts that complete a conversation ending in a state.
ENDING = {EMPTY: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
ROLE = {USER: "user", ASSISTANT: "assistant"}
BATCH_ROWS, BATCH_CHARS = 2000, 1 << 22


def made(state: int) -> int:
    """State after an inserted or reroled row: the assistant follows the user, the user all else."""
    return ASSISTANT if state == USER else USER


def _ways(initial: str, fault: str) -> list[list[tuple[int, int, str]]]:
    """Per state before a row: ``(state after it, cost, edits)``, the cheapest edits per pair of states, ties to the least in ASCII.

    Inserts stand in front of the row's own edit; more than two in a row never pay.
    """
    ways = []
    for before in range(4):
        best: dict[int, tuple[int, str]] = {}
        state, cost, edits = before, 0, ""
        for _ in range(3):
            own = [(DELETE, "D", state)]
            if fault not in ("blank", "duplicate"):
                extra = TRUNCATED if fault == "truncated" else 0
                own.append((REROLE + extra, "R", made(state)))
                if (state, initial) in AFTER:
                    own.append((KEEP + extra, "K", AFTER[state, initial]))
            for more, edit, after in own:
                best[after] = min(best.get(after, (INF, "")), (cost + more, edits + edit))
            state, cost, edits = made(state), cost + INSERT, edits + "I"
        ways.append([(after, c, e) for after, (c, e) in best.items()])
    return ways


WAYS = {(i, f): _ways(i, f) for i in ("s", "u", "a", "") for f in FAULTS}


class Node:
    """A survivor's edits of one row. ``kids`` are the nodes that lead back to it; their number is its reference count."""

    __slots__ = ("parent", "edits", "kids")

    def __init__(self, parent: Node | None, edits: str) -> None:
        self.parent, self.edits, self.kids = parent, edits, []


class Survivors:
    """Cheapest edits into every state, row by row, from one state before the first row.

    Survivors share a tree of backpointers. A node nothing leads back to is dropped, and once all survivors descend from one child of
    the root, that child's edits are final and ``push`` returns them; what stays in memory is the unresolved part alone.

    Ties are decided on the complete unresolved edits: ``order`` holds the place of each survivor among all by its whole string.
    No survivor's string continues another's (each has one edit per row, inserts in front of it), so an order once found stays, and
    the order of longer strings follows from that of their beginnings and the edits added.
    """

    def __init__(self, entry: int = EMPTY) -> None:
        self.root = Node(None, "")
        self.cost = [INF] * 4
        self.cost[entry] = 0
        self.order = [0] * 4
        self.tips: list[Node | None] = [None] * 4
        self.tips[entry] = self.root

    def push(self, initial: str, fault: str) -> list[str]:
        """Take a row; edits of the earliest unresolved rows that are now final, one string a row."""
        ways = WAYS[initial if initial in ("s", "u", "a") else "", fault]
        found: list[tuple | None] = [None] * 4
        for before in range(4):
            if self.cost[before] < INF:
                for after, cost, edits in ways[before]:
                    way = (self.cost[before] + cost, self.order[before], edits, before)
                    if found[after] is None or way < found[after]:
                        found[after] = way
        cost = [w[0] if w else INF for w in found]
        # what only a conversation without a dialogue so far can do, keep a system row, saves 2 at most; a system row alone can't end
        if min(cost[ASSISTANT], cost[USER] + INSERT) + DELETE < cost[EMPTY]:
            found[EMPTY], cost[EMPTY] = None, INF
        if min(cost[ASSISTANT], cost[USER] + INSERT) < cost[SYSTEM]:
            found[SYSTEM], cost[SYSTEM] = None, INF
        tips: list[Node | None] = [None] * 4
        for place, after in enumerate(sorted((q for q in range(4) if found[q]), key=lambda q: found[q][1:3])):
            _, _, edits, before = found[after]
            tips[after] = Node(self.tips[before], edits)
            self.tips[before].kids.append(tips[after])
            self.order[after] = place
        for old in self.tips:
            self._drop(old)
        self.cost, self.tips = cost, tips
        final = []
        while len(self.root.kids) == 1 and self.root.kids[0].kids:
            self.root = self.root.kids[0]
            self.root.parent = None
            final.append(self.root.edits)
        return final

    def _drop(self, node: Node | None) -> None:
        while node is not None and not node.kids and node.parent is not None:
            node.parent.kids.remove(node)
            node = node.parent

    def best(self) -> int:
        """State in which the cheapest conversation ends, its last inserts counted."""
        return min((q for q in range(4) if self.cost[q] < INF), key=lambda q: (self.cost[q] + INSERT * len(ENDING[q]), self.order[q]))

    def rest(self, state: int) -> list[str]:
        """Edits of all unresolved rows, for a conversation that goes on from, or ends in, ``state``."""
        out, node = [], self.tips[state]
        while node is not self.root:
            out.append(node.edits)
            node = node.parent
        return out[::-1]


def has_ink(text: Column) -> Column:
    return F.length(F.translate(text, " \t\n\v\f\r", "")) > 0


def faults(turns: DataFrame) -> DataFrame:
    """The first fault of every row: no visible character, role and text seen earlier in its conversation, no ``.``, ``!`` or ``?`` at its end."""
    again = F.row_number().over(W.partitionBy("key", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)).orderBy(F.col("turn").asc_nulls_first())) > 1
    last = F.right(F.rtrim(F.translate(F.col("text"), "\t\n\v\f\r", "     ")), F.lit(1))
    fault = F.when(~has_ink(F.col("text")), "blank").when(again, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    return turns.withColumn("fault", fault)


def _edit_chunks(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Edits of rows sorted by conversation, chunk and place; a chunk starts in ``entry`` and ends in ``exit`` (null: the cheapest end)."""
    out: list[list] = [[] for _ in schema]
    chars = 0
    held: deque = deque()
    chunk, tracker, state, place = None, None, EMPTY, 0

    def write(values: tuple) -> None:
        nonlocal chars
        for column, v in zip(out, values):
            column.append(v)
        chars += len(values[6])

    def apply(edits: str, row: tuple | None) -> None:
        nonlocal state, place
        for e in edits:
            if e == "I":
                state = made(state)
                write((chunk[0], place, e, None, None, ROLE[state], "", ""))
            else:
                _, turn, role, text, fault = row
                now = role
                if e == "K":
                    state = AFTER[state, role[:1]]
                elif e == "R":
                    state = made(state)
                    now = ROLE[state]
                write((chunk[0], place, e, turn, role, now, text, fault))
            place += 1

    def close() -> None:
        final = tracker.best() if chunk[4] is None else chunk[4]
        for edits in tracker.rest(final):
            apply(edits, held.popleft())
        if chunk[5]:
            apply(ENDING[final], None)

    def flush() -> pa.RecordBatch:
        nonlocal out, chars
        done = pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
        out, chars = [[] for _ in schema], 0
        return done

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if chunk is None or row[0] != chunk[0] or row[5] != chunk[1] or row[6] != chunk[2]:
                if chunk is not None:
                    close()
                chunk = (row[0], row[5], row[6], row[7], row[8], row[9])
                tracker, state, place = Survivors(chunk[3]), chunk[3], chunk[2] << 24
            held.append(row[:5])
            for edits in tracker.push(row[2][:1], row[4]):
                apply(edits, held.popleft())
            if len(out[0]) >= BATCH_ROWS or chars >= BATCH_CHARS:
                yield flush()
    if chunk is not None:
        close()
    if out[0]:
        yield flush()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk and state before it: cost of the cheapest edits into every state, and the order of their strings."""
    chunk, trackers = None, []

    def done() -> pa.RecordBatch:
        cost = [c for t in trackers for c in t.cost]
        order = [o for t in trackers for o in t.order]
        return pa.record_batch([pa.array([chunk[0]], kind), pa.array([chunk[1]], pa.int32()), pa.array([chunk[2]], pa.int64()),
                                pa.array([cost], pa.list_(pa.int64())), pa.array([order], pa.list_(pa.int32()))], ["key", "part", "sub", "cost", "order"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for key, role, fault, part, sub in zip(*(c.to_pylist() for c in batch.columns)):
            if chunk is None or (key, part, sub) != chunk:
                if chunk is not None:
                    yield done()
                chunk, trackers = (key, part, sub), [Survivors(q) for q in range(4)]
            for t in trackers:
                t.push(role[:1], fault)
    if chunk is not None:
        yield done()


def _resolve(chunks: pd.DataFrame) -> pd.DataFrame:
    """States before and after every chunk of one conversation on its cheapest path, ties to the least string of edits."""
    chunks = chunks.sort_values(["part", "sub"], ignore_index=True)
    cost, order, backs = [0, INF, INF, INF], [0] * 4, []
    for c, o in zip(chunks["cost"], chunks["order"]):
        ways = [min(((cost[b] + int(c[4 * b + a]), order[b], b) for b in range(4) if cost[b] < INF and c[4 * b + a] < INF), default=None) for a in range(4)]
        places = sorted((a for a in range(4) if ways[a]), key=lambda a: (ways[a][1], int(o[4 * ways[a][2] + a])))
        backs.append([w[2] if w else 0 for w in ways])
        cost = [w[0] if w else INF for w in ways]
        order = [places.index(a) if a in places else 0 for a in range(4)]
    state = min((q for q in range(4) if cost[q] < INF), key=lambda q: (cost[q] + INSERT * len(ENDING[q]), order[q]))
    entries, exits = [], []
    for back in reversed(backs):
        exits.append(state)
        state = back[state]
        entries.append(state)
    ends = [False] * (len(backs) - 1) + [True]
    return chunks[["key", "part", "sub"]].assign(number=range(len(backs)), entry=entries[::-1], exit=exits[::-1], ends=ends)


PLACE = ("turn", "role", "text", "fault")


def _ordered(rows: DataFrame, *before: str) -> DataFrame:
    return rows.sortWithinPartitions("key", *before, F.col("turn").asc_nulls_first(), "role", "text", "fault")


def repair_conversations(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         most: int = 1 << 16, parts: int | None = None) -> DataFrame:
    """Cheapest edits that give every conversation the role initials ``(s?(ua)+)?``. The project has no records of this kind: any table of turns.

    One row per edit, ``<key>, place`` (their order within the conversation), ``edit, turn, was`` (the role before), ``role, text, fault``. Edits:
    ``K`` keep (costs 0), ``R`` another role, user or assistant (1), ``D`` delete (2; the only edit of a ``blank`` or ``duplicate`` row),
    ``I`` insert a row without text (5; its ``turn`` and ``was`` are null); a ``truncated`` row that isn't deleted costs 5 more. Among
    equally cheap edits the string of their initials that is least in ASCII wins.

    Rows are taken by turn (null first), then role and text, so that the order of repeated rows doesn't matter; a null role or text is one
    space. Rows with a null key are one conversation. An empty table has no edits; further columns are ignored.

    Conversations of up to ``most`` rows are read from sorted partitions, one row at a time (``Survivors``); rows wait only until their edits
    are final. Longer ones are cut into chunks of at most ``most`` rows by a range partitioning into ``parts``: each chunk is first solved from
    every state, the states between chunks follow from these small summaries (one row per chunk), and the chunks are then edited
    independently of each other. Results don't depend on ``most``.
    """
    kind = dict(turns.dtypes)[key]
    named = faultless = turns.select(
        turns[key].alias("key"), turns[turn].cast("long").alias("turn"),
        F.coalesce(turns[role], F.lit(" ")).alias("role"), F.coalesce(turns[text], F.lit(" ")).alias("text"),
    )
    columns = f"key {kind}, place long, edit string, turn long, was string, role string, text string, fault string"
    long_ones = cut(named.groupBy("key").count().filter(F.col("count") > most).select("key"), "long")
    split = not long_ones.isEmpty()
    if split:
        faultless = join_keyed(named, long_ones, ["key"], "left_anti")

    def edited(chunks: DataFrame) -> DataFrame:
        arrow = pa.schema([("key", _arrow_type(turns, key)), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()),
                           ("was", pa.string()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string())])
        rows = chunks.select("key", *PLACE, "part", "number", "entry", "exit", "ends")
        return rows.mapInArrow(lambda batches: _edit_chunks(batches, arrow), columns)

    short = _ordered(faults(faultless.repartition("key"))).select(
        "*", F.lit(0).alias("part"), F.lit(0).cast("long").alias("number"), F.lit(EMPTY).alias("entry"), F.lit(None).cast("int").alias("exit"),
        F.lit(True).alias("ends"),
    )
    out = edited(short)
    if split:
        n = parts or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        found = faults(join_keyed(named, long_ones, ["key"], "left_semi"))
        placed = cut(found.repartitionByRange(n, "key", F.col("turn").asc_nulls_first(), "role", "text", "fault").withColumn("part", F.spark_partition_id()), "turns")
        within = F.row_number().over(W.partitionBy("key", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "fault"))
        numbered = cut(placed.withColumn("sub", F.floor((within - 1) / most).cast("long")), "turns")
        by_chunk = _ordered(numbered.repartition("key", "part", "sub"), "part", "sub")
        summed = by_chunk.select("key", "role", "fault", "part", "sub").mapInArrow(
            _summaries, f"key {kind}, part int, sub long, cost array<long>, order array<int>")
        ways = cut(summed.groupBy("key").applyInPandas(_resolve, f"key {kind}, part int, sub long, number long, entry int, exit int, ends boolean"), "ways")
        chunks = join_keyed(numbered, ways, ["key", "part", "sub"])
        out = out.unionByName(edited(_ordered(chunks.repartition("key", "number"), "number")))
    return out.withColumnRenamed("key", key)


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def summarise_repairs(edits: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation of ``repair_conversations``: ``<key>, gaps`` (turn numbers missing between the first and the last), the numbers of
    ``blank, duplicate, truncated`` rows, ``illegal`` pairs of neighbouring roles before the repair, ``cost``, ``audit`` (initials of the edits) and
    ``repaired_sha256`` of the repaired ``role:text``, joined with newlines.

    A digest of a whole conversation needs its rows one after the other: they pass through one task as a stream, none is held.
    """
    import hashlib

    kind = dict(edits.dtypes)[key]
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    columns = f"key {kind}, " + ", ".join(f"{n} long" for n in names) + ", audit string, repaired_sha256 string"
    price = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, key_now, type_ = False, None, None
        rows: list[tuple] = []

        def done() -> tuple:
            gaps = high - low + 1 - distinct if distinct else 0
            return (key_now, gaps, *(count[f] for f in FAULTS[1:]), illegal, cost, "".join(audit), digest.hexdigest())

        def flush() -> pa.RecordBatch:
            columns_ = list(zip(*rows))
            types = [type_, *[pa.int64()] * 6, pa.string(), pa.string()]
            out = pa.record_batch([pa.array(c, t) for c, t in zip(columns_, types)], ["key", *names, "audit", "repaired_sha256"])
            rows.clear()
            return out

        for batch in batches:
            type_ = batch.schema.field(0).type
            for k, edit, turn, was, role, text, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or k != key_now:
                    if begun:
                        rows.append(done())
                        if len(rows) >= BATCH_ROWS:
                            yield flush()
                    begun, key_now, low, high, distinct, illegal, cost, audit = True, k, None, None, 0, 0, 0, []
                    count, digest, before, first = dict.fromkeys(FAULTS, 0), hashlib.sha256(), None, True
                audit.append(edit)
                cost += price[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
                if edit != "I":
                    count[fault] += 1
                    if turn is not None and turn != high:
                        low, high, distinct = turn if low is None else low, turn, distinct + 1
                    illegal += before is not None and before[:1] + was[:1] not in ("su", "ua", "au")
                    before = was
                if edit != "D":
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
        if begun:
            rows.append(done())
            yield flush()

    rows = edits.select(edits[key].alias("key"), "place", "edit", "turn", "was", "role", "text", "fault")
    sorted_ = rows.repartition("key").sortWithinPartitions("key", "place").drop("place")
    return sorted_.mapInArrow(summed, columns).withColumnRenamed("key", key)
