"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, ending with
the assistant.  Dynamic programming over that automaton finds the cheapest mix of merges
(MERGE), relabels (RELABEL; UNKNOWN for roles it does not know) and empty insertions (INSERT).
Among cheapest repairs every turn, first to last, keeps its own role where that is possible,
else takes the first of user, assistant, system that stays cheapest; so the result does not
depend on how the rows are dealt out.

A conversation may hold a third of all rows.  Turns are range partitioned by conversation and
turn, and a stretch of turns acts on the automaton's states through a small min-plus matrix.
The driver gets one matrix and one state map per partition end, and only for conversations
that cross partitions; it never gets turns.

Output: one row per turn in order, and one per inserted empty turn.  The column ``rendered``
of a conversation's rows, joined by ``seq``, is the formatted conversation.

Defined results: every row is a turn, also one of several equal rows; turns sort by turn
(nulls last), then role, then text, nulls first; null text is empty text, and a merged turn
without text adds no separator; rows without conv_id are one conversation; an empty table
gives no rows.  Other columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table
from .registry import query

MERGE, INSERT, RELABEL, UNKNOWN = 1, 2, 3, 1
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ["", "system", "user", "assistant"]
#: Other names of the roles.
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER,
           "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT}
LEGAL = {START: [SYSTEM, USER], SYSTEM: [USER], USER: [ASSISTANT], ASSISTANT: [USER]}
INFINITE = 1 << 40
OPEN, CLOSE, JOIN = "<|{}|>\n", "<|end|>\n", "\n\n"


def _way(state: int, goal: int) -> list[int] | None:
    """Turns to insert on the shortest legal way from ``state`` to a turn ``goal``."""
    ways = [[state]]
    while ways:
        way = ways.pop(0)
        for turn in LEGAL[way[-1]]:
            if turn == goal:
                return way[1:]
            if turn not in way[1:]:
                ways.append([*way, turn])
    return None


def _step(state: int, label: int) -> tuple[int, bool, list[int]]:
    """Cost, whether it merges, and insertions of a turn labelled ``label`` after ``state``."""
    way = _way(state, label)
    cost = INFINITE if way is None else INSERT * len(way)
    if state == label and MERGE <= cost:
        return MERGE, True, []
    return cost, False, way or []


LABELS = [USER, ASSISTANT, SYSTEM]
STEPS = {(s, l): _step(s, l) for s in range(4) for l in LABELS}
#: Insertions that end a conversation legally.
ENDINGS = {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}
FINAL = np.array([INSERT * len(ENDINGS[s]) for s in range(4)], np.int64)


def _relabel(role: int, label: int) -> int:
    return 0 if role == label else UNKNOWN if role == START else RELABEL


#: Cost of a turn of a role (0: unknown) from a state to a state, as min-plus matrices.
COSTS = np.full((4, 4, 4), INFINITE, np.int64)
for _role in range(4):
    for (_s, _l), (_cost, _, _) in STEPS.items():
        COSTS[_role, _s, _l] = min(INFINITE, _cost + _relabel(_role, _l))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), INFINITE)


def product(roles: np.ndarray) -> np.ndarray:
    """Matrix of a stretch of turns, by halving."""
    stack = COSTS[roles]
    while len(stack) > 1:
        half = np.minimum((stack[:-1:2, :, :, None] + stack[1::2, None, :, :]).min(axis=2), INFINITE)
        stack = np.concatenate([half, stack[-1:]]) if len(stack) % 2 else half
    return stack[0]


def decide(roles: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Best label for each turn and each state before it; ``rest``: cost to go after the last turn."""
    out = np.zeros((len(roles), 4), np.int8)
    for i in range(len(roles) - 1, -1, -1):
        role = int(roles[i])
        total = COSTS[role] + rest[None, :]
        order = ([role] if role else []) + [l for l in LABELS if l != role]
        out[i] = np.array(order)[total[:, order].argmin(axis=1)]
        rest = np.minimum(total.min(axis=1), INFINITE)
    return out


def role_code(role: str | None) -> int:
    return ALIASES.get((role or "").strip().lower(), START)


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, list[str | None], list[dict]]]:
    """Conversations of one partition in order: id, roles, and the rows if they have more columns."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for key, some in groupby(rows, key=lambda r: r["conv_id"]):
        some = list(some)
        yield key, np.array([role_code(r["role"]) for r in some], np.int8), some


def _edges(batches: Iterable[pa.RecordBatch]):
    """First and last run of a partition, with their place: 0 first, 1 last; a lone run is 0."""
    first = last = None
    for key, roles, _ in _runs(batches):
        if first is None:
            first = (0, key, roles)
        else:
            last = (1, key, roles)
    return [r for r in (first, last) if r is not None], last is None


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, seq, turn, role, new_role, action, rendered."""
    from pyspark import TaskContext
    spark = conversations.sparkSession
    # The number splits a conversation of one repeated row; equal rows are alike in any order.
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(),
             F.col("text").asc_nulls_first(), F.col("tie")]
    turns = conversations.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("tie"))
    placed = checkpoint(turns.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie"))

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, lone = _edges(batches)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist([
            {"part": part, "place": place, "conv_id": key, "lone": lone, "n": len(roles),
             "matrix": product(roles).ravel().tolist()} for place, key, roles in found],
            schema=pa.schema([("part", pa.int32()), ("place", pa.int32()), ("conv_id", pa.int64()),
                              ("lone", pa.bool_()), ("n", pa.int64()), ("matrix", pa.list_(pa.int64()))]))

    # At most two rows per partition.
    ends = sorted(placed.select("conv_id", "role").mapInArrow(
        summaries, "part int, place int, conv_id long, lone boolean, n long, matrix array<long>").collect(),
        key=lambda r: (r["part"], r["place"]))
    chains: list[list] = []         # stretches of one conversation over several partitions
    for r in ends:
        linked = (chains and chains[-1][-1]["conv_id"] == r["conv_id"] and r["place"] == 0
                  and (chains[-1][-1]["place"] == 1 or chains[-1][-1]["lone"]))
        if linked:
            chains[-1].append(r)
        else:
            chains.append([r])
    chains = [c for c in chains if len(c) > 1]
    rest: dict[tuple[int, int], list[int]] = {}
    for chain in chains:
        after = FINAL
        for r in reversed(chain):
            rest[r["part"], r["place"]] = after.tolist()
            after = np.minimum((np.array(r["matrix"]).reshape(4, 4) + after[None, :]).min(axis=1), INFINITE)

    def walk(roles: np.ndarray, to_go: np.ndarray, state: int) -> tuple[int, int]:
        best, inserted = decide(roles, to_go), 0
        for i in range(len(roles)):
            label = int(best[i, state])
            inserted += len(STEPS[state, label][2])
            state = label
        return state, inserted

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), []
        if (part, 0) in rest or (part, 1) in rest:
            for place, _, roles in _edges(batches)[0]:
                if (part, place) in rest:
                    ways = [walk(roles, np.array(rest[part, place]), s) for s in range(4)]
                    out.append({"part": part, "place": place, "to": [w[0] for w in ways], "more": [w[1] for w in ways]})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
            ("part", pa.int32()), ("place", pa.int32()), ("to", pa.list_(pa.int32())), ("more", pa.list_(pa.int64()))]))

    # state and position before each stretch
    before: dict[tuple[int, int], tuple[int, int]] = {}
    open_: set[tuple[int, int]] = set()     # stretches that another one continues
    if chains:
        found = {(r["part"], r["place"]): r for r in placed.select("conv_id", "role").mapInArrow(
            maps, "part int, place int, to array<int>, more array<long>").collect()}
        for chain in chains:
            state, seq = START, 0
            for k, r in enumerate(chain):
                at = r["part"], r["place"]
                before[at] = state, seq
                if k + 1 < len(chain):
                    open_.add(at)
                seq += r["n"] + found[at]["more"][state]
                state = found[at]["to"][state]

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, size = TaskContext.get().partitionId(), [], 0
        runs = _runs(batches)
        current = next(runs, None)
        place = 0
        while current is not None:
            following = next(runs, None)
            # The last of several runs is the one at the partition's end.
            at = (part, 0 if place == 0 else 1 if following is None else -1)
            for row in _formatted(*current, *before.get(at, (START, 0)), np.array(rest.get(at, FINAL)), at in open_):
                out.append(row)
                size += len(row["rendered"])
                if len(out) >= 5_000 or size > 8_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema=_OUT)
                    out, size = [], 0
            current, place = following, place + 1
        yield pa.RecordBatch.from_pylist(out, schema=_OUT)

    return placed.mapInArrow(
        render, "conv_id long, seq long, turn long, role string, new_role string, action string, rendered string")


_OUT = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("turn", pa.int64()), ("role", pa.string()),
                  ("new_role", pa.string()), ("action", pa.string()), ("rendered", pa.string())])


def _formatted(key, roles, rows, state: int, seq: int, rest: np.ndarray, goes_on: bool) -> Iterator[dict]:
    """Output rows of one stretch of a conversation."""
    best = decide(roles, rest)

    def row(label: int, action: str, body: str, close: bool, source: dict | None = None) -> dict:
        nonlocal seq
        seq += 1
        head = "" if action.startswith("merge") else (CLOSE if close else "") + OPEN.format(NAMES[label])
        return {"conv_id": key, "seq": seq - 1, "turn": source and source["turn"], "role": source and source["role"],
                "new_role": NAMES[label], "action": action, "rendered": head + body}

    last: dict | None = None
    for i, source in enumerate(rows):
        label = int(best[i, state])
        _, merges, way = STEPS[state, label]
        for turn in way:
            if last is not None:
                yield last
            last = row(turn, "insert", "", state != START)
            state = turn
        kept = int(roles[i]) == label
        action = ("merge" if merges else "keep") + ("" if kept else " relabel")
        text = source["text"] or ""
        if last is not None:
            yield last
        last = row(label, "relabel" if action == "keep relabel" else action, (JOIN if merges and text else "") + text,
                   state != START, source)
        state = label
    for turn in [] if goes_on else ENDINGS[state]:
        yield last
        last = row(turn, "insert", "", True)
    if not goes_on:
        last["rendered"] += CLOSE
    yield last


@query()
def op1_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))
