"""Chat formatting: minimum-cost role repair, then rendering.

The legal-turn automaton: an optional system turn first, then user and assistant in turn, beginning with user. For each
turn dynamic programming chooses to keep it, to merge it into the turn before (same role), to relabel it, or to
insert an empty turn of the role that is missing before it; costs are COSTS. Ties take the first choice in that order.

A step is a min-plus matrix over the automaton's states, and products of matrices are associative. Turns are dealt by
ranges of (conversation, turn), so a conversation may lie in many tasks: each task returns one matrix per piece, pieces of
a conversation are chained (as many as tasks, not turns), and each task traces its pieces between the states found.

The result has a row per repaired piece: rows of a conversation in the order (seq, part), joined, are its rendering. A merged
turn is a further part of the turn before, so no text grows.

Defined results: null texts are empty; unknown and null roles cost a relabelling wherever they go; equal turn numbers are
ordered by role and text; null conversations are one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palate.llm.common import bound_batches, shuffle_width
from palate.session import stage

COSTS = {"keep": 0, "merge": 10, "relabel": 15, "insert": 20}
ROLES = ("system", "user", "assistant")
# States: nothing yet, or the role of the last turn.
STATES = ("start", *ROLES)
_NEXT = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
_FAR = 1 << 50


def moves(state: str, role: str | None) -> list[tuple[int, str, str, str | None]]:
    """(cost, action, new role, inserted role) for a turn after a state."""
    out = []
    for new in _NEXT[state]:
        out.append((COSTS["keep"], "keep", new, None) if new == role else (COSTS["relabel"], "relabel", new, None))
    if state != "start":
        out.append((COSTS["merge"] + (0 if state == role else COSTS["relabel"]), "merge", state, None))
    for gap in _NEXT[state]:
        for new in _NEXT[gap]:
            if new == role:
                out.append((COSTS["insert"], "insert", new, gap))
    return out


_MOVES = {(s, r): moves(s, r) for s in STATES for r in (*ROLES, None)}


def forward(roles: list[str | None], begin: str) -> tuple[dict[str, int], list[dict[str, tuple]]]:
    """Least costs of the end states, and for each turn the best way into each state."""
    cost, ways = {begin: 0}, []
    for role in roles:
        new: dict[str, tuple] = {}
        for state in STATES:
            if state not in cost:
                continue
            for price, action, to, gap in _MOVES[state, role if role in ROLES else None]:
                if to not in new or cost[state] + price < new[to][0]:
                    new[to] = (cost[state] + price, state, action, gap)
        ways.append(new)
        cost = {s: w[0] for s, w in new.items()}
    return cost, ways


def trace(ways: list[dict[str, tuple]], end: str) -> list[tuple[str, str, str | None]]:
    """(action, role, inserted role) of each turn on the best way to an end state."""
    out = []
    for way in reversed(ways):
        _, before, action, gap = way[end]
        out.append((action, end, gap))
        end = before
    return out[::-1]


def render(role: str, text: str, first: bool) -> str:
    return (f"<|{role}|>\n" if first else "") + text + "\n"


_PIECE = "piece int, conv_id bigint, costs string, n bigint"
_OUT = "conv_id bigint, seq bigint, part bigint, role string, action string, rendered string"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(piece, conversation, rows) of a task's sorted rows."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and (row["piece"], row["conv_id"]) != key:
                yield (*key, rows)
                rows = []
            key = (row["piece"], row["conv_id"])
            rows.append(row)
    if rows:
        yield (*key, rows)


def _matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece, conv, rows in _runs(batches):
        roles = [r["role"] for r in rows]
        costs = {s: forward(roles, s)[0] for s in STATES}
        yield pa.RecordBatch.from_arrays(
            [pa.array([piece], pa.int32()), pa.array([conv], pa.int64()), pa.array([json.dumps(costs)]), pa.array([len(rows)], pa.int64())], ["piece", "conv_id", "costs", "n"]
        )


def _chain(table: pa.Table) -> pa.Table:
    """The states between the pieces of one conversation."""
    rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
    cost, ways = {"start": 0}, []
    for row in rows:
        costs, new = json.loads(row["costs"]), {}
        for state in STATES:
            for to in STATES:
                if state in cost and to in costs[state] and (to not in new or cost[state] + costs[state][to] < new[to][0]):
                    new[to] = (cost[state] + costs[state][to], state)
        ways.append(new)
        cost = {s: w[0] for s, w in new.items()}
    end, found = min((c, STATES.index(s)) for s, c in cost.items())[1], []
    end = STATES[end]
    for way in reversed(ways):
        found.append((way[end][1], end))
        end = way[end][1]
    found, at = found[::-1], 0
    offsets = []
    for row in rows:
        offsets.append(at)
        at += row["n"]
    return pa.table(
        {
            "piece": pa.array([r["piece"] for r in rows], pa.int32()),
            "conv_id": pa.array([r["conv_id"] for r in rows], pa.int64()),
            "begin": [b for b, _ in found],
            "end": [e for _, e in found],
            "before": pa.array(offsets, pa.int64()),
        }
    )


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _OUT.split(", ")]
    for _, conv, rows in _runs(batches):
        done = trace(forward([r["role"] for r in rows], rows[0]["begin"])[1], rows[0]["end"])
        out = []
        for k, (row, (action, role, gap)) in enumerate(zip(rows, done)):
            # Places are those of the input's turns; an inserted turn stands before its turn.
            seq = (rows[0]["before"] + k) * 2 + 1
            if gap:
                out.append((conv, seq - 1, 0, gap, "inserted", render(gap, "", True)))
            out.append((conv, seq, int(action == "merge"), role, action, render(role, row["text"] or "", action != "merge")))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)


def chat_repair(turns: DataFrame) -> DataFrame:
    """conv_id, seq (place), part (1: goes on the turn before), role, action, rendered."""
    spark = turns.sparkSession
    bound_batches(spark)
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
    dealt = rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    dealt = stage(dealt.withColumns({"piece": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "turns")
    # Written parts keep their task's order; a piece is read back by its number.
    pieces = dealt.repartition(shuffle_width(spark), "piece").sortWithinPartitions("piece", "place")
    chained = pieces.mapInArrow(_matrix, _PIECE).groupBy("conv_id").applyInArrow(_chain, "piece int, conv_id bigint, begin string, end string, before bigint")
    chained = stage(chained, "states").select(F.col("piece").alias("p"), F.col("conv_id").alias("c"), "begin", "end", "before")
    joined = dealt.join(chained, (dealt["piece"] == chained["p"]) & dealt["conv_id"].eqNullSafe(chained["c"]))
    joined = joined.repartition(shuffle_width(spark), "piece").sortWithinPartitions("piece", "place")
    return joined.select("piece", "conv_id", "role", "text", "begin", "end", "before").mapInArrow(_repair, _OUT)
