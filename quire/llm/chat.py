"""Chat formatting by minimum-cost role repair (operator 1).

A conversation is legal if its turns are: one system turn or none, then user
and assistant in turn, beginning with the user and ending with the assistant.
A dynamic program over this automaton repairs any sequence at the least cost:
each turn keeps its role or is relabelled, goes on with the open turn (a merge)
or opens one, and empty turns are inserted where the automaton needs them.

Costs of a stretch of turns are a small matrix (state before, state after) under
(min, +), and matrices compose.  Turns are therefore dealt by ranges of
(conversation, turn); a conversation that spans several tasks is solved from one
matrix a task, which the driver chains to find the states at the borders (two
stretches a task at most).  No conversation is gathered in one place.

The result has one row for each source turn and inserted turn, with the segment
it adds to the rendered conversation: concatenating ``segment`` by (out_turn,
part) gives it.  A merged turn is several rows (parts) of one out_turn.

Defined cases: a role that isn't system, user or assistant, or is null, is
relabelled at a lower cost; null text is empty; a null conv_id is a conversation
of its own; null turns come first; equal turns are ordered by role and text;
repeated rows are turns of their own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import fixed_partitions, read

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: Roles that may open a turn after each state.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, INSERT, RELABEL, RELABEL_UNKNOWN = 2, 3, 6, 1
FAR = 10**12


def _inserts() -> list[list[tuple[int, ...] | None]]:
    """Shortest runs of empty turns that lead from one state to another."""
    best: list[list[tuple[int, ...] | None]] = [[None] * 4 for _ in range(4)]
    for s in range(4):
        best[s][s] = ()
        todo = [s]
        while todo:
            x = todo.pop(0)
            for y in NEXT[x]:
                if best[s][y] is None:
                    best[s][y] = (*best[s][x], y)
                    todo.append(y)
    return best


INSERTS = _inserts()


def _moves() -> dict[int, list[tuple[int, int, int, bool, tuple[int, ...]]]]:
    """For each source role (0 if unknown): (before, after, cost, merged, inserted)."""
    out = {}
    for source in range(4):
        moves = []
        for before in range(4):
            for role in (SYSTEM, USER, ASSISTANT):
                label = 0 if role == source else RELABEL if source else RELABEL_UNKNOWN
                if before == role:
                    moves.append((before, role, label + MERGE, True, ()))
                for mid in range(4):
                    run = INSERTS[before][mid]
                    if run is not None and role in NEXT[mid] and len(run) <= 2:
                        moves.append((before, role, label + INSERT * len(run), False, run))
        # Of equal costs: no merge before a merge, few inserts, smaller roles first.
        out[source] = sorted(moves, key=lambda m: (m[2], m[3], len(m[4]), m[0], m[1], m[4]))
    return out


MOVES = _moves()


def closing(state: int) -> tuple[int, ...]:
    """Empty turns at the end, so that the last one is the assistant's."""
    if state == START:
        return ()
    return INSERTS[state][ASSISTANT]


def best_from(sources: list[int], entry: int) -> tuple[list[int], list[list[int]]]:
    """Costs by final state, and for each turn the best move's index by state after."""
    cost = [FAR] * 4
    cost[entry] = 0
    back = []
    for s in sources:
        new, via = [FAR] * 4, [-1] * 4
        for k, (a, b, c, _, _) in enumerate(MOVES[s]):
            if cost[a] + c < new[b]:
                new[b], via[b] = cost[a] + c, k
        cost = new
        back.append(via)
    return cost, back


def trace(sources: list[int], back: list[list[int]], final: int) -> list[tuple]:
    """The moves of the best way to ``final``."""
    out = []
    for s, via in zip(reversed(sources), reversed(back), strict=True):
        move = MOVES[s][via[final]]
        out.append(move)
        final = move[0]
    return out[::-1]


def opened(moves: list[tuple]) -> int:
    return sum(len(m[4]) + (not m[3]) for m in moves)


def summary(sources: list[int]) -> tuple[list[list[int]], list[list[int]]]:
    """Cost and number of turns opened, by state before and after."""
    costs, turns = [], []
    for entry in range(4):
        cost, back = best_from(sources, entry)
        costs.append(cost)
        turns.append([opened(trace(sources, back, f)) if cost[f] < FAR else 0 for f in range(4)])
    return costs, turns


def source_role(role: str | None) -> int:
    return ROLES.index(role) + 1 if role in ROLES else 0


def _stretches(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[int, int, list[int], pd.DataFrame]]:
    """(task, conv_id, source roles, rows) of each run of one conversation in sorted batches."""
    held: list[pd.DataFrame] = []

    def one() -> tuple[int, int, list[int], pd.DataFrame]:
        pdf = pd.concat(held) if len(held) > 1 else held[0]
        return int(pdf["task"].iloc[0]), int(pdf["conv_id"].iloc[0]), [source_role(x) for x in pdf["role"]], pdf

    for pdf in batches:
        if pdf.empty:
            continue
        keys = pdf["conv_id"].to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and held[-1]["conv_id"].iloc[0] != keys[a]:
                yield one()
                held = []
            held.append(pdf.iloc[a:b])
    if held:
        yield one()


def _ends(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Summaries of a task's first and last stretch; all others are whole conversations."""
    kept: list[tuple] = []
    for task, conv, sources, _ in _stretches(batches):
        kept = [*kept[:1], (task, conv, sources)]
    rows = []
    for place, (task, conv, sources) in enumerate(kept):
        costs, turns = summary(sources)
        rows.append((task, place, conv, [x for r in costs for x in r], [x for r in turns for x in r]))
    yield pd.DataFrame(rows, columns=["task", "place", "conv_id", "costs", "turns"])


def _chain(run: list, borders: dict[tuple[int, int], tuple[int, int, int, bool]]) -> None:
    """States at the borders of one conversation's stretches, by (min, +) products."""
    costs, back = [0, FAR, FAR, FAR], []
    for r in run:
        new, via = [FAR] * 4, [0] * 4
        for a in range(4):
            for b in range(4):
                c = costs[a] + r.costs[4 * a + b]
                if c < new[b]:
                    new[b], via[b] = c, a
        costs = new
        back.append(via)
    states = [_final(costs)]
    for via in reversed(back):
        states.append(via[states[-1]])
    states.reverse()
    before = 0
    for k, r in enumerate(run):
        borders[r.task, r.conv_id] = (states[k], states[k + 1], before, k == len(run) - 1)
        before += r.turns[4 * states[k] + states[k + 1]]


def _final(costs: list[int]) -> int:
    return min(range(4), key=lambda f: (costs[f] + INSERT * len(closing(f)), f))


NONE = -(2**63)
COLUMNS = "conv_id long, turn long, source_role string, role string, action string, cost long, out_turn long, part long, segment string"


def repair(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", header: str = "<|im_start|>{role}\n", footer: str = "<|im_end|>\n", joiner: str = "\n\n") -> DataFrame:
    """conv_id, turn, source_role, role, action, cost, out_turn, part, segment.

    ``action`` is keep, relabel, merge, relabel+merge or insert; ``turn`` and
    ``source_role`` are null for inserted turns.  The footer of a turn is at the
    head of the segment that opens the next one, or at the conversation's end.
    """
    spark = conversations.sparkSession
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NONE))
    c = conversations.select(number(conv_id).alias("conv_id"), number(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    # Identical rows may be parted anywhere, hence the last key.
    c = c.withColumn("h", F.xxhash64("text")).withColumn("i", F.monotonically_increasing_id())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = c.repartitionByRange(n, "conv_id", "turn", "role", "h", "i").sortWithinPartitions("conv_id", "turn", "role", "h", "i")
    held = fixed_partitions(ranged.drop("h", "i").withColumn("task", F.spark_partition_id()))

    summaries = held.select("conv_id", "role", "task").mapInPandas(_ends, "task int, place int, conv_id long, costs array<long>, turns array<long>")
    pieces = sorted(summaries.collect(), key=lambda r: (r.task, r.place))  # two rows a task at most
    borders: dict[tuple[int, int], tuple[int, int, int, bool]] = {}
    run: list = []
    for r in [*pieces, None]:
        if run and (r is None or r.conv_id != run[0].conv_id):
            if len(run) > 1:
                _chain(run, borders)
            run = []
        run.append(r)
    sent = spark.sparkContext.broadcast(borders)

    def solve(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending: list[list] = []
        for task, conv, sources, pdf in _stretches(batches):
            entry, final, before, over = sent.value.get((task, conv), (START, None, 0, True))
            cost, back = best_from(sources, entry)
            final = _final(cost) if final is None else final
            out_turn, rows = before - 1, []

            def add(turn, source, role, action, cost, lead, body="", opens=True, conv=conv, task=task, rows=rows):
                nonlocal out_turn
                if opens:
                    out_turn += 1
                    lead = (footer if out_turn else "") + lead
                rows.append([conv, turn, source, role, action, cost, out_turn, (task << 40) + len(rows), lead + body])

            for t, said, body, (_, to, price, merged, inserted) in zip(pdf["turn"], pdf["role"], pdf["text"], trace(sources, back, final), strict=True):
                for x in inserted:
                    add(NONE, None, ROLES[x - 1], "insert", INSERT, header.format(role=ROLES[x - 1]))
                name = ROLES[to - 1]
                action = "+".join([x for x, y in (("relabel", name != said), ("merge", merged)) if y]) or "keep"
                add(t, said, name, action, price - INSERT * len(inserted), joiner if merged else header.format(role=name), body or "", opens=not merged)
            if over:
                for x in closing(final):
                    add(NONE, None, ROLES[x - 1], "insert", INSERT, header.format(role=ROLES[x - 1]))
                rows[-1][-1] += footer
            pending += rows
            if len(pending) >= 5_000:
                yield pd.DataFrame(pending, columns=[x.split()[0] for x in COLUMNS.split(", ")])
                pending = []
        yield pd.DataFrame(pending, columns=[x.split()[0] for x in COLUMNS.split(", ")])

    out = held.mapInPandas(solve, COLUMNS)
    null = lambda c: F.when(F.col(c) != NONE, F.col(c)).alias(c)
    return out.select(null("conv_id"), null("turn"), *out.columns[2:])


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(read(spark, sf_dir, "conversations"))
