"""Role repair: least cost by exhaustive search, legal results, rendering, spanning conversations."""

import itertools
import random
from collections import defaultdict

import pytest

from quire.llm import chat
from quire.llm.chat import repair

LEGAL = {("^", "s"), ("^", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def cheapest(roles):
    """Least cost by shortest paths over (turns read, state), one step at a time."""
    best = {(0, "^"): 0}
    todo = [(0, "^")]
    while todo:
        k, s = todo.pop(0)
        c = best[k, s]
        steps = [((k, t), c + chat.INSERT) for t in "sua" if (s, t) in LEGAL]
        if k < len(roles):
            for t in "sua":
                label = 0 if t == roles[k] else chat.RELABEL if roles[k] in "sua" else chat.RELABEL_UNKNOWN
                if t == s:
                    steps.append(((k + 1, t), c + label + chat.MERGE))
                if (s, t) in LEGAL:
                    steps.append(((k + 1, t), c + label))
        for key, cost in steps:
            if cost < best.get(key, 10**9):
                best[key] = cost
                todo.append(key)
    return best[len(roles), "a"]


def names(roles):
    return [{"s": "system", "u": "user", "a": "assistant"}.get(r, "tool") for r in roles]


def render(rows):
    return "".join(r.segment for r in sorted(rows, key=lambda r: (r.out_turn, r.part)))


def check(rows, roles, texts):
    rows = sorted(rows, key=lambda r: (r.out_turn, r.part))
    assert sum(r.cost for r in rows) == cheapest(roles)
    turns = defaultdict(list)
    for r in rows:
        turns[r.out_turn].append(r)
    assert sorted(turns) == list(range(len(turns)))
    seq = "^" + "".join(turns[i][0].role[0] for i in sorted(turns))
    assert all(p in LEGAL for p in itertools.pairwise(seq)) and seq[-1] == "a"
    assert all(len({r.role for r in t}) == 1 for t in turns.values())
    want = ""
    sources = iter(texts)
    for i in sorted(turns):
        parts = [next(sources) for r in turns[i] if r.action != "insert"]
        want += f"<|im_start|>{turns[i][0].role}\n" + "\n\n".join(parts) + "<|im_end|>\n"
    assert render(rows) == want


def frame(spark, convs):
    rows = [(c, t, names(roles)[t], f"{c}.{t}") for c, roles in convs.items() for t in range(len(roles))]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_all_short_sequences(spark):
    convs = dict(enumerate("".join(x) for n in range(1, 5) for x in itertools.product("sua?", repeat=n)))
    got = defaultdict(list)
    for r in repair(frame(spark, convs)).collect():
        got[r.conv_id].append(r)
    assert got.keys() == convs.keys()
    for c, roles in convs.items():
        check(got[c], roles, [f"{c}.{t}" for t in range(len(roles))])


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(1)
    convs = {1: "ua", 5: "".join(rng.choice("sua?uaua") for _ in range(3000)), 9: "uu"}
    got = defaultdict(list)
    df = repair(frame(spark, convs))
    for r in df.collect():
        got[r.conv_id].append(r)
    assert len({r.part >> 40 for r in got[5]}) > 1
    for c, roles in convs.items():
        check(got[c], roles, [f"{c}.{t}" for t in range(len(roles))])


def test_table(spark, sf):
    src = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    convs, got = defaultdict(list), defaultdict(list)
    for r in src:
        convs[r.conv_id].append(r)
    for r in chat.op1_chat_format(spark, sf).collect():
        got[r.conv_id].append(r)
    for c, rows in convs.items():
        check(got[c], "".join(r.role[0] for r in rows), [r.text for r in rows])


def test_edge_rows(spark):
    big = 2**62 + 1
    rows = [(None, None, None, None, 1), (None, 1, "user", "x", 1), (big, big, "user", None, 1), (big, big, "user", None, 1), (3, 0, "assistant", "y" * 200_000, 1)]
    got = repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.conv_id].append(r)
    assert sorted(map(str, by)) == sorted(map(str, (None, big, 3)))
    assert [r.action for r in sorted(by[big], key=lambda r: r.part)] == ["keep", "merge", "insert"]
    assert {r.turn for r in by[big]} == {big, None}
    assert render(by[3]) == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n" + "y" * 200_000 + "<|im_end|>\n"
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair(empty).collect() == []


@pytest.mark.parametrize("roles", ["uau", "suaua", "uuaa", "aua", "uaus"])
def test_least_cost_is_stable(roles):
    sources = [chat.source_role(n) for n in names(roles)]
    cost, _ = chat.best_from(sources, chat.START)
    assert min(c + chat.INSERT * len(chat.closing(f)) for f, c in enumerate(cost)) == cheapest(roles)
