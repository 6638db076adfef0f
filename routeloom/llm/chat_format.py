"""Chat formatting with minimum-cost role repair.

A conversation is legal when an optional system turn comes first and user and assistant turns then take
turns, user first.  Dynamic programming over that automaton's states decides for every
turn whether it is kept, relabelled, merged into the turn before it, or preceded by inserted empty turns,
so that the total cost is least.  The repaired turns are rendered as fragments, one for each input turn;
a conversation's fragments in order are its text.

The turns are dealt by range and cut into chunks of a few thousand, so a conversation may span any number of
chunks.  The cost of a chunk from every state to every state is a small min-plus matrix; the
matrices of a conversation's chunks, in order, fix the state at each border, and every chunk is then solved by
itself.  No conversation has to fit a task, however long it is.

Of equally cheap repairs the one stands whose states, read from the last turn to the first, come first in order (no turn, system, user,
assistant).  A matrix carries the order of its ways by that rule beside their costs, so the choice at
a border is the one that solving the whole conversation makes, wherever the borders are.

Defined cases: turns are ordered by turn number (null first), then role, then text; repeated rows are turns of
their own; a null or unknown role may take any role at a small cost; a null text is empty; rows with a null conversation
form one conversation; the strings that open and close a turn are broken up by a blank where a text contains
them; a very long text is one turn like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm import store
from routeloom.llm.blocks import by_block

ROLES = ("system", "user", "assistant")
_FAR = 1 << 50
_OPEN, _CLOSE = "<|im_start|>", "<|im_end|>"
#: States: nothing yet, then after each role.  Legal next roles of every state.
_NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}


@dataclass(frozen=True)
class Costs:
    merge: int = 10
    insert: int = 20
    relabel: int = 30
    name: int = 5  # a role for a turn whose own is null or unknown


class Repair:
    """Steps of the automaton: for an input role, from a state to a state."""

    def __init__(self, costs: Costs, chunk_bits: int = 12):
        self.chunk_bits = chunk_bits
        #: steps[role][state][next]: (cost, action, inserted roles); role 0 is unknown
        self.steps = [[[None] * 4 for _ in range(4)] for _ in range(4)]
        for role in range(4):
            for state in range(4):
                for to in (1, 2, 3):
                    label = 0 if to == role else costs.name if role == 0 else costs.relabel
                    options = []
                    if to in _NEXT[state]:
                        options.append((label, "keep" if to == role else "relabel", ()))
                    if to == state:
                        options.append((label + costs.merge, "merge", ()))
                    for path in self._paths(state):
                        if to in _NEXT[path[-1]]:
                            options.append((label + costs.insert * len(path), "insert", path))
                    if options:
                        self.steps[role][state][to] = min(options, key=lambda o: o[0])

    @staticmethod
    def _paths(state: int) -> list[tuple[int, ...]]:
        """One or two empty turns that may follow a state."""
        one = [(a,) for a in _NEXT[state]]
        return one + [(a, b) for (a,) in one for b in _NEXT[a]]

    def matrix(self, roles: list[int]) -> list[int]:
        """Least cost from every state to every state over the turns, then the place of each start among
        the ways to one end: ways are compared from their last state back, then by their start."""
        costs, ways = [], {}
        for start in range(4):
            f = [_FAR] * 4
            f[start] = 0
            rows = self.forward(f, roles)
            costs += rows[-1]
            for to in range(1, 4):
                if rows[-1][to] < _FAR:
                    ways[start, to] = [*(w[0] for w in self._back(rows, roles, to)), start]
        place = [0] * 16
        for to in range(1, 4):
            order = sorted((s for s in range(4) if (s, to) in ways), key=lambda s: ways[s, to])  # noqa: B023
            for k, s in enumerate(order):
                place[4 * s + to] = k
        return costs + place

    def _back(self, rows: list[list[int]], roles: list[int], state: int) -> list[tuple[int, int, str, tuple[int, ...]]]:
        """The way to ``state``, last turn first; of equal ways back the lowest state wins."""
        out = []
        for i in range(len(roles) - 1, -1, -1):
            steps = self.steps[roles[i]]
            before = min(
                (s for s in range(4) if rows[i][s] < _FAR and steps[s][state] is not None), key=lambda s: (rows[i][s] + steps[s][state][0], s)  # noqa: B023
            )
            cost, action, inserted = steps[before][state]
            out.append((state, cost, action, inserted))
            state = before
        return out

    def forward(self, f: list[int], roles: list[int]) -> list[list[int]]:
        rows = [f]
        for role in roles:
            step, g = self.steps[role], [_FAR] * 4
            for s in range(4):
                if f[s] < _FAR:
                    for to in (1, 2, 3):
                        o = step[s][to]
                        if o is not None and f[s] + o[0] < g[to]:
                            g[to] = f[s] + o[0]
            rows.append(f := g)
        return rows

    def solve(self, roles: list[int], entry: int = 0, leave: int | None = None) -> list[tuple[int, int, str, tuple[int, ...]]]:
        """(role, cost, action, inserted) of every turn."""
        f = [_FAR] * 4
        f[entry] = 0
        rows = self.forward(f, roles)
        state = leave if leave is not None else min((1, 2, 3), key=lambda s: (rows[-1][s], s))
        return self._back(rows, roles, state)[::-1]


def _role(name: str | None) -> int:
    name = (name or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else 0


def _runs(conv: list) -> list[tuple[int, int]]:
    edges = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
    return list(zip(edges, edges[1:], strict=False))


def _quote(text: str | None) -> str:
    return (text or "").replace("<|im_", "<| im_")


def _fragment(role: int, action: str, inserted: tuple[int, ...], text: str | None, first: bool, last: bool) -> str:
    if action == "merge":
        body = "\n\n" + _quote(text)
    else:
        empty = "".join(f"{_OPEN}{ROLES[r - 1]}\n{_CLOSE}\n" for r in inserted)
        body = ("" if first else f"{_CLOSE}\n") + empty + f"{_OPEN}{ROLES[role - 1]}\n" + _quote(text)
    return body + (f"{_CLOSE}\n" if last else "")


def _summaries(repair: Repair):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        conv, roles = table["conv_id"].to_pylist(), [_role(r) for r in table["role"].to_pylist()]
        runs = _runs(conv)
        ends = [runs[0]] if len(runs) == 1 else [runs[0], runs[-1]]
        rows = {"conv_id": [], "chunk": [], "costs": []}
        for a, b in ends:
            rows["conv_id"].append(conv[a])
            rows["chunk"].append(table["chunk"][0].as_py())
            rows["costs"].append(repair.matrix(roles[a:b]))
        return pa.table({"conv_id": pa.array(rows["conv_id"], table["conv_id"].type), "chunk": pa.array(rows["chunk"], pa.int64()), "costs": pa.array(rows["costs"], pa.list_(pa.int64()))})

    return run


def _borders(table: pa.Table) -> pa.Table:
    """States in which a conversation enters and leaves each of its chunks."""
    table = table.sort_by("chunk")
    costs = table["costs"].to_pylist()
    n = len(costs)
    f, rows = [0, _FAR, _FAR, _FAR], []
    for m in costs:
        rows.append(f)
        f = [min(f[s] + m[4 * s + t] for s in range(4)) for t in range(4)]
    state = min((1, 2, 3), key=lambda s: (f[s], s))
    entry, leave = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        leave[i] = state
        state = min(range(4), key=lambda s: (rows[i][s] + costs[i][4 * s + state], costs[i][16 + 4 * s + state]))  # noqa: B023
        entry[i] = state
    return pa.table({
        "conv_id": table["conv_id"], "chunk": table["chunk"], "entry": pa.array(entry, pa.int32()), "leave": pa.array(leave, pa.int32()),
        "first": pa.array([i == 0 for i in range(n)]), "last": pa.array([i == n - 1 for i in range(n)]),
    })


def _solutions(repair: Repair):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("pos")
        border = {r["conv_id"]: r for r in by_block(right)}
        conv, names, texts = (left[c].to_pylist() for c in ("conv_id", "role", "text"))
        roles = [_role(r) for r in names]
        out, fragments = [], []
        for a, b in _runs(conv):
            # a conversation at a border of the chunk may have come from the chunk before or go on in the next
            at = border.get(conv[a]) if a == 0 or b == len(conv) else None
            first, last = at is None or at["first"], at is None or at["last"]
            ways = repair.solve(roles[a:b], at["entry"] if at else 0, at["leave"] if at else None)
            out += ways
            for i, (role, _, action, inserted) in enumerate(ways):
                fragments.append(_fragment(role, action, inserted, texts[a + i], first and i == 0, last and a + i == b - 1))
        return pa.table({
            "conv_id": left["conv_id"], "pos": left["pos"], "turn": left["turn"], "role": left["role"],
            "repaired_role": pa.array([ROLES[w[0] - 1] for w in out], pa.string()),
            "action": pa.array([w[2] for w in out], pa.string()),
            "inserted": pa.array([[ROLES[r - 1] for r in w[3]] for w in out], pa.list_(pa.string())),
            "cost": pa.array([w[1] for w in out], pa.int64()), "fragment": pa.array(fragments, pa.string()),
        })

    return run


def repair_chats(turns: DataFrame, costs: Costs = Costs(), *, chunk_bits: int = 12) -> DataFrame:
    """One row per input turn (conv_id, turn, role, text): conv_id, pos (order), turn, role, repaired_role, action,
    inserted (empty turns put before it), cost and fragment."""
    spark, repair = turns.sparkSession, Repair(costs, chunk_bits)
    n = store.shuffle_partitions(spark)
    rows = turns.select("conv_id", "turn", "role", "text").withColumns({"mark": F.xxhash64("text"), "tag": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "mark", "tag"]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions("conv_id", "turn", "role", "text", "tag")
    rows = rows.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("pos"))
    rows = store.materialize(rows.withColumn("chunk", F.shiftright("pos", chunk_bits)), "turns")
    kinds = dict(rows.dtypes)
    ends = rows.select("conv_id", "role", "pos", "chunk").groupBy("chunk").applyInArrow(
        _summaries(repair), f"conv_id {kinds['conv_id']}, chunk long, costs array<long>"
    )
    ends = store.materialize(ends, "ends")
    borders = ends.groupBy("conv_id").applyInArrow(
        _borders, f"conv_id {kinds['conv_id']}, chunk long, entry int, leave int, first boolean, last boolean"
    )
    return rows.groupBy("chunk").cogroup(borders.groupBy("chunk")).applyInArrow(
        _solutions(repair),
        f"conv_id {kinds['conv_id']}, pos long, turn {kinds['turn']}, role string, repaired_role string, action string, "
        "inserted array<string>, cost long, fragment string",
    )
