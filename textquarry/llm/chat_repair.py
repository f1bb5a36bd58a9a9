"""Minimum-cost role repair of conversations, and their rendering.

A legal conversation is: at most one system turn, then user and assistant in turn, ending with assistant. A turn may be
kept, merged into the turn before it, or relabelled (and then kept or merged), and empty turns may be inserted before
it or at the end. The cheapest repair is a shortest path through the automaton of legal turns.

A conversation may be as long as the table, so none is gathered. Turns are range-partitioned by (conversation, turn);
each partition reduces its piece of a conversation to the costs from each state to each other, a min-plus matrix, the
few pieces of a conversation are chained to find the states at their borders, and then each partition traces its own part.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common as C

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
NAMES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT, "human": USER, "prompter": USER, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT, "developer": SYSTEM}
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
COSTS = {"merge": 1.0, "relabel": 2.0, "relabel_unknown": 1.0, "insert": 3.0}
INFINITE = float("inf")


def role_of(name: str | None) -> int:
    """The state a role leads to; 0 for a null or unknown one."""
    return NAMES.get((name or "").strip().lower(), 0)


def insertions(limit: int = 2) -> dict[tuple[int, int], tuple[int, ...]]:
    """The shortest chain of legal empty turns from one state to another."""
    found = {(q, q): () for q in range(4)}
    for n in range(1, limit + 1):
        for q in range(4):
            for chain in itertools.product((SYSTEM, USER, ASSISTANT), repeat=n):
                if all(b in LEGAL[a] for a, b in zip((q, *chain), chain)):
                    found.setdefault((q, chain[-1]), chain)
    return found


def moves(costs: dict[str, float]) -> dict[int, list[tuple[float, int, int, tuple[int, ...], str]]]:
    """For each role (0: unknown) the best (cost, from, to, inserted turns, action) between each two states."""
    out = {}
    for role in range(4):
        best: dict[tuple[int, int], tuple] = {}
        for (q, mid), chain in insertions().items():
            for to in (SYSTEM, USER, ASSISTANT):
                label = 0.0 if to == role else costs["relabel_unknown" if role == 0 else "relabel"]
                for action, extra in (("keep", 0.0 if to in LEGAL[mid] else INFINITE), ("merge", costs["merge"] if to == mid else INFINITE)):
                    cost = len(chain) * costs["insert"] + label + extra
                    name = action if to == role else f"relabel+{action}" if action == "merge" else "relabel"
                    move = (cost, q, to, chain, name)
                    if cost < INFINITE and ((q, to) not in best or move < best[q, to]):
                        best[q, to] = move
        out[role] = sorted(best.values(), key=lambda m: (m[2], m[0], m[1]))
    return out


def endings(costs: dict[str, float]) -> dict[int, tuple[float, tuple[int, ...]]]:
    """Cost and inserted turns to end a conversation in each state."""
    chains = insertions()
    return {q: (len(chains[q, ASSISTANT]) * costs["insert"], chains[q, ASSISTANT]) for q in (SYSTEM, USER, ASSISTANT)}


def forward(roles: list[int], table: dict, start: list[float]) -> tuple[list[float], list[list]]:
    """Costs of the states after the turns, from those before, and the move into each state at each turn."""
    cost, back = start, []
    for role in roles:
        new, came = [INFINITE] * 4, [None] * 4
        for move in table[role]:
            x = cost[move[1]] + move[0]
            if x < new[move[2]]:
                new[move[2]], came[move[2]] = x, move
        cost = new
        back.append(came)
    return cost, back


def trace(roles: list[int], table: dict, entry: int, exit_: int) -> list[tuple]:
    _, back = forward(roles, table, [0.0 if q == entry else INFINITE for q in range(4)])
    path, state = [], exit_
    for came in reversed(back):
        path.append(came[state])
        state = came[state][1]
    return path[::-1]


def best_end(cost: list[float], ends: dict) -> int:
    return min(ends, key=lambda q: (cost[q] + ends[q][0], q))


def head(role: int, first: bool) -> str:
    return ("" if first else "<|end|>\n") + f"<|{ROLES[role]}|>\n"


def plain(text: str | None) -> str:
    """Text in which no marker of the format can appear."""
    return (text or "").replace("<|", "< |")


def repair_chats(turns: DataFrame, costs: dict[str, float] | None = None) -> DataFrame:
    """conv_id, seq, turn, source_role, role, action, rendered: one row per turn of the input and per inserted turn.

    In order of seq, the rendered strings of a conversation make up its whole rendering. action is keep, merge, relabel,
    relabel+merge or insert; an inserted turn has null turn and source_role.

    Turns of a conversation go by turn, null first; ties by role, then by a hash of the text. Null or unknown role: any
    label, at its own cost. Null text: empty. Null conv_id: one conversation. Repeated rows are turns of their own and
    merge. Empty table: empty result. Extra columns are ignored.
    """
    costs = COSTS | (costs or {})
    table, ends = moves(costs), endings(costs)
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("__h", F.xxhash64("text"))
    order = ["conv_id", "turn", "role", "__h"]
    parts = C.group_count(turns)
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("__h")
    rows = rows.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id())
    # A range partitioning samples, and is fixed by being written.
    rows = C.cut(rows)

    def pieces(t: pa.Table):
        """(conv_id, first row, last row + 1) of a part, whose rows are in order."""
        conv = t.column("conv_id").to_pylist()
        s = 0
        for i in range(1, len(conv) + 1):
            if i == len(conv) or conv[i] != conv[s]:
                yield conv[s], s, i
                s = i

    conv_type = turns.schema["conv_id"].dataType
    piece_schema = T.StructType([T.StructField("conv_id", conv_type), T.StructField("part", T.IntegerType()), T.StructField("turns", T.LongType()), T.StructField("costs", T.ArrayType(T.DoubleType()))])
    border_schema = T.StructType([T.StructField("conv_id", conv_type), T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("leave", T.IntegerType()), T.StructField("last", T.BooleanType()), T.StructField("before", T.LongType())])

    def reduce_part(t):
        t = t.sort_by("pos")
        roles, part = [role_of(r) for r in t.column("role").to_pylist()], t.column("part")[0].as_py()
        conv, sizes, costs_ = [], [], []
        found = list(pieces(t))
        for c, s, e in found:
            # Only the first and the last conversation of a part can go on in another part.
            entries = range(4) if s == 0 or e == len(roles) else (START,)
            conv.append(c)
            sizes.append(e - s)
            costs_.append([x for q in range(4) for x in (forward(roles[s:e], table, [0.0 if p == q else INFINITE for p in range(4)])[0] if q in entries else [INFINITE] * 4)])
        return pa.table({"conv_id": pa.array(conv, t.schema.field("conv_id").type), "part": pa.array([part] * len(conv), pa.int32()), "turns": pa.array(sizes, pa.int64()), "costs": pa.array(costs_, pa.list_(pa.float64()))})

    def borders(t):
        t = t.sort_by([("part", "ascending")])
        by: dict = {}
        for c, p, n, m in zip(*(t.column(x).to_pylist() for x in ("conv_id", "part", "turns", "costs"))):
            by.setdefault(c, []).append((p, n, np.array(m).reshape(4, 4)))
        out: list[tuple] = []
        for c, chain in by.items():
            cost, back = np.array([0.0, INFINITE, INFINITE, INFINITE]), []
            for _, _, m in chain:
                ways = cost[:, None] + m
                back.append(ways.argmin(0))
                cost = ways.min(0)
            state, found, before = best_end(cost.tolist(), ends), [], sum(n for _, n, _ in chain)
            for (p, n, _), came in zip(reversed(chain), reversed(back)):
                before -= n
                found.append((c, p, int(came[state]), state, p == chain[-1][0], before))
                state = int(came[state])
            out += found[::-1]
        cols = list(zip(*out))
        types = [t.schema.field("conv_id").type, pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]
        return pa.Table.from_arrays([pa.array(x, y) for x, y in zip(cols, types)], names=border_schema.names)

    out = T.StructType([
        T.StructField("conv_id", conv_type), T.StructField("seq", T.LongType()), T.StructField("turn", turns.schema["turn"].dataType), T.StructField("source_role", T.StringType()),
        T.StructField("role", T.StringType()), T.StructField("action", T.StringType()), T.StructField("rendered", T.StringType()),
    ])
    arrow = to_arrow_schema(out)

    def render(left, right):
        if not left.num_rows:
            return C.empty_like(arrow)
        t = left.sort_by("pos")
        names, texts, turn = (t.column(c).to_pylist() for c in ("role", "text", "turn"))
        roles = [role_of(r) for r in names]
        known = {c: x for c, *x in zip(*(right.column(x).to_pylist() for x in ("conv_id", "entry", "leave", "last", "before")))}
        made = []
        for c, s, e in pieces(t):
            entry, leave, last, before = known[c]
            first, path = entry == START, trace(roles[s:e], table, entry, leave)
            for i, (_, _, to, chain, action) in zip(range(s, e), path):
                seq = (before + i - s) * 8
                for k, x in enumerate(chain):
                    made.append((c, seq + k, None, None, ROLES[x], "insert", head(x, first)))
                    first = False
                text = "\n\n" + plain(texts[i]) if action.endswith("merge") else head(to, first) + plain(texts[i])
                first = False
                made.append([c, seq + 3, turn[i], names[i], ROLES[to], action, text])
            if last:
                for k, x in enumerate(ends[leave][1]):
                    made.append([c, (before + e - 1 - s) * 8 + 4 + k, None, None, ROLES[x], "insert", head(x, first)])
                made[-1][-1] += "<|end|>\n"
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made), arrow)], names=arrow.names)

    reduced = rows.groupBy("part").applyInArrow(reduce_part, piece_schema)
    bucket = F.pmod(F.xxhash64("conv_id"), F.lit(parts))
    bounded = reduced.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(lambda t: borders(t), border_schema)
    return rows.groupBy("part").cogroup(bounded.groupBy("part")).applyInArrow(render, out)


def op6_repair_chats(spark, sf_dir: str) -> DataFrame:
    return repair_chats(C.read_documents(spark, sf_dir, "conversations"))
