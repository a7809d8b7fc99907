"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation from user to assistant. A
dynamic program over the automaton of legal turns repairs the roles of a conversation at least cost: a turn is kept,
merged into the one before, or relabelled, and an empty turn is inserted where one is missing. The states are the role of
the last turn so far; what a turn does to the costs is a 4 x 4 matrix in the (min, +) algebra.

Matrices can be multiplied block by block, so a conversation of any length is repaired in parallel: turns are range
partitioned by conversation, turn and a tie hash, each partition reports one matrix for each conversation that reaches
its edges, entry costs and exit states are found from these few matrices, and every partition then runs its own part.
The rendered conversation is the concatenation of ``rendered`` in the order of ``pos``; no row holds a whole one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardline.llm.shared import written

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
#: Costs of the repairs; keeping a turn is free.
MERGE, RELABEL, INSERT = 2, 3, 4
#: States: nothing yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_STATE = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
#: Which role may follow which state.
_NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = np.int64(1 << 60)


def _steps() -> dict[int, list[list[tuple[int, str, tuple[int, ...]]]]]:
    """For each given role (0 if unknown) and pair of states the cheapest (cost, action, inserted roles)."""
    steps = {}
    for given in (0, SYSTEM, USER, ASSISTANT):
        table = [[(int(FAR), "", ()) for _ in range(4)] for _ in range(4)]
        for before in range(4):
            for role in (SYSTEM, USER, ASSISTANT):
                change = 0 if role == given else RELABEL
                name = "keep" if role == given else "relabel"
                choices = []
                if role in _NEXT[before]:
                    choices.append((change, name, ()))
                for extra in _NEXT[before]:
                    if role in _NEXT[extra]:
                        choices.append((change + INSERT, name, (extra,)))
                if role == before:
                    choices.append((change + MERGE, "merge" if role == given else "relabel+merge", ()))
                if choices:
                    table[before][role] = min(choices, key=lambda c: (c[0], c[1], c[2]))
        steps[given] = table
    return steps


_STEPS = _steps()
_COST = {g: np.array([[c[0] for c in row] for row in t], dtype=np.int64) for g, t in _STEPS.items()}
#: Cost of ending in a state: an assistant turn must come last; an empty conversation stays empty.
_END = np.array([0, 2 * INSERT, INSERT, 0], dtype=np.int64)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def _given(role: str | None) -> int:
    name = (role or "").strip().lower()
    return _STATE.get(ALIASES.get(name, name), 0)


def repair_roles(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, turn, role, new_role, action, inserted, behind, rendered: one row for each row of ``conversations``.

    pos is the place among the rows of a conv_id, ordered by turn (null first), then a hash of role and text. action is
    keep, merge, relabel or relabel+merge; inserted lists the empty turns put before it, behind those after the last row.
    Null and unknown roles are relabelled; a null text renders as empty; rows without conv_id form one conversation; ties
    between repairs of equal cost go to the lower state. Repeated rows are turns like others. Other columns are not read.
    """
    order = ["key", "turn", "tie"]
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text",
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("key"),
        F.xxhash64("role", "text").alias("tie"),
    )
    dealt = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt = written(dealt.withColumn("line", F.monotonically_increasing_id()), "turns")
    runs = written(_over_runs(dealt.select("key", "part", *order[1:], "line", "role"), _matrices, ["key", "part"], _ASC, "n long, costs array<long>"), "runs")
    ends = _over_runs(runs, _ends, ["key"], ["part desc"], "part int, togo array<long>, final boolean")
    back = _over_runs(
        dealt.join(ends, ["key", "part"]), _backward, ["key", "part"], [f"{c} desc" for c in _ASC],
        "conv_id long, turn long, tie long, line long, role string, text string, after array<long>, closing boolean, exits array<int>",
    )
    back = written(back, "costs")
    maps = back.filter("exits is not null").select("key", "part", "exits").join(runs.select("key", "part", "n"), ["key", "part"])
    entries = _over_runs(maps, _entries, ["key"], ["part"], "part int, entry int, start long")
    return _over_runs(
        back.drop("exits").join(written(entries, "entries"), ["key", "part"]), _forward, ["key", "part"], _ASC,
        "conv_id long, pos long, turn long, role string, new_role string, action string, inserted string, behind string, rendered string",
    ).drop("key", "part")


_ASC = ["turn", "tie", "line"]


def _over_runs(rows: DataFrame, make, keys: list[str], order: list[str], fields: str) -> DataFrame:
    """Streams the rows of each key, in order, through a generator function that yields output rows (dictionaries).

    Keys are dealt over tasks; one task sees a key as a stream and holds one batch and the generator's state.
    """
    by = [F.col(c) for c in keys] + [F.col(o.removesuffix(" desc")).desc() if o.endswith(" desc") else F.col(o).asc() for o in order]
    rows = rows.repartition(*keys).sortWithinPartitions(*by)
    names = ["key"] + (["part"] if "part" in keys else [])
    schema = ", ".join(f"{n} {'string' if n == 'key' else 'int'}" for n in names) + ", " + fields
    from pyspark.sql.pandas.types import to_arrow_schema

    target = rows.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if own != key:
                    if state is not None:
                        out += state.close()
                    key, state = own, make(dict(zip(keys, own, strict=True)))
                out += state.take(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if state is not None and (out := state.close()):
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, target)


class _Run:
    def __init__(self, key: dict) -> None:
        self.key = key

    def take(self, row: dict) -> list[dict]:
        return []

    def close(self) -> list[dict]:
        return []


class _matrices(_Run):
    """Product of the cost matrices of a run."""

    def __init__(self, key: dict) -> None:
        super().__init__(key)
        self.n, self.costs = 0, np.where(np.eye(4, dtype=bool), np.int64(0), FAR)

    def take(self, row: dict) -> list[dict]:
        self.n, self.costs = self.n + 1, _times(self.costs, _COST[_given(row["role"])])
        return []

    def close(self) -> list[dict]:
        return [{**self.key, "n": self.n, "costs": self.costs.ravel().tolist()}]


class _ends(_Run):
    """Least cost from the end of each run to the end of its conversation; runs come last to first."""

    def __init__(self, key: dict) -> None:
        super().__init__(key)
        self.togo, self.final = _END, True

    def take(self, row: dict) -> list[dict]:
        out = {**self.key, "part": row["part"], "togo": self.togo.tolist(), "final": self.final}
        costs = np.array(row["costs"], dtype=np.int64).reshape(4, 4)
        self.togo, self.final = np.minimum((costs + self.togo[None, :]).min(axis=1), FAR), False
        return [out]


class _backward(_Run):
    """Adds to each row the least cost after it; the first row of the run also gets exit state by entry state."""

    def __init__(self, key: dict) -> None:
        super().__init__(key)
        self.togo, self.exits, self.held = None, list(range(4)), None

    def take(self, row: dict) -> list[dict]:
        final = row.pop("final") and self.togo is None
        first = row.pop("togo")
        self.togo = np.array(first, dtype=np.int64) if self.togo is None else self.togo
        out = [self.held] if self.held else []
        self.held = {**row, "after": self.togo.tolist(), "closing": final, "exits": None}
        both = _COST[_given(row["role"])] + self.togo[None, :]
        self.exits = [self.exits[int(q)] for q in both.argmin(axis=1)]
        self.togo = np.minimum(both.min(axis=1), FAR)
        return out

    def close(self) -> list[dict]:
        return [{**self.held, "exits": self.exits}]


class _entries(_Run):
    """State and place at which each run begins; runs come first to last."""

    def __init__(self, key: dict) -> None:
        super().__init__(key)
        self.state, self.start = START, 0

    def take(self, row: dict) -> list[dict]:
        out = {**self.key, "part": row["part"], "entry": self.state, "start": self.start}
        self.state, self.start = row["exits"][self.state], self.start + row["n"]
        return [out]


class _forward(_Run):
    """Chooses the repair of each row and renders it."""

    def __init__(self, key: dict) -> None:
        super().__init__(key)
        self.state, self.pos = None, 0

    def take(self, row: dict) -> list[dict]:
        if self.state is None:
            self.state, self.pos = row["entry"], row["start"]
        given = _given(row["role"])
        choice = int((_COST[given][self.state] + np.array(row["after"], dtype=np.int64)).argmin())
        _, action, extra = _STEPS[given][self.state][choice]
        text, role = row["text"] or "", ROLES[choice - 1]
        if action.endswith("merge"):
            rendered = "\n" + text
        else:
            rendered = (_CLOSE if self.pos else "") + "".join(_opened(x) + _CLOSE for x in extra) + _opened(choice) + text
        behind = {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,)}.get(choice, ()) if row["closing"] else ()
        if row["closing"]:
            rendered += _CLOSE + "".join(_opened(x) + _CLOSE for x in behind)
        out = {
            **self.key, "conv_id": row["conv_id"], "pos": self.pos, "turn": row["turn"], "role": row["role"], "new_role": role,
            "action": action, "inserted": ",".join(ROLES[x - 1] for x in extra), "behind": ",".join(ROLES[x - 1] for x in behind),
            "rendered": rendered,
        }
        self.state, self.pos = choice, self.pos + 1
        return [out]


_CLOSE = "<|end|>\n"


def _opened(state: int) -> str:
    return f"<|{ROLES[state - 1]}|>\n"
