"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, ending with an assistant
turn. A dynamic program over that automaton chooses for every turn whether its role stays or is relabelled, whether it
opens a turn or is merged into the one before, and where empty turns are inserted, at the least total cost. Long
conversations are cut into segments: each segment is summed up by the cheapest cost between any two states, these are
joined along the conversation, and every segment is then repaired on its own between the states that the best path gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmnet.llm.common import partitions
from firmnet.operators.rank import distributed_rank
from firmnet.storage import materialize

ROLES = ("system", "user", "assistant")
# States: nothing said yet, or the role that spoke last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
# Costs of repairs.
MERGE, INSERT = 1.0, 3.0
RELABEL = {("system", "user"): 1.5, ("system", "assistant"): 4.0, ("user", "assistant"): 2.5, ("user", "system"): 4.0,
           ("assistant", "user"): 2.5, ("assistant", "system"): 4.0}
RELABEL_UNKNOWN = 2.0
SEGMENT = 512  # turns
ROWS_PER_TASK = 20_000
SEPARATOR = "\n\n"

# What opens and closes a rendered turn.
OPEN, CLOSE = "<|im_start|>{role}\n", "<|im_end|>\n"


def _steps() -> list[tuple[int, int, float, tuple[int, ...], bool]]:
    """(from, to, cost, empty turns inserted first, merged) for a turn that is given the role ``to``."""
    out = []
    for a in range(STATES):
        for b in (SYSTEM, USER, ASSISTANT):
            if a == b:
                out.append((a, b, MERGE, (), True))
            if b == SYSTEM:
                if a == START:
                    out.append((a, b, 0.0, (), False))
            elif b == USER:
                if a == USER:
                    out.append((a, b, INSERT, (ASSISTANT,), False))
                else:
                    out.append((a, b, 0.0, (), False))
            elif a == USER:
                out.append((a, b, 0.0, (), False))
            else:
                out.append((a, b, INSERT, (USER,), False))
    return out


STEPS = _steps()
ENDING = {START: (0.0, ()), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), USER: (INSERT, (ASSISTANT,)), ASSISTANT: (0.0, ())}


def relabel_cost(role: str | None, to: int) -> float:
    role = (role or "").strip().lower()
    return 0.0 if role == ROLES[to - 1] else RELABEL.get((role, ROLES[to - 1]), RELABEL_UNKNOWN)


def advance(costs: np.ndarray, role: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest costs after one more turn, for each row of ``costs`` (by state), and the step that led there."""
    out, by = np.full_like(costs, np.inf), np.full(costs.shape, -1)
    for k, (a, b, cost, _, _) in enumerate(STEPS):
        c = costs[:, a] + cost + relabel_cost(role, b)
        better = c < out[:, b] - 1e-9
        out[better, b], by[better, b] = c[better], k
    return out, by


def segment_costs(roles: list[str | None]) -> np.ndarray:
    """Cheapest cost of a segment between any two states."""
    costs = np.where(np.eye(STATES) > 0, 0.0, np.inf)
    for r in roles:
        costs, _ = advance(costs, r)
    return costs


def segment_path(roles: list[str | None], start: int, end: int) -> list[int]:
    """Steps of the cheapest way from ``start`` to ``end``."""
    costs, trail = np.where(np.arange(STATES) == start, 0.0, np.inf)[None, :], []
    for r in roles:
        costs, by = advance(costs, r)
        trail.append(by[0])
    path, at = [], end
    for by in reversed(trail):
        path.append(int(by[at]))
        at = STEPS[path[-1]][0]
    return path[::-1]


def join_segments(matrices: list[np.ndarray]) -> tuple[list[tuple[int, int]], float]:
    """Entry and exit state of each segment on the best path, and its cost with the ending."""
    costs, trail = np.where(np.arange(STATES) == START, 0.0, np.inf), []
    for m in matrices:
        through = costs[:, None] + m
        trail.append(through.argmin(0))
        costs = through.min(0)
    total = costs + np.array([ENDING[s][0] for s in range(STATES)])
    at = int(total.argmin())
    ends = []
    for back in reversed(trail):
        ends.append((int(back[at]), at))
        at = int(back[at])
    return ends[::-1], float(total.min())


def repaired(turns: list[tuple], start: int, end: int, last: bool) -> list[tuple]:
    """Rows (turn, part, action, role, text, rendered) of a segment; ``turns`` holds (turn, role, text)."""
    out, said = [], start != START

    def opened(turn, action: str, role: int, text: str) -> None:
        nonlocal said
        head = (CLOSE if said else "") + OPEN.format(role=ROLES[role - 1])
        said = True
        out.append([turn, 0, action, ROLES[role - 1], text, head + text])

    for (turn, role, text), k in zip(turns, segment_path([t[1] for t in turns], start, end)):
        _, to, _, inserted, merged = STEPS[k]
        text = text or ""
        for r in inserted:
            opened(turn, "insert", r, "")
        kept = "" if relabel_cost(role, to) == 0 else "relabel"
        if merged:
            out.append([turn, 0, f"{kept}+merge".lstrip("+"), ROLES[to - 1], text, SEPARATOR + text])
        else:
            opened(turn, kept or "keep", to, text)
    if last:
        for r in ENDING[end][1]:
            opened(turns[-1][0], "insert", r, "")
        out[-1][5] += CLOSE
    return [tuple(r) for r in out]


def _groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[tuple, list[tuple]]]:
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    return ((k, list(g)) for k, g in groupby(rows, key=lambda r: r[:key]))


def _batches(rows: Iterator[tuple], form: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), form)], schema=form)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), form)], schema=form)


_MATRIX = pa.schema([("_conv", pa.string()), ("_seg", pa.int64()), ("costs", pa.list_(pa.float64()))])
_ENDS = pa.schema([("_conv", pa.string()), ("_seg", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("last", pa.bool_()), ("cost", pa.float64())])
_TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("place", pa.int64()), ("part", pa.int32()), ("action", pa.string()), ("role", pa.string()),
                    ("text", pa.string()), ("rendered", pa.string()), ("cost", pa.float64())])


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batches(((*k, segment_costs([r[3] for r in g]).ravel().tolist()) for k, g in _groups(batches, 2)), _MATRIX)


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for (conv,), g in _groups(batches, 1):
            ends, cost = join_segments([np.array(r[2]).reshape(STATES, STATES) for r in g])
            for n, (r, (a, b)) in enumerate(zip(g, ends)):
                yield conv, r[1], a, b, n == len(g) - 1, cost

    return _batches(rows(), _ENDS)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for _, g in _groups(batches, 2):
            start, end, last, cost, conv_id = g[0][3:8]
            place = g[0][2]
            for part, (turn, _, action, role, text, rendered) in enumerate(repaired([r[8:] for r in g], start, end, last)):
                yield conv_id, turn, place, part, action, role, text, rendered, cost

    return _batches(rows(), _TURNS)


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each turn kept, relabelled, merged or inserted: (conv_id, turn, place, part, action, role, text,
    rendered, cost). ``rendered`` joined in order of place and part is the rendered conversation; ``cost`` is that of
    the whole repair. An inserted turn has the number of the turn beside it.

    Turns of a conversation go by number (NULL last), then role and text, so repeated turns are kept and follow each
    other. A NULL text is empty, an unknown or NULL role is relabelled, rows with a NULL id are conversations of their
    own. A segment holds at most ``SEGMENT`` turns, however long or repeated the conversation is.
    """
    rows = turns.select(
        F.coalesce(F.concat(F.lit("c"), F.col(conv_id).cast("string")), F.concat(F.lit("n"), F.monotonically_increasing_id().cast("string"))).alias("_conv"),
        F.col(conv_id).cast("long").alias("_id"), F.col(turn).cast("long").alias("_turn"), F.col(turn).isNull().alias("_late"),
        F.col(role).alias("_role"), F.col(text).alias("_text"))
    order = [("_late", True), ("_turn", True), ("_role", True), ("_text", True)]
    ranked = distributed_rank(rows, order, "_no", ("_conv",))
    ranked = materialize(ranked.withColumn("_seg", F.floor((F.col("_no") - 1) / SEGMENT)), "turns")
    keys = ["_conv", "_seg"]
    # A number of its own: left to itself, Spark would join small partitions into one slow task.
    parts = partitions(turns.sparkSession, ranked.count(), ROWS_PER_TASK)
    ordered = ranked.select(*keys, "_no", "_role").repartition(parts, *keys).sortWithinPartitions(*keys, "_no")
    matrices = ordered.mapInArrow(_sum_up, "_conv string, _seg long, costs array<double>")
    ends = matrices.repartition(parts, "_conv").sortWithinPartitions(*keys).mapInArrow(
        _join_up, "_conv string, _seg long, start int, end int, last boolean, cost double")
    ends = materialize(ends, "segment-ends")
    full = ranked.join(ends, keys).repartition(parts, *keys).sortWithinPartitions(*keys, "_no")
    return full.select(*keys, "_no", "start", "end", "last", "cost", "_id", "_turn", "_role", "_text").mapInArrow(
        _repair, "conv_id long, turn long, place long, part int, action string, role string, text string, rendered string, cost double")
