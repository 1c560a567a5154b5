"""Chat formatting with a role repair of least cost.

Legal conversations are an optional system turn, then user and assistant in turn, ending with the
assistant. Dynamic programming over that automaton chooses for each message to keep it, merge it
into the turn before, relabel it, or put an empty turn before it. Messages are sorted into ranges,
whatever conversation they are of. Costs of a stretch of messages form a small min-plus matrix;
where a conversation goes on in the next range, the matrices of its stretches tell in which states
each must begin and end, so that parts that are repaired apart agree with each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, cut, rows_to_arrow, table

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the turn that is open.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where each role may open a turn.
OPENS = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
#: Costs: merging into a turn of the same role, of another; giving a message another role; an empty turn.
MERGE, MERGE_OTHER, RELABEL, INSERT = 1, 3, 2, 3
NO = 1 << 40

Matrix = tuple[tuple[int, ...], ...]


@dataclass(frozen=True)
class Step:
    """What brings one state to another: empty turns put in, then what becomes of the message."""

    cost: int
    inserted: tuple[int, ...]
    action: str
    role: int


def _inserts() -> dict[tuple[int, int], tuple[int, tuple[int, ...]]]:
    """The cheapest empty turns between two states."""
    out = {(s, s): (0, ()) for s in range(4)}
    for _ in range(3):
        for (a, b), (cost, turns) in list(out.items()):
            for role in (USER, ASSISTANT):  # an empty system turn says nothing
                if b in OPENS[role] and cost + INSERT < out.get((a, role), (NO,))[0]:
                    out[a, role] = (cost + INSERT, (*turns, role))
    return out


_PUT_IN = _inserts()


def _steps(own: int) -> dict[tuple[int, int], Step]:
    """For a message of role ``own`` (0: none of the three) the best step between states; ties go to the earlier kind."""
    out: dict[tuple[int, int], Step] = {}
    for (a, b), (cost, turns) in sorted(_PUT_IN.items(), key=lambda x: x[1]):
        choices = [(RELABEL * (role != own), "keep" if role == own else "relabel", role) for role in (SYSTEM, USER, ASSISTANT) if b in OPENS[role]]
        if b != START:
            choices.append((MERGE if b == own else MERGE_OTHER, "merge", b))
        for more, action, role in choices:
            if cost + more < out.get((a, role), Step(NO, (), "", 0)).cost:
                out[a, role] = Step(cost + more, turns, action, role)
    return out


STEPS = {own: _steps(own) for own in range(4)}
MATRICES: dict[int, Matrix] = {own: tuple(tuple(s[a, b].cost if (a, b) in s else NO for b in range(4)) for a in range(4)) for own, s in STEPS.items()}
UNIT: Matrix = tuple(tuple(0 if a == b else NO for b in range(4)) for a in range(4))
#: What it costs to end in each state.
ENDING = tuple(_PUT_IN.get((s, ASSISTANT), (NO, ()))[0] for s in range(4))


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(min(row[k] + b[k][j] for k in range(4)), NO) for j in range(4)) for row in a)


def role_of(role: str | None) -> int:
    name = (role or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else 0


def route(parts: list[Matrix]) -> tuple[int, list[tuple[int, int]]]:
    """The least cost of a conversation's parts and the states that each begins and ends in."""
    costs = [(0, NO, NO, NO)]
    for m in parts:
        costs.append(tuple(min(min(costs[-1][a] + m[a][b] for a in range(4)), NO) for b in range(4)))
    end = min(range(4), key=lambda s: costs[-1][s] + ENDING[s])
    total, out = costs[-1][end] + ENDING[end], []
    for m, before in zip(reversed(parts), reversed(costs[:-1]), strict=True):
        begin = min(range(4), key=lambda s: before[s] + m[s][end])
        out.append((begin, end))
        end = begin
    return total, out[::-1]


def repair(roles: list[int], begin: int, end: int | None = None) -> tuple[int, int, list[Step]]:
    """The cheapest steps that lead messages of these roles from one state to another, their cost and the end state.

    Without ``end`` it is the one from which the conversation is best ended; its cost is included.
    """
    costs, came = tuple(0 if s == begin else NO for s in range(4)), []
    for own in roles:
        now, back = [NO] * 4, [0] * 4
        for (a, b), step in STEPS[own].items():
            if costs[a] + step.cost < now[b]:
                now[b], back[b] = costs[a] + step.cost, a
        costs = tuple(now)
        came.append(back)
    if end is None:
        end = min(range(4), key=lambda s: costs[s] + ENDING[s])
        cost = costs[end] + ENDING[end]
    else:
        cost = costs[end]
    at, out = end, []
    for own, back in zip(reversed(roles), reversed(came), strict=True):
        out.append(STEPS[own][back[at], at])
        at = back[at]
    return end, cost, out[::-1]


def opened(role: int, first: bool) -> str:
    return f"{'' if first else '<|end|>' + chr(10)}<|{ROLES[role - 1]}|>\n"


def render(texts: list[str], steps: list[Step], first: bool, last: bool) -> str:
    """The template's text of one part; the parts of a conversation, one after another, are the whole."""
    out = []
    for text, step in zip(texts, steps, strict=True):
        for role in step.inserted:
            out.append(opened(role, first))
            first = False
        out.append("\n\n" + text if step.action == "merge" else opened(step.role, first) + text)
        first = False
    if last:
        for role in _PUT_IN[steps[-1].role, ASSISTANT][1]:
            out.append(opened(role, False))
        out.append("<|end|>\n")
    return "".join(out)


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], values: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal keys, which stand side by side, across batches."""
    key, held = None, []
    for b in batches:
        for k, v in zip(zip(*(column(b, c).to_pylist() for c in keys), strict=True), zip(*(column(b, c).to_pylist() for c in values), strict=True), strict=True):
            if held and k != key:
                yield key, held
                held = []
            key = k
            held.append(v)
    if held:
        yield key, held


def matrix_of(roles: list[int]) -> Matrix:
    m = UNIT
    for own in roles:
        m = times(m, MATRICES[own])
    return m


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The matrices of a range's first and last conversation, which may go on in other ranges."""
    last = None
    for k, ((part, conv_id), rows) in enumerate(_runs(batches, ("part", "conv_id"), ("role",))):
        last = (conv_id, part, rows)
        if k == 0:
            yield conv_id, part, [x for row in matrix_of([role_of(r) for (r,) in rows]) for x in row]
            first = part, conv_id
    if last and (last[1], last[0]) != first:
        yield last[0], last[1], [x for row in matrix_of([role_of(r) for (r,) in last[2]]) for x in row]


def plan_parts(ends: list[tuple[int | None, int, list[int]]]) -> dict[tuple[int | None, int], tuple[int, int, int, int, int]]:
    """For each part of the conversations in several ranges: begin, end, number, parts and the whole cost."""
    by_conv: dict[int | None, list[tuple[int, list[int]]]] = {}
    for conv_id, part, m in sorted(ends, key=lambda e: e[1]):
        by_conv.setdefault(conv_id, []).append((part, m))
    out = {}
    for conv_id, parts in by_conv.items():
        if len(parts) > 1:
            total, states = route([tuple(tuple(m[4 * i : 4 * i + 4]) for i in range(4)) for _, m in parts])
            for number, ((part, _), (begin, end)) in enumerate(zip(parts, states, strict=True)):
                out[conv_id, part] = begin, end, number, len(parts), total
    return out


def _rendered(plan: dict[tuple[int | None, int], tuple[int, int, int, int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv_id, part), rows in _runs(batches, ("conv_id", "part"), ("role", "text")):
            roles = [role_of(r) for r, _ in rows]
            if (conv_id, part) in plan:
                begin, end, number, parts, total = plan[conv_id, part]
                _, _, steps = repair(roles, begin, end)
            else:
                number, parts = 0, 1
                end, total, steps = repair(roles, START)
            tail = _PUT_IN[end, ASSISTANT][1] if number == parts - 1 else ()
            actions = [s.action for s in steps]
            yield (
                conv_id, number, parts, len(rows), sum(a != "merge" for a in actions) + sum(len(s.inserted) for s in steps) + len(tail),
                actions.count("merge"), actions.count("relabel"), sum(len(s.inserted) for s in steps) + len(tail), total,
                render([t or "" for _, t in rows], steps, number == 0, number == parts - 1),
            )

    return run


_ENDS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("matrix", pa.list_(pa.int64()))])
_OUT = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), ("parts", pa.int64()), ("n_messages", pa.int64()), ("n_turns", pa.int64()), ("n_merged", pa.int64()), ("n_relabelled", pa.int64()), ("n_inserted", pa.int64()), ("cost", pa.int64()), ("rendered", pa.string())]
)


def _through(df: DataFrame, rows, schema: pa.Schema) -> DataFrame:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.list_(pa.int64()): "array<long>"}
    pack = rows_to_arrow(schema)
    return df.mapInArrow(lambda it: pack(rows(it)), ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


_COUNTS = ("n_messages", "n_turns", "n_merged", "n_relabelled", "n_inserted")


def _ranges(conversations: DataFrame, parts: int | None) -> tuple[DataFrame, dict]:
    """Messages in sorted ranges, and the plan for those conversations that ranges part.

    Text travels once. Ranges are cut anywhere, inside a conversation or a turn too, so none is larger
    than others. Of each range no more than two small rows reach the driver.
    """
    order = [F.col("turn"), F.col("role"), F.xxhash64("text"), F.col("text")]
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").withColumn("row", F.monotonically_increasing_id())
    keys = ["conv_id", "turn", "role", F.xxhash64("text"), "row"]  # the row parts messages that are equal
    ranged = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    ranged = cut(ranged.sortWithinPartitions("conv_id", *order).select("conv_id", F.spark_partition_id().cast("long").alias("part"), "role", "text"))
    ends = _through(ranged.select("conv_id", "part", "role"), _ends, _ENDS).collect()
    return ranged, plan_parts([tuple(r) for r in ends])


def _parts(ranged: DataFrame, plan: dict) -> DataFrame:
    return _through(ranged, _rendered(plan), _OUT)


def format_parts(conversations: DataFrame, parts: int | None = None) -> DataFrame:
    """A row for each stretch of a conversation, for conversations that are larger than a row may be.

    The texts of a conversation's parts, one after another, are the text of ``format_chats``; counts
    are those of the part, ``cost`` is the whole conversation's. Messages are sorted into ``parts``
    ranges, by default as many as the session shuffles into.
    """
    return _parts(*_ranges(conversations, parts))


def format_chats(conversations: DataFrame, parts: int | None = None) -> DataFrame:
    """A row for each conversation, with its repaired messages rendered.

    Messages are ordered by turn (null first), then role, then a hash of the text; repeated rows are
    messages of their own. Roles count without regard to case and blanks around them; others, and
    null, are of no role and must be relabelled or merged. A null text is empty. Rows of a null conv_id
    are one conversation. ``parts`` tells into how many stretches of one range each the conversation
    fell. Other columns are left out; an empty table gives an empty result.
    """
    ranged, plan = _ranges(conversations, parts)
    spark = conversations.sparkSession
    # No more conversations can lie in several ranges than there are ranges.
    split = F.broadcast(spark.createDataFrame([(c,) for c in {c for c, _ in plan}], "split_id long"))
    in_several = ranged["conv_id"].eqNullSafe(split["split_id"])
    whole = _parts(ranged.join(split, in_several, "left_anti"), {})
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("part", "rendered"))), lambda x: x["rendered"])
    several = _parts(ranged.join(split, in_several, "left_semi"), plan).groupBy("conv_id")
    joined = several.agg(F.max("parts").alias("parts"), *(F.sum(c).alias(c) for c in _COUNTS), F.max("cost").alias("cost"), F.array_join(pieces, "").alias("rendered"))
    return whole.drop("part").unionByName(joined)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
