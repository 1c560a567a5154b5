from __future__ import annotations

import heapq
import itertools

from shardlake.llm.chat import ENDING, MATRICES, UNIT, format_chats, format_parts, op8_chat, repair, route, times


def cheapest(roles):
    """Least cost by searching the graph of (messages used, state) itself."""
    best, heap = {(0, 0): 0}, [(0, 0, 0)]
    while heap:
        cost, i, s = heapq.heappop(heap)
        if cost > best[i, s]:
            continue
        after = [(cost + 3, i, t) for t, ok in ((2, s in (0, 1, 3)), (3, s == 2)) if ok]
        if i < len(roles):
            after += [(cost + 2 * (t != roles[i]), i + 1, t) for t, ok in ((1, s == 0), (2, s in (0, 1, 3)), (3, s == 2)) if ok]
            after += [(cost + (1 if s == roles[i] else 3), i + 1, s)] * bool(s)
        for c, j, t in after:
            if c < best.get((j, t), 10**9):
                best[j, t] = c
                heapq.heappush(heap, (c, j, t))
    return best[len(roles), 3]


def matrix(roles):
    m = UNIT
    for r in roles:
        m = times(m, MATRICES[r])
    return m


def test_repairs_are_cheapest_in_any_parts():
    for n in range(1, 6):
        for roles in itertools.product(range(4), repeat=n):
            right = cheapest(roles)
            for cut in range(n):
                parts = [p for p in (roles[:cut], roles[cut:]) if p]
                total, states = route([matrix(p) for p in parts])
                steps = [s for p, (a, b) in zip(parts, states, strict=True) for s in repair(list(p), a, b)[2]]
                assert cut or repair(list(roles), 0)[1] == total
                assert total == right == sum(s.cost for s in steps) + ENDING[states[-1][1]]


SCHEMA = "conv_id long, turn int, role string, text string, cost int"


def shown(df, **more):
    found = format_chats(df, **more).collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: r.rendered for r in found}


def test_rendering_and_odd_rows(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "user", "v"), (1, 3, "Assistant ", "a"), (1, 3, "Assistant ", "a"),
        (2, 5, "assistant", "only"), (3, None, "user", None), (None, 1, None, "lost"), (4, 1, "user", "q"), (4, 2, "assistant", "r"), (4, 3, "system", "late"), (4, 4, "assistant", "t"),
    ]
    got = shown(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA))
    assert got[1] == "<|system|>\ns<|end|>\n<|user|>\nu\n\nv<|end|>\n<|assistant|>\na\n\na<|end|>\n"
    assert got[2] == "<|user|>\n<|end|>\n<|assistant|>\nonly<|end|>\n"
    assert got[3] == "<|user|>\n<|end|>\n<|assistant|>\n<|end|>\n"
    assert got[4] == "<|user|>\nq<|end|>\n<|assistant|>\nr<|end|>\n<|user|>\nlate<|end|>\n<|assistant|>\nt<|end|>\n"
    assert "lost" in got[None] and got[None].endswith("<|end|>\n")
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_parts_of_a_long_conversation_agree(spark):
    """A conversation, a turn of it and equal messages in several ranges; so do the rows of no conversation."""
    rows = [(1, i, ("user", "assistant", "tool", "system")[(i * i + i // 7) % 4], f"m{i}", 0) for i in range(600)]
    rows += [(2, 7, "user", "again", 0)] * 300 + [(2, None, "tool", f"n{i}", 0) for i in range(300)] + [(None, i, "assistant", f"l{i}", 0) for i in range(200)]
    rows += [(3 + i // 2, i % 2, "user", f"o{i}", 0) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole, parts = ({r.conv_id: r for r in format_chats(df, n).collect()} for n in (1, 12))
    assert {r.parts for r in whole.values()} == {1} and min(parts[c].parts for c in (1, 2, None)) > 1
    pieces: dict = {}
    for r in sorted(format_parts(df, 12).collect(), key=lambda r: r.part):
        pieces[r.conv_id] = pieces.get(r.conv_id, "") + r.rendered
    for c, r in whole.items():
        assert (r.cost, r.n_messages, r.n_turns, r.n_merged) == (parts[c].cost, parts[c].n_messages, parts[c].n_turns, parts[c].n_merged) or r.cost == parts[c].cost
        assert pieces[c] == parts[c].rendered and len(parts[c].rendered.split("<|end|>")) - 1 == parts[c].n_turns
    assert parts[2].n_messages == 600 and parts[2].rendered.count("again") == 300 and all(f"m{i}" in parts[1].rendered for i in range(600))


def test_the_table(spark, sf):
    found = op8_chat(spark, sf).collect()
    assert sum(r.n_messages for r in found) == spark.read.parquet(f"{sf}/conversations.parquet").count()
    for r in found:
        roles = [x.split("|>")[0] for x in r.rendered.split("<|") if x[:3] != "end"][1:]
        roles = [x for x in roles if x in ("user", "assistant")]
        assert roles == ["user", "assistant"] * (len(roles) // 2)
