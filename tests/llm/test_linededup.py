from __future__ import annotations

import duckdb
import numpy as np
import pytest

from shardlake.llm.linededup import OP3_SQL, PerfectHash, dedup_lines, line_key, long_enough, op3_line_dedup


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_perfect_hash_is_minimal(n):
    keys = np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64)
    keys = np.unique(keys)
    mph = PerfectHash.build(keys)
    assert sorted(mph.lookup(keys).tolist()) == list(range(len(keys)))
    assert len(mph.bits) * 8 <= 8 * len(keys) + 64 * 30


def test_rest_of_stubborn_keys():
    mph = PerfectHash(np.zeros(0, np.int64), np.zeros(0, np.uint8), np.array([5, 9], np.uint64))
    assert mph.lookup(np.array([9, 5, 7], np.uint64)).tolist() == [1, 0, -1]


def test_keys():
    assert line_key(b" \t\x0b A\xc3\x89b \r\x0c") == b"a\xc3\x89b" and line_key("\xa0x".encode()) == "\xa0x".encode()
    assert long_enough("é".encode() * 10, 10) and not long_enough("é".encode() * 9, 10)


def test_agrees_with_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    names = "doc_id, kept_sha256, n_dropped, n_lines"
    right = sorted(con.sql(f"SELECT {names} FROM ({OP3_SQL})").fetchall())
    assert sorted(tuple(r) for r in op3_line_dedup(spark, sf).select(*names.split(", ")).collect()) == right


def brute(rows):
    holders: dict = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n") if doc_id is not None else ():
            if long_enough(k := line_key(line.encode()), 10):
                holders.setdefault(k, set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if doc_id is None or len(h := holders.get(line_key(x.encode()), {doc_id})) < 2 or min(h) == doc_id]
        out.append((doc_id, text if len(stay) == len(lines) else "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


@pytest.mark.parametrize("shard_rows", [3, 40_000])
def test_hot_lines_and_odd_rows(spark, shard_rows):
    hot = "this line is in a third of all"
    rows = [(i, "\n".join([hot if i % 3 == 0 else f"own line number {i}", f"pair line {i // 2:08d}", "short", ""])) for i in range(90)]
    rows += [(1, rows[1][1]), (None, hot), (None, None), (500, None), (501, ""), (502, "  " + hot.upper() + "\t\r"), (503, "\n".join([hot] * 5000))]
    df = spark.createDataFrame([(a, b, 7, "x") for a, b in rows], "doc_id long, text string, n_lines int, lost string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    got = sorted((tuple(r) for r in dedup_lines(df, shard_rows=shard_rows).select("doc_id", "text", "n_lines", "n_dropped").collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    assert dedup_lines(df.limit(0)).count() == 0
