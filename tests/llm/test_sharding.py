from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardlake.llm.sharding import op4_sharding, place, shard_by_bytes


def brute(rows, shards):
    known = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        known.append((int(hashlib.md5(raw).hexdigest()[:15], 16), -(2**63) if doc_id is None else doc_id, len(raw) + 8, zlib.crc32(raw), doc_id))
    total, at, slots, out = sum(k[2] for k in known), 0, [0] * shards, []
    for _, _, size, crc, doc_id in sorted(known, key=lambda k: k[:4]):
        shard = min(shards - 1, (2 * at + size) * shards // (2 * total))
        out.append((doc_id, size, crc, shard, slots[shard]))
        at, slots[shard] = at + size, slots[shard] + 1
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[3], r[4]))


@pytest.mark.parametrize("range_rows", [40, 20_000])
def test_agrees_with_a_global_sort(spark, sf, range_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    right = in_order(brute([(r.doc_id, r.text) for r in docs.collect()], 24))
    got = in_order(tuple(r) for r in shard_by_bytes(docs, 24, range_rows=range_rows).collect())
    assert got == right
    op = in_order((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in op4_sharding(spark, sf).collect())
    assert op == right


def test_hot_text_is_subdivided(spark):
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 5, range_rows=100)
    assert in_order(tuple(r) for r in got.collect()) == in_order(brute(rows, 5))


@pytest.mark.parametrize("range_rows", [10, 20_000])
def test_a_hot_row_is_dealt_to_shards(spark, monkeypatch, range_rows):
    from shardlake.llm import sharding

    monkeypatch.setattr(sharding, "COPIES", 7)
    rows = [(5, "one row many times") if i % 3 == 0 else (i % 50, f"text {i % 40}") for i in range(900)]
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 6, range_rows=range_rows)
    assert in_order(tuple(r) for r in got.collect()) == in_order(brute(rows, 6))


def test_odd_rows(spark):
    rows = [(1, "a"), (1, "a"), (None, None), (3, ""), (4, "é" * 100_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, shard int, key string")
    assert in_order(tuple(r) for r in shard_by_bytes(df, 3).collect()) == in_order(brute(rows, 3))
    assert shard_by_bytes(df.limit(0), 3).count() == 0


def test_more_bytes_than_an_int_holds_half_of(spark):
    n, size = 1_100, 1_000_008  # 1.1e9 bytes: twice that is beyond 2^31
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), size - 8).alias("text"))
    got = [(r.doc_id, r.size, r.shard) for r in shard_by_bytes(docs, 24).orderBy("doc_id").collect()]
    assert got == [(i, size, (2 * i + 1) * 24 // (2 * n)) for i in range(n)]


def test_place():
    keys, ids = np.array([1, 2, 2, 2, 3]), np.array([9, 1, 5, 9, 0])
    assert place(keys, ids, np.array([2, 2, 3]), np.array([2, 5, 1])).tolist() == [0, 0, 2, 2, 2]
