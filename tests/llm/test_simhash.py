from __future__ import annotations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from shardlake.llm.components import components
from shardlake.llm.simhash import _links, cells, embed, fingerprint, keep_one, link_components, near_duplicates, op6_simhash, shingle_hashes


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints, bits=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    f = np.array(prints, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[:i] ^ f[i]) <= bits):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    low: dict = {}
    for i in range(len(ids)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low[find(i)] for i in range(len(ids))]


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab É\n\t\x0b\xa0"), max_size=60))
def test_fingerprints(text):
    assert fingerprint(text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("size", [1, 5, 64])
def test_slices_change_nothing(monkeypatch, size):
    from shardlake.llm import simhash

    text = " ".join("word" * (i % 7) + str(i % 11) for i in range(300)) + "\n\t"
    whole = shingle_hashes(text.encode(), 5)
    monkeypatch.setattr(simhash, "SLICE_BYTES", size)
    assert shingle_hashes(text.encode(), 5).tolist() == whole.tolist() and len(whole) == len(text.split()) - 4
    assert fingerprint(text.encode()) == slow_fingerprint(text)
    assert [len(shingle_hashes(t, 5)) for t in (b"", b" \n ", b"a", b"a b c d e", b"a b c d e f")] == [0, 0, 1, 1, 2]


def test_cells_across_batches(monkeypatch):
    import pyarrow as pa

    from shardlake.llm import simhash

    rng = np.random.default_rng(5)
    cell = np.sort(rng.integers(0, 12, 400))
    fp = rng.integers(0, 1 << 10, 400)
    rows = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 7]) for x in (cell, fp, np.arange(400))], names=["cell", "fp", "node"]) for i in range(0, 400, 7)]
    monkeypatch.setattr(simhash, "CELL_ROWS", 30)
    got = {tuple(e) for b in simhash._verify(2)(iter(rows)) for e in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True)}
    assert got == {tuple(e) for e in _links(cell, fp.view(np.uint64), np.arange(400), 2).tolist()}


def test_meetings_across_batches():
    import pyarrow as pa

    from shardlake.llm import simhash

    rng = np.random.default_rng(6)
    cell = np.sort(np.r_[rng.integers(0, 40, 200), np.full(150, 7), np.full(90, 40)])
    fp = rng.integers(0, 1 << 12, len(cell))
    fp[cell == 40] = np.r_[np.zeros(45, np.int64), np.full(20, 0xFFF), rng.integers(1 << 20, 1 << 40, 25)]
    node = rng.permutation(len(cell))
    near = lambda i, j: int(fp[i] ^ fp[j]).bit_count() <= 2
    right = {tuple(sorted((int(node[i]), int(node[j])))) for i in range(len(cell)) for j in range(i) if cell[i] == cell[j] and near(i, j)}
    for step, most in ((1, 1), (7, 30), (64, 100), (1000, 0)):
        rows = [pa.RecordBatch.from_arrays([pa.array(x[i : i + step]) for x in (cell, fp, node)], names=["cell", "fp", "node"]) for i in range(0, len(cell), step)]
        got = [r for b in simhash._verify(2, simhash._meetings, ("large", "u", "v"), most)(iter(rows)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        pairs, groups = {(u, v) for large, u, v in got if not large}, {}
        for large, u, v in got:
            if large:
                groups.setdefault(u, set()).add(v)
        together = {tuple(sorted((u, v))) for g in groups.values() for u in g for v in g if u < v}
        assert pairs <= right <= pairs | together and all(len(g) > simhash.SMALL_CELL for g in groups.values())
        assert any(g == set(node[(cell == 40) & (fp == 0)].tolist()) for g in groups.values())


def test_meetings_miss_nothing(spark):
    from shardlake.llm.simhash import meetings

    rng, prints = np.random.default_rng(9), []
    for base in rng.integers(0, 2**63, 15).tolist():
        for _ in range(20):
            prints.append(base)
            for bit in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                prints[-1] ^= 1 << bit
    f = np.array(prints, np.uint64)
    df = spark.createDataFrame(list(enumerate(f.view(np.int64).tolist())), "node long, fp long").select("fp", "node")
    right = {(j, i) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f[:i] ^ f[i]) <= 5).tolist()}
    for width in (1, 2):
        assert {(r.u, r.v) for r in meetings(df, width=width).collect() if not r.large} == right
    with pytest.raises(ValueError):
        meetings(df, 6)


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("the end of the",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % 2**64 == fingerprint(b"The END of  the")


@pytest.mark.parametrize("width", [1, 2])
def test_points_within_reach_meet(width):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, 300, dtype=np.uint64)
    b = a.copy()
    for i in range(300):
        for bit in rng.choice(64, i % 6, replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    rows_a, cells_a = cells(a, width)
    rows_b, cells_b = cells(b, width)
    for i in range(300):
        assert set(cells_a[rows_a == i]) & set(cells_b[rows_b == i])
        pa, pb = (int(embed(x[i : i + 1], width)[0]) for x in (a, b))
        manhattan = sum(abs((pa >> s & 2 * width - 1) - (pb >> s & 2 * width - 1)) for s in range(0, 64, width))
        assert manhattan <= int(np.bitwise_count(a[i] ^ b[i]))


@pytest.mark.parametrize("size", [5, 200])
def test_links_keep_every_connection_in_a_cell(size):
    rng = np.random.default_rng(size)
    prints = np.array([sum(1 << int(b) for b in rng.choice(12, 3, replace=False)) for _ in range(size)], np.uint64)
    found = _links(np.zeros(size, np.int64), prints, np.arange(size), 4)
    root = list(range(size))
    for u, v in found.tolist():
        a, b = sorted((root[u], root[v]))
        root = [a if r == b else r for r in root]
    assert root == slow_components(list(range(size)), prints)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 102), (103, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("width", [1, 2])
def test_dense_groups(spark, width):
    rng, prints = np.random.default_rng(1), []
    for base in rng.integers(0, 2**63, 20):
        for _ in range(25):
            x = int(base)
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(bit)
            prints.append(x)
    ids = list(range(len(prints)))
    df = spark.createDataFrame(list(zip(ids, np.array(prints, np.uint64).view(np.int64).tolist(), strict=True)), "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in link_components(df, width=width).collect()}
    assert [got[i] for i in ids] == slow_components(ids, prints)
    with pytest.raises(ValueError):
        link_components(df, 6)


def test_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    prints = [slow_fingerprint(r.text) for r in docs]
    right = list(zip([r.doc_id for r in docs], [f"{p:016x}" for p in prints], slow_components([r.doc_id for r in docs], prints), strict=True))
    assert [tuple(r) for r in op6_simhash(spark, sf).orderBy("doc_id").collect()] == right


def test_odd_rows(spark):
    rows = [(1, "a"), (1, "a"), (None, None), (3, ""), (None, "a"), (5, " ".join(f"w{i}" for i in range(60_000)))]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 3), (3, 3), (None, 1), (5, 5)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0
    kept = keep_one(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "5", "None", "None"]
