from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from shardlake.llm.nearcopies import SMALL_CELL, connect, keep_one, near_copies


def slow_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_components(ids, texts):
    sets, root = [slow_set(t) for t in texts], list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    low: dict = {}
    for i, d in enumerate(ids):
        low[root[i]] = min(low.get(root[i], d), d)
    return [low[r] for r in root]


def edited(rng, words, edits):
    words = list(words)
    for at in rng.choice(len(words), edits, replace=False):
        words[at] = f"x{rng.integers(10**9)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    """Groups around one text each, edited so that similarities lie on both sides of 0.8, and a group larger than a small cell."""
    rng, texts = np.random.default_rng(4), []
    for group in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        texts += [" ".join(words)] + [edited(rng, words, int(e)) for e in rng.integers(1, 12, 3 * SMALL_CELL if not group else 4)]
    return list(enumerate(texts)) + [(9001, ""), (9002, None), (9003, " \n")]


def test_all_links_are_found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies(df).collect()}
    right = slow_components([d for d, _ in rows], [t for _, t in rows])
    assert [got[d] for d, _ in rows] == right and 40 < len(set(right)) < len(rows) - 60


@pytest.mark.parametrize("path", ["fingerprints", "bands"])
def test_fingerprints_meet_all_within_reach(spark, rows, sf, monkeypatch, path):
    """The stage's fingerprints alone link all near copies up to 5 bits, the bands alone only those farther apart."""
    from shardlake.llm import nearcopies, simhash

    other = {"fingerprints": "_by_bands", "bands": "_by_prints"}[path]
    whole = getattr(nearcopies, other, None)
    monkeypatch.setattr(nearcopies, other, lambda nodes: whole(nodes).limit(0), raising=False)
    rows = rows if path == "fingerprints" else rows[97:]  # large cells of bands are compared whole
    prints, sets = [simhash.fingerprint((t or "").encode(), 5) for _, t in rows], [slow_set(t) for _, t in rows]
    root = [d for d, _ in rows]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            met = x == y or ((prints[i] ^ prints[j]).bit_count() <= 5) == (path == "fingerprints")
            if met and 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, df, sf).collect()} == set(root)
    assert len(set(slow_components([d for d, _ in rows], [t for _, t in rows]))) < len(set(root)) < len(rows) - 20


def test_a_cell_is_dealt_to_blocks(spark, rows, monkeypatch):
    from shardlake.llm import nearcopies

    monkeypatch.setattr(nearcopies, "CELL_SHINGLES", 3_000)  # some 15 of the first group's 97 texts
    df = spark.createDataFrame(rows[:120], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies(df).collect()}
    assert [got[d] for d, _ in rows[:120]] == slow_components([d for d, _ in rows[:120]], [t for _, t in rows[:120]])


def test_cells_are_met_across_batches(monkeypatch):
    import pyarrow as pa

    from shardlake.llm import nearcopies

    rng = np.random.default_rng(8)
    cell = np.sort(np.r_[rng.integers(0, 60, 300), np.full(150, 7), np.full(40, 60)])
    digest = np.arange(len(cell))
    size = dict(zip(*np.unique(cell, return_counts=True), strict=True))
    for step in (1, 5, 64, 1000):
        monkeypatch.setattr(nearcopies, "COUNT_ROWS", step)
        batches = [pa.RecordBatch.from_arrays([pa.array(cell[i : i + step]), pa.array(digest[i : i + step])], names=["cell", "digest"]) for i in range(0, len(cell), step)]
        got = [r for b in nearcopies._meet(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        large = {(True, int(c), int(d)) for c, d in zip(cell, digest, strict=True) if size[c] > SMALL_CELL}
        small = {(False, int(a), int(b)) for a in digest for b in digest[a + 1 :] if cell[a] == cell[b] and size[cell[a]] <= SMALL_CELL}
        assert sorted(got) == sorted(large | small)


def test_the_stage_takes_similarity(spark, rows, sf):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    right = set(slow_components([d for d, _ in rows], [t for _, t in rows]))
    assert {r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, df, sf).collect()} == right


def test_links_of_a_large_cell():
    rng = np.random.default_rng(2)
    sets = [np.unique(np.r_[rng.choice(30, 26, replace=False), 100 + i % 3 * 40 + np.arange(40)]) for i in range(90)]
    root = list(range(90))
    for u, v in connect(sets, np.arange(90)).tolist():
        a, b = sorted((root[u], root[v]))
        root = [a if r == b else r for r in root]
    assert root == [i % 3 for i in range(90)]


def test_odd_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "A  b"), (None, "a b"), (None, None), (5, ""), (6, None), (7, " ".join(f"w{i}" for i in range(40_000)))]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.component_id) for r in near_copies(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (None, 1), (None, 5), (5, 5), (6, 5), (7, 7)], key=str)
    kept = keep_one(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "5", "7", "None", "None"]
    assert near_copies(df.limit(0)).count() == 0
