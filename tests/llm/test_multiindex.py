from __future__ import annotations

import numpy as np
import pytest

from shardlake.llm.multiindex import Codebooks, neighbours_exact, op2_neighbours, products, search

SCHEMA = "vec_id long, embedding array<float>"


def exact(ids, x, nearest=20, every=20):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            scores = products(q, x)
            out[i] = [(ids[k], scores[k]) for k in sorted(range(len(ids)), key=lambda k: (-scores[k], ids[k])) if ids[k] != i][:nearest]
    return out


def by_query(df):
    got: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def columns(spark, path):
    v = spark.read.parquet(path).toPandas()
    return v["vec_id"].tolist(), np.stack(v["embedding"]).astype(float)


@pytest.mark.parametrize("steps", [1, 7, 10_000])
def test_walk_goes_by_summed_distance(steps):
    rng = np.random.default_rng(0)
    books = Codebooks(rng.normal(size=(7, 3)), rng.normal(size=(5, 2)))
    q, counts = rng.normal(size=5), rng.integers(0, 4, 35)
    sums = -((books.first @ q[:3])[:, None] + (books.second @ q[3:])[None, :]).ravel()
    every = np.flatnonzero(counts)
    level, cells = books.walk(q, counts, 10**9, steps)
    assert level == np.inf and sorted(cells.tolist()) == every.tolist()
    for want in range(1, int(counts.sum())):
        level, cells = books.walk(q, counts, want, steps)
        assert sorted(cells.tolist()) == [c for c in every.tolist() if sums[c] < level] and counts[cells].sum() >= want
        if steps == 10_000 and level < np.inf:  # so fine a step holds one sum
            assert counts[[c for c in cells if sums[c] < max(sums[cells])]].sum() < want


def test_exact_mode_is_exact(spark, sf):
    assert by_query(neighbours_exact(spark, sf)) == exact(*columns(spark, f"{sf}/embeddings.parquet"))


def test_recall_as_shipped(spark, sf):
    for path in (f"{sf}/embeddings.parquet", "/root/testdata/sf0.1/embeddings.parquet"):
        ids, x = columns(spark, path)
        right, got = exact(ids, x), by_query(op2_neighbours(spark, path.rpartition("/")[0]))
        assert set(got) == set(right) and all(len(v) == 20 for v in got.values())
        assert np.mean([len({v for v, _ in right[q]} & {v for v, _ in got[q]}) / 20 for q in right]) >= 0.9
        at = {i: k for k, i in enumerate(ids)}
        for q, found in got.items():
            assert all(score == products(x[at[q]], x[at[v]][None])[0] for v, score in found)
            assert found == sorted(found, key=lambda r: (-r[1], r[0]))


def test_clustered_vectors_need_few_candidates(spark, monkeypatch):
    from shardlake.llm import multiindex

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16))
    x = (centres[rng.integers(0, 60, 4000)] + rng.normal(size=(4000, 16)) * 0.1).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    asked, found = [], multiindex._depth
    monkeypatch.setattr(multiindex, "_depth", lambda *a: asked.append(found(*a)) or asked[-1])
    got, right = by_query(search(df, nearest=10, every=40, block_rows=300, task_queries=20)), exact(range(4000), x.astype(float), 10, 40)
    assert asked[0] < 400  # a tenth of all
    assert np.mean([len({v for v, _ in right[q]} & {v for v, _ in got[q]}) / 10 for q in right]) >= 0.9


@pytest.mark.parametrize("recall", [1.0, 0.95])
def test_a_hot_vector_is_dealt_to_blocks(spark, recall):
    rows = spark.range(1200).selectExpr("id AS vec_id", "array(cast(if(id % 3 = 0, 1, id % 7) AS float), cast(if(id % 3 = 0, 1, id % 11) AS float)) AS embedding")
    v = rows.toPandas()
    right = exact(v["vec_id"].tolist(), np.stack(v["embedding"]).astype(float), 5, 100)
    got = by_query(search(rows, nearest=5, every=100, recall=recall, block_rows=100, task_queries=3))
    assert got == right if recall == 1 else [s for _, s in got[0]] == [s for _, s in right[0]]


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0, 2.0]), (0, [1.0, 0.0, 2.0]), (1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, float("nan"), 1.0]), (4, [1.0, None, 1.0]), (8, [1.0, float("inf"), 0.0]), (None, [1.0, 1.0, 1.0]), (5, [1.0, 2.0, 3.0]), (20, [1.0, 2.0, 3.0]), (7, [1.0]), (40, [2.0]), (9, [])]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], f"{SCHEMA}, rank int, row int, cell int, block int")
    got = sorted(tuple(r) for r in search(df).collect())
    each = [(0, 1, 5, 7.0), (0, 2, 20, 7.0), (0, 3, 0, 5.0)]  # a repeated row is a candidate of the other
    assert got == sorted([*each, *each, (20, 1, 5, 14.0), (20, 2, 0, 7.0), (20, 3, 0, 7.0), (40, 1, 7, 2.0)])
    assert search(df.limit(0)).count() == 0
    assert search(spark.createDataFrame([(1, [1.0]), (20, [2.0])], SCHEMA)).collect()[0].score == 2.0
