from __future__ import annotations

import zlib

import numpy as np
import pytest

from shardlake.llm.quality import N_FEATURES, AttentionModel, fit, learn, op10_quality, passages, score_quality


def test_passages():
    assert passages(b"").shape == (1, N_FEATURES) and not passages(b"").any()
    x = passages(b"Hello world. " * 100)
    assert x.shape == (3, N_FEATURES) and np.isfinite(x).all()
    assert passages(("éあ \x00" * 4000).encode()).shape[0] == 55


def test_gradient():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, N_FEATURES)) for n in (1, 3, 5)]
    y = np.array([0.0, 1.0, 1.0])
    sizes = np.array([1, 3, 5])
    x, starts = np.concatenate(bags), np.cumsum(sizes) - sizes
    shapes = {"E": (N_FEATURES, 6), "e": (6,), "V": (6, 4), "U": (6, 4), "w": (4,), "c": (6,), "b": (1,)}
    model = AttentionModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), {k: rng.normal(0, 0.4, s) for k, s in shapes.items()})

    def loss():
        s = model.score(x, starts)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for k, g in model.gradient(x, starts, y).items():
        for at in list(np.ndindex(g.shape))[:5]:
            w = model.weights[k]
            old, h = w[at], 1e-6
            w[at] = old + h
            up = loss()
            w[at] = old - h
            down = loss()
            w[at] = old
            assert (up - down) / (2 * h) == pytest.approx(g[at], abs=1e-6)
    assert model.forward(x, starts)["a"][1:4].sum() == pytest.approx(1)


def test_one_label_only():
    assert fit([], np.zeros(0)).score(np.zeros((1, N_FEATURES)), np.array([0])).tolist() == [0.5]
    assert fit([np.zeros((1, N_FEATURES))], np.array([1])).score(np.zeros((1, N_FEATURES)), np.array([0])).tolist() == [1.0]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op10_quality(spark, sf).collect()}
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert len(labels) > 50 and np.mean([got[r.doc_id].predicted == r.quality for r in labels]) > 0.95


def test_labels_that_are_held_out_teach_nothing(spark):
    docs = spark.createDataFrame([(i, "clean words here" if i % 2 else "BAD!! ### BAD!!") for i in range(60)], "doc_id long, text string")
    out = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    labels = spark.createDataFrame([(i, i % 2) for i in out], "doc_id long, quality int")
    assert learn(docs, labels).constant == 0.5


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, "clean words are here, and so on." if i % 2 else "BAD!! ### BAD!!", 1) for i in range(60)] + [(None, None, 1), (99, "", 1), (98, "word " * 100_000, 1)], "doc_id long, text string, quality_score int")
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(60)] + [(1, None, "x"), (None, 1, "x")], "doc_id long, quality int, text string")
    model = learn(docs.drop("quality_score"), labels)
    rows = score_quality(docs, model).collect()
    assert len(rows) == 63 and all(0 <= r.quality_score <= 1 for r in rows)
    assert np.mean([(r.quality_score >= 0.5) == r.doc_id % 2 for r in rows if r.doc_id is not None and r.doc_id < 60]) == 1
    assert score_quality(docs.limit(0), model).count() == 0 and learn(docs.limit(0), labels).constant == 0.5
