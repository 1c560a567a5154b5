from __future__ import annotations

import pytest

import corpus_pipeline
from shardlake.llm import mixing, quality, sentencepiece
from tests.llm.test_linededup import brute

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """What each stage leaves, the documents first."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    assert all(s.columns == DOCUMENTS for s in stages[:-1]) and "ids" in stages[-1].columns


def test_quality_stage(spark, stages, sf):
    model = quality.learn(stages[0], spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r.doc_id for r in quality.score_quality(stages[0], model).where("quality_score >= 0.5").collect()}
    assert set(texts(stages[1])) == kept and 0 < len(kept) < stages[0].count()
    assert all(texts(stages[0])[k] == v for k, v in texts(stages[1]).items())


def test_line_stage(stages):
    right = {d: t for d, t, _, _ in brute(list(texts(stages[1]).items()))}
    assert texts(stages[2]) == right and all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_near_duplicate_stage(stages):
    before = sorted(texts(stages[2]).items())
    sets = []
    for _, text in before:
        words = text.encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(before)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert sorted(texts(stages[3])) == sorted({before[r][0] for r in root})


def test_mixing_stage(stages):
    mix = mixing.mix_sources(stages[3])
    taken = {r.doc_id: r.taken for r in mixing.taken_words(mix).groupBy("doc_id").sum("taken").withColumnRenamed("sum(taken)", "taken").collect()}
    words: dict = {}
    for r in stages[4].collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
    assert words == taken


def test_token_stage(stages):
    model = sentencepiece.PieceModel(open(sentencepiece.default_model(), "rb").read())
    right = sorted((r.doc_id, model.encode(r.text).tolist()) for r in stages[4].collect())
    assert sorted((r.doc_id, r.ids) for r in stages[5].collect()) == right
    assert stages[5].where("NOT round_trip").count() == 0


def test_run(spark, sf, stages):
    from pathlib import Path

    from shardlake.llm import common

    got = sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == sorted((r.doc_id, r.ids) for r in stages[5].collect())
    left = Path(common.shared_folder(spark).removeprefix("file:")).glob("pipeline-*/*")
    assert {p.name for p in left} == {"4"}  # what lay between is gone
