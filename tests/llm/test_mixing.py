from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shardlake.llm.mixing import count_words, mix_sources, mixed_documents, op9_mixing, permute, settle, taken_words, targets


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutations(n):
    a = permute(np.arange(n), n, 5)
    assert sorted(a.tolist()) == list(range(n)) and (a == permute(np.arange(n), n, 5)).all()
    assert n < 10 or (a != permute(np.arange(n), n, 6)).any()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=30))
def test_targets(sizes):
    got = targets(sizes)
    assert sum(got) == pytest.approx(sum(sizes)) and all(t <= 3 * s + 1e-6 for t, s in zip(got, sizes, strict=True))
    free = [t / w for t, w, s in zip(got, [5, 2, 1] * 10, sizes, strict=False) if t < 3 * s - 1e-6]
    assert not free or max(free) == pytest.approx(min(free))


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ab é\n\t\x0b\x0c\r\xa0"), max_size=40))
def test_words(text):
    assert count_words(text.encode()) == len(text.encode().split())


@pytest.mark.parametrize("seed", range(6))
def test_settled_draws_use_up_the_totals(seed):
    rng = np.random.default_rng(seed)
    draws = rng.integers(0, 40, 9) * rng.integers(0, 2, 9) + np.r_[500, np.zeros(8, int)]
    shards, total = 13, int(draws.sum())
    slots = np.array([total * (k + 1) // shards - total * k // shards for k in range(shards)])
    counts = np.stack([rng.multinomial(n, draws / total) for n in slots])
    first = np.cumsum(counts, 0) - counts
    k, s = np.nonzero(counts)
    rows = settle(k, s, counts[k, s], first[k, s], draws, counts.sum(0))
    of_shard, of_source = np.zeros(shards, int), [[] for _ in draws]
    for shard, source, begin, n in rows:
        of_shard[shard] += n
        of_source[source] += range(begin, begin + n)
    assert (of_shard == slots).all() and all(sorted(x) == list(range(n)) for x, n in zip(of_source, draws, strict=True))
    kept = sum(n for shard, source, begin, n in rows if begin == first[shard, source])
    assert kept >= total - np.abs(counts.sum(0) - draws).sum()


def test_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = op9_mixing(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    pdf = docs.toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got["doc_id"] == pdf["doc_id"]).all() and (got["size"] == [len(t.encode().split()) for t in pdf["text"]]).all()
    assert (got["taken"] <= 3 * got["size"]).all()
    by = got.assign(source=pdf["source"]).groupby("source").agg(size=("size", "sum"), said=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by["said"]).all() and by["target"].tolist() == pytest.approx(targets(by["size"].tolist()))
    assert ((by["taken"] - by["target"]).abs() <= 64 + 0.02 * by["target"]).all()
    again = op9_mixing(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, again)
    mixed = mixed_documents(docs, mix_sources(docs)).toPandas()
    words = mixed.groupby("doc_id")["text"].apply(lambda x: sum(len(t.encode().split()) for t in x))
    assert words.to_dict() == {d: t for d, t in zip(got["doc_id"], got["taken"], strict=True) if t}
    whole = mixed.merge(pdf, on="doc_id")
    assert (whole["n_chars_x"] == whole["text_x"].str.len()).all() and (whole["source_x"] == whole["source_y"]).all()


def test_slots_are_gapless_and_blocks_exist(spark, sf):
    mix = mix_sources(spark.read.parquet(f"{sf}/documents.parquet"), block_words=16)
    slots = mix.slots.toPandas()
    for _, part in slots.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    times = slots.groupby(["source_no", "block"]).size()
    for s in mix.sources:
        of = times[s.number].reindex(range(s.blocks), fill_value=0)
        assert of.sum() == s.draws and of.max() - of.min() <= 1


def test_taken_is_what_the_slots_hold(spark, tmp_path, monkeypatch):
    """Every slot's words are walked one by one, on rows without source or id, repeated, empty and very long."""
    from shardlake.llm import mixing

    monkeypatch.setattr(mixing, "COPIES", 2)
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 16)
    rows = [(1, "a b c " * 9, "x")] * 5 + [(1, "a b c " * 9, "y"), (1, "other text", "x"), (None, None, None), (None, "lost " * 70, "x"), (None, "lost " * 70, None), (3, "", "y"), (4, " z ", None), (5, "w " * 9000, "x"), (6, "v\n" * 700, "u")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op9_mixing(spark, str(tmp_path)).collect()), key=str)
    mix = mix_sources(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    blocks: dict = {}
    for r in mix.segments.collect():
        blocks.setdefault((r.source_no, r.block), []).extend([(r.doc_id, r.text_hash, r.copy, r.first_word + k) for k in range(r.words)])
    sizes = {name: sum(len((t or "").split()) for _, t, n in rows if n == name) for name in ("u", "x", "y", None)}
    aims = dict(zip(sizes, targets(list(sizes.values())), strict=True))
    slots, words = mix.slots.collect(), {}
    for r in slots:
        for word in blocks[r.source_no, r.block]:
            words[r.source_no, word] = words.get((r.source_no, word), 0) + 1
    assert max(words.values()) <= 3 and len({(r.source_no, r.epoch, r.block) for r in slots}) == len(slots) and len({r.shard for r in slots}) > 5
    assert all(len(w) == 64 for (_, b), w in blocks.items() if (_, b + 1) in blocks)
    number = {s.name: s.number for s in mix.sources}
    want, copies = [], {}
    hashes = {(r.doc_id, r.source_no, r.size): r.text_hash for r in mix.rows.collect()}
    for doc_id, text, source in rows:
        n = len((text or "").split())
        key = (doc_id, number[source], n)
        copies[key] = copies.get(key, -1) + 1
        taken = sum(words.get((number[source], (doc_id, hashes[key], copies[key], k)), 0) for k in range(n))
        want.append((doc_id, n, sizes[source], aims[source], taken))
    assert got == sorted(want, key=str)
    for name, aim in aims.items():
        assert abs(sum(r[4] for r, (_, _, n) in zip(want, rows, strict=True) if n == name) - aim) <= 64


def test_odd_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, None, None), (3, "", "y"), (4, " z ", None), (5, "w " * 50_000, "x")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, block int")
    mix = mix_sources(df)
    assert [(s.name, s.size) for s in mix.sources] == [("x", 50_006), ("y", 0), (None, 1)]
    assert taken_words(mix).count() and mixed_documents(df, mix).columns == df.columns
    assert taken_words(mix_sources(df.limit(0))).count() == 0
