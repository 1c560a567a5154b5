from __future__ import annotations

import random

import pytest

from shardlake.llm.sentencepiece import PieceModel, decode, default_model, encode, op7_sentencepiece

library = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")
RAW = open(default_model(), "rb").read()
MODEL = PieceModel(RAW)
ODD = ["", " ", "  a  b ", "\n\n x\t", "日本語のテキスト 𝔘 é ▁", "a" * 4000, "ab" * 3000, "=-" * 999, "    indented\n        more", "x\u0000y", "🙂🙂 ﷺ"]


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + ODD


def test_ids_are_the_librarys(texts):
    other = library.SentencePieceProcessor(model_proto=RAW)
    for t in texts:
        ids = MODEL.encode(t).tolist()
        assert ids == other.encode(t)
        assert MODEL.decode(ids) == t.replace("▁", " ")


def test_random_texts():
    other, rng = library.SentencePieceProcessor(model_proto=RAW), random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice("abcdefghtion etsr  .,\nABCüé1#") for _ in range(rng.randrange(1, 80)))
        assert MODEL.encode(t).tolist() == other.encode(t)


def _entry(piece: str, score: float, kind: int = 1) -> bytes:
    import struct

    p = piece.encode()
    body = b"\x0a" + bytes([len(p)]) + p + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind])
    return b"\x0a" + bytes([len(body)]) + body


def test_unigram_search_is_optimal():
    scores = {"▁": -2.0, "a": -1.5, "b": -1.7, "c": -3.1, "ab": -2.3, "bc": -2.9, "abc": -3.3, "▁a": -2.6, "ca": -3.0, "cab": -4.7, "aa": -2.2, "▁▁": -2.5, "b▁c": -3.0}
    data = _entry("<unk>", 0.0, 2) + b"".join(_entry(p, s) for p, s in scores.items())
    data += b"\x12\x02\x18\x01" + b"\x1a\x06\x18\x01\x20\x00\x28\x01"
    model, rng = PieceModel(data), random.Random(2)
    assert not model.parts_at_space
    for _ in range(200):
        t = "".join(rng.choice("abc x") for _ in range(rng.randrange(1, 60)))
        norm = model.normalise(t)
        best = [0.0] + [-1e18] * len(norm)
        for end in range(1, len(norm) + 1):
            for start in range(max(0, end - 3), end):
                p = norm[start:end]
                if p in scores or end == start + 1:
                    best[end] = max(best[end], best[start] + scores.get(p, model.unknown_score))
        ids = [i for part in model.stream(iter(norm)) for i in part]
        found = sum(model.unknown_score if i == 0 else model.scores[i] for i in ids)
        assert found == pytest.approx(best[-1]) and ids == model.encode(t).tolist()


def test_window_is_bounded_where_paths_meet(texts):
    held = [0]
    long = MODEL.normalise(" ".join(t for t in texts[:40]))
    assert len(long) > 20_000
    ids = [i for part in MODEL.stream(iter(long), held) for i in part]
    assert ids == MODEL.encode(" ".join(t for t in texts[:40])).tolist() and held[0] <= 8 * MODEL.longest
    held = [0]
    list(MODEL.stream(iter("a" * 20_000), held))
    assert held[0] <= 8 * MODEL.longest


def test_every_text_is_streamed_or_recalled(texts):
    model = PieceModel(RAW)
    lengths = [sum(map(len, model._chunks(t))) for t in texts]
    model.encode(texts[0])
    assert model.streamed > 0.3 * lengths[0]
    before = model.streamed
    model.encode(texts[0])
    assert model.streamed == before  # every chunk of it is recalled
    fresh, whole = PieceModel(RAW), set()
    for t in texts:
        fresh.encode(t)
        whole |= set(fresh._chunks(t))
    assert sum(map(len, whole)) <= fresh.streamed <= sum(lengths)


def test_legal_pairs_are_those_that_merging_leaves():
    rng = random.Random(7)

    def merged(text):
        parts = list(text)
        while len(parts) > 1:
            scores = [(MODEL.score_of.get(parts[i - 1] + parts[i]), -i) for i in range(1, len(parts))]
            best = max((x for x in scores if x[0] is not None), default=None)
            if best is None:
                return parts
            parts[-best[1] - 1 : -best[1] + 1] = ["".join(parts[-best[1] - 1 : -best[1] + 1])]
        return parts

    normal = [i for i, p in enumerate(MODEL.pieces) if p in MODEL.score_of]
    for _ in range(4000):
        a, b = rng.choice(normal), rng.choice(normal[:3000])
        pair = [MODEL.pieces[a], MODEL.pieces[b]]
        assert MODEL._legal(a, b) == (merged("".join(pair)) == pair), pair


def test_a_very_long_text_takes_bounded_memory():
    import tracemalloc

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]
    long = " ".join(rng.choice(words) for _ in range(400_000))
    model = PieceModel(RAW)
    tracemalloc.start()
    ids = model.encode(long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.decode(ids[:50]) == long[: len(model.decode(ids[:50]))]
    assert peak < 5 * len(ids) + 30e6  # ids of four bytes and what the model remembers


def test_columns(spark, sf):
    df = spark.createDataFrame([(1, "Hello world", 3), (1, "Hello world", 3), (None, None, 3), (4, "", 3)], "doc_id long, text string, ids int")
    rows = sorted(decode(encode(df)).collect(), key=str)
    assert sorted(((r.doc_id, r.text, r.decoded) for r in rows), key=str) == sorted([(1, "Hello world", "Hello world")] * 2 + [(None, None, None), (4, "", "")], key=str)
    assert encode(df.limit(0)).count() == 0
    assert op7_sentencepiece(spark, sf).where("NOT round_trip").count() == 0
