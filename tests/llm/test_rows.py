"""What every operator owes to odd tables: any extra columns, and very long texts in bounded memory."""

from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardlake.llm import chat, common, htmltext, linededup, media, mixing, multiindex, nearcopies, quality, sentencepiece, sharding, simhash

WORDS = "the quick brown fox jumps over a lazy dog and then some more of it again".split()


def words(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(n))


def documents(spark):
    rng = random.Random(1)
    texts = [words(rng, 40) + "\nshared line number one\n" + words(rng, 5) for _ in range(30)]
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate([*texts, *texts[:5], None, ""])]
    return spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, source string")


def pages(spark):
    html = "<html><body><div>Menu</div><div><h1>T {0}</h1><p>Paragraph {0} is here.</p><p>More of {0}.</p></div></body></html>"
    return spark.createDataFrame([(i, f"http://h{i % 3}/", html.format(i)) for i in range(12)] + [(13, None, None)], "page_id long, url string, html string")


def vectors(spark):
    rng = np.random.default_rng(2)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)))], "vec_id long, embedding array<double>")


def chats(spark):
    rows = [(i // 4, i % 4, ("user", "assistant", None, "user")[i % 4], f"m{i}") for i in range(40)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def model(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    return quality.learn(documents(spark), labels)


CASES = {
    "lines": (linededup, documents, linededup.dedup_lines),
    "keep_one": (simhash, documents, simhash.keep_one),
    "simhash": (simhash, documents, simhash.near_duplicates),
    "near_copies": (nearcopies, documents, nearcopies.keep_one),
    "mixing": (mixing, documents, lambda df: mixing.mixed_documents(df, mixing.mix_sources(df, block_words=8))),
    "html_sent": (htmltext, pages, htmltext.main_text),
    "html_joined": (htmltext, pages, lambda df: htmltext.main_text(df, 0)),
    "neighbours": (multiindex, vectors, multiindex.search),
    "sharding": (sharding, documents, lambda df: sharding.shard_by_bytes(df, 3)),
    "encode": (sentencepiece, documents, sentencepiece.encode),
    "decode": (sentencepiece, documents, lambda df: sentencepiece.decode(sentencepiece.encode(df))),
    "quality": (quality, documents, lambda df: quality.score_quality(df, model(df.sparkSession))),
    "chat": (chat, chats, chat.format_chats),
    "store": (media, documents, media.store_texts),
    "index": (media, documents, lambda df: media.index_media(df.withColumn("media", F.col("text").cast("binary")))),
}


@pytest.mark.parametrize("case", CASES)
def test_extra_columns_of_any_name(spark, case):
    module, table, operator = CASES[case]
    plain = table(spark)
    source = "".join(open(m.__file__).read() for m in (module, common, simhash))
    own = {name.lower() for text in re.findall(r'"([^"\n]*)"', source) for name in re.findall(r"[A-Za-z_]\w*", text)}
    own |= {f"_{name}" for name in ("host", "lost", "kept_id", "copy")}
    taken = {c.lower() for c in plain.columns} | {"media", "n_chars"}
    extra = sorted(own - taken)
    crowded = plain.select("*", *(F.lit(k).alias(name) for k, name in enumerate(extra)))
    right = operator(plain)
    got = operator(crowded)
    assert set(right.columns) <= set(got.columns)
    show = lambda df: sorted(str(tuple(r)) for r in df.select(*(F.col(f"`{c}`") for c in right.columns)).collect())
    assert show(got) == show(right)
    passed = [c for c in got.columns if c not in right.columns]
    if passed:
        at = {name: k for k, name in enumerate(extra)}
        assert all(r[c] == at[c] for r in got.select(passed).distinct().collect() for c in passed)


def peak(call):
    tracemalloc.start()
    try:
        call()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


LONG = 50_000_000


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(3)
    lines = [words(rng, rng.randrange(1, 30)) for _ in range(1000)]
    text = "\n".join(lines).encode()
    return (text * (LONG // len(text) + 1))[:LONG]


def test_passages_of_a_long_text(long_text):
    assert peak(lambda: quality.passages(long_text)) < 5 * LONG  # rows of features and word beginnings


def test_fingerprint_of_a_long_text(long_text):
    assert peak(lambda: simhash.fingerprint(long_text[: LONG // 5])) < 40_000_000


def test_lines_of_a_long_text(long_text):
    assert peak(lambda: linededup.line_hashes(long_text, 10)) < 1.5 * LONG
    assert peak(lambda: linededup._without(long_text, [1, 2, 3], 10)) < 3 * LONG


def test_media_of_a_long_text(long_text):
    payload = long_text[: LONG // 64 * 64]

    def through():
        stored = media.mux(payload)
        _, (track,) = media.probe(stored)
        assert media.read_samples(stored, track) == payload
        media.features(payload, track)

    assert peak(through) < 6 * LONG


def test_ranges_of_a_long_text(long_text):
    assert peak(lambda: mixing._ranges(long_text, [(0, 5), (10_000, 64)])) < 8 * LONG


def test_a_long_page():
    page = "<html><body>" + "".join(f"<p>Paragraph <b>{i}</b> &amp; more.</p>\n" for i in range(100_000)) + "</body></html>"
    assert len(htmltext.Extractor(None).text(page).split("\n\n")) == 100_000
    assert peak(lambda: htmltext.parse(page[: len(page) // 4])) < 60 * len(page)
