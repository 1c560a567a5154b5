from __future__ import annotations

import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shardlake.llm.media import MediaError, index_media, mux, payload_of, probe, read_samples, store_texts, walk


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=3000))
def test_round_trip(text):
    n, payload = payload_of(text)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[:n] == text.encode() and not payload[n:].strip(b"\0")
    media = mux(payload)
    brand, (track,) = probe(media)
    assert brand == "isom" and track.codec == "raw " and track.handler == "soun" and track.duration == len(payload)
    assert read_samples(media, track) == payload
    for offset, length in track.keyframes():
        assert media[offset : offset + length] in payload and length == 64


def box(kind: bytes, body: bytes, size: int | None = None) -> bytes:
    return struct.pack(">I4s", len(body) + 8 if size is None else size, kind) + body


def full(kind: bytes, body: bytes) -> bytes:
    return box(kind, bytes(4) + body)


def test_variable_samples_in_uneven_chunks():
    # Sizes 3, 5, 2, 4 in chunks of 2, 1, 1 that lie apart; keyframes are samples 1 and 3; the last box reaches to the end.
    head = box(b"ftyp", b"isom" + bytes(4))

    def moov(base):
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1) + box(b"avc1", bytes(70)))
            + full(b"stsc", struct.pack(">I6I", 2, 1, 2, 1, 2, 1, 1))
            + full(b"stsz", struct.pack(">II4I", 0, 4, 3, 5, 2, 4))
            + full(b"co64", struct.pack(">I3Q", 3, base, base + 10, base + 20))
            + full(b"stss", struct.pack(">I2I", 2, 1, 3)),
        )
        mdhd = full(b"mdhd", struct.pack(">IIII", 0, 0, 90000, 12345) + bytes(4))
        return box(b"moov", box(b"trak", box(b"mdia", mdhd + box(b"minf", stbl))))

    base = len(head) + len(moov(0)) + 8
    media = head + moov(base) + box(b"mdat", b"aaabbbbb..cc--------dddd", 0)
    _, (t,) = probe(media)
    assert (t.codec, t.timescale, t.duration) == ("avc1", 90000, 12345)
    assert t.keyframes() == [(base, 3), (base + 10, 2)] and read_samples(media, t) == b"aaabbbbbccdddd"


@pytest.mark.parametrize("data", [b"", b"abc", b"\0\0\0\x20moov", struct.pack(">I4s", 4, b"free"), box(b"moov", box(b"trak", b"\0\0\0\x09mdiax"))])
def test_broken_bytes_raise(data):
    with pytest.raises(MediaError):
        brand, tracks = probe(data)
        if not brand:
            raise MediaError


def test_large_box_size():
    assert [b.kind for b in walk(memoryview(struct.pack(">I4sQ", 1, b"free", 20) + b"abcd"))] == [b"free"]


def test_store_texts(spark):
    rows = [(1, "a"), (1, "a"), (None, None), (3, ""), (4, "é" * 50_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, feature string")
    found = store_texts(df).collect()
    assert len(found) == 5
    for r, (doc_id, text) in zip(sorted(found, key=lambda r: (r.n_bytes, r.doc_id or 0)), [(None, None), (3, ""), (1, "a"), (1, "a"), (4, "é" * 50_000)], strict=True):
        n, payload = payload_of(text)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = mux(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert store_texts(df.limit(0)).count() == 0


def test_index_media(spark):
    df = spark.createDataFrame([(1, bytearray(mux(b"x" * 2048)), "old"), (2, None, "old"), (3, bytearray(b"junk!"), "old")], "id int, media binary, media_codec string")
    rows = {r.id: r for r in index_media(df).collect()}
    assert rows[1].media_codec == "raw " and len(rows[1].media_keyframes) == 2 and rows[1].media_error is None
    assert [t.codec for t in rows[1].media_tracks] == ["raw "] and rows[1].media_tracks[0].keyframes == rows[1].media_keyframes
    assert rows[2].media_codec is None and rows[2].media_error is None and rows[3].media_error


def trak(number: int, codec: bytes, *tables: bytes) -> bytes:
    tkhd = full(b"tkhd", struct.pack(">IIII", 0, 0, number, 0))
    mdhd = full(b"mdhd", struct.pack(">IIII", 0, 0, 1000, 7) + bytes(4))
    stsd = full(b"stsd", struct.pack(">I", 1) + box(codec, bytes(70)))
    return box(b"trak", tkhd + box(b"mdia", mdhd + full(b"hdlr", bytes(4) + b"vide") + box(b"minf", box(b"stbl", stsd + b"".join(tables)))))


def flagged(kind: bytes, flags: int, body: bytes) -> bytes:
    return box(kind, struct.pack(">I", flags) + body)


def fragmented() -> tuple[bytes, bytes]:
    """Two tracks in two fragments, and what the first track's samples hold."""
    trex = [full(b"trex", struct.pack(">5I", n, 1, 40, size, flags)) for n, size, flags in ((1, 0, 0x10000), (2, 2, 0))]
    head = box(b"ftyp", b"iso5" + bytes(4)) + box(b"moov", trak(1, b"avc1") + trak(2, b"mp4a") + box(b"mvex", b"".join(trex)))
    out = head
    for data, sizes, flags in ((b"AAAAbbcc", (4, 2, 2), (0, 0x10000, 0x10000)), (b"DDDDDe", (5, 1), (0, 0x10000))):

        def moof(offset):
            rows = b"".join(struct.pack(">II", *r) for r in zip(sizes, flags, strict=True))
            first = flagged(b"tfhd", 0x20000, struct.pack(">I", 1)) + flagged(b"trun", 0x601, struct.pack(">Ii", len(sizes), offset) + rows)
            second = flagged(b"tfhd", 0, struct.pack(">I", 2)) + flagged(b"trun", 0, struct.pack(">I", 3))
            return box(b"moof", full(b"mfhd", struct.pack(">I", 1)) + box(b"traf", first) + box(b"traf", second))

        out += moof(len(moof(0)) + 8) + box(b"mdat", data + b"xxyyzz")
    return out, b"AAAAbbccDDDDDe"


def test_fragments_and_all_tracks():
    media, samples = fragmented()
    brand, (video, sound) = probe(media)
    assert brand == "iso5" and (video.codec, sound.codec) == ("avc1", "mp4a") and (video.samples, sound.samples) == (5, 6)
    assert read_samples(media, video) == samples and read_samples(media, sound) == b"xxyyzz" * 2
    assert [media[a : a + n] for a, n in video.keyframes()] == [b"AAAA", b"DDDDD"] and [n for _, n in sound.keyframes()] == [6, 6]
    assert (video.duration, sound.duration) == (7 + 5 * 40, 7 + 6 * 40)


def test_first_sample_flags():
    def file(flags, head, default):
        trex = full(b"trex", struct.pack(">5I", 1, 1, 10, 3, default))
        moof = lambda at: box(b"moof", box(b"traf", flagged(b"tfhd", 0x20000, struct.pack(">I", 1)) + flagged(b"trun", flags, struct.pack(">Ii", 3, at) + head)))
        return box(b"ftyp", b"iso5" + bytes(4)) + box(b"moov", trak(1, b"avc1") + box(b"mvex", trex)) + moof(len(moof(0)) + 8) + box(b"mdat", b"aaabbbccc")

    keys = lambda *a: [n for _, n in probe(file(*a))[1][0].keyframes()]
    assert keys(5, struct.pack(">I", 0), 0x10000) == [3] and keys(5, struct.pack(">I", 0x10000), 0x10000) == []
    assert keys(5, struct.pack(">I", 0x10000), 0) == [3, 3] and keys(1, b"", 0) == [9] and keys(1, b"", 0x10000) == []


HUGE = [
    trak(1, b"raw ", full(b"stsz", struct.pack(">II", 1, 2**32 - 1)), full(b"stsc", struct.pack(">I3I", 1, 1, 2**32 - 1, 1)), full(b"stco", struct.pack(">II", 1, 0))),
    trak(1, b"raw ", full(b"stsz", struct.pack(">II", 0, 2**32 - 1))),
    trak(1, b"raw ", full(b"stsc", struct.pack(">I", 2**31))),
    trak(1, b"raw ", full(b"stsz", struct.pack(">II", 1, 3)), full(b"stsc", struct.pack(">I3I", 1, 2**32 - 1, 3, 1)), full(b"stco", struct.pack(">II", 1, 0))),
    trak(1, b"raw ", full(b"stsz", b"\0\0\0")),
    box(b"trak", box(b"mdia", full(b"mdhd", b"\0"))),
    box(b"trak", box(b"mdia", box(b"mdhd", b"\1"))),
    trak(1, b"raw ", full(b"stsz", struct.pack(">II", 1, 1)), full(b"stsc", struct.pack(">I3I", 1, 1, 1, 1)), full(b"co64", struct.pack(">IQ", 1, 2**63 + 1))),
]


@pytest.mark.parametrize("body", HUGE, ids=range(len(HUGE)))
def test_stated_counts_are_not_believed(body):
    with pytest.raises(MediaError):
        probe(box(b"ftyp", b"isom" + bytes(4)) + box(b"moov", body))


def test_deep_nesting():
    data = b""
    for _ in range(1500):
        data = box(b"moov", data)
    with pytest.raises(MediaError):
        probe(data)


def test_damaged_files_give_a_row_or_a_reason():
    import random

    from shardlake.llm.media import INDEX_NAMES, _index

    rng, ended = random.Random(4), [0, 0]
    for whole in (mux(bytes(range(256)) * 8), fragmented()[0]):
        tries = [whole[:n] for n in range(0, len(whole), 7)]
        for _ in range(3000):
            data = bytearray(whole)
            for _ in range(rng.randrange(1, 6)):
                data[rng.randrange(min(len(data), 900))] = rng.choice((0, 1, 127, 128, 255, rng.randrange(256)))
            tries.append(bytes(data))
        for data in tries:
            row = _index(memoryview(data))
            assert len(row) == len(INDEX_NAMES) and (row[-1] is not None or row[5] is not None)
            ended[row[-1] is None] += 1
    assert min(ended) > 100
