"""ISO media containers: nested boxes, sample tables, codec, duration and keyframe byte ranges.

Readers look only at box headers, sample tables and fragment runs; payload bytes are never decoded.
All lengths and counts that a file states are held against its bytes before they are believed. A
writer for one-track raw 8-bit files makes the round trip testable.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OUT_ROWS, column, rows_to_arrow, schema_of, table

#: Boxes that hold other boxes.
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"))
#: Containers inside each other, far more than the format has.
DEEPEST = 32
UNIT = 64
KEYFRAME_EVERY = 16
UNITS_PER_CHUNK = 16
TIMESCALE = 8000


class MediaError(ValueError):
    """The bytes aren't a readable ISO media file."""


@dataclass
class Box:
    kind: bytes
    start: int
    body: int
    end: int
    path: tuple[bytes, ...]


@dataclass
class Piece:
    """Samples of one sample table or fragment run: chunks that lie together, and sizes that are all one or a list."""

    offsets: np.ndarray  # of each chunk
    first: np.ndarray  # each chunk's first sample
    count: int
    size: int = 0
    ends: np.ndarray | None = None  # of each sample, from the piece's first byte on; None where all have one size
    sync: np.ndarray | None = None  # keyframes; None where all are

    def _end(self, sample: np.ndarray) -> np.ndarray:
        """Bytes of all samples before these."""
        return sample * self.size if self.ends is None else np.r_[0, self.ends][sample]

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each chunk's bytes."""
        bytes_before = self._end(np.r_[self.first, self.count])
        return self.offsets, self.offsets + np.diff(bytes_before)

    def keyframes(self) -> tuple[np.ndarray, np.ndarray]:
        """Offset and length of each keyframe; where all samples are, of each chunk as one."""
        if self.sync is None:
            begin, end = self.ranges()
            return begin[end > begin], (end - begin)[end > begin]
        chunk = np.searchsorted(self.first, self.sync, "right") - 1
        before = self._end(self.sync)
        return self.offsets[chunk] + before - self._end(self.first[chunk]), self._end(self.sync + 1) - before

    def check(self, length: int) -> None:
        begin, end = self.ranges()
        if (begin < 0).any() or (end < begin).any() or (len(end) and end.max() > length):
            raise MediaError("samples outside the file")


@dataclass
class Track:
    number: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    pieces: list[Piece] = field(default_factory=list)

    @property
    def samples(self) -> int:
        return sum(p.count for p in self.pieces)

    def keyframes(self) -> list[tuple[int, int]]:
        return [k for p in self.pieces for k in zip(*(x.tolist() for x in p.keyframes()), strict=True)]

    def extents(self) -> Iterator[tuple[int, int]]:
        """Byte ranges (begin, end) of the samples in order, neighbours merged."""
        for p in self.pieces:
            begin, end = p.ranges()
            if len(begin):
                breaks = np.flatnonzero(begin[1:] != end[:-1]) + 1
                yield from zip(begin[np.r_[0, breaks]].tolist(), end[np.r_[breaks - 1, len(end) - 1]].tolist(), strict=True)


def walk(data: memoryview) -> Iterator[Box]:
    """Every box in file order, parents before children. Sizes 0 (to the end) and 1 (64 bits) count."""
    todo: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]
    while todo:
        start, end, path = todo.pop()
        if start == end:
            continue
        if end - start < 8:
            raise MediaError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise MediaError("a 64-bit box size is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise MediaError(f"box {kind!r} passes its parent's end")
        yield Box(kind, start, body, start + size, path)
        todo.append((start + size, end, path))
        if kind in CONTAINERS:
            if len(path) >= DEEPEST:
                raise MediaError("boxes are nested too deeply")
            todo.append((body, start + size, (*path, kind)))


class _Reader:
    """Numbers of one box, never beyond its end."""

    def __init__(self, data: memoryview, box: Box) -> None:
        self.data, self.at, self.end = data, box.body, box.end

    def take(self, form: str) -> tuple:
        if self.at + struct.calcsize(form) > self.end:
            raise MediaError("a box is cut off")
        out = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return out

    def one(self, form: str = ">I"):
        return self.take(form)[0]

    def table(self, count: int, dtype: str, width: int = 1) -> np.ndarray:
        if count * width * np.dtype(dtype).itemsize > self.end - self.at:
            raise MediaError("a sample table is cut off")
        return np.frombuffer(self.data, dtype, count * width, self.at).reshape(count, width).astype(np.int64)


class _Tables:
    """The sample tables of one track, as they come, and the ranges they add up to."""

    def __init__(self) -> None:
        self.track = Track()
        self.runs = self.chunks = self.sizes = self.sync = None
        self.each = self.count = 0

    def take(self, kind: bytes, r: _Reader) -> None:
        version = r.one() >> 24
        if kind == b"tkhd":
            r.take(">QQ" if version == 1 else ">II")
            self.track.number = r.one()
        elif kind == b"mdhd":
            r.take(">QQ" if version == 1 else ">II")
            self.track.timescale, self.track.duration = r.take(">IQ" if version == 1 else ">II")
        elif kind == b"hdlr":
            r.take(">I")
            self.track.handler = r.one(">4s").decode("latin-1")
        elif kind == b"stsd":
            if r.one():
                r.take(">I")
                self.track.codec = r.one(">4s").decode("latin-1")
        elif kind == b"stsc":
            self.runs = r.table(r.one(), ">u4", 3)
        elif kind in (b"stco", b"co64"):
            self.chunks = r.table(r.one(), ">u4" if kind == b"stco" else ">u8")[:, 0]
        elif kind == b"stsz":
            self.each, self.count = r.take(">II")
            self.sizes = None if self.each else r.table(self.count, ">u4")[:, 0]
        elif kind == b"stz2":
            bits, self.count = r.take(">II")
            self.each, bits = 0, bits & 255
            if bits == 4:
                packed = r.table((self.count + 1) // 2, "u1")[:, 0]
                self.sizes = np.stack([packed >> 4, packed & 15], 1).reshape(-1)[: self.count]
            elif bits in (8, 16):
                self.sizes = r.table(self.count, ">u1" if bits == 8 else ">u2")[:, 0]
            else:
                raise MediaError("stz2 with an unknown field size")
        elif kind == b"stss":
            self.sync = r.table(r.one(), ">u4")[:, 0] - 1

    def resolve(self, length: int) -> Track:
        n = self.count
        if self.sync is not None and len(self.sync) and (self.sync.min() < 0 or self.sync.max() >= n):
            raise MediaError("a keyframe that is no sample")
        if n:
            if self.runs is None or self.chunks is None or not len(self.runs):
                raise MediaError("samples without chunks")
            first = self.runs[:, 0] - 1
            spans = np.diff(np.r_[first, len(self.chunks)])
            if first[0] != 0 or (spans < 0).any():
                raise MediaError("chunk runs out of order")
            held = np.cumsum(np.repeat(self.runs[:, 1], spans))
            if not len(held) or held[-1] < n:
                raise MediaError("chunks hold fewer samples than there are")
            used = int(np.searchsorted(held, n)) + 1
            firsts = np.r_[0, held[: used - 1]]
            piece = Piece(self.chunks[:used], firsts, n, self.each, None if self.each else np.cumsum(self.sizes), self.sync)
            if self.each * n > length:
                raise MediaError("samples outside the file")
            piece.check(length)
            self.track.pieces.insert(0, piece)
        return self.track


class _Fragments:
    """Runs of samples in movie fragments, which go on with the tracks of the movie box."""

    def __init__(self) -> None:
        self.defaults: dict[int, tuple[int, int, int]] = {}  # duration, size and flags by track number
        self.moof = self.next = 0
        self.number, self.base, self.own = 0, 0, (0, 0, 0)
        self.found: list[tuple[int, int, Piece]] = []

    def take(self, kind: bytes, box: Box, r: _Reader, length: int) -> None:
        if kind == b"trex":
            r.one()
            number, _, duration, size, flags = r.take(">5I")
            self.defaults[number] = (duration, size, flags)
        elif kind == b"tfhd":
            given = r.one() & 0xFFFFFF
            self.number = r.one()
            own = list(self.defaults.get(self.number, (0, 0, 0)))
            # Without an own base the first track of a fragment counts from its start, later ones go on.
            self.base = r.one(">Q") if given & 1 else self.moof if given & 0x20000 else self.next
            if given & 2:
                r.one()
            for i, bit in enumerate((8, 16, 32)):
                if given & bit:
                    own[i] = r.one()
            self.own, self.next = (own[0], own[1], own[2]), self.base
        elif kind == b"trun":
            given = r.one() & 0xFFFFFF
            count = r.one()
            start = self.base + r.one(">i") if given & 1 else self.next
            head = r.one() if given & 4 else None
            fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if given & bit]
            rows = r.table(count, ">u4", len(fields)) if fields else None
            of = lambda bit: rows[:, fields.index(bit)] if given & bit else None
            durations, sizes, flags = of(0x100), of(0x200), of(0x400)
            duration = self.own[0] * count if durations is None else int(durations.sum())
            if not count:
                return
            if sizes is None and (not self.own[1] or self.own[1] * count > length):
                raise MediaError("a run of samples without a size, or outside the file")
            # Bit 16 of a sample's flags tells that it is no keyframe.
            if flags is not None:
                sync = np.flatnonzero(flags & 0x10000 == 0)
            else:
                sync = None if not self.own[2] & 0x10000 else np.zeros(0, np.int64)
            if head is not None:
                rest = np.arange(count) if sync is None and count <= length else sync
                rest = rest[rest > 0]
                sync = rest if head & 0x10000 else np.r_[0, rest]
            piece = Piece(np.array([start], np.int64), np.zeros(1, np.int64), count, self.own[1] if sizes is None else 0, None if sizes is None else np.cumsum(sizes), sync)
            piece.check(length)
            self.next = int(piece.ranges()[1][0])
            self.found.append((self.number, duration, piece))


TABLES = frozenset((b"tkhd", b"mdhd", b"hdlr", b"stsd", b"stsc", b"stco", b"co64", b"stsz", b"stz2", b"stss"))
RUNS = frozenset((b"trex", b"tfhd", b"trun"))


def probe(data: bytes | memoryview) -> tuple[str, list[Track]]:
    """The major brand and the tracks. Raises ``MediaError`` where the boxes don't add up."""
    view, brand, tables, fragments = memoryview(data), "", [], _Fragments()
    for box in walk(view):
        if box.kind == b"ftyp" and not box.path:
            brand = _Reader(view, box).one(">4s").decode("latin-1")
        elif box.kind == b"trak":
            tables.append(_Tables())
        elif box.kind == b"moof":
            fragments.moof = fragments.next = box.start
        elif box.kind in TABLES and tables and b"trak" in box.path:
            tables[-1].take(box.kind, _Reader(view, box))
        elif box.kind in RUNS and (b"traf" in box.path or b"mvex" in box.path):
            fragments.take(box.kind, box, _Reader(view, box), len(view))
    if not brand and not tables:
        raise MediaError("neither a brand nor a track")
    tracks = [t.resolve(len(view)) for t in tables]
    by_number = {t.number: t for t in tracks}
    for number, duration, piece in fragments.found:
        if number not in by_number:
            raise MediaError("a fragment of no track")
        by_number[number].pieces.append(piece)
        by_number[number].duration += duration
    return brand, tracks


def read_samples(data: bytes | memoryview, track: Track) -> bytes:
    view = memoryview(data)
    return b"".join(view[a:b] for a, b in track.extents())


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def mux(payload: bytes) -> bytes:
    """A one-track file of raw 8-bit mono sound: units of 64 samples, a keyframe each 16 units."""
    if not payload or len(payload) % UNIT:
        raise MediaError("the payload is no positive multiple of the unit")
    units = len(payload) // UNIT
    chunks, rest = divmod(units, UNITS_PER_CHUNK)
    runs = [(1, UNITS_PER_CHUNK, 1)] * bool(chunks) + [(chunks + 1, rest, 1)] * bool(rest)
    chunks += bool(rest)
    sync = range(1, units + 1, KEYFRAME_EVERY)
    entry = _box(b"raw ", struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, TIMESCALE << 16))
    wide = len(payload) >= 1 << 31

    def file_head(at: int) -> bytes:
        places = np.arange(chunks, dtype=np.int64) * (UNITS_PER_CHUNK * UNIT) + at
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, units, UNIT)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", UNIT, units)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), places.astype(">u8" if wide else ">u4").tobytes()),
            _full(b"stss", struct.pack(">I", len(sync)), np.array(sync, dtype=">u4").tobytes()),
        )
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        long = struct.pack(">QQIQ", 0, 0, TIMESCALE, len(payload))
        mdia = _box(b"mdia", _full(b"mdhd", long, struct.pack(">HH", 0x55C4, 0), version=1), _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"sound\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, len(payload), 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=7)
        mvhd = _full(b"mvhd", long, struct.pack(">IH10x", 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41") + _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    size = len(file_head(0)) + (16 if len(payload) + 8 >= 1 << 32 else 8)
    return file_head(size) + _box(b"mdat", payload)


_KEYFRAMES = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
_TRACK = [("codec", pa.string()), ("handler", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("keyframes", _KEYFRAMES)]
_RANGES = "array<struct<offset:long,length:long>>"
INDEX_SCHEMA = (
    f"media_brand string, media_codec string, media_handler string, media_timescale long, media_duration long, media_samples long, media_keyframes {_RANGES}, "
    f"media_tracks array<struct<codec:string,handler:string,timescale:long,duration:long,samples:long,keyframes:{_RANGES}>>, media_error string"
)
INDEX_NAMES = ("media_brand", *(f"media_{name}" for name, _ in _TRACK), "media_tracks", "media_error")
_INDEX_TYPES = (pa.string(), *(kind for _, kind in _TRACK), pa.list_(pa.struct(_TRACK)), pa.string())


def _index(data: memoryview | None) -> tuple:
    if data is None:
        return (None,) * len(INDEX_NAMES)
    try:
        brand, tracks = probe(data)
    except MediaError as e:
        return (None,) * (len(INDEX_NAMES) - 1) + (str(e),)
    if not tracks:
        return (brand, None, None, None, None, 0, [], [], "no track")
    rows = [(t.codec, t.handler, t.timescale, t.duration, t.samples, [{"offset": a, "length": n} for a, n in t.keyframes()]) for t in tracks]
    return (brand, *rows[0], [dict(zip((name for name, _ in _TRACK), r, strict=True)) for r in rows], None)


def index_media(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with the index columns of ``INDEX_NAMES``: the first track of binary column ``media``, and all tracks.

    Null media give null columns; bytes that aren't a readable file give nulls and the reason
    in ``media_error``. Without a sync table all samples are keyframes, told as a range for each chunk.
    Times of fragments count towards their track's duration. Columns of ``df`` that carry one of these
    names are replaced.
    """
    df = df.drop(*INDEX_NAMES)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, OUT_ROWS // 16) for i in range(0, whole.num_rows, OUT_ROWS // 16)):
                found = [_index(memoryview(x.as_buffer()) if x.is_valid else None) for x in column(b, media)]
                extra = [pa.array(c, type=t) for c, t in zip(zip(*found, strict=True), _INDEX_TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*names, *INDEX_NAMES])

    return df.mapInArrow(run, schema_of(df, set(), INDEX_SCHEMA))


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    return len(raw), raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def features(payload: bytes, track: Track) -> str:
    samples = np.frombuffer(payload, np.uint8)
    level = energy = 0
    for i in range(0, len(samples), 1 << 20):
        part = samples[i : i + (1 << 20)].astype(np.float64)
        level, energy = level + int(part.sum()), energy + int(np.dot(part, part))
    high = samples >= 128
    turns = int(np.count_nonzero(high[1:] != high[:-1]))
    keys = track.keyframes()
    ranges = zlib.crc32(np.array(keys, dtype="<i8").tobytes())
    return (
        f"codec={track.codec.strip()};handler={track.handler};timescale={track.timescale};duration={track.duration};units={track.samples};"
        f"keyframes={len(keys)};first_key={keys[0][0]}+{keys[0][1]};key_ranges_crc32={ranges};level={level};energy={energy};crossings={turns}"
    )


STORED_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
        ("media_codec", pa.string()), ("media_duration", pa.int64()), ("media_keyframes", _KEYFRAMES),
    ]
)


def store_texts(documents: DataFrame) -> DataFrame:
    """Store each text as an ISO media file, read it back through its sample tables, and digest both.

    A null text counts as empty; an empty one is 64 zero bytes. Equal texts give equal values,
    repeated rows give repeated results, a null doc_id stays null, other columns are left out.
    """
    pack = rows_to_arrow(STORED_SCHEMA)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for doc_id, text in zip(column(b, "doc_id"), column(b, "text"), strict=True):
                n, payload = payload_of(text.as_py())
                media = mux(payload)
                _, (track,) = probe(media)
                back = read_samples(media, track)
                keys = [{"offset": a, "length": k} for a, k in track.keyframes()]
                yield (
                    doc_id.as_py(), n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]),
                    len(media), hashlib.sha256(media).hexdigest(), features(back, track), track.codec, track.duration, keys,
                )

    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
        "media_codec string, media_duration long, media_keyframes array<struct<offset:long,length:long>>"
    )
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: pack(rows(it)), schema)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(table(spark, sf_dir, "documents"))
