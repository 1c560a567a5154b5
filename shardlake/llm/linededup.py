"""Lines that documents share, dropped but in the first document, through minimal perfect hashes.

Only line hashes travel: each shard of hash space gets a minimal perfect hash over all its
distinct line hashes, which indexes compact arrays: a fingerprint and a document count for each
line, and the first document's id for those that several hold. The hashes of every document probe
those arrays; lines are never joined to lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OUT_ROWS, column, cut, fresh, scalars, schema_of, table

STRIPPED = b" \t\n\x0b\x0c\r"
LEAST_CODE_POINTS = 10
#: Line occurrences that one probing task should hold; beyond HOT times that, a shard's are dealt to several tasks.
SHARD_ROWS, HOT = 40_000, 2
#: No more shards than this can count as hot: those that hold one of so many parts of all occurrences.
MOST_HOT = 10_000
#: Bits per key and level of the minimal perfect hash; levels before the rest is listed.
GAMMA, LEVELS = 2, 24


def line_key(line: bytes) -> bytes:
    return line.strip(STRIPPED).lower()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8")) >= least)


def _spread(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    """Levels of bits: a key sits at the first level where it met no other; its index is the rank of that bit."""

    widths: np.ndarray
    bits: np.ndarray
    rest: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        widths, parts, left = [], [], np.unique(keys)
        for level in range(LEVELS):
            if not len(left):
                break
            width = max(64, GAMMA * len(left))
            spot = (_spread(left, level) % np.uint64(width)).astype(np.int64)
            alone = np.bincount(spot, minlength=width) == 1
            widths.append(width)
            parts.append(alone)
            left = left[~alone[spot]]
        bits = np.concatenate(parts) if parts else np.zeros(0, bool)
        return cls(np.array(widths, np.int64), np.packbits(bits), np.sort(left))

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, all different for the keys that were built in; -1 or any index for others."""
        out = np.full(len(keys), -1, np.int64)
        bits = np.unpackbits(self.bits)
        rank = np.cumsum(bits, dtype=np.int64) - bits
        todo, base = np.arange(len(keys)), 0
        for level, width in enumerate(self.widths.tolist()):
            spot = base + (_spread(keys[todo], level) % np.uint64(width)).astype(np.int64)
            hit = bits[spot] == 1
            out[todo[hit]] = rank[spot[hit]]
            todo, base = todo[~hit], base + width
        if len(self.rest) and len(todo):
            spot = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            hit = self.rest[spot] == keys[todo]
            out[todo[hit]] = int(bits.sum()) + spot[hit]
        return out


_OCCURRENCE = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])
_INDEX = "shard long, seed long, widths binary, bits binary, rest binary, prints binary, counts binary, owners binary"


def lines_of(raw: bytes) -> Iterator[bytes]:
    start = 0
    while (end := raw.find(b"\n", start)) >= 0:
        yield raw[start:end]
        start = end + 1
    yield raw[start:]


def line_hashes(raw: bytes, least: int) -> np.ndarray:
    """Both halves of the hashes of a text's different keys, a row for each."""
    out = bytearray()
    for line in lines_of(raw):
        if long_enough(key := line_key(line), least):
            out += xxhash.xxh3_128_digest(key)
    both = np.frombuffer(out, np.int64).reshape(-1, 2)
    return both[np.unique(both[:, 0], return_index=True)[1]]


def _occurrences(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, OUT_ROWS) for i in range(0, whole.num_rows, OUT_ROWS)):
                ids, found = column(b, "doc_id"), [np.zeros((0, 2), np.int64)]
                at: list[np.ndarray] = [np.zeros(0, np.int64)]
                for i, text in enumerate(column(b, "text")):
                    if text.is_valid and ids[i].is_valid:
                        found.append(line_hashes(text.as_buffer().to_pybytes(), least))
                        at.append(np.full(len(found[-1]), i))
                both = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(at))), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], schema=_OCCURRENCE)

    return run


def _keys(h1: np.ndarray, h2: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit key for each line of a shard; another seed parts keys that fall together."""
    return h2.view(np.uint64) ^ _spread(h1.view(np.uint64), seed)


def _prints(h1: np.ndarray) -> np.ndarray:
    return (h1.view(np.uint64) >> np.uint64(32)).astype(np.uint32)


def _build(group: pa.Table) -> pa.Table:
    """The arrays of one shard: prints and counts in the order of its perfect hash, owners for the counts over one."""
    h1, h2 = group["h1"].to_numpy(), group["h2"].to_numpy()
    seed = next(s for s in range(1 << 16) if len(np.unique(_keys(h1, h2, s))) == len(h1))
    keys = _keys(h1, h2, seed)
    mph, n = PerfectHash.build(keys), len(h1)
    spot = mph.lookup(keys)
    prints, counts, owners = np.zeros(n, np.uint32), np.zeros(n, np.uint16), np.zeros(n, np.int64)
    prints[spot] = _prints(h1)
    counts[spot] = np.minimum(group["holders"].to_numpy(), 2**16 - 1)
    owners[spot] = group["owner"].to_numpy()
    blobs = [x.tobytes() for x in (mph.widths, mph.bits, mph.rest, prints, counts, owners[counts > 1])]
    return pa.table({"shard": group["shard"][:1], "seed": pa.array([seed], pa.int64()), **{k: pa.array([v], pa.binary()) for k, v in zip(("widths", "bits", "rest", "prints", "counts", "owners"), blobs, strict=True)}})


def _probe(hashes: pa.Table, index: pa.Table) -> pa.Table:
    """Of a shard's (document, line hash) pairs those whose line stays in another document."""
    if not index.num_rows or not hashes.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "h1": pa.array([], pa.int64())})
    of = lambda name, kind: np.frombuffer(index[name][0].as_py(), kind)
    mph = PerfectHash(of("widths", np.int64), of("bits", np.uint8), of("rest", np.uint64))
    prints, counts, owners = of("prints", np.uint32), of("counts", np.uint16), of("owners", np.int64)
    doc, h1, h2 = (hashes[c].to_numpy() for c in ("doc_id", "h1", "h2"))
    spot = mph.lookup(_keys(h1, h2, index["seed"][0].as_py()))
    shared = np.flatnonzero((spot >= 0) & (prints[spot] == _prints(h1)) & (counts[spot] > 1))
    owner = owners[(np.cumsum(counts > 1) - 1)[spot[shared]]]
    lost = shared[owner < doc[shared]]
    return pa.table({"doc_id": pa.array(doc[lost]), "h1": pa.array(h1[lost])})


def lost_lines(documents: DataFrame, least: int = LEAST_CODE_POINTS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id and the hashes (array ``lost``) of its lines that an earlier document keeps."""
    hashes = cut(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_occurrences(least), "doc_id long, h1 long, h2 long"))
    (n,) = scalars(hashes, F.count("*"))
    shards = max(1, -(-n // shard_rows))
    hashes = hashes.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)))
    # Rows that repeat a doc_id are one document: a line that only they hold has one holder.
    holders = F.when(F.min("doc_id") == F.max("doc_id"), F.lit(1)).otherwise(F.count("*"))
    lines = hashes.groupBy("shard", "h1", "h2").agg(F.min("doc_id").alias("owner"), holders.alias("holders"))
    index = lines.groupBy("shard").applyInArrow(_build, _INDEX)
    # A line that very many documents hold makes its shard hot; the bound holds the number of those down.
    bound = max(HOT * shard_rows, n // MOST_HOT)
    hot = hashes.groupBy("shard").count().where(F.col("count") > bound)
    salts = F.broadcast(hot.select("shard", F.ceil(F.col("count") / shard_rows).cast("int").alias("salts")))
    many = F.coalesce(F.col("salts"), F.lit(1))
    dealt = hashes.join(salts, "shard", "left").select("shard", F.pmod(F.xxhash64("doc_id"), many).cast("int").alias("salt"), "doc_id", "h1", "h2")
    copies = index.join(salts, "shard", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("salts")
    lost = dealt.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(_probe, "doc_id long, h1 long")
    return lost.groupBy("doc_id").agg(F.collect_set("h1").alias("lost"))


def _without(raw: bytes, lost: list[int], least: int) -> tuple[bytes, int]:
    """A text less the lines of these hashes, and how many those were."""
    gone, out, dropped = set(lost), bytearray(), 0
    for line in lines_of(raw):
        if long_enough(key := line_key(line), least) and int.from_bytes(xxhash.xxh3_128_digest(key)[:8], "little", signed=True) in gone:
            dropped += 1
        else:
            out += line
            out += b"\n"
    del out[-1:]
    return bytes(out), dropped


def _kept(names: list[str], lost: str, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, OUT_ROWS // 8) for i in range(0, whole.num_rows, OUT_ROWS // 8)):
                texts, lines, dropped = [], [], []
                for text, gone in zip(column(b, "text"), column(b, lost), strict=True):
                    raw, n = text.as_buffer().to_pybytes() if text.is_valid else None, 0
                    lines.append((raw or b"").count(b"\n") + 1)
                    if raw and gone.is_valid:
                        raw, n = _without(raw, gone.as_py(), least)
                    texts.append(raw)
                    dropped.append(n)
                own = {"text": pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
                yield pa.RecordBatch.from_arrays([own[n] if n in own else column(b, n) for n in names], names=names)

    return run


def dedup_lines(documents: DataFrame, least: int = LEAST_CODE_POINTS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``documents`` with their texts less repeated lines, and columns n_lines and n_dropped.

    A line is what stands between \\n; its key is the line with blanks and \\x09-\\x0D stripped
    at both ends and A-Z in lower case. Keys of at least ``least`` code points that two documents
    or more hold lose all lines but those in the smallest doc_id. A text that is null stays null
    and counts as one empty line; a null doc_id is no document: its row passes unchanged. Rows
    that repeat a doc_id are parts of one document. Columns n_lines and n_dropped of the input
    are replaced; others pass through, whatever their names.
    """
    documents = documents.drop("n_lines", "n_dropped")
    schema = schema_of(documents, set(), "n_lines long, n_dropped long")
    lost, lost_id = fresh(documents, "lost", "lost_id")
    found = lost_lines(documents, least, shard_rows).select(F.col("doc_id").alias(lost_id), F.col("lost").alias(lost))
    both = documents.join(found, documents["doc_id"].cast("long") == found[lost_id], "left").drop(lost_id)
    return both.mapInArrow(_kept(schema.names, lost, least), schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents),
keyed AS (
  SELECT doc_id, n, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
held AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT k.doc_id, k.n, k.line, h.key IS NOT NULL AND k.doc_id <> h.owner AS gone
  FROM keyed k LEFT JOIN held h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
