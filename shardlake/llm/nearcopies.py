"""Near copies by SimHash, held against the exact Jaccard similarity of their sets of word shingles.

Texts meet on the popcount grid of their fingerprints, which misses no pair up to 5 bits. Pairs of
similarity 0.8 differ in up to 17 bits, beyond any grid of 64 bits: those that are more than 5
bits apart meet by MinHash, each text being filed in a cell for every band of minima. What meets is
compared on the whole sets, pair by pair in small cells and from member to member in large ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, raw_text, scalars
from .components import components
from .simhash import COUNT_ROWS, REACH, majority, meetings, shingle_hashes, smallest

#: Texts are near copies from a Jaccard similarity of 4/5 on.
SHINGLE_WORDS, SHARE, WHOLE = 5, 4, 5
#: A pair of similarity 0.8 meets in no band once in (1 - 0.8^5)^-32, or 300,000 pairs.
BANDS, BAND_ROWS = 32, 5
#: Cells with more texts get the sets themselves, so that pairs don't grow with the square.
SMALL_CELL = 32
#: Names of texts that meet others are broadcast up to this size.
SENT_BYTES = 32 << 20
#: Shingles that one task compares at once; a cell that has more is dealt to blocks, and each two blocks meet.
CELL_SHINGLES = 32_000_000

_RANDOM = np.random.default_rng(2026)
_FACTORS = _RANDOM.integers(0, 2**64, (BANDS * BAND_ROWS, 1), np.uint64) | np.uint64(1)
_WEIGHTS = _RANDOM.integers(0, 2**64, (BANDS, BAND_ROWS), np.uint64) | np.uint64(1)


def shingle_set(raw: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    return np.unique(shingle_hashes(raw, words))


def band_cells(shingles: np.ndarray) -> np.ndarray:
    """The text's cell in each band; none without words."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), COUNT_ROWS >> 4):
        least = np.minimum(least, (_FACTORS * shingles[i : i + (COUNT_ROWS >> 4)]).min(axis=1))
    return (least.reshape(_WEIGHTS.shape) * _WEIGHTS).sum(axis=1, dtype=np.uint64)


def digest_of(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int.from_bytes(xxhash.xxh3_64_digest(shingles.tobytes()), "big", signed=True)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text the digest of its set, its fingerprint and its cells; sets are too large to be kept for all."""
    for whole in batches:
        for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
            digests, fps, cells = [], [], []
            for t in column(b, "text"):
                hashes = shingle_hashes(raw_text(t), SHINGLE_WORDS)
                fps.append(majority([hashes]))
                shingles = np.unique(hashes)
                digests.append(digest_of(shingles))
                cells.append(band_cells(shingles).view(np.int64))
            own = [pa.array(digests, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(cells, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), *own], names=["doc_id", "digest", "fp", "cells"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of those texts whose digest is the one asked for."""
    for whole in batches:
        for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
            rows = []
            for digest, node, fp, t in zip(*(column(b, c).to_pylist() for c in ("digest", "node", "fp")), column(b, "text"), strict=True):
                shingles = shingle_set(raw_text(t))
                if digest_of(shingles) == digest:  # rows that repeat an id may have other texts
                    rows.append((digest, node, fp, shingles.view(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["digest", "node", "fp", "shingles"])


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list]:
    """The values of each name for each cell and pair of blocks, by which rows are sorted."""
    group, held = None, []
    for b in batches:
        at = np.stack([column(b, "cell").to_numpy(), column(b, "pair").to_numpy()])
        starts = np.flatnonzero(np.r_[True, (at[:, 1:] != at[:, :-1]).any(0)]) if b.num_rows else []
        for a, z in zip(starts, [*starts[1:], b.num_rows], strict=True):
            if held and tuple(at[:, a]) != group:
                yield [pa.concat_arrays(x) for x in zip(*held, strict=True)]
                held = []
            group = tuple(at[:, a])
            held.append([column(b, n).slice(a, z - a) for n in names])
    if held:
        yield [pa.concat_arrays(x) for x in zip(*held, strict=True)]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of digests that share a small cell; (cell, digest) of large cells."""
    held: list[np.ndarray] = []
    size = 0

    def out() -> pa.RecordBatch:
        rows = np.concatenate(held, axis=1)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(rows[0] == 1), pa.array(rows[1]), pa.array(rows[2])], names=["large", "u", "v"])

    def pairs(cell: np.ndarray, digest: np.ndarray) -> Iterator[np.ndarray]:
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sizes = np.diff(np.r_[starts, len(cell)])
        own = np.repeat(sizes, sizes)
        big = own > SMALL_CELL
        yield np.stack([np.ones(big.sum(), np.int64), cell[big], digest[big]])
        end, at = np.repeat(starts + sizes, sizes), np.flatnonzero(~big & (own > 1))
        for step in range(1, SMALL_CELL):
            at = at[at + step < end[at]]
            if not len(at):
                break
            a, b = digest[at], digest[at + step]
            yield np.stack([np.zeros(len(at), np.int64), np.minimum(a, b), np.maximum(a, b)])

    cell, digest, crowded = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for b in batches:
        if not b.num_rows:
            continue
        new, ids = column(b, "cell").to_numpy(), column(b, "digest").to_numpy()
        if crowded is not None:  # the cell that was passed on as large goes on
            end = int(np.searchsorted(new, crowded, "right")) if new[0] == crowded else 0
            held.append(np.stack([np.ones(end, np.int64), new[:end], ids[:end]]))
            size, new, ids = size + end, new[end:], ids[end:]
            if not len(new):
                continue
            crowded = None
        cell, digest = np.r_[cell, new], np.r_[digest, ids]
        whole = int(np.searchsorted(cell, cell[-1], "left"))  # the last run may go on
        if len(cell) - whole > SMALL_CELL:
            crowded, whole = int(cell[-1]), len(cell)
        if whole:
            held += pairs(cell[:whole], digest[:whole])
            size += whole
            cell, digest = cell[whole:], digest[whole:]
        if size >= COUNT_ROWS:
            yield out()
            size = 0
    if len(cell):
        held += pairs(cell, digest)
    if held:
        yield out()


def connect(sets: list[np.ndarray], nodes: np.ndarray) -> np.ndarray:
    """A forest (u, v) with all links among these sets: each links to the one that reached it."""
    sizes = np.array([len(s) for s in sets])
    _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[place] > 1  # what only one set has is in no intersection
    bit = (np.cumsum(counts > 1) - 1)[place[shared]]
    bits = np.zeros((len(sets), int((counts > 1).sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (np.repeat(np.arange(len(sets)), sizes)[shared], bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    edges, left = [np.zeros((0, 2), np.int64)], np.arange(len(sets))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            both = np.bitwise_count(bits[left] & bits[at]).sum(axis=1, dtype=np.int64)
            near = (SHARE + WHOLE) * both >= SHARE * (sizes[left] + sizes[at])
            if near.any():
                edges.append(np.stack([np.full(near.sum(), nodes[at]), nodes[left[near]]], 1))
                queue.extend(left[near].tolist())
                left = left[~near]
    return np.concatenate(edges)


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for nodes, shingles in _runs(batches, ["node", "shingles"]):
        ends = shingles.offsets.to_numpy()
        flat = shingles.values.to_numpy()
        found = connect([flat[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)], nodes.to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["u", "v"])


def _by_prints(nodes: DataFrame) -> DataFrame:
    """What the grid of the fingerprints meets: all pairs up to 5 bits."""
    return meetings(nodes.select("fp", F.col("digest").alias("node")))


def _by_bands(nodes: DataFrame) -> DataFrame:
    """What shares a band of minima."""
    parts = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    filed = nodes.select(F.explode("cells").alias("cell"), "digest")
    return filed.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_meet, "large boolean, u long, v long")


def near_copies(documents: DataFrame) -> DataFrame:
    """doc_id and component_id, the smallest doc_id that links of similarity 0.8 or more reach.

    Equal sets are one node, named by the smallest doc_id; texts without words are one. Pairs of nodes up to 5
    bits apart come from the fingerprints, the bands add those farther apart. A null doc_id names no component. Repeated rows are repeated, other columns left out.
    """
    spark = documents.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = cut(texts.mapInArrow(_prints, "doc_id long, digest long, fp long, cells array<long>"))
    # Texts of one set may repeat its shingles differently; any of their fingerprints does, if it is the same in all runs.
    nodes = cut(prints.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), F.min("fp").alias("fp"), F.first("cells").alias("cells")))
    close, banded = _by_prints(nodes).withColumn("close", F.lit(True)), _by_bands(nodes).withColumn("close", F.lit(False))
    met = cut(close.union(banded).distinct())
    names = nodes.select("digest", "node", "fp")
    wanted = cut(names.join(met.where("NOT large").select(F.col("u").alias("digest")).union(met.select("v")).distinct(), "digest"))
    # Most texts meet none: sets are made anew for those that do, and where their names are few, no other text is moved.
    (n,) = scalars(wanted, F.count("*"))
    few = F.broadcast(wanted) if n * 24 <= SENT_BYTES else wanted
    own = texts.join(few, texts["doc_id"] == few["node"]).select("digest", "node", "fp", "text")
    sets = own.mapInArrow(_sets, "digest long, node long, fp long, shingles array<long>")
    sets = cut(sets.groupBy("digest").agg(F.first("node").alias("node"), F.first("fp").alias("fp"), F.first("shingles").alias("shingles")))
    a = sets.select(F.col("digest").alias("u"), F.col("node").alias("a"), F.col("fp").alias("f"), F.col("shingles").alias("x"))
    b = sets.select(F.col("digest").alias("v"), F.col("node").alias("b"), F.col("fp").alias("g"), F.col("shingles").alias("y"))
    due = F.col("close") | (F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) > REACH)  # the grid has met the others
    alike = (SHARE + WHOLE) * F.size(F.array_intersect("x", "y")) >= SHARE * (F.size("x") + F.size("y"))
    paired = met.where("NOT large").select("u", "v", "close").join(a, "u").join(b, "v").where(due & alike).select(F.col("a").alias("u"), F.col("b").alias("v"))
    large = met.where("large").select(F.col("u").alias("cell"), F.col("v").alias("digest")).distinct()
    crowded = large.join(sets, "digest").select("cell", "node", "shingles")
    # No more cells can be dealt to blocks than CELL_SHINGLES goes into all shingles that are filed.
    sizes = sets.select("digest", F.size("shingles").alias("n"))
    vast = large.join(sizes, "digest").groupBy("cell").agg(F.ceil(F.sum("n") / CELL_SHINGLES).alias("blocks")).where("blocks > 1")
    dealt = crowded.join(F.broadcast(vast), "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own, last = F.pmod(F.xxhash64("node"), F.col("blocks")), F.col("blocks") - 1
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), last), lambda other: F.least(own, other) * F.col("blocks") + F.greatest(own, other)))
    met_twice = dealt.select("cell", pair.alias("pair"), "node", "shingles")
    reached = met_twice.repartition(parts, "cell", "pair").sortWithinPartitions("cell", "pair").mapInArrow(_connect, "u long, v long")
    roots = components(paired.union(reached))
    named = names.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id"))
    return prints.select("doc_id", "digest").join(named, "digest", "left").select("doc_id", "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents that are the smallest doc_id of their component, each id once; null ids pass."""
    return smallest(documents, near_copies(documents))
