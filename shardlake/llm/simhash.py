"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint becomes its bit counts in segments of two bits (of one bit where there are very many
fingerprints). The Manhattan distance of two such points never exceeds the Hamming distance of the
fingerprints, and if that is at most 5, one half of the segments is within 2. Points are put on
the grid of each half: every point is filed at its own cell and at all cells one step away, so that
two points within 2 meet at a cell half-way. What meets in a cell is verified exactly on the
fingerprints.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, cut, fresh, raw_text, scalars, table
from .components import components

SHINGLE_WORDS, MOST_BITS, HASH_SEED = 4, 4, 42
#: The grid meets all pairs up to this distance.
REACH = 5
#: Shingles whose bits are counted at once; bytes of a text that are cut into words at once.
COUNT_ROWS, SLICE_BYTES = 1 << 15, 1 << 18
#: Rows of cells that are looked through at once; rows that a task should get.
CELL_ROWS, TASK_ROWS = 1 << 20, 1 << 20
#: The same where all pairs of a cell are listed, which are up to SMALL_CELL / 2 for each row.
MEETING_ROWS = 1 << 16
#: Fingerprints from which on segments have one bit: a point meets one in 2^14 others by chance on the coarse
#: grid, one in 2^23 on the fine one, which has 66 rows a point instead of 50. Both find the same links.
FINE_GRID = 4_000_000
#: Cells with more points are searched point by point, each point meeting those not yet reached.
SMALL_CELL = 32

_EVEN = np.uint64(0x5555555555555555)
_BLANK = re.compile(rb"[ \t-\r]")


def _slices(raw: bytes) -> Iterator[bytes]:
    """The text in parts that end at a blank, so that no word is parted."""
    start = 0
    while len(raw) - start > SLICE_BYTES:
        found = _BLANK.search(raw, start + SLICE_BYTES)
        end = found.start() if found else len(raw)
        yield raw[start:end]
        start = end
    yield raw[start:]


def shingle_parts(raw: bytes, words: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles in order, repeats included, some at a time; a text of fewer words is one shingle."""
    digest = xxhash.xxh64_intdigest
    carried: list[bytes] = []
    some = False
    for part in _slices(raw):
        carried += part.lower().split()
        if len(carried) < words:
            continue
        joined = b" ".join(carried)
        ends = np.cumsum([len(p) + 1 for p in carried]) - 1
        starts = np.r_[0, ends[:-1] + 1][: len(carried) - words + 1].tolist()
        yield np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)
        some, carried = True, carried[len(carried) - words + 1 :]
    if carried and not some:
        yield np.array([digest(b" ".join(carried), HASH_SEED)], np.uint64)


def shingle_hashes(raw: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *shingle_parts(raw, words)])


def majority(parts: Iterable[np.ndarray]) -> int:
    """Bits that are set in over half of all hashes; 0 for none."""
    counts, total = np.zeros(64, np.int64), 0
    for h in parts:
        total += len(h)
        for i in range(0, len(h), COUNT_ROWS):
            part = h[i : i + COUNT_ROWS]
            counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > total, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprint(raw: bytes, words: int = SHINGLE_WORDS) -> int:
    """Bits that are set in over half the shingle hashes; 0 for a text without words."""
    return majority(shingle_parts(raw, words))


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(raw_text(t), words) for t in column(b, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(documents: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp, a long with the 64 bits, for every row."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(words), "doc_id long, fp long")


def embed(prints: np.ndarray, width: int = 2) -> np.ndarray:
    """Bit counts of the segments of one or two bits, in place."""
    return prints if width == 1 else prints - ((prints >> np.uint64(1)) & _EVEN)


def cells(prints: np.ndarray, width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): each point's own cell and those one step away, on both half grids."""
    rows, out = [], []
    points, index = embed(prints, width), np.arange(len(prints))
    most = width
    for half in (0, 1):
        own = ((points >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        base = own | (half << 32)
        rows.append(index), out.append(base)
        for i in range(0, 32, width):
            count = (own >> i) & ((1 << width) - 1)
            for step, can in ((1, count < most), (-1, count > 0)):
                rows.append(index[can]), out.append(base[can] + (step << i))
    return np.concatenate(rows), np.concatenate(out)


def _file(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, node = column(b, "fp").to_numpy(), column(b, "node").to_numpy()
            for i in range(0, len(fp), 1 << 14):
                row, cell = cells(fp[i : i + (1 << 14)].view(np.uint64), width)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp[i + row]), pa.array(node[i + row])], names=["cell", "fp", "node"])

    return run


def _reach(fp: np.ndarray, node: np.ndarray, bits: int) -> list[np.ndarray]:
    """A forest with all links inside one cell: each point links to the one that reached it."""
    edges, left = [], np.arange(len(fp))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= bits
            if near.any():
                found = left[near]
                edges.append(np.stack([np.full(len(found), node[at]), node[found]], 1))
                queue.extend(found.tolist())
                left = left[~near]
    return edges


def _near(fp: np.ndarray, node: np.ndarray, sizes: np.ndarray, bits: int) -> list[np.ndarray]:
    """All links inside small runs of these sizes, which follow one another; larger runs are passed over."""
    edges, ends = [], np.cumsum(sizes)
    rest = np.repeat(np.where(sizes > SMALL_CELL, 0, ends), sizes)  # the end of each small run
    at = np.arange(len(fp))
    for step in range(1, SMALL_CELL):
        at = at[at + step < rest[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= bits]
        edges.append(np.stack([node[near], node[near + step]], 1))
    return edges


def _links(cell: np.ndarray, fp: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Verified links in whole runs of equal cells, repeats removed."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    edges = []
    for a, n in zip(starts[sizes > SMALL_CELL].tolist(), sizes[sizes > SMALL_CELL].tolist(), strict=True):
        edges += _reach(fp[a : a + n], node[a : a + n], bits)
    edges += _near(fp, node, sizes, bits)
    if not edges:
        return np.zeros((0, 2), np.int64)
    found = np.concatenate(edges)
    return np.unique(np.stack([found.max(1), found.min(1)], 1), axis=0) if len(found) else found


def _meetings(cell: np.ndarray, fp: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """(0, u, v) for all links in whole runs of equal cells; (1, group, node) for what links join in large runs.

    A group is named by its nodes, so that cells which hold the same ones name one group.
    """
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    edges, groups = _near(fp, node, sizes, bits), []
    for a, n in zip(starts[sizes > SMALL_CELL].tolist(), sizes[sizes > SMALL_CELL].tolist(), strict=True):
        label = np.arange(n)
        for found in _reach(fp[a : a + n], label.copy(), bits):
            label[found[:, 1]] = label[found[0, 0]]  # reached before, so it has its label
        order = a + np.argsort(label, kind="stable")
        _, counts = np.unique(label, return_counts=True)
        edges += _near(fp[order], node[order], counts, bits)
        ends = np.cumsum(counts)
        for z, m in zip(ends[counts > SMALL_CELL].tolist(), counts[counts > SMALL_CELL].tolist(), strict=True):
            own = np.sort(node[order[z - m : z]])
            name = int.from_bytes(xxhash.xxh3_64_digest(own.tobytes()), "big", signed=True)
            groups.append(np.stack([np.ones(m, np.int64), np.full(m, name), own], 1))
    found = np.concatenate([np.zeros((0, 2), np.int64), *edges])
    pairs = np.unique(np.stack([np.zeros(len(found), np.int64), found.min(1), found.max(1)], 1), axis=0) if len(found) else np.zeros((0, 3), np.int64)
    return np.concatenate([pairs, *groups])


def _verify(bits: int, find: Callable = _links, names: tuple[str, ...] = ("u", "v"), most: int = 0):
    """What ``find`` has in whole cells, some ``most`` rows (CELL_ROWS if 0) at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size, ready = 0, 0  # rows held, and those of them whose cell has surely ended

        def out(rows: list[tuple[np.ndarray, ...]], end: int) -> pa.RecordBatch:
            cell, fp, node = (np.concatenate(x) for x in zip(*rows, strict=True))
            held[:] = [(cell[end:], fp[end:], node[end:])] if end < len(cell) else []
            found = find(cell[:end], fp[:end].view(np.uint64), node[:end], bits)
            return pa.RecordBatch.from_arrays([pa.array(x.copy()) for x in found.T], names=list(names))

        for b in batches:
            if not b.num_rows:
                continue
            rows = tuple(column(b, c).to_numpy() for c in ("cell", "fp", "node"))
            last = int(np.searchsorted(rows[0], rows[0][-1], "left"))  # the last run may go on
            if last or (held and held[-1][0][-1] != rows[0][0]):
                ready = size + last
            held.append(rows)
            size += b.num_rows
            if ready >= (most or CELL_ROWS):
                yield out(held, ready)
                size, ready = size - ready, 0
        if size:
            yield out(held, size)

    return run


def _filed(nodes: DataFrame, width: int | None) -> DataFrame:
    """The cells of nodes (fp, node), sorted by cell in tasks of bounded length."""
    (n,) = scalars(nodes, F.count("*"))
    width = width or (2 if n < FINE_GRID else 1)
    filed = nodes.select("fp", "node").mapInArrow(_file(width), "cell long, fp long, node long")
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * (50 if width == 2 else 66) // TASK_ROWS))
    return filed.repartition(parts, "cell").sortWithinPartitions("cell", "fp")


def meetings(nodes: DataFrame, bits: int = REACH, width: int | None = None) -> DataFrame:
    """large, u and v: of nodes (fp, node; cut already) all that are within ``bits``, for an exact check to follow.

    Two nodes within ``bits`` are u and v of a row, u < v, or both v of rows that are large and
    have the same u, the name of a group. Repeats are left in.
    """
    if bits > REACH:
        raise ValueError(f"the grid meets pairs up to {REACH} bits")
    met = _filed(nodes, width).mapInArrow(_verify(bits, _meetings, ("large", "u", "v"), MEETING_ROWS), "large long, u long, v long")
    return met.select((F.col("large") == 1).alias("large"), "u", "v")


def link_components(prints: DataFrame, bits: int = MOST_BITS, width: int | None = None) -> DataFrame:
    """doc_id, fp and component_id for rows of doc_id and fp (cut already, as they are read several times).

    Equal fingerprints are one node, named by the smallest doc_id; a node's links inside a cell
    are a forest, which keeps every connection without listing all pairs. ``width`` (1 or 2) is the
    bits of a segment, by default as many as the number of fingerprints asks for; links are the same.
    """
    if bits > REACH:
        raise ValueError(f"the grid meets pairs up to {REACH} bits")
    nodes = cut(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")))
    links = _filed(nodes, width).mapInArrow(_verify(bits), "u long, v long")
    roots = components(links)
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def near_duplicates(documents: DataFrame, words: int = SHINGLE_WORDS, bits: int = MOST_BITS) -> DataFrame:
    """doc_id, fp (64 bits as a long) and component_id, the smallest doc_id that its links reach.

    A null or empty text has fingerprint zero, which links like any other. A null doc_id names no
    component: its row takes the component of an equal fingerprint, or null. Repeated rows are
    repeated. Other columns are left out; an empty table gives an empty result.
    """
    return link_components(cut(fingerprints(documents, words)), bits)


def smallest(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents whose doc_id is their component_id in ``found``, each id once; null ids pass.

    Of rows that repeat an id the one of the least hash over all columns stays.
    """
    kept_id, copy_no = fresh(documents, "kept_id", "copy")
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias(kept_id)).distinct()
    copy = Window.partitionBy(kept_id).orderBy(F.xxhash64(*documents.columns))
    one = documents.join(kept, documents["doc_id"].cast("long") == kept[kept_id]).withColumn(copy_no, F.row_number().over(copy))
    return one.where(F.col(copy_no) == 1).select(documents.columns).unionByName(documents.where("doc_id IS NULL"))


def keep_one(documents: DataFrame, words: int = SHINGLE_WORDS, bits: int = MOST_BITS) -> DataFrame:
    """The documents that are the smallest doc_id of their component, each id once; null ids pass."""
    return smallest(documents, near_duplicates(documents, words, bits))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
