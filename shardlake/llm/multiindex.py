"""Nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by a codebook of its own; a pair of centroids is a cell. A
query walks the cells in the order of the summed distance of its halves to the pair's centroids,
with a heap over the rows of pairs, until the cells hold enough candidates; those are ranked by
the exact measure. The measure is the inner product, so a half's distance is its negative. How
many candidates are enough is measured: some queries are answered exactly first, and the walk
goes as deep as their true neighbours lie.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, cut, table

#: Centroids of a half for each square root of the vectors, and at most (their pairs' counts pass through the driver).
CENTROIDS_ROOT, MOST_CENTROIDS = 1.0, 1_024
#: Vectors that the codebooks are fitted on at most; rounds of fitting.
FIT_ROWS, FIT_ROUNDS, SEED = 20_000, 12, 5
#: Recall that a walk aims at; queries that are answered exactly to find how deep it must go; room on top of that.
RECALL, PROBES, ROOM = 0.93, 128, 1.05
#: Steps of summed distance in which a walk takes its cells.
STEPS = 32
#: Vectors and queries of one ranking group; queries that it ranks at once; tasks for the groups at most.
BLOCK_ROWS, TASK_QUERIES, QUERY_ROWS, MOST_TASKS = 4_096, 2_048, 256, 20_000


@dataclass
class Codebooks:
    first: np.ndarray
    second: np.ndarray

    @property
    def half(self) -> int:
        return self.first.shape[1]

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def assign(self, x: np.ndarray) -> np.ndarray:
        near = lambda y, c: np.argmin((c * c).sum(1) - 2 * (y @ c.T), axis=1)
        return near(x[:, : self.half], self.first) * len(self.second) + near(x[:, self.half :], self.second)

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of the halves of each row of q to both codebooks."""
        return -(q[:, : self.half] @ self.first.T), -(q[:, self.half :] @ self.second.T)

    def walk(self, q: np.ndarray, counts: np.ndarray, want: int, steps: int = STEPS) -> tuple[float, np.ndarray]:
        """The summed distance below which cells hold ``want`` vectors, and those of these cells that aren't empty.

        The heap has a row of pairs for each centroid of the first half that was come to, by the sum of
        its next pair. Rows whose sum lies in the present step leave it together, each with its run of
        pairs up to the step's end, and come back with their next pair; a walk ends where a step does.
        """
        (a,), (b,) = self.distances(q[None])
        order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b = a[order_a], b[order_b]
        rows, first, n, m = a.tolist(), float(b[0]), len(a), len(b)
        held = counts.reshape(n, m)[np.ix_(order_a, order_b)]
        before = np.c_[np.zeros(n, np.int64), np.cumsum(held, axis=1)]
        ends, have, low = np.zeros(n, np.int64), 0, rows[0] + first
        step = max((rows[-1] - rows[0] + float(b[-1]) - first) / steps, math.ulp(low))
        heap, level = [(low, 0)], low
        while heap and have < want:
            level = max(low + (math.floor((heap[0][0] - low) / step) + 1) * step, math.nextafter(heap[0][0], math.inf))
            left: list[int] = []
            while heap and heap[0][0] < level:
                _, i = heapq.heappop(heap)
                left.append(i)
                if not ends[i] and i + 1 < n:  # a row's first pair lets the next row in
                    heapq.heappush(heap, (rows[i + 1] + first, i + 1))
            end = np.maximum(ends[left] + 1, np.searchsorted(b, level - a[left]))
            have += int((before[left, end] - before[left, ends[left]]).sum())
            ends[left] = end
            for i, j in zip(left, end.tolist(), strict=True):
                if j < m:
                    heapq.heappush(heap, (rows[i] + float(b[j]), i))
        i, j = np.nonzero((np.arange(m) < ends[:, None]) & (held > 0))
        return level if heap else math.inf, order_a[i] * m + order_b[j]


def _centroids(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    c = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)].copy()
    for _ in range(FIT_ROUNDS):
        near = np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)
        sums, sizes = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return c


def fit(sample: np.ndarray, centroids: int, seed: int = SEED) -> Codebooks:
    rng = np.random.default_rng(seed)
    half = (sample.shape[1] + 1) // 2
    return Codebooks(_centroids(sample[:, :half], centroids, rng), _centroids(sample[:, half:], centroids, rng) if sample.shape[1] > half else np.zeros((1, 0)))


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and vec (array of double) of the rows that take part."""
    v = F.col("vec")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0.0))


def _placed(books: Codebooks, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = column(b, "vec")
            cell = books.assign(_matrix(vec, dims)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([column(b, "row"), column(b, "vec_id"), vec, pa.array(cell.astype(np.int64))], names=["row", "vec_id", "vec", "cell"])

    return run


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of q (a vector, or one for each row of v) with the rows of v, each summed from the first component to the last."""
    out = np.zeros(len(v))
    for k in range(v.shape[1]):
        out += q[..., k] * v[:, k]
    return out


def _nearest_cells(rows: np.ndarray, q: np.ndarray, dims: int, nearest: int):
    """Of each task's vectors the ``nearest`` of each query, by exact search: query, score and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, cell = np.full((len(q), nearest), -np.inf), np.zeros((len(q), nearest), np.int64)
        for whole in batches:
            for b in (whole.slice(i, BLOCK_ROWS) for i in range(0, whole.num_rows, BLOCK_ROWS)):
                s = q @ _matrix(column(b, "vec"), dims).T
                s[rows[:, None] == column(b, "row").to_numpy()[None, :]] = -np.inf
                s, c = np.c_[score, s], np.c_[cell, np.broadcast_to(column(b, "cell").to_numpy(), (len(q), b.num_rows))]
                best = np.argpartition(-s, nearest - 1, axis=1)[:, :nearest]
                score, cell = np.take_along_axis(s, best, 1), np.take_along_axis(c, best, 1)
        at, k = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(score[at, k]), pa.array(cell[at, k])], names=["probe", "score", "cell"])

    return run


def _depth(placed: DataFrame, queries: DataFrame, books: Codebooks, counts: np.ndarray, dims: int, nearest: int, recall: float) -> int:
    """How many candidates a walk must gather so that ``recall`` of the true neighbours are among them.

    Found on ``PROBES`` queries, those of lowest hashed row, which are answered exactly over all vectors.
    """
    n = int(counts.sum())
    if recall >= 1:
        return n
    probes = queries.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "row").limit(PROBES).select("row", "vec").toPandas()
    if not len(probes):
        return 1
    rows, q = probes["row"].to_numpy(np.int64), np.stack(probes["vec"].to_numpy()).astype(np.float64)
    near = placed.mapInArrow(_nearest_cells(rows, q, dims, nearest), "probe long, score double, cell long")
    by = Window.partitionBy("probe").orderBy(F.desc("score"), "cell")
    found = near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= nearest).select("probe", "cell").toPandas()
    held, depths = np.flatnonzero(counts), []
    a, b = books.distances(q)
    for probe, cells in found.groupby("probe")["cell"]:
        sums = a[probe][held // len(books.second)] + b[probe][held % len(books.second)]
        order = np.argsort(sums, kind="stable")
        before = np.cumsum(counts[held][order])
        of = np.searchsorted(sums[order], sums[np.searchsorted(held, cells.to_numpy())], "right") - 1
        depths.append(before[of])
    return min(n, int(ROOM * np.quantile(np.concatenate(depths), recall)) + nearest) if depths else 1


_WALKED = pa.schema([("block", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("vec", pa.list_(pa.float64())), ("level", pa.float64())])


def _walked(books: Codebooks, dims: int, counts: np.ndarray, first: np.ndarray, parts: np.ndarray, want: int):
    """A row for each query and block that holds some of its cells, with the sum that its cells stay below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, QUERY_ROWS) for i in range(0, whole.num_rows, QUERY_ROWS)):
                blocks, of, levels = [], [], []
                for i, q in enumerate(_matrix(column(b, "vec"), dims)):
                    level, cells = books.walk(q, counts, want)
                    split = parts[cells] > 1
                    own = np.unique(first[cells[~split]])
                    own = np.unique(np.concatenate([own, *(np.arange(first[c], first[c] + parts[c]) for c in cells[split])]))
                    blocks.append(own), of.append(np.full(len(own), i)), levels.append(np.full(len(own), level))
                at = pa.array(np.concatenate(of) if of else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(blocks).astype(np.int64) if blocks else np.zeros(0, np.int64)), *(column(b, c).take(at) for c in ("row", "vec_id", "vec")), pa.array(np.concatenate(levels) if levels else np.zeros(0))],
                    schema=_WALKED,
                )

    return run


def _block_of(first: np.ndarray, parts: np.ndarray):
    """Vectors with the block that they stand in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, row = column(b, "cell").to_numpy(), column(b, "row").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(first[cell] + (row * 2654435761 >> 7) % parts[cell]), *b.columns], names=["block", *b.schema.names])

    return run


def _best(books: Codebooks, held: tuple[np.ndarray, ...], rows: np.ndarray, q: np.ndarray, levels: np.ndarray, nearest: int) -> tuple[np.ndarray, ...]:
    """For each query the nearest of the held vectors whose cells lie below its level: query, row, id and score."""
    own, ids, v, cell = held
    a, b = books.distances(q)
    scores = q @ v.T
    first, second = np.divmod(cell, len(books.second))
    scores[(a[:, first] + b[:, second] >= levels[:, None]) | (rows[:, None] == own[None, :])] = -np.inf
    # Whatever may be among the nearest after exact summing, ties included.
    slack = 1e-12 * v.shape[1] * np.sqrt((v * v).sum(1).max()) * np.sqrt((q * q).sum(1))
    level = np.partition(scores, len(v) - nearest, axis=1)[:, len(v) - nearest] - slack if len(v) > nearest else np.full(len(q), -np.inf)
    at, near = np.nonzero((scores >= level[:, None]) & (scores > -np.inf))
    exact = np.concatenate([np.zeros(0), *(products(q[at[i : i + BLOCK_ROWS]], v[near[i : i + BLOCK_ROWS]]) for i in range(0, len(at), BLOCK_ROWS))])
    order = np.lexsort((own[near], ids[near], -exact, at))
    at, near, exact = at[order], near[order], exact[order]
    best = np.arange(len(at)) - np.searchsorted(at, at) < nearest
    return at[best], own[near[best]], ids[near[best]], exact[best]


def _ranked(books: Codebooks, dims: int, nearest: int):
    """Rows come sorted by group, a group's vectors before its queries; one group's vectors are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, held = None, [], None
        for whole in batches:
            marks = np.stack([column(whole, c).to_numpy() for c in ("block", "part", "kind")])
            starts = np.flatnonzero(np.r_[True, (marks[:, 1:] != marks[:, :-1]).any(0)]) if whole.num_rows else []
            for i, z in zip(starts, [*starts[1:], whole.num_rows], strict=True):
                b, now = whole.slice(i, z - i), (marks[0, i], marks[1, i])
                if now != group:
                    group, parts, held = now, [], None
                if marks[2, i] == 0:
                    parts.append((column(b, "row").to_numpy(), column(b, "vec_id").to_numpy(), _matrix(column(b, "vec"), dims), column(b, "cell").to_numpy()))
                    continue
                if not parts:
                    continue
                held = held or tuple(np.concatenate(x) for x in zip(*parts, strict=True))
                for k in range(0, b.num_rows, QUERY_ROWS):
                    c = b.slice(k, QUERY_ROWS)
                    rows = column(c, "row").to_numpy()
                    found = _best(books, held, rows, _matrix(column(c, "vec"), dims), column(c, "level").to_numpy(), nearest)
                    at = pa.array(found[0])
                    yield pa.RecordBatch.from_arrays(
                        [column(c, "row").take(at), column(c, "vec_id").take(at), *map(pa.array, found[1:])], names=["row", "query_id", "other", "vec_id", "score"]
                    )

    return run


_SCHEMA = "query_id long, rank int, vec_id long, score double"


def _search(rows: DataFrame, dims: int, n: int, nearest: int, is_query: Column, recall: float, centroids_root: float, block_rows: int, task_queries: int) -> DataFrame:
    """The search among vectors of one length."""
    chance = F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 30)) < F.lit(int(min(1.0, FIT_ROWS / n) * (1 << 30)))
    sample = rows.where(chance).orderBy("vec_id", "vec").limit(2 * FIT_ROWS).select("vec").toPandas()["vec"]
    if not len(sample):
        sample = rows.orderBy("vec_id", "vec").limit(FIT_ROWS).select("vec").toPandas()["vec"]
    books = fit(np.stack(sample.to_numpy()).astype(np.float64), min(MOST_CENTROIDS, math.ceil(centroids_root * math.sqrt(n))))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())  # fixed by the cut
    placed = cut(numbered.mapInArrow(_placed(books, dims), "row long, vec_id long, vec array<double>, cell long"))
    counts = np.zeros(books.cells, np.int64)
    in_cells = placed.groupBy("cell").count().toPandas()  # a row for each pair of centroids at most
    counts[in_cells["cell"]] = in_cells["count"]
    queries = placed.where(is_query)
    want = _depth(placed, queries, books, counts, dims, nearest, recall)
    # Cells side by side share a block; one that is larger than a block is dealt to several.
    parts = np.maximum(1, -(-counts // block_rows))
    first, block, filled = np.zeros(books.cells, np.int64), 0, 0
    for cell in np.flatnonzero(counts).tolist():
        if filled and filled + counts[cell] > block_rows:
            block, filled = block + 1, 0
        first[cell] = block
        if parts[cell] > 1:
            block += int(parts[cell])
        else:
            filled += int(counts[cell])
    # A block that many queries come to is copied for each part of them.
    walked = cut(queries.mapInArrow(_walked(books, dims, counts, first, parts, want), "block long, row long, vec_id long, vec array<double>, level double"))
    come = walked.groupBy("block").count().toPandas()  # a row for each block
    many = np.zeros(block + 1, np.int64)
    many[come["block"]] = -(-come["count"].to_numpy() // task_queries)
    salts = F.broadcast(rows.sparkSession.createDataFrame([(int(x), int(many[x])) for x in np.flatnonzero(many)], "block long, salts long"))
    dealt = placed.mapInArrow(_block_of(first, parts), "block long, row long, vec_id long, vec array<double>, cell long").join(salts, "block")
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    asked = walked.join(salts, "block").withColumn("part", F.pmod(F.xxhash64("row"), F.col("salts")))
    both = dealt.select("block", "part", F.lit(0).alias("kind"), "row", "vec_id", "vec", "cell", F.lit(0.0).alias("level")).union(
        asked.select("block", "part", F.lit(1).alias("kind"), "row", "vec_id", "vec", F.lit(0).cast("long").alias("cell"), "level")
    )
    tasks = max(1, min(MOST_TASKS, int(many.sum())))
    near = both.repartition(tasks, "block", "part").sortWithinPartitions("block", "part", "kind").mapInArrow(_ranked(books, dims, nearest), "row long, query_id long, other long, vec_id long, score double")
    by = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "other")
    return near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def search(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", nearest: int = 20, every: int = 20, recall: float = RECALL,
    centroids_root: float = CENTROIDS_ROOT, block_rows: int = BLOCK_ROWS, task_queries: int = TASK_QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id and score: the nearest of each row whose id ``every`` divides, itself left out.

    Every row is indexed; the codebooks are fitted on about ``FIT_ROWS`` of them at most, those of
    lowest hashed id. A walk gathers as many candidates as measured queries needed for ``recall``;
    with a recall of 1 it goes through all cells, which is exact search. Null, all-zero and non-finite
    vectors and null ids take no part. The inner product needs vectors of one length, so those of
    each length are searched among themselves. Rows that repeat an id are queries and candidates of
    their own. Ties go to the smaller id. Other columns are left out; an empty table gives an empty result.
    """
    rows = usable(vectors, vec_id, vector)
    sizes = rows.groupBy(F.size("vec").alias("dims")).count().orderBy("dims").collect()  # a row for each length
    found = vectors.sparkSession.createDataFrame([], _SCHEMA)
    for dims, n in sizes:
        found = found.union(_search(rows.where(F.size("vec") == dims), dims, n, nearest, F.col("vec_id") % every == 0, recall, centroids_root, block_rows, task_queries))
    return found


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


def neighbours_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same index, walked through all of its cells: what the SQL of exact search must equal."""
    return search(table(spark, sf_dir, "embeddings"), recall=1.0)


EXACT_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
"""
