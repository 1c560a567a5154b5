"""Mixing sources to target weights in fixed-length blocks of words.

Each source's words are packed into blocks. Output shards draw how many blocks each source gives
them, a multinomial draw each; what a source drew beyond its total in the last shards goes, there,
to sources that drew less than theirs, so that totals meet their targets to within a block. Every
slot is mapped to a block through the source's pseudorandom permutation of block indices (a fresh
one each time the source begins again), and slots meet blocks by index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import OUT_ROWS, column, cut, fresh, schema_of, table

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
BLOCK_WORDS = 64
#: Blocks that an output shard should have.
SHARD_BLOCKS = 16_384
#: Documents that one packing group should have; equal rows that travel together.
BUCKET_ROWS, COPIES = 2_000, 1_000
#: Slots that one order of the mix makes; tasks for those at most.
TASK_SLOTS, MOST_TASKS = 16_384, 20_000
#: Tables of sources up to this size are broadcast, larger ones joined.
SENT_BYTES = 8 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def count_words(raw: bytes) -> int:
    if not raw:
        return 0
    blank = _BLANK[np.frombuffer(raw, np.uint8)]
    return int(not blank[0]) + int(np.count_nonzero(blank[:-1] & ~blank[1:]))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [count_words(x.as_buffer()) if x.is_valid else 0 for x in column(b, "text")]
        keep = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(column(b, c) for c in keep), pa.array(words, pa.int64())], names=[*keep, "size"])


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: float = MOST_EPOCHS) -> list[float]:
    """Share all sizes by weight; what passes ``most`` times a source's size is shared anew among the others."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, left, active = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while active:
        rate = left / sum(w[i] for i in active)
        over = {i for i in active if rate * w[i] > most * sizes[i]}
        for i in over or active:
            out[i] = float(most * sizes[i]) if over else rate * w[i]
        left -= sum(out[i] for i in over)
        active -= over or active
    return out


def _round_mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0 to n - 1, chosen by ``seed``: a Feistel network that walks on until it is inside."""
    if n <= 1:
        return np.zeros(len(index), np.int64)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [int(k) for k in np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 62, 4)]
    x = index.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> shift, x[todo] & mask
        for k in keys:
            left, right = right, left ^ (_round_mix(right, k) & mask)
        x[todo] = left << shift | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def _seed(*parts: int) -> int:
    return int(np.random.SeedSequence(parts).generate_state(1, np.uint64)[0] >> np.uint64(1))


@dataclass
class Source:
    name: str | None
    number: int
    size: int
    target: float
    blocks: int
    draws: int


@dataclass
class Mix:
    """rows: doc_id, source_no, text_hash, size and how many copies; segments: the words of a copy in a block; slots: block of each slot."""

    rows: DataFrame
    sources: list[Source]
    segments: DataFrame
    slots: DataFrame


def _sources(found: list[tuple[str | None, int]], weights: tuple[int, ...], most: int, block_words: int) -> list[Source]:
    found = sorted(found, key=lambda s: (s[0] is None, s[0] or ""))  # by code point, null last
    out = []
    for i, ((name, size), target) in enumerate(zip(found, targets([s for _, s in found], weights, most), strict=True)):
        blocks = -(-size // block_words)
        draws = min(most * blocks, round(target * blocks / size)) if size else 0
        out.append(Source(name, i, size, target, blocks, draws))
    return out


def _filled(total: int, shards: int, shard: int) -> int:
    return total * (shard + 1) // shards - total * shard // shards


def _drawn(draws: np.ndarray, shards: int, seed: int):
    """For each shard's number a row for each source that it draws blocks of."""
    total = int(draws.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in column(b, "shard").to_pylist():
                counts = np.random.Generator(np.random.PCG64(_seed(seed, shard))).multinomial(_filled(total, shards, shard), draws / total)
                of = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), shard)), pa.array(of.astype(np.int32)), pa.array(counts[of])], names=["shard", "source_no", "count"])

    return run


def settle(shard: np.ndarray, source: np.ndarray, count: np.ndarray, first: np.ndarray, draws: np.ndarray, drawn: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(shard, source, first, count) after sources have given up what they drew beyond their totals.

    Surplus draws are counted through all sources, missing ones too; the k-th surplus draw becomes the
    k-th missing one, in the shard that it was drawn in. ``first`` is what the source drew in earlier shards.
    """
    surplus, missing = np.maximum(drawn - draws, 0), np.maximum(draws - drawn, 0)
    before, ends = np.cumsum(surplus) - surplus, np.cumsum(missing)
    kept = np.clip(draws[source] - first, 0, count)
    out = [x for x in zip(shard.tolist(), source.tolist(), first.tolist(), kept.tolist(), strict=True) if x[3]]
    for i in np.flatnonzero(kept < count).tolist():
        s = source[i]
        at, left = int(before[s] + max(first[i], draws[s]) - draws[s]), int(count[i] - kept[i])
        while left:
            to = int(np.searchsorted(ends, at, "right"))
            n = min(left, int(ends[to]) - at)
            out.append((int(shard[i]), to, int(drawn[to] + at - (ends[to] - missing[to])), n))
            at, left = at + n, left - n
    return out


_ORDER = pa.schema([("shard", pa.int64()), ("source_no", pa.int32()), ("first", pa.int64()), ("count", pa.int64())])


def _settled(draws: np.ndarray, drawn: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = settle(*(column(b, c).to_numpy() for c in ("shard", "source_no", "count", "first")), draws, drawn)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ORDER)], schema=_ORDER)

    return run


def _orders(spark: SparkSession, sources: list[Source], seed: int) -> DataFrame:
    """shard, source_no, first, count, place and filled: how many draws of which source stand where in which shard."""
    draws = np.array([s.draws for s in sources], np.int64)
    total = int(draws.sum())
    shards = max(1, -(-total // SHARD_BLOCKS))
    if not total:
        return spark.createDataFrame([], "shard long, source_no int, first long, count long, place long, filled long")
    drawn = np.zeros(len(sources), np.int64)
    counts = cut(spark.range(shards).toDF("shard").mapInArrow(_drawn(draws, shards, seed), "shard long, source_no int, count long"))
    sums = counts.groupBy("source_no").agg(F.sum("count").alias("drawn")).toPandas()  # a row for each source
    drawn[sums["source_no"]] = sums["drawn"]
    earlier = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    settled = counts.withColumn("first", F.coalesce(F.sum("count").over(earlier), F.lit(0))).mapInArrow(_settled(draws, drawn), "shard long, source_no int, first long, count long")
    ahead = Window.partitionBy("shard").orderBy("source_no", "first").rowsBetween(Window.unboundedPreceding, -1)
    return settled.withColumn("place", F.coalesce(F.sum("count").over(ahead), F.lit(0))).withColumn("filled", F.expr(f"{total} * (shard + 1) div {shards} - {total} * shard div {shards}"))


def _slot_rows(blocks: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, source, first, count, place, filled in zip(*(column(b, c).to_pylist() for c in ("shard", "source_no", "first", "count", "place", "filled")), strict=True):
                n = int(blocks[source])
                draws = np.arange(first, first + count, dtype=np.int64)
                epoch = draws // n
                block = np.empty(count, np.int64)
                for e in np.unique(epoch).tolist():
                    at = epoch == e
                    block[at] = permute(draws[at] % n, n, _seed(seed, source, e))
                slot = permute(np.arange(place, place + count), filled, _seed(seed, 1 << 40, shard))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(count, shard)), pa.array(slot), pa.array(np.full(count, source), pa.int32()), pa.array(block), pa.array(epoch)],
                    names=["shard", "slot", "source_no", "block", "epoch"],
                )

    return run


def _by_number(spark: SparkSession, sources: list[Source], rows: list[tuple], schema: str) -> DataFrame:
    """A table with a row for each source, broadcast where it is small."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if sum(64 + len(s.name or "") for s in sources) <= SENT_BYTES else df


def _each_copy(rows: DataFrame) -> DataFrame:
    """A row for each of the copies from ``first_copy`` on that travel together."""
    last = F.least(F.col("copies"), F.col("first_copy") + COPIES) - 1
    return rows.withColumn("copy", F.explode(F.sequence("first_copy", last)))


def mix_sources(
    documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, block_words: int = BLOCK_WORDS, seed: int = 11
) -> Mix:
    """Plan a mix of all ``documents``: which word ranges stand in which slot of which shard.

    Words are runs of anything but blanks and \\x09-\\x0D; a null or empty text has none and takes
    no part, but stays in ``rows``. Sources are ordered by code point with null last; the driver holds
    a name and a few numbers of each. Repeated rows are documents of their own, told apart by a copy
    number. An empty table gives an empty mix. Other columns are left out. The same input gives the same mix.
    """
    spark = documents.sparkSession
    thin = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_sizes, "doc_id long, source string, text_hash long, size long")
    rows = cut(thin.groupBy("source", "doc_id", "text_hash", "size").agg(F.count("*").alias("copies")))
    found = [(r[0], int(r[1]), int(r[2])) for r in rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")), F.sum("copies")).collect()]
    sources = _sources([(name, size) for name, size, _ in found], weights, most, block_words)
    numbers = _by_number(spark, sources, [(s.name, s.number) for s in sources], "name string, source_no int")
    rows = rows.join(numbers, rows["source"].eqNullSafe(numbers["name"])).drop("name", "source")
    buckets = max(1, -(-sum(n for _, _, n in found) // BUCKET_ROWS))
    first_copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long")))
    bucket = F.pmod(F.xxhash64("doc_id", "text_hash", "first_copy", F.lit(seed)), F.lit(buckets))
    together = rows.where("size > 0").withColumn("first_copy", first_copy).withColumn("bucket", bucket)
    # Words before a document in its source: those of earlier buckets, then those before it in its bucket.
    held = together.groupBy("source_no", "bucket").agg(F.sum(F.col("size") * F.least(F.lit(COPIES), F.col("copies") - F.col("first_copy"))).alias("words"))
    earlier = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("source_no", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "text_hash", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        _each_copy(together.repartition("source_no", "bucket"))
        .withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(held, ["source_no", "bucket"])
        .withColumn("at", F.col("base") + F.col("before"))
    )
    block = F.explode(F.sequence(F.expr(f"at div {block_words}"), F.expr(f"(at + size - 1) div {block_words}")))
    start = F.greatest(F.col("at"), F.col("block") * block_words)
    segments = (
        placed.withColumn("block", block)
        .withColumn("first_word", start - F.col("at"))
        .withColumn("words", F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words) - start)
        .select("source_no", "block", "doc_id", "text_hash", "copy", "first_word", "words")
    )
    # A shard's draws of a source are cut into orders of bounded size.
    skip = F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(TASK_SLOTS).cast("long")))
    orders = _orders(spark, sources, _seed(seed)).withColumn("skip", skip).select(
        "shard", "source_no", (F.col("first") + F.col("skip")).alias("first"), F.least(F.lit(TASK_SLOTS), F.col("count") - F.col("skip")).alias("count"), (F.col("place") + F.col("skip")).alias("place"), "filled"
    )
    tasks = max(1, min(MOST_TASKS, -(-sum(s.draws for s in sources) // (4 * TASK_SLOTS))))
    slots = orders.repartition(tasks, "shard", "source_no", "first").mapInArrow(
        _slot_rows(np.array([s.blocks for s in sources], np.int64), seed), "shard long, slot long, source_no int, block long, epoch long"
    )
    return Mix(rows, sources, segments, slots)


def _large(df: DataFrame) -> DataFrame:
    """Slots come from a few work orders, from which the optimiser takes them for few: they mustn't be broadcast."""
    return df.hint("merge")


def taken_words(mix: Mix) -> DataFrame:
    """source_no, doc_id, text_hash, copy and how many of that document's words the mix takes, repeats counted."""
    times = mix.slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    return mix.segments.join(_large(times), ["source_no", "block"]).groupBy("source_no", "doc_id", "text_hash", "copy").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))


def _ranges(raw: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The words of these (first, number) ranges, with what stands between them; ranges joined by a blank."""
    blank = _BLANK[np.frombuffer(raw, np.uint8)]
    starts, ends = np.flatnonzero(~blank & np.r_[True, blank[:-1]]), np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
    return b" ".join(raw[starts[a] : ends[a + n - 1]] for a, n in ranges)


def mixed_documents(documents: DataFrame, mix: Mix) -> DataFrame:
    """The mix as documents: for each document and epoch a row whose text is the words that the epoch takes.

    Where an epoch takes the whole document, the text is unchanged; else the taken ranges are
    joined by a blank. Columns are those of ``documents``, n_chars (if there) set anew. Of rows
    equal in doc_id, source and text, the one of the least hash over all columns stands for all.
    """
    names = documents.columns
    schema = schema_of(documents, set(), "")
    by_no, by_name, by_id, by_hash, copy_no, epochs = fresh(documents, "source_no", "name", "mix_id", "text_hash", "copy", "epochs")
    pieces = (
        mix.segments.join(_large(mix.slots), ["source_no", "block"])
        .groupBy("doc_id", "text_hash", "source_no", "copy", "epoch")
        .agg(F.sort_array(F.collect_list(F.struct("first_word", "words"))).alias("pieces"))
        .groupBy("doc_id", "text_hash", "source_no")
        .agg(F.sort_array(F.collect_list(F.struct("epoch", "copy", "pieces"))).alias(epochs))
        .select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), F.col("source_no").alias("of_no"), epochs)
    )
    numbers = _by_number(documents.sparkSession, mix.sources, [(s.name, s.number) for s in mix.sources], f"{by_name} string, {by_no} int")
    same = Window.partitionBy(by_id, by_hash, by_no).orderBy(F.xxhash64(*names))
    one = (
        documents.join(numbers, documents["source"].eqNullSafe(numbers[by_name]))
        .withColumns({by_id: F.col("doc_id").cast("long"), by_hash: F.xxhash64("text")})
        .withColumn(copy_no, F.row_number().over(same))
        .where(F.col(copy_no) == 1)
    )
    pieces = _large(pieces)
    both = one.join(pieces, one[by_id].eqNullSafe(pieces["of_id"]) & (one[by_hash] == pieces["of_hash"]) & (one[by_no] == pieces["of_no"])).select(*(one[c] for c in names), pieces[epochs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, OUT_ROWS // 16) for i in range(0, whole.num_rows, OUT_ROWS // 16)):
                take, texts = [], []
                for i, (text, of) in enumerate(zip(column(b, "text"), column(b, epochs), strict=True)):
                    raw = text.as_buffer().to_pybytes()
                    size = count_words(raw)
                    for e in of.as_py():
                        ranges = [(p["first_word"], p["words"]) for p in e["pieces"]]
                        take.append(i)
                        texts.append(raw if sum(n for _, n in ranges) == size else _ranges(raw, ranges))
                out = b.take(pa.array(take, pa.int32()))
                text = pa.array(texts, pa.binary()).cast(pa.string())
                own = {"text": text, "n_chars": pc.utf8_length(text)}
                yield pa.RecordBatch.from_arrays([own[n].cast(column(out, n).type) if n in own else column(out, n) for n in names], names=names)

    return both.mapInArrow(run, schema)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(table(spark, sf_dir, "documents"))
    of_source = _by_number(spark, mix.sources, [(s.number, s.size, s.target) for s in mix.sources], "source_no int, source_size long, target double")
    first_copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long")))
    rows = _each_copy(mix.rows.withColumn("first_copy", first_copy))
    taken = taken_words(mix).hint("merge")
    same = (rows["source_no"] == taken["source_no"]) & rows["doc_id"].eqNullSafe(taken["doc_id"]) & (rows["text_hash"] == taken["text_hash"]) & (rows["copy"] == taken["copy"])
    each = rows.join(taken, same, "left").select(rows["source_no"], rows["doc_id"], "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    return each.join(of_source, "source_no").select("doc_id", "size", "source_size", "target", "taken")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of the sources that ``op9_mixing`` mixes."""
    mix = mix_sources(table(spark, sf_dir, "documents"))
    return spark.createDataFrame([(s.name, s.size, s.target) for s in mix.sources], "source string, source_size long, target double")


TARGETS_SQL = r"""
WITH words AS (
  SELECT source, CAST(sum(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)) AS BIGINT) AS size
  FROM documents GROUP BY source),
weighted AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM words),
ranked AS (
  SELECT *, row_number() OVER w AS n, sum(size) OVER w - size AS full_size, sum(weight) OVER w - weight AS full_weight,
         sum(size) OVER () AS total, sum(weight) OVER () AS weights
  FROM weighted WINDOW w AS (ORDER BY size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
rates AS (
  SELECT *, CAST(total - 3 * full_size AS DOUBLE) / (weights - full_weight) AS rate FROM ranked),
level AS (
  SELECT rate FROM rates WHERE rate * weight <= 3 * size ORDER BY n LIMIT 1)
SELECT source, size AS source_size, CASE WHEN rate * weight > 3 * size THEN CAST(3 * size AS DOUBLE) ELSE rate * weight END AS target
FROM weighted, level
"""
