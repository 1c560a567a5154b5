"""Shards of near-equal bytes: size-weighted sampled splitters, range partitioning, overfull ranges subdivided.

Records are ordered by a key of their text and then by doc_id, so that equal texts stand
side by side. A size-weighted sample of the keys gives quantile boundaries; ranges that turn
out overfull are sampled again and split. The exact bytes before each range are then known
from one small table, and with a running sum inside the range every record knows the bytes
before it in the global order: its shard is that place's share of all bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, cut, scalars, table

#: Bytes that each record costs besides its text.
RECORD_BYTES = 8
#: Keys that the driver samples in a round, whatever the input's size.
SAMPLE_KEYS = 100_000
#: Records that one range should hold, and ranges at most (their totals pass through the driver).
RANGE_ROWS, MOST_RANGES = 20_000, 50_000
#: A range is overfull beyond so many times the even share; rounds of splitting.
OVERFULL, ROUNDS = 2.0, 3
#: crc32 of a text's bytes is a native function, its key the high bits of md5.
KEY_DIGITS = 15
#: Equal rows that are written out of one row at once.
COPIES = 1_000


def text_key(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, KEY_DIGITS), 16, 10).cast("long")


def place(keys: np.ndarray, ids: np.ndarray, split_keys: np.ndarray, split_ids: np.ndarray) -> np.ndarray:
    """For each (key, id) the number of splitters (sorted pairs) that are not greater."""
    low, high = np.searchsorted(split_keys, keys, "left"), np.searchsorted(split_keys, keys, "right")
    out = low.copy()
    tied = np.flatnonzero(high > low)
    if len(tied):
        order = tied[np.argsort(low[tied], kind="stable")]
        for part in np.split(order, np.flatnonzero(np.diff(low[order])) + 1):
            a, b = low[part[0]], high[part[0]]
            out[part] = a + np.searchsorted(split_ids[a:b], ids[part], "right")
    return out


def _with_range(thin: DataFrame, split_keys: np.ndarray, split_ids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spot = place(column(b, "key").to_numpy(zero_copy_only=False), column(b, "tie").to_numpy(zero_copy_only=False), split_keys, split_ids)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spot.astype(np.int64))], names=[*b.schema.names, "range"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in thin.schema)
    return thin.mapInArrow(run, f"{fields}, range long")


def _sample(thin: DataFrame, rows: int, total: int, want: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys drawn with chances in proportion to size, about ``want`` of them, sorted."""
    size = F.col("size") * F.col("copies")
    chance = F.least(F.lit(1.0), size * F.lit(want / max(total, 1)))
    draw = F.pmod(F.xxhash64("key", "tie", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    weight = F.greatest(F.lit(1.0), size * F.lit(want / max(total, 1))).cast("int")
    # Equal pairs can't be told apart by a splitter: one of each is enough.
    got = thin.where(draw < chance).groupBy("key", "tie").agg(F.sum(weight).alias("w")).toPandas().sort_values(["key", "tie"])
    return np.repeat(got["key"].to_numpy(np.int64), got["w"]), np.repeat(got["tie"].to_numpy(np.int64), got["w"])


def _quantiles(keys: np.ndarray, ids: np.ndarray, ranges: int) -> list[tuple[int, int]]:
    if not len(keys):
        return []
    spots = (np.arange(1, ranges) * len(keys)) // ranges
    return sorted(set(zip(keys[spots].tolist(), ids[spots].tolist(), strict=True)))


def shard_by_bytes(documents: DataFrame, shards: int, seed: int = 7, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: every row is in one shard, shards near equal in bytes.

    Size is the text's UTF-8 bytes (null: none) plus ``RECORD_BYTES``. Order inside and across
    shards is (text key, doc_id); a null doc_id comes first, a null text has the key of an empty
    one. Repeated rows each have a slot; rows equal in text and id travel as one with a count until
    their places are known. The shard sizes differ from the even share by less than the largest
    record. An empty table gives an empty result. Extra columns are left out.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(RECORD_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        text_key(text).alias("key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("tie"),
    )
    thin = cut(thin.groupBy(*thin.columns).agg(F.count("*").alias("copies")))
    rows, total = scalars(thin, F.count("*"), F.coalesce(F.sum(F.col("size") * F.col("copies")), F.lit(0)))
    ranges = int(min(MOST_RANGES, max(1, -(-rows // range_rows))))
    splitters = _quantiles(*_sample(thin, rows, total, min(SAMPLE_KEYS, 64 * ranges), seed), ranges) if ranges > 1 else []
    arrays = lambda: (np.array([s[0] for s in splitters], np.int64), np.array([s[1] for s in splitters], np.int64))
    for again in range(ROUNDS + 1):
        ranged = _with_range(thin, *arrays())
        held = ranged.groupBy("range").agg(F.count("*").alias("rows"), F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("records")).toPandas().sort_values("range")
        full = held[(held["rows"] > OVERFULL * range_rows) | (held["bytes"] > OVERFULL * max(total / ranges, 1))]
        if again == ROUNDS or full.empty or ranges == 1:
            break
        inside = ranged.where(F.col("range").isin([int(x) for x in full["range"]]))
        fresh = set(splitters)
        parts = int(min(MOST_RANGES, np.ceil(max(full["rows"].sum() / range_rows, full["bytes"].sum() / (total / ranges))) * 2))
        fresh |= set(_quantiles(*_sample(inside.drop("range"), int(full["rows"].sum()), int(full["bytes"].sum()), min(SAMPLE_KEYS, 64 * parts), seed + again + 1), parts))
        if len(fresh) == len(splitters):  # only pairs that repeat are left, which no boundary can part
            break
        splitters = sorted(fresh)
    before = held.assign(bytes_before=held["bytes"].cumsum() - held["bytes"], rows_before=held["records"].cumsum() - held["records"])
    offsets = spark.createDataFrame(
        [(int(r), int(b), int(n)) for r, b, n in zip(before["range"], before["bytes_before"], before["rows_before"], strict=True)],
        "range long, bytes_before long, rows_before long",
    )  # at most MOST_RANGES rows and what rounds of splitting add
    before_it = Window.partitionBy("range").orderBy("key", "tie", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    at = (
        ranged.withColumn("bytes_in", F.sum(F.col("size") * F.col("copies")).over(before_it))
        .withColumn("row_in", F.sum("copies").over(before_it))
        .join(F.broadcast(offsets), "range")
        .withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
        .withColumn("copy", F.explode(F.sequence("first", F.least(F.col("copies"), F.col("first") + COPIES) - 1)))
        .withColumn("at", F.col("bytes_before") + F.coalesce(F.col("bytes_in"), F.lit(0)) + F.col("copy") * F.col("size"))
        .withColumn("row", F.col("rows_before") + F.coalesce(F.col("row_in"), F.lit(0)) + F.col("copy"))
        # whole longs only: the middle of the record against the even share
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"((2 * at + size) * {shards}L) div {2 * max(total, 1)}L")).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", "row")
    )
    at = cut(at)
    firsts = at.groupBy("shard").agg(F.min("row").alias("first"))  # a row for each shard
    return at.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def sharding_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those columns of ``op4_sharding`` for which the database of the SQL check has functions."""
    return op4_sharding(spark, sf_dir).select("doc_id", "size", "law", "shard", "slot")


PLACES_SQL = """
WITH rows AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, CAST('0x' || md5(coalesce(text, ''))[1:15] AS BIGINT) AS key
  FROM documents),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS begins,
         row_number() OVER (ORDER BY key, doc_id NULLS FIRST) AS n, sum(size) OVER () AS total
  FROM rows),
dealt AS (SELECT *, least(23, ((2 * begins + size) * 24) // (2 * total)) AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(n - min(n) OVER (PARTITION BY shard) AS BIGINT) AS slot
FROM dealt
"""
