"""Counts and times of queries by shard, and what stands out: on the driver and over query logs."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ShardMetrics:
    def __init__(self) -> None:
        self.enabled = True
        self.reset()

    def reset(self) -> None:
        self.counts: Counter[str] = Counter()
        self.total_ms: Counter[str] = Counter()
        self.cross_shard = 0

    def record_query(self, shard_id: str, ms: float) -> None:
        if self.enabled:
            self.counts[shard_id] += 1
            self.total_ms[shard_id] += ms

    def record_cross_shard(self) -> None:
        if self.enabled:
            self.cross_shard += 1

    def average_ms(self, shard_id: str) -> float:
        return self.total_ms[shard_id] / self.counts[shard_id] if self.counts[shard_id] else 0.0

    def total_queries(self) -> int:
        return sum(self.counts.values())

    def hotspots(self, threshold: float = 2.0) -> dict[str, float]:
        """Shards with at least ``threshold`` times the mean count of the shards that were queried."""
        mean = self.total_queries() / len(self.counts) if self.counts else 0
        found = {s: round(n / mean, 2) for s, n in self.counts.items() if mean and n / mean >= threshold}
        return dict(sorted(found.items(), key=lambda x: -x[1]))

    def slow_shards(self, threshold_ms: float = 100.0) -> dict[str, float]:
        found = {s: round(self.average_ms(s), 2) for s in self.counts if self.average_ms(s) >= threshold_ms}
        return dict(sorted(found.items(), key=lambda x: -x[1]))

    def summary(self) -> dict:
        by_shard = {s: {"queries": n, "total_ms": self.total_ms[s], "average_ms": self.average_ms(s)} for s, n in self.counts.items()}
        return {"total_queries": self.total_queries(), "cross_shard_queries": self.cross_shard, "shards": by_shard, "hotspots": self.hotspots(), "slow": self.slow_shards()}


def hotspots(logged: DataFrame, shard: str = "_shard_id", threshold: float = 2.0) -> DataFrame:
    """shard_id, queries and ratio to the mean of the shards in a query log, where at least ``threshold``."""
    counts = logged.groupBy(F.col(shard).alias("shard_id")).agg(F.count("*").alias("queries"))
    mean = counts.agg(F.avg("queries").alias("mean"))  # one row
    found = counts.crossJoin(F.broadcast(mean)).withColumn("share", F.col("queries") / F.col("mean"))
    return found.where(F.col("share") >= threshold).select("shard_id", "queries", F.round("share", 2).alias("ratio")).orderBy(F.desc("ratio"), "shard_id")


def slow_shards(logged: DataFrame, ms: str, shard: str = "_shard_id", threshold_ms: float = 100.0) -> DataFrame:
    """shard_id and average_ms of a query log, where at least ``threshold_ms``."""
    found = logged.groupBy(F.col(shard).alias("shard_id")).agg(F.avg(ms).alias("mean")).where(F.col("mean") >= threshold_ms)
    return found.select("shard_id", F.round("mean", 2).alias("average_ms")).orderBy(F.desc("average_ms"), "shard_id")
