"""Health, jobs, migrations and the commands that show them."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.context import Engine
from ..topology import Shard, ShardingError

HEALTH_SCHEMA = "shard_id string, healthy boolean, error string, latency_ms long, checked_at timestamp"
STATUS_SCHEMA = "shard_id string, migration string, batch int"


@dataclass(frozen=True)
class Health:
    shard: Shard
    healthy: bool
    error: str | None = None
    latency_ms: int | None = None
    checked_at: datetime = field(default_factory=lambda: datetime.now(UTC))

    def row(self) -> tuple:
        return (self.shard.id, self.healthy, self.error, self.latency_ms, self.checked_at)


class HealthChecker:
    """Probes shards with ``probe``, such as reading one row of a table."""

    def __init__(self, engine: Engine, probe: Callable[[Shard], Any]) -> None:
        self.engine, self.probe = engine, probe

    def check(self, shard: Shard | str) -> Health:
        found, began = self.engine.shard(shard), time.perf_counter()
        try:
            self.probe(found)
        except Exception as e:
            return Health(found, False, str(e))
        return Health(found, True, latency_ms=int((time.perf_counter() - began) * 1000))

    def check_all(self) -> dict[str, Health]:
        return {s.id: self.check(s) for s in self.engine.shards.active()}

    def all_healthy(self) -> bool:
        return all(h.healthy for h in self.check_all().values())

    def healthy(self) -> list[Shard]:
        return [h.shard for h in self.check_all().values() if h.healthy]

    def unhealthy(self) -> list[Shard]:
        return [h.shard for h in self.check_all().values() if not h.healthy]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([h.row() for h in self.check_all().values()], HEALTH_SCHEMA)


class ShardJob:
    """Work that remembers its shard and runs in that shard's context."""

    def __init__(self, engine: Engine, do: Callable[[], Any], shard: Shard | str | None = None) -> None:
        self.engine, self.do = engine, do
        self.shard_id = engine.shard(shard).id if shard else engine.context.current_id()

    def on_shard(self, shard: Shard | str) -> ShardJob:
        return ShardJob(self.engine, self.do, shard)

    def payload(self, key: str = "_shard_id") -> dict[str, str]:
        return {key: self.shard_id} if self.shard_id else {}

    def run(self, spark: SparkSession | None = None, shard: Shard | str | None = None) -> Any:
        """In the context of ``shard``, else of the shard remembered, else in the one that is current."""
        wanted = shard or self.shard_id
        if spark is not None and wanted:
            spark.sparkContext.setJobGroup(f"shard:{wanted if isinstance(wanted, str) else wanted.id}", "work of one shard")
        return self.engine.run(wanted, lambda _: self.do()) if wanted else self.do()


class Migrations:
    """Named steps, run once on each shard; which ran is kept as (shard, step, batch) rows, in ``log`` where given."""

    def __init__(
        self, engine: Engine, steps: Mapping[str, tuple[Callable[[Shard], Any], Callable[[Shard], Any]]], ran: list[tuple[str, str, int]] | None = None, log: StepLog | None = None
    ) -> None:
        self.engine, self.steps, self.log = engine, dict(sorted(steps.items())), log
        self.ran = list(ran) if ran is not None else log.ran() if log else []

    def ran_on(self, shard: Shard) -> list[str]:
        return [m for s, m, _ in self.ran if s == shard.id]

    def pending(self, shard: Shard) -> list[str]:
        done = set(self.ran_on(shard))
        return [m for m in self.steps if m not in done]

    def has_pending(self, shard: Shard) -> bool:
        return bool(self.pending(shard))

    def last_batch(self, shard: Shard) -> int:
        return max((b for s, _, b in self.ran if s == shard.id), default=0)

    def migrate(self, shard: Shard) -> list[str]:
        batch, todo = self.last_batch(shard) + 1, self.pending(shard)
        for m in todo:
            self.engine.run(shard, self.steps[m][0])
            self.ran.append((shard.id, m, batch))
            if self.log:
                self.log.add(shard.id, m, batch, True)
        return todo

    def rollback(self, shard: Shard, all_batches: bool = False) -> list[str]:
        last = self.last_batch(shard)
        todo = [m for s, m, b in reversed(self.ran) if s == shard.id and (all_batches or b == last)]
        for m in todo:
            self.engine.run(shard, self.steps[m][1])
            self.ran = [r for r in self.ran if r[:2] != (shard.id, m)]
            if self.log:
                self.log.add(shard.id, m, last, False)
        return todo

    def reset(self, shard: Shard) -> list[str]:
        return self.rollback(shard, all_batches=True)

    def fresh(self, shard: Shard) -> list[str]:
        self.reset(shard)
        return self.migrate(shard)

    def seed(self, shard: Shard, do: Callable[[Shard], Any]) -> Any:
        return self.engine.run(shard, do)

    def status(self, spark: SparkSession) -> DataFrame:
        """shard_id, migration, and whether it is pending, for every shard and step."""
        every = spark.createDataFrame([(s.id, m) for s in self.engine.shards for m in self.steps], "shard_id string, migration string")
        ran = spark.createDataFrame(self.ran, STATUS_SCHEMA)
        return every.join(ran, ["shard_id", "migration"], "left").select("shard_id", "migration", F.col("batch").isNull().alias("pending"), "batch")


class StepLog:
    """Which steps ran where, kept as parquet rows that are only added to: the latest row of a step counts."""

    SCHEMA = "shard_id string, migration string, batch int, ran boolean, at timestamp, row long"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException:  # nothing has run yet
            return self.spark.createDataFrame([], self.SCHEMA)

    def ran(self) -> list[tuple[str, str, int]]:
        latest = self.rows().groupBy("shard_id", "migration").agg(F.max_by(F.struct("batch", "ran"), "row").alias("x"), F.max("row").alias("row"))
        return [tuple(r) for r in latest.where("x.ran").orderBy("row").select("shard_id", "migration", "x.batch").collect()]

    def add(self, shard_id: str, migration: str, batch: int, ran: bool) -> None:
        now = datetime.now(UTC)
        self.spark.createDataFrame([(shard_id, migration, batch, ran, now, time.time_ns())], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


ACTIONS = ("migrate", "rollback", "reset", "fresh", "seed")


@dataclass(frozen=True)
class Report:
    """What a command did on each shard; the exit code is 1 if any shard failed."""

    done: dict[str, list[str]]
    failed: dict[str, str]

    @property
    def exit_code(self) -> int:
        return int(bool(self.failed))

    def json(self) -> str:
        return json.dumps({"done": self.done, "failed": self.failed, "exit_code": self.exit_code})


def on_all_shards(migrations: Migrations, action: str = "migrate", shards: Iterable[Shard | str] | None = None, seed: Callable[[Shard], Any] | None = None) -> Report:
    """Run a command on these shards, by default all active ones, one after another; a shard that fails doesn't stop the others.

    ``seed`` runs after the others' steps where given, or alone for the action of that name.
    """
    if action not in ACTIONS or (action == "seed" and seed is None):
        raise ShardingError(f"no such command: {action}")
    engine = migrations.engine
    wanted = [engine.shard(s) for s in shards] if shards is not None else list(engine.shards.active())
    done: dict[str, list[str]] = {}
    failed: dict[str, str] = {}
    for shard in wanted:
        try:
            done[shard.id] = [] if action == "seed" else getattr(migrations, action)(shard)
            if seed is not None:
                migrations.seed(shard, seed)
        except Exception as e:
            failed[shard.id] = f"{type(e).__name__}: {e}"
    return Report(done, failed)


def pending_steps(every: DataFrame, ran: DataFrame) -> DataFrame:
    """(shard_id, migration) pairs that haven't run."""
    return every.join(ran, ["shard_id", "migration"], "left_anti")


def list_shards(engine: Engine, spark: SparkSession) -> DataFrame:
    rows = [(s.id, s.name, s.connection, s.weight, s.active, s.read_only, {k: str(v) for k, v in s.metadata.items()}) for s in engine.shards]
    return spark.createDataFrame(rows, "id string, name string, connection string, weight int, active boolean, read_only boolean, metadata map<string,string>")


def make_migration(folder: str | Path, name: str, create: str | None = None, now: datetime | None = None) -> Path:
    """Write an empty step module, or one for a new table with a UUID key and time stamps."""
    stem = re.sub(r"\W+", "_", name).strip("_").lower()
    path = Path(folder) / f"{(now or datetime.now(UTC)):%Y_%m_%d_%H%M%S}_{stem}.py"
    columns = "id STRING NOT NULL, created_at TIMESTAMP, updated_at TIMESTAMP"
    up = f'spark.sql("CREATE TABLE {create} ({columns}) USING parquet")' if create else "pass"
    down = f'spark.sql("DROP TABLE IF EXISTS {create}")' if create else "pass"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(f'"""{name}"""\n\n\ndef up(spark, shard):\n    {up}\n\n\ndef down(spark, shard):\n    {down}\n')
    return path
