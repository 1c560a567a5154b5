"""Sharded tables as single DataFrames tagged with _shard_id, and central tables."""

from __future__ import annotations

import functools
import logging
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from ..functions.uuid7 import UUID_PATTERN, decoded_shard, looks_like_uuid
from ..plans.context import Engine
from ..topology import PoolExhausted, Shard, ShardingError, ShardSet

SHARD = "_shard_id"
#: Bytes of rows that a bucket of a saved table should hold; buckets at least and at most (Spark allows 100,000).
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 64 << 20, 8, 1 << 16
log = logging.getLogger(__name__)


class ShardedTable:
    """One logical table over shards.

    Rows come from one frame whose rows are placed by the table's routing column (``frame``), from
    one that already has ``_shard_id`` (as ``write`` leaves it), or from a loader for each shard.
    """

    def __init__(
        self, engine: Engine, name: str, frame: DataFrame | None = None, loaders: Mapping[str, Callable[[], DataFrame]] | None = None,
        shard_key: str = "id", primary_key: str | None = None, uuid_key: bool = False,
    ) -> None:
        if (frame is None) == (loaders is None):
            raise ShardingError("give either one frame or a loader for each shard")
        self.engine, self.name, self.shard_key, self.primary_key = engine, name, shard_key, primary_key or shard_key
        self.uuid_key, self._frame, self._loaders = uuid_key, frame, loaders
        self.skipped: dict[str, str] = {}

    def place(self, key: int | str | None) -> Shard | None:
        """The one placement for writing and for pruning: null is the context, a UUID its own shard, else the route."""
        if key is None:
            return self.engine.context.current()
        if self.uuid_key and looks_like_uuid(key):
            found = self.engine.decoder.decode(key, self.engine.shards)
            if found:
                return found
        return self.engine.route_for_table(self.name, key)

    def placement(self, frame: DataFrame) -> Column:
        """``place`` as a column."""
        key, kind = F.col(self.shard_key), dict(frame.dtypes)[self.shard_key]
        out = self.engine.router.column_for_table(self.name, key, kind)
        if self.uuid_key and kind == "string":
            out = F.coalesce(F.when(key.rlike(UUID_PATTERN), decoded_shard(key, self.engine.shards, self.engine.uuids.bits)), out)
        return F.coalesce(out, F.lit(self.engine.context.current_id()))

    def rows(self, shards: ShardSet | None = None, tolerant: bool | None = None) -> DataFrame:
        """All rows on ``shards`` (the active ones) with their ``_shard_id``.

        Where shards have loaders, each is probed by reading its schema; with tolerance one that
        fails is left out and listed in ``skipped``, else the error is raised.
        """
        wanted = shards if shards is not None else self.engine.shards.active()
        if self._loaders is None:
            frame = self._frame if SHARD in self._frame.columns else self._frame.withColumn(SHARD, self.placement(self._frame))
            placed_everywhere = SHARD not in self._frame.columns and wanted.ids() == self.engine.shards.active().ids()
            return frame if placed_everywhere else frame.where(F.col(SHARD).isin(wanted.ids()))
        tolerant = self.engine.config["dead_shard_tolerance"] if tolerant is None else tolerant
        self.skipped, parts = {}, []
        for s in wanted:
            try:
                part = self._loaders[s.id]()
                part.schema  # noqa: B018  reads what the source says of itself
            except Exception as e:
                if not tolerant:
                    raise
                log.warning("shard %s can't be read and is left out: %s", s.id, str(e).splitlines()[0])
                self.skipped[s.id] = str(e)
                continue
            parts.append(part.withColumn(SHARD, F.lit(s.id)))
        if not parts:
            raise ShardingError(f"no shard of {self.name} can be read")
        return functools.reduce(lambda a, b: a.unionByName(b), parts)

    def ordinal(self) -> Column:
        """The place of a row's shard in the configured order."""
        out = F.lit(len(self.engine.shards))
        for i, s in enumerate(self.engine.shards):
            out = F.when(F.col(SHARD) == s.id, i).otherwise(out)
        return out

    def query(self):
        from ..plans.query import ShardQuery

        return ShardQuery(self)

    def create_view(self, name: str | None = None) -> str:
        """Register the union of all active shards as a view, ``all_<table>`` by default."""
        view = name or f"{self.engine.config['view_prefix']}{self.name}"
        self.rows().createOrReplaceTempView(view)
        return view

    def write(self, frame: DataFrame, path: str, mode: str = "append", uuid_column: str | None = None) -> None:
        """Place rows and write them, a folder for each shard; ``uuid_column`` is filled in where it is empty."""
        placed = frame.withColumn(SHARD, self.placement(frame))
        if uuid_column:
            placed = placed.withColumn(uuid_column, F.coalesce(F.col(uuid_column), self._uuids()))
        # Files of a shard side by side; a large shard's rows are split into tasks of the advisory size.
        placed.hint("rebalance", SHARD).write.mode(mode).partitionBy(SHARD).parquet(path)

    def save(self, frame: DataFrame, name: str, path: str, buckets: int | None = None, mode: str = "overwrite") -> None:
        """Place rows and save them as table ``name``: a folder for each shard, bucketed and sorted by the shard key.

        Tables of a group that are saved with equally many buckets meet without a shuffle: ``bucket_count`` of
        all their frames. Without a number it is that of this frame.
        """
        buckets = buckets or bucket_count(frame)
        placed = frame.withColumn(SHARD, self.placement(frame)).repartition(buckets, self.shard_key)
        placed.write.mode(mode).partitionBy(SHARD).bucketBy(buckets, self.shard_key).sortBy(self.shard_key).option("path", path).saveAsTable(name)

    @functools.cached_property
    def key_kind(self) -> str | None:
        """SQL type of the shard key's column; None where no source tells."""
        if self._frame is not None:
            return dict(self._frame.dtypes).get(self.shard_key)
        for load in self._loaders.values():
            try:
                return dict(load().dtypes).get(self.shard_key)
            except Exception as e:
                log.warning("a shard of %s can't be read: %s", self.name, str(e).splitlines()[0])
        return None

    def _uuids(self) -> Column:
        """A random UUID of version 7 that carries the row's shard number."""
        from ..functions.uuid7 import shard_number

        bits = self.engine.uuids.bits
        number = F.lit(0)
        for s in self.engine.shards:
            number = F.when(F.col(SHARD) == s.id, shard_number(s, bits) & ((1 << bits) - 1)).otherwise(number)
        rest = F.replace(F.uuid(), F.lit("-"), F.lit(""))
        ms = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
        tail = F.conv(F.substring(rest, 29, 4), 16, 10).cast("int").bitwiseAND(0xFFFF & ~((1 << bits) - 1)).bitwiseOR(number)
        tail = F.lpad(F.lower(F.hex(tail)), 4, "0")
        return F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), F.substring(rest, 14, 3), F.lit("-"), F.substring(rest, 17, 4), F.lit("-"), F.substring(rest, 21, 8), tail)


def read_placed(engine: Engine, spark: SparkSession, name: str, path: str, **keys) -> ShardedTable:
    """A table that ``ShardedTable.write`` wrote; queries that name shards read only their folders."""
    return ShardedTable(engine, name, spark.read.parquet(path), **keys)


class CentralTable:
    """A table that is not sharded: read from the central source, whatever shard is current."""

    def __init__(self, connections: Connections, engine: Engine, name: str) -> None:
        self.connections, self.engine, self.name = connections, engine, name

    def rows(self) -> DataFrame:
        with self.connections.central_only(self.engine) as options:
            return self.connections.load(options, self.name)

    def get(self, *columns: str) -> DataFrame:
        return self.rows().select(*columns) if columns else self.rows()


def bucket_count(*frames: DataFrame) -> int:
    """Buckets for tables that are to meet: so many that one of the largest table holds about ``BUCKET_BYTES``.

    A task sorts a bucket, so its memory doesn't grow with the tables, save for a key that has more rows than that.
    """
    most, buckets = max(_bytes_of(f) for f in frames), LEAST_BUCKETS
    while buckets < MOST_BUCKETS and buckets * BUCKET_BYTES < most:
        buckets *= 2
    return buckets


def _bytes_of(frame: DataFrame) -> int:
    """Bytes of the rows as Spark sorts them: eight for each field, and what texts and nested values have besides."""
    name = lambda f: F.col("`" + f.name.replace("`", "``") + "`")
    wide = [name(f) if isinstance(f.dataType, BinaryType) else name(f).cast("string") for f in frame.schema if isinstance(f.dataType, (StringType, BinaryType, ArrayType, MapType, StructType))]
    rows, *held = frame.agg(F.count("*"), *(F.sum(F.octet_length(c).cast("long")) for c in wide)).first()
    return rows * 8 * (len(frame.columns) + 1) + sum(n or 0 for n in held)


def scratch(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share: under the checkpoint folder, or a temporary one in a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ShardingError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="shardlake-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


class Connections:
    """Reader options of each shard: its own where they name a driver, else merged over the central ones."""

    def __init__(self, spark: SparkSession, central: Mapping[str, str], limit: int = 10) -> None:
        self.spark, self.central, self._made = spark, dict(central), {}
        self.pool = Pool(limit)
        self._default: list[str] = ["central"]

    def options(self, shard: Shard) -> dict[str, str]:
        return dict(shard.options) if "driver" in shard.options else {**self.central, **shard.options}

    def make(self, shard: Shard) -> dict[str, str]:
        return self._made.setdefault(shard.connection, self.options(shard))

    def has(self, name: str) -> bool:
        return name in self._made

    def names(self) -> list[str]:
        return list(self._made)

    def purge(self, name: str | None = None) -> None:
        self._made = {k: v for k, v in self._made.items() if name is not None and k != name}

    def resolve(self, engine: Engine, name: str | None = None, central: bool = False) -> dict[str, str]:
        """A named connection, else the central one if asked for, else the current shard's, else the default."""
        if name is not None:
            return self._made.get(name, self.central)
        shard = engine.context.current()
        return self.central if central or shard is None else self.make(shard)

    @contextmanager
    def central_only(self, engine: Engine):
        """Inside, nothing is current but the central connection."""
        held = engine.context.stack()
        engine.context.clear()
        try:
            yield self.central
        finally:
            for s in held:
                engine.context.push(s)

    def reader(self, shard: Shard, table: str) -> Callable[[], DataFrame]:
        """A loader for ``ShardedTable``: by path, or through JDBC where the options have a url."""
        options = self.make(shard)

        def load() -> DataFrame:
            with self.pool.lease(shard.connection):
                return self.load(options, table)

        return load

    def load(self, options: Mapping[str, str], table: str) -> DataFrame:
        if "url" in options:
            return self.spark.read.format("jdbc").options(**options, dbtable=table).load()
        return self.spark.read.format(options.get("format", "parquet")).load(f"{options['path']}/{table}.parquet")

    def warm(self, shards: Iterable[Shard]) -> list[str]:
        """Make the options of these shards ready; the names of their connections."""
        for s in shards:
            self.make(s)
        return self.names()

    def close_idle(self, now: float | None = None) -> list[str]:
        """Purge connections that nobody has used for the pool's idle time."""
        gone = self.pool.idle(now)
        for name in gone:
            self.purge(name)
            self.pool.forget(name)
        return gone


class Pool:
    """Counts leases for each connection; at the limit a further one raises. ``idle_s`` is when an unused one is idle."""

    def __init__(self, limit: int = 10, idle_s: float = 60.0) -> None:
        self.limit, self.idle_s, self._active, self._used = max(1, limit), idle_s, {}, {}

    def acquire(self, name: str) -> None:
        self._used[name] = time.monotonic()
        if self._active.get(name, 0) >= self.limit:
            raise PoolExhausted(f"{self.limit} connections to {name} are in use")
        self._active[name] = self._active.get(name, 0) + 1

    def release(self, name: str) -> None:
        self._used[name] = time.monotonic()
        self._active[name] = max(0, self._active.get(name, 0) - 1)

    @contextmanager
    def lease(self, name: str):
        self.acquire(name)
        try:
            yield
        finally:
            self.release(name)

    def flush(self) -> None:
        self._active.clear(), self._used.clear()

    def idle(self, now: float | None = None) -> list[str]:
        now = time.monotonic() if now is None else now
        return [name for name, at in self._used.items() if now - at > self.idle_s and not self._active.get(name)]

    def forget(self, name: str) -> None:
        self._active.pop(name, None), self._used.pop(name, None)

    def stats(self) -> dict:
        return {"limit": self.limit, "active": dict(self._active), "total": sum(self._active.values())}


def foreign_server_sql(shards: Iterable[Shard], wrapper: str = "postgres_fdw") -> list[str]:
    """Statements that make each shard known to one PostgreSQL coordinator."""
    out = [f"CREATE EXTENSION IF NOT EXISTS {wrapper};"]
    for s in shards:
        server, o = quoted_name(_server(s)), s.options
        quoted = {k: str(o.get(k, "")).replace("'", "''") for k in ("host", "port", "database", "username", "password")}
        out.append(f"CREATE SERVER IF NOT EXISTS {server} FOREIGN DATA WRAPPER {wrapper} OPTIONS (host '{quoted['host']}', port '{quoted['port']}', dbname '{quoted['database']}');")
        out.append(f"CREATE USER MAPPING IF NOT EXISTS FOR CURRENT_USER SERVER {server} OPTIONS (user '{quoted['username']}', password '{quoted['password']}');")
    return out


def quoted_name(name: str) -> str:
    """An SQL identifier, in quotes where it isn't a plain one."""
    return name if re.fullmatch(r"[a-z_][a-z0-9_]*", name) else '"' + name.replace('"', '""') + '"'


def _server(shard: Shard) -> str:
    return "shard_" + shard.id.replace("-", "_")


def _foreign(table: str, shard: Shard) -> str:
    return quoted_name(f"{shard.id.replace('-', '_')}_{table}")


def foreign_table_sql(table: str, shards: Iterable[Shard]) -> list[str]:
    """Statements that make each shard's part of ``table`` a foreign table of the coordinator, with its own table's columns."""
    literal = table.replace("'", "''")
    return [f"CREATE FOREIGN TABLE IF NOT EXISTS {_foreign(table, s)} (LIKE {quoted_name(table)}) SERVER {quoted_name(_server(s))} OPTIONS (table_name '{literal}');" for s in shards]


def unified_view_sql(table: str, shards: Iterable[Shard], prefix: str = "all_") -> str:
    """A view over one foreign table for each shard, rows tagged with ``_shard_id``."""
    parts = ["SELECT *, '{}' AS {} FROM {}".format(s.id.replace("'", "''"), SHARD, _foreign(table, s)) for s in shards]
    return f"CREATE OR REPLACE VIEW {quoted_name(prefix + table)} AS\n" + "\nUNION ALL\n".join(parts) + ";"


def coordinator_sql(table: str, shards: ShardSet, prefix: str = "all_") -> str:
    """All that makes ``all_<table>`` readable on the coordinator: its foreign tables, then the view. Active shards count."""
    active = shards.active()
    if active.is_empty():
        raise ShardingError("there is no active shard")
    return "\n".join([*foreign_table_sql(table, active), unified_view_sql(table, active, prefix)])


def sharded_sql(tables: Iterable[ShardedTable], sql: str, args: Mapping[str, object] | list | None = None) -> DataFrame:
    """SQL over the unified views of ``tables``; values are passed as ``args`` for ``:name`` or ``?`` markers."""
    tables = list(tables)
    for t in tables:
        t.create_view()
    return tables[0].rows().sparkSession.sql(sql, args=args)


def rebalance(table: ShardedTable, onto: Engine) -> DataFrame:
    """Rows whose shard would change on another engine, with ``_shard_id`` and ``_new_shard_id``.

    An extension: the rows to move after shards or weights have changed.
    """
    then = ShardedTable(onto, table.name, table.rows().drop(SHARD), shard_key=table.shard_key, uuid_key=table.uuid_key)
    rows = table.rows()
    return rows.withColumn("_new_shard_id", then.placement(rows)).where(~F.col("_new_shard_id").eqNullSafe(F.col(SHARD)))
