"""Key to shard: modulo, ranges and consistent hashing, for single values and for columns.

Each strategy states one placement twice: ``route`` for a value on the driver, ``column`` for a
Spark expression; both give the same shard. Columns stay in native expressions wherever Spark
has the hash function.
"""

from __future__ import annotations

import functools
import hashlib
import logging
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Mapping
from typing import Protocol

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..topology import Shard, ShardingError, ShardSet

Key = int | str
log = logging.getLogger(__name__)


class Strategy(Protocol):
    name: str

    def route(self, key: Key, shards: ShardSet) -> Shard: ...

    def column(self, key: Column, kind: str, shards: ShardSet) -> Column: ...

    def supports(self, key: object) -> bool: ...


def _check(key: object) -> Key:
    if isinstance(key, bool) or not isinstance(key, (int, str)):
        raise ShardingError(f"a shard key is a whole number or a string, not {type(key).__name__}")
    return key


def _some(shards: ShardSet) -> ShardSet:
    if shards.is_empty():
        raise ShardingError("there is no active shard")
    return shards


def text_number(value: str) -> int:
    return zlib.crc32(value.encode("utf-8")) & 0x7FFFFFFF


def _number(key: Column, kind: str) -> Column:
    """A whole, not negative number for a key column of SQL type ``kind``."""
    return F.crc32(key.cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF)) if kind == "string" else F.abs(key.cast("long"))


class Modulo:
    """Number of the key modulo the number of shards, shards sorted by id."""

    name = "modulo"

    def supports(self, key: object) -> bool:
        return isinstance(key, (int, str)) and not isinstance(key, bool)

    def route(self, key: Key, shards: ShardSet) -> Shard:
        ids = sorted(_some(shards).ids())
        number = text_number(key) if isinstance(_check(key), str) else abs(key)
        return shards.require(ids[number % len(ids)])

    def column(self, key: Column, kind: str, shards: ShardSet) -> Column:
        ids = sorted(_some(shards).ids())
        at = _number(key, kind) % len(ids)
        out = F.lit(ids[-1])
        for i, shard_id in enumerate(ids[:-1]):
            out = F.when(at == i, F.lit(shard_id)).otherwise(out)
        return F.when(key.isNotNull(), out)


class Ranges:
    """First shard whose metadata has start <= key < end; the last one, if none has."""

    name = "range"
    supports = Modulo.supports

    @staticmethod
    def _bounds(shards: ShardSet) -> list[tuple[Shard, int, int]]:
        return [(s, int(s.metadata["start"]), int(s.metadata["end"])) for s in _some(shards) if s.metadata.get("start") is not None and s.metadata.get("end") is not None]

    def route(self, key: Key, shards: ShardSet) -> Shard:
        number = text_number(key) if isinstance(_check(key), str) else key
        for shard, start, end in self._bounds(shards):
            if start <= number < end:
                return shard
        log.warning("no shard's range holds %r; the last one takes it", key)
        return list(shards)[-1]

    def column(self, key: Column, kind: str, shards: ShardSet) -> Column:
        number = _number(key, kind) if kind == "string" else key.cast("long")
        out = F.lit(list(shards)[-1].id)
        for shard, start, end in reversed(self._bounds(shards)):
            out = F.when((number >= start) & (number < end), F.lit(shard.id)).otherwise(out)
        return F.when(key.isNotNull(), out)


_DIGESTS = {
    "md5": lambda b: hashlib.md5(b).hexdigest(),
    "sha256": lambda b: hashlib.sha256(b).hexdigest(),
    "xxh64": xxhash.xxh64_hexdigest,
    "xxh128": xxhash.xxh128_hexdigest,
}


def digest(text: str, algorithm: str) -> str:
    return _DIGESTS.get(algorithm, xxhash.xxh128_hexdigest)(text.encode("utf-8"))


def digest_column(text: Column, algorithm: str) -> Column:
    if algorithm == "md5":
        return F.md5(text)
    if algorithm == "sha256":
        return F.sha2(text, 256)
    of = _DIGESTS.get(algorithm, xxhash.xxh128_hexdigest)

    @F.pandas_udf("string")
    def hashed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else of(v.encode("utf-8")))

    return hashed(text)


class Ring:
    """A consistent-hash ring: every shard has virtual nodes, a key goes to the first at or after its hash."""

    def __init__(self, shards: Iterable[Shard], virtual_nodes: int = 150, algorithm: str = "xxh128") -> None:
        self.virtual_nodes, self.algorithm = virtual_nodes, algorithm
        self.nodes = {s.id: virtual_nodes * max(1, s.weight) for s in shards}
        owners = {digest(f"{shard_id}:{i}", algorithm): shard_id for shard_id, n in self.nodes.items() for i in range(n)}
        self.positions = sorted(owners)
        self.owners = [owners[p] for p in self.positions]

    @property
    def stretch_digits(self) -> int:
        """Leading hex digits by which a column expression finds its stretch of the ring: few positions in each."""
        return 3 if len(self.positions) <= 4096 else 4

    def add(self, shard: Shard) -> Ring:
        return self._with({**{k: v // self.virtual_nodes for k, v in self.nodes.items()}, shard.id: shard.weight})

    def remove(self, shard_id: str) -> Ring:
        return self._with({k: v // self.virtual_nodes for k, v in self.nodes.items() if k != shard_id})

    def clear(self) -> Ring:
        return self._with({})

    def _with(self, weights: Mapping[str, int]) -> Ring:
        return Ring([Shard(k, weight=w) for k, w in weights.items()], self.virtual_nodes, self.algorithm)

    def lookup(self, key: Key) -> str:
        if not self.positions:
            raise ShardingError("the ring is empty")
        return self.owners[bisect_left(self.positions, digest(str(key), self.algorithm)) % len(self.owners)]

    def node_count(self) -> int:
        return len(self.nodes)

    def virtual_node_count(self) -> int:
        return len(self.positions)

    def has(self, shard_id: str) -> bool:
        return shard_id in self.nodes

    def distribution(self, keys: Iterable[Key]) -> dict[str, int]:
        out = dict.fromkeys(self.nodes, 0)
        for k in keys:
            out[self.lookup(k)] += 1
        return out

    def column(self, key: Column) -> Column:
        """The owner of each key, by one table look-up and a comparison or two, all native.

        A table says for each leading-digit stretch how many positions lie before it; the positions
        inside a stretch (a handful at most) are compared with the whole hash.
        """
        if not self.positions:
            raise ShardingError("the ring is empty")
        digits = self.stretch_digits
        n = 16**digits
        of = [int(p[:digits], 16) for p in self.positions]
        before = [bisect_left(of, i) for i in range(n)]
        deepest = max(b - a for a, b in zip(before, [*before[1:], len(of)], strict=True))
        listed = lambda values: F.split(F.lit(",".join(map(str, values))), ",")  # noqa: E731  folded into one literal
        starts, positions = listed(before).cast("array<int>"), listed([*self.positions, *["~"] * (deepest + 1)])
        owners = F.split(F.lit("\u0001".join([*self.owners, self.owners[0]])), "\u0001")
        hashed = digest_column(key.cast("string"), self.algorithm)
        start = F.element_at(starts, F.conv(F.substring(hashed, 1, digits), 16, 10).cast("int") + 1)
        at = start
        for k in range(deepest):  # no conditional parts, so that what they share is computed once
            at = at + (F.element_at(positions, start + (k + 1)) < hashed).cast("int")
        return F.element_at(owners, at + 1)

    def intervals(self) -> list[tuple[str, str, str]]:
        """(after, up to, owner) for the ring's stretches, for SQL; the last one wraps around."""
        last = self.positions[-1]
        return [("" if i == 0 else self.positions[i - 1], p, o) for i, (p, o) in enumerate(zip(self.positions, self.owners, strict=True))] + [(last, "~", self.owners[0])]


@functools.lru_cache(maxsize=64)
def _ring(nodes: tuple[tuple[str, int], ...], virtual_nodes: int, algorithm: str) -> Ring:
    return Ring([Shard(i, weight=w) for i, w in nodes], virtual_nodes, algorithm)


class ConsistentHash:
    name = "consistent_hash"
    supports = Modulo.supports

    def __init__(self, virtual_nodes: int = 150, algorithm: str = "md5") -> None:
        """md5 is native in columns; xxh digests, which rows placed elsewhere may need, run in a pandas UDF."""
        self.virtual_nodes, self.algorithm = virtual_nodes, algorithm

    def ring(self, shards: ShardSet) -> Ring:
        return _ring(tuple((s.id, s.weight) for s in shards), self.virtual_nodes, self.algorithm)

    def route(self, key: Key, shards: ShardSet) -> Shard:
        return shards.require(self.ring(_some(shards)).lookup(_check(key)))

    def column(self, key: Column, kind: str, shards: ShardSet) -> Column:
        return self.ring(_some(shards)).column(key)


def strategy_from_config(config: Mapping) -> Strategy:
    """The strategy that ``default_strategy`` names; unknown names mean consistent hashing."""
    name = config.get("default_strategy", "consistent_hash")
    if not isinstance(name, str):
        return name
    if name in ("modulo", "range"):
        return Modulo() if name == "modulo" else Ranges()
    ring = config.get("consistent_hash", {})
    return ConsistentHash(ring.get("virtual_nodes", 150), ring.get("hash_algorithm", "md5"))


class TableGroups:
    """Tables that are routed together; a table is in one group at most, the last one given."""

    def __init__(self, groups: Mapping[str, Iterable[str]] | None = None) -> None:
        self._tables: dict[str, list[str]] = {}
        self._group: dict[str, str] = {}
        for group, tables in (groups or {}).items():
            self._tables.setdefault(group, [])
            for t in tables:
                self.add(t, group)

    def add(self, table: str, group: str) -> None:
        self.remove(table)
        self._tables.setdefault(group, []).append(table)
        self._group[table] = group

    def remove(self, table: str) -> None:
        if group := self._group.pop(table, None):
            self._tables[group].remove(table)

    def group_of(self, table: str) -> str | None:
        return self._group.get(table)

    def tables_in(self, group: str) -> list[str]:
        return list(self._tables.get(group, ()))

    def has_group(self, table: str) -> bool:
        return table in self._group

    def names(self) -> list[str]:
        return list(self._tables)

    def tables(self) -> list[str]:
        return list(self._group)

    def together(self, a: str, b: str) -> bool:
        return self.has_group(a) and self.group_of(a) == self.group_of(b)


class Router:
    """Routes keys over the active shards, for grouped tables by the group's key."""

    def __init__(self, shards: ShardSet, strategy: Strategy | None = None, groups: TableGroups | None = None) -> None:
        self.shards, self.strategy, self.groups = shards, strategy or ConsistentHash(), groups or TableGroups()

    def route(self, key: Key) -> Shard:
        return self.strategy.route(key, self.shards.active())

    def group_key(self, table: str, key: Key) -> Key:
        group = self.groups.group_of(table)
        return key if group is None else f"{group}:{key}"

    def route_for_table(self, table: str, key: Key) -> Shard:
        return self.route(self.group_key(table, key))

    def shard_by_id(self, shard_id: str) -> Shard | None:
        return self.shards.get(shard_id)

    def column(self, key: Column, kind: str) -> Column:
        return self.strategy.column(key, kind, self.shards.active())

    def column_for_table(self, table: str, key: Column, kind: str) -> Column:
        group = self.groups.group_of(table)
        if group is None:
            return self.column(key, kind)
        return self.column(F.concat(F.lit(f"{group}:"), key.cast("string")), "string")


def distribution(keys: DataFrame, key: str, router: Router) -> DataFrame:
    """shard_id and n for every active shard, zero where no key falls."""
    kind = dict(keys.dtypes)[key]
    counted = keys.groupBy(router.column(F.col(key), kind).alias("shard_id")).agg(F.count("*").alias("n"))
    every = keys.sparkSession.createDataFrame([(i,) for i in router.shards.active().ids()], "shard_id string")
    return every.join(counted, "shard_id", "left").select("shard_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
