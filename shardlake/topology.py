"""Shards and sets of shards, immutable, in the order in which they were configured."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from typing import Any


class ShardingError(RuntimeError):
    """Base of all errors of this library."""


class ShardNotFound(ShardingError):
    def __init__(self, shard_id: str) -> None:
        super().__init__(f"there is no shard {shard_id!r}")
        self.shard_id = shard_id


class PoolExhausted(ShardingError):
    """No connection is free within the limit."""


class CrossShardWrite(ShardingError):
    """A guarded batch of writes reached a second shard."""


@dataclass(frozen=True)
class Shard:
    id: str
    name: str = ""
    connection: str = ""
    options: Mapping[str, Any] = field(default_factory=dict)
    weight: int = 1
    active: bool = True
    read_only: bool = False
    metadata: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        object.__setattr__(self, "name", self.name or self.id)
        object.__setattr__(self, "connection", self.connection or f"shard_{self.id}")

    @classmethod
    def from_config(cls, shard_id: str, config: Mapping[str, Any]) -> Shard:
        keys = ("name", "connection", "weight", "active", "read_only", "metadata")
        return cls(str(shard_id), options=dict(config.get("database", {})), **{k: config[k] for k in keys if k in config})

    def with_active(self, active: bool) -> Shard:
        return replace(self, active=active)

    def with_read_only(self, read_only: bool) -> Shard:
        return replace(self, read_only=read_only)


class ShardSet:
    """An ordered map from id to shard; every change returns a new set."""

    def __init__(self, shards: Iterable[Shard] = ()) -> None:
        self._shards = {s.id: s for s in shards}

    @classmethod
    def from_config(cls, config: Mapping[Any, Mapping[str, Any]]) -> ShardSet:
        return cls(Shard.from_config(str(k), v) for k, v in config.items())

    @classmethod
    def numbered(cls, n: int, prefix: str = "shard-") -> ShardSet:
        return cls(Shard(f"{prefix}{i + 1}") for i in range(n))

    def add(self, shard: Shard) -> ShardSet:
        return ShardSet([*self._shards.values(), shard])

    def remove(self, shard_id: str) -> ShardSet:
        return self.filter(lambda s: s.id != shard_id)

    def get(self, shard_id: str) -> Shard | None:
        return self._shards.get(shard_id)

    def require(self, shard: str | Shard) -> Shard:
        shard_id = shard.id if isinstance(shard, Shard) else shard
        if shard_id not in self._shards:
            raise ShardNotFound(shard_id)
        return self._shards[shard_id]

    def has(self, shard_id: str) -> bool:
        return shard_id in self._shards

    def first(self) -> Shard | None:
        return next(iter(self), None)

    def filter(self, keep: Callable[[Shard], bool]) -> ShardSet:
        return ShardSet(s for s in self if keep(s))

    def active(self) -> ShardSet:
        return self.filter(lambda s: s.active)

    def writable(self) -> ShardSet:
        return self.filter(lambda s: not s.read_only)

    def read_only(self) -> ShardSet:
        return self.filter(lambda s: s.read_only)

    def map(self, of: Callable[[Shard], Any]) -> dict[str, Any]:
        return {s.id: of(s) for s in self}

    def each(self, do: Callable[[Shard], Any]) -> ShardSet:
        for s in self:
            do(s)
        return self

    def all(self) -> dict[str, Shard]:
        return dict(self._shards)

    def ids(self) -> list[str]:
        return list(self._shards)

    def total_weight(self) -> int:
        return sum(s.weight for s in self)

    def is_empty(self) -> bool:
        return not self._shards

    def is_not_empty(self) -> bool:
        return bool(self._shards)

    def count(self) -> int:
        return len(self._shards)

    def __len__(self) -> int:
        return len(self._shards)

    def __iter__(self) -> Iterator[Shard]:
        return iter(self._shards.values())

    def __contains__(self, shard: object) -> bool:
        return (shard.id if isinstance(shard, Shard) else shard) in self._shards
