"""Doubles for tests: an engine that keeps its history, and UUIDs in a fixed sequence."""

from __future__ import annotations

import uuid

from .functions.uuid7 import ShardUuid, UuidFactory, shard_number
from .plans.context import Engine
from .topology import Shard, ShardSet


class FakeEngine(Engine):
    def __init__(self, shards: ShardSet | None = None) -> None:
        super().__init__(shards or ShardSet.numbered(3))
        self.history: list[tuple[str, str]] = []
        self.listeners.append(lambda event, shard: self.history.append((event, shard.id)))

    def initialized(self) -> list[str]:
        return [s for event, s in self.history if event == "initialized"]

    def assert_initialized(self, shard_id: str) -> None:
        assert shard_id in self.initialized(), f"{shard_id} wasn't initialized"

    def assert_not_initialized(self, shard_id: str) -> None:
        assert shard_id not in self.initialized(), f"{shard_id} was initialized"

    def assert_count(self, n: int) -> None:
        assert len(self.initialized()) == n, f"{len(self.initialized())} were initialized, not {n}"

    def assert_current(self, shard_id: str | None) -> None:
        assert self.context.current_id() == shard_id


class FixedUuids(UuidFactory):
    """UUIDs given beforehand, then counted ones."""

    def __init__(self, given: list[str] | None = None, bits: int = 10) -> None:
        super().__init__(bits)
        self.given, self.sequence = list(given or []), 0

    def generate(self, shard: Shard | str | None = None) -> ShardUuid:
        self.sequence += 1
        number = shard_number(shard, self.bits) if shard else None
        if self.given:
            return ShardUuid(uuid.UUID(self.given.pop(0)), number)
        return ShardUuid(uuid.UUID(int=7 << 76 | 2 << 62 | self.sequence << 16 | (number or 0)), number)
