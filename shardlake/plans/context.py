"""What a query runs in: the stack of shards, life-cycle hooks, detectors, and the engine that holds all."""

from __future__ import annotations

import contextvars
import logging
import time
import warnings
from collections import deque
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any, Protocol

from ..functions.routing import Router, Strategy, TableGroups, strategy_from_config
from ..functions.uuid7 import UuidDecoder, UuidFactory
from ..operators.metrics import ShardMetrics
from ..topology import CrossShardWrite, Shard, ShardSet

log = logging.getLogger(__name__)
_stack: ContextVar[tuple[Shard, ...]] = ContextVar("shards", default=())


class ShardContext:
    """The shards that are current, innermost last."""

    def push(self, shard: Shard) -> None:
        _stack.set((*_stack.get(), shard))

    def pop(self) -> Shard | None:
        held = _stack.get()
        _stack.set(held[:-1])
        return held[-1] if held else None

    def current(self) -> Shard | None:
        return (_stack.get() or (None,))[-1]

    def current_id(self) -> str | None:
        shard = self.current()
        return shard.id if shard else None

    def active(self) -> bool:
        return bool(_stack.get())

    def depth(self) -> int:
        return len(_stack.get())

    def clear(self) -> None:
        _stack.set(())

    def stack(self) -> list[Shard]:
        return list(_stack.get())

    def contains(self, shard: Shard | str) -> bool:
        shard_id = shard.id if isinstance(shard, Shard) else shard
        return any(s.id == shard_id for s in _stack.get())

    @contextmanager
    def on(self, shard: Shard) -> Iterator[Shard]:
        token = _stack.set((*_stack.get(), shard))
        try:
            yield shard
        finally:
            _stack.reset(token)

    def run(self, shard: Shard, do: Callable[[Shard], Any]) -> Any:
        with self.on(shard):
            return do(shard)


class Bootstrapper(Protocol):
    def bootstrap(self, shard: Shard) -> None: ...

    def revert(self) -> None: ...


class CurrentDatabase:
    """Makes each shard's catalog database current while the shard is, if its options name one."""

    def __init__(self, spark) -> None:
        self._spark, self._before = spark, []

    def bootstrap(self, shard: Shard) -> None:
        self._before.append(self._spark.catalog.currentDatabase())
        if name := shard.options.get("database"):
            self._spark.catalog.setCurrentDatabase(name)

    def revert(self) -> None:
        self._spark.catalog.setCurrentDatabase(self._before.pop())


class CachePrefix:
    """A prefix for names of cached results; nested contexts nest theirs."""

    def __init__(self) -> None:
        self._shards: list[str] = []

    @property
    def prefix(self) -> str:
        return "".join(f"shard:{s}:" for s in self._shards)

    def bootstrap(self, shard: Shard) -> None:
        self._shards.append(shard.id)

    def revert(self) -> None:
        self._shards.pop()


class ScatterDetector:
    """Tells when a query reaches more than one shard, once for each query."""

    #: Queries that are remembered, the latest ones.
    MOST_SEEN = 1_000

    def __init__(self) -> None:
        self.reset()

    def record(self, query: str, shards: list[str]) -> None:
        if self.enabled and len(shards) > 1:
            self.seen.append((query, len(shards)))
            log.warning("a query reaches %d shards: %s", len(shards), query)
            if self.callback:
                self.callback(query, shards)

    def reset(self) -> None:
        self.enabled, self.callback, self.seen = False, None, deque(maxlen=self.MOST_SEEN)


class WriteGuard:
    """Watches which shards a batch of writes reaches; a second one warns, or raises where strict."""

    def __init__(self) -> None:
        self.enabled, self.strict, self.shards, self._open = True, False, [], False

    @contextmanager
    def batch(self) -> Iterator[WriteGuard]:
        self._open, self.shards = True, []
        try:
            yield self
        finally:
            self._open, self.shards = False, []

    def record(self, shard: Shard) -> None:
        if not self.enabled or not self._open or shard.id in self.shards:
            return
        self.shards.append(shard.id)
        if len(self.shards) > 1:
            said = f"one batch writes to shards {', '.join(self.shards)}; it isn't atomic"
            if self.strict:
                raise CrossShardWrite(said)
            warnings.warn(said, stacklevel=3)


class Engine:
    """Shards, routing, context, metrics and hooks of one application."""

    def __init__(
        self, shards: ShardSet, strategy: Strategy | None = None, groups: TableGroups | None = None, config: Mapping[str, Any] | None = None, bootstrappers: list[Bootstrapper] | None = None
    ) -> None:
        self.config = {"dead_shard_tolerance": False, "co_location": True, "view_prefix": "all_", **(config or {})}
        self.shards, self.groups = shards, groups or TableGroups(self.config.get("table_groups"))
        self.strategy = strategy or strategy_from_config(self.config)
        uuids = self.config.get("uuid", {})
        self.uuids = UuidFactory(uuids.get("shard_bits", 10), uuids.get("embed_shard_metadata", True))
        self.decoder = UuidDecoder(self.uuids)
        self.context, self.metrics = ShardContext(), ShardMetrics()
        self.scatter, self.writes = ScatterDetector(), WriteGuard()
        self.bootstrappers = bootstrappers or []
        self.listeners: list[Callable[[str, Shard], None]] = []

    @property
    def router(self) -> Router:
        return Router(self.shards, self.strategy, self.groups)

    def add_shard(self, shard: Shard) -> None:
        self.shards = self.shards.add(shard)

    def set_shards(self, shards: ShardSet) -> None:
        self.shards = shards

    def shard(self, shard: Shard | str) -> Shard:
        return self.shards.require(shard)

    def _tell(self, event: str, shard: Shard) -> None:
        for listener in self.listeners:
            listener(event, shard)

    def initialize(self, shard: Shard | str) -> Shard:
        found, done = self.shard(shard), []
        self.context.push(found)
        try:
            self.writes.record(found)
            self._tell("initialized", found)
            for b in self.bootstrappers:
                b.bootstrap(found)
                done.append(b)
        except BaseException:
            for b in reversed(done):
                b.revert()
            self.context.pop()
            raise
        self._tell("bootstrapped", found)
        return found

    def end(self) -> None:
        if self.context.current() is None:
            return
        for b in reversed(self.bootstrappers):
            b.revert()
        self._tell("ended", self.context.pop())

    @contextmanager
    def on(self, shard: Shard | str) -> Iterator[Shard]:
        found, began = self.initialize(shard), time.perf_counter()
        try:
            yield found
        finally:
            self.metrics.record_query(found.id, (time.perf_counter() - began) * 1000)
            self.end()

    def run(self, shard: Shard | str, do: Callable[[Shard], Any]) -> Any:
        with self.on(shard) as found:
            return do(found)

    def run_on_all(self, do: Callable[[Shard], Any]) -> dict[str, Any]:
        return {s.id: self.run(s, do) for s in self.shards.active()}

    def run_tolerantly(self, do: Callable[[Shard], Any], at_once: int = 8) -> tuple[dict[str, Any], dict[str, str]]:
        """``do`` on every active shard, each on its own thread, and what those said that failed.

        A Spark job fails as a whole; where a source may break off in the middle of a scan, a job for each
        shard is what keeps the others' results. Without tolerance in the configuration the first error is raised.
        """
        shards, found, failed = list(self.shards.active()), {}, {}
        with ThreadPoolExecutor(max_workers=max(1, min(at_once, len(shards)))) as pool:
            # Each thread has a context of its own, so the stack of shards is that of its shard alone.
            waiting = {s.id: pool.submit(contextvars.copy_context().run, self.run, s, do) for s in shards}
            for shard_id, result in waiting.items():
                try:
                    found[shard_id] = result.result()
                except Exception as e:
                    if not self.config["dead_shard_tolerance"]:
                        raise
                    log.warning("shard %s failed and is left out: %s", shard_id, str(e).splitlines()[0] if str(e) else type(e).__name__)
                    failed[shard_id] = str(e)
        return found, failed

    def route(self, key: int | str) -> Shard:
        return self.router.route(key)

    def route_for_table(self, table: str, key: int | str) -> Shard:
        return self.router.route_for_table(table, key)

    def reset(self) -> None:
        """Forget everything that a long-running process should not carry on."""
        self.context.clear(), self.metrics.reset(), self.scatter.reset()
