"""Queries over a sharded table: immutable, pruned to one shard where the key is pinned, else scattered.

Every terminal that needs one Spark job comes twice: as a frame (``..._frame``) and as a value.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.uuid7 import looks_like_uuid
from ..sources.catalog import SHARD, ShardedTable
from ..topology import Shard, ShardSet

_OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<>": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "like": lambda c, v: c.like(v),
    "ilike": lambda c, v: c.ilike(v),
}


@dataclass(frozen=True)
class Condition:
    """One condition and what joins it to those before it; ``column`` and ``values`` where it pins a column."""

    test: Column
    either: bool = False
    column: str | None = None
    values: tuple = ()


def combined(conditions: Iterable[Condition]) -> Column | None:
    """Conditions without brackets, as SQL reads them: "and" binds closer than "or"."""
    groups: list[list[Column]] = []
    for c in conditions:
        if c.either or not groups:
            groups.append([])
        groups[-1].append(c.test)
    if not groups:
        return None
    return functools.reduce(lambda a, b: a | b, (functools.reduce(lambda a, b: a & b, g) for g in groups))


class Filters:
    """The ``where`` methods, for whatever keeps a tuple of conditions."""

    conditions: tuple[Condition, ...]

    def _add(self, *found: Condition):
        return replace(self, conditions=(*self.conditions, *found))

    @staticmethod
    def _conditions(args: tuple, either: bool) -> list[Condition]:
        if len(args) == 1 and isinstance(args[0], dict):
            pairs = [Condition(F.col(k) == v, False, k, (v,)) for k, v in args[0].items()]
            return [replace(p, either=either and i == 0) for i, p in enumerate(pairs)]
        if len(args) == 1 and isinstance(args[0], Column):
            return [Condition(args[0], either)]
        if len(args) == 1:  # a function that puts conditions in brackets
            return [Condition(combined(args[0](Group()).conditions), either)]
        column, operator, value = (args[0], "=", args[1]) if len(args) == 2 else args
        test = _OPERATORS[operator.lower()](F.col(column), value)
        return [Condition(test, either, column, (value,)) if operator == "=" else Condition(test, either)]

    def where(self, *args):
        return self._add(*self._conditions(args, False))

    def or_where(self, *args):
        """Joined without brackets: ``fk = 1 AND a OR b`` also takes rows of other parents."""
        return self._add(*self._conditions(args, True))

    def where_in(self, column: str, values: Iterable):
        values = tuple(values)
        return self._add(Condition(F.col(column).isin(*values) if values else F.lit(False), False, column, values))

    def where_not_in(self, column: str, values: Iterable):
        values = tuple(values)
        return self._add(Condition(~F.col(column).isin(*values) if values else F.lit(True)))

    def where_null(self, column: str):
        return self._add(Condition(F.col(column).isNull()))

    def where_not_null(self, column: str):
        return self._add(Condition(F.col(column).isNotNull()))

    def where_between(self, column: str, low, high):
        return self._add(Condition(F.col(column).between(low, high)))


@dataclass(frozen=True)
class Group(Filters):
    conditions: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class ShardQuery(Filters):
    table: ShardedTable
    conditions: tuple[Condition, ...] = ()
    targets: ShardSet | None = None
    orders: tuple[tuple[str | Column, bool], ...] = ()
    limited: int | None = None
    skipped: int = 0
    columns: tuple[str | Column, ...] = ()
    attached: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    prunes: bool = True
    by_shard_order: bool = False
    described: str = field(default="", compare=False)

    # ---- targets

    def on_shard(self, shard: Shard | str) -> ShardQuery:
        return replace(self, targets=ShardSet([self.table.engine.shard(shard)]))

    def on_all_shards(self) -> ShardQuery:
        return replace(self, targets=None)

    def only(self, ids: Iterable[str]) -> ShardQuery:
        """These of all shards, inactive ones too; unknown ids are passed over."""
        wanted = set(ids)
        return replace(self, targets=self.table.engine.shards.filter(lambda s: s.id in wanted))

    def except_(self, ids: Iterable[str]) -> ShardQuery:
        """The current targets without these."""
        gone = set(ids)
        return replace(self, targets=self._targets().filter(lambda s: s.id not in gone))

    def _targets(self) -> ShardSet:
        return self.targets if self.targets is not None else self.table.engine.shards.active()

    @property
    def target_shard(self) -> Shard | None:
        return self.targets.first() if self.targets is not None and len(self.targets) == 1 else None

    @property
    def is_all_shards(self) -> bool:
        return self.targets is None

    def pinned(self) -> ShardSet | None:
        """The shards that the conditions leave, if they pin the shard key.

        An equality on the key that every row must meet routes to one shard. A list of values does so to
        theirs, which goes beyond the studied design. Any "or" at the top level rules both out, and so does
        a value that compares with the key's column but can't be placed as rows of that column are.
        """
        if not self.prunes or not self.table.engine.config["co_location"] or any(c.either for c in self.conditions):
            return None
        for c in self.conditions:
            if c.column == self.table.shard_key and c.values:
                keys = [placeable(v, self.table.key_kind) for v in c.values if v is not None]
                if any(k is None for k in keys):
                    continue
                found = [self.table.place(k) for k in keys]
                if all(found):
                    return ShardSet(found)
        return None

    def shards(self) -> ShardSet:
        """The shards that the query reads."""
        targets, pinned = self._targets(), self.pinned() if self.targets is None else None
        return targets if pinned is None else targets.filter(lambda s: s.id in pinned)

    # ---- shape

    def order_by(self, column: str | Column, direction: str = "asc") -> ShardQuery:
        return replace(self, orders=(*self.orders, (column, direction.lower() == "desc")))

    def order_by_desc(self, column: str | Column) -> ShardQuery:
        return self.order_by(column, "desc")

    def latest(self, column: str = "created_at") -> ShardQuery:
        return self.order_by_desc(column)

    def oldest(self, column: str = "created_at") -> ShardQuery:
        return self.order_by(column)

    def limit(self, n: int) -> ShardQuery:
        return replace(self, limited=n)

    take = limit

    def offset(self, n: int) -> ShardQuery:
        return replace(self, skipped=n)

    skip = offset

    def in_shard_order(self) -> ShardQuery:
        """Rows in the shards' order, then by primary key: what a limit takes is then certain, at the price of a sort."""
        return replace(self, by_shard_order=True)

    def select(self, *columns: str | Column) -> ShardQuery:
        return replace(self, columns=columns)

    def attach(self, step: Callable[[DataFrame], DataFrame]) -> ShardQuery:
        """Let ``step`` add to the rows that remain after ordering and limits: eager loads, counts."""
        return replace(self, attached=(*self.attached, step))

    # ---- frames

    def base(self) -> DataFrame:
        """All rows that the query's conditions leave, tagged with their shard."""
        shards = self.shards()
        self.table.engine.scatter.record(f"{self.table.name}{self.described}", shards.ids())
        if len(shards) > 1:
            self.table.engine.metrics.record_cross_shard()
        everything = shards.ids() == self.table.engine.shards.active().ids()
        rows = self.table.rows(None if everything else shards)
        test = combined(self.conditions)
        return rows if test is None else rows.where(test)

    def _ordering(self) -> list[Column]:
        """The order asked for; ties follow the shards' order and the key."""
        keys = [(F.col(c) if isinstance(c, str) else c) for c, _ in self.orders]
        asked = [k.desc() if down else k.asc() for k, (_, down) in zip(keys, self.orders, strict=True)]
        return [*asked, self.table.ordinal().asc(), F.col(self.table.primary_key).asc()]

    def get(self, *columns: str | Column) -> DataFrame:
        rows = self.base()
        if self.orders or self.by_shard_order:
            rows = rows.orderBy(*self._ordering())
        # Without an order a limit takes any rows: each task stops as soon as it has that many.
        rows = rows.offset(self.skipped) if self.skipped else rows
        rows = rows.limit(self.limited) if self.limited is not None else rows
        for step in self.attached:
            rows = step(rows)
        chosen = self.columns or columns
        return rows.select(*chosen) if chosen else rows

    def aggregate_frame(self, **of: Column) -> DataFrame:
        return self.base().agg(*(c.alias(k) for k, c in of.items()))

    def count_frame(self, column: str = "*", name: str = "count") -> DataFrame:
        return self.aggregate_frame(**{name: F.count(column)})

    def sum_frame(self, column: str, name: str = "sum") -> DataFrame:
        return self.aggregate_frame(**{name: total(column)})

    def avg_frame(self, column: str, name: str = "avg", null_aware: bool = False) -> DataFrame:
        return self.aggregate_frame(**{name: F.avg(column) if null_aware else average(column)})

    def min_frame(self, column: str, name: str = "min") -> DataFrame:
        return self.aggregate_frame(**{name: F.min(column)})

    def max_frame(self, column: str, name: str = "max") -> DataFrame:
        return self.aggregate_frame(**{name: F.max(column)})

    def exists_frame(self, name: str = "exists") -> DataFrame:
        return self.base().select(F.lit(1).alias("one")).limit(1).agg((F.count("*") > 0).alias(name))

    def counts_by_shard(self, column: str = "*", name: str = "n") -> DataFrame:
        """shard_id and a count for every shard that is read, zero where there is nothing."""
        counted = self.base().groupBy(F.col(SHARD).alias("shard_id")).agg(F.count(column).alias(name))
        every = counted.sparkSession.createDataFrame([(i,) for i in self.shards().ids()], "shard_id string")
        return every.join(counted, "shard_id", "left").select("shard_id", F.coalesce(name, F.lit(0)).cast("long").alias(name))

    def group_by(self, *keys: str, **of: Column) -> DataFrame:
        """Groups over all shards; Spark aggregates partially where rows are and merges."""
        return self.base().groupBy(*keys).agg(*(c.alias(k) for k, c in of.items()))

    def first_frame(self, *columns: str) -> DataFrame:
        return replace(self, limited=1).get(*columns)

    def find_frame(self, key: int | str, *columns: str) -> DataFrame:
        """The row of a primary key, from the shard that the key places it on where that is known."""
        table, query = self.table, self.where(self.table.primary_key, key)
        if self.targets is None and table.primary_key != table.shard_key and isinstance(key, str) and looks_like_uuid(key):
            found = table.engine.decoder.decode(key, table.engine.shards)
            query = query.on_shard(found) if found else query
        return query.get(*columns)

    def pluck_frame(self, column: str, key: str | None = None) -> DataFrame:
        """One column; with ``key`` a row for each key, the last in the shards' order."""
        if key is None:
            return self.get(column)
        from pyspark.sql import Window

        last = Window.partitionBy(key).orderBy(self.table.ordinal().desc(), F.col(self.table.primary_key).desc())
        return self.base().withColumn("_n", F.row_number().over(last)).where("_n = 1").select(key, column)

    def by_shard_frame(self, *columns: str) -> DataFrame:
        """The rows of all shards beside their shard's id, in one scan."""
        return self.base().select(SHARD, *(c for c in columns if c != SHARD)) if columns else self.base()

    def by_shard(self, *columns: str) -> dict[str, DataFrame]:
        """A frame for each shard, each a scan of its own; see ``by_shard_frame`` for all in one."""
        rows = self.base()
        return {i: (rows.where(F.col(SHARD) == i).select(*columns) if columns else rows.where(F.col(SHARD) == i)) for i in self.shards().ids()}

    # ---- values

    def _value(self, frame: DataFrame) -> Any:
        return frame.first()[0]

    def count(self, column: str = "*") -> int:
        return self._value(self.count_frame(column))

    def sum(self, column: str) -> float:
        return float(self._value(self.sum_frame(column)))

    def avg(self, column: str, null_aware: bool = False) -> float | None:
        return self._value(self.avg_frame(column, null_aware=null_aware))

    def min(self, column: str) -> Any:
        return self._value(self.min_frame(column))

    def max(self, column: str) -> Any:
        return self._value(self.max_frame(column))

    def exists(self) -> bool:
        return not self.base().isEmpty()

    def first(self, *columns: str) -> Any:
        return self.first_frame(*columns).first()

    def find(self, key: int | str, *columns: str) -> Any:
        return self.find_frame(key, *columns).first()


_WHOLE = ("tinyint", "smallint", "int", "bigint")
_DIGITS = re.compile(r"\s*[+-]?\d+\s*")


def placeable(value: Any, kind: str | None) -> int | str | None:
    """``value`` as rows of a key column of SQL type ``kind`` carry it, so that it is placed as they are; else None.

    A number in a string equals a whole-number column's value, so it is placed as that number. A number
    beside a text column equals many texts ('7', '07'), which are on different shards: it can't be placed.
    """
    if isinstance(value, bool):
        return None
    if kind in _WHOLE:
        if isinstance(value, str):
            return int(value) if _DIGITS.fullmatch(value) else None
        if isinstance(value, (float, Decimal)):
            return int(value) if math.isfinite(value) and value == int(value) else None
        return value if isinstance(value, int) else None
    return value if kind == "string" and isinstance(value, str) else None


def total(column: str) -> Column:
    """A sum that is 0 over nothing."""
    return F.coalesce(F.sum(column), F.lit(0))


def average(column: str) -> Column:
    """The sum over the number of rows, nulls counted in; 0 over nothing."""
    return F.when(F.count("*") > 0, F.coalesce(F.sum(column), F.lit(0)) / F.count("*")).otherwise(F.lit(0.0))
