"""Relationships from central parents to sharded children, and back."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.query import ShardQuery
from ..sources.catalog import SHARD, ShardedTable


@dataclass(frozen=True)
class Relation:
    """Children of ``table`` whose ``foreign_key`` is a parent's ``local_key``."""

    table: ShardedTable
    foreign_key: str
    local_key: str

    def of(self, parent: Any) -> ShardQuery:
        """One parent's children. The foreign key comes first, so that an ``or_where`` reaches past it."""
        key = parent[self.local_key] if hasattr(parent, "__getitem__") and not isinstance(parent, (str, bytes)) else parent
        return ShardQuery(self.table, prunes=False).where(self.foreign_key, key)

    def create(self, parent_key: Any, frame: DataFrame, path: str) -> None:
        """Write children of one parent, each to its own shard."""
        self.table.write(frame.withColumn(self.foreign_key, F.lit(parent_key)), path)

    def children(self, query: ShardQuery | None = None) -> DataFrame:
        return (query or ShardQuery(self.table)).base()


def _prefixed(frame: DataFrame, prefix: str) -> DataFrame:
    return frame.select(*(F.col(c).alias(f"{prefix}{c}") for c in frame.columns))


def has_many(parents: DataFrame, relation: Relation, query: ShardQuery | None = None, how: str = "inner", prefix: str = "") -> DataFrame:
    """Parents beside each of their children. The optimiser broadcasts parents if they are small."""
    children = _prefixed(relation.children(query), prefix)
    return parents.join(children, parents[relation.local_key] == children[f"{prefix}{relation.foreign_key}"], how)


def _ranked(relation: Relation, query: ShardQuery | None, order: list[Column]) -> DataFrame:
    by = Window.partitionBy(relation.foreign_key).orderBy(*order)
    return relation.children(query).withColumn("_n", F.row_number().over(by))


def top_children(parents: DataFrame, relation: Relation, order: list[Column], n: int, query: ShardQuery | None = None) -> DataFrame:
    """Each parent's first ``n`` children in ``order``; ties go by shard, then primary key."""
    ties = [relation.table.ordinal().asc(), F.col(relation.table.primary_key).asc()]
    children = _ranked(relation, query, [*order, *ties]).where(F.col("_n") <= n)
    return parents.join(children, parents[relation.local_key] == children[relation.foreign_key])


def has_one(parents: DataFrame, relation: Relation, query: ShardQuery | None = None) -> DataFrame:
    """Every parent with its first child: first in the shards' order, then by primary key; null if none."""
    one = _ranked(relation, query, [relation.table.ordinal().asc(), F.col(relation.table.primary_key).asc()]).where("_n = 1").drop("_n")
    return parents.join(one, parents[relation.local_key] == one[relation.foreign_key], "left")


def with_count(parents: DataFrame, relation: Relation, name: str, query: ShardQuery | None = None) -> DataFrame:
    """Parents with how many children they have. Children are counted before anything is joined."""
    counted = relation.children(query).groupBy(F.col(relation.foreign_key).alias("_fk")).agg(F.count("*").alias(name))
    joined = parents.join(counted, parents[relation.local_key] == counted["_fk"], "left").drop("_fk")
    return joined.withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def with_children(parents: DataFrame, relation: Relation, name: str, columns: list[str], query: ShardQuery | None = None, most: int | None = None) -> DataFrame:
    """Parents with an array of their children's ``columns``, in the order of those.

    All children of a parent are then one row. ``most`` keeps the first so many of each; ``has_many``
    has a row for each child, whatever their number.
    """
    children = relation.children(query)
    if most is not None:
        children = _ranked(relation, query, [F.col(c).asc() for c in columns]).where(F.col("_n") <= most)
    gathered = children.groupBy(F.col(relation.foreign_key).alias("_fk")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    joined = parents.join(gathered, parents[relation.local_key] == gathered["_fk"], "left").drop("_fk")
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(gathered.schema[name].dataType)))


def with_parent(rows: DataFrame, parents: DataFrame, foreign_key: str, parent_key: str, name: str, columns: list[str]) -> DataFrame:
    """Sharded rows with a struct of their central parent; null where there is none."""
    found = parents.select(F.col(parent_key).alias("_pk"), F.struct(*columns).alias(name))
    return rows.join(found, rows[foreign_key] == found["_pk"], "left").drop("_pk")


def parents_with_children(parents: DataFrame, relation: Relation, query: ShardQuery | None = None) -> DataFrame:
    """Parents that have a child: a semi-join on the foreign keys alone."""
    children = relation.children(query).select(relation.foreign_key)
    return parents.join(children, parents[relation.local_key] == children[relation.foreign_key], "left_semi")


def colocated_join(left: ShardQuery, right: ShardQuery, left_key: str, right_key: str) -> DataFrame:
    """Rows of two tables of one group that meet on their shard keys.

    Equal keys are on equal shards, so the shard needs no comparing of its own. Where both tables were
    saved by ``ShardedTable.save`` with equally many buckets, neither side is shuffled, and a pinned
    key reads one folder and one bucket of each.
    """
    a, b = left.table, right.table
    if not a.engine.groups.together(a.name, b.name):
        raise ValueError(f"{a.name} and {b.name} aren't in one group")
    rows, others = left.base(), right.base().withColumnRenamed(SHARD, "_other_shard_id")
    return rows.join(others, rows[left_key] == others[right_key])
