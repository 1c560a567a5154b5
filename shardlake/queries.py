"""Every operator as a query over the TPC-H-like tables, and the SQL that it must agree with.

Three shards; ``orders`` is placed by o_orderkey modulo 3, ``events`` and some others by rings or
ranges where the query says so. Nulls and childless parents are derived, since the tables have none.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.routing import ConsistentHash, Modulo, Ranges, Ring, Router, TableGroups, distribution
from .functions.uuid7 import decoded_shard, shard_number_of, timestamp_ms_of
from .operators.metrics import hotspots, slow_shards
from .operators.ops import pending_steps
from .operators.paging import cursor_frame, page_frame
from .operators.relations import Relation, colocated_join, has_many, has_one, parents_with_children, top_children, with_children, with_count, with_parent
from .plans.context import Engine
from .plans.query import ShardQuery, average, total
from .sources.catalog import SHARD, CentralTable, Connections, ShardedTable, bucket_count, read_placed, rebalance, scratch
from .streaming.iterate import chunk, chunk_by_id, lazy, map_batches
from .topology import Shard, ShardSet

Query = Callable[[SparkSession, str], DataFrame]
SHARDS = ShardSet.numbered(3)
RANGED = ShardSet([Shard("low", metadata={"start": 0, "end": 300}), Shard("mid", metadata={"start": 300, "end": 900}), Shard("top")])
WEIGHTED = ShardSet([Shard("shard-1", weight=1), Shard("shard-2", weight=2), Shard("shard-3", weight=3)])

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sharded(spark: SparkSession, sf_dir: str, name: str, key: str, primary: str | None = None, engine: Engine | None = None, frame: DataFrame | None = None) -> ShardedTable:
    return ShardedTable(engine or Engine(SHARDS, Modulo()), name, read(spark, sf_dir, name) if frame is None else frame, shard_key=key, primary_key=primary)


def orders(spark: SparkSession, sf_dir: str, engine: Engine | None = None) -> ShardQuery:
    return sharded(spark, sf_dir, "orders", "o_orderkey", engine=engine).query()


def holed(spark: SparkSession, sf_dir: str) -> ShardQuery:
    """orders whose finished ones have no price, so that nulls are met."""
    frame = read(spark, sf_dir, "orders").withColumn("price", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")))
    return sharded(spark, sf_dir, "orders", "o_orderkey", frame=frame).query()


def lines(spark: SparkSession, sf_dir: str, engine: Engine | None = None) -> ShardQuery:
    return sharded(spark, sf_dir, "lineitem", "l_orderkey", engine=engine).query()


def events(spark: SparkSession, sf_dir: str, engine: Engine | None = None) -> ShardQuery:
    return sharded(spark, sf_dir, "events", "user_id", "event_id", engine).query()


OF_ORDER = "'shard-' || (abs(o_orderkey) % 3 + 1)"
OF_EVENT = "'shard-' || (abs(user_id) % 3 + 1)"
HOLED = "(SELECT *, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS price FROM orders)"
COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
LISTED = ", ".join(COLUMNS)


# ---- scans and views


@query(f"SELECT {LISTED}, {OF_ORDER} AS _shard_id FROM orders")
def scan_all(spark, sf_dir):
    return orders(spark, sf_dir).get(*COLUMNS, SHARD)


@query(f"SELECT {LISTED}, {OF_ORDER} AS _shard_id FROM orders WHERE {OF_ORDER} = 'shard-2'")
def scan_one_shard(spark, sf_dir):
    return orders(spark, sf_dir).on_shard("shard-2").get(*COLUMNS, SHARD)


@query(f"SELECT {LISTED}, {OF_ORDER} AS _shard_id FROM orders WHERE {OF_ORDER} IN ('shard-1', 'shard-3')")
def scan_only(spark, sf_dir):
    return orders(spark, sf_dir).only(["shard-1", "shard-3", "unknown"]).get(*COLUMNS, SHARD)


@query(f"SELECT {LISTED}, {OF_ORDER} AS _shard_id FROM orders WHERE {OF_ORDER} <> 'shard-1'")
def scan_except(spark, sf_dir):
    return orders(spark, sf_dir).except_(["shard-1"]).get(*COLUMNS, SHARD)


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def scan_central(spark, sf_dir):
    engine = Engine(SHARDS, Modulo())
    central = CentralTable(Connections(spark, {"path": sf_dir}), engine, "customer")
    with engine.on("shard-2"):  # a current shard changes nothing
        return central.get("c_custkey", "c_name", "c_nationkey")


@query(f"SELECT {LISTED}, {OF_ORDER} AS _shard_id FROM orders WHERE o_totalprice > 1000")
def unified_view(spark, sf_dir):
    view = sharded(spark, sf_dir, "orders", "o_orderkey").create_view("all_orders_by_shard")
    return spark.sql(f"SELECT {LISTED}, _shard_id FROM {view} WHERE o_totalprice > 1000")


@query(f"SELECT {OF_ORDER} AS _shard_id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def union_of_loaders(spark, sf_dir):
    frame = sharded(spark, sf_dir, "orders", "o_orderkey").rows()
    loaders = {s.id: functools.partial(lambda i: frame.where(F.col(SHARD) == i).drop(SHARD), s.id) for s in SHARDS}
    table = ShardedTable(Engine(SHARDS, Modulo()), "orders", loaders=loaders, shard_key="o_orderkey")
    return table.query().group_by(SHARD, n=F.count("*"), total=F.round(F.sum("o_totalprice"), 2))


@query(f"SELECT {OF_ORDER} AS _shard_id, count(*) AS n FROM orders WHERE {OF_ORDER} <> 'shard-3' GROUP BY 1")
def tolerant_scan(spark, sf_dir):
    frame = sharded(spark, sf_dir, "orders", "o_orderkey").rows()
    loaders = {s.id: functools.partial(lambda i: frame.where(F.col(SHARD) == i).drop(SHARD), s.id) for s in SHARDS}
    loaders["shard-3"] = lambda: spark.read.parquet(f"{sf_dir}/no-such-shard.parquet")
    table = ShardedTable(Engine(SHARDS, Modulo(), config={"dead_shard_tolerance": True}), "orders", loaders=loaders, shard_key="o_orderkey")
    return table.query().group_by(SHARD, n=F.count("*"))


# ---- predicates


@query(f"SELECT {LISTED} FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey = 7")
def filter_in(spark, sf_dir):
    return orders(spark, sf_dir).where("o_custkey", 7).where_in("o_orderstatus", ["F", "P"]).get(*COLUMNS)


@query(f"SELECT o_orderkey, price FROM {HOLED} WHERE price NOT IN (0) AND o_custkey < 50")
def filter_not_in(spark, sf_dir):
    return holed(spark, sf_dir).where("o_custkey", "<", 50).where_not_in("price", [0]).get("o_orderkey", "price")


@query(f"SELECT o_orderkey, price FROM {HOLED} WHERE price NOT IN (0)")
def filter_not_in_whole(spark, sf_dir):
    return holed(spark, sf_dir).where_not_in("price", [0]).get("o_orderkey", "price")


@query(f"SELECT o_orderkey FROM {HOLED} WHERE price IS NULL")
def filter_null(spark, sf_dir):
    return holed(spark, sf_dir).where_null("price").get("o_orderkey")


@query(f"SELECT o_orderkey, price FROM {HOLED} WHERE price IS NOT NULL")
def filter_not_null(spark, sf_dir):
    return holed(spark, sf_dir).where_not_null("price").get("o_orderkey", "price")


@query(f"SELECT {LISTED} FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
def filter_between(spark, sf_dir):
    return orders(spark, sf_dir).where_between("o_totalprice", 1000, 50000).get(*COLUMNS)


@query(f"SELECT {LISTED} FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F' OR o_totalprice < 2000")
def filter_or_precedence(spark, sf_dir):
    return orders(spark, sf_dir).where("o_custkey", 7).where("o_orderstatus", "F").or_where("o_totalprice", "<", 2000).get(*COLUMNS)


@query(f"SELECT {LISTED} FROM orders WHERE o_custkey = 7 AND (o_orderstatus = 'F' OR o_totalprice < 2000)")
def filter_group(spark, sf_dir):
    return orders(spark, sf_dir).where("o_custkey", 7).where(lambda g: g.where("o_orderstatus", "F").or_where("o_totalprice", "<", 2000)).get(*COLUMNS)


@query(f"SELECT {LISTED} FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O'")
def filter_map(spark, sf_dir):
    return orders(spark, sf_dir).where({"o_custkey": 7, "o_orderstatus": "O"}).get(*COLUMNS)


@query(f"SELECT {LISTED} FROM orders WHERE o_orderkey = 42")
def find_by_key(spark, sf_dir):
    return orders(spark, sf_dir).find_frame(42, *COLUMNS)


@query("SELECT DISTINCT o_orderpriority FROM orders")
def pluck_column(spark, sf_dir):
    return orders(spark, sf_dir).pluck_frame("o_orderpriority").distinct()


@query(
    f"""SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority
    ORDER BY {OF_ORDER} DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1"""
)
def pluck_keyed(spark, sf_dir):
    return orders(spark, sf_dir).pluck_frame("o_orderkey", "o_orderpriority")


@query(f"SELECT {LISTED} FROM orders ORDER BY o_totalprice DESC, {OF_ORDER}, o_orderkey LIMIT 1")
def first_ordered(spark, sf_dir):
    return orders(spark, sf_dir).order_by_desc("o_totalprice").first_frame(*COLUMNS)


@query(f"SELECT {LISTED} FROM orders WHERE o_custkey > 20 ORDER BY {OF_ORDER}, o_orderkey LIMIT 1")
def first_unordered(spark, sf_dir):
    return orders(spark, sf_dir).where("o_custkey", ">", 20).in_shard_order().first_frame(*COLUMNS)


@query("SELECT CAST(1 AS BIGINT) AS n, CAST(1 AS BIGINT) AS met FROM orders WHERE o_custkey > 20 LIMIT 1")
def first_of_any(spark, sf_dir):
    """Which row comes first is open without an order; how many, and that they meet the condition, isn't."""
    return orders(spark, sf_dir).where("o_custkey", ">", 20).first_frame("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_custkey") > 20).alias("met"))


@query("SELECT count(*) > 0 AS found FROM orders WHERE o_totalprice < 0")
def exists_none(spark, sf_dir):
    return orders(spark, sf_dir).where("o_totalprice", "<", 0).exists_frame("found")


@query("SELECT count(*) > 0 AS found FROM orders WHERE o_orderstatus = 'F'")
def exists_any(spark, sf_dir):
    return orders(spark, sf_dir).where("o_orderstatus", "F").exists_frame("found")


# ---- aggregates


@query("SELECT count(*) AS n FROM orders")
def agg_count(spark, sf_dir):
    return orders(spark, sf_dir).count_frame(name="n")


@query(f"SELECT count(price) AS n FROM {HOLED}")
def agg_count_column(spark, sf_dir):
    return holed(spark, sf_dir).count_frame("price", "n")


@query("SELECT round(coalesce(sum(o_totalprice), 0), 2) AS total FROM orders")
def agg_sum(spark, sf_dir):
    return orders(spark, sf_dir).aggregate_frame(total=F.round(total("o_totalprice"), 2))


@query(f"SELECT round(coalesce(sum(price), 0) / count(*), 4) AS mean FROM {HOLED}")
def agg_avg_scatter(spark, sf_dir):
    return holed(spark, sf_dir).aggregate_frame(mean=F.round(average("price"), 4))


@query(f"SELECT round(avg(price), 4) AS mean FROM {HOLED}")
def agg_avg_null_aware(spark, sf_dir):
    return holed(spark, sf_dir).avg_frame("price", "mean", null_aware=True).select(F.round("mean", 4).alias("mean"))


@query(f"SELECT min(price) AS low FROM {HOLED}")
def agg_min(spark, sf_dir):
    return holed(spark, sf_dir).min_frame("price", "low")


@query("SELECT max(o_totalprice) AS high, max(o_orderdate) AS last FROM orders")
def agg_max(spark, sf_dir):
    return orders(spark, sf_dir).aggregate_frame(high=F.max("o_totalprice"), last=F.max("o_orderdate"))


@query("SELECT CAST(0 AS DOUBLE) AS total, CAST(0 AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS low, CAST(0 AS BIGINT) AS n")
def agg_of_nothing(spark, sf_dir):
    return orders(spark, sf_dir).where("o_custkey", "<", -1).aggregate_frame(total=total("o_totalprice"), mean=average("o_totalprice"), low=F.min("o_totalprice"), n=F.count("*"))


@query(
    """SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'F') AS done,
    count(*) FILTER (WHERE o_orderstatus = 'P') AS pending, count(*) FILTER (WHERE o_totalprice > 100000) AS large FROM orders"""
)
def dashboard_counts(spark, sf_dir):
    status = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return orders(spark, sf_dir).aggregate_frame(n=F.count("*"), open=status("O"), done=status("F"), pending=status("P"), large=F.count_if(F.col("o_totalprice") > 100000))


@query(f"SELECT s.shard_id, CAST(count(o_orderkey) AS BIGINT) AS n FROM (VALUES ('shard-1'), ('shard-2'), ('shard-3')) s(shard_id) LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 <> 1) o ON {OF_ORDER} = s.shard_id GROUP BY 1")
def count_by_shard(spark, sf_dir):
    return orders(spark, sf_dir).where(F.col("o_orderkey") % 3 != 1).counts_by_shard()


@query(f"SELECT {OF_ORDER} AS _shard_id, o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def rows_by_shard(spark, sf_dir):
    return orders(spark, sf_dir).where("o_totalprice", ">", 200000).by_shard_frame("o_orderkey", "o_totalprice")


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def group_by_merge(spark, sf_dir):
    return orders(spark, sf_dir).group_by("o_orderpriority", n=F.count("*"), total=F.round(F.sum("o_totalprice"), 2))


@query(f"SELECT {OF_ORDER} AS _shard_id, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def group_by_shard(spark, sf_dir):
    return orders(spark, sf_dir).group_by(SHARD, "o_orderstatus", n=F.count("*"))


# ---- order, limits, pages


@query(f"SELECT {LISTED} FROM orders WHERE o_custkey <= 20")
def order_multi_key(spark, sf_dir):
    return orders(spark, sf_dir).where("o_custkey", "<=", 20).order_by("o_orderstatus").order_by_desc("o_totalprice").get(*COLUMNS)


@query(f"SELECT {LISTED} FROM orders")
def order_multi_key_whole(spark, sf_dir):
    return orders(spark, sf_dir).order_by("o_orderstatus").order_by_desc("o_totalprice").get(*COLUMNS)


@query(f"SELECT {LISTED} FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, sf_dir):
    return orders(spark, sf_dir).order_by_desc("o_totalprice").order_by("o_orderkey").limit(25).get(*COLUMNS)


@query(f"SELECT {LISTED} FROM orders ORDER BY o_orderstatus, o_orderkey LIMIT 20 OFFSET 40")
def offset_limit(spark, sf_dir):
    return orders(spark, sf_dir).order_by("o_orderstatus").order_by("o_orderkey").offset(40).limit(20).get(*COLUMNS)


@query(f"SELECT {LISTED} FROM orders ORDER BY {OF_ORDER}, o_orderkey LIMIT 30")
def limit_unordered(spark, sf_dir):
    return orders(spark, sf_dir).in_shard_order().limit(30).get(*COLUMNS)


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS different FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' LIMIT 30)")
def limit_of_any(spark, sf_dir):
    rows = orders(spark, sf_dir).where("o_orderstatus", "O").limit(30).get("o_orderkey", "o_orderstatus")
    return rows.agg(F.count_if(F.col("o_orderstatus") == "O").alias("n"), F.count_distinct("o_orderkey").alias("different"))


@query(f"SELECT o_orderkey, price FROM {HOLED} ORDER BY price ASC NULLS FIRST, o_orderkey LIMIT 30")
def order_nulls_first(spark, sf_dir):
    return holed(spark, sf_dir).order_by("price").order_by("o_orderkey").limit(30).get("o_orderkey", "price")


@query(f"SELECT {LISTED} FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def latest(spark, sf_dir):
    return orders(spark, sf_dir).latest("o_orderdate").order_by("o_orderkey").take(10).get(*COLUMNS)


@query(f"SELECT {LISTED} FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10 OFFSET 5")
def oldest(spark, sf_dir):
    return orders(spark, sf_dir).oldest("o_orderdate").order_by("o_orderkey").skip(5).take(10).get(*COLUMNS)


@query(f"SELECT {LISTED} FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 60")
def page_5(spark, sf_dir):
    return page_frame(orders(spark, sf_dir).order_by_desc("o_totalprice").order_by("o_orderkey"), 5, 15, *COLUMNS)


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 15.0) AS BIGINT) AS last_page FROM orders WHERE o_orderstatus = 'F'")
def page_total(spark, sf_dir):
    return orders(spark, sf_dir).where("o_orderstatus", "F").aggregate_frame(total=F.count("*"), last_page=F.ceil(F.count("*") / 15))


@query("SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 15")
def keyset_first(spark, sf_dir):
    return cursor_frame(events(spark, sf_dir), 15, "event_id", "asc", None, "event_id", "user_id", "value")


@query("SELECT event_id, user_id, value FROM events WHERE event_id > 400 ORDER BY event_id LIMIT 15")
def keyset_next(spark, sf_dir):
    return cursor_frame(events(spark, sf_dir), 15, "event_id", "asc", 400, "event_id", "user_id", "value")


@query("SELECT event_id, user_id, value FROM events WHERE event_id < 400 ORDER BY event_id DESC LIMIT 15")
def keyset_down(spark, sf_dir):
    return cursor_frame(events(spark, sf_dir), 15, "event_id", "desc", 400, "event_id", "user_id", "value")


# ---- routing and pruning


@query("SELECT count(*) AS n FROM orders WHERE o_orderkey = 77")
def colocated_count(spark, sf_dir):
    return orders(spark, sf_dir).where("o_orderkey", 77).count_frame(name="n")


@query("SELECT event_id, user_id, event_type FROM events WHERE user_id = 17")
def colocated_rows(spark, sf_dir):
    return events(spark, sf_dir).where("user_id", 17).get("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (3, 6, 9)")
def colocated_in(spark, sf_dir):
    return events(spark, sf_dir).where_in("user_id", [3, 6, 9]).get("event_id", "user_id")


@query("SELECT event_id, user_id FROM events WHERE user_id = 17")
def colocated_ring(spark, sf_dir):
    return events(spark, sf_dir, Engine(SHARDS, ConsistentHash())).where("user_id", 17).get("event_id", "user_id")


@query("SELECT count(*) AS n FROM orders WHERE o_orderkey = 42")
def pinned_by_text_modulo(spark, sf_dir):
    """A number given as text finds the number's rows, on the shard where they are."""
    return orders(spark, sf_dir).where("o_orderkey", "42").count_frame(name="n")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (7, 301)")
def pinned_by_text_range(spark, sf_dir):
    return sharded(spark, sf_dir, "customer", "c_custkey", engine=Engine(RANGED, Ranges())).query().where_in("c_custkey", ["7", " 301 "]).get("c_custkey", "c_name")


@query("SELECT event_id, user_id FROM events WHERE user_id = 17")
def pinned_by_text_ring(spark, sf_dir):
    return events(spark, sf_dir, Engine(SHARDS, ConsistentHash())).where("user_id", "17").get("event_id", "user_id")


def _ring_values(shards: ShardSet, nodes: int = 150) -> str:
    rows = Ring(shards, nodes, "md5").intervals()
    return ", ".join(f"('{a}', '{b}', '{o}')" for a, b, o in rows)


def _ring_sql(shards: ShardSet, table: str, key: str) -> str:
    listed = ", ".join(f"('{i}')" for i in shards.ids())
    return f"""WITH ring(after, upto, owner) AS (VALUES {_ring_values(shards)}),
      placed AS (SELECT owner FROM {table} JOIN ring ON md5({key}) > after AND md5({key}) <= upto)
      SELECT s.shard_id, CAST(count(owner) AS BIGINT) AS n FROM (VALUES {listed}) s(shard_id) LEFT JOIN placed ON owner = shard_id GROUP BY 1"""


@query(_ring_sql(SHARDS, "orders", "CAST(o_orderkey AS VARCHAR)"))
def ring_md5_count_by_shard(spark, sf_dir):
    return distribution(read(spark, sf_dir, "orders"), "o_orderkey", Router(SHARDS, ConsistentHash(algorithm="md5")))


@query(_ring_sql(WEIGHTED, "orders", "CAST(o_orderkey AS VARCHAR)"))
def ring_weighted_distribution(spark, sf_dir):
    return distribution(read(spark, sf_dir, "orders"), "o_orderkey", Router(WEIGHTED, ConsistentHash(algorithm="md5")))


@query()
def ring_xxh128_count_by_shard(spark, sf_dir):
    return distribution(read(spark, sf_dir, "orders"), "o_orderkey", Router(SHARDS, ConsistentHash(algorithm="xxh128")))


@query("SELECT c_custkey, CASE WHEN c_custkey >= 0 AND c_custkey < 300 THEN 'low' WHEN c_custkey >= 300 AND c_custkey < 900 THEN 'mid' ELSE 'top' END AS _shard_id FROM customer")
def range_route(spark, sf_dir):
    return sharded(spark, sf_dir, "customer", "c_custkey", engine=Engine(RANGED, Ranges())).query().get("c_custkey", SHARD)


@query("SELECT c_custkey, 'shard-' || (abs(c_custkey - 700) % 3 + 1) AS _shard_id FROM customer")
def modulo_route(spark, sf_dir):
    shifted = read(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey") - 700)
    return sharded(spark, sf_dir, "customer", "k", engine=Engine(SHARDS, Modulo()), frame=shifted).query().get("c_custkey", SHARD)


@query()
def modulo_route_text(spark, sf_dir):
    return sharded(spark, sf_dir, "customer", "c_name", "c_custkey").query().get("c_custkey", "c_name", SHARD)


GROUPED = TableGroups({"orders": ["orders", "lineitem"]})


@query(
    f"""WITH ring(after, upto, owner) AS (VALUES {_ring_values(SHARDS)})
    SELECT o_orderkey, owner AS _shard_id FROM orders JOIN ring ON md5('orders:' || o_orderkey) > after AND md5('orders:' || o_orderkey) <= upto"""
)
def group_route(spark, sf_dir):
    return orders(spark, sf_dir, Engine(SHARDS, ConsistentHash(algorithm="md5"), GROUPED)).get("o_orderkey", SHARD)


@query(f"SELECT o_orderkey, {OF_ORDER} AS _shard_id, 'shard-' || (abs(o_orderkey) % 4 + 1) AS _new_shard_id FROM orders WHERE abs(o_orderkey) % 3 <> abs(o_orderkey) % 4")
def rebalance_moves(spark, sf_dir):
    moved = rebalance(sharded(spark, sf_dir, "orders", "o_orderkey"), Engine(ShardSet.numbered(4), Modulo()))
    return moved.select("o_orderkey", SHARD, "_new_shard_id")


# ---- relationships

CUSTOMER_ORDERS = ("o_custkey", "c_custkey")


def customers(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")


def of_customer(spark, sf_dir, large: bool = True) -> tuple[Relation, ShardQuery]:
    children = orders(spark, sf_dir)
    return Relation(children.table, *CUSTOMER_ORDERS), children.where("o_totalprice", ">", 400000) if large else children


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3")
def has_many_all(spark, sf_dir):
    relation, children = of_customer(spark, sf_dir, False)
    return has_many(customers(spark, sf_dir).where("c_nationkey = 3"), relation, children).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey")
def has_many_whole(spark, sf_dir):
    relation, children = of_customer(spark, sf_dir, False)
    return has_many(customers(spark, sf_dir), relation, children).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query(f"SELECT {LISTED} FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 5 OFFSET 1")
def has_many_of_one(spark, sf_dir):
    relation, _ = of_customer(spark, sf_dir)
    return relation.of(7).where("o_orderstatus", "F").order_by_desc("o_totalprice").order_by("o_orderkey").offset(1).limit(5).get(*COLUMNS)


@query(f"SELECT {LISTED} FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F' OR o_totalprice < 2000")
def has_many_or_where(spark, sf_dir):
    relation, _ = of_customer(spark, sf_dir)
    return relation.of(7).where("o_orderstatus", "F").or_where("o_totalprice", "<", 2000).get(*COLUMNS)


@query("SELECT count(*) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders WHERE o_custkey = 7")
def has_many_aggregates(spark, sf_dir):
    relation, _ = of_customer(spark, sf_dir)
    return relation.of(7).aggregate_frame(n=F.count("*"), total=F.round(total("o_totalprice"), 2), low=F.min("o_totalprice"), high=F.max("o_totalprice"))


@query(
    """SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT c_custkey, o_orderkey, o_totalprice,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey) WHERE n <= 3"""
)
def has_many_top_n(spark, sf_dir):
    relation, children = of_customer(spark, sf_dir, False)
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]
    return top_children(customers(spark, sf_dir), relation, order, 3, children).select("c_custkey", "o_orderkey", "o_totalprice")


@query(
    f"""SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey
    ORDER BY {OF_ORDER}, o_orderkey) AS n FROM orders WHERE o_totalprice > 400000) ON o_custkey = c_custkey AND n = 1"""
)
def has_one_first_shard(spark, sf_dir):
    relation, children = of_customer(spark, sf_dir)
    return has_one(customers(spark, sf_dir), relation, children).select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS orders_count FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON o_custkey = c_custkey GROUP BY 1")
def with_count_large(spark, sf_dir):
    relation, children = of_customer(spark, sf_dir)
    return with_count(customers(spark, sf_dir), relation, "orders_count", children).select("c_custkey", "orders_count")


@query("SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n_orders, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderkey), '') AS keys FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON o_custkey = c_custkey GROUP BY 1")
def eager_children(spark, sf_dir):
    relation, _ = of_customer(spark, sf_dir)
    found = with_children(customers(spark, sf_dir), relation, "orders", ["o_orderkey"], orders(spark, sf_dir).where("o_totalprice", ">", 300000))
    return found.select("c_custkey", F.size("orders").cast("long").alias("n_orders"), F.concat_ws(",", F.transform("orders", lambda o: o["o_orderkey"].cast("string"))).alias("keys"))


@query("SELECT o_orderkey, c_name AS customer_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 20) ON o_custkey = c_custkey WHERE o_totalprice > 150000")
def with_parent_customer(spark, sf_dir):
    parents = customers(spark, sf_dir).where("c_nationkey < 20")
    rows = orders(spark, sf_dir).where("o_totalprice", ">", 150000).attach(lambda r: with_parent(r, parents, "o_custkey", "c_custkey", "customer", ["c_name"])).get()
    return rows.select("o_orderkey", F.col("customer.c_name").alias("customer_name"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join_parents(spark, sf_dir):
    relation, children = of_customer(spark, sf_dir)
    return parents_with_children(customers(spark, sf_dir), relation, children).select("c_custkey", "c_name")


@query("SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def colocated_join_lines(spark, sf_dir):
    engine = Engine(SHARDS, ConsistentHash(algorithm="md5"), GROUPED)
    joined = colocated_join(orders(spark, sf_dir, engine), lines(spark, sf_dir, engine), "o_orderkey", "l_orderkey")
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


# ---- tables that were written by shard


def _saved(spark, sf_dir, name: str, key: str, primary: str | None = None) -> ShardedTable:
    """The table saved by shard and key in buckets, once for each session and folder of tables."""
    engine = Engine(SHARDS, ConsistentHash(), GROUPED)
    saved = f"shardlake_{name}_{zlib.crc32(sf_dir.encode()):08x}_{spark.sparkContext.applicationId.replace('-', '_')}"
    if not spark.catalog.tableExists(saved):
        buckets = bucket_count(*(read(spark, sf_dir, t) for t in ("orders", "lineitem")))  # the whole group's, so that its tables meet
        sharded(spark, sf_dir, name, key, primary, engine).save(read(spark, sf_dir, name), saved, scratch(spark, saved), buckets)
    return ShardedTable(engine, name, spark.table(saved), shard_key=key, primary_key=primary)


@query("SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def colocated_join_saved(spark, sf_dir):
    """Both sides come bucketed by key, so that neither is shuffled for the join."""
    left, right = _saved(spark, sf_dir, "orders", "o_orderkey").query(), _saved(spark, sf_dir, "lineitem", "l_orderkey").query()
    joined = colocated_join(left, right, "o_orderkey", "l_orderkey")
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 77")
def pinned_read_saved(spark, sf_dir):
    """One shard's folder and one bucket of it are read."""
    return _saved(spark, sf_dir, "lineitem", "l_orderkey").query().where("l_orderkey", 77).get("l_orderkey", "l_linenumber", "l_quantity")


@query(f"SELECT {OF_ORDER} AS _shard_id, count(*) AS n, sum(o_custkey) AS customers FROM orders GROUP BY 1")
def write_and_read(spark, sf_dir):
    """Rows written to their shards' folders and read back."""
    table = sharded(spark, sf_dir, "orders", "o_orderkey")
    path = scratch(spark, "orders")
    table.write(read(spark, sf_dir, "orders"), path)
    return read_placed(table.engine, spark, "orders", path, shard_key="o_orderkey").query().group_by(SHARD, n=F.count("*"), customers=F.sum("o_custkey"))


@query(f"SELECT {OF_ORDER} AS _shard_id, count(*) AS n, count(*) AS own_shard, count(*) AS different FROM orders GROUP BY 1")
def uuid_on_insert(spark, sf_dir):
    """Every row gets a UUID of its own that carries its shard."""
    frame = read(spark, sf_dir, "orders").withColumn("uuid", F.lit(None).cast("string"))
    table = sharded(spark, sf_dir, "orders", "o_orderkey", frame=frame)
    path = scratch(spark, "uuids")
    table.write(frame, path, uuid_column="uuid")
    own = F.count_if(decoded_shard(F.col("uuid"), SHARDS) == F.col(SHARD))
    return spark.read.parquet(path).groupBy(SHARD).agg(F.count("*").alias("n"), own.alias("own_shard"), F.count_distinct("uuid").alias("different"))


@query("SELECT count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders WHERE o_custkey = 7")
def children_created(spark, sf_dir):
    """Children of one parent written through the relationship, each to its shard, and read back through it."""
    table = sharded(spark, sf_dir, "orders", "o_orderkey")
    path = scratch(spark, "children")
    mine = read(spark, sf_dir, "orders").where("o_custkey = 7").drop("o_custkey")
    Relation(table, *CUSTOMER_ORDERS).create(7, mine, path)
    placed = read_placed(table.engine, spark, "orders", path, shard_key="o_orderkey")
    return Relation(placed, *CUSTOMER_ORDERS).of(7).aggregate_frame(n=F.count("*"), first=F.min("o_orderkey"), last=F.max("o_orderkey"))


# ---- reading in chunks


def _told(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "shard_id string, part long, n long, low long, high long")


@query(
    f"""SELECT shard_id, part, count(*) AS n, min(c_custkey) AS low, max(c_custkey) AS high FROM (SELECT c_custkey, 'shard-' || (abs(c_custkey) % 3 + 1) AS shard_id,
    (row_number() OVER (PARTITION BY abs(c_custkey) % 3 ORDER BY c_custkey) - 1) // 100 AS part FROM customer) GROUP BY 1, 2"""
)
def chunks_by_id(spark, sf_dir):
    told: list[tuple] = []
    parts: Counter[str] = Counter()

    def do(rows, shard):
        told.append((shard.id, parts[shard.id], len(rows), rows[0].c_custkey, rows[-1].c_custkey))
        parts[shard.id] += 1

    chunk_by_id(sharded(spark, sf_dir, "customer", "c_custkey").query(), 100, do, "c_custkey")
    return _told(spark, told)


@query("SELECT 'shard-' || (abs(c_custkey) % 3 + 1) AS shard_id, count(*) AS n, min(c_custkey) AS low, max(c_custkey) AS high FROM customer GROUP BY 1")
def chunks_of_shards(spark, sf_dir):
    """Chunks of at most 100 rows, shard by shard; what they add up to."""
    told: list[tuple] = []
    chunk(sharded(spark, sf_dir, "customer", "c_custkey").query(), 100, lambda rows, s: told.append((s.id, 0, len(rows), min(r.c_custkey for r in rows), max(r.c_custkey for r in rows))))
    if any(n > 100 for _, _, n, _, _ in told):
        raise ValueError("a chunk is too large")
    return _told(spark, told).groupBy("shard_id").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


@query("SELECT 'shard-' || (abs(s_suppkey) % 3 + 1) AS shard_id, count(*) AS n, min(s_suppkey) AS low, max(s_suppkey) AS high FROM supplier GROUP BY 1")
def lazy_rows(spark, sf_dir):
    rows = lazy(sharded(spark, sf_dir, "supplier", "s_suppkey").query(), "s_suppkey", SHARD)
    frame = spark.createDataFrame([(r[SHARD], 0, 1, r.s_suppkey, r.s_suppkey) for r in rows], "shard_id string, part long, n long, low long, high long")
    return frame.groupBy("shard_id").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


@query(f"SELECT {OF_ORDER} AS shard_id, count(*) AS n, max(o_orderkey) AS high FROM orders GROUP BY 1")
def batches_of_shards(spark, sf_dir):
    """A function of each batch of a shard's rows, run where the rows are."""
    of = lambda shard_id, rows: pd.DataFrame({"shard_id": [shard_id], "n": [len(rows)], "high": [rows["o_orderkey"].max()]})
    return map_batches(orders(spark, sf_dir), of, "shard_id string, n long, high long").groupBy("shard_id").agg(F.sum("n").alias("n"), F.max("high").alias("high"))


@query(f"SELECT {OF_ORDER} AS shard_id, count(*) AS n FROM orders WHERE {OF_ORDER} <> 'shard-3' GROUP BY 1")
def tolerant_jobs(spark, sf_dir):
    """A job for each shard; one breaks off in the middle of its scan and is left out."""
    engine = Engine(SHARDS, Modulo(), config={"dead_shard_tolerance": True})
    query = orders(spark, sf_dir, engine)
    broken = F.when(F.col("o_orderkey") > 100, F.raise_error(F.lit("the shard went away"))).otherwise(0)

    def count(shard):
        rows = query.on_shard(shard).get("o_orderkey")
        return rows.agg(F.sum(broken if shard.id == "shard-3" else F.lit(0)), F.count("*").alias("n")).first()["n"]

    found, _ = engine.run_tolerantly(count)
    return spark.createDataFrame(list(found.items()), "shard_id string, n long")


@query(
    """SELECT n_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM nation
    JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1"""
)
def team_report(spark, sf_dir):
    relation, _ = of_customer(spark, sf_dir)
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    owned = has_many(customers(spark, sf_dir).join(nation, F.col("c_nationkey") == F.col("n_nationkey")), relation, orders(spark, sf_dir).where("o_orderstatus", "F"))
    rows = lines(spark, sf_dir).get("l_orderkey", "l_extendedprice", "l_discount")
    # Lines meet the orders that are left; sums of each order then follow the join's own shuffle.
    joined = owned.select("n_name", "o_orderkey").join(rows, F.col("o_orderkey") == F.col("l_orderkey"))
    by_order = joined.groupBy("o_orderkey", "n_name").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    return by_order.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("revenue"), 2).alias("revenue"))


# ---- UUIDs

def _uuids(spark, sf_dir) -> DataFrame:
    tail = F.lpad(F.lower(F.hex(F.col("o_orderkey") * 1029)), 12, "0")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("018f0000-0000-7000-8000-"), tail).alias("uuid"))


@query("SELECT o_orderkey, CAST((o_orderkey * 1029) % 65536 % 1024 AS INTEGER) AS shard_number, CAST(1713691951104 AS BIGINT) AS ms FROM orders")
def uuid_extract_shard(spark, sf_dir):
    return _uuids(spark, sf_dir).select("o_orderkey", shard_number_of(F.col("uuid")).alias("shard_number"), timestamp_ms_of(F.col("uuid")).alias("ms"))


@query("SELECT o_orderkey, CASE (o_orderkey * 1029) % 1024 WHEN 1 THEN 'shard-1' WHEN 2 THEN 'shard-2' WHEN 3 THEN 'shard-3' WHEN 0 THEN 'shard-1' END AS shard_id FROM orders")
def uuid_decode_shard(spark, sf_dir):
    return _uuids(spark, sf_dir).select("o_orderkey", decoded_shard(F.col("uuid"), SHARDS).alias("shard_id"))


# ---- metrics and migrations


def _logged(spark, sf_dir) -> DataFrame:
    """events as a query log whose first shard gets most."""
    return read(spark, sf_dir, "events").withColumn(SHARD, F.when(F.col("user_id") % 10 < 7, "shard-1").otherwise(F.concat(F.lit("shard-"), (F.col("user_id") % 10 - 5).cast("string"))))


_LOGGED = "(SELECT *, CASE WHEN user_id % 10 < 7 THEN 'shard-1' ELSE 'shard-' || (user_id % 10 - 5) END AS s FROM events)"


@query(f"WITH c AS (SELECT s AS shard_id, count(*) AS queries FROM {_LOGGED} GROUP BY 1), m AS (SELECT avg(queries) AS mean FROM c) SELECT shard_id, queries, round(queries / mean, 2) AS ratio FROM c, m WHERE queries / mean >= 2.0")
def hotspot_shards(spark, sf_dir):
    return hotspots(_logged(spark, sf_dir))


@query(f"SELECT s AS shard_id, round(avg(value), 2) AS average_ms FROM {_LOGGED} GROUP BY 1 HAVING avg(value) >= 1.0")
def slow_shard_report(spark, sf_dir):
    return slow_shards(_logged(spark, sf_dir), "value", threshold_ms=1.0)


@query("SELECT 'shard-' || s AS shard_id, n_name AS migration FROM range(1, 4) t(s), nation WHERE NOT (n_nationkey % 3 = s - 1)")
def pending_migrations(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    shard = F.explode(F.array(*(F.lit(i) for i in SHARDS.ids()))).alias("shard_id")
    every = nation.select(shard, F.col("n_name").alias("migration"))
    ran = nation.select(F.concat(F.lit("shard-"), (F.col("n_nationkey") % 3 + 1).cast("string")).alias("shard_id"), F.col("n_name").alias("migration"))
    return pending_steps(every, ran)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and revenue by shard."""
    return orders(spark, sf_dir).group_by(SHARD, n=F.count("*"), revenue=F.round(F.sum("o_totalprice"), 2)).orderBy(SHARD)


from . import state_queries  # noqa: E402, F401  registers its queries here
