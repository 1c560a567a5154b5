from __future__ import annotations

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardlake.functions.routing import ConsistentHash, Modulo, Ranges, Ring, Router, TableGroups, distribution, strategy_from_config
from shardlake.topology import Shard, ShardingError, ShardSet

THREE = ShardSet.numbered(3)
RANGED = ShardSet([Shard("a", metadata={"start": 0, "end": 10}), Shard("b", metadata={"start": 10, "end": 20}), Shard("c")])
GOLDEN = {
    "user:123": ("shard-2", "shard-3", "shard-3"),
    "user:456": ("shard-2", "shard-1", "shard-1"),
    "5": ("shard-1", "shard-1", "shard-2"),
    "42": ("shard-1", "shard-2", "shard-1"),
    "key:123": ("shard-2", "shard-2", "shard-2"),
    "users:key:123": ("shard-1", "shard-3", "shard-1"),
}


def test_golden_routes():
    for key, owners in GOLDEN.items():
        found = tuple(ConsistentHash(algorithm=a).route(key, THREE).id for a in ("xxh128", "md5", "sha256"))
        assert found == owners


def test_ring_nodes_weights_and_balance():
    assert Ring([Shard("a"), Shard("b", weight=2)], 100).virtual_node_count() == 300
    keys = [f"key:{i}" for i in range(1, 1001)]
    even = Ring([Shard("shard-1"), Shard("shard-2")], 100).distribution(keys)
    assert even == {"shard-1": 458, "shard-2": 542}
    assert Ring([Shard("shard-1"), Shard("shard-2", weight=3)], 100).distribution(keys) == {"shard-1": 198, "shard-2": 802}


def test_ring_changes_and_errors():
    ring = Ring([Shard("a"), Shard("b")])
    assert ring.node_count() == 2 and ring.has("a") and not ring.remove("a").has("a")
    assert ring.add(Shard("c")).node_count() == 3 and ring.clear().virtual_node_count() == 0
    assert ring.lookup("x") == ring.lookup("x") and Ring([Shard("only")]).lookup(12345) == "only"
    with pytest.raises(ShardingError):
        Ring([]).lookup("x")
    assert Ring([Shard("a")], algorithm="unknown").positions == Ring([Shard("a")], algorithm="xxh128").positions


def test_modulo():
    assert Modulo().route(-5, THREE).id == "shard-3"  # abs(-5) % 3 == 2
    assert Modulo().route(42, THREE).id == "shard-1"
    assert Modulo().route("42", THREE).id == "shard-3"
    assert zlib.crc32(b"user:123") & 0x7FFFFFFF == 1873151336
    for bad in (1.5, None, True):
        with pytest.raises(ShardingError):
            Modulo().route(bad, THREE)


def test_ranges():
    assert [Ranges().route(k, RANGED).id for k in (0, 9, 10, 19, 20, -1)] == ["a", "a", "b", "b", "c", "c"]


@pytest.mark.parametrize("strategy", [Modulo(), Ranges(), ConsistentHash(), ConsistentHash(algorithm="md5"), ConsistentHash(20, "sha256"), ConsistentHash(algorithm="xxh64")], ids=str)
def test_columns_route_like_values(spark, strategy):
    shards = RANGED if isinstance(strategy, Ranges) else THREE
    router = Router(shards, strategy)
    whole = [*range(-40, 40), 2**62, -(2**62)]
    rows = spark.createDataFrame([(k, f"k:{k}é") for k in whole], "k long, t string")
    for name, kind in (("k", "bigint"), ("t", "string")):
        for key, shard in rows.select(name, router.column(F.col(name), kind)).collect():
            assert shard == router.route(key).id


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.integers(-(2**63), 2**63 - 1), st.text(max_size=20)), st.integers(1, 9))
def test_every_key_has_one_active_shard(key, n):
    shards = ShardSet.numbered(n).add(Shard("off", active=False))
    for strategy in (Modulo(), ConsistentHash(10)):
        found = Router(shards, strategy).route(key)
        assert found.active and found == Router(shards, strategy).route(key)


def test_groups_route_together():
    groups = TableGroups({"users": ["users", "profiles"]})
    router = Router(THREE, ConsistentHash(100), groups)
    assert router.route_for_table("users", "key:123") == router.route_for_table("profiles", "key:123") == router.route("users:key:123")
    assert router.route_for_table("other", "key:123") == router.route("key:123")
    assert groups.together("users", "profiles") and not groups.together("other", "other")
    groups.add("users", "else")
    assert groups.group_of("users") == "else" and groups.tables_in("users") == ["profiles"] and groups.names() == ["users", "else"]
    groups.remove("users")
    assert not groups.has_group("users") and router.shard_by_id("no") is None


def test_configured_strategies():
    assert strategy_from_config({"default_strategy": "modulo"}).name == "modulo"
    assert strategy_from_config({"default_strategy": "range"}).name == "range"
    assert strategy_from_config({"default_strategy": "unheard"}).name == "consistent_hash"
    assert strategy_from_config({"consistent_hash": {"virtual_nodes": 7}}).virtual_nodes == 7


def test_distribution_lists_empty_shards(spark):
    keys = spark.createDataFrame([(3,), (6,)], "k long")
    assert dict(map(tuple, distribution(keys, "k", Router(THREE, Modulo())).collect())) == {"shard-1": 2, "shard-2": 0, "shard-3": 0}
