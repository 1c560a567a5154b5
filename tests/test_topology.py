from __future__ import annotations

import pytest

from shardlake.topology import Shard, ShardNotFound, ShardSet

MIXED = ShardSet([Shard("shard-1"), Shard("shard-2", weight=2, read_only=True), Shard("shard-3", weight=3, active=False)])


def test_defaults():
    s = Shard.from_config("shard-1", {})
    assert (s.name, s.connection, s.weight, s.active, s.read_only, dict(s.options), dict(s.metadata)) == ("shard-1", "shard_shard-1", 1, True, False, {}, {})


def test_full_config():
    s = Shard.from_config("a", {"name": "A", "connection": "c", "weight": 3, "active": False, "read_only": True, "database": {"driver": "x"}, "metadata": {"dc": "dc1"}})
    assert (s.name, s.connection, s.weight, s.active, s.read_only, s.options["driver"], s.metadata["dc"]) == ("A", "c", 3, False, True, "x", "dc1")


def test_copies_leave_the_original():
    s = Shard("a")
    assert not s.with_active(False).active and s.active
    assert s.with_read_only(True).read_only and not s.read_only


def test_filters_and_weights():
    assert MIXED.active().ids() == ["shard-1", "shard-2"]
    assert MIXED.writable().ids() == ["shard-1", "shard-3"]
    assert MIXED.read_only().ids() == ["shard-2"]
    assert MIXED.total_weight() == 6 and MIXED.count() == len(MIXED) == 3
    assert MIXED.map(lambda s: s.weight) == {"shard-1": 1, "shard-2": 2, "shard-3": 3}


def test_sets_are_immutable_and_ordered():
    more = MIXED.add(Shard("a"))
    assert more.ids() == ["shard-1", "shard-2", "shard-3", "a"] and not MIXED.has("a")
    assert MIXED.remove("shard-1").first().id == "shard-2" and MIXED.first().id == "shard-1"
    assert "shard-2" in MIXED and Shard("shard-2") in MIXED and MIXED.get("x") is None
    seen = []
    MIXED.each(lambda s: seen.append(s.id))
    assert seen == list(MIXED.all())
    assert ShardSet().is_empty() and MIXED.is_not_empty()


def test_numeric_ids_and_missing():
    assert ShardSet.from_config({1: {}, 2: {}}).ids() == ["1", "2"]
    with pytest.raises(ShardNotFound):
        MIXED.require("no")
