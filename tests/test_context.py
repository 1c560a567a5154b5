from __future__ import annotations

import pytest

from shardlake.plans.context import CachePrefix, Engine, ShardContext, WriteGuard
from shardlake.testing import FakeEngine, FixedUuids
from shardlake.topology import CrossShardWrite, Shard, ShardNotFound, ShardSet

A, B = Shard("a"), Shard("b")


@pytest.fixture(autouse=True)
def clean():
    ShardContext().clear()
    yield
    ShardContext().clear()


def test_stack():
    c = ShardContext()
    assert not c.active() and c.current() is None and c.pop() is None
    c.push(A), c.push(B)
    assert c.depth() == 2 and c.current_id() == "b" and c.contains("a") and c.contains(B) and c.stack() == [A, B]
    assert c.pop() == B and c.current() == A
    c.clear()
    assert c.depth() == 0


def test_run_restores_after_an_error():
    c = ShardContext()
    assert c.run(A, lambda s: s.id) == "a"
    with pytest.raises(ZeroDivisionError):
        c.run(A, lambda s: 1 / 0)
    assert not c.active()


def test_engine_runs_hooks_and_measures():
    e, prefix = FakeEngine(), CachePrefix()
    e.bootstrappers = [prefix]
    assert e.run("shard-1", lambda s: (s.id, prefix.prefix)) == ("shard-1", "shard:shard-1:")
    assert prefix.prefix == "" and e.metrics.counts == {"shard-1": 1}
    assert [x for x, _ in e.history] == ["initialized", "bootstrapped", "ended"]
    assert e.run_on_all(lambda s: s.id) == {f"shard-{i}": f"shard-{i}" for i in (1, 2, 3)}
    e.assert_initialized("shard-2"), e.assert_count(4), e.assert_not_initialized("x"), e.assert_current(None)
    with pytest.raises(ShardNotFound):
        e.run("x", lambda s: None)


def test_failing_hook_leaves_no_context():
    class Bad:
        def bootstrap(self, shard):
            raise ValueError

        def revert(self):
            raise AssertionError

    prefix = CachePrefix()
    e = Engine(ShardSet.numbered(2), bootstrappers=[prefix, Bad()])
    with pytest.raises(ValueError):
        e.run("shard-1", lambda s: None)
    assert not e.context.active() and prefix.prefix == ""


def test_added_shards_reach_the_router():
    e = Engine(ShardSet.numbered(1))
    e.add_shard(Shard("shard-2"))
    assert {e.route(k).id for k in range(200)} == {"shard-1", "shard-2"}


def test_write_guard():
    g = WriteGuard()
    with g.batch(), pytest.warns(UserWarning):
        g.record(A), g.record(A), g.record(B)
    g.strict = True
    with pytest.raises(CrossShardWrite), g.batch():
        g.record(A), g.record(B)
    g.record(B)
    assert g.shards == []


def test_fixed_uuids():
    f = FixedUuids(["018f0000-0000-7000-8000-000000000001"])
    assert str(f.generate()) == "018f0000-0000-7000-8000-000000000001"
    assert f.generate("shard-3").shard_number == 3 and f.generate_string() != f.generate_string()
