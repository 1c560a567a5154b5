from __future__ import annotations

from shardlake.operators.metrics import ShardMetrics, hotspots, slow_shards
from shardlake.operators.ops import HealthChecker, Migrations, ShardJob, list_shards, make_migration
from shardlake.plans.context import Engine
from shardlake.topology import ShardSet


def test_metrics():
    m = ShardMetrics()
    for shard, n in (("a", 10), ("b", 1), ("c", 1)):
        for _ in range(n):
            m.record_query(shard, 150.0 if shard == "b" else 1.0)
    assert m.hotspots() == {"a": 2.5} and m.slow_shards() == {"b": 150.0} and m.average_ms("x") == 0.0
    m.record_cross_shard()
    assert m.summary()["cross_shard_queries"] == 1 and m.summary()["total_queries"] == 12
    m.enabled = False
    m.record_query("a", 1)
    assert m.total_queries() == 12


def test_logged_metrics(spark):
    log = spark.createDataFrame([("a", 1.0)] * 10 + [("b", 150.0), ("c", 1.0)], "_shard_id string, ms double")
    assert [tuple(r) for r in hotspots(log).collect()] == [("a", 10, 2.5)]
    assert [tuple(r) for r in slow_shards(log, "ms").collect()] == [("b", 150.0)]


def test_health(spark):
    def probe(shard):
        if shard.id == "shard-2":
            raise OSError("down")

    h = HealthChecker(Engine(ShardSet.numbered(3)), probe)
    assert not h.all_healthy() and [s.id for s in h.unhealthy()] == ["shard-2"] and len(h.healthy()) == 2
    rows = {r.shard_id: r for r in h.frame(spark).collect()}
    assert rows["shard-2"].error == "down" and rows["shard-2"].latency_ms is None and rows["shard-1"].latency_ms >= 0


def test_jobs():
    e = Engine(ShardSet.numbered(3))
    with e.on("shard-2"):
        job = ShardJob(e, e.context.current_id)
    assert job.run() == "shard-2" and job.run(shard="shard-3") == "shard-3" and job.on_shard("shard-1").run() == "shard-1"
    assert job.payload() == {"_shard_id": "shard-2"} and ShardJob(e, e.context.current_id).run() is None


def test_migrations(spark, tmp_path):
    e, seen = Engine(ShardSet.numbered(2)), []
    m = Migrations(e, {n: (lambda s, n=n: seen.append(("up", n, s.id)), lambda s, n=n: seen.append(("down", n, s.id))) for n in ("02_b", "01_a")})
    first, second = e.shards
    assert m.migrate(first) == ["01_a", "02_b"] and m.pending(second) == ["01_a", "02_b"] and not m.has_pending(first)
    assert m.status(spark).where("pending").count() == 2 and m.last_batch(first) == 1
    assert m.rollback(first) == ["02_b", "01_a"] and m.fresh(first) == ["01_a", "02_b"]
    path = make_migration(tmp_path, "Create users table", create="users")
    assert path.name.endswith("create_users_table.py") and "CREATE TABLE users" in path.read_text()
    assert list_shards(e, spark).count() == 2
