from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardlake.functions.routing import ConsistentHash, Modulo, Ranges
from shardlake.operators.paging import cursor_frame, paginate
from shardlake.operators.relations import Relation, colocated_join
from shardlake.plans.context import Engine
from shardlake.sources.catalog import SHARD, Connections, Pool, ShardedTable, foreign_server_sql, read_placed, sharded_sql, unified_view_sql
from shardlake.streaming.iterate import chunk, chunk_by_id, each, lazy
from shardlake.topology import PoolExhausted, Shard, ShardingError, ShardSet

THREE = ShardSet.numbered(3)


def table(spark, rows, schema, key="id", engine=None, **more):
    return ShardedTable(engine or Engine(THREE, Modulo()), "t", spark.createDataFrame(rows, schema), shard_key=key, **more)


@pytest.fixture(scope="module")
def numbers(spark):
    return table(spark, [(i, i % 4, float(i) if i % 5 else None) for i in range(30)], "id long, c int, v double")


def test_null_aware_and_scatter_averages(spark):
    t = table(spark, [(1, 1.0), (2, None), (3, 2.0)], "id long, v double")
    assert (t.query().avg("v"), t.query().avg("v", null_aware=True), t.query().sum("v"), t.query().count("v")) == (1.0, 1.5, 3.0, 2)


def test_aggregates_over_nothing(spark):
    q = table(spark, [(1, 1.0)], "id long, v double").query().where("id", 99)
    assert (q.count(), q.sum("v"), q.avg("v"), q.min("v"), q.max("v"), q.exists()) == (0, 0.0, 0.0, None, None, False)


def test_weighted_average_of_averages(spark):
    rows = [(i, 100.0) for i in range(10)] + [(i, 50.0) for i in range(10, 100)]
    assert table(spark, rows, "id long, v double").query().avg("v") == 55.0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(0, 3)), min_size=1, max_size=30), st.integers(1, 5), st.sampled_from([Modulo(), ConsistentHash(20, "md5"), Ranges()]))
def test_sharding_is_transparent(spark, rows, n, strategy):
    engine = Engine(ShardSet.numbered(n), strategy)
    t = table(spark, rows, "id long, c int", engine=engine)
    q = t.query().where("c", ">", 0)
    assert sorted(tuple(r) for r in q.get("id", "c").collect()) == sorted(r for r in rows if r[1] > 0)
    assert q.counts_by_shard().agg(F.sum("n")).first()[0] == sum(c > 0 for _, c in rows)
    key = rows[0][0]
    pinned = t.query().where("id", key)
    assert len(pinned.shards()) == 1 and pinned.count() == sum(k == key for k, _ in rows)


def test_pruning_rules(numbers):
    q = numbers.query()
    assert q.where("id", 4).shards().ids() == ["shard-2"]
    assert q.where("c", 1).where("id", "=", 4).shards().ids() == ["shard-2"]
    assert q.where_in("id", [3, 6, 4]).shards().ids() == ["shard-1", "shard-2"]
    for scattered in (q.where("id", ">", 4), q.where("id", 4).or_where("c", 1), q.where(lambda g: g.where("id", 4))):
        assert len(scattered.shards()) == 3
    off = ShardedTable(Engine(THREE, Modulo(), config={"co_location": False}), "t", numbers._frame, shard_key="id")
    assert len(off.query().where("id", 4).shards()) == 3


def test_pruned_plan_reads_one_folder(spark, numbers, tmp_path):
    numbers.write(numbers._frame, str(tmp_path / "t"))
    t = read_placed(numbers.engine, spark, "t", str(tmp_path / "t"), shard_key="id")
    rows = t.query().where("id", 4).base()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_shard_id" in plan and "shard-2" in plan
    assert t.query().count() == 30 and t.query().where("id", 4).count() == 1


def test_only_except_and_inactive(spark):
    shards = THREE.remove("shard-3").add(Shard("shard-3", active=False))
    frame = spark.createDataFrame([(i, f"shard-{i % 3 + 1}") for i in range(9)], f"id long, {SHARD} string")
    q = ShardedTable(Engine(shards, Modulo()), "t", frame).query()
    assert q.count() == 6 and q.only(["shard-3"]).count() == 3 and q.except_(["shard-1"]).count() == 3
    assert q.on_shard("shard-1").target_shard.id == "shard-1" and q.is_all_shards
    assert not q.on_shard("shard-1").is_all_shards and q.on_shard("shard-1").on_all_shards().is_all_shards


def test_repeated_keys_on_two_shards_stay(spark):
    frame = spark.createDataFrame([(1, "shard-1"), (1, "shard-2")], f"id long, {SHARD} string")
    assert ShardedTable(Engine(THREE, Modulo()), "t", frame).query().count() == 2


def test_order_limit_first_find_pluck(numbers):
    q = numbers.query()
    assert [r.id for r in q.order_by("c").order_by_desc("id").offset(2).limit(3).get().collect()] == [20, 16, 12]
    assert q.order_by_desc("id").first("id").id == 29 and q.first().id == 0 and q.find(7, "id").id == 7 and q.find(99) is None
    assert {r.c: r.id for r in q.pluck_frame("id", "c").collect()} == {0: 20, 1: 29, 2: 26, 3: 23}
    assert len(q.select("id").get().columns) == 1


def test_pages(numbers):
    page = paginate(numbers.query().order_by("id"), 2, 7)
    assert [r.id for r in page.items.collect()] == list(range(7, 14)) and (page.total, page.last_page, page.has_more) == (30, 5, True)
    assert paginate(numbers.query(), 0, 7).page == 1


def test_keyset_skips_ties(spark):
    t = table(spark, [(1, 1), (2, 2), (3, 2), (4, 3)], "id long, c int")
    assert [r.c for r in cursor_frame(t.query(), 2, "c").collect()] == [1, 2]
    assert [r.c for r in cursor_frame(t.query(), 2, "c", "asc", 2).collect()] == [3]


def test_deep_pages_keep_few_rows(numbers):
    plan = numbers.query().order_by("id").offset(4).limit(5).get()._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=9" in plan and "Exchange rangepartitioning" not in plan


def test_or_where_escapes_the_foreign_key(spark):
    t = table(spark, [(1, 7, 1), (2, 7, 0), (3, 8, 1)], "id long, fk long, b int")
    r = Relation(t, "fk", "k")
    assert {x.id for x in r.of(7).where("b", 0).or_where("b", 1).get().collect()} == {1, 2, 3}
    assert r.of({"k": 7}).count() == 2 and not r.of(9).exists()


def test_colocated_join_wants_a_group(numbers):
    with pytest.raises(ValueError):
        colocated_join(numbers.query(), numbers.query(), "id", "id")


def test_dead_shards(spark, numbers):
    def dead():
        raise OSError("gone")

    loaders = {"shard-1": lambda: numbers._frame.where("id < 10"), "shard-2": dead, "shard-3": lambda: numbers._frame.where("id >= 20")}
    t = ShardedTable(Engine(THREE, Modulo(), config={"dead_shard_tolerance": True}), "t", loaders=loaders)
    assert t.query().count() == 20 and list(t.skipped) == ["shard-2"]
    with pytest.raises(OSError):
        ShardedTable(Engine(THREE, Modulo()), "t", loaders=loaders).query().count()
    t.engine.shards = ShardSet([Shard("shard-2")])
    with pytest.raises(ShardingError):
        t.query().count()


def test_iteration(numbers):
    q, got = numbers.query(), []
    read = [r[SHARD] for r in lazy(q)]
    assert len(read) == 30 and read == sorted(read)
    assert chunk(q, 4, lambda rows, s: got.extend(r.id for r in rows)) and sorted(got) == list(range(30))
    assert chunk(q, 4, lambda rows, s: False) is False
    got.clear()
    assert chunk_by_id(q, 4, lambda rows, s: got.append([r.id for r in rows])) and got[0] == [0, 3, 6, 9]
    assert each(q, lambda r: r.id < 100) and each(q, lambda r: False) is False


def test_sql_with_values(numbers):
    assert sharded_sql([numbers], "SELECT count(*) FROM all_t WHERE c = :c AND _shard_id = 'shard-1'", {"c": 1}).first()[0] == 2
    assert sharded_sql([numbers], "SELECT count(*) FROM all_t WHERE c = ? AND id < ?", [1, 10]).first()[0] == 3


def test_scatter_detector(numbers):
    e = numbers.engine
    e.scatter.enabled, told = True, []
    e.scatter.callback = lambda name, shards: told.append(len(shards))
    numbers.query().count(), numbers.query().where("id", 3).count()
    assert told == [3]
    e.scatter.reset()


def test_uuid_placement(spark):
    engine = Engine(THREE)
    made = [engine.uuids.generate_string(s) for s in engine.shards]
    t = ShardedTable(engine, "t", spark.createDataFrame([(u,) for u in made], "id string"), uuid_key=True)
    assert [r[SHARD] for r in t.rows().orderBy(SHARD).collect()] == THREE.ids()
    assert [t.place(u).id for u in made] == THREE.ids() and t.query().where("id", made[1]).count() == 1
    with engine.on("shard-2"):
        assert t.place(None).id == "shard-2"
    assert t.place(None) is None


def test_written_rows_get_their_shards_uuid(spark, tmp_path):
    engine = Engine(THREE, Modulo())
    t = ShardedTable(engine, "t", spark.createDataFrame([(i, None) for i in range(6)], "id long, u string"))
    t.write(t._frame, str(tmp_path / "u"), uuid_column="u")
    for r in spark.read.parquet(str(tmp_path / "u")).collect():
        assert engine.decoder.decode(r.u, THREE).id == r[SHARD] and engine.uuids.parse(r.u).value.version == 7


def test_connections_pools_and_sql(spark, tmp_path):
    shards = ShardSet([Shard("shard-1", options={"path": str(tmp_path)}), Shard("b", options={"driver": "x", "url": "u"})])
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    c = Connections(spark, {"format": "parquet"}, limit=1)
    a, b = shards
    assert c.options(a) == {"format": "parquet", "path": str(tmp_path)} and c.options(b) == {"driver": "x", "url": "u"}
    assert c.reader(a, "t")().count() == 3 and c.has("shard_shard-1") and c.names() == ["shard_shard-1"]
    engine = Engine(shards, Modulo())
    with engine.on("shard-1"):
        assert c.resolve(engine)["path"] == str(tmp_path) and c.resolve(engine, central=True) == c.central
        with c.central_only(engine):
            assert c.resolve(engine) == c.central
        assert engine.context.current_id() == "shard-1"
    p = Pool(1)
    with p.lease("x"), pytest.raises(PoolExhausted):
        p.acquire("x")
    assert p.stats()["total"] == 0
    assert "UNION ALL" in unified_view_sql("t", shards) and "'shard-1' AS _shard_id" in unified_view_sql("t", shards)
    assert foreign_server_sql(shards)[1].startswith("CREATE SERVER IF NOT EXISTS shard_shard_1")
