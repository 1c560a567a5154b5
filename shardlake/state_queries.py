"""What the engine knows and does apart from tables, as queries: targets, contexts, rings, UUIDs, jobs, commands, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.routing import ConsistentHash, Modulo, Ranges, Ring, Router, TableGroups, distribution, strategy_from_config
from .functions.uuid7 import decoded_shard, shard_number_of, timestamp_ms_of
from .operators.ops import HealthChecker, Migrations, ShardJob, StepLog, list_shards, on_all_shards
from .operators.paging import paginate
from .operators.relations import Relation
from .plans.context import CachePrefix, Engine, WriteGuard
from .queries import CUSTOMER_ORDERS, LISTED, OF_ORDER, SHARDS, WEIGHTED, COLUMNS, _ring_sql, orders, query, read, sharded
from .sources.catalog import Connections, Pool, ShardedTable, coordinator_sql, scratch, sharded_sql
from .testing import FixedUuids
from .topology import CrossShardWrite, PoolExhausted, Shard, ShardSet


def told(spark, rows, schema: str):
    return spark.createDataFrame(list(rows), schema)


# ---- what a query reads


@query("SELECT * FROM (VALUES ('all', 'shard-1,shard-2,shard-3'), ('key', 'shard-1'), ('keys', 'shard-1,shard-2'), ('one', 'shard-2'), ('only', 'shard-3'), ('except', 'shard-1,shard-3'), ('either', 'shard-1,shard-2,shard-3')) t(query, shards)")
def targets_read(spark, sf_dir):
    q = orders(spark, sf_dir)
    cases = {
        "all": q, "key": q.where("o_orderkey", 6), "keys": q.where_in("o_orderkey", [3, 4]), "one": q.on_shard("shard-2"), "only": q.only(["shard-3", "x"]),
        "except": q.except_(["shard-2"]), "either": q.where("o_orderkey", 6).or_where("o_custkey", 1),
    }
    return told(spark, [(name, ",".join(c.shards().ids())) for name, c in cases.items()], "query string, shards string")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def builder_select(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", "o_totalprice").where("o_orderstatus", "P").get()


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def relation_select(spark, sf_dir):
    return Relation(orders(spark, sf_dir).table, *CUSTOMER_ORDERS).of(7).select("o_orderkey").get()


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 AND o_orderpriority <> '1-URGENT' GROUP BY 1")
def sql_with_named_values(spark, sf_dir):
    sql = "SELECT o_orderstatus, count(*) AS n FROM all_orders WHERE o_totalprice > :least AND o_orderpriority <> :not GROUP BY 1"
    return sharded_sql([orders(spark, sf_dir).table], sql, {"least": 1000, "not": "1-URGENT"})


@query("SELECT count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '?') AS marks FROM orders WHERE o_orderstatus = 'F'")
def sql_with_placed_values(spark, sf_dir):
    """A question mark inside a literal is no placeholder."""
    return sharded_sql([orders(spark, sf_dir).table], "SELECT count(*) AS n, count_if(o_orderpriority = '?') AS marks FROM all_orders WHERE o_orderstatus = ?", ["F"])


@query("SELECT 3 AS page, count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS last_page, count(*) > 60 AS more FROM orders")
def page_summary(spark, sf_dir):
    p = paginate(orders(spark, sf_dir).order_by("o_orderkey"), 3, 20)
    return told(spark, [(p.page, p.total, p.last_page, p.has_more)], "page int, total long, last_page long, more boolean")


@query(f"SELECT {LISTED} FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def page_items(spark, sf_dir):
    return paginate(orders(spark, sf_dir).order_by("o_orderkey"), 3, 20, *COLUMNS).items


# ---- routing


@query("SELECT c_custkey, 'shard-' || (c_custkey % 3 + 1) AS shard FROM customer")
def row_to_shard(spark, sf_dir):
    """Single keys placed on the driver, as a writer places one row."""
    table = sharded(spark, sf_dir, "customer", "c_custkey")
    keys = [r.c_custkey for r in table.query().get("c_custkey").toLocalIterator()]
    return told(spark, [(k, table.place(k).id) for k in keys], "c_custkey long, shard string")


@query("SELECT * FROM (VALUES ('modulo', 'modulo'), ('range', 'range'), ('consistent_hash', 'consistent_hash'), ('unknown', 'consistent_hash')) t(configured, used)")
def configured_strategies(spark, sf_dir):
    return told(spark, [(n, strategy_from_config({"default_strategy": n}).name) for n in ("modulo", "range", "consistent_hash", "unknown")], "configured string, used string")


@query("SELECT * FROM (VALUES ('modulo', true, true, false), ('range', true, true, false), ('consistent_hash', true, true, false)) t(strategy, whole, text, other)")
def supported_keys(spark, sf_dir):
    return told(spark, [(s.name, s.supports(1), s.supports("a"), s.supports(1.5)) for s in (Modulo(), Ranges(), ConsistentHash())], "strategy string, whole boolean, text boolean, other boolean")


@query("SELECT * FROM (VALUES ('shard-1', 150), ('shard-2', 300), ('shard-3', 450)) t(shard_id, nodes)")
def ring_nodes(spark, sf_dir):
    ring = Ring(WEIGHTED, 150, "md5")
    return told(spark, [(i, sum(o == i for o in ring.owners)) for i in WEIGHTED.ids() if ring.has(i)], "shard_id string, nodes int")


def _ring_counts(spark, sf_dir, shards: ShardSet):
    return distribution(read(spark, sf_dir, "customer"), "c_custkey", Router(shards, ConsistentHash(algorithm="md5")))


@query(_ring_sql(SHARDS.remove("shard-2"), "customer", "CAST(c_custkey AS VARCHAR)"))
def ring_after_removal(spark, sf_dir):
    return _ring_counts(spark, sf_dir, SHARDS.remove("shard-2"))


@query(_ring_sql(SHARDS.add(Shard("shard-4")), "customer", "CAST(c_custkey AS VARCHAR)"))
def ring_after_addition(spark, sf_dir):
    return _ring_counts(spark, sf_dir, SHARDS.add(Shard("shard-4")))


@query("SELECT * FROM (VALUES ('orders', 'sales', true), ('lineitem', 'sales', true), ('events', NULL, false)) t(tbl, grp, together)")
def table_groups(spark, sf_dir):
    g = TableGroups({"old": ["lineitem"], "sales": ["orders", "lineitem"]})
    return told(spark, [(t, g.group_of(t), g.together(t, "orders")) for t in ("orders", "lineitem", "events")], "tbl string, grp string, together boolean")


@query("SELECT 'shard-' || s AS shard_id, count(*) AS n, count(*) AS carried, count(*) AS versions, count(*) AS different FROM range(1, 4) t(s), range(50) GROUP BY 1")
def uuids_generated(spark, sf_dir):
    """UUIDs made on the driver, read as columns: shard, version and time."""
    engine = Engine(SHARDS)
    made = told(spark, [(s.id, engine.uuids.generate_string(s)) for s in SHARDS for _ in range(50)], "shard_id string, u string")
    own = F.concat(F.lit("shard-"), shard_number_of(F.col("u")).cast("string")) == F.col("shard_id")
    return made.groupBy("shard_id").agg(
        F.count("*").alias("n"), F.count_if(own & (decoded_shard(F.col("u"), SHARDS) == F.col("shard_id"))).alias("carried"),
        F.count_if(timestamp_ms_of(F.col("u")) > 1_600_000_000_000).alias("versions"), F.count_distinct("u").alias("different"),
    )


@query("SELECT * FROM (VALUES (1, 1, true), (2, 2, true), (3, 7, true)) t(n, shard_number, version_7)")
def fixed_uuids(spark, sf_dir):
    f = FixedUuids()
    made = [f.generate("shard-1"), f.generate("shard-2"), f.generate("shard-7")]
    return told(spark, [(i + 1, f.parse(str(u)).shard_number, u.timestamp_ms is not None) for i, u in enumerate(made)], "n int, shard_number int, version_7 boolean")


# ---- contexts and connections


@query("SELECT * FROM (VALUES (0, NULL, 0, ''), (1, 'shard-1', 1, 'shard:shard-1:'), (2, 'shard-3', 2, 'shard:shard-1:shard:shard-3:'), (3, 'shard-1', 1, 'shard:shard-1:'), (4, NULL, 0, '')) t(step, current, depth, prefix)")
def context_stack(spark, sf_dir):
    prefix, seen = CachePrefix(), []
    engine = Engine(SHARDS, bootstrappers=[prefix])
    look = lambda: seen.append((len(seen), engine.context.current_id(), engine.context.depth(), prefix.prefix))
    look()
    with engine.on("shard-1"):
        look()
        with engine.on("shard-3"):
            look()
        look()
    look()
    return told(spark, seen, "step int, current string, depth int, prefix string")


@query("SELECT * FROM (VALUES ('initialized', 'shard-2'), ('bootstrapped', 'shard-2'), ('ended', 'shard-2')) t(event, shard_id)")
def context_events(spark, sf_dir):
    engine, seen = Engine(SHARDS), []
    engine.listeners.append(lambda event, shard: seen.append((event, shard.id)))
    engine.run("shard-2", lambda s: None)
    return told(spark, seen, "event string, shard_id string")


@query(f"SELECT {OF_ORDER} AS shard_id, count(*) AS n FROM orders GROUP BY 1")
def run_on_every_shard(spark, sf_dir):
    q = orders(spark, sf_dir)
    found = q.table.engine.run_on_all(lambda s: q.on_shard(s).count())
    return told(spark, found.items(), "shard_id string, n long")


@query("SELECT * FROM (VALUES ('none', 'central'), ('shard', 'one'), ('shard, central asked for', 'central'), ('shard, central alone', 'central'), ('named', 'two')) t(case_, host)")
def connections_resolved(spark, sf_dir):
    shards = ShardSet([Shard("shard-1", options={"host": "one"}), Shard("shard-2", options={"host": "two"})])
    connections, engine = Connections(spark, {"host": "central"}), Engine(shards)
    connections.warm(shards)
    host = lambda **how: connections.resolve(engine, **how)["host"]
    rows = [("none", host())]
    with engine.on("shard-1"):
        rows += [("shard", host()), ("shard, central asked for", host(central=True)), ("named", host(name="shard_shard-2"))]
        with connections.central_only(engine):
            rows.append(("shard, central alone", host()))
    return told(spark, rows, "case_ string, host string")


@query("SELECT * FROM (VALUES ('free', 2, false), ('full', 2, true), ('released', 1, false)) t(moment, active, refused)")
def pool_limits(spark, sf_dir):
    pool, rows = Pool(2), []

    def refused() -> bool:
        try:
            pool.acquire("x")
        except PoolExhausted:
            return True
        pool.release("x")
        return False

    pool.acquire("x"), pool.acquire("x")
    rows.append(("free", pool.stats()["active"]["x"], False))
    rows.append(("full", pool.stats()["active"]["x"], refused()))
    pool.release("x")
    rows.append(("released", pool.stats()["active"]["x"], refused()))
    return told(spark, rows, "moment string, active int, refused boolean")


@query(
    """SELECT * FROM (VALUES
    ('CREATE FOREIGN TABLE IF NOT EXISTS shard_1_orders (LIKE orders) SERVER shard_shard_1 OPTIONS (table_name ''orders'');'),
    ('CREATE FOREIGN TABLE IF NOT EXISTS shard_2_orders (LIKE orders) SERVER shard_shard_2 OPTIONS (table_name ''orders'');'),
    ('CREATE OR REPLACE VIEW all_orders AS'), ('SELECT *, ''shard-1'' AS _shard_id FROM shard_1_orders'), ('UNION ALL'),
    ('SELECT *, ''shard-2'' AS _shard_id FROM shard_2_orders;')) t(line)"""
)
def coordinator_statements(spark, sf_dir):
    return told(spark, [(line,) for line in coordinator_sql("orders", ShardSet.numbered(2)).split("\n")], "line string")


@query("SELECT * FROM (VALUES ('one shard', false), ('two shards', true)) t(batch, refused)")
def writes_over_shards(spark, sf_dir):
    def refused(keys) -> bool:
        guard, table = WriteGuard(), sharded(spark, sf_dir, "customer", "c_custkey")
        guard.strict = True
        try:
            with guard.batch():
                for k in keys:
                    guard.record(table.place(k))
        except CrossShardWrite:
            return True
        return False

    return told(spark, [("one shard", refused([3, 6])), ("two shards", refused([3, 4]))], "batch string, refused boolean")


# ---- detectors, metrics, health, jobs


@query("SELECT * FROM (VALUES ('orders', 3), ('orders', 2)) t(query, shards)")
def scattered_queries(spark, sf_dir):
    q = orders(spark, sf_dir)
    q.table.engine.scatter.enabled = True
    q.count(), q.where("o_orderkey", 5).count(), q.except_(["shard-1"]).count()
    return told(spark, q.table.engine.scatter.seen, "query string, shards int")


@query("SELECT * FROM (VALUES ('shard-1', 6, CAST(2.0 AS DOUBLE)), ('shard-2', 2, NULL), ('shard-3', 1, NULL)) t(shard_id, queries, hot)")
def metrics_of_shards(spark, sf_dir):
    engine = Engine(SHARDS)
    for shard_id, n in (("shard-1", 6), ("shard-2", 2), ("shard-3", 1)):
        for _ in range(n):
            engine.run(shard_id, lambda s: None)
    hot = engine.metrics.hotspots()
    return told(spark, [(s, engine.metrics.counts[s], hot.get(s)) for s in SHARDS.ids()], "shard_id string, queries int, hot double")


@query("SELECT 2 AS cross_shard")
def cross_shard_queries(spark, sf_dir):
    q = orders(spark, sf_dir)
    q.count(), q.where("o_orderkey", 5).count(), q.only(["shard-1", "shard-2"]).exists(), q.on_shard("shard-1").exists()
    return told(spark, [(q.table.engine.metrics.summary()["cross_shard_queries"],)], "cross_shard int")


@query("SELECT * FROM (VALUES ('shard-1', true, NULL), ('shard-2', false, 'down'), ('shard-3', true, NULL)) t(shard_id, healthy, error)")
def health_report(spark, sf_dir):
    q = orders(spark, sf_dir)

    def probe(shard):
        if shard.id == "shard-2":
            raise OSError("down")
        q.on_shard(shard).exists()

    return HealthChecker(q.table.engine, probe).frame(spark).select("shard_id", "healthy", "error")


@query("SELECT * FROM (VALUES ('shard-2', 'shard-2'), ('shard-3', 'shard-3'), (NULL, NULL)) t(payload, ran_on)")
def jobs_of_shards(spark, sf_dir):
    engine = Engine(SHARDS)
    with engine.on("shard-2"):
        first = ShardJob(engine, engine.context.current_id)
    jobs = [first, first.on_shard("shard-3"), ShardJob(engine, engine.context.current_id)]
    return told(spark, [(j.payload().get("_shard_id"), j.run(spark)) for j in jobs], "payload string, ran_on string")


@query("SELECT 'shard-' || s AS id, s AS weight, true AS active, false AS read_only FROM range(1, 4) t(s)")
def shards_listed(spark, sf_dir):
    return list_shards(Engine(WEIGHTED), spark).select("id", "weight", "active", "read_only")


# ---- migrations and commands


def _steps():
    return {n: (lambda s: None, lambda s: None) for n in ("01_users", "02_posts")}


@query("SELECT * FROM (VALUES ('shard-1', '01_users', false, 1), ('shard-1', '02_posts', false, 1), ('shard-2', '01_users', true, NULL), ('shard-2', '02_posts', true, NULL), ('shard-3', '01_users', true, NULL), ('shard-3', '02_posts', true, NULL)) t(shard_id, migration, pending, batch)")
def migration_status(spark, sf_dir):
    """Steps run on two shards and taken back on one; a second process reads the log."""
    engine, log = Engine(SHARDS), StepLog(spark, scratch(spark, "steps"))
    first = Migrations(engine, _steps(), log=log)
    on_all_shards(first, "migrate", ["shard-1", "shard-2"]), on_all_shards(first, "rollback", ["shard-2"])
    return Migrations(engine, _steps(), log=log).status(spark)


@query("SELECT * FROM (VALUES ('shard-1', 2, NULL), ('shard-2', 0, 'OSError: down'), ('shard-3', 2, NULL)) t(shard_id, steps, error)")
def migration_commands(spark, sf_dir):
    def seed(shard):
        if shard.id == "shard-2":
            raise OSError("down")

    report = on_all_shards(Migrations(Engine(SHARDS), {"01_a": (seed, seed), "02_b": (seed, seed)}), "migrate")
    return told(spark, [(i, len(report.done.get(i, [])), report.failed.get(i)) for i in SHARDS.ids()], "shard_id string, steps int, error string")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(1 AS BIGINT) AS shards FROM orders")
def context_places_null_keys(spark, sf_dir):
    """Rows without a key go to the shard that is current where they are written."""
    frame = read(spark, sf_dir, "orders").select(F.lit(None).cast("long").alias("k"), "o_custkey")
    engine = Engine(SHARDS, Modulo())
    table = ShardedTable(engine, "t", frame, shard_key="k")
    with engine.on("shard-2"):
        rows = table.rows()
    return rows.agg(F.count_if(F.col("_shard_id") == "shard-2").alias("n"), F.count_distinct("_shard_id").alias("shards"))
