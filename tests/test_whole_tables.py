from __future__ import annotations

from shardlake.queries import QUERIES


def test_order_over_the_whole_table(spark, sf):
    rows = QUERIES["order_multi_key_whole"](spark, sf).collect()
    keys = [(r.o_orderstatus, -r.o_totalprice) for r in rows]
    assert keys == sorted(keys) and len(rows) == spark.read.parquet(f"{sf}/orders.parquet").count()
