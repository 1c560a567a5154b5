from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from shardlake.functions.uuid7 import UuidDecoder, UuidFactory, decoded_shard, looks_like_uuid, shard_number, shard_number_of, timestamp_ms_of
from shardlake.topology import ShardingError, ShardSet

V7 = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
LITERAL = "018f0000-0000-7000-8000-000000000405"


def test_generate_and_embed():
    f = UuidFactory()
    assert V7.match(f.generate_string()) and not f.generate().has_shard
    for shard, number in (("1", 1), ("shard-5", 5), ("eu_9", 9), ("Shard_12x", 12)):
        made = f.generate(shard)
        assert V7.match(str(made)) and made.shard_number == number == f.extract(str(made)) == f.parse(str(made)).shard_number


def test_limits():
    assert (UuidFactory(10).max_shard, UuidFactory(8).max_shard) == (1023, 255)
    assert not UuidFactory(embed=False).generate("3").has_shard
    with pytest.raises(ShardingError):
        UuidFactory(4).generate("77")
    with pytest.raises(ShardingError):
        UuidFactory(17)
    assert 0 <= shard_number("north", 10) < 1024


def test_decode():
    d, shards = UuidDecoder(), ShardSet.numbered(3)
    assert d.shard_number(LITERAL) == 5 and d.shard_number("no") is None
    assert d.decode(LITERAL, shards) is None
    assert d.decode(LITERAL[:-1] + "2", shards).id == "shard-2"
    assert d.decode(LITERAL[:-3] + "400", shards).id == "shard-1"  # by place
    assert d.has_shard(LITERAL) and not looks_like_uuid(5)


def test_columns(spark):
    made = UuidFactory().generate("2")
    rows = spark.createDataFrame([(LITERAL,), (str(made),), ("x",), (None,)], "u string")
    shards = ShardSet.numbered(3)
    found = rows.select(shard_number_of(F.col("u")), timestamp_ms_of(F.col("u")), decoded_shard(F.col("u"), shards)).collect()
    assert [tuple(r) for r in found] == [(5, 0x018F00000000, None), (2, made.timestamp_ms, "shard-2"), (None, None, None), (None, None, None)]
    assert made.equals(str(made).upper()) and len(made.bytes) == 16 and len(made.hex) == 32
