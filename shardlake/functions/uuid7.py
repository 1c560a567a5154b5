"""UUIDs of version 7 that carry a shard's number in their lowest bits."""

from __future__ import annotations

import os
import re
import time
import uuid
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..topology import Shard, ShardingError, ShardSet

UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
_UUID = re.compile(UUID_PATTERN)


def looks_like_uuid(value: object) -> bool:
    return isinstance(value, str) and bool(_UUID.match(value))


@dataclass(frozen=True)
class ShardUuid:
    value: uuid.UUID
    shard_number: int | None = None

    def __str__(self) -> str:
        return str(self.value)

    @property
    def bytes(self) -> bytes:
        return self.value.bytes

    @property
    def hex(self) -> str:
        return self.value.hex

    @property
    def has_shard(self) -> bool:
        return self.shard_number is not None

    @property
    def timestamp_ms(self) -> int | None:
        return self.value.int >> 80 if self.value.version == 7 else None

    def equals(self, other: ShardUuid | uuid.UUID | str) -> bool:
        return str(other).lower() == str(self)


def shard_number(shard: Shard | str, bits: int) -> int:
    """A number for a shard id: itself if numeric, else its "shard-N", its last digits, or a checksum."""
    name = shard.id if isinstance(shard, Shard) else shard
    if name.isdigit():
        return int(name)
    if found := re.search(r"shard[_-]?(\d+)", name, re.I):
        return int(found[1])
    if digits := re.findall(r"\d+", name):
        return int(digits[-1])
    return zlib.crc32(name.encode()) % (1 << bits)


class UuidFactory:
    def __init__(self, bits: int = 10, embed: bool = True) -> None:
        if not 1 <= bits <= 16:
            raise ShardingError("shard bits must be from 1 to 16")
        self.bits, self.embed = bits, embed

    @property
    def max_shard(self) -> int:
        return (1 << self.bits) - 1

    def generate(self, shard: Shard | str | None = None) -> ShardUuid:
        value = int(time.time() * 1000) << 80 | int.from_bytes(os.urandom(10), "big")
        value = value & ~(0xF << 76) | 7 << 76
        value = value & ~(0x3 << 62) | 0x2 << 62
        if shard is None or not self.embed:
            return ShardUuid(uuid.UUID(int=value))
        number = shard_number(shard, self.bits)
        if number > self.max_shard:
            raise ShardingError(f"shard number {number} doesn't fit into {self.bits} bits")
        return ShardUuid(uuid.UUID(int=value & ~self.max_shard | number), number)

    def generate_string(self, shard: Shard | str | None = None) -> str:
        return str(self.generate(shard))

    def extract(self, value: str | uuid.UUID) -> int:
        return uuid.UUID(str(value)).int & self.max_shard

    def parse(self, value: str) -> ShardUuid:
        return ShardUuid(uuid.UUID(value), self.extract(value) if self.embed else None)


class UuidDecoder:
    """From a UUID to the shard whose number it carries."""

    def __init__(self, factory: UuidFactory | None = None) -> None:
        self.factory = factory or UuidFactory()

    def shard_number(self, value: str) -> int | None:
        return self.factory.extract(value) if looks_like_uuid(value) else None

    def has_shard(self, value: str) -> bool:
        return looks_like_uuid(value)

    def decode(self, value: str, shards: ShardSet) -> Shard | None:
        number = self.shard_number(value)
        return None if number is None else by_number(number, shards)


def by_number(number: int, shards: ShardSet) -> Shard | None:
    """Exact id, then "shard-N" as a word, then last digits, then place in the set."""
    if shards.has(str(number)):
        return shards.get(str(number))
    for s in shards:
        if (found := re.search(r"\bshard[-_]?(\d+)\b", s.id, re.I)) and int(found[1]) == number:
            return s
    for s in shards:
        if (digits := re.findall(r"\d+", s.id)) and int(digits[-1]) == number:
            return s
    ordered = list(shards)
    return ordered[number] if number < len(ordered) else None


def shard_number_of(col: Column, bits: int = 10) -> Column:
    """The number a UUID column carries; null where the text is no UUID."""
    number = F.conv(F.substring(col, -4, 4), 16, 10).cast("int").bitwiseAND((1 << bits) - 1)
    return F.when(col.rlike(UUID_PATTERN), number)


def timestamp_ms_of(col: Column) -> Column:
    digits = F.replace(col, F.lit("-"), F.lit(""))
    return F.when(col.rlike(UUID_PATTERN) & (F.substring(digits, 13, 1) == "7"), F.conv(F.substring(digits, 1, 12), 16, 10).cast("long"))


def decoded_shard(col: Column, shards: ShardSet, bits: int = 10) -> Column:
    """The shard id of a UUID column, as ``UuidDecoder.decode`` finds it."""
    numbers: Iterable[tuple[int, Shard | None]] = ((n, by_number(n, shards)) for n in range(1 << bits))
    number, out = shard_number_of(col, bits), F.lit(None).cast("string")
    for n, s in numbers:
        if s is not None:
            out = F.when(number == n, F.lit(s.id)).otherwise(out)
    return out
