"""What the training-data operators share: reading tables, cutting lineage, Arrow helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

#: Rows of output that a Python stage gathers before it hands a batch back.
OUT_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set to a temporary one where a local session names none."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="shardlake-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage.

    The folder is the one that the session names in ``spark.checkpoint.dir``; a temporary
    folder stands in only where a local session names none, as in tests. Files go when Spark's
    cleaner finds the frame unreferenced (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def rows_to_arrow(schema: pa.Schema) -> Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]]:
    """A function that turns an iterator of row tuples into record batches of bounded length."""

    def pack(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

        for row in rows:
            held.append(row)
            if len(held) >= OUT_ROWS:
                yield batch()
                held.clear()
        if held:
            yield batch()

    return pack


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for own columns beside those of ``df``, which may carry any names."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def schema_of(df: DataFrame, without: set[str], more: str) -> StructType:
    """The schema of ``df`` less some columns, with more of them at the end."""
    kept = [StructField(f.name, f.dataType) for f in df.schema if f.name not in without]
    return StructType(kept + (StructType.fromDDL(more).fields if more else []))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def raw_text(text: pa.StringScalar) -> bytes:
    """The bytes of a text, none of a null."""
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def scalars(df: DataFrame, *exprs) -> tuple:
    """The one row of a global aggregate."""
    return tuple(df.agg(*exprs).first())
