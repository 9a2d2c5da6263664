"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lookup table up to this size is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key and the text, a missing text as the empty one."""
    return df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def batches(f: Callable[[pa.RecordBatch], dict[str, list] | pa.RecordBatch], schema: pa.Schema) -> Callable:
    """For ``mapInArrow``: ``f`` turns a batch into columns of ``schema``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                out = f(batch)
                if isinstance(out, dict):
                    out = pa.RecordBatch.from_pydict(out, schema=schema)
                yield out

    return run


def join_lookup(df: DataFrame, lookup: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join with a written table of one row per key: by broadcast when its measured size is small."""
    size = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) + 16 for c in lookup.columns), F.lit(0))
    measured = lookup.agg(F.sum(size)).first()[0] or 0
    return df.join(F.broadcast(lookup) if measured <= BROADCAST_BYTES else lookup, on, how)


def release() -> None:
    """Give unused memory back, Arrow's and the C library's: a worker process lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def to_spark(schema: pa.Schema) -> str:
    """The same schema as Spark's DDL."""
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.int16(): "smallint", pa.string(): "string", pa.binary(): "binary",
             pa.float64(): "double", pa.float32(): "float", pa.bool_(): "boolean"}

    def kind(t: pa.DataType) -> str:
        if pa.types.is_list(t):
            return f"array<{kind(t.value_type)}>"
        if pa.types.is_struct(t):
            return f"struct<{','.join(f'{t.field(i).name}:{kind(t.field(i).type)}' for i in range(t.num_fields))}>"
        return names[t]

    return ", ".join(f"`{f.name}` {kind(f.type)}" for f in schema)
