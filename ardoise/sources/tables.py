"""Reading and writing of loan tables, datasets, small result tables and dictionaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ardoise.functions.aggspec import quoted

# Fixed value: encoding of the column dictionary file.
DICTIONARY_ENCODING = "ISO-8859-1"

# Types that a column may turn out to have, narrowest first.
TYPES = {"bigint": T.LongType(), "double": T.DoubleType()}


def csv_schema(spark: SparkSession, path: str, strings: Sequence[str] = ()) -> T.StructType:
    """Schema of a CSV file from its values, in one aggregate over the file read as text: the narrowest of whole
    number, number and text that holds every value of a column.  Columns in ``strings`` stay text; a column
    without values is a number.  Keep the schema (``schema.json()``) and pass it to later reads."""
    raw = spark.read.option("header", True).csv(path)
    cells = []
    for i, c in enumerate(raw.columns):
        cells.append(f"count({quoted(c)}) as n{i}")
        cells += [f"count(try_cast({quoted(c)} as {t})) as {t}{i}" for t in TYPES]
    seen = raw.agg(*[F.expr(x) for x in cells]).first()

    def kind(i: int, c: str) -> T.DataType:
        if c in strings:
            return T.StringType()
        if not seen[f"n{i}"]:
            return T.DoubleType()
        return next((k for t, k in TYPES.items() if seen[f"{t}{i}"] == seen[f"n{i}"]), T.StringType())

    return T.StructType([T.StructField(c, kind(i, c)) for i, c in enumerate(raw.columns)])


def null_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL at the scan, so that aggregates skip it."""
    doubles = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.nanvl(F.col(c), F.lit(None)).alias(c) if c in doubles else F.col(c) for c in df.columns]
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, strings: Sequence[str] = ()) -> DataFrame:
    """A table from CSV with header.  Without a schema the types come from the values (``csv_schema``), text for
    the columns in ``strings`` whatever their values.  A value that does not fit the schema is an error."""
    schema = csv_schema(spark, path, strings) if schema is None else schema
    return null_nan(spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return null_nan(spark.read.parquet(path))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(position, Row, Description) from the column dictionary, a file in Latin-1."""
    raw = spark.read.option("header", True).option("encoding", DICTIONARY_ENCODING).csv(path)
    return raw.select(F.monotonically_increasing_id().alias("position"), "Row", "Description")


def write_dataset(df: DataFrame, path: str) -> None:
    """A prepared dataset.  No row number is stored: the key is a column."""
    df.write.mode("overwrite").parquet(path)


def write_result(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A small result table (scores, parameters, coefficients)."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def read_result(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
