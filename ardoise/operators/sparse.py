"""One-hot encoding for columns with very many categories.

A category is a row of an index table, never a column of a plan, and none is collected: ``fit_sparse`` numbers the
distinct values of every column from 0, in their order, with the missing value last; ``vectors`` builds one sparse
vector per row from these numbers.  Values are numbered in ranges: each task counts its own, one row per task says where
it begins.  A value that a third of the rows have is met by broadcast, the others by a shuffle.  Values that the index
does not know are zero everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ardoise.operators.encode import category_pairs
from ardoise.operators.skew import BROADCAST_ROWS, lookup_join
from ardoise.sources.workdir import materialise

#: Columns that are looked up by a shuffle before the rows are written.
SHUFFLED = 2


def _number_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, done = TaskContext.get().partitionId(), 0
    for b in batches:
        here = pa.array(range(done, done + b.num_rows), pa.int64())
        done += b.num_rows
        yield pa.RecordBatch.from_arrays([b["column"], b["value"], pa.array([part] * b.num_rows, pa.int32()), here], ["column", "value", "part", "here"])


def _numbered(pairs: DataFrame, name: str) -> DataFrame:
    """(column, value, index): values numbered from 0 within their column, in order."""
    ranged = pairs.repartitionByRange("column", "value").sortWithinPartitions("column", "value")
    placed = materialise(ranged.mapInArrow(_number_partition, "column string, value string, part int, here bigint"), name)
    # Numbers are made when the table is read: it is written once.
    # One row per task and column: how many values of the column lie in the tasks before, and where it begins in its own.
    starts = placed.groupBy("column", "part").agg(F.min("here").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("column", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("_shift"))
    joined = placed.join(F.broadcast(materialise(starts, "starts")), ["column", "part"])
    return joined.select("column", "value", (F.col("here") + F.col("_shift")).alias("index"))


def _number(column: str) -> Column:
    """A numeric feature; a missing one is an error, as in the dense vectors."""
    value = F.col(column).cast("double")
    return F.when(value.isNull() | F.isnan(value), F.raise_error(F.lit(f"{column} has a missing value"))).otherwise(value)


@dataclass
class SparseCategories:
    """Index table (column, value, index), number of known values per column, and whether missing ones count."""

    table: DataFrame
    known: dict[str, int]
    nan_category: bool = True

    def sizes(self) -> dict[str, int]:
        """Places of each column in the vector."""
        return {c: n + self.nan_category for c, n in self.known.items()}

    def indices(self, df: DataFrame, replace: bool = False) -> DataFrame:
        """Add ``<column>_index``: the value's number in its column; missing for values without one.  With ``replace`` the
        numbers stand instead of the columns; after every few columns that are looked up by a shuffle the rows are then
        written, so that the shuffles of all columns are not on the disks at once."""
        given, shuffled = df, 0
        for column, n in self.known.items():
            own = self.table.where(F.col("column") == column).select(F.col("value").alias(column), F.col("index").alias("_index"))
            if replace and n > BROADCAST_ROWS:
                if shuffled == SHUFFLED:
                    df, shuffled = materialise(df, "indices"), 0
                shuffled += 1
            # The values are those of the given table, whatever was looked up before.
            joined = lookup_join(df, own, [column], hot_in=given)
            index = F.col("_index")
            if self.nan_category:
                index = F.when(F.col(column).isNull(), F.lit(n)).otherwise(index)
            kept = [c for c in df.columns if not (replace and c == column)]
            df = joined.select(*kept, index.cast("bigint").alias(f"{column}_index"))
        return df

    def long(self, df: DataFrame, *keep: str) -> DataFrame:
        """(keep, column, index) of all values that have a number, numbered over all columns one after the other."""
        cells, start = [], 0
        for column, n in self.sizes().items():
            cells.append(F.struct(F.lit(column).alias("column"), (F.col(f"{column}_index") + F.lit(start)).alias("index")))
            start += n
        return self.indices(df).select(*keep, F.inline(F.array(*cells))).where(F.col("index").isNotNull())

    def vectors(self, df: DataFrame, output: str = "features", numeric: Sequence[str] = ()) -> DataFrame:
        """Replace the columns by one sparse vector: the numeric features, then the places of each column."""
        sizes = self.sizes()
        if any(n >= 1 << 31 for n in sizes.values()) or sum(sizes.values()) + len(numeric) >= 1 << 31:
            raise ValueError("a vector has fewer than 2**31 places")
        # (place, value) of all that may differ from zero, in the order of the places.
        cells = [F.struct(F.lit(i).alias("place"), _number(c).alias("value")) for i, c in enumerate(numeric)]
        start = len(numeric)
        for c, n in sizes.items():
            if n:
                cells.append(F.struct((F.col(f"{c}_index") + F.lit(start)).cast("int").alias("place"), F.lit(1.0).alias("value")))
            start += n
        # An unknown value has no place.
        filled = F.filter(F.array(*cells), lambda e: e["place"].isNotNull() & (e["value"] != 0)) if cells else F.array()
        filled = filled.cast("array<struct<place:int,value:double>>")
        parts = F.struct(
            F.lit(0).cast("tinyint").alias("type"), F.lit(start).alias("size"), filled["place"].alias("indices"), filled["value"].alias("values")
        )
        # The encoder and the assembler of Spark ML name every place in the column's metadata, which the driver holds: millions
        # of names.  Here it says how many there are.
        vector = F.from_json(F.to_json(F.struct(parts.alias("v"))), StructType([StructField("v", VectorUDT())]))["v"]
        kept = [c for c in df.columns if c not in self.known]
        return self.indices(df, replace=True).select(*kept, vector.alias(output, metadata={"ml_attr": {"num_attrs": start}}))

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(f"{path}/index")
        rows = [(i, c, n, self.nan_category) for i, (c, n) in enumerate(self.known.items())]
        spark = self.table.sparkSession
        spark.createDataFrame(rows, "place int, column string, known bigint, nan_category boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SparseCategories:
        # One row per column.
        rows = spark.read.parquet(f"{path}/columns").orderBy("place").collect()
        return cls(spark.read.parquet(f"{path}/index"), {r["column"]: r["known"] for r in rows}, bool(rows and rows[0]["nan_category"]))


def fit_sparse(df: DataFrame, columns: Sequence[str], nan_category: bool = True) -> SparseCategories:
    """Number the values of the columns; one pass with map-side distinct, one shuffle of the distinct values."""
    if not columns:
        raise ValueError("no columns to encode")
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    table = _numbered(category_pairs(text, columns), "values")
    # One row per column.
    found = {r["column"]: r["n"] for r in table.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    return SparseCategories(table, {c: found.get(c, 0) for c in columns}, nan_category)
