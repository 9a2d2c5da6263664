"""Feature rows kept by key, so that a few requests read a few files.

The rows lie in folders by a hash of their key, about as many rows in each, sorted by key within the file and
with a Bloom filter of the keys.  A lookup computes the folders of its keys: all others are pruned before any
file is opened.  Few keys are also pushed into the scan, where the extremes and filters of row groups skip most
of what a file holds.

Keys are unique by contract; a key that was stored twice gives both rows.  Rows without a key cannot be asked
for and are left out.  Keys without features, and null, give no row; an empty table makes an empty store.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROWS_PER_FOLDER = 100_000
#: More keys than this are not pushed into the scan; they meet the rows of their folders in a join.
PUSHED = 1_000
#: Bytes of a row group: small, since a lookup reads whole ones.
ROW_GROUP = 8 << 20
FOLDER = "_folder"


def _folder(key: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(folders)).cast("int")


@dataclass(frozen=True)
class FeatureStore:
    rows: DataFrame
    key: str
    folders: int

    @classmethod
    def write(cls, df: DataFrame, path: str, key: str, rows_per_folder: int = ROWS_PER_FOLDER) -> FeatureStore:
        """Stores ``df``, which should be a written table: it is counted first.  One shuffle, one file a folder."""
        spark = df.sparkSession
        folders = max(1, math.ceil(df.count() / rows_per_folder))
        rows = df.where(F.col(key).isNotNull()).withColumn(FOLDER, _folder(F.col(key), folders))
        (
            rows.repartition(folders, FOLDER).sortWithinPartitions(FOLDER, key).write.partitionBy(FOLDER)
            .option(f"parquet.bloom.filter.enabled#{key}", "true")
            .option(f"parquet.bloom.filter.expected.ndv#{key}", str(rows_per_folder))
            .option("parquet.block.size", str(ROW_GROUP))
            .parquet(f"{path}/rows")
        )
        # Written last: a store without it is not whole.
        about = [(key, folders, rows.schema.json())]
        spark.createDataFrame(about, "key string, folders int, columns string").coalesce(1).write.json(f"{path}/about")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureStore:
        about = spark.read.schema("key string, folders int, columns string").json(f"{path}/about").first()
        columns = StructType.fromJson(json.loads(about["columns"]))
        return cls(spark.read.schema(columns).parquet(f"{path}/rows"), about["key"], about["folders"])

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """Rows of the keys in column ``key`` of ``keys``, each once, whatever the number of requests about it."""
        kind = self.rows.schema[self.key].dataType
        wanted = keys.select(F.col(self.key).cast(kind).alias(self.key)).where(F.col(self.key).isNotNull()).distinct()
        # Numbers of folders: at most as many as the store has, and one per 100,000 applicants.
        folders = sorted(r[0] for r in wanted.select(_folder(F.col(self.key), self.folders)).distinct().collect())
        rows = self.rows if len(folders) == self.folders else self.rows.where(F.col(FOLDER).isin(folders))
        rows = rows.drop(FOLDER)
        few = [r[0] for r in wanted.limit(PUSHED + 1).collect()]
        if len(few) <= PUSHED:
            return rows.where(F.col(self.key).isin(few))
        return rows.join(wanted, self.key, "left_semi")
