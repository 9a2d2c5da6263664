"""Written tables and fitted objects that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ardoise.catalog.standin import loan_tables
from ardoise.plans import scoring
from ardoise.plans.prepare import Prepared, prepare
from ardoise.plans.wide import wide_features
from ardoise.sources.workdir import materialise

_WIDE: dict[tuple[str, str, int], DataFrame] = {}
_PREPARED: dict[tuple[str, str, int], Prepared] = {}
_VECTORS: dict[tuple[str, str, int], DataFrame] = {}
_SCORERS: dict[tuple[str, str, int], scoring.Scorer] = {}


def file_state(spark: SparkSession, folder: str) -> int:
    """A number that changes with any file of the folder: names, sizes and times, listed without reading them."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    state = listed.select(F.xxhash64("path", "length", "modificationTime").alias("x"))
    return state.agg(F.bit_xor("x"), F.count(F.lit(1))).select(F.xxhash64("*")).first()[0]


def _once(store: dict, spark: SparkSession, folder: str, make):
    """Made on first use; later queries of the session share it while the folder's files are the same."""
    at = (spark.sparkContext.applicationId, folder, file_state(spark, folder))
    if at not in store:
        store[at] = make()
    return store[at]


def forget() -> None:
    """Later queries make their shared tables anew."""
    for store in (_WIDE, _PREPARED, _VECTORS, _SCORERS):
        store.clear()


def wide_table(spark: SparkSession, folder: str) -> DataFrame:
    return _once(_WIDE, spark, folder, lambda: materialise(wide_features(loan_tables(spark, folder)), "features"))


def prepared(spark: SparkSession, folder: str) -> Prepared:
    return _once(_PREPARED, spark, folder, lambda: prepare(wide_table(spark, folder), written=True))


def scorer(spark: SparkSession, folder: str) -> scoring.Scorer:
    return _once(_SCORERS, spark, folder, lambda: scoring.train_scorer(prepared(spark, folder)))


def vectors_of(spark: SparkSession, folder: str) -> DataFrame:
    return _once(_VECTORS, spark, folder, lambda: scoring.training_vectors(prepared(spark, folder)))
