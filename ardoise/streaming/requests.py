"""Requests arriving as files are decided as they come: a stateless join of the stream of ids with the
table of features, or a lookup of each micro-batch in a store of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ardoise.functions.exprs import decide
from ardoise.plans.scoring import Scorer
from ardoise.plans.specs import KEY
from ardoise.sources.store import FeatureStore

DECISIONS = f"{KEY} bigint, rep string, proba double"


def request_stream(
    spark: SparkSession, folder: str, schema: str = f"{KEY} bigint", fmt: str = "json", glob: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Stream of request records from a folder."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


# Answer to a request about an applicant without features.
UNKNOWN = "Inconnue"


def decide_stream(requests: DataFrame, wide: DataFrame, scorer: Scorer, key: str = KEY) -> DataFrame:
    """One answer per request: the decision, or ``UNKNOWN`` without a probability where no features are known."""
    known = requests.select(key).join(wide.withColumn("_known", F.lit(True)), key, "left")
    scored = scorer.probabilities(known, key, "_known")
    sure = F.col("_known").isNotNull()
    return scored.select(
        key,
        F.when(sure, decide("p", scorer.threshold)).otherwise(F.lit(UNKNOWN)).alias("rep"),
        F.when(sure, F.round("p", 2)).alias("proba"),
    )


def write_decisions(
    decisions: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append the decisions to a table.  The file sink and the checkpoint give each request one answer
    even when the job restarts."""
    writer = decisions.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.outputMode("append").start()


def decide_from_store(
    requests: DataFrame, store: FeatureStore, scorer: Scorer, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """One answer per request as ``decide_stream`` gives it, with the features of a micro-batch looked up in the
    store: a trigger reads the files of its applicants only.

    Each micro-batch has a folder of its own below ``path``, written over when the batch is repeated after a
    failure, so each request has one answer.
    """

    def answer(batch: DataFrame, number: int) -> None:
        batch = batch.select(store.key).persist()
        try:
            answers = decide_stream(batch, store.rows_of(batch), scorer, store.key)
            answers.write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    writer = requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_decisions(spark: SparkSession, path: str, schema: str = DECISIONS) -> DataFrame:
    """The answers of all micro-batches."""
    return spark.read.schema(f"{schema}, batch bigint").parquet(path).drop("batch")
