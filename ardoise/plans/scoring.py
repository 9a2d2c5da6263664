"""Training, choice of threshold and batch decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ardoise.functions.aggspec import quoted
from ardoise.functions.exprs import decide
from ardoise.operators.clean import Preparation, filled_sql, finite_sql, scaled_sql
from ardoise.operators.metrics import best_threshold, f1_curve
from ardoise.operators.models import LABEL, assembler, logistic, predict, vectors
from ardoise.operators.split import add_class_weights
from ardoise.plans.encoder import LoanEncoderModel
from ardoise.plans.prepare import Prepared
from ardoise.plans.specs import KEY
from ardoise.sources.workdir import materialise


def cleaning_stage(p: Preparation) -> SQLTransformer:
    """Cleaning and scaling with frozen statistics as a pipeline stage: ``s_<feature>`` columns."""
    cells = [
        f"{scaled_sql(filled_sql(finite_sql(c), p.medians[c]), *p.ranges[c])} as {quoted('s_' + c)}" for c in p.features
    ]
    return SQLTransformer(statement=f"select *, {', '.join(cells)} from __THIS__")


def as_pipeline(p: Preparation, model) -> PipelineModel:
    """Cleaning, scaling, feature vector in frozen order and model in one object that Spark saves."""
    return PipelineModel([cleaning_stage(p), assembler([f"s_{c}" for c in p.features]), model])


@dataclass
class Scorer:
    """What a scoring job needs: the fitted pipeline and the threshold."""

    pipeline: PipelineModel
    threshold: float

    def save(self, spark: SparkSession, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        row = spark.createDataFrame([(self.threshold,)], "Threshold double")
        row.coalesce(1).write.mode("overwrite").json(f"{path}/threshold")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scorer:
        row = spark.read.schema("Threshold double").json(f"{path}/threshold").first()
        return cls(PipelineModel.load(f"{path}/pipeline"), row["Threshold"])

    def with_encoder(self, encoder: LoanEncoderModel) -> Scorer:
        """From raw tables to decisions in one saved object: codes, categories and feature order included."""
        lacking = set(self.features()) - set(encoder.columns)
        if lacking:
            raise ValueError(f"the encoder does not make {sorted(lacking)[:5]}")
        return Scorer(PipelineModel([encoder, *self.pipeline.stages]), self.threshold)

    def features(self) -> list[str]:
        """Features in the order of the pipeline's vector."""
        vector = next(s for s in self.pipeline.stages if isinstance(s, VectorAssembler))
        return [c.removeprefix("s_") for c in vector.getInputCols()]

    def probabilities(self, wide: DataFrame, *keep: str) -> DataFrame:
        """Probability of class 1.  A feature that the table lacks, because no applicant in it has that category,
        is 0, as for any applicant without it; columns that the pipeline does not know are ignored.  A pipeline that
        begins with an encoder takes raw applications instead."""
        encoded = isinstance(self.pipeline.stages[0], LoanEncoderModel)
        absent = {} if encoded else {c: F.lit(0.0) for c in self.features() if c not in wide.columns}
        wide = wide.withColumns(absent) if absent else wide
        return self.pipeline.transform(wide).select(*keep, vector_to_array("probability")[1].alias("p"))

    def decisions(self, wide: DataFrame, key: str = KEY) -> DataFrame:
        """(key, rep, proba): the decision on the unrounded probability, the probability to two digits."""
        scored = self.probabilities(wide, key)
        return scored.select(key, decide("p", self.threshold).alias("rep"), F.round("p", 2).alias("proba"))


def training_vectors(data: Prepared) -> DataFrame:
    """Weighted training vectors, written once: fitting scans them again and again."""
    rows = vectors(add_class_weights(data.train, LABEL), data.preparation.features, LABEL, "weight")
    return materialise(rows, "vectors")


def train_scorer(data: Prepared, C: float = 1.0, penalty: str = "l2") -> Scorer:
    """Logistic regression with balanced class weights on the prepared (scaled) training rows; threshold
    of the highest F1 on the validation rows."""
    features = data.preparation.features
    model = logistic(training_vectors(data), C=C, penalty=penalty)
    held = predict(model, vectors(data.valid, features, LABEL))
    best = best_threshold(f1_curve(held, LABEL, "proba")).first()
    return Scorer(as_pipeline(data.preparation, model), best["threshold"])
