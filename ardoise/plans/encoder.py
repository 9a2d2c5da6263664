"""One fitted object from raw tables to features: codes, categories of all tables, and the order of the features.

``LoanEncoder`` is an estimator of Spark ML.  It is fitted on the training applications and reads the history tables by
name from the session's catalog, as ``SQLTransformer`` reads its table; ``prefix`` stands before the names of all of them.
The fitted ``LoanEncoderModel`` turns applications into the wide table with exactly the fitted columns.  It is saved
like any stage, also within a pipeline, and next month reads next month's tables under the same names:

* a category that the new tables lack keeps its column, which is zero;
* a category that they add has no column, an added code is -1;
* a column that they lack counts as missing everywhere, a further one is ignored.

Saved are the parameters and four small tables in Parquet: schemas, codes, categories and features.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ardoise.functions.aggspec import quoted
from ardoise.operators.encode import Categories, categorical_columns, discover_categories
from ardoise.plans import blocks
from ardoise.plans.specs import CODED, KEY
from ardoise.plans.wide import IS_TRAIN, LoanTables, feature_blocks

#: History tables by the names that they have in the catalog, behind the prefix.
HISTORY = ("bureau", "bureau_balance", "previous", "pos", "installments", "card")
APPLICATION = "application"
#: Columns of applications that are no features and pass through.
PASSING = ("TARGET", IS_TRAIN)


class _LoanParams(Params):
    prefix = Param(Params._dummy(), "prefix", "stands before the names of the history tables", TypeConverters.toString)
    onZero = Param(Params._dummy(), "onZero", "ratio with a zero divisor: ieee or null", TypeConverters.toString)
    maxCategories = Param(Params._dummy(), "maxCategories", "more categories in a table are an error", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(prefix="", onZero="ieee", maxCategories=10_000)

    def history(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {n: spark.table(self.getOrDefault("prefix") + n) for n in HISTORY}


def register(tables: LoanTables, prefix: str = "") -> None:
    """Temporary views of the history tables under the names that the encoder reads."""
    for name in HISTORY:
        getattr(tables, name).createOrReplaceTempView(prefix + name)


def conform(df: DataFrame, schema: T.StructType, passing: tuple[str, ...] = ()) -> DataFrame:
    """The fitted columns with the fitted types; an absent one is missing everywhere.  ``passing`` columns stay."""
    have = set(df.columns)
    cells = [
        (F.col(quoted(f.name)).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema
    ]
    return df.select(*cells, *[c for c in passing if c in have])


class LoanEncoder(_LoanParams, Estimator, MLReadable, MLWritable):
    """Fits codes, categories and the order of the features on training applications and the history tables."""

    @keyword_only
    def __init__(self, *, prefix: str = "", onZero: str = "ieee", maxCategories: int = 10_000,
                 digits: Mapping[str, Mapping[str, int]] | None = None) -> None:
        super().__init__()
        given = {k: v for k, v in self._input_kwargs.items() if k != "digits"}
        self._set(**given)
        self.digits = {t: dict(d) for t, d in (digits or {}).items()}

    def copy(self, extra=None) -> LoanEncoder:
        other = super().copy(extra)
        other.digits = self.digits
        return other

    def write(self) -> MLWriter:
        return _StateWriter(self, {"digits": self.digits})

    @classmethod
    def read(cls) -> MLReader:
        return _EncoderReader(cls)

    def _fit(self, dataset: DataFrame) -> LoanEncoderModel:
        history = self.history(dataset.sparkSession)
        train = dataset.drop(*[c for c in PASSING if c in dataset.columns])
        tables = {APPLICATION: train, **history}
        most = self.getOrDefault("maxCategories")
        categories = {
            n: discover_categories(
                t, [c for c in categorical_columns(t) if n != APPLICATION or c not in CODED],
                nan_category=n != APPLICATION, max_categories=most,
            )
            for n, t in tables.items()
        }
        codes = {}
        for column, table in blocks.fit_codes(train).items():
            rows = table.orderBy("code").limit(most + 1).collect()
            if len(rows) > most:
                raise ValueError(f"more than {most} values of {column}")
            codes[column] = [r["value"] for r in rows]
        schemas = {n: t.schema for n, t in tables.items()}
        model = LoanEncoderModel(schemas, codes, categories, [], self.digits)
        model = self._copyValues(model)
        # The columns that one empty application gets are the features and their order.
        model.columns = [c for c in model.transform(train.limit(0)).columns if c != KEY]
        return model


class LoanEncoderModel(_LoanParams, Model, MLReadable, MLWritable):
    """Raw applications to the wide table, with frozen codes, categories and columns."""

    def __init__(self, schemas: Mapping[str, T.StructType] | None = None, codes: Mapping[str, list[str]] | None = None,
                 categories: Mapping[str, Categories] | None = None, columns: list[str] | None = None,
                 digits: Mapping[str, Mapping[str, int]] | None = None) -> None:
        super().__init__()
        self.schemas, self.codes = dict(schemas or {}), dict(codes or {})
        self.categories, self.columns = dict(categories or {}), list(columns or [])
        self.digits = {t: dict(d) for t, d in (digits or {}).items()}

    def copy(self, extra=None) -> LoanEncoderModel:
        other = super().copy(extra)
        for name in ("schemas", "codes", "categories", "columns", "digits"):
            setattr(other, name, getattr(self, name))
        return other

    def write(self) -> MLWriter:
        return _ModelWriter(self, {"digits": self.digits})

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """(key, passing columns, features) of every application."""
        spark = dataset.sparkSession
        tables = {n: conform(t, self.schemas[n]) for n, t in self.history(spark).items()}
        rows = conform(dataset, self.schemas[APPLICATION], PASSING)
        codes = {c: spark.createDataFrame(list(zip(v, range(len(v)))), "value string, code int") for c, v in self.codes.items()}
        on_zero = self.getOrDefault("onZero")
        app = blocks.application(rows, codes, self.categories[APPLICATION], on_zero=on_zero)
        loans = LoanTables(rows, rows, *[tables[n] for n in HISTORY], digits=self.digits)
        history = feature_blocks(loans, on_zero, self.categories)
        wide = reduce(lambda left, block: left.join(block, KEY, "left"), history.values(), app)
        passing = [c for c in PASSING if c in dataset.columns]
        features = self.columns or [c for c in wide.columns if c != KEY and c not in passing]
        return wide.select(KEY, *passing, *[quoted(c) for c in features])


class _StateWriter(MLWriter):
    """Parameters and what else fits into the metadata."""

    def __init__(self, instance, extra: dict) -> None:
        super().__init__()
        self.instance, self.extra = instance, extra

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata=self.extra)


class _ModelWriter(_StateWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        m, spark = self.instance, self.sparkSession
        tables = {
            "schemas": ([(n, s.json()) for n, s in m.schemas.items()], "name string, fields string"),
            "codes": ([(c, v, i) for c, values in m.codes.items() for i, v in enumerate(values)], "column string, value string, code int"),
            "coded": ([(c,) for c in m.codes], "column string"),
            "categories": (
                [(n, c, v, i) for n, by in m.categories.items() for c, values in by.items() for i, v in enumerate(values)],
                "name string, column string, value string, place int",
            ),
            "categorical": ([(n, c, i) for n, by in m.categories.items() for i, c in enumerate(by)], "name string, column string, place int"),
            "features": (list(enumerate(m.columns)), "place int, name string"),
        }
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}")


class _EncoderReader(MLReader):
    def __init__(self, cls) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> LoanEncoder:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        encoder = self.cls(digits=metadata["digits"])
        encoder._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(encoder, metadata)
        return encoder


class _ModelReader(_EncoderReader):
    def load(self, path: str) -> LoanEncoderModel:
        model = super().load(path)

        def rows(name: str, *order: str) -> list:
            # The size of the fitted state, whatever the number of applications.
            return self.sparkSession.read.parquet(f"{path}/{name}").orderBy(*order).collect()

        model.schemas = {r["name"]: T._parse_datatype_json_string(r["fields"]) for r in rows("schemas", "name")}
        model.codes = {r["column"]: [] for r in rows("coded", "column")}
        for r in rows("codes", "column", "code"):
            model.codes[r["column"]].append(r["value"])
        model.categories = {n: {} for n in model.schemas}
        for r in rows("categorical", "name", "place"):
            model.categories[r["name"]][r["column"]] = []
        for r in rows("categories", "name", "column", "place"):
            model.categories[r["name"]][r["column"]].append(r["value"])
        model.columns = [r["name"] for r in rows("features", "place")]
        return model
