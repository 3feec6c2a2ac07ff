"""The fitted steps as ``pyspark.ml`` estimators and models, so that a whole preparation can be fitted, saved and loaded as one ``Pipeline``.

What is learned is a table: models keep its DataFrame, and write it as Parquet
beside their metadata. A dictionary of any size stays out of the driver.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import encoding, scaling, selection
from netloom.sources.sinks import stored


class HasColumns(Params):
    """The columns that a step learns from and changes."""

    columns = Param(Params._dummy(), "columns", "columns to learn from", TypeConverters.toListString)

    def getColumns(self) -> list[str]:  # noqa: N802
        return self.getOrDefault(self.columns)


class TableWriter(MLWriter):
    def __init__(self, instance: TableModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:  # noqa: N802
        spark = SparkSession.active()
        DefaultParamsWriter.saveMetadata(self.instance, path, spark)
        self.instance.table.write.mode("overwrite").parquet(f"{path}/table")


class TableReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> TableModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = self.kind(spark.read.parquet(f"{path}/table"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class TableModel(Model, HasColumns, MLReadable, MLWritable):
    """A model that is a table and its parameters."""

    def __init__(self, table: DataFrame | None = None):
        super().__init__()
        self.table = table

    def write(self) -> TableWriter:
        return TableWriter(self)

    @classmethod
    def read(cls) -> TableReader:
        return TableReader(cls)


class _TableEstimator(Estimator, HasColumns, DefaultParamsReadable, DefaultParamsWritable):
    model: type[TableModel]

    def _learned(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _fit(self, df: DataFrame) -> TableModel:
        return self._copyValues(self.model(stored(self._learned(df), type(self).__name__.lower())))


class HasUnknown(Params):
    unknown = Param(Params._dummy(), "unknown", "what stands for values that were not seen", TypeConverters.toString)


class CoderModel(TableModel, HasUnknown):
    """Codes in place of categories; a value that was not seen, or none, gets the code of the unknown mark."""

    def _transform(self, df: DataFrame) -> DataFrame:
        names = df.columns
        for c in self.getColumns():
            own = self.table.filter(F.col("column") == c).select("value", "code")
            df = encoding.apply_codes_with_unknown(df, c, own, f"{c}__code", self.getOrDefault(self.unknown)).drop(c).withColumnRenamed(f"{c}__code", c)
        return df.select(*[F.col(f"`{c}`") for c in names])


class Coder(_TableEstimator, HasUnknown):
    """Learns (column, value, code): the sorted distinct values of each column, the unknown mark among them."""

    model = CoderModel

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, unknown: str = encoding.UNKNOWN):
        super().__init__()
        self._setDefault(unknown=encoding.UNKNOWN)
        self._set(**self._input_kwargs)

    def _learned(self, df: DataFrame) -> DataFrame:
        every = None
        for c in self.getColumns():
            own = encoding.fit_codes_with_unknown(df, c, self.getOrDefault(self.unknown)).select(F.lit(c).alias("column"), "value", "code")
            every = own if every is None else every.unionByName(own)
        return every if every is not None else df.sparkSession.createDataFrame([], "column string, value string, code int")


class ScalerModel(TableModel):
    """Columns scaled to the fitted ranges; a constant one becomes 0."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return scaling.apply_min_max(df, self.getColumns(), self.table).select(*[F.col(f"`{c}`") for c in df.columns])


class Scaler(_TableEstimator):
    """Learns each column's smallest and largest value, in one aggregation."""

    model = ScalerModel

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _learned(self, df: DataFrame) -> DataFrame:
        return scaling.fit_min_max(df, self.getColumns())


class HasLabel(Params):
    label = Param(Params._dummy(), "label", "the class column", TypeConverters.toString)
    k = Param(Params._dummy(), "k", "how many columns stay", TypeConverters.toInt)


class SelectorModel(TableModel, HasLabel):
    """Without the columns that were not chosen; other columns stay."""

    def _transform(self, df: DataFrame) -> DataFrame:
        # A row for each chosen feature.
        chosen = {r.feature for r in self.table.collect()}
        return df.drop(*[c for c in self.getColumns() if c not in chosen])


class Selector(_TableEstimator, HasLabel):
    """Learns (place, feature): the k best columns by chi-squared scores."""

    model = SelectorModel

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, label: str | None = None, k: int = 25):
        super().__init__()
        self._setDefault(k=25)
        self._set(**self._input_kwargs)

    def _learned(self, df: DataFrame) -> DataFrame:
        best = selection.select_k_best(df, self.getColumns(), self.getOrDefault(self.label), self.getOrDefault(self.k), selection.chi2)
        return df.sparkSession.createDataFrame(list(enumerate(best)), "place int, feature string")
