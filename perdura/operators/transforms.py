"""Feature stages as ``pyspark.ml`` transformers and estimators.

Stateless stages only add projections or filters, which Catalyst folds
together. A fitted stage runs one aggregate job and keeps its result, including
the columns it emits, so scoring never looks at the statistics of new rows.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perdura.functions import dates, html, numeric, url
from perdura.operators.aggregates import missing_for
from perdura.operators.column_stats import column_stats, numeric_columns
from perdura.operators.lookup import join_lookup
from perdura.operators.relational import pick_existing, rename_existing
from perdura.sources.staging import new_table_path, stage_table

INLINE_CATEGORIES = 10_000


def _param(name: str, doc: str, convert=TypeConverters.identity) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=convert)


class _Persisted(DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, **values) -> None:
        super().__init__()
        self._set(**values)

    def value(self, name: str):
        return self.getOrDefault(name)


class _Stage(_Persisted, Transformer):
    """A stage with nothing to fit.

    ``reads`` names the columns it needs. A stage that treats columns one by one gives
    instead its form beside a join key, which it leaves alone (``beside_key``).
    """

    selects = False  # whether it also decides which columns stay

    def reads(self) -> list[str]:
        raise NotImplementedError

    def beside_key(self, key: str) -> Transformer | None:
        return None


class _Fitted(_Persisted, Model):
    """What an estimator learned, as plain params, so it is saved with them."""


class _Learner(_Persisted, Estimator):
    pass


# ---------------------------------------------------------------- stateless stages


class TobitLabel(_Stage):
    """label = last known year - 1990."""

    def reads(self) -> list[str]:
        return ["last_available_timestamp", "id"]

    def _transform(self, df: DataFrame) -> DataFrame:
        label = dates.tobit_label(F.col("last_available_timestamp"), F.col("id"))
        return df.withColumn("label", label)


class AgeLabel(_Stage):
    """label = years between first and last appearance; negative ages dropped."""

    def reads(self) -> list[str]:
        return ["first_appear", "last_available_timestamp", "id"]

    def _transform(self, df: DataFrame) -> DataFrame:
        label = dates.age_label(
            F.col("first_appear"), F.col("last_available_timestamp"), F.col("id")
        )
        return df.withColumn("label", label).filter(F.col("label") >= 0)


class Chronology(_Stage):
    def reads(self) -> list[str]:
        return ["last_available_timestamp", "id"]

    def _transform(self, df: DataFrame) -> DataFrame:
        year = dates.last_year(F.col("last_available_timestamp"), F.col("id"))
        return df.withColumn("timestamp_coef", year)


class UrlFeatures(_Stage):
    """All URL features; hosts without a dot or with a malformed TLD are dropped."""

    def reads(self) -> list[str]:
        return ["url"]

    def _transform(self, df: DataFrame) -> DataFrame:
        return url.url_features(df).filter(url.is_valid_tld(F.col("suffix_idx")))


class PageShape(_Stage):
    """code_size and is_html5, which need the markup as it is."""

    def reads(self) -> list[str]:
        return ["html_text"]

    def _transform(self, df: DataFrame) -> DataFrame:
        text = F.col("html_text")
        return df.withColumns(
            {"code_size": html.code_size(text), "is_html5": html.is_html5(text)}
        )


class PageFeatures(_Stage):
    def reads(self) -> list[str]:
        return ["html_text"]

    def _transform(self, df: DataFrame) -> DataFrame:
        return html.default_registry().apply(df)


class EmptyHtmlFilter(_Stage):
    def reads(self) -> list[str]:
        return ["html_text"]

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.dropna(subset=["html_text"])


class ContentType(_Stage):
    def reads(self) -> list[str]:
        return ["header"]

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("content_type", html.content_type(F.col("header")))


class RenameColumns(_Stage):
    mapping = _param("mapping", "old name -> new name")

    def beside_key(self, key: str) -> RenameColumns:
        return RenameColumns(mapping={k: v for k, v in self.value("mapping").items() if k != key})

    def _transform(self, df: DataFrame) -> DataFrame:
        return rename_existing(df, self.value("mapping"))


class PresenceFlags(_Stage):
    columns = _param("columns", "columns to flag when present", TypeConverters.toListString)

    def beside_key(self, key: str) -> PresenceFlags:
        return PresenceFlags(columns=[c for c in self.value("columns") if c != key])

    def _transform(self, df: DataFrame) -> DataFrame:
        found = [c for c in self.value("columns") if c in df.columns]
        return df.withColumns({f"has_{c}": (~missing_for(df, c)).cast("int") for c in found})


class MapValues(_Stage):
    inputCol = _param("inputCol", "column to map", TypeConverters.toString)
    pairs = _param("pairs", "list of [from, to]; other values become null")

    def reads(self) -> list[str]:
        return [self.value("inputCol")]

    def _transform(self, df: DataFrame) -> DataFrame:
        name = self.value("inputCol")
        mapping = {k: v for k, v in self.value("pairs")}
        return df.withColumn(name, numeric.map_values(F.col(name), mapping))


class NanToZero(_Stage):
    columns = _param("columns", "columns to fill", TypeConverters.toListString)

    def beside_key(self, key: str) -> NanToZero:
        return NanToZero(columns=[c for c in self.value("columns") if c != key])

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.fillna(0, [c for c in self.value("columns") if c in df.columns])


class LogFeatures(_Stage):
    columns = _param("columns", "columns to take the log of", TypeConverters.toListString)

    def reads(self) -> list[str]:
        return list(self.value("columns"))

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: numeric.shifted_log(F.col(c)) for c in self.value("columns")}
        )


class PickColumns(_Stage):
    columns = _param("columns", "columns to keep", TypeConverters.toListString)

    selects = True

    def beside_key(self, key: str) -> PickColumns:
        return PickColumns(columns=list(dict.fromkeys([key, *self.value("columns")])))

    def _transform(self, df: DataFrame) -> DataFrame:
        return pick_existing(df, self.value("columns"))


class DropColumns(_Stage):
    columns = _param("columns", "columns to drop", TypeConverters.toListString)

    selects = True

    def beside_key(self, key: str) -> DropColumns:
        return DropColumns(columns=[c for c in self.value("columns") if c != key])

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.value("columns"))


# ---------------------------------------------------------------- fitted stages


class StagedRows(_Learner):
    """Write the rows once in ``fit``, so later fits read a narrow table instead
    of parsing pages and joining again."""

    def _fit(self, df: DataFrame) -> StagedRowsModel:
        model = StagedRowsModel()
        model.source, model.table = df, stage_table(df, "features")
        return model


class StagedRowsModel(_Fitted):
    """The staged table for the rows it was fitted on; other rows pass through.
    A model loaded from disk passes all rows through."""

    source: DataFrame | None = None
    table: DataFrame | None = None

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.source is not None and df.sameSemantics(self.source):
            return self.table
        return df


def suffix_dummies(df: DataFrame, suffixes=url.DUMMY_SUFFIXES) -> DataFrame:
    made = {s: (F.col("suffix_idx") == s).cast("int") for s in suffixes}
    return df.withColumns(made).drop("suffix_idx")


class SuffixDummies(_Learner):
    """One 0/1 column per known suffix; ``presentOnly`` keeps those in the data."""

    presentOnly = _param("presentOnly", "only suffixes seen in fit", TypeConverters.toBoolean)

    def __init__(self, **values) -> None:
        super().__init__()
        self._setDefault(presentOnly=False)
        self._set(**values)

    def _fit(self, df: DataFrame) -> SuffixDummiesModel:
        keep = list(url.DUMMY_SUFFIXES)
        if self.value("presentOnly"):
            seen = df.agg(
                *[F.bool_or(F.col("suffix_idx") == s).alias(f"s{i}") for i, s in enumerate(keep)]
            ).first()
            keep = [s for i, s in enumerate(keep) if seen[i]]
        return SuffixDummiesModel(suffixes=keep)


class SuffixDummiesModel(_Fitted):
    suffixes = _param("suffixes", "columns emitted", TypeConverters.toListString)

    def _transform(self, df: DataFrame) -> DataFrame:
        return suffix_dummies(df, self.value("suffixes"))


class FrequencyEncoder(_Learner):
    """Replace a category by its share of the fitted rows; unseen ones get 0."""

    inputCol = _param("inputCol", "category column", TypeConverters.toString)

    def _fit(self, df: DataFrame) -> FrequencyEncoderModel:
        name = self.value("inputCol")
        # keys are what Spark's cast makes of the category, here and in transform
        key = F.col(name).cast("string").alias("_key")
        counts = df.filter(F.col(name).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
        head = counts.limit(INLINE_CATEGORIES + 1).collect()
        if len(head) <= INLINE_CATEGORIES:
            total = sum(r["_n"] for r in head)
            shares = {r["_key"]: r["_n"] / total for r in head}
            return FrequencyEncoderModel(inputCol=name, shares=shares)
        total = counts.agg(F.sum("_n")).scalar()
        table = counts.select("_key", (F.col("_n") / total).alias("_share"))
        path = new_table_path(df.sparkSession, "frequencies")
        table.write.parquet(path)
        return FrequencyEncoderModel(inputCol=name, tablePath=path)


class FrequencyEncoderModel(_Fitted):
    inputCol = _param("inputCol", "category column", TypeConverters.toString)
    shares = _param("shares", "category -> share, for few categories")
    tablePath = _param("tablePath", "table of shares, for many", TypeConverters.toString)

    def _transform(self, df: DataFrame) -> DataFrame:
        name = self.value("inputCol")
        spark = df.sparkSession
        keyed = df.withColumn("_key", F.col(name).cast("string"))
        if self.isDefined("shares"):
            # at most INLINE_CATEGORIES rows
            rows = list(self.value("shares").items())
            table = spark.createDataFrame(rows, "_key string, _share double")
            joined = keyed.join(F.broadcast(table), "_key", "left")
        else:
            joined = join_lookup(keyed, spark.read.parquet(self.value("tablePath")), "_key")
        return (
            joined.withColumn(name, F.coalesce(F.col("_share"), F.lit(0.0)))
            .select(*df.columns)
        )


class PopulationScaler(_Learner):
    """z-scores with the population deviation for columns of 3 or more values.

    Output order: two-valued columns, scaled columns, other columns, kept
    columns, label. ``keepRaw`` names columns that also stay unscaled; their
    scaled form is called ``scaled_<name>``. A constant column becomes 0.
    """

    labelCol = _param("labelCol", "label, passed through", TypeConverters.toString)
    passCols = _param("passCols", "columns passed through", TypeConverters.toListString)
    keepRaw = _param("keepRaw", "columns kept beside their z-score", TypeConverters.toListString)

    def __init__(self, **values) -> None:
        super().__init__()
        self._setDefault(labelCol="label", passCols=[], keepRaw=[])
        self._set(**values)

    def _fit(self, df: DataFrame) -> PopulationScalerModel:
        label = self.value("labelCol")
        passed = [c for c in self.value("passCols") if c in df.columns]
        candidates = [c for c in df.columns if c not in (label, *passed)]
        numbers = [c for c in candidates if c in numeric_columns(df)]
        stats = column_stats(df, numbers)
        flags = [c for c in numbers if stats[c].distinct < 3]
        scaled = [c for c in numbers if c not in flags]
        return PopulationScalerModel(
            labelCol=label,
            flags=flags,
            scaled=scaled,
            others=[c for c in candidates if c not in numbers] + passed,
            means=[stats[c].mean for c in scaled],
            stds=[stats[c].std or 1.0 for c in scaled],
            keepRaw=[c for c in self.value("keepRaw") if c in scaled],
        )


class PopulationScalerModel(_Fitted):
    labelCol = _param("labelCol", "label", TypeConverters.toString)
    flags = _param("flags", "columns of one or two values", TypeConverters.toListString)
    scaled = _param("scaled", "columns scaled", TypeConverters.toListString)
    others = _param("others", "columns passed through", TypeConverters.toListString)
    means = _param("means", "means of the scaled columns", TypeConverters.toListFloat)
    stds = _param("stds", "population deviations", TypeConverters.toListFloat)
    keepRaw = _param("keepRaw", "columns kept unscaled too", TypeConverters.toListString)

    def _transform(self, df: DataFrame) -> DataFrame:
        raw = self.value("keepRaw")
        out = [F.col(c) for c in self.value("flags")]
        extra = []
        for c, mean, std in zip(self.value("scaled"), self.value("means"), self.value("stds")):
            z = (F.col(c) - F.lit(mean)) / F.lit(std)
            if c in raw:
                out.append(F.col(c))
                extra.append(z.alias(f"scaled_{c}"))
            else:
                out.append(z.alias(c))
        label = self.value("labelCol")
        tail = [label] if label in df.columns else []
        return df.select(*out, *self.value("others"), *extra, *tail)


class LowVarianceFilter(_Learner):
    """Drop two-valued columns of variance < p(1-p) and others of variance < p."""

    threshold = _param("threshold", "p", TypeConverters.toFloat)
    labelCol = _param("labelCol", "never tested", TypeConverters.toString)

    def __init__(self, **values) -> None:
        super().__init__()
        self._setDefault(labelCol="label")
        self._set(**values)

    def _fit(self, df: DataFrame) -> DropColumns:
        p = self.value("threshold")
        tested = [c for c in numeric_columns(df) if c != self.value("labelCol")]
        stats = column_stats(df, tested)
        drop = [
            c
            for c in tested
            if stats[c].variance < (p * (1 - p) if stats[c].distinct == 2 else p)
        ]
        return DropColumns(columns=drop)


class LabelScaler(_Learner):
    """z-score of the label, with the way back."""

    labelCol = _param("labelCol", "label", TypeConverters.toString)

    def __init__(self, **values) -> None:
        super().__init__()
        self._setDefault(labelCol="label")
        self._set(**values)

    def _fit(self, df: DataFrame) -> LabelScalerModel:
        name = self.value("labelCol")
        stats = column_stats(df, [name])[name]
        return LabelScalerModel(labelCol=name, mean=stats.mean, std=stats.std or 1.0)


class LabelScalerModel(_Fitted):
    labelCol = _param("labelCol", "label", TypeConverters.toString)
    mean = _param("mean", "mean", TypeConverters.toFloat)
    std = _param("std", "population deviation", TypeConverters.toFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        name = self.value("labelCol")
        z = (F.col(name) - F.lit(self.value("mean"))) / F.lit(self.value("std"))
        return df.withColumn(name, z)

    def inverse(self, df: DataFrame, column: str) -> DataFrame:
        back = F.col(column) * F.lit(self.value("std")) + F.lit(self.value("mean"))
        return df.withColumn(column, back)
