"""A custom evaluator and a cross-validator that keeps every fold's score."""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perdura.operators.caching import cached
from perdura.operators.evaluate import rmse


class DeviationEvaluator(Evaluator, DefaultParamsReadable, DefaultParamsWritable):
    """Root mean squared error; smaller is better."""

    labelCol = Param(Params._dummy(), "labelCol", "label", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction", TypeConverters.toString)

    def __init__(self, **values) -> None:
        super().__init__()
        self._setDefault(labelCol="label", predictionCol="prediction")
        self._set(**values)

    def _evaluate(self, dataset: DataFrame) -> float:
        y = F.col(self.getOrDefault("labelCol"))
        p = F.col(self.getOrDefault("predictionCol"))
        return float(dataset.agg(rmse(y, p)).first()[0])

    def isLargerBetter(self) -> bool:
        return False


class DeviationCrossValidator:
    """Score every setting on every fold; the rows are cached once, for all folds."""

    def __init__(
        self, estimator: Estimator, evaluator: Evaluator, settings: list[dict], foldCol: str
    ) -> None:
        self.estimator, self.evaluator = estimator, evaluator
        self.settings, self.fold = settings, foldCol

    def scores(self, df: DataFrame) -> DataFrame:
        kept = cached(df)
        folds = [r[0] for r in kept.select(self.fold).distinct().limit(1001).collect()]
        if len(folds) > 1000:
            raise ValueError("more than 1000 folds")
        rows = []
        for fold in sorted(folds):
            train, held = kept.filter(F.col(self.fold) != fold), kept.filter(F.col(self.fold) == fold)
            for setting in self.settings:
                params = {self.estimator.getParam(k): v for k, v in setting.items()}
                model = self.estimator.fit(train, params)
                text = ",".join(f"{k}={setting[k]}" for k in sorted(setting))
                rows.append((text, int(fold), self.evaluator.evaluate(model.transform(held))))
        kept.unpersist()
        return df.sparkSession.createDataFrame(rows, "setting string, fold int, score double")
