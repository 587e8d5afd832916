"""Regression and classification metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perdura.operators.aggregates import present
from perdura.operators.quantiles import running_totals


def pseudo_r2(y: Column, prediction: Column) -> Column:
    """corr^2; null when either side is constant, where ``corr`` would fail."""
    varies = (F.var_pop(y) > 0) & (F.var_pop(prediction) > 0)
    cov = F.covar_pop(y, prediction)
    return F.when(varies, cov * cov / (F.var_pop(y) * F.var_pop(prediction)))


def mse(y: Column, prediction: Column) -> Column:
    return F.avg((y - prediction) * (y - prediction))


def rmse(y: Column, prediction: Column) -> Column:
    return F.sqrt(mse(y, prediction))


def r2(y: Column, prediction: Column) -> Column:
    return 1 - mse(y, prediction) / F.nullif(F.var_pop(y), F.lit(0.0))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    y, p = present(label), present(prediction)
    both = y.isNotNull() & p.isNotNull()
    y, p = F.when(both, y), F.when(both, p)
    return df.agg(
        mse(y, p).alias("mse"),
        rmse(y, p).alias("rmse"),
        r2(y, p).alias("r2"),
        pseudo_r2(y, p).alias("pseudo_r2"),
    )


def grouped_metrics(
    df: DataFrame, n: str, mean: str, variance: str, prediction: str, keys: Sequence[str] = ()
) -> DataFrame:
    """regression_metrics by key from groups of rows with one prediction: their number, and mean and variance of the label."""
    n, y, p = F.col(n), F.col(mean), F.col(prediction)
    whole = F.sum(n)
    means = df.groupBy(*keys).agg((F.sum(n * y) / whole).alias("_y"), (F.sum(n * p) / whole).alias("_p"))
    rows = df.join(F.broadcast(means), list(keys)) if keys else df.crossJoin(F.broadcast(means))
    dy, dp = y - F.col("_y"), p - F.col("_p")
    sums = rows.groupBy(*keys).agg(
        (F.sum(n * (F.col(variance) + (y - p) * (y - p))) / whole).alias("mse"),
        (F.sum(n * (F.col(variance) + dy * dy)) / whole).alias("_vy"),
        (F.sum(n * dp * dp) / whole).alias("_vp"),
        (F.sum(n * dy * dp) / whole).alias("_cov"),
    )
    vy, vp, cov = F.col("_vy"), F.col("_vp"), F.col("_cov")
    return sums.select(
        *keys,
        "mse",
        F.sqrt("mse").alias("rmse"),
        (1 - F.col("mse") / F.nullif(vy, F.lit(0.0))).alias("r2"),
        F.when((vy > 0) & (vp > 0), cov * cov / (vy * vp)).alias("pseudo_r2"),
    )


def generalization_gap(scores: DataFrame, keys: list[str], metric: str = "r2") -> DataFrame:
    """Train metric less test metric per setting, from Train / Test tagged rows."""
    train = F.max(F.when(F.col("dataset") == "Train", F.col(metric)))
    test = F.max(F.when(F.col("dataset") == "Test", F.col(metric)))
    return scores.groupBy(*keys).agg((train - test).alias("gap"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count("*").alias("cnt"))


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class of a 0 / 1 label."""
    pair = F.explode(F.array(F.lit(0), F.lit(1))).alias("class")
    counts = confusion(df, label, predicted).select(label, predicted, "cnt", pair)
    actual, said = F.col(label) == F.col("class"), F.col(predicted) == F.col("class")

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("cnt")).otherwise(0))

    hit, claimed, support = total(actual & said), total(said), total(actual)
    precision = F.coalesce(hit / F.nullif(claimed, F.lit(0)), F.lit(0.0))
    recall = F.coalesce(hit / F.nullif(support, F.lit(0)), F.lit(0.0))
    return counts.groupBy("class").agg(
        precision.alias("precision"),
        recall.alias("recall"),
        F.coalesce(2 * hit / F.nullif(claimed + support, F.lit(0)), F.lit(0.0)).alias("f1"),
        support.alias("support"),
    )


def score_groups(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """False and true positive rate at every distinct score."""
    groups = score_groups(df, label, score)
    ends = groups.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    total = ends.select(F.struct("p", "n")).scalar()
    return running_totals(groups, "threshold", ["pos", "neg"], descending=True).select(
        "threshold",
        (F.col("cum_neg") / total["n"]).alias("fpr"),
        (F.col("cum_pos") / total["p"]).alias("tpr"),
    )


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve; equal scores count half."""
    ranked = running_totals(score_groups(df, label, score), "threshold", ["pos"], descending=True)
    wins = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)
    return ranked.agg((F.sum(wins) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def accuracy(label: Column, predicted: Column) -> Column:
    return F.avg((label == predicted).cast("double"))


def hinge_loss(label: Column, score: Column) -> Column:
    sign = F.when(label == 1, 1.0).otherwise(-1.0)
    return F.avg(F.greatest(F.lit(0.0), 1 - sign * score))
