"""How kept rows are dealt to partitions, and that folds share one copy of them."""

from pyspark.sql import functions as F

from perdura.operators import caching
from perdura.operators.stages import DeviationCrossValidator, DeviationEvaluator
from perdura.operators.tobit import TobitRegression


def test_no_kept_partition_holds_more_than_its_share(spark, monkeypatch):
    monkeypatch.setattr(caching, "PART_ROWS", 1000)
    rows = spark.range(0, 30_000, numPartitions=9).select("id", (F.col("id") % 7).alias("v"))
    kept = caching.cached(rows)
    parts = [r["n"] for r in kept.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(parts) == 30_000 and max(parts) <= 1100
    assert kept.agg(F.sum("v")).first()[0] == rows.agg(F.sum("v")).first()[0]
    kept.unpersist()
    even = caching.cached(spark.range(0, 8_000, numPartitions=9))
    assert even.rdd.getNumPartitions() == 9
    even.unpersist()


def test_folds_read_one_copy_of_the_rows(spark):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(v):
        reads.add(1)
        return float(v)

    rows = spark.range(0, 600, numPartitions=2).select(
        ((F.col("id") % 13) / 6 - 1).alias("x"), seen((F.col("id") * 7 % 11) / 4).alias("y"), (F.col("id") % 3).alias("f")
    )
    validator = DeviationCrossValidator(
        TobitRegression(features=["x"], labelCol="y", censorRight=2.0), DeviationEvaluator(labelCol="y"), [{"C": 0.0}], "f"
    )
    assert validator.scores(rows).count() == 3
    assert reads.value <= 1200  # kept once; before, each fold read the source for both its parts
