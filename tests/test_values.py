"""Dates, mapping, logs, hashes and probabilities."""

import math

import numpy as np
from pyspark.sql import functions as F

from perdura.functions import dates, numeric
from perdura.functions.probability import (
    chi_square_upper,
    log_ndtr,
    log_ndtr_and_mills,
    t_two_sided,
)


def test_stamp_year(spark):
    stamps = [20150708093011.0, float("nan"), None, 20151308093011.0, 19991231235959.0]
    df = spark.createDataFrame([(s,) for s in stamps], "s double")
    got = [r[0] for r in df.select(dates.stamp_year(F.col("s"))).collect()]
    assert got == [2015, None, None, None, 1999]


def test_years_do_not_depend_on_the_time_zone(spark):
    # 2010-12-31T23:30:00Z
    df = spark.createDataFrame([("4d1e68a8" + "0" * 16,)], "id string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert df.select(dates.objectid_year(F.col("id"))).first()[0] == 2010
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_age_label_treats_nan_as_missing(spark):
    oid = "4d1e68a8" + "0" * 16
    rows = [(float("nan"), 20150708093011.0, oid), (2000.0, None, oid), (None, None, oid)]
    df = spark.createDataFrame(rows, "f double, s double, id string")
    got = [
        r[0] for r in df.select(dates.age_label(F.col("f"), F.col("s"), F.col("id"))).collect()
    ]
    assert got == [5, 10, 0]


def test_value_mapping_gives_null_for_unknown(spark):
    df = spark.createDataFrame([("http",), ("https",), ("ftp",), (None,)], "s string")
    mapped = df.select(numeric.map_values(F.col("s"), {"http": 1, "https": 0})).collect()
    assert [r[0] for r in mapped] == [1, 0, None, None]


def test_shifted_log(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (-1.0,)], "x double")
    got = [r[0] for r in df.select(numeric.shifted_log(F.col("x"))).collect()]
    assert math.isclose(got[0], math.log(1e-11)) and got[2] is None


def test_hash_fraction_is_fixed_by_key_and_seed(spark):
    df = spark.range(20_000)
    for method in ("md5", "xxhash64"):
        u = numeric.hash_fraction(F.col("id"), seed=1, method=method)
        one = df.repartition(3).select("id", u.alias("u")).orderBy("id").collect()
        two = df.repartition(11).select("id", u.alias("u")).orderBy("id").collect()
        assert one == two
        values = np.array([r["u"] for r in one])
        assert 0 <= values.min() and values.max() < 1
        assert abs(values.mean() - 0.5) < 0.01 and abs(values.var() - 1 / 12) < 0.005


def test_log_normal_cdf():
    for x in (-30.0, -8.0, -3.0, -1.0, 0.0, 0.5, 3.0):
        want = math.log(0.5 * math.erfc(-x / math.sqrt(2)))
        assert math.isclose(float(log_ndtr(np.array(x))), want, rel_tol=1e-11, abs_tol=1e-15)


def test_far_tail_stays_finite():
    value, mills = log_ndtr_and_mills(np.array([-40.0, -1e4, -1e8]))
    # log phi(x) - log|x| - 1 / x^2 to leading order
    assert math.isclose(value[0], -800 - math.log(40 * math.sqrt(2 * math.pi)) - 1 / 1600, rel_tol=1e-6)
    assert np.isfinite(value).all()
    assert np.allclose(mills, [40.02496884720743, 1e4, 1e8], rtol=1e-7)


def test_p_values():
    # textbook points: t(10) 97.5 %, chi-square(10) 95 %, chi-square(100) 95 %
    assert math.isclose(t_two_sided(2.228139, 10), 0.05, abs_tol=1e-6)
    assert math.isclose(chi_square_upper(18.307038, 10), 0.05, abs_tol=1e-6)
    assert math.isclose(chi_square_upper(124.342113, 100), 0.05, abs_tol=1e-6)
    assert math.isclose(chi_square_upper(20_000, 20_000), 0.4987, abs_tol=1e-3)
