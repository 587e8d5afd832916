"""Years and life spans; none of it depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE_YEAR = 1990  # labels count years from here


def missing(col: Column) -> Column:
    """True for null and for NaN."""
    return col.isNull() | F.isnan(col)


def objectid_year(object_id: Column) -> Column:
    """UTC year of creation, held in the first eight hex digits."""
    seconds = F.conv(F.substring(object_id, 1, 8), 16, 10).try_cast("bigint")
    return F.year(F.date_from_unix_date(F.floor(seconds / 86400).cast("int")))


def stamp_year(stamp: Column) -> Column:
    """Year of a ``yyyyMMddHHmmss`` number; anything that is no date gives null."""
    text = stamp.try_cast("bigint").cast("string")
    return F.year(F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")))


def last_year(stamp: Column, object_id: Column) -> Column:
    return F.coalesce(stamp_year(stamp), objectid_year(object_id))


def tobit_label(stamp: Column, object_id: Column) -> Column:
    return last_year(stamp, object_id) - BASE_YEAR


def age_label(first_appear: Column, stamp: Column, object_id: Column) -> Column:
    first = F.when(~missing(first_appear), first_appear)
    return last_year(stamp, object_id) - F.coalesce(first, objectid_year(object_id))


def wayback_label(from_waybackmachine: Column) -> Column:
    return F.when(from_waybackmachine == 1, 0).otherwise(1)


def life_span(prediction: Column, first_appear: Column, mean: float, std: float) -> Column:
    """Predicted years online from a prediction on the scaled label."""
    return prediction * F.lit(std) + F.lit(mean) + BASE_YEAR - first_appear


def actual_life_span(label: Column, first_appear: Column) -> Column:
    return label + BASE_YEAR - first_appear


def years_left(prediction: Column, mean: float, std: float, today: int = 2021) -> Column:
    return prediction * F.lit(std) + F.lit(mean) + BASE_YEAR - today
