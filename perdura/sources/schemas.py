"""Schemas of the study's tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and types of the stored tables.
RESOURCE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("actual_scrape_url", T.StringType()),
        T.StructField("first_appear", T.DoubleType()),
        T.StructField("first_available_timestamp", T.DoubleType()),
        T.StructField("last_available_timestamp", T.DoubleType()),
        T.StructField("header", T.StringType()),
        T.StructField("html_text", T.StringType()),
        T.StructField("comment", T.StringType()),
        T.StructField("from_waybackmachine", T.IntegerType()),
        T.StructField("http_status_code", T.DoubleType()),
        T.StructField("original_check_failure", T.StringType()),
        T.StructField("original_check_error_log", T.StringType()),
        T.StructField("terminate_reason", T.StringType()),
        T.StructField("terminate_reason_error_log", T.StringType()),
        T.StructField("label", T.IntegerType()),
    ]
)

BRIDGE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("pmid", T.StringType()),
        T.StructField("doi", T.StringType()),
    ]
)

# The publication features joined to every resource.
PUBLICATION_FEATURES = (
    "total_num_of_paper_citing",
    "total_num_of_author_citing",
    "total_num_of_affiliation_citing",
    "total_num_of_journal_citing",
    "total_num_of_author_self_citation",
    "total_num_of_affiliation_self_citation",
    "total_num_of_journal_self_citation",
    "avg_year",
    "min_year",
    "max_year",
    "median",
    "num_of_author",
    "num_of_author_citing",
    "num_of_affiliation_citing",
    "num_of_journal_citing",
    "avg_hindex",
    "first_author_hindex",
    "last_author_hindex",
    "avg_mid_author_hindex",
    "paper_unique_affiliation",
)


def raw_json(schema: T.StructType) -> T.StructType:
    """What is read from a JSON line before casting: every field as text.

    Numbers arrive as numbers or as text and must not void a whole line, so the
    reader takes text and the caller casts. ``_id`` is a one-entry map.
    """
    fields = [T.StructField("_id", T.MapType(T.StringType(), T.StringType()))]
    fields += [T.StructField(f.name, T.StringType()) for f in schema if f.name != "id"]
    return T.StructType([*fields, T.StructField("_corrupt_record", T.StringType())])
