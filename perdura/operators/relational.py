"""Filters, joins and row selection of the extract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perdura.functions.dates import missing
from perdura.functions.numeric import hash_fraction
from perdura.operators.sides import JoinSides
from perdura.sources.schemas import PUBLICATION_FEATURES

# The resource columns of the extract.
RESOURCE_COLUMNS = (
    "id",
    "url",
    "actual_scrape_url",
    "first_appear",
    "first_available_timestamp",
    "last_available_timestamp",
    "header",
    "html_text",
    "comment",
    "from_waybackmachine",
    "http_status_code",
    "original_check_failure",
    "original_check_error_log",
    "terminate_reason",
    "terminate_reason_error_log",
)


def label_set(truncated: bool) -> tuple[int, ...]:
    """Truncated studies keep archived rows only."""
    return (0,) if truncated else (0, 1)


def usable_resource(truncated: bool = False) -> Column:
    """Rows with a wanted label, a known first year, and no DOI resolver link."""
    return (
        F.col("label").isin(*label_set(truncated))
        & ~missing(F.col("first_appear"))
        & ~F.lower(F.col("url")).like("%doi.org%")
    )


def publication_lookup(bridge: DataFrame, paper: DataFrame, mag: DataFrame) -> DataFrame:
    """id -> publication features: the narrow part of the star, joined first."""
    return (
        bridge.select("id", "doi")
        .join(paper.select("doi", "paperId"), "doi")
        .join(mag, "paperId")
        .drop("doi")
    )


def study_sides(
    resource: DataFrame,
    bridge: DataFrame,
    paper: DataFrame,
    mag: DataFrame,
    truncated: bool = False,
    fraction: float | None = None,
    seed: int = 77,
) -> JoinSides:
    """The two sides of the extract: wide resource rows, and publication features by id.

    Sampling is a hash filter on the id and runs under the join. The narrow
    tables are joined among themselves, so the resource rows are shuffled
    once, on their own id.
    """
    rows = resource.filter(usable_resource(truncated))
    if fraction is not None:
        rows = rows.filter(hash_fraction(F.col("id"), seed=seed) < fraction)
    wide = [c for c in RESOURCE_COLUMNS if c in rows.columns]
    features = [c for c in PUBLICATION_FEATURES if c in mag.columns]
    lookup = publication_lookup(bridge, paper, mag.select("paperId", *features))
    return JoinSides(rows.select(*wide, "label"), lookup, "id")


def extract_study_rows(
    resource: DataFrame,
    bridge: DataFrame,
    paper: DataFrame,
    mag: DataFrame,
    truncated: bool = False,
    fraction: float | None = None,
    seed: int = 77,
) -> DataFrame:
    """The four-table extract as joined rows; features are cheaper to take from ``study_sides``."""
    return study_sides(resource, bridge, paper, mag, truncated, fraction, seed).joined()


def paper_meta(paper: DataFrame, authorship: DataFrame) -> DataFrame:
    """Authors and distinct affiliations per paper, 0 for a paper without any.

    Authorship is aggregated before the join, so a paper with very many rows is
    combined on the map side and never forms one hot join partition.
    """
    per_paper = authorship.groupBy("paper_id").agg(
        F.count("author_id").alias("author_cnt"),
        F.count_distinct("affiliation_id").alias("org_cnt"),
    )
    return (
        paper.select("paper_id")
        .distinct()
        .join(per_paper, "paper_id", "left")
        .fillna(0, ["author_cnt", "org_cnt"])
    )


def reference_counts(paper: DataFrame, reference: DataFrame, meta: DataFrame) -> DataFrame:
    """Per paper: cited organisations, papers and authors over its references.

    ``meta`` has one row per paper, so a much-cited paper is hot on the
    reference side only, which adaptive execution splits; the sums combine
    before their shuffle.
    """
    hits = reference.join(meta.withColumnRenamed("paper_id", "reference_id"), "reference_id")
    sums = hits.groupBy("paper_id").agg(
        F.sum("org_cnt").alias("cnt_org_cited"),
        F.count("*").alias("cnt_paper_cited"),
        F.sum("author_cnt").alias("cnt_author_cited"),
    )
    return (
        paper.select("paper_id")
        .distinct()
        .join(sums, "paper_id", "left")
        .fillna(0, ["cnt_paper_cited"])
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in the given order.

    A minimum over structs combines before the shuffle, so copies of a hot key
    never meet in one task, as they would under ``row_number``. Columns not
    named in ``order`` break remaining ties.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.min(F.struct(*order, *rest)).alias("_first")
    return df.groupBy(*keys).agg(best).select(*keys, "_first.*").select(*df.columns)


def join_first_match(
    sample: DataFrame, full: DataFrame, on: str, order: Sequence[str]
) -> DataFrame:
    """Each sample row with its first partner; the partner side is cut to one
    row per key before the join, so a popular key cannot multiply rows."""
    return sample.join(first_per_key(full, [on], order), on)


def extremes(df: DataFrame, by: str, tie: str, n: int = 3) -> DataFrame:
    """The n lowest and n highest rows."""
    low = df.orderBy(F.col(by).asc(), F.col(tie).asc()).limit(n)
    high = df.orderBy(F.col(by).desc(), F.col(tie).asc()).limit(n)
    return low.withColumn("side", F.lit("low")).unionByName(
        high.withColumn("side", F.lit("high"))
    )


def rename_existing(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def pick_existing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in names if c in df.columns])


def stack_tagged(train: DataFrame, test: DataFrame, tag: str = "dataset") -> DataFrame:
    return train.withColumn(tag, F.lit("Train")).unionByName(
        test.withColumn(tag, F.lit("Test"))
    )
