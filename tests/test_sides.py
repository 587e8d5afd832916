"""Recipe stages run below the join: same rows, and no page text in an exchange or a sort."""

import pytest
from plan_tree import moved_columns, nodes
from pyspark.sql import functions as F

from perdura.operators import transforms as t
from perdura.operators.sides import JoinSides, joined_features, push_stages
from perdura.plans.catalog_models import sides_of_study, study_rows
from perdura.plans.recipe import RECIPES, StudyRecipe, build_recipe

SF = "/root/testdata/sf0.001"
WIDE = {"html_text", "header", "comment", "_markup"}


def lines(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(RECIPES))
def test_no_wide_column_is_moved(spark, name):
    features = StudyRecipe(RECIPES[name]).features(sides_of_study(spark, SF))
    assert any("Join" in node for node, _ in nodes(features))
    assert "id" in moved_columns(features) and not moved_columns(features) & WIDE
    assert moved_columns(study_rows(spark, SF)) & WIDE  # what the test would see without the planner


@pytest.mark.parametrize("name", ["untruncated", "edition_1", "edition_4", "edition_5"])
def test_same_rows_as_over_the_joined_table(spark, name):
    rows = study_rows(spark, SF)
    want = build_recipe(RECIPES[name], ("id",)).fit(rows).transform(rows)
    got = StudyRecipe(RECIPES[name], ("id",)).fit_transform(sides_of_study(spark, SF))
    assert got.columns == want.columns
    assert lines(got) == lines(want)


def test_fitted_on_train_or_again_on_test(spark):
    sides = sides_of_study(spark, SF)
    part = lambda which: JoinSides(sides.left.where(F.crc32("id") % 3 == which), sides.right, "id")
    model = StudyRecipe(RECIPES["truncated"], ("id",)).fit(part(0))
    mean = lambda df: df.agg(F.avg("scaled_first_appear")).first()[0]
    assert abs(mean(model.transform(part(0)))) < 1e-9 < abs(mean(model.transform(part(1))))
    assert abs(mean(model.transform(part(1), refit=True))) < 1e-9


def test_stages_stay_above_the_join_when_they_read_both_sides(spark):
    left = spark.createDataFrame([(1, "http://a.org/x", 3.0), (2, "http://b.org/", 1.0)], "id long, url string, a double")
    right = spark.createDataFrame([(1, 5.0), (3, 6.0)], "id long, b double")
    both = t.LogFeatures(columns=["a", "b"])
    pushed, rest = push_stages([t.UrlFeatures(), both, t.PickColumns(columns=["a", "b"])], JoinSides(left, right, "id"))
    assert "url_depth" in pushed.left.columns and [type(s) for s in rest] == [t.LogFeatures, t.PickColumns]
    out = joined_features([t.UrlFeatures(), both, t.PickColumns(columns=["b", "a"])], JoinSides(left, right, "id"))
    assert out.columns == ["b", "a"] and out.count() == 1


def test_key_is_left_alone_by_stages_on_single_columns(spark):
    left = spark.createDataFrame([(1, None)], "id long, a double")
    right = spark.createDataFrame([(1, None)], "id long, b double")
    stages = [t.RenameColumns(mapping={"id": "key", "a": "c"}), t.NanToZero(columns=["c", "b"]), t.PickColumns(columns=["c", "b"])]
    assert [tuple(r) for r in joined_features(stages, JoinSides(left, right, "id")).collect()] == [(0.0, 0.0)]
