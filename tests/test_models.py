"""Models against independent numpy computations."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from perdura.operators import evaluate, grouptests, linear, logistic, tobit, trees
from perdura.operators import transforms as t
from perdura.operators.moments import gram
from perdura.operators.quantiles import running_totals  # noqa: F401
from perdura.plans.recipe import RECIPES, build_recipe
from perdura.plans import catalog_models
from perdura.plans.catalog_models import study_rows

NAMES = ["a", "b", "c"]
SF = "/root/testdata/sf0.001"


def normal_cdf(x):
    return 0.5 * math.erfc(-x / math.sqrt(2))


def plain_loglik(x, y, theta, left, right):
    """Row by row, straight from the definition."""
    total = 0.0
    s = theta[-1]
    for row, label in zip(x, y):
        xb = theta[0] + row @ theta[1:-1]
        if label <= left:
            total += math.log(normal_cdf((label - xb) / s))
        elif label >= right:
            total += math.log(normal_cdf((xb - label) / s))
        else:
            z = (label - xb) / s
            total += -0.5 * z * z - math.log(s) - 0.5 * math.log(2 * math.pi)
    return total


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 3))
    y = 1 + x @ [0.8, -0.5, 0.0] + 0.7 * rng.normal(size=3000)
    return x, y


@pytest.fixture(scope="module")
def frames(spark, data):
    x, y = data

    def make(label):
        pdf = pd.DataFrame(x, columns=NAMES).assign(label=label, id=range(len(x)))
        return spark.createDataFrame(pdf).repartition(5).cache()

    return {"free": make(y), "right": make(np.minimum(y, 1.5)), "both": make(np.clip(y, -0.5, 1.5))}


# ---------------------------------------------------------------- Tobit


def test_loglik_equals_the_definition(spark, data, frames):
    x, y = data
    theta = np.array([0.9, 0.7, -0.4, 0.1, 0.8])
    with tobit.TobitRows(frames["both"], NAMES, "label", tobit.Censoring(-0.5, 1.5)) as rows:
        got = rows.sums(theta, rows.products()).value[0]
    assert math.isclose(got, plain_loglik(x, np.clip(y, -0.5, 1.5), theta, -0.5, 1.5), rel_tol=1e-12)


def test_derivatives_equal_central_differences(spark, frames):
    theta, eps = np.array([0.9, 0.7, -0.4, 0.1, 0.8]), 1e-5
    around = np.array([theta + d for d in eps * np.eye(5)] + [theta - d for d in eps * np.eye(5)])
    with tobit.TobitRows(frames["both"], NAMES, "label", tobit.Censoring(-0.5, 1.5)) as rows:
        products = rows.products()
        at, near = rows.sums(theta, products), rows.sums(around, products)
    slope = (near.value[:5] - near.value[5:]) / (2 * eps)
    assert np.allclose(at.gradient[0], slope, rtol=1e-6, atol=1e-5)
    bend = (near.gradient[:5] - near.gradient[5:]) / (2 * eps)
    assert np.allclose(at.hessian[0], bend, rtol=1e-6, atol=1e-4)


def test_known_coefficients_are_recovered(spark, frames):
    model = tobit.TobitRegression(features=NAMES, censorRight=1.5).fit(frames["right"])
    truth = [0.8, -0.5, 0.0]
    assert np.allclose(model.getOrDefault("coefficients"), truth, atol=0.05)
    assert abs(model.getOrDefault("intercept") - 1) < 0.05
    assert abs(model.getOrDefault("sigma") - 0.7) < 0.03


def test_without_censoring_the_fit_is_least_squares(spark, data, frames):
    x, y = data
    model = tobit.TobitRegression(features=NAMES).fit(frames["free"])
    design = np.column_stack([np.ones(len(x)), x])
    want = np.linalg.lstsq(design, y, rcond=None)[0]
    assert np.allclose([model.getOrDefault("intercept"), *model.getOrDefault("coefficients")], want)
    assert math.isclose(model.getOrDefault("sigma"), np.std(y - design @ want), rel_tol=1e-8)


def test_penalised_fit_beats_all_neighbours_and_has_exact_zeros(spark, data, frames):
    x, y = data
    c, alpha = 60.0, 0.9
    with tobit.TobitRows(frames["right"], NAMES, "label", tobit.Censoring(right=1.5)) as rows:
        fit = rows.fit([(c, alpha)])[0]

    def objective(theta):
        cost = c * (alpha * np.abs(theta).sum() + (1 - alpha) * (theta**2).sum() / 2)
        return plain_loglik(x, np.minimum(y, 1.5), theta, -math.inf, 1.5) - cost

    best = objective(fit.theta)
    assert math.isclose(-fit.objective, best, rel_tol=1e-9)
    assert fit.coef[2] == 0.0
    for j in range(5):
        for step in (-1e-3, 1e-3):
            theta = fit.theta.copy()
            theta[j] += step
            assert objective(theta) < best


def test_all_settings_together_equal_one_by_one(spark, frames):
    settings = [(0.0, 1.0), (5.0, 0.3), (60.0, 1.0)]
    with tobit.TobitRows(frames["right"], NAMES, "label", tobit.Censoring(right=1.5)) as rows:
        joint = rows.fit(settings)
        for one, setting in zip(joint, settings):
            assert np.allclose(rows.fit([setting])[0].theta, one.theta, atol=1e-7)


def test_partitioning_does_not_matter(spark, frames):
    fits = []
    for parts in (1, 3, 17):
        df = frames["right"].repartition(parts)
        with tobit.TobitRows(df, NAMES, "label", tobit.Censoring(right=1.5)) as rows:
            fits.append(rows.fit([(1.0, 0.5)])[0].theta)
    assert np.allclose(fits[0], fits[1]) and np.allclose(fits[0], fits[2])


def test_all_rows_censored_stays_finite(spark, frames):
    with tobit.TobitRows(frames["free"], NAMES, "label", tobit.Censoring(right=-100.0)) as rows:
        fit = rows.fit([(1.0, 0.5)], max_iter=20)[0]
    assert np.isfinite(fit.theta).all() and math.isfinite(fit.loglik)


def test_fold_fits_equal_fits_on_the_training_rows(spark, data, frames):
    limits = tobit.Censoring(right=1.5)
    x, y = data
    found = tobit.tobit_grid(
        frames["right"], NAMES, "label", limits, [(2.0, 0.5)], F.col("id") % 3, 3
    )
    scores = []
    for k in range(3):
        train = frames["right"].filter(F.col("id") % 3 != k)
        with tobit.TobitRows(train, NAMES, "label", limits) as rows:
            theta = rows.fit([(2.0, 0.5)])[0].theta
        held = np.arange(len(x)) % 3 == k
        scores.append(plain_loglik(x[held], np.minimum(y, 1.5)[held], theta, -math.inf, 1.5))
    assert math.isclose(found[0][1], float(np.mean(scores)), rel_tol=1e-6)


def test_bootstrap_spread_matches_the_information_matrix(spark, frames):
    limits = tobit.Censoring(right=1.5)
    fits = tobit.bootstrap(frames["right"], NAMES, "label", limits, ["id"], 200, (0.0, 1.0), batch=120)
    spread = np.array([f.theta for f in fits]).std(axis=0)
    with tobit.TobitRows(frames["right"], NAMES, "label", limits) as rows:
        theta = rows.fit([(0.0, 1.0)])[0].theta
        info = -rows.sums(theta, rows.products()).hessian[0]
    assert np.allclose(spread, np.sqrt(np.diag(np.linalg.inv(info))), rtol=0.25)


def test_bootstrap_weights_are_poisson():
    draws = tobit.poisson_counts(np.arange(50_000.0) * 7919, np.arange(4), 77)
    assert abs(draws.mean() - 1) < 0.01 and abs(draws.var() - 1) < 0.03
    assert abs(np.corrcoef(draws.T)[0, 1]) < 0.02


def test_row_loglik_sums_to_the_score(spark, frames, tmp_path):
    model = tobit.TobitRegression(features=NAMES, censorRight=1.5, C=5.0).fit(frames["right"])
    total = model.with_row_loglik(frames["right"]).agg(F.sum("loglik")).first()[0]
    assert math.isclose(total, model.score(frames["right"]), rel_tol=1e-10)
    model.save(str(tmp_path / "tobit"))
    again = tobit.TobitModel.load(str(tmp_path / "tobit"))
    assert again.getOrDefault("coefficients") == model.getOrDefault("coefficients")
    assert again.limits == model.limits


# ---------------------------------------------------------------- linear models


def test_elastic_net_meets_its_optimality_conditions(spark, data, frames):
    x, y = data
    stats = gram(frames["free"], NAMES, "label")[0]
    settings = [(a, r) for a in (0.001, 0.1, 0.4) for r in (0.0, 0.3, 1.0)]
    for (alpha, ratio), fit in zip(settings, linear.elastic_net_path(stats, settings)):
        gap = y - fit.intercept - x @ fit.coef
        pull = x.T @ gap / len(y) - alpha * (1 - ratio) * fit.coef
        assert abs(gap.mean()) < 1e-9
        for g, b in zip(pull, fit.coef):
            if b != 0:
                assert math.isclose(g, alpha * ratio * np.sign(b), abs_tol=1e-8)
            else:
                assert abs(g) <= alpha * ratio + 1e-8
        assert math.isclose(stats.mse(fit.intercept, fit.coef), (gap**2).mean(), rel_tol=1e-9)
        assert math.isclose(stats.r2(fit.intercept, fit.coef), 1 - (gap**2).mean() / y.var(), rel_tol=1e-9)


def test_gram_without_a_fold_is_the_gram_of_the_rest(spark, data, frames):
    x, y = data
    folds = gram(frames["free"].withColumn("f", F.col("id") % 4), NAMES, "label", "f", 4)
    rest = folds[0] + folds[1] + folds[2] + folds[3] - folds[2]
    keep = np.arange(len(x)) % 4 != 2
    v = np.column_stack([x, y])[keep]
    assert rest.n == keep.sum() and np.allclose(rest.mean, v.mean(axis=0))
    assert np.allclose(rest.centred, np.cov(v.T, bias=True) * keep.sum())


def test_coefficient_report_matches_textbook_formulas(spark, data, frames):
    x, y = data
    stats = gram(frames["free"], NAMES, "label")[0]
    report = {r[0]: r for r in linear.coefficient_report(stats, linear.ols(stats))}
    design = np.column_stack([np.ones(len(x)), x])
    b = np.linalg.lstsq(design, y, rcond=None)[0]
    var = ((y - design @ b) ** 2).sum() / (len(x) - 4) * np.linalg.inv(design.T @ design)
    for j, name in enumerate(["Constant", *NAMES]):
        _, coef, se, tv, _ = report[name]
        assert coef == round(b[j], 4) and se == round(math.sqrt(var[j, j]), 3)
        assert math.isclose(tv, b[j] / math.sqrt(var[j, j]), abs_tol=2e-3)


# ---------------------------------------------------------------- fitted stages


def test_scaler_keeps_flags_and_scales_the_rest(spark):
    df = spark.createDataFrame(
        [(0, 1.0, 5.0, "u", 1.0), (1, 2.0, 5.0, "v", 2.0), (0, 4.0, 5.0, "w", 3.0)],
        "flag int, x double, same double, url string, label double",
    )
    model = t.PopulationScaler(passCols=["url"], keepRaw=["x"]).fit(df)
    out = model.transform(df)
    assert out.columns == ["flag", "same", "x", "url", "scaled_x", "label"]
    z = [r["scaled_x"] for r in out.orderBy("x").collect()]
    want = (np.array([1.0, 2.0, 4.0]) - 7 / 3) / np.std([1.0, 2.0, 4.0])
    assert np.allclose(z, want)
    # new rows are scaled by the fitted statistics
    assert math.isclose(model.transform(df.filter("x = 4")).first()["scaled_x"], want[2])


def test_low_variance_filter(spark):
    rows = [(1 if i == 0 else 0, i % 2, i * 1e-4, float(i), i) for i in range(500)]
    df = spark.createDataFrame(rows, "rare int, even int, flat double, wide double, label int")
    assert t.LowVarianceFilter(threshold=0.005).fit(df).transform(df).columns == [
        "even", "wide", "label",
    ]


def test_encoder_gives_unseen_categories_zero(spark, monkeypatch):
    train = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "s string")
    new = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "s string")
    want = [0.0, 0.0, 1 / 3, 2 / 3]
    for limit in (10_000, 1):  # shares held in the model, then in a table
        monkeypatch.setattr(t, "INLINE_CATEGORIES", limit)
        model = t.FrequencyEncoder(inputCol="s").fit(train)
        assert sorted(r["s"] for r in model.transform(new).collect()) == pytest.approx(want)


def test_suffix_dummies_remember_what_was_seen(spark):
    train = spark.createDataFrame([("gov",), ("org",), ("com",)], "suffix_idx string")
    model = t.SuffixDummies(presentOnly=True).fit(train)
    new = spark.createDataFrame([("eu",), ("gov",)], "suffix_idx string")
    assert model.transform(new).columns == ["org", "gov"]
    assert [tuple(r) for r in model.transform(new).orderBy("gov").collect()] == [(0, 0), (0, 1)]


def test_recipe_is_fitted_once_and_survives_saving(spark, tmp_path):
    rows = study_rows(spark, SF).cache()
    train, test = rows.filter("paperId % 3 != 0"), rows.filter("paperId % 3 = 0")
    model = build_recipe(RECIPES["untruncated"]).fit(train)
    model.save(str(tmp_path / "recipe"))
    again = PipelineModel.load(str(tmp_path / "recipe"))
    one, two = model.transform(test), again.transform(test)
    assert one.columns == two.columns == model.transform(train).columns
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


@pytest.mark.parametrize("name", sorted(RECIPES))
def test_every_recipe_runs(spark, name):
    rows = study_rows(spark, SF)
    out = build_recipe(RECIPES[name]).fit(rows).transform(rows)
    assert out.count() > 0 and "label" in out.columns
    assert ("url" in out.columns) == RECIPES[name].keep_url


# ---------------------------------------------------------------- evaluation and tests


def test_auc_and_roc_in_bins(spark, monkeypatch):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 4000)
    p = np.round(rng.normal(size=4000) + 0.5 * y, 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert math.isclose(evaluate.auc(df, "y", "p").first()[0], wins, rel_tol=1e-12)
    points = evaluate.roc_points(df, "y", "p").orderBy("threshold").collect()
    middle = points[len(points) // 2]
    assert math.isclose(middle["tpr"], (pos >= middle["threshold"]).mean())
    assert math.isclose(middle["fpr"], (neg >= middle["threshold"]).mean())


def test_constant_prediction_has_no_pseudo_r2(spark, frames):
    df = frames["free"].withColumn("p", F.lit(1.0))
    assert evaluate.regression_metrics(df, "label", "p").first()["pseudo_r2"] is None


def test_correlation_p_values(spark):
    # r = 0.5 with n = 18: t = 0.5 * sqrt(16 / 0.75) = 2.309401
    assert math.isclose(grouptests.corr_p_value(0.5, 18), 0.034612, abs_tol=1e-4)
    assert grouptests.corr_p_value(1.0, 10) == 0.0


def test_welch_and_chi_square(spark, data, frames):
    _, y = data
    flag = np.arange(len(y)) % 3 == 0
    a, b = y[flag], y[~flag]
    e1, e2 = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    got = grouptests.welch_t_test(frames["free"], F.col("id") % 3 == 0, "label")
    assert math.isclose(got[0], (a.mean() - b.mean()) / math.sqrt(e1 + e2), rel_tol=1e-9)
    dof = (e1 + e2) ** 2 / (e1**2 / (len(a) - 1) + e2**2 / (len(b) - 1))
    assert math.isclose(got[1], dof, rel_tol=1e-9)
    q = y**2
    stat, df, _ = grouptests.chi_square_test(frames["free"], F.col("label") * F.col("label"))
    assert math.isclose(stat, ((q - q.mean()) ** 2).sum() / q.mean(), rel_tol=1e-9)
    assert df == len(y) - 1


def test_shuffled_columns_are_permutations(spark, frames):
    out = trees.shuffled_columns(frames["free"], NAMES, ["id"]).toPandas()
    for name in NAMES:
        assert np.allclose(np.sort(out[name]), np.sort(out[f"_s_{name}"]))
        assert abs(np.corrcoef(out[name], out[f"_s_{name}"])[0, 1]) < 0.1


def test_permutation_importance_ranks_features(spark, frames):
    rows = trees.assemble(frames["free"], NAMES)
    model = trees.forest(trees=10, depth=6, leaf=20).fit(rows)
    found = trees.permutation_importance(model, frames["free"], NAMES, "label", ["id"])
    score = {r["feature"]: r["importance"] for r in found.collect()}
    assert score["a"] > score["b"] > score["c"]


def test_custom_stages_fit_in_a_pipeline(spark, frames):
    stages = [t.LabelScaler(), tobit.TobitRegression(features=NAMES)]
    model = Pipeline(stages=stages).fit(frames["free"])
    out = model.transform(frames["free"])
    back = model.stages[0].inverse(out, "prediction")
    assert abs(back.agg(F.avg("prediction")).first()[0] - 1) < 0.1


def test_logistic_grid_against_scipy_free_newton(spark, data):
    x, noise = data
    x, y = x[:600], (noise[:600] > 1).astype(float)
    fold = np.arange(600) % 7 % 3  # folds of unequal size
    pdf = pd.DataFrame(x, columns=NAMES).assign(label=y, fold=fold)
    rows = spark.createDataFrame(pdf).repartition(3)
    stored = rows.select(*[F.col(n).alias(f"x{i}") for i, n in enumerate(NAMES)], "label", F.col("fold").cast("long"))
    settings = [(0.01, 0.0, 50), (0.01, 1.0, 50), (0.1, 0.3, 50)]
    held = np.tile(np.arange(3), 3)
    theta = logistic.fit(stored, 3, [s for s in settings for _ in range(3)], held)
    aucs = []
    for (c, ratio, _), h, b in zip([s for s in settings for _ in range(3)], held, theta):
        mine = fold != h
        chance = 1 / (1 + np.exp(-(b[0] + x[mine] @ b[1:])))
        slope = c * x[mine].T @ (chance - y[mine]) + (1 - ratio) * b[1:]
        assert abs((chance - y[mine]).sum()) < 1e-5  # the intercept is free
        zero = b[1:] == 0
        assert np.abs(slope + ratio * np.sign(b[1:]))[~zero].max(initial=0) < 1e-6
        assert (np.abs(slope[zero]) <= ratio + 1e-6).all()
        score = x[~mine] @ b[1:]
        up, down = score[y[~mine] == 1], score[y[~mine] == 0]
        aucs.append(((up[:, None] > down).mean() + (up[:, None] == down).mean() / 2))
    got = logistic.grid_auc(rows, NAMES, "label", settings, F.col("fold"), 3)
    assert got == pytest.approx(np.reshape(aucs, (3, 3)).mean(axis=1))


def test_registered_searches_have_the_size_of_the_study(spark):
    assert len(catalog_models.LOGISTIC_GRID) == 240
    assert catalog_models.logistic(spark, SF).count() == 240
    assert catalog_models.tobit_grid_cv(spark, SF).count() == 399


def test_registered_forests_are_those_of_the_study(spark, monkeypatch):
    made = []
    plain = trees.forest
    monkeypatch.setattr(trees, "forest", lambda **more: made.append(plain(**more)) or made[-1])
    catalog_models.feature_importance(spark, SF)
    catalog_models.permutation_importance(spark, SF)
    assert [(m.getNumTrees(), m.getMaxDepth()) for m in made] == [(30, 11)] * 2
    made.clear()
    assert catalog_models.grid_search_verbose(spark, SF).count() == 12
    assert {m.getNumTrees() for m in made} == {30} and (11, 232) in {(m.getMaxDepth(), m.getMinInstancesPerNode()) for m in made}


def test_correlations_leave_out_missing_values_pair_by_pair(spark):
    rng = np.random.default_rng(5)
    whole = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4)) + 1e4
    holes = [(0, slice(0, 90)), (1, slice(60, 200)), (2, slice(390, 400))]
    for c, rows in holes:
        whole[rows, c] = np.nan
    frame = pd.DataFrame(whole, columns=list("abcd")).assign(flat=7.1, none=np.nan)
    rows = [tuple(None if i % 2 and math.isnan(x) else float(x) for x in r) for i, r in enumerate(frame.to_numpy())]
    names = list(frame.columns)
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(3)
    r, n = grouptests.correlations(df, names)
    here = frame.notna().to_numpy().astype(int)
    assert (n == here.T @ here).all()
    np.testing.assert_allclose(r[:4, :4], frame[list("abcd")].corr().to_numpy(), atol=1e-10)
    assert np.isnan(r[4:]).all() and np.isnan(r[:, 4:]).all()
    pair = grouptests.corr_pairs(df.select("a", "b"), ["a", "b"], None).first()
    assert math.isclose(pair["p"], grouptests.corr_p_value(frame["a"].corr(frame["b"]), 200), abs_tol=1e-9)
    empty, none = grouptests.correlations(df.limit(0), names)
    assert np.isnan(empty).all() and not none.any()
