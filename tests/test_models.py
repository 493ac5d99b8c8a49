"""Models against closed forms and brute force."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.config import PanelConfig
from ledgerline.operators import linear, metrics, models, preprocess
from ledgerline.operators.design import feature_columns, one_hot_vector, scale_and_encode
from ledgerline.plans import training
from ledgerline.plans.panel import PreparedPanel
from ledgerline.queries import modelling

D = 5
NAMES = [f"x{i}" for i in range(D)]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (240, D)) + 0.4 * rng.normal(0, 1, (240, 1))
    y = x @ np.array([2.0, -1.0, 0.5, 0.0, 0.05]) + rng.normal(0, 0.3, 240) + 3
    return x, y


@pytest.fixture(scope="module")
def train(spark, data):
    x, y = data
    rows = [(str(i % 12), dt.date(2000 + (i // 12) // 4, 1 + 3 * ((i // 12) % 4), 1), float(y[i]), *map(float, x[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "id string, date date, label double, " + ", ".join(f"{n} double" for n in NAMES)).cache()


def coefficients(fitted):
    return np.array([v for _, v in fitted.importances()])


def centred(data):
    x, y = data
    return x - x.mean(0), y - y.mean()


def test_cross_products_and_ols(train, data):
    xc, yc = centred(data)
    expected = np.linalg.lstsq(xc, yc, rcond=None)[0]
    beta, intercept = linear.solve(linear.cross_products(train.repartition(5), NAMES))
    assert beta == pytest.approx(expected) and intercept == pytest.approx(data[1].mean() - data[0].mean(0) @ expected)
    assert coefficients(models.fit(models.OLS, train, NAMES)) == pytest.approx(expected, rel=1e-6)


def test_dependent_columns_get_the_minimum_norm_solution(train, data):
    beta, _ = linear.solve(linear.cross_products(train.withColumn("copy", F.col("x0")), ["x0", "copy"]))
    assert beta[0] == pytest.approx(beta[1])


@pytest.mark.parametrize("alpha", [0.5, 40.0])
def test_ridge(train, data, alpha):
    xc, yc = centred(data)
    expected = np.linalg.solve(xc.T @ xc + alpha * np.eye(D), xc.T @ yc)
    assert coefficients(models.fit(models.RIDGE, train, NAMES, {"alpha": alpha})) == pytest.approx(expected, rel=1e-5)


def descent(xc, yc, l1, l2):
    n, b = len(yc), np.zeros(xc.shape[1])
    for _ in range(3000):
        for j in range(len(b)):
            rho = xc[:, j] @ (yc - xc @ b + xc[:, j] * b[j]) / n
            b[j] = np.sign(rho) * max(abs(rho) - l1, 0) / (xc[:, j] @ xc[:, j] / n + l2)
    return b


@pytest.mark.parametrize("model,params,l1,l2", [(models.LASSO, {"alpha": 0.2}, 0.2, 0.0), (models.ELASTIC, {"alpha": 0.4, "l1_ratio": 0.3}, 0.12, 0.28)])
def test_sparse_penalties(train, data, model, params, l1, l2):
    got = coefficients(models.fit(model, train, NAMES, params))
    assert got == pytest.approx(descent(*centred(data), l1, l2), abs=1e-5)


def test_elimination_matches_refitting(train, data):
    xc, yc = centred(data)
    left = list(range(D))
    while len(left) > 2:
        b = np.linalg.lstsq(xc[:, left], yc, rcond=None)[0]
        left.pop(int(np.argmin(b**2)))
    assert linear.eliminate_features(linear.cross_products(train, NAMES)) == [NAMES[i] for i in left]
    assert models.fit("Ridge_RFE", train, NAMES, {"n_features": 3}).features == linear.eliminate_features(linear.cross_products(train, NAMES), 3)


def test_fixed_effects_equal_dummies(train, data):
    x, y = data
    ids = np.arange(len(y)) % 12
    dummies = (ids[:, None] == np.arange(12)[None, :]).astype(float)
    expected = np.linalg.lstsq(np.hstack([x[:, :2], dummies]), y, rcond=None)[0]
    beta, effects = linear.fixed_effects(train, ["x0", "x1"])
    got = {int(r.id): r.effect for r in effects.collect()}
    assert beta == pytest.approx(expected[:2]) and [got[i] for i in range(12)] == pytest.approx(expected[2:])
    fitted = models.fit(models.EFFECTS, train, ["x0", "x1"])
    stranger = fitted.predict(train.limit(1).withColumn("id", F.lit("new"))).first()
    assert stranger.prediction == pytest.approx(np.mean(expected[2:]) + stranger.x0 * expected[0] + stranger.x1 * expected[1])


def with_dummies(x, y, ids, alpha):
    """Least squares (ridge if alpha > 0) of x and a column for each of the ids, by normal equations."""
    z = np.hstack([x, (ids[:, None] == np.unique(ids)[None, :]).astype(float)])
    zc, yc = z - z.mean(0), y - y.mean()
    b = np.linalg.pinv(zc.T @ zc + alpha * np.eye(z.shape[1])) @ zc.T @ yc
    return b[: x.shape[1]], b[x.shape[1] :], y.mean() - z.mean(0) @ b


@pytest.mark.parametrize("alpha", [0.0, 3.0, 200.0])
def test_absorbed_levels_equal_dummies_of_fifty_entities(spark, alpha):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 50, 700)
    x = rng.normal(0, 1, (700, 3)) + 0.1 * ids[:, None] + 100
    y = x @ [1.0, -2.0, 0.3] + np.sin(ids) * 4 + rng.normal(0, 0.5, 700)
    df = spark.createDataFrame([(str(i), float(t), *map(float, r)) for i, t, r in zip(ids, y, x)], "id string, label double, a double, b double, c double").repartition(4)
    absorbed = linear.absorb(df, ["a", "b", "c"], penalty=alpha)
    for keep in (["a", "b", "c"], ["c", "a"]):
        beta, level, effects = linear.absorbed_fit(absorbed, ["a", "b", "c"], keep, alpha)
        slopes, levels, intercept = with_dummies(x[:, ["abc".index(k) for k in keep]], y, ids, alpha)
        got = {int(r.id): r.effect for r in effects.collect()}
        assert beta == pytest.approx(slopes, rel=1e-7) and level == pytest.approx(intercept, rel=1e-7)
        assert [got[i] for i in np.unique(ids)] == pytest.approx(levels + intercept, rel=1e-7)


def test_two_hundred_thousand_entities(spark):
    """Linear models with entity levels hold nothing on the driver that grows with the entities."""
    n = 200_000
    rows = spark.range(0, 3 * n, 1, 8).select((F.col("id") % n).cast("string").alias("id"), F.lit(None).cast("date").alias("date"), (F.pmod(F.xxhash64("id"), F.lit(17)) / 3).alias("num__x"))
    rows = rows.withColumn("label", 2 * F.col("num__x") + F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(10)))
    for model, slope in ((models.EFFECTS, 2.0), ("FixedEffectsLR_RFE", 2.0)):
        fitted = models.fit(model, rows, ["num__x"], keep=1)
        assert fitted.beta == pytest.approx([slope]) and fitted.effects.count() == n and fitted.model is None


def test_search_is_repeatable_and_picks_the_best(train):
    assert models.random_draws("Ridge_RFE", 4, n_features=5) == models.random_draws("Ridge_RFE", 4, n_features=5)
    draws = models.random_draws(models.FOREST, 50)
    assert all(10 <= d["n_estimators"] <= 200 and 5 <= d["max_depth"] <= 30 for d in draws)
    assert len(models.grid_points(models.ELASTIC)) == 25 and models.grid_points(models.OLS) == []
    best, scored = models.param_search(models.RIDGE, train, NAMES, [{"alpha": 0.01}, {"alpha": 5000.0}])
    assert best.params == {"alpha": 0.01} and scored[0]["mse"] < scored[1]["mse"]


@pytest.mark.parametrize("model", [m + e for m in (models.OLS, models.RIDGE, models.LASSO, models.ELASTIC) for e in ("", "_RFE")])
def test_one_pass_scores_equal_refitting(train, model):
    candidates = [{"alpha": 3.0, "l1_ratio": 0.4, "n_features": 2}, {"alpha": 0.1, "l1_ratio": 0.4, "n_features": 4}, {"alpha": 0.02, "l1_ratio": 0.7, "n_features": 4}]
    wanted = {models.RIDGE: ["alpha"], models.LASSO: ["alpha"], models.ELASTIC: ["alpha", "l1_ratio"], models.OLS: []}[models.base_name(model)]
    wanted += ["n_features"] if model.endswith("_RFE") else []
    candidates = [{k: c[k] for k in wanted} for c in candidates]
    one_pass = models._moment_scores(model, models.fold_moments(train, NAMES, 3), candidates)
    refitted = models._fitted_scores(model, train, NAMES, candidates, 3, 42, 2)
    assert one_pass == pytest.approx(refitted, rel=1e-6)


@pytest.mark.parametrize("l1,l2", [(0.2, 0.0), (0.05, 0.3), (1e-4, 0.0), (50.0, 0.0)])
def test_coordinate_descent_on_moments(train, data, l1, l2):
    moments = linear.cross_products(train, NAMES)
    beta, intercept = linear.coordinate_descent(moments, l1, l2)
    assert beta == pytest.approx(descent(*centred(data), l1, l2), abs=1e-7)
    warm, _ = linear.coordinate_descent(moments, l1, l2, start=beta + 0.5)
    assert warm == pytest.approx(beta, abs=1e-8)
    assert intercept == pytest.approx(data[1].mean() - data[0].mean(0) @ beta)


def test_coordinate_descent_with_a_constant_and_a_copy(train):
    moments = linear.cross_products(train.withColumns({"c": F.lit(1.0), "copy": F.col("x0")}), ["x0", "c", "copy"])
    beta, _ = linear.coordinate_descent(moments, 0.1)
    assert beta[1] == 0 and beta[0] + beta[2] == pytest.approx(linear.coordinate_descent(moments, 0.1, keep=[0])[0][0])


def test_a_whole_search_reads_the_rows_once(train, monkeypatch):
    reads = []
    original = models.block_cross_products
    monkeypatch.setattr(models, "block_cross_products", lambda *a, **k: reads.append(1) or original(*a, **k))
    moments = models.fold_moments(train, NAMES, 3)
    for model in (models.RIDGE, models.LASSO, models.ELASTIC, "Lasso_RFE"):
        grid = models.grid_points(model, D)
        _, scored = models.param_search(model, train, NAMES, grid, moments=lambda: moments)
        assert len(scored) == len(grid)
    assert len(reads) == 1


def test_selection_grid_is_a_third_two_thirds_and_all():
    assert sorted({g["n_features"] for g in models.grid_points("Lasso_RFE", 9)}) == [3, 6, 9]
    assert [g["n_features"] for g in models.grid_points("LinearRegression_RFE", 2)] == [1, 2]


def test_search_falls_back_to_defaults(train):
    constant = train.withColumn("label", F.lit(1.0))
    fitted, scored = models.param_search(models.OLS, constant, NAMES, [{}])
    assert scored == [] and fitted.model is not None
    few = train.filter(F.col("date") < "2000-07-01")
    assert models.param_search(models.RIDGE, few, NAMES, [{"alpha": 1.0}])[1] == []


def test_nothing_to_fit_is_an_error(train):
    with pytest.raises(ValueError):
        models.fit(models.OLS, train.limit(0), NAMES)
    with pytest.raises(ValueError):
        models.fit("NoSuchModel", train, NAMES)


def test_training_run_and_reports(spark, train, tmp_path):
    panel = PreparedPanel(train.withColumn("quarter", F.concat(F.lit("quarter_"), F.quarter("date"))), ["x0", "x1"], ["quarter"], [], None, None)
    cfg = PanelConfig(targets=("label",), features={"x0": "bank", "x1": "bank"}, lags=1)
    names = (models.MEAN, models.OLS, "LinearRegression_RFE", models.TREE, models.FOREST)
    original = models.estimator
    small = lambda m, p, *a: original(m, {"max_depth": 3, "n_estimators": 4, **p}, *a)
    models.estimator = small
    try:
        run = training.train_matrix(panel, cfg, horizons=(1, 2), names=names, search=None, out=str(tmp_path))
    finally:
        models.estimator = original
    rows = run.predictions.groupBy("target", "horizon", "model").count().collect()
    assert len(rows) == 2 * 6 and len({r["count"] for r in rows if r.horizon == 1}) == 1
    assert {r.model for r in rows} == {*names, "VotingEnsemble"}
    comparison = metrics.model_comparison(run.predictions, run.registry)
    assert comparison.filter("run_type = 'RFE'").select("base_model").distinct().collect()[0][0] == "LinearRegression"
    counts = training.feature_count_report(comparison, ["label", "absent"]).collect()
    assert all(r.absent == "-" for r in counts)
    params = training.param_report(comparison, ["Ridge|Standard", "DecisionTree|Standard"]).first()
    assert params["Ridge|Standard"] == "N/A" and params["DecisionTree|Standard"].startswith("{")
    assert training.importance_report(run.importances, 2).filter("rank > 2").count() == 0
    assert training.selected_features(run.registry).count() > 0
    path = run.registry.filter("model = 'LinearRegression' and horizon = 1").first().path
    assert models.load(path, spark).model.numFeatures == run.registry.filter("model = 'LinearRegression'").first().n_features


def test_matrix_has_no_leak(spark, sf_dir):
    cfg = PanelConfig(lags=1, test_split=0.25)
    base = modelling._ratios(spark, sf_dir)
    from ledgerline.operators.design import horizon_dataset

    rows = horizon_dataset(base, "roa", 2, cfg, ["deposit_ratio"])
    last_train = rows.filter("split = 'train'").agg(F.max("date")).first()[0]
    first_test = rows.filter("split = 'test'").agg(F.min("date")).first()[0]
    # The two quarters before the cut have no label inside the train split.
    assert (first_test.year - last_train.year) * 4 + (first_test.month - last_train.month) // 3 >= 3


def test_stored_models_predict_the_same(spark, train, tmp_path):
    for name in (models.MEAN, models.OLS, models.EFFECTS, models.TREE):
        fitted = models.fit(name, train, ["x0", "x1"], {"max_depth": 3} if name == models.TREE else None)
        fitted.save(f"{tmp_path}/{name}", spark)
        loaded = models.load(f"{tmp_path}/{name}", spark)
        a, b = (sorted((r.id, r.date, round(r.prediction, 9)) for r in m.predict(train).select("id", "date", "prediction").collect()) for m in (fitted, loaded))
        assert a == b and loaded.features == fitted.features and loaded.params == fitted.params


def study(spark, train):
    panel = PreparedPanel(train.withColumn("quarter", F.concat(F.lit("quarter_"), F.quarter("date"))), ["x0", "x1"], ["quarter"], [], None, None)
    return panel, PanelConfig(targets=("label",), features={"x0": "bank", "x1": "bank"}, lags=1)


def test_a_run_is_taken_up_where_it_ended(spark, train, tmp_path, monkeypatch):
    panel, cfg = study(spark, train)
    fitted, original = [], models.fit

    def counting(name, *args, **kwargs):
        fitted.append(name)
        if name == models.RIDGE and fitted.count(name) == 1:
            raise RuntimeError("the cluster is gone")
        return original(name, *args, **kwargs)

    monkeypatch.setattr(models, "fit", counting)
    names = (models.MEAN, models.OLS, models.RIDGE)
    with pytest.raises(RuntimeError):
        training.train_matrix(panel, cfg, names=names, search=None, out=str(tmp_path))
    run = training.train_matrix(panel, cfg, names=names, search=None, out=str(tmp_path))
    assert sorted(fitted) == sorted([models.MEAN, models.OLS, models.RIDGE, models.RIDGE]) and fitted[-1] == models.RIDGE
    assert {r.model for r in run.registry.collect()} == set(names)
    training.train_matrix(panel, cfg, names=names, search=None, out=str(tmp_path))
    assert len(fitted) == 4
    # other settings make everything due again
    training.train_matrix(panel, PanelConfig(targets=("label",), features={"x0": "bank", "x1": "bank"}, lags=2), names=names, search=None, out=str(tmp_path))
    assert len(fitted) == 7


def test_a_search_that_fails_is_on_record(spark, train, tmp_path, monkeypatch):
    panel, cfg = study(spark, train)
    monkeypatch.setattr(models, "fold_moments", lambda *a: (_ for _ in ()).throw(ValueError("no folds")))
    run = training.train_matrix(panel, cfg, names=(models.MEAN, models.RIDGE), search="grid", out=str(tmp_path))
    found = {r.model: r for r in run.registry.collect()}
    assert found[models.MEAN].fallback is None and "no folds" in found[models.RIDGE].fallback and found[models.RIDGE].problem is None


def test_a_stored_run_scores_rows_it_never_saw(spark, train, tmp_path):
    """New entities, a level and quarters that training did not have; ensembles too."""
    panel, cfg = study(spark, train)
    names = (models.MEAN, models.OLS, models.EFFECTS, models.TREE, models.FOREST)
    original = models.estimator
    models.estimator = lambda m, p, *a: original(m, {"max_depth": 3, "n_estimators": 4, **p}, *a)
    try:
        training.train_matrix(panel, cfg, names=names, search=None, out=str(tmp_path))
    finally:
        models.estimator = original
    run = training.load_run(spark, str(tmp_path))
    # the rows of the test split come out as they did in training
    again = training.score_panel(spark, str(tmp_path), panel.data)
    both = again.join(run.predictions.withColumnRenamed("prediction", "then"), ["target", "horizon", "model", "id", "date"])
    gap = both.agg(F.count("*").alias("n"), F.max(F.abs(F.col("prediction") - F.col("then"))).alias("gap")).first()
    assert gap.n == run.predictions.count() and gap.gap < 1e-9
    late = panel.data.select(F.concat(F.lit("new"), "id").alias("id"), F.add_months("date", 1200).alias("date"), "label", "x0", "x1", F.lit("quarter_9").alias("quarter"))
    scored = training.score_panel(spark, str(tmp_path), late)
    assert scored.filter("prediction is null").count() == 0 and scored.filter("label is null").count() > 0
    assert {r.model for r in scored.select("model").distinct().collect()} == {*names, "VotingEnsemble"}
    members = scored.filter("model in ('DecisionTree', 'RandomForest')").groupBy("id", "date").agg(F.avg("prediction").alias("mean"))
    off = members.join(scored.filter("model = 'VotingEnsemble'"), ["id", "date"]).agg(F.max(F.abs(F.col("mean") - F.col("prediction")))).first()[0]
    assert off < 1e-9
    report = training.run_report(run)
    assert report.count() == 6 and report.filter("train_rmse is null or test_rmse is null").count() == 0


def test_preprocessing_is_stored_whole(spark, tmp_path):
    rows = spark.createDataFrame(
        [("1", "train", 1.0, 5.0, "b", f"e{i}") for i in range(80)] + [("2", "train", 3.0, 5.0, "a", "e0"), ("3", "test", 9.0, 6.0, "zz", "unseen"), ("4", "test", 9.0, 6.0, None, None)],
        "id string, split string, x double, one double, level string, many string",
    )
    fitted = preprocess.fit(rows, ["level", "many"])
    assert fitted.levels == {"level": ("a", "b")} and list(fitted.vectors) == ["many"]
    fitted.save(f"{tmp_path}/p", spark)
    loaded = preprocess.load(f"{tmp_path}/p", spark)
    assert loaded.scaling == fitted.scaling and loaded.levels == fitted.levels
    a, b = (sorted(map(str, p.apply(rows).collect())) for p in (fitted, loaded))
    assert a == b
    unseen = {r.id: r for r in loaded.apply(rows.drop("split")).collect() if r.id in "34"}
    assert unseen["3"]["cat__level_a"] == unseen["3"]["cat__level_b"] == 0 and unseen["3"]["cat__many"].numNonzeros() == 0
    assert unseen["4"]["num__one"] == 1.0 and unseen["4"]["cat__many"].numNonzeros() == 0


def test_a_model_that_fails_does_not_end_the_run(spark, train, tmp_path):
    panel = PreparedPanel(train.withColumn("quarter", F.concat(F.lit("quarter_"), F.quarter("date"))), ["x0", "x1"], ["quarter"], [], None, None)
    cfg = PanelConfig(targets=("label",), features={"x0": "bank", "x1": "bank"}, lags=1)
    run = training.train_matrix(panel, cfg, names=(models.OLS, "NoSuchModel"), search=None, out=str(tmp_path))
    assert {r.model: r.problem is None for r in run.registry.collect()} == {models.OLS: True, "NoSuchModel": False}
    assert {r.model for r in run.predictions.select("model").distinct().collect()} == {models.OLS}


def test_a_tree_deeper_than_possible_is_refused():
    with pytest.raises(ValueError, match="30 levels"):
        models.estimator(models.TREE, {"max_depth": 40}, 10, 1.0)


def test_cross_products_of_many_features(spark):
    n = 1200
    df = spark.range(0, 50, 1, 4).select(*((F.col("id") * (i % 7 + 1) % 11).cast("double").alias(f"f{i}") for i in range(n)), F.col("id").cast("double").alias("label"))
    got = linear.cross_products(df, [f"f{i}" for i in range(n)])
    ids = np.arange(50.0)
    x = np.column_stack([np.ones(50), *((ids * (i % 7 + 1)) % 11 for i in range(n)), ids])
    assert np.allclose(got.matrix, x.T @ x)


def test_entity_effects_of_five_thousand_entities(spark, tmp_path):
    n = 5000
    rows = spark.range(0, n * 6, 1, 4).select(
        (F.col("id") % n).cast("string").alias("id"), F.expr("add_months(DATE '2000-01-01', 3 * cast(id div 5000 as int))").alias("date"),
        F.when(F.col("id") < n * 4, "train").otherwise("test").alias("split"), (F.col("id") % 13).cast("double").alias("x"),
    ).withColumns({"bank_id": F.concat(F.lit("bank_id_"), "id"), "label": 2 * F.col("x") + F.pmod(F.xxhash64("id"), F.lit(10))})
    matrix = scale_and_encode(rows, ["bank_id"])
    assert feature_columns(matrix) == ["num__x", "cat__bank_id"]
    train = matrix.filter("split = 'train'").cache()
    for name in (models.RIDGE, models.EFFECTS):
        fitted = models.fit(name, train, feature_columns(matrix), {"alpha": 1e-3} if name == models.RIDGE else None)
        error = fitted.predict(matrix.filter("split = 'test'")).agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0]
        assert error < 0.05 and dict(fitted.importances())["num__x"] > 0
        assert len(fitted.importances()) == (2 if name == models.RIDGE else 1)


def test_unseen_level_is_all_zeros(spark):
    rows = spark.createDataFrame([("1", "train", "b", 1.0), ("2", "train", "a", 2.0), ("3", "test", "zz", 3.0)], "id string, split string, bank_id string, x double")
    got = {r["id"]: r["cat__bank_id"].toArray().tolist() for r in one_hot_vector(rows, "bank_id").collect()}
    assert got == {"1": [0.0, 1.0], "2": [1.0, 0.0], "3": [0.0, 0.0]}


def test_boosting_ends_on_the_last_train_dates(spark):
    """Noise is not learned for long, and rows of the test split have no say."""
    rows = spark.range(0, 1200, 1, 4).select(
        F.expr("add_months(DATE '2000-01-01', 3 * cast(id % 40 as int))").alias("date"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("x"),
        (F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1000)) / 1000).alias("label"),
    ).cache()
    params = {"n_estimators": 30, "max_depth": 4}
    long, short = (models.fit(models.BOOSTED, rows, ["x"], {**params, **more}) for more in ({}, {"validation": 0.2}))
    assert long.model.getNumTrees == 30 and short.model.getNumTrees < 30
    judges = rows.withColumn("j", models._last_dates(rows, 0.2)).groupBy("j").agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.count_distinct("date").alias("n"))
    by = {r.j: r for r in judges.collect()}
    assert by[True].n == 8 and by[False].hi < by[True].lo


def test_trees_do_not_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(models, "MODEL_LEAVES", 60)
    assert models.smallest_leaf(10, 1) == 1 and models.smallest_leaf(10**9, 100) == 10**11 // 60 + 1
    for n in (500, 5000):
        rows = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(99991)) / 7.0).alias("x"), F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(1000)).cast("double").alias("label"))
        tree = models.fit(models.TREE, rows, ["x"]).model
        forest = models.fit(models.FOREST, rows, ["x"], {"n_estimators": 3}).model
        assert (tree.numNodes + 1) / 2 <= 60 and sum((t.numNodes + 1) / 2 for t in forest.trees) <= 60 * 1.7


def test_leaves_hold_one_row_however_many_the_rows(spark):
    for rows in (10, 16_959, 10**9):
        for model in (models.TREE, models.FOREST, models.BOOSTED):
            assert models.estimator(model, {}, rows, 1.0).getMinInstancesPerNode() == 1
            assert models.estimator(model, {"min_samples_leaf": 3}, rows, 1.0).getMinInstancesPerNode() == 3
    rows = spark.range(10_001).select((F.col("id") == 7).cast("double").alias("x"), F.when(F.col("id") == 7, 100.0).otherwise(0.0).alias("label"))
    fitted = models.fit(models.FOREST, rows, ["x"], {"n_estimators": 100, "max_depth": 1, "bootstrap": False})
    assert [r["prediction"] for r in fitted.predict(rows).orderBy("x").collect()] == [0.0] * 10_000 + [100.0]


def test_blocks_of_trees_are_whole_and_bounded():
    assert models.tree_blocks(1697, 100, 1) == [100]
    assert models.tree_blocks(16959, 100, models.smallest_leaf(16959, 100)) == [20] * 5
    assert models.tree_blocks(10**9, 7, models.smallest_leaf(10**9, 7)) == [1] * 7
    for rows, trees in ((1, 1), (40_000, 200), (10**6, 100), (10**10, 13)):
        leaf = models.smallest_leaf(rows, trees)
        sizes = models.tree_blocks(rows, trees, leaf)
        assert sum(sizes) == trees and (max(sizes) == 1 or max(sizes) * rows <= models.BLOCK_LEAVES * leaf)


def test_few_rows_in_many_partitions_make_no_more_work_for_nodes(train, monkeypatch):
    assert models.tree_partitions(16959, 30, 2) == 1 and models.tree_partitions(1, 30, 1) == 1
    assert models.tree_partitions(10**6, 30, 100) == 4 and models.tree_partitions(10**9, 30, 10**5) == 3125
    assert models.tree_partitions(10**8, 30, 100) == 200 and models.tree_partitions(10**6, 5, 1) == 977
    seen = []

    class Chosen:
        def __getattr__(self, name):
            return lambda: 1

        def fit(self, matrix):
            seen.append(matrix.rdd.getNumPartitions())

    monkeypatch.setattr(models, "estimator", lambda *a: Chosen())
    for model in (models.TREE, models.FOREST):
        models.fit(model, train.repartition(40), NAMES)
    assert seen == [4, 4]  # 240 rows, two leaves


def test_importances_of_a_forest_that_keeps_no_trees(train, monkeypatch):
    params = {"n_estimators": 7, "max_depth": 4, "min_samples_leaf": 2}
    for leaves in (10**6, 360):
        monkeypatch.setattr(models, "BLOCK_LEAVES", leaves)
        kept, dropped = (models.fit(models.FOREST, train, NAMES, params, importances_only=o) for o in (False, True))
        assert dropped.importances() == kept.importances() and len(kept.importances()) == len(NAMES)
    assert not hasattr(dropped.model, "blocks")


def test_a_forest_grown_in_blocks_is_one_forest(spark, train, monkeypatch, tmp_path):
    params = {"n_estimators": 7, "max_depth": 4, "min_samples_leaf": 2}
    whole = models.fit(models.FOREST, train, NAMES, params).model
    alone = models.estimator(models.FOREST, params, 240, 1.0).setCacheNodeIds(False).fit(models.assemble(train, NAMES).coalesce(1))
    assert [t.toDebugString.split("\n", 1)[1] for t in whole.trees] == [t.toDebugString.split("\n", 1)[1] for t in alone.trees]

    monkeypatch.setattr(models, "BLOCK_LEAVES", 360)  # 120 leaves a tree
    fitted = models.fit(models.FOREST, train, NAMES, params)
    assert [b.getNumTrees for b in fitted.model.blocks] == [3, 2, 2]
    texts = {t.toDebugString.split("\n", 1)[1] for t in fitted.model.trees}
    assert len(texts) == 7  # no block repeats the samples of another
    each = np.array([t.featureImportances.toArray() for t in fitted.model.trees])
    assert coefficients(fitted) == pytest.approx(each.mean(0)) and coefficients(fitted).sum() == pytest.approx(1)
    rows = models.assemble(train, NAMES)
    votes = [[r[0] for r in t.transform(rows).orderBy("id", "date").select("prediction").collect()] for t in fitted.model.trees]
    fitted.save(str(tmp_path), spark)
    for model in (fitted, models.load(str(tmp_path), spark)):
        got = [r[0] for r in model.predict(train).orderBy("id", "date").select("prediction").collect()]
        assert got == pytest.approx(np.mean(votes, axis=0))
    assert set(fitted.predict(train).columns) == {*train.columns, "prediction"}
