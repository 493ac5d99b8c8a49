"""Training runs over targets, horizons and models, their stored models on new rows, and their reports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import cache, reduce
from threading import Lock

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.config import PanelConfig
from ledgerline.functions import scalars as S
from ledgerline.operators import aggregates, metrics, models, preprocess
from ledgerline.operators.design import TRAIN, feature_columns, horizon_dataset, scoring_rows
from ledgerline.plans.panel import PreparedPanel
from ledgerline.session import materialize, scratch_path
from ledgerline.sources.files import write_parquet

RUN_SCHEMA = "n_features int, features array<string>, params string, path string, problem string, fallback string, settings string"
REGISTRY_SCHEMA = f"{RUN_SCHEMA}, target string, horizon int, model string"
PREDICTION_SCHEMA = "split string, id string, date date, label double, prediction double, target string, horizon int, model string"
IMPORTANCE_SCHEMA = "feature string, importance double, target string, horizon int, model string"
#: What a model may raise because of its data or parameters. Anything else, such as a lost cluster, ends the run.
DATA_ERRORS = (ValueError, ArithmeticError, np.linalg.LinAlgError, IllegalArgumentException, AnalysisException)


@dataclass(frozen=True)
class TrainingRun:
    predictions: DataFrame
    registry: DataFrame
    importances: DataFrame


def _of(target: str, horizon: int, model: str | None = None) -> str:
    return f"target={target}/horizon={horizon}" + (f"/model={model}" if model else "")


def _marks(spark: SparkSession, folder: str, schema: str) -> list:
    """Rows of a manifest; none where nothing was finished yet."""
    try:
        return spark.read.schema(schema).parquet(folder).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def train_matrix(
    panel: PreparedPanel,
    cfg: PanelConfig,
    targets: Sequence[str] | None = None,
    horizons: Sequence[int] = (1,),
    names: Sequence[str] = models.DEFAULT_MODELS,
    search: str | None = "random",
    draws: int = 20,
    folds: int = 3,
    out: str | None = None,
    parallelism: int = 4,
) -> TrainingRun:
    """Fit every model for every target and horizon and score both splits.

    The driver only loops over runs; matrices, fits and scores are Spark jobs. Each matrix is
    written once (partitioned by split) and all its models read it, ``parallelism`` of them at a time,
    as the many small jobs of a fit do not keep a cluster busy; the fold cross products of a matrix are
    taken once for all its linear models. Beside a matrix stands its preprocessing, so
    that :func:`score_panel` can put rows through it which nobody had seen.

    A run can be taken up again: a matrix and a model are marked in ``out`` when all they consist of is
    stored, and a call with the same settings fits only what is not marked. A model that its data
    or parameters forbid is marked with the problem, and tried again; any other error ends the call.
    ``out`` belongs to one panel.
    """
    spark = panel.data.sparkSession
    out = out or scratch_path(spark, "training")
    design = {"cfg": asdict(cfg), "numeric": panel.numeric, "categorical": panel.categorical}
    settings = hashlib.sha256(json.dumps([design, search, draws, folds], sort_keys=True, default=str).encode()).hexdigest()[:16]
    spark.createDataFrame([(json.dumps(design),)], "design string").coalesce(1).write.mode("overwrite").parquet(f"{out}/design")
    matrices = {(r.target, r.horizon) for r in _marks(spark, f"{out}/matrices_done", "settings string, target string, horizon int") if r.settings == settings}
    finished = {(r.target, r.horizon, r.model) for r in _marks(spark, f"{out}/registry", REGISTRY_SCHEMA) if r.settings == settings and r.problem is None}

    @cache
    def source() -> DataFrame:
        return materialize(panel.data, "training-panel")

    trained = False
    for target in targets or cfg.targets:
        for horizon in horizons:
            folder = f"{out}/matrices/{_of(target, horizon)}"
            if (target, horizon) not in matrices:
                rows = horizon_dataset(source(), target, horizon, cfg, panel.numeric, panel.categorical)
                write_parquet(rows, f"{folder}/unscaled", ["split"])
                rows = spark.read.parquet(f"{folder}/unscaled")
                if rows.filter(F.col("split") == TRAIN).limit(1).count() == 0:
                    continue
                fitted = preprocess.fit(rows, panel.categorical)
                fitted.save(f"{folder}/preprocessing", spark)
                write_parquet(fitted.apply(rows), f"{folder}/scaled", ["split"])
                spark.createDataFrame([(settings,)], "settings string").coalesce(1).write.mode("overwrite").parquet(f"{out}/matrices_done/{_of(target, horizon)}")
            trained = True
            todo = [n for n in names if (target, horizon, n) not in finished]
            if todo:
                _fit_models(spark, out, folder, target, horizon, todo, search, draws, folds, cfg.seed, settings, parallelism)
            _vote(spark, out, target, horizon, names, bool(todo), settings)
    if not trained:
        raise ValueError("no target and horizon has train rows")
    return load_run(spark, out)


def _fit_models(spark, out, folder, target, horizon, names, search, draws, folds, seed, settings, parallelism) -> None:
    matrix = spark.read.parquet(f"{folder}/scaled")
    features = feature_columns(matrix)
    train = matrix.filter(F.col("split") == TRAIN)
    lock, taken = Lock(), []

    def moments():
        with lock:
            if not taken:
                taken.append(models.fold_moments(train, features, folds))
            return taken[0]

    def one(name: str) -> None:
        candidates = {
            "random": lambda: models.random_draws(name, draws, seed, len(features)),
            "grid": lambda: models.grid_points(name, len(features)),
            None: list,
        }[search]()
        # boosting ends where the last train dates say so; no test row is asked
        fixed = {"validation": models.VALIDATION} if models.base_name(name) == models.BOOSTED else {}
        candidates = [{**c, **fixed} for c in candidates]
        path = f"{out}/models/{_of(target, horizon)}/{name}"
        try:
            fitted, fallback = _fitted(name, train, features, candidates, fixed, folds, seed, moments)
            fitted.save(path, spark)
            rows = fitted.predict(matrix).select("split", F.col("id").cast("string").alias("id"), F.col("date").cast("date").alias("date"), "label", "prediction")
            rows.write.mode("overwrite").parquet(f"{out}/predictions/{_of(target, horizon, name)}")
        except DATA_ERRORS as e:
            _register(spark, out, target, horizon, name, [None, None, None, None, f"{type(e).__name__}: {e}"[:500], None, settings])
            return
        importances = spark.createDataFrame(fitted.importances(), "feature string, importance double")
        importances.coalesce(1).write.mode("overwrite").parquet(f"{out}/importances/{_of(target, horizon, name)}")
        # the mark that all of this model is stored
        _register(spark, out, target, horizon, name, [len(fitted.features), fitted.features, models.params_json(fitted.params), path, None, fallback, settings])

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        list(pool.map(inheritable_thread_target(spark)(one), names))


def _register(spark: SparkSession, out: str, target: str, horizon: int, model: str, row: list) -> None:
    spark.createDataFrame([tuple(row)], RUN_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{out}/registry/{_of(target, horizon, model)}")


def _vote(spark: SparkSession, out: str, target: str, horizon: int, names: Sequence[str], changed: bool, settings: str) -> None:
    """The mean of the members that could be fitted, as predictions and as a model of its own."""
    run = (F.col("target") == target) & (F.col("horizon") == horizon)
    fitted = {r.model: r for r in spark.read.schema(REGISTRY_SCHEMA).parquet(f"{out}/registry").filter(run).collect() if r.problem is None and r.settings == settings}
    members = [m for m in names if m in fitted and m in models.ENSEMBLE_MEMBERS]
    if len(members) < 2 or models.ENSEMBLE in fitted and not changed:
        return
    votes = metrics.voting_ensemble(_stored(spark, out).filter(run), members)
    votes.select("split", "id", "date", "label", "prediction").write.mode("overwrite").parquet(f"{out}/predictions/{_of(target, horizon, models.ENSEMBLE)}")
    path = f"{out}/models/{_of(target, horizon)}/{models.ENSEMBLE}"
    models.Ensemble([fitted[m].path for m in members], []).save(path, spark)
    features = sorted({f for m in members for f in fitted[m].features})
    _register(spark, out, target, horizon, models.ENSEMBLE, [len(features), features, models.params_json({"members": members}), path, None, None, settings])


def _fitted(name, train, features, candidates, fixed, folds, seed, moments) -> tuple[models.FittedModel, str | None]:
    """The best candidate; the default parameters, and why, where there is none or the search fails."""
    if not candidates:
        return models.fit(name, train, features, fixed, seed), None
    try:
        fitted, scored = models.param_search(name, train, features, candidates, folds, seed, moments=moments)
        return fitted, None if scored else "too few rows or dates, or a constant label"
    except DATA_ERRORS as e:
        return models.fit(name, train, features, fixed, seed), f"search failed: {type(e).__name__}: {e}"[:500]


def _stored(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(PREDICTION_SCHEMA).parquet(f"{out}/predictions").select("target", "horizon", "model", "split", "id", "date", "label", "prediction")


def load_run(spark: SparkSession, out: str) -> TrainingRun:
    """A stored run: predictions, registry (with the problem of a model that failed) and importances."""
    registry = spark.read.schema(REGISTRY_SCHEMA).parquet(f"{out}/registry").select("target", "horizon", "model", "n_features", "features", "params", "path", "problem", "fallback")
    importances = spark.read.schema(IMPORTANCE_SCHEMA).parquet(f"{out}/importances").select("target", "horizon", "model", "feature", "importance")
    return TrainingRun(_stored(spark, out), registry, importances)


def load_preprocessing(spark: SparkSession, out: str, target: str, horizon: int) -> preprocess.Preprocessing:
    """Means, deviations and levels of the train rows of one matrix of a stored run."""
    return preprocess.load(f"{out}/matrices/{_of(target, horizon)}/preprocessing", spark)


def score_panel(spark: SparkSession, out: str, panel: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Predictions of a stored run's models for a panel they never saw: target, horizon, model, id, date, label, prediction.

    Everything comes from the folder: the design (lags and columns), the preprocessing of each
    target and horizon, and the models, ensembles included. Nothing is fitted again. ``panel`` holds the
    prepared columns by (id, date); rows whose features are not all known are not scored, rows whose
    label is not known yet are. Levels and entities that training did not see have the meaning the
    models give them (zeros, the mean level).
    """
    design = json.loads(spark.read.parquet(f"{out}/design").first()[0])
    # Fields of the settings come back as lists where they were tuples; only lags and targets are read.
    cfg = PanelConfig(**design["cfg"])
    scores = []
    runs = [r for r in load_run(spark, out).registry.orderBy("target", "horizon", "model").collect() if r.path and (names is None or r.model in names)]
    for target, horizon in dict.fromkeys((r.target, r.horizon) for r in runs):
        rows = scoring_rows(panel, target, horizon, cfg, design["numeric"], design["categorical"])
        rows = materialize(load_preprocessing(spark, out, target, horizon).apply(rows), "scoring-rows")
        for run in runs:
            if (run.target, run.horizon) == (target, horizon):
                scored = models.load(run.path, spark).predict(rows)
                scores.append(scored.select(F.lit(target).alias("target"), F.lit(horizon).alias("horizon"), F.lit(run.model).alias("model"), "id", "date", "label", "prediction"))
    if not scores:
        raise ValueError("the run holds no stored model of these names")
    return reduce(DataFrame.unionByName, scores)


def run_report(run: TrainingRun) -> DataFrame:
    """One row a run: metrics and coverage of the train and the test split side by side, features and parameters.

    Columns carry ``train_`` and ``test_`` in front; best test error first within run type and target.
    """
    keys = list(metrics.RUN_KEYS)
    split = metrics.regression_metrics(run.predictions).join(metrics.run_coverage(run.predictions), [*keys, "split"])
    values = [c for c in split.columns if c not in (*keys, "split")]
    wide = split.groupBy(*keys).agg(*[F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}") for s in ("train", "test") for c in values])
    named = wide.join(run.registry, keys, "left").withColumns(
        {"run_type": F.when(F.col("model").endswith("_RFE"), "RFE").otherwise("Standard"), "base_model": F.replace("model", F.lit("_RFE"), F.lit(""))}
    )
    return named.orderBy("run_type", "target", "horizon", "test_rmse", "model")


def feature_count_report(comparison: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Mean number of features per base model and run type, targets as columns, ``-`` where none."""
    wide = aggregates.pivot_mean(comparison, ["base_model", "run_type"], "target", "n_features", targets)
    return wide.select("base_model", "run_type", *[F.coalesce(F.col(f"`{t}`").cast("string"), F.lit("-")).alias(t) for t in targets])


def param_report(comparison: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Parameters per target, ``base model|run type`` as columns, ``N/A`` where none."""
    wide = aggregates.pivot_first(comparison, "target", ["base_model", "run_type"], "params", runs, ["rmse", "model"])
    return wide.select("target", *[F.coalesce(F.col(f"`{r}`"), F.lit("N/A")).alias(r) for r in runs])


def importance_report(importances: DataFrame, n: int = 10) -> DataFrame:
    """Largest importances per run under their display names."""
    top = aggregates.top_n_importance(importances, n, ["target", "horizon", "model"])
    bare = F.regexp_replace("feature", "^(num|cat)__", "")
    return top.withColumn("display", S.display_name(bare))


def selected_features(registry: DataFrame) -> DataFrame:
    """Features kept by the runs with feature selection."""
    return registry.filter(F.col("model").endswith("_RFE")).select("target", "horizon", "model", F.explode("features").alias("feature"))
