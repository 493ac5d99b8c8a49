"""Regressors on Spark ML, hyper-parameter search and importances."""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product
from typing import Any

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import regression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import DenseVector, Vectors, VectorUDT
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.design import ENTITY, TEST, TRAIN, expanding_folds, fold_rows
from ledgerline.operators.linear import (
    Moments,
    absorb,
    absorbed_fit,
    add_moments,
    block_cross_products,
    coordinate_descent,
    cross_products,
    elimination_order,
    eliminate_features,
    linear_prediction,
    moment_error,
    solve,
)
from ledgerline.session import materialize

MEAN, OLS, EFFECTS = "DummyRegressor", "LinearRegression", "FixedEffectsLR"
LASSO, RIDGE, ELASTIC = "Lasso", "Ridge", "ElasticNet"
TREE, FOREST, BOOSTED = "DecisionTree", "RandomForest", "BoostedTrees"
ENSEMBLE = "VotingEnsemble"
ENSEMBLE_MEMBERS = tuple(m + s for m in (BOOSTED, FOREST, TREE) for s in ("", "_RFE"))
DEFAULT_MODELS = (OLS, RIDGE, TREE, FOREST, BOOSTED)
MAX_DEPTH = 30  # the deepest tree Spark ML grows
#: Leaves of all trees of a model together, for whoever must have small models: beyond them leaves hold more rows.
#: None: leaves hold what the parameters say, however many the rows.
MODEL_LEAVES: int | None = None
#: Leaves of the trees that one job grows: a larger forest is grown in blocks of trees.
BLOCK_LEAVES = 400_000
#: Leaves of the blocks that are grown side by side: their nodes lie on the driver, three times as large as when done.
GROWING_LEAVES = 1_200_000
#: Every partition fills and sends the statistics of every node, so it shall have some rows for each leaf of a tree,
#: if these are no more than one task should hold.
ROWS_A_LEAF = 32
PARTITION_ROWS = 500_000
#: Seeds of two blocks lie further apart than partitions are many: bootstrap samples are drawn by seed + partition.
SEED_STEP = 1_000_003
#: Candidate splits of a feature. Each task keeps statistics of nodes x features x bins; more bins than
#: the default 32 bring splits nearer to the exact ones that single-machine trees find.
MAX_BINS = 64
#: Share of the train dates, the last ones, on which a boosted model's rounds are judged in a run.
VALIDATION = 0.1

# Search ranges ("u" uniform on [low, high], "i" whole numbers low..high).
RANDOM_RANGES: dict[str, dict[str, tuple[str, float, float]]] = {
    LASSO: {"alpha": ("u", 0.0001, 10)},
    RIDGE: {"alpha": ("u", 0.001, 100)},
    ELASTIC: {"alpha": ("u", 0.001, 10), "l1_ratio": ("u", 0.1, 0.9)},
    TREE: {"max_depth": ("i", 3, 20), "min_samples_leaf": ("i", 1, 10)},
    BOOSTED: {
        "n_estimators": ("i", 10, 150), "learning_rate": ("u", 0.01, 0.3), "max_depth": ("i", 3, 11),
        "subsample": ("u", 0.2, 1.0), "colsample": ("u", 0.2, 1.0),
    },
    FOREST: {"n_estimators": ("i", 10, 200), "max_depth": ("i", 5, 30), "min_samples_leaf": ("i", 1, 10)},
}
# Grids of the exhaustive search.
GRIDS: dict[str, dict[str, list[Any]]] = {
    LASSO: {"alpha": [0.0001, 0.001, 0.01, 0.1, 1, 10, 20]},
    RIDGE: {"alpha": [0.001, 0.01, 0.1, 1, 10, 50, 100]},
    ELASTIC: {"alpha": [0.001, 0.01, 0.1, 1, 10], "l1_ratio": [0.1, 0.3, 0.5, 0.7, 0.9]},
    TREE: {"max_depth": [None, 5, 10, 15, 20], "min_samples_leaf": [1, 5, 10]},
    BOOSTED: {
        "n_estimators": [20, 30, 35, 40, 45, 50, 100],
        "learning_rate": [0.01, 0.03, 0.05, 0.06, 0.07, 0.08, 0.1, 0.2],
        "max_depth": [3, 5, 7, 9, 11],
    },
    FOREST: {"n_estimators": [50, 100, 150], "max_depth": [None, 10, 20], "min_samples_leaf": [1, 2, 4]},
}


def base_name(model: str) -> str:
    return model.removesuffix("_RFE")


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def _depth(wanted: int | None, default: int) -> int:
    """Depth of a tree; ``None`` is the default of the model, for single trees as deep as Spark ML grows them."""
    if wanted is not None and wanted > MAX_DEPTH:
        raise ValueError(f"trees are at most {MAX_DEPTH} levels deep, not {wanted}")
    return default if wanted is None else int(wanted)


def smallest_leaf(rows: int, trees: int) -> int:
    """Rows a leaf must hold so that all trees of a model have at most ``MODEL_LEAVES`` leaves, if these are limited."""
    return max(1, -(-rows * trees // MODEL_LEAVES)) if MODEL_LEAVES else 1


def tree_blocks(rows: int, trees: int, leaf: int) -> list[int]:
    """Trees of each block of a forest whose leaves hold at least ``leaf`` rows."""
    blocks = -(-trees // max(1, BLOCK_LEAVES * leaf // rows))
    return [trees // blocks + (i < trees % blocks) for i in range(blocks)]


def tree_partitions(rows: int, depth: int, leaf: int) -> int:
    """Partitions of the rows beyond which a tree takes more work for its nodes than for its rows."""
    leaves = min(max(1, rows // leaf), 2**depth)
    return -(-rows // min(PARTITION_ROWS, ROWS_A_LEAF * leaves))


def sparse_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features that are vectors, as entity effects are."""
    return [f for f in features if isinstance(df.schema[f].dataType, VectorUDT)]


def estimator(model: str, params: dict[str, Any], rows: int, label_std: float, seed: int = 42, solver: str = "normal"):
    """Spark ML estimator for a model name with parameters in the conventional scale.

    Spark ML scales the L2 part of a penalty by the label's deviation and divides the loss by
    the number of rows; the factors below undo that, so ``alpha`` means the textbook penalty.
    """
    name = base_name(model)
    depth = _depth(params.get("max_depth"), MAX_DEPTH)
    trees = int(params.get("n_estimators", 100)) if name in (FOREST, BOOSTED) else 1
    leaf = max(int(params.get("min_samples_leaf", 1)), smallest_leaf(rows, trees))
    if name in (OLS, RIDGE, LASSO, ELASTIC):
        alpha, reg, mix = float(params.get("alpha", 1.0)), 0.0, 0.0
        if name == RIDGE:
            reg = alpha * label_std / rows
        elif name == LASSO:
            reg, mix = alpha, 1.0
        elif name == ELASTIC:
            l1 = float(params.get("l1_ratio", 0.5))
            reg = alpha * l1 + alpha * (1 - l1) * label_std
            mix = alpha * l1 / reg
        return LinearRegression(
            regParam=reg, elasticNetParam=mix, standardization=False, solver=solver, maxIter=15000, tol=1e-10
        )
    # Rows keep the number of their node in every tree: deep trees need not be sent to all tasks level by level.
    if name == TREE:
        return DecisionTreeRegressor(maxDepth=depth, minInstancesPerNode=leaf, maxBins=MAX_BINS, cacheNodeIds=True, seed=seed)
    if name == FOREST:
        # Every split may use every feature, as a bagged forest does.
        return RandomForestRegressor(
            numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, maxBins=MAX_BINS,
            featureSubsetStrategy="all", bootstrap=bool(params.get("bootstrap", True)), cacheNodeIds=True, seed=seed,
        )
    if name == BOOSTED:
        return GBTRegressor(
            maxIter=trees, stepSize=float(params.get("learning_rate", 0.3)),
            maxDepth=_depth(params.get("max_depth"), 6), minInstancesPerNode=leaf, maxBins=MAX_BINS,
            subsamplingRate=float(params.get("subsample", 1.0)),
            featureSubsetStrategy=str(float(params.get("colsample", 1.0))), seed=seed,
        )
    raise ValueError(f"unknown model {model}")


@dataclass
class Forest:
    """A forest that was grown in blocks of trees; every tree counts the same."""

    blocks: list[RandomForestRegressionModel]

    @property
    def trees(self) -> list:
        return [t for b in self.blocks for t in b.trees]

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        return ForestImportances.of(map(summed_importances, self.blocks)).featureImportances

    def transform(self, df: DataFrame) -> DataFrame:
        names = [f"_block{i}" for i in range(len(self.blocks))]
        for name, block in zip(names, self.blocks):
            df = block.transform(df, {block.predictionCol: name})
        total = sum(F.col(n) * b.getNumTrees for n, b in zip(names, self.blocks))
        return df.withColumn("prediction", total / sum(b.getNumTrees for b in self.blocks)).drop(*names)


@dataclass
class ForestImportances:
    """A forest of which only the importances are wanted: its blocks are dropped once theirs are known."""

    featureImportances: DenseVector  # noqa: N815

    @classmethod
    def of(cls, sums: Iterable[np.ndarray]) -> ForestImportances:
        values = sum(sums)
        return cls(Vectors.dense(values / (values.sum() or 1.0)))


def summed_importances(block: RandomForestRegressionModel) -> np.ndarray:
    """Importances added up over the trees of a block; its own are a mean over its trees that have a split."""
    return block.featureImportances.toArray() * sum(t.depth > 0 for t in block.trees)


def grow_forest(chosen: RandomForestRegressor, matrix: DataFrame, rows: int, importances_only: bool = False) -> RandomForestRegressionModel | Forest | ForestImportances:
    """Fit a forest, a large one in blocks of trees, as many of them side by side as the driver can hold."""
    leaf = chosen.getMinInstancesPerNode()
    sizes = tree_blocks(rows, chosen.getNumTrees(), leaf)
    if len(sizes) == 1:
        return chosen.fit(matrix)
    parts = [chosen.copy({chosen.numTrees: n, chosen.seed: chosen.getSeed() + i * SEED_STEP}) for i, n in enumerate(sizes)]

    def grow(part: RandomForestRegressor) -> RandomForestRegressionModel | np.ndarray:
        block = part.fit(matrix)
        return summed_importances(block) if importances_only else block

    with ThreadPoolExecutor(max_workers=max(1, GROWING_LEAVES * leaf // (sizes[0] * rows))) as pool:
        grown = list(pool.map(inheritable_thread_target(matrix.sparkSession)(grow), parts))
    return ForestImportances.of(grown) if importances_only else Forest(grown)


@dataclass
class FittedModel:
    name: str
    features: list[str]
    model: Any = None
    constant: float | None = None
    effects: DataFrame | None = None
    beta: list[float] | None = None
    params: dict[str, Any] = field(default_factory=dict)
    widths: list[int] | None = None  # columns of each feature, where one is a vector
    level_weight: float | None = None  # absolute coefficients of absorbed levels, added up

    def predict(self, df: DataFrame) -> DataFrame:
        if self.constant is not None:
            if self.effects is None:
                return df.withColumn("prediction", F.lit(self.constant))
            # An entity unseen in training gets the mean train level.
            level = F.coalesce(F.col("effect"), F.lit(self.constant))
            return df.join(self.effects, "id", "left").withColumn("prediction", linear_prediction(self.features, self.beta, level)).drop("effect")
        return self.model.transform(assemble(df, self.features)).drop("features")

    def importances(self) -> list[tuple[str, float]]:
        if self.beta is not None:
            return list(zip(self.features, [*self.beta, self.level_weight]))
        if self.model is None:
            return []
        values = self.model.featureImportances if hasattr(self.model, "featureImportances") else self.model.coefficients
        values = values.toArray()
        if self.widths is None:
            return [(f, float(v)) for f, v in zip(self.features, values)]
        # The levels of a category count together.
        ends = np.cumsum(self.widths)
        return [(f, float(values[e - w] if w == 1 else np.abs(values[e - w : e]).sum())) for f, w, e in zip(self.features, self.widths, ends)]

    def save(self, path: str, spark: SparkSession) -> None:
        """Store whatever the model consists of below ``path``; :func:`load` reads it back."""
        kept = {"name": self.name, "features": self.features, "constant": self.constant, "beta": self.beta, "params": self.params, "widths": self.widths, "level_weight": self.level_weight, "kind": type(self.model).__name__ if self.model is not None else None}
        blocks = self.model.blocks if isinstance(self.model, Forest) else []
        kept["blocks"] = len(blocks)
        spark.createDataFrame([(json.dumps(kept),)], "model string").coalesce(1).write.mode("overwrite").parquet(f"{path}/description")
        for i, block in enumerate(blocks):
            block.write().overwrite().save(f"{path}/model/{i}")
        if self.model is not None and not blocks:
            self.model.write().overwrite().save(f"{path}/model")
        if self.effects is not None:
            self.effects.write.mode("overwrite").parquet(f"{path}/effects")


@dataclass
class Ensemble:
    """Unweighted mean of models that are stored by themselves."""

    members: list[str]  # their paths
    models: list[FittedModel]
    name: str = ENSEMBLE

    def predict(self, df: DataFrame) -> DataFrame:
        names = [f"_member{i}" for i in range(len(self.models))]
        for name, model in zip(names, self.models):
            df = model.predict(df).withColumnRenamed("prediction", name)
        return df.withColumn("prediction", sum(map(F.col, names)) / len(names)).drop(*names)

    def save(self, path: str, spark: SparkSession) -> None:
        kept = json.dumps({"kind": ENSEMBLE, "members": self.members})
        spark.createDataFrame([(kept,)], "model string").coalesce(1).write.mode("overwrite").parquet(f"{path}/description")


def load(path: str, spark: SparkSession) -> FittedModel | Ensemble:
    """A model stored by :meth:`FittedModel.save` or :meth:`Ensemble.save`."""
    kept = json.loads(spark.read.parquet(f"{path}/description").first()[0])
    kind = kept.pop("kind")
    if kind == ENSEMBLE:
        return Ensemble(kept["members"], [load(m, spark) for m in kept["members"]])
    blocks = kept.pop("blocks", 0)
    if blocks:
        model = Forest([RandomForestRegressionModel.load(f"{path}/model/{i}") for i in range(blocks)])
    else:
        model = getattr(regression, kind).load(f"{path}/model") if kind else None
    effects = spark.read.parquet(f"{path}/effects") if kept["beta"] is not None else None
    return FittedModel(model=model, effects=effects, **kept)


def fit(model: str, train: DataFrame, features: Sequence[str], params: dict[str, Any] | None = None, seed: int = 42, keep: int | None = None, importances_only: bool = False) -> FittedModel:
    """Fit one model on a train matrix with a ``label`` column; ``*_RFE`` selects features first.

    With ``importances_only`` a large forest does not keep its trees, which the driver may be too small for.
    """
    params, features = dict(params or {}), list(features)
    name = base_name(model)
    rows, mean, std = train.agg(F.count("label"), F.avg("label"), F.stddev_pop("label")).first()
    if not rows or not features:
        raise ValueError("no train rows or no features")
    if name == MEAN:
        return FittedModel(model, features, constant=mean, params=params)
    sparse = sparse_features(train, features)
    scalars = [f for f in features if f not in sparse]
    if name == EFFECTS or name in (OLS, RIDGE) and sparse == [f"cat__{ENTITY}"]:
        return _absorbed(model, train, scalars, [] if name == EFFECTS else sparse, params, keep)
    if model.endswith("_RFE"):
        features = [*eliminate_features(cross_products(train, scalars), params.pop("n_features", keep)), *sparse]
    # Closed forms need a square matrix of all columns; with a sparse vector among them the fit is iterative.
    chosen = estimator(model, params, rows, std, seed, "l-bfgs" if sparse else "normal")
    matrix = assemble(train, features)
    if name in (TREE, FOREST):
        matrix = matrix.coalesce(tree_partitions(rows, chosen.getMaxDepth(), chosen.getMinInstancesPerNode()))
    if name == BOOSTED and params.get("validation"):
        fitted = chosen.setValidationIndicatorCol("judges").fit(matrix.select("features", "label", _last_dates(train, float(params["validation"])).alias("judges")))
    elif name == FOREST:
        fitted = grow_forest(chosen, matrix.select("features", "label"), rows, importances_only)
    else:
        fitted = chosen.fit(matrix.select("features", "label"))
    widths = [train.select(f).first()[0].size if f in sparse else 1 for f in features] if sparse else None
    return FittedModel(model, features, model=fitted, params=params, widths=widths)


def _last_dates(train: DataFrame, share: float) -> Column:
    """Marks the rows of the last ``share`` of the dates: rounds are judged by them, and none is fitted on them."""
    dates = train.agg(F.sort_array(F.collect_set("date"))).scalar()
    first = F.size(dates) - F.greatest(F.lit(1), F.floor(F.size(dates) * F.lit(share)).cast("int"))
    return F.when(first > 0, F.col("date") >= F.get(dates, first)).otherwise(F.lit(False))


def _absorbed(model: str, train: DataFrame, scalars: list[str], levels: list[str], params: dict[str, Any], keep: int | None) -> FittedModel:
    """Least squares or ridge with entity levels, of which only sums by entity are taken."""
    penalty = float(params.get("alpha", 1.0)) if base_name(model) == RIDGE else 0.0
    absorbed = absorb(train, scalars, penalty=penalty)
    kept = scalars
    if model.endswith("_RFE"):
        within = absorbed if not penalty else absorb(train, scalars)
        kept = eliminate_features(within.moments(scalars), params.pop("n_features", keep))
    beta, level, effects = absorbed_fit(absorbed, scalars, kept, penalty)
    effects = materialize(effects, "entity-effects")
    weight = effects.agg(F.sum(F.abs(F.col("effect") - F.lit(level)))).first()[0] if levels else None
    return FittedModel(model, [*kept, *levels], constant=level, effects=effects, beta=[float(b) for b in beta], params=params, level_weight=weight)


def random_draws(model: str, n: int, seed: int = 42, n_features: int | None = None) -> list[dict[str, Any]]:
    rng = random.Random(f"{seed}:{model}")
    ranges = dict(RANDOM_RANGES.get(base_name(model), {}))
    if model.endswith("_RFE") and n_features:
        ranges["n_features"] = ("i", max(1, n_features // 3), n_features)
    pick = {"u": lambda lo, hi: rng.uniform(lo, hi), "i": lambda lo, hi: rng.randint(int(lo), int(hi))}
    return [{k: pick[kind](lo, hi) for k, (kind, lo, hi) in ranges.items()} for _ in range(n)] if ranges else []


def grid_points(model: str, n_features: int | None = None) -> list[dict[str, Any]]:
    """Every point of the grid; with feature selection also a third, two thirds and all of the features."""
    grid = dict(GRIDS.get(base_name(model), {}))
    if model.endswith("_RFE") and n_features:
        grid["n_features"] = sorted({max(1, n_features * q // 3) for q in (1, 2, 3)})
    return [dict(zip(grid, values)) for values in product(*grid.values())] if grid else []


def fold_moments(train: DataFrame, features: Sequence[str], folds: int) -> list[tuple[Moments, Moments]]:
    """Cross products of the train and the test rows of every expanding date fold.

    The folds are unions of date blocks, so one pass over the rows serves every fold, every linear
    model and every candidate; fitting and scoring are then small matrix work.
    """
    bounds = expanding_folds(train, folds).agg(F.sort_array(F.collect_list("test_start"))).scalar()
    marked = train.withColumn("_starts", bounds).withColumn("_block", F.size(F.filter("_starts", lambda d: d <= F.col("date"))))
    blocks = block_cross_products(marked, features, "_block")
    return [(add_moments([blocks[i] for i in range(k)]), blocks[k]) for k in range(1, folds + 1)]


def _penalties(model: str, params: dict[str, Any]) -> tuple[float, float]:
    """(l1, l2) of a candidate for mean squared error / 2."""
    alpha = float(params.get("alpha", 1.0))
    l1 = {LASSO: 1.0, ELASTIC: float(params.get("l1_ratio", 0.5))}.get(base_name(model), 0.0)
    return alpha * l1, alpha * (1 - l1)


def _moment_scores(model: str, moments: Sequence[tuple[Moments, Moments]], candidates: Sequence[dict[str, Any]]) -> list[float]:
    """Fold errors of linear models from cross products.

    Features are eliminated once a fold, for all counts. Sparse penalties are solved along their path:
    from strong to weak, each from the solution before it.
    """
    errors = np.zeros(len(candidates))
    selecting = model.endswith("_RFE")
    path = sorted(range(len(candidates)), key=lambda i: (candidates[i].get("n_features", 0), candidates[i].get("l1_ratio", 0.0), -candidates[i].get("alpha", 1.0)))
    for fit_on, test_on in moments:
        n = len(fit_on.features)
        order = elimination_order(fit_on) if selecting else list(fit_on.features)
        start, before = None, None
        for i in path:
            params = candidates[i]
            wanted = min(params.get("n_features", max(1, n // 2)), n) if selecting else n
            names = set(order[n - wanted :])
            keep = [j for j, f in enumerate(fit_on.features) if f in names]
            if base_name(model) in (LASSO, ELASTIC):
                l1, l2 = _penalties(model, params)
                solved = coordinate_descent(fit_on, l1, l2, keep, start if before == keep else None)
                start, before = solved[0], keep
            else:
                solved = solve(fit_on, keep, float(params.get("alpha", 1.0)) if base_name(model) == RIDGE else 0.0)
            errors[i] += moment_error(test_on, *solved, keep)
    return [float(e) for e in errors / len(moments)]


def _fitted_scores(model: str, train: DataFrame, features: Sequence[str], candidates: Sequence[dict[str, Any]], folds: int, seed: int, parallelism: int) -> list[float]:
    """Fold errors by fitting; several candidates at a time keep the cluster busy."""
    rows = fold_rows(train, expanding_folds(train, folds))
    error = F.pow(F.col("label") - F.col("prediction"), 2)

    def score(params: dict[str, Any]) -> float:
        total = 0.0
        for k in range(1, folds + 1):
            here = rows.filter(F.col("fold") == k)
            fitted = fit(model, here.filter(F.col("role") == TRAIN), features, params, seed)
            total += fitted.predict(here.filter(F.col("role") == TEST)).agg(F.avg(error)).first()[0]
        return total / folds

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(inheritable_thread_target(train.sparkSession)(score), candidates))


def param_search(
    model: str, train: DataFrame, features: Sequence[str], candidates: Sequence[dict[str, Any]], folds: int = 3, seed: int = 42, parallelism: int = 4,
    moments: Callable[[], list[tuple[Moments, Moments]]] | None = None,
) -> tuple[FittedModel, list[dict[str, Any]]]:
    """Score candidates by mean squared error over expanding date folds and refit the best on all rows.

    Falls back to the default parameters (and returns no scores) when there is nothing to search, too
    few dates, or a constant label. ``train`` should be a stored table, as it is read repeatedly;
    ``moments`` gives the fold moments of its features if they are already known.
    """
    stats = train.agg(F.count("*"), F.count_distinct("date"), F.min("label") < F.max("label")).first()
    if not candidates or stats[0] < 2 * folds or stats[1] < folds + 1 or not stats[2]:
        return fit(model, train, features, seed=seed), []
    if base_name(model) in (OLS, RIDGE, LASSO, ELASTIC) and not sparse_features(train, features):
        scores = _moment_scores(model, moments() if moments else fold_moments(train, features, folds), candidates)
    else:
        scores = _fitted_scores(model, train, features, candidates, folds, seed, parallelism)
    scored = [{"params": p, "mse": s} for p, s in zip(candidates, scores)]
    best = min(scored, key=lambda s: s["mse"])
    return fit(model, train, features, best["params"], seed), scored


def predictions(fitted: FittedModel, rows: DataFrame, target: str, horizon: int) -> DataFrame:
    """Long prediction table of a fitted model."""
    return fitted.predict(rows).select(
        F.lit(target).alias("target"), F.lit(horizon).alias("horizon"), F.lit(fitted.name).alias("model"),
        "split", "id", "date", "label", "prediction",
    )


def importance_table(spark: SparkSession, fitted: Sequence[FittedModel]) -> DataFrame:
    rows = [(m.name, f, v) for m in fitted for f, v in m.importances()]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def params_json(params: dict[str, Any]) -> str:
    """Parameters as text with four significant digits, keys in order."""
    short = {k: (float(f"{v:.4g}") if isinstance(v, float) else v) for k, v in sorted(params.items())}
    return json.dumps(short)
