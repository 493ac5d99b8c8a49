"""Linear models from one distributed pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import materialize

_SUMS = "b int, m binary"
_ADDED_BY = (64, 1)  # tasks of the two rounds in which the matrices are added up


@dataclass(frozen=True)
class Moments:
    """Cross products of (1, features, label); its size depends on the columns only."""

    features: tuple[str, ...]
    matrix: np.ndarray

    def centred(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        n = self.matrix[0, 0]
        means = self.matrix[0, 1:] / n
        cross = self.matrix[1:, 1:] - n * np.outer(means, means)
        return cross[:-1, :-1], cross[:-1, -1], means[:-1], means[-1]


def _added_up(sums: DataFrame, size: int) -> dict[int, np.ndarray]:
    """Symmetric matrices of upper triangles (b, m) from many tasks, added in two rounds as they arrive."""

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, m in zip(batch["b"], batch["m"]):
                totals[key] = totals.get(key, 0) + np.frombuffer(m)
        for key, total in totals.items():
            yield pd.DataFrame({"b": [key], "m": [total.tobytes()]})

    for parts in _ADDED_BY:
        sums = sums.repartition(parts).mapInPandas(added, _SUMS)
    out, upper = {}, np.triu_indices(size)
    for b, m in sums.collect():
        matrix = np.zeros((size, size))
        matrix[upper] = np.frombuffer(m)
        out[b] = matrix + np.triu(matrix, 1).T
    return out


def _upper(totals: dict[int, np.ndarray], size: int) -> Iterator[pd.DataFrame]:
    upper = np.triu_indices(size)
    for key, total in totals.items():
        yield pd.DataFrame({"b": [key], "m": [total[upper].tobytes()]})


def block_cross_products(df: DataFrame, features: Sequence[str], block: str, label: str = "label") -> dict[int, Moments]:
    """Sums of outer products per block of rows (few, such as folds), all in one pass.

    Every task reduces its rows to one matrix per block and sends it as a single row.
    """
    columns = [*features, label]
    size = len(columns) + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, rows in batch.groupby("_block", sort=False):
                x = np.column_stack([np.ones(len(rows)), rows[columns].to_numpy(dtype=float)])
                totals[key] = totals.get(key, 0) + x.T @ x
        yield from _upper(totals, size)

    rows = df.select(F.col(block).cast("int").alias("_block"), *columns).na.drop()
    return {b: Moments(tuple(features), m) for b, m in _added_up(rows.mapInPandas(partial, _SUMS), size).items()}


def cross_products(df: DataFrame, features: Sequence[str], label: str = "label") -> Moments:
    found = block_cross_products(df.withColumn("_all", F.lit(0)), features, "_all", label)
    return found.get(0) or Moments(tuple(features), np.zeros((len(features) + 2,) * 2))


@dataclass(frozen=True)
class PairwiseMoments:
    """For every pair of columns over the rows that know both: rows, sums of either, squares and products."""

    counts: np.ndarray  # rows that know a and b
    sums: np.ndarray  # of a, where b is known
    squares: np.ndarray  # of a, where b is known
    products: np.ndarray

    def correlations(self) -> np.ndarray:
        n, s, q = self.counts, self.sums, self.squares
        with np.errstate(invalid="ignore", divide="ignore"):
            spread = q - s * s / n  # of a among the rows of the pair
            # what is left of equal values is rounding noise
            spread = np.where(spread > 1e-13 * q, spread, np.nan)
            return np.clip((self.products - s * s.T / n) / np.sqrt(spread * spread.T), -1.0, 1.0)


def pairwise_moments(df: DataFrame, columns: Sequence[str]) -> PairwiseMoments:
    """Pairwise complete cross products of columns with missing values, about the column means.

    With X the values (0 where missing) and M the marks of known ones, M'M, X'M, (X^2)'M and X'X are all
    there is to know; as products of the one matrix (M, X, X^2) with itself they are added up like
    the cross products of a regression.
    """
    columns = list(columns)
    d, size = len(columns), 3 * len(columns)
    found = df.agg(*[F.avg(F.col(c).cast("double")) for c in columns]).first()
    means = np.array([m if m is not None else 0.0 for m in found])
    names = [f"_c{i}" for i in range(d)]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for batch in batches:
            x = batch.to_numpy(dtype=float) - means
            known = ~np.isnan(x)
            x = np.where(known, x, 0.0)
            stacked = np.hstack([known.astype(float), x, x * x])
            total += stacked.T @ stacked
        yield from _upper({0: total}, size)

    rows = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)])
    whole = _added_up(rows.mapInPandas(partial, _SUMS), size).get(0, np.zeros((size, size)))
    return PairwiseMoments(whole[:d, :d], whole[d : 2 * d, :d], whole[2 * d :, :d], whole[d : 2 * d, d : 2 * d])


def add_moments(parts: Sequence[Moments]) -> Moments:
    return Moments(parts[0].features, sum(p.matrix for p in parts))


def moment_error(moments: Moments, beta: np.ndarray, intercept: float, keep: Sequence[int] | None = None) -> float:
    """Mean squared error of a linear prediction over the rows behind ``moments``."""
    full = np.zeros(moments.matrix.shape[0])
    full[0], full[-1] = intercept, -1.0
    idx = np.arange(len(moments.features)) if keep is None else np.asarray(keep)
    full[1 + idx] = beta
    return float(full @ moments.matrix @ full / moments.matrix[0, 0])


def solve(moments: Moments, keep: Sequence[int] | None = None, penalty: float = 0.0) -> tuple[np.ndarray, float]:
    """Least squares with intercept, ridge when ``penalty`` > 0; minimum norm if columns are dependent."""
    gram, xy, x_mean, y_mean = moments.centred()
    idx = np.arange(len(x_mean)) if keep is None else np.asarray(keep)
    sub = gram[np.ix_(idx, idx)] + penalty * np.eye(len(idx))
    beta = np.linalg.pinv(sub, hermitian=True) @ xy[idx]
    return beta, float(y_mean - beta @ x_mean[idx])


def coordinate_descent(moments: Moments, l1: float, l2: float = 0.0, keep: Sequence[int] | None = None, start: np.ndarray | None = None, tolerance: float = 1e-10, rounds: int = 100_000) -> tuple[np.ndarray, float]:
    """Slopes and intercept that minimise mean squared error / 2 + l1 * |b| + l2 / 2 * b^2.

    Works on the cross products alone, one coefficient after the other, from the solution of a
    neighbouring penalty if one is given. Converged when no step moves predictions by more than
    ``tolerance`` deviations of the label.
    """
    gram, xy, x_mean, y_mean = moments.centred()
    n = moments.matrix[0, 0]
    idx = np.arange(len(x_mean)) if keep is None else np.asarray(keep)
    gram, xy = gram[np.ix_(idx, idx)] / n, xy[idx] / n
    beta = np.zeros(len(idx)) if start is None else start.copy()
    residual = xy - gram @ beta
    enough = tolerance * np.sqrt(max(moments.matrix[-1, -1] / n - y_mean**2, 0.0))
    scale = np.sqrt(np.maximum(np.diag(gram), 0.0))
    for _ in range(rounds):
        largest = 0.0
        for j in range(len(idx)):
            curvature = gram[j, j] + l2
            pull = residual[j] + gram[j, j] * beta[j]
            step = (np.sign(pull) * max(abs(pull) - l1, 0.0) / curvature if curvature > 0 else 0.0) - beta[j]
            if step:
                beta[j] += step
                residual -= gram[:, j] * step
                largest = max(largest, abs(step) * scale[j])
        if largest <= enough:
            break
    return beta, float(y_mean - beta @ x_mean[idx])


def elimination_order(moments: Moments, fewest: int = 1) -> list[str]:
    """Features in the order recursive elimination drops them, then the ``fewest`` that stay.

    Each step refits and drops the smallest coefficient. What is left does not depend on how many
    were wanted, so the last k names are the choice of k features, for every k from ``fewest`` on. The
    refits work on the cross products: the rows are read once whatever the number of steps.
    """
    left, dropped = list(range(len(moments.features))), []
    while len(left) > max(1, fewest):
        beta, _ = solve(moments, left)
        dropped.append(left.pop(int(np.argmin(beta**2))))
    return [moments.features[i] for i in [*dropped, *left]]


def eliminate_features(moments: Moments, keep: int | None = None) -> list[str]:
    """The ``keep`` features (default half) that recursive elimination leaves, in their given order."""
    n = len(moments.features)
    keep = max(1, n // 2 if keep is None else min(keep, n))
    chosen = set(elimination_order(moments, keep)[n - keep :])
    return [f for f in moments.features if f in chosen]


def linear_prediction(features: Sequence[str], beta: Sequence[float], intercept: float | Column) -> Column:
    start = intercept if isinstance(intercept, Column) else F.lit(float(intercept))
    terms = " + ".join(f"`{name}` * {float(b)!r}D" for name, b in zip(features, beta))
    return start + F.expr(terms) if terms else start


def within_transform(df: DataFrame, columns: Sequence[str], id_col: str = "id") -> DataFrame:
    """Subtract the entity mean of every column: the slopes of entity dummies without the dummies."""
    w = Window.partitionBy(id_col)
    return df.withColumns({c: F.col(c) - F.avg(c).over(w) for c in columns})


@dataclass(frozen=True)
class Absorbed:
    """A regression from which the levels of a factor were removed before any slope is estimated.

    ``sums`` (factor, n and a sum for each feature and the label, all about their means) has a row a
    level and stays in Spark; the driver holds one matrix of the size of the features.
    """

    factor: str
    means: np.ndarray
    rows: float
    matrix: np.ndarray
    sums: DataFrame

    def moments(self, features: Sequence[str]) -> Moments:
        """Cross products within levels, as if every column had its level's mean taken off."""
        within = self.matrix.copy()
        within[0, :] = within[:, 0] = 0.0
        within[0, 0] = self.rows
        return Moments(tuple(features), within)


def absorb(df: DataFrame, features: Sequence[str], factor: str = "id", label: str = "label", penalty: float = 0.0) -> Absorbed:
    """Cross products of (1, features, label) with the levels of ``factor`` partialled out.

    A level's coefficient is its summed residual over its rows plus ``penalty``, whatever the slopes are;
    putting that in leaves M - sum of s s' / (n + penalty) over the sums s of the levels. One aggregate by
    level (combined on the map side, so a level may hold any share of the rows) gives the sums, and
    tasks add up the outer products, so neither a column nor a number on the driver stands for a level.
    """
    columns = [*features, label]
    size = len(columns) + 1
    rows = df.select(F.col(factor), *columns).na.drop()
    # about the means, so that no digits are lost where a level's mean is large
    means = np.array(rows.agg(*[F.avg(c) for c in columns]).first(), dtype=float)
    shifted = rows.select(factor, *[(F.col(c) - F.lit(float(m))).alias(f"_c{i}") for i, (c, m) in enumerate(zip(columns, means))])
    names = [f"_c{i}" for i in range(len(columns))]
    sums = materialize(shifted.groupBy(factor).agg(F.count(F.lit(1)).cast("double").alias("_n"), *[F.sum(c).alias(c) for c in names]), "level-sums")

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for batch in batches:
            s = batch[["_n", *names]].to_numpy(dtype=float)
            s = s / np.sqrt(s[:, :1] + penalty)
            total += s.T @ s
        yield from _upper({0: total}, size)

    whole = cross_products(shifted, names[:-1], names[-1]).matrix
    levels = _added_up(sums.select("_n", *names).mapInPandas(outer, _SUMS), size).get(0, np.zeros((size, size)))
    return Absorbed(factor, means, float(whole[0, 0]), whole - levels, sums)


def absorbed_fit(absorbed: Absorbed, features: Sequence[str], keep: Sequence[str], penalty: float = 0.0) -> tuple[np.ndarray, float, DataFrame]:
    """Slopes of ``keep``, the level of a stranger, and a table (factor, effect) of the levels.

    With a penalty it falls on slopes and level coefficients alike, not on the intercept; without one
    the intercept is the mean of the levels.
    """
    idx = [list(features).index(f) for f in keep]
    on = np.array([0, *[1 + i for i in idx]])
    left = absorbed.matrix[np.ix_(on, on)] + penalty * np.diag([0.0, *[1.0] * len(idx)])
    if penalty > 0:
        solved = np.linalg.solve(left, absorbed.matrix[on, -1])
    else:
        solved = np.array([0.0, *(np.linalg.pinv(left[1:, 1:], hermitian=True) @ absorbed.matrix[on[1:], -1])])
    intercept, beta = float(solved[0]), solved[1:]
    # back from columns about their means
    level = intercept + float(absorbed.means[-1] - beta @ absorbed.means[idx])
    label = f"_c{len(features)}"
    residual = linear_prediction([f"_c{i}" for i in idx], [-b for b in beta], F.col(label)) - F.col("_n") * F.lit(intercept)
    effects = absorbed.sums.select(absorbed.factor, (F.lit(level) + residual / (F.col("_n") + F.lit(float(penalty)))).alias("effect"))
    if not penalty:
        level = effects.agg(F.avg("effect")).first()[0]
    return beta, level, effects


def fixed_effects(df: DataFrame, features: Sequence[str], label: str = "label", factor: str = "id") -> tuple[np.ndarray, DataFrame]:
    """Slopes of the entity-effects regression and a table (id, effect) of entity intercepts."""
    beta, _, effects = absorbed_fit(absorb(df, features, factor, label), features, features)
    return beta, effects
