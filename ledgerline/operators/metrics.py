"""Reports on a long prediction table (target, horizon, model, split, id, date, label, prediction)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S

RUN_KEYS = ("target", "horizon", "model")


def regression_metrics(predictions: DataFrame, keys: Sequence[str] = (*RUN_KEYS, "split")) -> DataFrame:
    """Rows, MAE, MSE, RMSE, R2 and MAPE (percent, over non-zero labels) per run and split."""
    error = F.col("label") - F.col("prediction")
    known = predictions.filter(F.col("label").isNotNull() & F.col("prediction").isNotNull())
    sums = known.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.var_pop("label").alias("_var"),
        (F.avg(F.abs(S.ratio(error, "label"))) * 100).alias("mape"),
    )
    perfect = F.when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    r2 = F.when(F.col("_var") == 0, perfect).otherwise(1 - S.ratio("mse", "_var"))
    return sums.select(*keys, "n", "mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"), "mape")


def voting_ensemble(predictions: DataFrame, members: Sequence[str], name: str = "VotingEnsemble") -> DataFrame:
    """Unweighted mean of the member predictions (one a model and row); rows with fewer than two have none."""
    keys = ["target", "horizon", "split", "id", "date"]
    mean = (
        predictions.filter(F.col("model").isin(list(members)))
        .groupBy(*keys)
        .agg(F.max("label").alias("label"), F.avg("prediction").alias("prediction"), F.count(F.lit(1)).alias("_m"))
    )
    return mean.filter(F.col("_m") >= 2).drop("_m").withColumn("model", F.lit(name))


def split_characteristics(rows: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Entities, dates and rows of the train and test split side by side, and all entities.

    Rows are first counted by entity and by date, combined on the map side; what is distinct is then
    counted by being there, so no row is repeated for the sake of another distinct count.
    """
    splits = ("train", "test")
    in_split = [F.count(F.when(F.col("split") == s, F.lit(1))).alias(f"_{s}") for s in splits]

    def present(column: str, name: str) -> list[Column]:
        return [F.count(F.when(F.col(f"_{s}") > 0, F.col(column))).alias(f"{s}_{name}") for s in splits]

    by_id = rows.groupBy(*keys, "id").agg(*in_split).groupBy(*keys).agg(
        *present("id", "entities"), *[F.sum(f"_{s}").alias(f"{s}_rows") for s in splits], F.count("id").alias("total_entities")
    )
    by_date = rows.filter(F.col("date").isNotNull()).groupBy(*keys, "date").agg(*in_split).groupBy(*keys).agg(*present("date", "dates"))
    columns = [f"{s}_{c}" for s in splits for c in ("entities", "dates", "rows")]
    return by_id.join(by_date, list(keys), "left").na.fill(0, [f"{s}_dates" for s in splits]).select(*keys, *columns, "total_entities")


def run_coverage(rows: DataFrame, keys: Sequence[str] = (*RUN_KEYS, "split"), value: str = "label") -> DataFrame:
    """Missing labels, entities, first and last date and mean dates per entity."""
    per_id = rows.groupBy(*keys, "id").agg(
        F.count_distinct("date").alias("_dates"),
        F.sum(F.col(value).isNull().cast("int")).alias("_missing"),
        F.min("date").alias("_first"),
        F.max("date").alias("_last"),
    )
    return per_id.groupBy(*keys).agg(
        F.sum("_missing").alias("missing"),
        F.count("*").alias("entities"),
        F.min("_first").alias("first_date"),
        F.max("_last").alias("last_date"),
        F.avg("_dates").alias("avg_dates_per_entity"),
    )


def model_comparison(predictions: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """One row per run with its test metrics, entity counts and, if given, registry columns; best first."""
    test = regression_metrics(predictions.filter(F.col("split") == "test"), RUN_KEYS)
    out = test.join(split_characteristics(predictions), list(RUN_KEYS))
    if registry is not None:
        out = out.join(registry, list(RUN_KEYS), "left")
    named = out.withColumns(
        {
            "run_type": F.when(F.col("model").endswith("_RFE"), "RFE").otherwise("Standard"),
            "base_model": F.replace("model", F.lit("_RFE"), F.lit("")),
        }
    )
    return named.orderBy("run_type", "target", "horizon", "rmse", "model")
