"""Aggregates over ratings, predictions and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from starfold.functions.vectors import norm


def item_counts(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("movieId").agg(F.count(F.lit(1)).alias("n"))


def global_mean(ratings: DataFrame) -> DataFrame:
    return ratings.agg(F.avg("rating").alias("global_mean"))


def item_stats(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("movieId").agg(
        F.round(F.avg("rating"), 3).alias("mean_rating"),
        F.count(F.lit(1)).alias("num_ratings"))


def damped_bias(ratings: DataFrame, mean: Column, damping: float = 10.0) -> DataFrame:
    """Item bias: summed deviation from the mean over count plus damping."""
    return ratings.groupBy("movieId").agg(
        (F.sum(F.col("rating") - mean) / (F.count(F.lit(1)) + F.lit(damping))).alias("bias"))


def with_item_stats(scores: DataFrame, ratings: DataFrame) -> DataFrame:
    return scores.join(item_stats(ratings), "movieId", "left")


def prediction_metrics(predictions: DataFrame, by: list[str], predicted: str = "predicted",
                       actual: str = "rating") -> DataFrame:
    """RMSE, MAE and row count of predictions per group, in one pass."""
    error = F.col(predicted) - F.col(actual)
    return predictions.groupBy(*by).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        F.count(F.lit(1)).alias("n_test"))


def rating_summary(ratings: DataFrame) -> DataFrame:
    """Row, user and item counts."""
    return ratings.agg(
        F.count(F.lit(1)).alias("n_ratings"), F.countDistinct("userId").alias("n_users"),
        F.countDistinct("movieId").alias("n_items"))


def spread_per_alpha(predictions: DataFrame) -> DataFrame:
    """Population standard deviation of the predictions per penalty."""
    return predictions.groupBy("alpha").agg(F.stddev_pop("predicted").alias("pred_spread"))


def norm_report(users: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """Length of each user vector beside the average length of the item vectors."""
    average = items.agg(F.avg(norm(F.col("vec"), size))).scalar()
    return users.select("userId", norm(F.col("vec"), size).alias("user_norm"),
                        average.alias("avg_item_norm"))


def convergence_point(curve: DataFrame, step: str = "n_epochs", value: str = "rmse",
                      improvement: float = 0.001, by: list[str] | None = None) -> DataFrame:
    """First step of a learning curve that improves by less than ``improvement``."""
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(step)
    gains = curve.withColumn("_gain", F.lag(value).over(window) - F.col(value))
    slow = gains.where(F.col("_gain") < improvement)
    return slow.groupBy(*(by or [])).agg(F.min(step).alias("converged_at"))
