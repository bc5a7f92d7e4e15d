"""Row filters on ratings and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from starfold.functions.scalars import (
    comma_tokens,
    has_all_tokens,
    has_token,
    matches_any,
    seeded_unit,
)

MIN_RATINGS = 20


def supported_items(ratings: DataFrame, minimum: int = MIN_RATINGS) -> DataFrame:
    return ratings.groupBy("movieId").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= minimum).select("movieId")


def min_support(ratings: DataFrame, minimum: int = MIN_RATINGS) -> DataFrame:
    """Ratings of items that have at least ``minimum`` ratings."""
    return ratings.join(supported_items(ratings, minimum), "movieId", "left_semi")


def first_users(ratings: DataFrame, n: int = 1000) -> DataFrame:
    """All ratings of the first n users by id (a dry run's sample)."""
    chosen = ratings.select("userId").distinct().orderBy("userId").limit(n)
    return ratings.join(chosen, "userId", "left_semi")


def _least(rows: DataFrame, rank: Column, order: list[str], n: int) -> DataFrame:
    """The n rows with the least ``rank``, a number spread evenly over [0, 1), then ``order``.

    Rows below a threshold that leaves a little more than n are kept first, so that no task
    sorts more than these; where chance leaves fewer, the threshold is doubled.
    """
    total = rows.count()
    ranked = rows.withColumn("_rank", rank)
    share = 1.1 * n / max(total, 1) + 50 / max(total, 1)
    while share < 1 and ranked.where(F.col("_rank") < share).count() < min(n, total):
        share *= 2
    return ranked.where(F.col("_rank") < share).orderBy("_rank", *order).limit(n).drop("_rank")


def sample_users(ratings: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """All ratings of n users chosen by a seeded hash of their id."""
    users = ratings.select("userId").distinct()
    chosen = _least(users, seeded_unit(seed, F.col("userId")), ["userId"], n)
    return ratings.join(chosen, "userId", "left_semi")


def sample_ratings(ratings: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """At most n ratings chosen by a seeded hash of user and item."""
    return _least(ratings, seeded_unit(seed, F.col("userId"), F.col("movieId")), ["userId", "movieId"], n)


def in_all_genres(items: DataFrame, genres: str | None) -> DataFrame:
    """Items whose genres hold every comma-separated token as a substring."""
    if not genres:
        return items
    return items.where(has_all_tokens(F.col("genres"), comma_tokens(F.lit(genres))))


def in_genre(items: DataFrame, genre: str | None) -> DataFrame:
    """Items whose genres hold one substring; unknown genres count as the placeholder."""
    return items if genre is None else items.where(has_token(F.col("genres"), genre))


def exclude_rated(candidates: DataFrame, rated: DataFrame) -> DataFrame:
    return candidates.join(rated, ["userId", "movieId"], "left_anti")


def rated_often(items: DataFrame, ratings: DataFrame, minimum: int) -> DataFrame:
    """Items with at least ``minimum`` ratings, unrated ones counting 0."""
    if minimum <= 0:
        return items
    counts = ratings.groupBy("movieId").agg(F.count(F.lit(1)).alias("_n"))
    return items.join(counts, "movieId", "left").where(
        F.coalesce("_n", F.lit(0)) >= minimum).drop("_n")


def warm_only(ratings: DataFrame, factors: DataFrame) -> DataFrame:
    """Ratings of items the model has a vector for."""
    return ratings.join(factors.select("movieId"), "movieId", "left_semi")


def pending(ids: DataFrame, done: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Ids not yet processed; the limit counts after that."""
    rest = ids.join(done.select(key), key, "left_anti")
    return rest if limit is None else rest.orderBy(key).limit(limit)


def mark_trained(items: DataFrame, factors: DataFrame) -> DataFrame:
    """Flag ``in_trainset``: the model has a vector for the item."""
    known = factors.select("movieId", F.lit(True).alias("_known"))
    return items.join(known, "movieId", "left").withColumn(
        "in_trainset", F.col("_known").isNotNull()).drop("_known")


def titles_matching(items: DataFrame, terms: list[str]) -> DataFrame:
    return items.where(matches_any(F.col("title"), terms))


def inject_user(ratings: DataFrame, personal: DataFrame, valid: DataFrame,
                user_id: int = 0) -> DataFrame:
    """Ratings with a person's own ones added under ``user_id``, on valid items only."""
    own = personal.join(valid.select("movieId"), "movieId", "left_semi")
    columns = ["userId", "movieId", "rating"]
    return ratings.select(columns).unionByName(
        own.withColumn("userId", F.lit(user_id).cast("long")).select(columns))
