"""Whole recommendation queries: top-n, two-tier, single requests, demo profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from starfold.functions.scalars import NO_GENRES, UNKNOWN_TITLE, clamp
from starfold.functions.vectors import unit, weighted_sum, zeros
from starfold.operators import features as feat
from starfold.operators.filters import in_all_genres, in_genre, rated_often, warm_only
from starfold.operators.foldin import DEFAULT_ALPHA, _as_column, fold_in
from starfold.operators.matching import first_hit, nearest_year_matches, search_status, spread_nulls
from starfold.operators.scoring import predict, top_items
from starfold.session import new_folder

TIER_MINIMUM = 10


def _base(users: DataFrame, mean: Column) -> DataFrame:
    """User vectors with the constant part of their scores."""
    return users.where(F.col("status") == "ok").select(
        "userId", "vec", (mean + F.col("bias")).alias("base"))


def recommend(ratings: DataFrame, factors: DataFrame, items: DataFrame, mean: float | Column,
              n: int = 5, alpha: float = DEFAULT_ALPHA, genres: str | None = None,
              min_ratings: int = 0, all_ratings: DataFrame | None = None,
              min_support_sim: float = 0.0) -> DataFrame:
    """Fold every user of ``ratings`` in and return the n best unrated items of each.

    Candidates are items with a vector and a title; all item filters run before any
    score is computed. all_ratings: the table ``min_ratings`` counts (default: ratings).
    """
    mean = _as_column(mean)
    users = _base(fold_in(ratings, factors, mean, [alpha]), mean)
    counted = all_ratings if all_ratings is not None else ratings
    wanted = rated_often(in_all_genres(items, genres), counted, min_ratings)
    candidates = factors.join(wanted.select("movieId"), "movieId", "left_semi")
    best = top_items(users, candidates, ratings, n, min_support=min_support_sim,
                     profile_items=factors)
    return with_metadata(best, items)


def with_metadata(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Add title and genres, with placeholders for unknown items."""
    named = rows.join(items.select("movieId", "title", "genres"), "movieId", "left")
    return named.withColumn("title", F.coalesce("title", F.lit(UNKNOWN_TITLE))).withColumn(
        "genres", F.coalesce("genres", F.lit(NO_GENRES)))


def popularity(factors: DataFrame, mean: float | Column) -> DataFrame:
    """Score of every item for an average user."""
    return factors.select("movieId", (_as_column(mean) + F.col("bias")).alias("score"))


def preference_vectors(ratings: DataFrame, factors: DataFrame, mean: float | Column,
                       size: int) -> DataFrame:
    """Sum of the rated items' directions weighted by the rating's deviation."""
    directions = factors.select("movieId", unit(F.col("vec"), size).alias("_d"))
    rows = ratings.join(directions, "movieId")
    return rows.groupBy("userId").agg(weighted_sum(
        F.col("_d"), F.col("rating") - _as_column(mean), size).alias("vec"))


def recommend_tiered(matched: DataFrame, factors: DataFrame, items: DataFrame,
                     mean: float | Column, size: int, n: int = 25,
                     genre: str | None = None, users: DataFrame | None = None) -> DataFrame:
    """Item-based filtering for users with ten matched ratings, popularity below that.

    users: all users to serve, also those without a matched rating.
    """
    mean = _as_column(mean)
    counts = matched.groupBy("userId").agg(F.count(F.lit(1)).alias("n_matched"))
    if users is not None:
        counts = users.select("userId").distinct().join(counts, "userId", "left")
    enough = F.coalesce("n_matched", F.lit(0)) >= TIER_MINIMUM
    directions = factors.select("movieId", unit(F.col("vec"), size).alias("vec"), "bias")
    if genre is not None:
        known = items.select("movieId", "genres")
        labelled = directions.join(known, "movieId", "left")
        directions = in_genre(labelled, genre).drop("genres")
    preferences = preference_vectors(matched, factors, mean, size)
    profile = counts.where(enough).join(preferences, "userId", "left").select(
        "userId", F.coalesce("vec", zeros(size)).alias("vec"), F.lit(0.0).alias("base"), F.lit(0.0).alias("bias_weight"))
    warm = top_items(profile, directions, matched, n, bounds=None).select(
        "userId", "movieId", "score", "rank", F.lit("item_cf").alias("tier"))
    best = warm.unionByName(_most_popular(counts.where(~enough), directions, matched, mean, n))
    return with_metadata(best, items).select(
        "userId", "movieId", "title", "genres", "tier",
        F.col("score").alias("predicted_score"), "rank")


def _most_popular(users: DataFrame, items: DataFrame, matched: DataFrame, mean: Column, n: int) -> DataFrame:
    """The n most popular items each user has not rated.

    All these users rated fewer than ``TIER_MINIMUM`` items, so one short list serves them all. Scores that differ only by the
    order in which a bias was summed are the same.
    """
    score = (mean + F.col("bias")).cast("double")
    place = F.round("score", 9).desc()
    enough = items.select("movieId", score.alias("score")).orderBy(place, "movieId").limit(n + TIER_MINIMUM - 1)
    shown = enough.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("below"), "movieId"))).alias("list")).first()
    offers = F.array(*[F.struct(F.lit(r["movieId"]).alias("movieId"), F.lit(-r["below"]).alias("score")) for r in shown["list"]])
    if not shown["list"]:
        offers = offers.cast("array<struct<movieId:bigint,score:double>>")
    rows = users.select("userId", F.explode(offers).alias("o")).select("userId", F.col("o.movieId").cast("long").alias("movieId"), "o.score")
    rows = rows.join(matched.select("userId", "movieId"), ["userId", "movieId"], "left_anti")
    order = Window.partitionBy("userId").orderBy(place, "movieId")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)
    return ranked.select("userId", "movieId", "score", "rank", F.lit("popularity").alias("tier"))


def predict_requests(requests: DataFrame, ratings: DataFrame, items: DataFrame,
                     factors: DataFrame, content: DataFrame, mean: float | Column,
                     size: int, alpha: float = DEFAULT_ALPHA, catalog: DataFrame | None = None,
                     catalog_content: DataFrame | None = None) -> DataFrame:
    """Answer requests ``request_id, userId, title, year, movieId`` with a rating each.

    A request names an item id or a title and year. ``status`` is warm or cold for an
    answered request, else ambiguous, not_found, unscorable or too_few (ratings of the
    user). ``own_rating`` is set where the user had already rated the item.

    With a catalog, a title that is no item is looked up there and scored from
    ``catalog_content`` (``tmdb_id, vec, bias``); ``tmdb_id`` is set on such answers.
    """
    mean = _as_column(mean)
    requests = requests.select("request_id", "userId", "title",
                               F.col("year").cast("int").alias("year"), "movieId")
    by_title = requests.where(F.col("movieId").isNull()).drop("movieId")
    found = search_status(by_title, items).select(
        "title", "year", "movieId", F.col("status").alias("_search"))
    titled = by_title.join(found, ["title", "year"], "left")
    known = items.select("movieId", F.lit("found").alias("_search"))
    by_id = requests.where(F.col("movieId").isNotNull()).join(known, "movieId", "left")
    located = titled.unionByName(by_id).withColumn(
        "_search", F.coalesce("_search", F.lit("not_found")))
    path = new_folder(requests.sparkSession, "located")
    located.write.parquet(path)
    located = requests.sparkSession.read.parquet(path)
    if catalog is None:
        located = located.withColumn("tmdb_id", F.lit(None).cast("long"))
        fresh = located.limit(0).select("tmdb_id", F.lit(None).cast("array<double>").alias("_f"),
                                        F.lit(None).cast("double").alias("_fb"))
    else:
        lost = (F.col("_search") == "not_found") & F.col("title").isNotNull()
        hits = nearest_year_matches(located.where(lost), catalog).select(
            F.col("title").alias("_title"), F.col("year").alias("_year"),
            F.col("id").alias("tmdb_id"))
        same = (F.col("title") == F.col("_title")) & F.col("year").eqNullSafe(F.col("_year"))
        located = located.join(hits, lost & same, "left").drop("_title", "_year")
        fresh = catalog_content.select("tmdb_id", F.col("vec").alias("_f"),
                                       F.col("bias").alias("_fb"))
    vectors = feat.item_representations(items, factors, content).select(
        "movieId", F.col("vec").alias("_i"), F.col("bias").alias("_ib"),
        F.col("status").alias("_item_status"))
    users = fold_in(ratings, factors, mean, [alpha]).select(
        "userId", F.col("vec").alias("_u"), F.col("bias").alias("_ub"))
    own = ratings.select("userId", "movieId", F.col("rating").alias("own_rating"))
    # Requests without an item or a catalog id are many; they find nothing and must not meet.
    placed = (located.drop("title", "year").withColumn("_item", spread_nulls("movieId", "request_id"))
              .withColumn("_entry", spread_nulls("tmdb_id", "request_id"))
              .join(vectors.withColumnRenamed("movieId", "_item"), "_item", "left")
              .join(fresh.withColumnRenamed("tmdb_id", "_entry"), "_entry", "left"))
    # What was shuffled up to here goes before the requests are shuffled to their users.
    path = new_folder(requests.sparkSession, "placed")
    placed.write.option("compression", "zstd").parquet(path)
    joined = (requests.sparkSession.read.parquet(path)
              .join(users, "userId", "left").join(own.withColumnRenamed("movieId", "_item"), ["userId", "_item"], "left"))
    raw = predict(F.col("_u"), F.col("_ub"), F.coalesce("_i", "_f"), F.coalesce("_ib", "_fb"),
                  mean, size)
    missing = F.col("tmdb_id").isNull() & (F.col("_search") != "found")
    scorable = F.col("_i").isNotNull() | F.col("_f").isNotNull()
    status = (F.when(missing, F.col("_search")).when(~scorable, "unscorable")
              .when(F.col("_u").isNull(), "too_few")
              .otherwise(F.coalesce("_item_status", F.lit("cold"))))
    answered = F.col("status").isin("warm", "cold")
    return joined.withColumn("status", status).select(
        "request_id", "userId", "movieId", "tmdb_id", "status", "own_rating",
        F.when(answered, raw).alias("raw"), F.when(answered, clamp(raw)).alias("predicted"))


def recommend_for_titles(profile: DataFrame, factors: DataFrame, items: DataFrame,
                         mean: float | Column, n: int = 15,
                         alpha: float = DEFAULT_ALPHA) -> DataFrame:
    """Top-n for profiles given as ``userId, title, year, rating``.

    Every title counts as its first hit; titles without one are left out.
    """
    hits = first_hit(profile, items)
    matched = profile.withColumn("year", F.col("year").cast("int")).join(
        hits, ["title", "year"]).select("userId", "movieId", "rating")
    return recommend(matched, factors, items, mean, n, alpha)


def residual_report(ratings: DataFrame, factors: DataFrame, mean: float | Column, size: int,
                    alphas: Sequence[float]) -> DataFrame:
    """Predicted against given ratings of every profile, per solver.

    Solvers are ridge at each penalty and plain least squares.
    """
    mean = _as_column(mean)
    ridge = fold_in(ratings, factors, mean, alphas).withColumn(
        "solver", F.concat(F.lit("ridge_"), F.col("alpha").cast("string")))
    plain = fold_in(ratings, factors, mean, solver="least_squares").withColumn(
        "solver", F.lit("least_squares"))
    users = ridge.unionByName(plain).where(F.col("status") == "ok").select(
        "userId", "solver", "alpha", "vec", "bias")
    known = warm_only(ratings, factors).join(
        factors.select("movieId", F.col("vec").alias("_i"), F.col("bias").alias("_ib")), "movieId")
    joined = known.join(users, "userId")
    raw = predict(F.col("vec"), F.col("bias"), F.col("_i"), F.col("_ib"), mean, size)
    return joined.select("userId", "movieId", "solver", "alpha", "rating",
                         raw.alias("predicted")).withColumn(
        "error", F.col("predicted") - F.col("rating"))
