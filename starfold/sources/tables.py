"""Readers of the input tables, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from starfold import schemas


def ratings(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Ratings without the unused timestamp, so that the scan never reads it."""
    return _read(spark, path, fmt, schemas.RATINGS).select("userId", "movieId", "rating")


def items(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Item titles and genres; titles may hold commas and doubled quotes."""
    return _read(spark, path, fmt, schemas.ITEMS)


def links(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Bridge to the external catalog; ``tmdbId`` is nullable, ``line_no`` orders rows as in the files."""
    return with_line_order(_read(spark, path, fmt, schemas.LINKS)).withColumn("tmdbId", F.col("tmdbId").cast("long"))


def exports(spark: SparkSession, path: str) -> DataFrame:
    """Personal export as it was downloaded, with the order of its lines."""
    return export_rows(with_line_order(_read(spark, path, "csv", schemas.EXPORT)))


def with_line_order(df: DataFrame) -> DataFrame:
    """``line_no`` to compare rows by: file, place of the block in the file, place of the row in the block.

    A block is read by one task from its start to its end, so the last part ascends within it.
    """
    return df.withColumn("line_no", F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row")))


def _read(spark: SparkSession, path: str, fmt: str, schema) -> DataFrame:
    if fmt == "csv":
        return spark.read.schema(schema).option("header", True).option("quote", '"').option(
            "escape", '"').csv(path)
    return spark.read.schema(schema).format(fmt).load(path)


def catalog_to_item(links: DataFrame, order: str | None = None) -> DataFrame:
    """One item per catalog id: rows without an id dropped, the last row wins.

    The last row has the highest ``line_no``, or without such a column the highest item id.
    """
    order = order or ("line_no" if "line_no" in links.columns else "movieId")
    known = links.where(F.col("tmdbId").isNotNull())
    return known.groupBy(F.col("tmdbId").cast("long").alias("tmdbId")).agg(
        F.max_by("movieId", order).alias("movieId"))


def item_to_catalog(links: DataFrame, order: str | None = None) -> DataFrame:
    """Inverse of :func:`catalog_to_item`; items that lost their id have no row."""
    return catalog_to_item(links, order).select("movieId", "tmdbId")


def export_rows(raw: DataFrame) -> DataFrame:
    """Personal export without link and date; the year becomes a nullable integer."""
    keep = [c for c in ("userId", "user", "line_no") if c in raw.columns]
    return raw.select(*keep, F.col("Name").alias("title"), F.col("Year").cast("int").alias("year"),
                      F.col("Rating").cast("double").alias("rating"))


def profile(ratings: DataFrame, order: str = "line_no", dedup: bool = True) -> DataFrame:
    """A user's ratings with one row per item, the last one; or all rows as read."""
    if not dedup:
        return ratings.select("userId", "movieId", "rating")
    return ratings.groupBy("userId", "movieId").agg(F.max_by("rating", order).alias("rating"))


def record_store(spark: SparkSession, path: str) -> DataFrame:
    """Content records kept as JSON lines, in any depth of folders; lines that hold no record are skipped."""
    return spark.read.schema(schemas.RECORD).option("recursiveFileLookup", True).json(path).where(F.col("tmdb_id").isNotNull())


def latest_records(records: DataFrame, key: str, order: str) -> DataFrame:
    """Last record of every key, compared by ``order``."""
    others = [c for c in records.columns if c not in (key,)]
    last = records.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_last"))
    return last.select(key, "_last.*")


def latest_snapshot(exports: DataFrame, user: str | None = None, snapshot: str | None = None,
                    user_column: str = "user", date_column: str = "snapshot_date") -> DataFrame:
    """Rows of each user's newest snapshot.

    ``user`` restricts to one user (partition pruning), ``snapshot`` picks an exact
    snapshot instead of the newest; an unknown user or snapshot is an error.
    """
    chosen = exports
    if user is not None:
        chosen = chosen.where(F.col(user_column) == user)
    if snapshot is not None:
        chosen = chosen.where(F.col(date_column).cast("string") == snapshot)
    else:
        newest = chosen.groupBy(user_column).agg(F.max(date_column).alias(date_column))
        chosen = chosen.join(newest, [user_column, date_column], "left_semi")
    if user is not None and chosen.isEmpty():
        raise ValueError(f"no export of user {user!r}")
    return chosen


def parse_records(responses: DataFrame) -> DataFrame:
    """Nested JSON answers ``tmdb_id, detail, keywords, credits`` as flat records.

    Rows without a detail answer are dropped. Of the cast the first five entries
    count, and of those the ones with an id and an order.
    """
    parsed = responses.where(F.col("detail").isNotNull()).select(
        "tmdb_id",
        F.from_json("detail", schemas.DETAIL_RESPONSE).alias("d"),
        F.from_json("keywords", schemas.KEYWORDS_RESPONSE).alias("k"),
        F.from_json("credits", schemas.CREDITS_RESPONSE).alias("c"))

    def present(array, field):
        values = F.transform(F.coalesce(array, F.array()), lambda x: x[field])
        return F.filter(values, lambda v: v.isNotNull())

    directors = F.filter("c.crew", lambda x: x["job"] == "Director")
    billed = F.filter(F.slice("c.cast", 1, 5),
                      lambda x: x["id"].isNotNull() & x["order"].isNotNull())
    return parsed.select(
        "tmdb_id",
        present(F.col("d.genres"), "id").alias("genre_ids"),
        F.coalesce("d.runtime", F.lit(0.0)).alias("runtime"),
        F.coalesce("d.release_date", F.lit("")).alias("release_date"),
        F.coalesce("d.original_language", F.lit("")).alias("original_language"),
        F.coalesce("d.vote_average", F.lit(0.0)).alias("vote_average"),
        F.coalesce("d.vote_count", F.lit(0)).cast("long").alias("vote_count"),
        F.coalesce("d.budget", F.lit(0.0)).alias("budget"),
        F.coalesce("d.revenue", F.lit(0.0)).alias("revenue"),
        present(F.col("k.keywords"), "id").alias("keyword_ids"),
        present(F.col("k.keywords"), "name").alias("keyword_names"),
        present(directors, "id").alias("director_ids"),
        F.coalesce(billed, F.array().cast("array<struct<id:long,order:int>>")).alias("cast"))
