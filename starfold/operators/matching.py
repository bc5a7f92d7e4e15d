"""Resolve titles to catalog ids and catalog ids to items.

Every join is on equal keys. The year tolerance is turned into keys (one per allowed
difference), and requests and candidates are reduced to one row per title and year
before they meet, so a title that thousands share never forms pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from starfold.functions.scalars import release_year, trailing_year
from starfold.session import new_folder

YEAR_TOLERANCE = 1
MATCHED, UNMATCHED = "matched", "unmatched"


# ------------------------------------------------------------- candidates given as rows


def candidate_pool(candidates: DataFrame, request: list[str]) -> DataFrame:
    """Distinct candidates per request, the first of each id.

    candidates: ``request…, src_rank, pos, id, …``. The pool keeps the rows of the
    lowest source, then position, and numbers them by that order in ``rank`` terms:
    the order columns stay, so any later pick can compare them.
    """
    others = [c for c in candidates.columns if c not in (*request, "id")]
    first = F.min_by(F.struct(*others), F.struct("src_rank", "pos")).alias("_first")
    return candidates.groupBy(*request, "id").agg(first).select(*request, "id", "_first.*")


def pick_nearest_year(pool: DataFrame, request: list[str], year: str = "year",
                      tolerance: int = YEAR_TOLERANCE) -> DataFrame:
    """Best candidate per request: nearest release year, then lowest rank.

    A request without a year takes its first candidate. A candidate whose date has no
    year never matches a request with one. Requests without a match have no row.
    """
    difference = F.abs(release_year(F.col("release_date")) - F.col(year))
    eligible = pool.withColumn(
        "_diff", F.when(F.col(year).isNull(), F.lit(0)).otherwise(difference)).where(
        F.col("_diff") <= tolerance)
    others = [c for c in pool.columns if c not in request]
    best = F.min_by(F.struct(*others), F.struct("_diff", "src_rank", "pos")).alias("_best")
    return eligible.groupBy(*request).agg(best).select(*request, "_best.*")


def pick_first_hit(pool: DataFrame, request: list[str]) -> DataFrame:
    """Older rule: first candidate of the year-scoped list, else of the bare list."""
    others = [c for c in pool.columns if c not in request]
    best = F.min_by(F.struct(*others), F.struct("src_rank", "pos")).alias("_best")
    return pool.groupBy(*request).agg(best).select(*request, "_best.*")


# ------------------------------------------------------------- candidates from a catalog


def title_key(title: Column) -> Column:
    return F.lower(F.trim(title))


def _catalog_firsts(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First candidate per title and year, and per title."""
    keyed = catalog.select(
        title_key(F.col("title")).alias("_key"), release_year(F.col("release_date")).alias("_cy"),
        F.struct(F.col("rnk"), F.col("id"), F.col("original_title"),
                 F.col("release_date")).alias("hit"))
    by_year = keyed.where(F.col("_cy").isNotNull()).groupBy("_key", "_cy").agg(
        F.min("hit").alias("hit"))
    by_title = keyed.groupBy("_key").agg(F.min("hit").alias("hit"))
    return by_year, by_title


def nearest_year_matches(requests: DataFrame, catalog: DataFrame,
                         tolerance: int = YEAR_TOLERANCE, rule: str = "nearest") -> DataFrame:
    """Catalog hit per distinct ``(title, year)`` request, requests without one left out.

    rule "nearest" takes the smallest year difference within the tolerance, then the
    catalog's own rank; "first_hit" takes the first result of that very year and falls
    back to the first result of any year.
    Returns ``title, year, id, original_title, release_date``.
    """
    distinct = requests.select("title", "year").distinct().withColumn(
        "_key", title_key(F.col("title")))
    by_year, by_title = _catalog_firsts(catalog)
    offsets = tolerance if rule == "nearest" else 0
    wanted = distinct.where(F.col("year").isNotNull()).withColumn(
        "_cy", F.explode(F.sequence(F.col("year") - offsets, F.col("year") + offsets)))
    dated = wanted.join(by_year, ["_key", "_cy"]).select(
        "title", "year", "hit", F.abs(F.col("_cy") - F.col("year")).alias("_diff"))
    bare = distinct if rule == "first_hit" else distinct.where(F.col("year").isNull())
    undated = bare.join(by_title, "_key").select(
        "title", "year", "hit", F.lit(offsets + 1).alias("_diff"))
    best = F.min_by("hit", F.struct("_diff", "hit.rnk", "hit.id")).alias("hit")
    found = dated.unionByName(undated).groupBy("title", "year").agg(best)
    return found.select("title", "year", "hit.id", "hit.original_title", "hit.release_date")


def resolve_export(export: DataFrame, catalog: DataFrame, tolerance: int = YEAR_TOLERANCE,
                   rule: str = "nearest") -> DataFrame:
    """Every export row with its catalog hit; ``tmdb_id`` is null where none was found.

    Adds ``tmdb_id, original_title, release_year`` to the columns of ``export``.
    """
    hits = nearest_year_matches(export, catalog, tolerance, rule).select(
        F.col("title").alias("_title"), F.col("year").alias("_year"),
        F.col("id").alias("tmdb_id"), "original_title",
        F.nullif(F.substring(F.coalesce("release_date", F.lit("")), 1, 4), F.lit("")).alias(
            "release_year"))
    same = (F.col("title") == F.col("_title")) & F.col("year").eqNullSafe(F.col("_year"))
    return export.join(hits, same, "left").drop("_title", "_year")


def resolved_rows(resolution: DataFrame) -> DataFrame:
    """Rows that found a catalog id, in the layout of the resolved export."""
    keep = [c for c in ("userId", "line_no") if c in resolution.columns]
    return resolution.where(F.col("tmdb_id").isNotNull()).select(
        *keep, F.col("title").alias("query_title"), F.col("year").alias("query_year"),
        "tmdb_id", "original_title", "release_year", "rating")


def unresolved_titles(resolution: DataFrame) -> DataFrame:
    keep = [c for c in ("userId", "line_no") if c in resolution.columns]
    return resolution.where(F.col("tmdb_id").isNull()).select(*keep, "title")


# ------------------------------------------------------------- catalog id to item


def match_items(resolved: DataFrame, links: DataFrame) -> DataFrame:
    """Inner join with the bridge; an id with several items gives several rows."""
    bridge = links.select(F.col("tmdbId").cast("long").alias("tmdb_id"), "movieId")
    return resolved.join(bridge, "tmdb_id")


def unmatched_rows(resolved: DataFrame, links: DataFrame) -> DataFrame:
    bridge = links.select(F.col("tmdbId").cast("long").alias("tmdb_id"))
    return resolved.join(bridge, "tmdb_id", "left_anti")


def classify_matches(resolved: DataFrame, links: DataFrame, user: list[str],
                     dedup_unmatched: bool = False) -> DataFrame:
    """Matched, unmatched and ambiguous rows in one table with a ``kind`` column.

    A catalog id that occurs more than once among a user's joined rows is ambiguous,
    whether the bridge or two titles of the user caused it; all its rows go to
    ``unmatched`` without an item, once per joined row unless ``dedup_unmatched``.
    """
    bridge = links.where(F.col("tmdbId").isNotNull()).select(
        F.col("tmdbId").cast("long").alias("tmdb_id"), "movieId")
    # Joined rows per (user, id) = bridge rows of the id x export rows of the pair, so
    # both factors are aggregated before the join and no group is held in one place.
    fan_out = bridge.groupBy("tmdb_id").agg(F.count(F.lit(1)).alias("_items"))
    repeats = resolved.groupBy(*user, "tmdb_id").agg(F.count(F.lit(1)).alias("_rows"))
    sizes = repeats.join(fan_out, "tmdb_id").where(
        F.col("_rows") * F.col("_items") > 1).select(*user, "tmdb_id", F.lit(True).alias("_many"))
    joined = resolved.join(bridge, "tmdb_id", "left").join(sizes, [*user, "tmdb_id"], "left")
    lost = F.col("_many").isNotNull() | F.col("movieId").isNull()
    routed = joined.select(
        *resolved.columns, F.when(~lost, F.col("movieId")).alias("movieId"),
        F.when(lost, UNMATCHED).otherwise(MATCHED).alias("kind"),
        F.col("_many").isNotNull().alias("ambiguous"))
    return routed.distinct() if dedup_unmatched else routed


def spread_nulls(key: str, *by: str) -> Column:
    """The key, or where it is null a negative number that no table holds and that differs between rows.

    For left joins on a key that is null in many rows: these find nothing, and need not meet in one task.
    """
    return F.coalesce(F.col(key), -1 - F.pmod(F.xxhash64(*by), F.lit(1 << 40)))


def lookup_items(resolved: DataFrame, one_item: DataFrame) -> DataFrame:
    """Left lookup in the last-wins bridge; ``movieId`` is null where there is none."""
    bridge = one_item.select(F.col("tmdbId").alias("_id"), "movieId")
    others = [c for c in resolved.columns if c != "tmdb_id"]
    return resolved.join(bridge, spread_nulls("tmdb_id", *others) == F.col("_id"), "left").drop("_id").select(
        "tmdb_id", *others, "movieId")


def match_outcome(resolution: DataFrame, one_item: DataFrame) -> DataFrame:
    """Export rows with ``outcome``: matched, no_item or not_in_catalog."""
    looked_up = lookup_items(resolution, one_item)
    outcome = (F.when(F.col("tmdb_id").isNull(), "not_in_catalog")
               .when(F.col("movieId").isNull(), "no_item").otherwise(MATCHED))
    return looked_up.withColumn("outcome", outcome)


def match_ratings(export: DataFrame, catalog: DataFrame, one_item: DataFrame) -> DataFrame:
    """Export rows to items in one step (resolve, then look up), with the outcome."""
    return match_outcome(resolve_export(export, catalog), one_item)


# ------------------------------------------------------------- title search


def _grams(text: Column, length: int) -> Column:
    """Distinct substrings of one length (none when the text is shorter)."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (length - 1), F.lit(1)))
    cut = F.transform(starts, lambda s: F.substr(text, s, F.lit(length)))
    return F.array_distinct(F.filter(cut, lambda g: F.length(g) == length))


def title_search(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Items whose title contains the query, ignoring case, and ends in its year.

    queries: ``title, year``. Returns ``title, year, movieId, item_title, genres``,
    one row per distinct query and hit.

    Both sides are keyed by year and a substring of the query; a query uses the one
    that the fewest items have, so it meets those few items only and is then checked.
    The index holds year, substring and item of the substrings that some query has, and
    is written once; titles are joined back for the few candidates.
    """
    named = items.select("movieId", F.col("title").alias("item_title"), "genres",
                         trailing_year(F.col("title")).alias("year")).where(F.col("year").isNotNull())
    wanted = queries.select("title", F.col("year").cast("int").alias("year")).where(
        F.col("title").isNotNull() & F.col("year").isNotNull()).distinct().withColumn(
        "_query", F.lower("title"))
    own = (F.when(F.length("_query") >= 3, _grams(F.col("_query"), 3))
           .otherwise(F.array("_query")))
    keyed = wanted.withColumn("_gram", F.explode(own))
    text = F.lower("item_title")
    pieces = F.concat(F.array(F.lit("")), *[_grams(text, n) for n in (1, 2, 3)])
    path = new_folder(items.sparkSession, "title-index")
    (named.select("year", F.explode(pieces).alias("_gram"), "movieId")
     .join(keyed.select("year", "_gram").distinct(), ["year", "_gram"], "left_semi").write.parquet(path))
    index = items.sparkSession.read.parquet(path)
    frequency = index.groupBy("year", "_gram").agg(F.count(F.lit(1)).alias("_df"))
    # A query piece that no item has sorts first and leads to no item, as it must.
    rarest = keyed.join(frequency, ["year", "_gram"], "left").groupBy("title", "year", "_query").agg(
        F.min_by("_gram", F.struct(F.coalesce("_df", F.lit(0)), F.col("_gram"))).alias("_gram"))
    near = rarest.join(index, ["year", "_gram"]).select("title", "year", "_query", "movieId")
    hits = near.join(named.select("movieId", "item_title", "genres"), "movieId").where(F.contains(text, "_query"))
    return hits.select("title", "year", "movieId", "item_title", "genres")


def shown_candidates(hits: DataFrame, shown: int = 20) -> DataFrame:
    """The first hits of every query by item id, as listed to a user who must choose."""
    order = Window.partitionBy("title", "year").orderBy("movieId")
    return hits.withColumn("_pos", F.row_number().over(order)).where(
        F.col("_pos") <= shown).drop("_pos")


def search_status(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Per distinct query the number of hits, and the hit if it is the only one."""
    hits = title_search(queries, items)
    counted = hits.groupBy("title", "year").agg(
        F.count(F.lit(1)).alias("n_hits"), F.min("movieId").alias("movieId"))
    status = (F.when(F.col("n_hits").isNull(), "not_found")
              .when(F.col("n_hits") > 1, "ambiguous").otherwise("found"))
    return queries.select("title", F.col("year").cast("int").alias("year")).distinct().join(
        counted, ["title", "year"], "left").select(
        "title", "year", F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
        F.when(F.col("n_hits") == 1, F.col("movieId")).alias("movieId"), status.alias("status"))


def first_hit(queries: DataFrame, items: DataFrame) -> DataFrame:
    """First item (lowest id) each query finds."""
    return title_search(queries, items).groupBy("title", "year").agg(
        F.min("movieId").alias("movieId"))


# ------------------------------------------------------------- bridge reports


def match_report(classified: DataFrame) -> DataFrame:
    """Counts and rate of matched, unmatched and ambiguous rows."""
    def rows(condition):
        return F.sum(F.when(condition, 1).otherwise(0)).cast("long")

    return classified.agg(
        F.count(F.lit(1)).alias("n_rows"),
        rows(F.col("kind") == MATCHED).alias("n_matched"),
        rows(F.col("kind") == UNMATCHED).alias("n_unmatched"),
        rows(F.col("ambiguous")).alias("n_ambiguous"),
        F.countDistinct(F.when(F.col("ambiguous"), F.col("tmdb_id"))).alias("n_ambiguous_ids"),
        F.try_divide(rows(F.col("kind") == MATCHED), F.count(F.lit(1))).alias("match_rate"))


def warm_set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Items that only one of two models knows, with the ``side`` that has them."""
    a, b = left.select("movieId"), right.select("movieId")
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("right")))


def search_title(catalog: DataFrame, title: str, year: int | None = None):
    """Best catalog hit of one title, or ``None``."""
    one = catalog.sparkSession.createDataFrame([(title, year)], "title string, year int")
    return nearest_year_matches(one, catalog).first()
