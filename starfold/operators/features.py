"""Content features of items in long form ``movieId, feature_id, value``.

``fit`` learns the vocabulary and the numeric statistics from a corpus of records,
``transform`` encodes any records with them; the corpus itself and items that arrive
later go through the same ``transform``. Absent values are zeros and have no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from starfold.functions.scalars import (
    bayesian_average,
    billing_weight,
    positive_or,
    release_year_or_zero,
    smooth_idf,
    sublinear_tf,
    usable_std,
    word_tokens,
    z_score,
)
from starfold.operators.indexing import dense_index
from starfold.operators.tiles import Tiles, tiled, times
from starfold.session import new_folder

# The catalog's genre ids in column order, and their names.
GENRE_IDS = [28, 12, 16, 35, 80, 99, 18, 10751, 14, 36, 27, 10402, 9648, 10749, 878, 10770,
             53, 10752, 37]
GENRE_NAMES = ["Action", "Adventure", "Animation", "Comedy", "Crime", "Documentary", "Drama",
               "Family", "Fantasy", "History", "Horror", "Music", "Mystery", "Romance",
               "Sci-Fi", "TV Movie", "Thriller", "War", "Western"]
NUMERIC = ["vote_average_bayesian", "vote_count_log", "runtime", "budget_log", "revenue_log",
           "release_year", "is_english"]
# End of fixed values.

PRIOR_VOTES = 100.0
MAX_TERMS = 2000
MIN_DIRECTOR_FILMS = 3
MIN_CAST_FILMS = 5
#: Texts whose terms are counted in one task; what the counts take in memory is about 30 times as much.
TEXT_BYTES = 8 << 20


def genre_dictionary(df: DataFrame) -> DataFrame:
    """The genre columns as a table: ``feature_id, block, key, name, idf``."""
    session = df.sparkSession
    rows = [(i, "genre", str(g), f"genre:{n}", None)
            for i, (g, n) in enumerate(zip(GENRE_IDS, GENRE_NAMES))]
    rows += [(len(GENRE_IDS) + i, "numeric", name, name, None) for i, name in enumerate(NUMERIC)]
    return session.createDataFrame(
        rows, "feature_id int, block string, key string, name string, idf double")


# ------------------------------------------------------------------- numeric block


def _positive(column: str) -> Column:
    return F.when(F.col(column) > 0, F.col(column))


def median_sketch(column: str) -> Column:
    """Aggregate: number of positive values and a bracket around their median."""
    value = _positive(column)
    return F.struct(F.count(value).alias("n"),
                    F.percentile_approx(value, [0.499, 0.501], 2000).alias("edge"))


STEPS = 1024
FEW_VALUES = 4096


def _value_at(inside: DataFrame, rank: int, low: float, high: float) -> float:
    """The value of a rank, counted from 0, among values from ``low`` to ``high``.

    The range is cut into equal steps and their values are counted, until few are left.
    """
    while True:
        step = (high - low) / STEPS
        n = inside.count()
        if n <= FEW_VALUES or step == 0 or low + step == low:
            return sorted(row["v"] for row in inside.limit(FEW_VALUES).collect())[min(rank, FEW_VALUES - 1)]
        place = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(step)), F.lit(STEPS - 1))
        counted = inside.groupBy(place.alias("step")).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for row in sorted(counted.collect()):
            if rank < row["n"]:
                break
            rank -= row["n"]
        low, high = row["low"], row["high"]
        inside = inside.where(F.col("v").between(low, high))


def exact_medians(df: DataFrame, sketches: dict[str, tuple]) -> dict[str, float | None]:
    """Exact medians of the positive values, given each column's :func:`median_sketch`.

    Only values inside the bracket, a few thousandths of all, are looked at again; the
    middle ones are found by counting, so that nothing is sorted as a whole.
    """
    known = {c: s for c, s in sketches.items() if s["n"]}
    medians: dict[str, float | None] = dict.fromkeys(sketches)
    if not known:
        return medians
    below = df.agg(*[F.count(F.when(_positive(c) < s["edge"][0], 1)).alias(c)
                     for c, s in known.items()]).first()
    for column, (n, (low, high)) in known.items():
        inside = df.select(_positive(column).alias("v")).where(F.col("v").between(low, high))
        ranks = {(n - 1) // 2 - below[column], n // 2 - below[column]}
        middle = [_value_at(inside, rank, low, high) for rank in ranks]
        medians[column] = sum(middle) / len(middle)
    return medians


def _numeric_inputs(records: DataFrame) -> DataFrame:
    return records.select(
        "movieId",
        F.coalesce("vote_average", F.lit(0.0)).cast("double").alias("vote_average"),
        F.coalesce("vote_count", F.lit(0)).cast("double").alias("vote_count"),
        F.coalesce("runtime", F.lit(0.0)).cast("double").alias("runtime"),
        F.coalesce("budget", F.lit(0.0)).cast("double").alias("budget"),
        F.coalesce("revenue", F.lit(0.0)).cast("double").alias("revenue"),
        release_year_or_zero(F.col("release_date")).cast("double").alias("year"),
        F.when(F.col("original_language") == "en", 1.0).otherwise(0.0).alias("is_english"))


def _numeric_values(inputs: DataFrame, stats: dict[str, float]) -> DataFrame:
    """The transformed, not yet normalised columns."""
    known = {name: F.lit(value) for name, value in stats.items()}
    return inputs.select(
        "movieId", "year", "is_english",
        bayesian_average(F.col("vote_average"), F.col("vote_count"), known["bayesian_m"],
                         PRIOR_VOTES).alias("bayesian_vote"),
        F.log1p("vote_count").alias("vote_count_log"),
        positive_or(F.col("runtime"), known["runtime_impute_value"]).alias("runtime"),
        F.log1p(positive_or(F.col("budget"), known["budget_impute_value"])).alias("budget_log"),
        F.log1p(positive_or(F.col("revenue"), known["revenue_impute_value"])).alias("revenue_log"))


NORMALISED = ("bayesian_vote", "vote_count_log", "runtime", "budget_log", "revenue_log")


def fit_numeric(records: DataFrame) -> DataFrame:
    """One row with every number a later encoding needs.

    Imputed values come first, because the means and deviations are those of the
    imputed columns; all of it is aggregated, and only the final numbers reach the driver.
    """
    inputs = _numeric_inputs(records)
    year = F.when(F.col("year") > 0, F.col("year"))
    level = inputs.agg(
        F.coalesce(F.avg(F.when(F.col("vote_count") > 0, F.col("vote_average"))),
                   F.lit(6.0)).alias("bayesian_m"),
        F.coalesce(F.avg(F.when(F.col("runtime") > 0, F.col("runtime"))),
                   F.lit(90.0)).alias("runtime_impute_value"),
        F.coalesce(F.avg(year), F.lit(1990.0)).alias("year_mean"),
        F.coalesce(F.stddev_pop(year), F.lit(20.0)).alias("year_std"),
        median_sketch("budget").alias("budget"),
        median_sketch("revenue").alias("revenue")).first().asDict()
    medians = exact_medians(inputs, {c: level.pop(c) for c in ("budget", "revenue")})
    level |= {f"{c}_impute_value": 1.0 if m is None else m for c, m in medians.items()}
    moments = []
    for name in NORMALISED:
        moments += [F.avg(name).alias(f"{name}_mean"),
                    usable_std(F.stddev_pop(name)).alias(f"{name}_std")]
    normal = _numeric_values(inputs, level).agg(*moments).first().asDict()
    stats = {"bayesian_C": PRIOR_VOTES, **level, **normal}
    return records.sparkSession.createDataFrame(
        [tuple(stats.values())], ", ".join(f"{name} double" for name in stats))


def numeric_block(records: DataFrame, stats: DataFrame) -> DataFrame:
    """The seven numeric columns, normalised with saved statistics."""
    row = stats.first().asDict()
    values = _numeric_values(_numeric_inputs(records), row)
    normalised = [
        *[z_score(F.col(c), F.lit(row[f"{c}_mean"]), F.lit(row[f"{c}_std"])) for c in NORMALISED],
        F.when(F.col("year") > 0, (F.col("year") - F.lit(row["year_mean"]))
               / F.lit(row["year_std"] + 1e-9)).otherwise(0.0),
        F.col("is_english")]
    columns = F.array(*[F.struct(F.lit(len(GENRE_IDS) + i).alias("feature_id"), v.alias("value"))
                        for i, v in enumerate(normalised)])
    return values.select("movieId", F.explode(columns).alias("f")).select(
        "movieId", "f.feature_id", "f.value").where(F.col("value") != 0)


# ------------------------------------------------------------------- vocabularies


def term_counts(records: DataFrame, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """Occurrences of every keyword term per item; keyword phrases give several terms.

    An item's words go to one task as one text, so that what is shuffled is the texts and no row per term.
    The number of tasks follows from the size of the texts, about ``text_bytes`` each, as a task holds a count per item and term.
    """
    texts = records.select("movieId", F.array_join("keyword_names", " ").alias("_text"))
    parts = int((texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0) // text_bytes) + 1
    return texts.repartition(parts, "movieId").select("movieId", F.explode(word_tokens(F.col("_text"))).alias("term")).groupBy(
        "movieId", "term").agg(F.count(F.lit(1)).alias("tf"))


def fit_terms(records: DataFrame, counts: DataFrame | None = None,
              max_terms: int = MAX_TERMS) -> DataFrame:
    """The most frequent terms ``pos, term, idf``, numbered alphabetically.

    A term must occur in min(5, max(1, n / 200)) items, or in one if that leaves none.
    """
    counts = term_counts(records) if counts is None else counts
    n = records.count()
    frequency = counts.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    floor = min(5, max(1, n // 200))
    enough = F.col("df") >= floor
    # At most max_terms rows reach the driver, which is what makes them a vocabulary.
    top = frequency.orderBy(enough.desc(), F.col("total").desc(), "term").limit(max_terms).collect()
    kept = [row for row in top if row["df"] >= floor] or top
    rows = [(pos, row["term"], row["df"])
            for pos, row in enumerate(sorted(kept, key=lambda row: row["term"]))]
    terms = records.sparkSession.createDataFrame(rows, "pos int, term string, df long")
    return terms.select("pos", "term", smooth_idf(F.lit(n), F.col("df")).alias("idf"))


def director_occurrences(records: DataFrame) -> DataFrame:
    return records.select("movieId", F.explode("director_ids").alias("person"))


def cast_occurrences(records: DataFrame) -> DataFrame:
    return records.select("movieId", F.explode("cast").alias("c")).select(
        "movieId", F.col("c.id").alias("person"), billing_weight(F.col("c.order")).alias("value"))


def frequent_people(occurrences: DataFrame, minimum: int) -> DataFrame:
    """People listed at least ``minimum`` times, with their number of listings."""
    return occurrences.groupBy("person").agg(F.count(F.lit(1)).alias("films")).where(
        F.col("films") >= minimum)


def fit_vocab(records: DataFrame, min_director_films: int = MIN_DIRECTOR_FILMS,
              min_cast_films: int = MIN_CAST_FILMS, counts: DataFrame | None = None) -> DataFrame:
    """All feature columns in order: genres, numbers, terms, directors, cast.

    counts: :func:`term_counts` of the records, when the caller has them stored.
    """
    fixed = genre_dictionary(records)
    base = len(GENRE_IDS) + len(NUMERIC)
    terms = fit_terms(records, counts).select(
        (F.lit(base) + F.col("pos")).cast("int").alias("feature_id"), F.lit("keyword").alias("block"),
        F.col("term").alias("key"), F.concat(F.lit("kw:"), "term").alias("name"), "idf")

    start = base + terms.count()
    directors = people_vocab(director_occurrences(records), min_director_films, "director", start)
    cast = people_vocab(cast_occurrences(records), min_cast_films, "cast", start + directors.count())
    return fixed.unionByName(terms).unionByName(directors).unionByName(cast)


def people_vocab(occurrences: DataFrame, minimum: int, block: str, offset: int = 0) -> DataFrame:
    """Feature columns of the people listed often enough, numbered by id from ``offset`` on."""
    numbered = dense_index(frequent_people(occurrences, minimum), "person", "pos")
    return numbered.select(
        (F.lit(offset) + F.col("pos")).cast("int").alias("feature_id"),
        F.lit(block).alias("block"), F.col("person").cast("string").alias("key"),
        F.concat(F.lit(f"{block}:"), F.col("person").cast("string")).alias("name"),
        F.lit(None).cast("double").alias("idf"))


# ------------------------------------------------------------------- encoding


def _ids(vocab: DataFrame, block: str) -> DataFrame:
    return vocab.where(F.col("block") == block).select(
        "feature_id", F.col("key").cast("long").alias("person"))


def genre_block(records: DataFrame, vocab: DataFrame) -> DataFrame:
    """One-hot genres; ids outside the dictionary are ignored, repeats count once."""
    listed = records.select("movieId", F.explode(F.array_distinct("genre_ids")).alias("person"))
    return listed.join(F.broadcast(_ids(vocab, "genre")), "person").select(
        "movieId", "feature_id", F.lit(1.0).alias("value"))


def keyword_block(records: DataFrame, vocab: DataFrame,
                  counts: DataFrame | None = None) -> DataFrame:
    """TF-IDF of the kept terms, each item's row scaled to length one."""
    counts = term_counts(records) if counts is None else counts
    # The vocabulary holds at most MAX_TERMS terms.
    terms = F.broadcast(vocab.where(F.col("block") == "keyword").select(
        "feature_id", F.col("key").alias("term"), "idf"))
    weights = counts.join(terms, "term").select(
        "movieId", "feature_id", (sublinear_tf(F.col("tf")) * F.col("idf")).alias("w"))
    row = Window.partitionBy("movieId")  # at most MAX_TERMS rows per item
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(row))
    return weights.select("movieId", "feature_id", (F.col("w") / length).alias("value"))


def director_block(records: DataFrame, vocab: DataFrame) -> DataFrame:
    listed = director_occurrences(records).distinct()
    return listed.join(_ids(vocab, "director"), "person").select(
        "movieId", "feature_id", F.lit(1.0).alias("value"))


def cast_block(records: DataFrame, vocab: DataFrame) -> DataFrame:
    """Billing weights; an actor billed twice counts with the better billing."""
    listed = cast_occurrences(records).groupBy("movieId", "person").agg(
        F.max("value").alias("value"))
    return listed.join(_ids(vocab, "cast"), "person").select("movieId", "feature_id", "value")


def transform(records: DataFrame, vocab: DataFrame, stats: DataFrame,
              counts: DataFrame | None = None) -> DataFrame:
    """Encode records with a saved vocabulary and saved statistics."""
    blocks = [genre_block(records, vocab), numeric_block(records, stats),
              keyword_block(records, vocab, counts), director_block(records, vocab),
              cast_block(records, vocab)]
    out = blocks[0]
    for block in blocks[1:]:
        out = out.unionByName(block)
    return out


def linked_records(records: DataFrame, one_item: DataFrame) -> DataFrame:
    """Records of linked items, keyed by item."""
    bridge = one_item.select(F.col("tmdbId").alias("tmdb_id"), "movieId")
    return records.join(bridge, "tmdb_id")


def content_rows(wanted: DataFrame, stored: DataFrame, fresh: DataFrame, vocab: DataFrame,
                 stats: DataFrame) -> DataFrame:
    """Feature rows of the wanted items: stored ones, else encoded from fresh records.

    ``source`` tells which. Items with neither are absent.
    """
    ids = wanted.select("movieId").distinct()
    known = stored.join(ids, "movieId", "left_semi").withColumn("source", F.lit("stored"))
    missing = ids.join(stored.select("movieId").distinct(), "movieId", "left_anti")
    # every block of features reads them
    path = new_folder(wanted.sparkSession, "missing-records")
    fresh.join(missing, "movieId", "left_semi").write.parquet(path)
    records = wanted.sparkSession.read.parquet(path)
    return known.unionByName(
        transform(records, vocab, stats).withColumn("source", F.lit("fresh")))


def content_coverage(items: DataFrame, features: DataFrame) -> DataFrame:
    """How many of the items have any content."""
    with_content = features.select("movieId").distinct().withColumn("_has", F.lit(1))
    return items.select("movieId").distinct().join(with_content, "movieId", "left").agg(
        F.count(F.lit(1)).alias("n_items"), F.count("_has").alias("n_covered"),
        F.try_divide(F.count("_has"), F.count(F.lit(1))).alias("coverage"))


def density(features: DataFrame, vocab: DataFrame) -> DataFrame:
    """Stored values per block, and the filled share of the whole matrix."""
    columns = vocab.groupBy("block").agg(F.count(F.lit(1)).alias("n_features"))
    # The vocabulary is joined by id only to name the block of each value.
    filled = features.join(vocab.select("feature_id", "block"), "feature_id").groupBy(
        "block").agg(F.count(F.lit(1)).alias("nnz"))
    n_items = features.agg(F.countDistinct("movieId")).first()[0]
    share = F.col("nnz") / (F.col("n_features") * F.lit(n_items))
    return columns.join(filled, "block", "left").select(
        "block", "n_features", F.coalesce("nnz", F.lit(0)).alias("nnz"),
        F.coalesce(share, F.lit(0.0)).alias("density"))


# ------------------------------------------------------------------- item vectors


def project(features: DataFrame | Tiles, weights: DataFrame, size: int) -> DataFrame:
    """Content vector and bias of every item: its features times the feature weights."""
    tiles = features if isinstance(features, Tiles) else tiled(features)
    rows = weights.select("feature_id", F.concat(F.col("vec").cast("array<double>"), F.array(F.col("bias").cast("double"))).alias("vec"))
    return times(tiles, rows, size + 1).select(
        "movieId", F.slice("vec", 1, size).alias("vec"), F.element_at("vec", -1).alias("bias"))


def item_representations(items: DataFrame, factors: DataFrame, content: DataFrame,
                         warm_mode: str = "identity") -> DataFrame:
    """Vector and bias of every item: ``movieId, vec, bias, is_cold, status``.

    A warm item uses its trained vector, plus its content vector when ``warm_mode`` is
    "hybrid". A cold item uses its content vector. An item with neither is
    ``unscorable``.
    """
    if warm_mode not in ("identity", "hybrid"):
        raise ValueError("warm_mode is 'identity' or 'hybrid'")
    warm = factors.select("movieId", F.col("vec").cast("array<double>").alias("_q"),
                          F.col("bias").cast("double").alias("_qb"))
    cold = content.select("movieId", F.col("vec").alias("_c"), F.col("bias").alias("_cb"))
    joined = items.select("movieId").join(warm, "movieId", "left").join(cold, "movieId", "left")
    vec, bias = F.col("_q"), F.col("_qb")
    if warm_mode == "hybrid":
        summed = F.zip_with("_q", "_c", lambda a, b: a + b)
        vec = F.when(F.col("_c").isNull(), F.col("_q")).otherwise(summed)
        bias = F.col("_qb") + F.coalesce("_cb", F.lit(0.0))
    is_warm = F.col("_q").isNotNull()
    status = (F.when(is_warm, "warm").when(F.col("_c").isNotNull(), "cold")
              .otherwise("unscorable"))
    return joined.select(
        "movieId", F.when(is_warm, vec).otherwise(F.col("_c")).alias("vec"),
        F.when(is_warm, bias).otherwise(F.col("_cb")).alias("bias"),
        (~is_warm).alias("is_cold"), status.alias("status"))
