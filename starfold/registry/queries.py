"""Every operator as a query over the given tables, ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from starfold.functions import scalars, vectors
from starfold.operators import evaluate, features as feat, filters, foldin, matching, scoring, stats
from starfold.operators.indexing import dense_index
from starfold.plans import recommend as rec, train as training
from starfold.registry.derived import SMALL, Derived
from starfold.session import new_folder
from starfold.sources import store, tables
from starfold.streaming import jobs

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Derived], DataFrame]):
    """Register a query under its function's name."""
    REGISTRY[build.__name__] = lambda spark, folder: build(Derived(spark, folder))
    return build


def r6(column) -> "F.Column":
    return F.round(column, 6)


def _exploded(users: DataFrame, *extra: str) -> DataFrame:
    """Vectors as one row per dimension, so that they can be compared."""
    return users.select("userId", *extra, F.posexplode_outer("vec").alias("dim", "value")).withColumn(
        "value", r6(F.col("value")))


# ------------------------------------------------------------------ scans


@query
def scan_ratings(d):
    return d.ratings.select("userId", "movieId", "rating")


@query
def scan_items(d):
    return d.items.select("movieId", "title", "genres")


@query
def links_last_wins(d):
    return d.one_item


@query
def links_inverse(d):
    return tables.item_to_catalog(d.links)


@query
def export_clean(d):
    raw = d.export.select("userId", "line_no", F.lit("2026-01-01").alias("Date"),
                          F.col("title").alias("Name"), F.col("year").cast("double").alias("Year"),
                          F.lit("x").alias("URI"), F.col("rating").alias("Rating"))
    return tables.export_rows(raw)


@query
def profile_dedup(d):
    return tables.profile(d.profile_events)


@query
def records_latest(d):
    rows = d.profile_events.select("movieId", "line_no", "userId", "rating")
    return tables.latest_records(rows, "movieId", "line_no")


@query
def latest_snapshot(d):
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    exports = d.profile_events.select(F.col("userId").alias("user"), week.alias("snapshot_date"),
                                      "line_no", "movieId", "rating")
    return tables.latest_snapshot(exports)


@query
def record_parse(d):
    p = tables.parse_records(d.responses)
    def text(column):
        return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")

    billed = F.transform("cast", lambda c: F.concat(
        c["id"].cast("string"), F.lit(":"), c["order"].cast("string")))
    return p.select("tmdb_id", text("genre_ids").alias("genre_ids"), "runtime", "release_date",
                    "original_language", "vote_count", "budget",
                    F.size("keyword_names").cast("long").alias("n_keywords"),
                    F.array_join("keyword_names", " ").alias("keywords"),
                    text("keyword_ids").alias("keyword_ids"),
                    text("director_ids").alias("director_ids"),
                    F.array_join(billed, ",").alias("cast"))


# ------------------------------------------------------------------ filters


@query
def min_support(d):
    return d.kept.select("userId", "movieId", "rating")


@query
def first_n_users(d):
    return filters.first_users(d.ratings, 1000).select("userId", "movieId", "rating")


@query
def sample_users(d):
    return filters.sample_users(d.kept, 500, 7).select("userId", "movieId", "rating")


@query
def title_search(d):
    return matching.title_search(d.export.select("title", "year"), d.items)


@query
def title_candidates(d):
    return matching.shown_candidates(matching.title_search(d.export.select("title", "year"), d.items)).select(
        "title", "year", "movieId")


@query
def genre_all(d):
    return filters.in_all_genres(d.items, "Promo, BRAND#1").select("movieId", "genres")


@query
def genre_one(d):
    return filters.in_genre(d.items, "econ").select("movieId", "genres")


@query
def exclude_rated(d):
    seen = d.profile_events.select("userId", "movieId").distinct()
    return filters.exclude_rated(seen, d.ratings)


@query
def min_ratings_floor(d):
    return filters.rated_often(d.items.select("movieId", "title"), d.ratings, 30)


@query
def warm_only(d):
    return filters.warm_only(d.ratings, d.factors2).select("userId", "movieId", "rating")


@query
def pending_ids(d):
    done = d.table("documents").select(F.col("doc_id").alias("movieId"))
    return filters.pending(d.items.select("movieId"), done, "movieId", 500)


@query
def in_trainset(d):
    return filters.mark_trained(d.items.select("movieId"), d.factors2)


@query
def title_any(d):
    return filters.titles_matching(d.items, ["ring", "wid.et", r"\(199\d\)"]).select(
        "movieId", "title")


# ------------------------------------------------------------------ matching


def _resolution(d):
    return matching.resolve_export(d.export, d.catalog)


@query
def nearest_year(d):
    return matching.nearest_year_matches(d.export, d.catalog)


@query
def first_hit(d):
    return matching.nearest_year_matches(d.export, d.catalog, rule="first_hit")


@query
def resolve_export(d):
    return _resolution(d)


@query
def match_inner(d):
    return matching.match_items(matching.resolved_rows(_resolution(d)), d.links)


@query
def match_unmatched(d):
    return matching.unmatched_rows(matching.resolved_rows(_resolution(d)), d.links)


def _classified(d, dedup=False):
    return matching.classify_matches(matching.resolved_rows(_resolution(d)), d.links, ["userId"],
                                     dedup)


@query
def match_ambiguous(d):
    return _classified(d)


@query
def match_ambiguous_distinct(d):
    return _classified(d, dedup=True)


@query
def match_report(d):
    return matching.match_report(_classified(d)).withColumn("match_rate", r6(F.col("match_rate")))


@query
def match_lookup(d):
    return matching.lookup_items(matching.resolved_rows(_resolution(d)), d.one_item)


@query
def match_outcome(d):
    return matching.match_ratings(d.export, d.catalog, d.one_item).groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"))


def _candidates(d):
    """Search results as they might arrive: two sources, repeated ids, undated entries."""
    source = F.when(F.col("event_type").isin("click", "view"), 0).otherwise(1)
    k = F.get_json_object("props", "$.k").cast("long")
    date = F.when(k % 9 == 0, "").otherwise(
        F.concat((F.lit(1980) + k % 41).cast("string"), F.lit("-03-01")))
    year = F.when(F.col("user_id") % 8 == 0, None).otherwise(
        F.lit(1978) + F.col("user_id") % 45).cast("int")
    return d.table("events").select(
        F.col("user_id").alias("request"), year.alias("year"), source.alias("src_rank"),
        F.col("event_id").alias("pos"), k.alias("id"), date.alias("release_date"))


@query
def candidate_pool(d):
    return matching.candidate_pool(_candidates(d), ["request"])


@query
def pick_nearest_year(d):
    pool = matching.candidate_pool(_candidates(d), ["request"])
    return matching.pick_nearest_year(pool, ["request"])


@query
def pick_first_hit(d):
    return matching.pick_first_hit(matching.candidate_pool(_candidates(d), ["request"]),
                                   ["request"])


@query
def warm_set_diff(d):
    other = d.table("embeddings").where("label <> 3").select(F.col("vec_id").alias("movieId"))
    return matching.warm_set_difference(d.factors2, other)


@query
def dense_index_users(d):
    return dense_index(d.ratings, "userId")


@query
def dense_index_items(d):
    return dense_index(d.kept, "movieId")


@query
def enrich_meta(d):
    # Scores of more items than there is metadata for.
    known = d.items.where(F.col("title").rlike(r"\)$"))
    return rec.with_metadata(d.items.select("movieId"), known)


@query
def item_stats_join(d):
    scores = rec.popularity(d.factors2, d.mean).withColumn("score", r6(F.col("score")))
    return stats.with_item_stats(scores, d.stored)


@query
def inject_user(d):
    # The first exported profile becomes a trained user.
    own = tables.profile(d.profile_events).groupBy("movieId").agg(F.max("rating").alias("rating"))
    return filters.inject_user(d.kept, own, filters.supported_items(d.ratings), -1)


# ------------------------------------------------------------------ aggregates


@query
def item_counts(d):
    return stats.item_counts(d.ratings)


@query
def global_mean(d):
    return stats.global_mean(d.kept).select(r6(F.col("global_mean")).alias("global_mean"))


@query
def item_stats(d):
    return stats.item_stats(d.ratings)


@query
def rating_summary(d):
    return stats.rating_summary(d.kept)


@query
def convergence(d):
    curve = d.table("events").groupBy("event_type", F.dayofmonth("ts").alias("n_epochs")).agg(
        F.avg("value").alias("rmse"))
    return stats.convergence_point(curve, improvement=0.5, by=["event_type"])


@query
def norm_report(d):
    users = foldin.fold_in(d.stored, d.factors2, d.mean).where("status = 'ok'")
    return stats.norm_report(users, d.factors2, SMALL).select(
        "userId", r6(F.col("user_norm")).alias("user_norm"),
        r6(F.col("avg_item_norm")).alias("avg_item_norm"))


# ------------------------------------------------------------------ features


def _vocab(d):
    return feat.fit_vocab(d.linked)


def _rounded(rows):
    return rows.withColumn("value", r6(F.col("value")))


@query
def numeric_stats(d):
    row = feat.fit_numeric(d.linked)
    return row.select(*[r6(F.col(c)).alias(c) for c in row.columns])


@query
def freq_people(d):
    directors = feat.frequent_people(feat.director_occurrences(d.linked), 3)
    cast = feat.frequent_people(feat.cast_occurrences(d.linked), 5)
    return directors.withColumn("block", F.lit("director")).unionByName(
        cast.withColumn("block", F.lit("cast")))


@query
def tfidf_vocab(d):
    return feat.fit_terms(d.linked).select(
        F.col("pos").cast("long").alias("pos"), "term", r6(F.col("idf")).alias("idf"))


@query
def feature_vocab(d):
    return _vocab(d).select("feature_id", "block", "key", "name", r6(F.col("idf")).alias("idf"))


@query
def features_genre(d):
    return feat.genre_block(d.linked, feat.genre_dictionary(d.linked))


@query
def features_numeric(d):
    return _rounded(feat.numeric_block(d.linked, feat.fit_numeric(d.linked)))


@query
def features_tfidf(d):
    counts = d.written(feat.term_counts(d.linked), "terms")
    vocab = feat.fit_terms(d.linked, counts).select(
        F.col("pos").cast("int").alias("feature_id"), F.lit("keyword").alias("block"),
        F.col("term").alias("key"), "idf")
    return _rounded(feat.keyword_block(d.linked, vocab, counts))


@query
def features_director(d):
    vocab = feat.people_vocab(feat.director_occurrences(d.linked), feat.MIN_DIRECTOR_FILMS, "director")
    names = vocab.select("feature_id", "name")
    return feat.director_block(d.linked, vocab).join(names, "feature_id").select(
        "movieId", "name", "value")


@query
def features_cast(d):
    vocab = feat.people_vocab(feat.cast_occurrences(d.linked), feat.MIN_CAST_FILMS, "cast")
    names = vocab.select("feature_id", "name")
    return _rounded(feat.cast_block(d.linked, vocab).join(names, "feature_id").select(
        "movieId", "name", "value"))


@query
def features_all(d):
    return _rounded(d.content.features)


def _served(d):
    """Corpus: records of items with a trained vector. The other items arrive later."""
    corpus = d.linked.join(d.factors2.select("movieId"), "movieId", "left_semi")
    later = d.linked.join(d.factors2.select("movieId"), "movieId", "left_anti")
    return corpus, later


@query
def features_serve(d):
    corpus, later = _served(d)
    vocab, numbers = feat.fit_vocab(corpus), feat.fit_numeric(corpus)
    return _rounded(feat.transform(later, vocab, numbers))


@query
def content_row(d):
    corpus = d.written(_served(d)[0], "corpus")
    counts = d.written(feat.term_counts(corpus), "terms")
    vocab, numbers = d.written(feat.fit_vocab(corpus, counts=counts), "vocab"), feat.fit_numeric(corpus)
    stored = d.written(feat.transform(corpus, vocab, numbers, counts), "features")
    rows = feat.content_rows(d.items, stored, d.linked, vocab, numbers)
    return rows.groupBy("movieId", "source").agg(
        F.count(F.lit(1)).alias("n_features"), r6(F.sum("value")).alias("total"))


@query
def feature_density(d):
    return feat.density(d.content.features, d.content.vocab).withColumn("density", r6(F.col("density")))


def _content2(d):
    """Content vectors of the small model from all features and formula weights."""
    return feat.project(d.content.features, d.weights(d.content.vocab, SMALL), SMALL)


@query
def content_coverage(d):
    return feat.content_coverage(d.kept, d.content.features).withColumn(
        "coverage", r6(F.col("coverage")))


def _item_repr(d, mode):
    rows = feat.item_representations(d.items, d.factors2, _content2(d), mode)
    return rows.select("movieId", "is_cold", "status", r6(F.col("bias")).alias("bias"),
                       r6(F.col("vec")[0]).alias("x1"), r6(F.col("vec")[1]).alias("x2"))


@query
def item_repr(d):
    return _item_repr(d, "identity")


@query
def item_repr_hybrid(d):
    return _item_repr(d, "hybrid")


# ------------------------------------------------------------------ fold-in


@query
def fold_in_k2(d):
    users = foldin.fold_in(d.stored, d.factors2, d.mean)
    return users.select("userId", "alpha", "n", "status", r6(F.col("bias")).alias("bias"),
                        r6(F.col("vec")[0]).alias("w1"), r6(F.col("vec")[1]).alias("w2"))


@query
def fold_in(d):
    return _exploded(foldin.fold_in(d.stored, d.factors(), d.mean), "status")


@query
def fold_in_least_squares(d):
    users = foldin.fold_in(d.stored, d.factors2, d.mean, solver="least_squares")
    # Nearly dependent rows have solutions in the thousands.
    return users.select("userId", "n", F.round("bias", 4).alias("bias"),
                        F.round(F.col("vec")[0], 4).alias("w1"), F.round(F.col("vec")[1], 4).alias("w2"))


LOO_ALPHAS = (1.0, 10.0, 100.0)


def _loo(d, clamp=True):
    return foldin.leave_one_out(d.stored, d.factors2, d.mean, LOO_ALPHAS, clamp)


def _rounded_errors(rows):
    return rows.select("userId", "alpha", "n", *[
        r6(F.col(c)).alias(c) for c in ("rmse", "mae", "mean_error")])


@query
def loo_alpha(d):
    return _rounded_errors(_loo(d))


@query
def loo_alpha_unclamped(d):
    return _rounded_errors(_loo(d, clamp=False))


@query
def loo_alpha_full(d):
    return _rounded_errors(foldin.leave_one_out(d.stored, d.factors(), d.mean, LOO_ALPHAS))


@query
def best_alpha(d):
    return foldin.best_alpha(_loo(d)).withColumn("rmse", r6(F.col("rmse")))


@query
def fold_in_tuned(d):
    users = foldin.fold_in_tuned(d.stored, d.factors2, d.mean, LOO_ALPHAS, clamp=True)
    return users.select("userId", "alpha", "n", r6(F.col("bias")).alias("bias"),
                        r6(F.col("vec")[0]).alias("w1"), r6(F.col("vec")[1]).alias("w2"))


def _residuals(d):
    return rec.residual_report(d.stored, d.factors2, d.mean, SMALL, [0.1, 100.0])


@query
def train_fit(d):
    rows = _residuals(d).where("solver like 'ridge%'")
    metrics = stats.prediction_metrics(rows, ["userId", "alpha"])
    return metrics.select("userId", "alpha", "n_test", r6(F.col("rmse")).alias("rmse"),
                          r6(F.col("mae")).alias("mae"))


@query
def worst_errors(d):
    rows = _residuals(d).where("alpha = 100")
    worst = rows.orderBy(F.round(F.abs("error"), 9).desc(), "userId", "movieId").limit(25)
    return worst.select("userId", "movieId", "rating", r6(F.col("predicted")).alias("predicted"),
                        r6(F.col("error")).alias("error"))


@query
def solver_comparison(d):
    metrics = stats.prediction_metrics(_residuals(d), ["solver"])
    return metrics.select("solver", "n_test", r6(F.col("rmse")).alias("rmse"))


@query
def alpha_spread(d):
    return stats.spread_per_alpha(_residuals(d).where("solver like 'ridge%'")).select(
        "alpha", r6(F.col("pred_spread")).alias("pred_spread"))


# ------------------------------------------------------------------ scoring


@query
def predict_pairs(d):
    users = foldin.fold_in(d.stored, d.factors2, d.mean)
    pairs = tables.profile(d.profile_events).select("userId", "movieId")
    out = scoring.predict_pairs(pairs, users, d.factors2, F.lit(d.mean), SMALL)
    return out.select("userId", "movieId", r6(F.col("raw")).alias("raw"),
                      r6(F.col("predicted")).alias("predicted"))


def _top(rows, *extra):
    return rows.select("userId", "movieId", "rank", r6(F.col("raw")).alias("raw"),
                       r6(F.col("score")).alias("score"), *extra)


@query
def recommend_topn(d):
    return _top(rec.recommend(d.stored, d.factors(), d.items, d.mean, 5), "title", "genres")


@query
def recommend_filtered(d):
    return _top(rec.recommend(d.stored, d.factors2, d.items, d.mean, 5, genres="Brand#1,o",
                              min_ratings=25), "genres")


@query
def support_filter(d):
    return _top(rec.recommend(d.stored, d.factors2, d.items, d.mean, 5, min_support_sim=0.999),
                r6(F.col("support")).alias("support"))


@query
def recommend_full(d):
    return _top(rec.recommend(d.stored, d.factors(), d.items, d.mean, 5), "title")


@query
def popularity(d):
    return rec.popularity(d.factors2, d.mean).withColumn("score", r6(F.col("score")))


@query
def item_cf(d):
    return _exploded(rec.preference_vectors(d.stored, d.factors(), d.mean, 64))


def _matched(d):
    """Ratings of items the model knows, which leaves users on both sides of the tier."""
    return filters.warm_only(d.stored, d.factors2)


@query
def recommend_tiered(d):
    users = d.table("customer").select(F.col("c_custkey").alias("userId"))
    rows = rec.recommend_tiered(_matched(d), d.factors(), d.items, d.mean, 64, users=users)
    return rows.withColumn("predicted_score", r6(F.col("predicted_score")))


@query
def recommend_tiered_genre(d):
    users = d.table("customer").select(F.col("c_custkey").alias("userId"))
    rows = rec.recommend_tiered(_matched(d), d.factors2, d.items, d.mean, SMALL, 3,
                                genre="SMALL", users=users)
    return rows.select("userId", "movieId", "tier", "rank",
                       r6(F.col("predicted_score")).alias("predicted_score"))


@query
def score_components(d):
    users = foldin.fold_in(d.stored, d.factors2, d.mean).where("status = 'ok'")
    parts = scoring.score_components(users, d.factors2)
    return parts.select("userId", *[r6(F.col(c)).alias(c) for c in parts.columns if c != "userId"])


@query
def predict_requests(d):
    """Every exported row asks for its title, every event for its item."""
    by_title = d.export.select(
        F.concat(F.lit("t"), F.col("userId").cast("string"), F.lit("-"),
                 F.col("line_no").cast("string")).alias("request_id"),
        "userId", "title", "year", F.lit(None).cast("long").alias("movieId"))
    by_id = d.profile_events.select(
        F.concat(F.lit("e"), F.col("line_no").cast("string")).alias("request_id"), "userId",
        F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("year"),
        (F.col("movieId") * 23).alias("movieId"))
    records = d.keep_records()  # the content store and every block of features read them
    by_record = feat.transform(records.withColumnRenamed("tmdb_id", "movieId"), d.content.vocab, d.content.stats)
    # written, so that neither the records nor their features are there beside the answers
    fresh = d.written(feat.project(by_record, d.weights(d.content.vocab, SMALL), SMALL), "fresh")
    d.drop_records()
    out = rec.predict_requests(by_title.unionByName(by_id), d.stored, d.items, d.factors2,
                               d.written(_content2(d), "content-vectors"), d.mean, SMALL, catalog=d.catalog,
                               catalog_content=fresh.withColumnRenamed("movieId", "tmdb_id"))
    return out.withColumn("raw", r6(F.col("raw"))).withColumn("predicted", r6(F.col("predicted")))


@query
def demo_profile(d):
    """Profiles of titles: each user's export."""
    rows = rec.recommend_for_titles(d.export.select("userId", "title", "year", "rating"),
                                    d.factors2, d.items, d.mean, 15)
    return _top(rows)


# ------------------------------------------------------------------ evaluation


@query
def holdout_split(d):
    return evaluate.holdout_split(d.stored, 0.3, 5)


def _ablation(d):
    split = d.written(evaluate.holdout_split(d.stored, 0.3, 5), "split")
    users = foldin.fold_in(split.where("part = 'train'").drop("part"), d.factors2, d.mean)
    return evaluate.ablation_predictions(split.where("part = 'test'").drop("part"), users,
                                         d.factors2, _content2(d), d.mean, SMALL)


@query
def holdout_metrics(d):
    return evaluate.holdout_metrics(_ablation(d)).select(
        "variant", "n_test", r6(F.col("rmse")).alias("rmse"), r6(F.col("mae")).alias("mae"))


DRAW_SIZES, DRAWS, CASCADE_ALPHAS, FACTORS = (5, 10, 15), 3, (1.0, 10.0, 100.0), (1, 2, 64)


def _pool(d):
    return filters.warm_only(d.stored, d.factors2)


@query
def draws(d):
    rows = evaluate.draws(_pool(d), DRAW_SIZES, DRAWS, 0)
    return rows.select("userId", F.col("n").cast("long").alias("n"),
                       F.col("draw").cast("long").alias("draw"), "movieId")


def _cascade(d):
    samples = d.written(evaluate.draws(_pool(d), DRAW_SIZES, DRAWS, 0), "draws")
    errors = evaluate.cascade_errors(_pool(d), {k: d.factors(k) for k in FACTORS}, d.mean, samples,
                                     CASCADE_ALPHAS, DRAW_SIZES, DRAWS)
    return evaluate.cascade_results(errors)


@query
def loo_cascade(d):
    return _cascade(d).select(
        "userId", F.col("k").cast("long").alias("k"), F.col("n").cast("long").alias("n"), "alpha",
        "n_draws", r6(F.col("mean_rmse")).alias("mean_rmse"),
        r6(F.col("std_rmse")).alias("std_rmse"))


@query
def cascade_stored(d):
    """The same from stored variants, of which one was never trained."""
    folder = new_folder(d.spark, "variants")
    for k in FACTORS:
        d.factors(k).write.parquet(store.epoch_path(folder, "items", f"k{k}", 1))
        store.complete_epoch(folder, f"k{k}", 1, d.spark.createDataFrame(
            [(k, False, d.mean, False)], "components int, dry_run boolean, global_mean double, has_content boolean"))
    rows = training.cascade(d.spark, folder, {k: f"k{k}" for k in (*FACTORS, 128)}, d.stored, list(CASCADE_ALPHAS), list(DRAW_SIZES), DRAWS)
    return rows.select(
        "userId", F.col("k").cast("long").alias("k"), F.col("n").cast("long").alias("n"), "alpha",
        "n_draws", r6(F.col("mean_rmse")).alias("mean_rmse"), r6(F.col("std_rmse")).alias("std_rmse"))


@query
def cascade_best(d):
    rounded = _cascade(d).withColumn("mean_rmse", F.round("mean_rmse", 9))
    best = evaluate.cascade_best(rounded)
    return best.select("userId", F.col("n").cast("long").alias("n"),
                       F.col("best_k").cast("long").alias("best_k"), "best_alpha",
                       r6(F.col("best_mean_rmse")).alias("best_mean_rmse"))


@query
def sanity_check(d):
    rows = evaluate.sanity_check(d.stored, {k: d.factors(k) for k in FACTORS}, d.mean,
                                 CASCADE_ALPHAS)
    return rows.select("userId", F.col("k").cast("long").alias("k"), "alpha", "n",
                       r6(F.col("rmse")).alias("rmse"))


# ------------------------------------------------------------------ training


def _progress(d, features, params):
    folder = new_folder(d.spark, "train")
    training.train(d.spark, d.stored, folder, features, params)
    return store.read_progress(d.spark, folder).select(
        "epoch", r6(F.col("mse_loss")).alias("mse_loss"),
        r6(F.col("objective")).alias("objective"), "done")


@query
def train_hybrid(d):
    params = training.TrainParams(components=8, epochs=3)
    return _progress(d, d.content.features, params)


@query
def train_mf(d):
    return _progress(d, None, training.TrainParams(**{**training.PLAIN.__dict__, "epochs": 3}))


def _one_factor(d, features, params):
    """Models of one factor have closed forms in SQL."""
    return _progress(d, features, params).withColumn("objective", F.round("objective", 3))


@query
def train_mf_one_factor(d):
    params = {**training.PLAIN.__dict__, "components": 1, "epochs": 2}
    return _one_factor(d, None, training.TrainParams(**params))


@query
def train_hybrid_one_factor(d):
    return _one_factor(d, d.content.features, training.TrainParams(components=1, epochs=2, content_solver="step"))


@query
def continued_training(d):
    """One epoch, then another on the same ratings: as if it had not stopped."""
    folder = new_folder(d.spark, "train")
    for epochs in (1, 2):
        params = training.TrainParams(**{**training.PLAIN.__dict__, "components": 1, "epochs": epochs})
        training.train(d.spark, d.stored, folder, None, params)
    return store.read_progress(d.spark, folder).select(
        "epoch", r6(F.col("mse_loss")).alias("mse_loss"), F.round("objective", 3).alias("objective"))


@query
def trained_factors(d):
    """Factors of a trained variant, loaded by its tag."""
    folder = new_folder(d.spark, "train")
    params = training.TrainParams(**{**training.PLAIN.__dict__, "components": 1, "epochs": 2})
    training.train(d.spark, d.stored, folder, None, params, tag="svd")
    tags = store.available_tags(d.spark, folder, ["k64", "svd"])
    loaded = [store.load_model(d.spark, folder, tag).items.withColumn("tag", F.lit(tag)) for tag in tags]
    return loaded[0].select("tag", "movieId", r6(F.col("vec")[0]).alias("x"), r6(F.col("bias")).alias("bias"))


@query
def holdout_trained(d):
    """Ablation of a hybrid that is trained on its own split."""
    params = training.TrainParams(components=8, epochs=2)
    out = training.holdout_eval(d.spark, d.stored, d.content.features, new_folder(d.spark, "holdout"), params)
    return out.drop("elapsed_min")


@query
def learning_curve(d):
    params = training.TrainParams(**{**training.PLAIN.__dict__, "components": 2, "epochs": 2})
    return training.cross_validate(d.spark, d.stored, new_folder(d.spark, "cv"), 2, params).select(
        "fold", "n_epochs", "part", r6(F.col("rmse")).alias("rmse"), r6(F.col("mae")).alias("mae"))


@query
def joint_user(d):
    """The first customer's ratings once more, as a person that is trained along."""
    params = training.TrainParams(**{**training.PLAIN.__dict__, "components": 1, "epochs": 1})
    first = d.stored.agg(F.min("userId").alias("userId"))
    own = d.stored.join(first, "userId", "left_semi").select("movieId", "rating")
    rows = training.joint_user(d.spark, d.stored, own, new_folder(d.spark, "joint"), params, -1)
    return rows.select("userId", "n", r6(F.col("bias")).alias("bias"), r6(F.col("vec")[0]).alias("w"))


@query
def training_fit(d):
    """Error of the folded-in model on all ratings it was fitted to."""
    fit = training.training_fit(_residuals(d).where("alpha = 100"))
    return fit.select("n_test", r6(F.col("rmse")).alias("rmse"), r6(F.col("mae")).alias("mae"))


# ------------------------------------------------------------------ sinks


@query
def result_tables(d):
    """Matched and unmatched rows of the whole job, written and read again."""
    path = new_folder(d.spark, "result")
    resolution = d.written(_resolution(d), "resolution")
    classified = matching.classify_matches(matching.resolved_rows(resolution), d.links, ["userId"])
    for kind in (matching.MATCHED, matching.UNMATCHED):
        rows = classified.where(F.col("kind") == kind)
        store.write_result(rows.where("false"), f"{path}/{kind}", "2026-01-01")
        store.write_result(rows, f"{path}/{kind}", "2026-01-01")
    matched, unmatched = (d.spark.read.parquet(f"{path}/{kind}").drop("run_date") for kind in (matching.MATCHED, matching.UNMATCHED))
    return matched.unionByName(unmatched)


@query
def record_lines(d):
    """Records appended as JSON lines, some of them again with one vote more; the last of each counts."""
    path = new_folder(d.spark, "records")
    store.append_records(d.records, path, "first")
    store.append_records(d.records.where("tmdb_id % 20 = 0").withColumn("vote_count", F.col("vote_count") + 1), path, "second")
    # texts are counted before the lines of a record meet
    lines = tables.record_store(d.spark, path).select("tmdb_id", "vote_count", "runtime", "budget", "release_date", "original_language",
                                                      F.size("keyword_names").cast("long").alias("n_keywords"))
    return tables.latest_records(lines, "tmdb_id", "vote_count")


# ------------------------------------------------------------------ streaming


ARRIVALS = "userId long, movieId long, rating double, line_no long"


def _arrivals(d, batches=False):
    """Profile rows as they arrive: the table as one file, or in a file a month, some files a batch."""
    schema, folder, reader = d.table("events").schema, d.folder, d.spark.readStream
    if batches:
        folder = new_folder(d.spark, "arrivals")
        month = F.date_format("ts", "yyyyMM")
        d.table("events").repartition(12, month).write.parquet(folder)
        reader = reader.option("maxFilesPerTrigger", 4)
    else:
        reader = reader.option("pathGlobFilter", "events.parquet")
    stream = reader.schema(schema).parquet(folder)
    live = Derived(d.spark, d.folder)
    live.table = lambda name: stream
    return live.profile_events.select("userId", "movieId", "rating", "line_no")


@query
def stream_fold_in(d):
    folder = new_folder(d.spark, "stream")
    jobs.fold_in_stream(_arrivals(d), d.factors2, d.mean, folder, partitions=8).awaitTermination()
    users = jobs.current_users(d.spark, folder)
    return users.select("userId", "n", r6(F.col("bias")).alias("bias"),
                        r6(F.col("vec")[0]).alias("w1"), r6(F.col("vec")[1]).alias("w2"))


@query
def stream_fold_in_batches(d):
    folder = new_folder(d.spark, "stream")
    jobs.fold_in_stream(_arrivals(d, batches=True), d.factors2, d.mean, folder, partitions=8).awaitTermination()
    users = jobs.current_users(d.spark, folder)
    return users.select("userId", "n", r6(F.col("bias")).alias("bias"),
                        r6(F.col("vec")[0]).alias("w1"), r6(F.col("vec")[1]).alias("w2"))


@query
def stream_features(d):
    """Records that arrive in several batches, a tenth of them twice, encoded with the saved vocabulary."""
    folder = new_folder(d.spark, "stream")
    records = d.keep_records()
    again = records.where("tmdb_id % 100 = 0")
    # six files without a shuffle of the texts
    records.unionByName(again).coalesce(6).write.option("compression", "zstd").parquet(f"{folder}/arrivals")
    vocab, stats = d.content.vocab, d.content.stats
    d.drop_records()
    arrivals = d.spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/arrivals")
    jobs.encode_stream(arrivals, d.links, vocab, stats, folder).awaitTermination()
    return _rounded(jobs.current_features(d.spark, folder).select("movieId", "feature_id", "value")).distinct()


@query
def stream_record_keys(d):
    """Keys stored after several batches; which row of a key came first depends on the files."""
    folder = new_folder(d.spark, "stream")
    # three batches, merged after the first and again after the second
    jobs.record_stream(_arrivals(d, batches=True), "movieId", "line_no", folder, compact_every=1).awaitTermination()
    return jobs.stored_records(d.spark, folder, ARRIVALS).groupBy("movieId").agg(F.count(F.lit(1)).alias("n"))


@query
def stream_records(d):
    folder = new_folder(d.spark, "stream")
    jobs.record_stream(_arrivals(d), "movieId", "line_no", folder).awaitTermination()
    return jobs.stored_records(d.spark, folder, ARRIVALS).select("movieId", "userId", "rating", "line_no")


# ------------------------------------------------------------------ scalar functions


@query
def text_functions(d):
    docs = d.table("documents")
    return docs.select(
        "doc_id", F.size(scalars.word_tokens(F.col("text"))).cast("long").alias("n_tokens"),
        F.md5(F.array_join(F.array_sort(F.array_distinct(scalars.word_tokens(F.col("text")))), " ")).alias("tokens"),
        scalars.has_all_tokens(F.col("text"), scalars.comma_tokens(F.lit(" The,AN "))).alias(
            "has_both"))


@query
def title_functions(d):
    date = d.catalog.select(F.col("id"), "release_date")
    rows = d.items.withColumn("id", F.col("movieId") * 10).join(date, "id")
    return rows.select(
        "movieId", scalars.trailing_year(F.col("title")).alias("title_year"),
        scalars.release_year(F.col("release_date")).alias("year"),
        scalars.release_year_or_zero(F.col("release_date")).alias("year_or_zero"),
        scalars.display_title(F.col("name"), F.col("release_date")).alias("display"),
        scalars.joined_genres(F.filter(F.split("genres", r"\|"), lambda g: g != "PROMO")).alias(
            "genres"))


@query
def numeric_functions(d):
    lines = d.table("lineitem")
    q = F.col("l_quantity")
    return lines.select(
        "l_orderkey", F.col("l_linenumber"), "l_partkey", "l_suppkey",
        r6(scalars.clamp(q / 7 - 1)).alias("clamped"), r6(F.log1p(q)).alias("log"),
        r6(scalars.bayesian_average(F.col("l_tax"), q, F.lit(6.0), 100.0)).alias("bayes"),
        r6(scalars.billing_weight(F.col("l_linenumber"))).alias("billing"),
        r6(scalars.sublinear_tf(q)).alias("tf"),
        r6(scalars.seeded_unit(3, F.col("l_orderkey"), F.col("l_linenumber"))).alias("unit"))


@query
def vector_functions(d):
    e = d.table("embeddings")
    nearby = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    a, b = F.col("embedding"), F.col("next")
    return e.join(nearby, "vec_id").select(
        "vec_id", r6(vectors.dot(a, b, 64)).alias("dot"), r6(vectors.dot(a, b)).alias("dot_any"),
        r6(vectors.norm(a, 64)).alias("norm"), r6(vectors.cosine(a, b, 64)).alias("cosine"))
