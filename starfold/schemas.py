"""Explicit schemas of every table the engine reads, as DDL; nothing is inferred."""

RATINGS = "userId long, movieId long, rating double, timestamp long"
ITEMS = "movieId long, title string, genres string"
LINKS = "movieId long, imdbId string, tmdbId double"
EXPORT = "`Date` string, `Name` string, `Year` int, `URI` string, `Rating` double"
RECORD = (
    "tmdb_id long, genre_ids array<long>, runtime double, release_date string, "
    "original_language string, vote_average double, vote_count long, budget double, "
    "revenue double, keyword_ids array<long>, keyword_names array<string>, "
    "director_ids array<long>, cast array<struct<id:long,order:int>>"
)
DETAIL_RESPONSE = (
    "genres array<struct<id:long>>, runtime double, release_date string, "
    "original_language string, vote_average double, vote_count long, budget double, revenue double"
)
KEYWORDS_RESPONSE = "keywords array<struct<id:long,name:string>>"
CREDITS_RESPONSE = (
    "crew array<struct<id:long,job:string>>, cast array<struct<id:long,order:int>>"
)
ITEM_FEATURES = "movieId long, feature_id int, value double"
VOCAB = "feature_id int, block string, key string, name string, idf double"
FEATURE_WEIGHTS = "feature_id int, vec array<float>, bias double"
PROGRESS = (
    "epoch int, of int, mse_loss double, rmse double, objective double, "
    "updated_at string, done boolean"
)
