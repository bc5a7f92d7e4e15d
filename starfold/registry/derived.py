"""Domain tables derived from the given tables, in whole and without sampling."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from starfold.operators import features as feat
from starfold.operators.filters import min_support
from starfold.operators.stats import damped_bias
from starfold.plans.content import build_content_store
from starfold.session import drop, new_folder
from starfold.sources import tables

SMALL = 2  # factors of the models that have a closed form in SQL


@dataclass
class Derived:
    """Tables of one scale factor; a property is a plan over the parquet files, or over what of them it has written."""

    spark: SparkSession
    folder: str

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """The table as a user of the engine has it: on disk, derived once per query."""
        path = new_folder(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def stored(self) -> DataFrame:
        """Ratings for queries that read them several times."""
        return self.written(self.ratings, "ratings")

    @cached_property
    def ratings(self) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        return joined.groupBy(F.col("o_custkey").alias("userId"),
                              F.col("l_partkey").alias("movieId")).agg(
            F.avg(F.ceil(F.col("l_quantity") / 5) / 2).alias("rating"))

    @cached_property
    def items(self) -> DataFrame:
        year = (F.lit(1980) + F.col("p_partkey") % 41).cast("int")
        bare = F.col("p_partkey") % 50 == 0
        return self.table("part").select(
            F.col("p_partkey").alias("movieId"), F.col("p_name").alias("name"),
            year.alias("year"),
            F.when(bare, F.col("p_name")).otherwise(
                F.concat("p_name", F.lit(" ("), year.cast("string"), F.lit(")"))).alias("title"),
            F.concat_ws("|", "p_type", "p_brand").alias("genres"))

    @cached_property
    def links(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            key.alias("movieId"), (key + 100000).cast("string").alias("imdbId"),
            F.when(key % 53 == 7, None).when(key % 97 == 5, (key - 1) * 10).otherwise(
                key * 10).alias("tmdbId"))

    @cached_property
    def one_item(self) -> DataFrame:
        return tables.catalog_to_item(self.links)

    @cached_property
    def catalog(self) -> DataFrame:
        """Search catalog; the rank is a total order, so no numbering is needed."""
        key = F.col("p_partkey")
        date = F.concat((F.lit(1980) + key % 41).cast("string"), F.lit("-06-15"))
        return self.table("part").select(
            (key * 10).alias("id"), F.col("p_name").alias("title"),
            F.upper("p_name").alias("original_title"),
            F.when(key % 29 == 0, "").otherwise(date).alias("release_date"),
            (-F.round(F.col("p_retailprice") * 100)).cast("long").alias("rnk"))

    @cached_property
    def export(self) -> DataFrame:
        """Personal exports of all users; the year may be missing or off by up to two."""
        year = F.when(F.col("movieId") % 13 == 0, None).otherwise(
            F.col("year") + F.col("movieId") % 4 - 1).cast("int")
        return self.ratings.join(self.items, "movieId").select(
            "userId", F.col("movieId").alias("line_no"), F.col("name").alias("title"),
            year.alias("year"), "rating")

    @cached_property
    def profile_events(self) -> DataFrame:
        rating = F.greatest(F.lit(0.5), F.least(F.lit(5.0), F.ceil(F.col("value") / 10) / 2))
        return self.table("events").select(
            F.col("user_id").alias("userId"), F.col("event_id").alias("line_no"), "ts",
            F.get_json_object("props", "$.k").cast("long").alias("movieId"),
            rating.alias("rating"))

    @cached_property
    def kept(self) -> DataFrame:
        return min_support(self.stored)

    @cached_property
    def mean(self) -> float:
        """Mean training rating; a number, as it is in a loaded model."""
        return self.kept.agg(F.avg("rating")).first()[0]

    def factors(self, size: int | None = None) -> DataFrame:
        """Embeddings as frozen item vectors, with damped mean biases."""
        vec = F.col("embedding") if size is None else F.slice("embedding", 1, size)
        vectors = self.table("embeddings").select(F.col("vec_id").alias("movieId"),
                                                  vec.alias("vec"))
        return vectors.join(self.biases, "movieId")

    @cached_property
    def biases(self) -> DataFrame:
        return self.written(damped_bias(self.kept, F.lit(self.mean)), "biases")

    @cached_property
    def factors2(self) -> DataFrame:
        return self.factors(SMALL)

    @cached_property
    def records(self) -> DataFrame:
        """Content records keyed by the catalog id. What they count is written, so that no shuffle of the lines stays for the texts."""
        key = F.col("p_partkey")
        # dealt to parts once, for both sums over them
        lines = self.table("lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").repartition("l_partkey")
        sold = lines.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("revenue"))
        votes = self.written(self.stored.groupBy("movieId").agg(
            (2 * F.avg("rating")).alias("vote_average"), F.count(F.lit(1)).alias("vote_count")), "votes")
        people = lines.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
        order = Window.partitionBy("l_partkey").orderBy(F.col("q").desc(), "l_suppkey")
        billed = people.withColumn("order", F.row_number().over(order) - 1).where(
            F.col("order") < 5)
        crew = billed.groupBy("l_partkey").agg(
            F.sort_array(F.collect_list(F.struct(
                F.col("order"), F.col("l_suppkey").alias("id")))).alias("people"))
        sales = self.written(sold.join(crew, "l_partkey"), "sales")
        # Texts are shuffled whole, once and by the catalog id, by which the records are linked; split they are several times as large.
        texts = self.table("documents").select((F.col("doc_id") * 10).alias("tmdb_id"), "lang", "text")
        words = F.array_remove(F.split("text", r"\s+"), "")
        ids = F.array(*[F.lit(g) for g in feat.GENRE_IDS])
        brand = F.substring_index("p_brand", "#", -1).cast("int")
        genre_at = lambda i: F.coalesce(F.try_element_at(ids, i.cast("int") + 1), F.lit(99999))
        parts = self.table("part")
        joined = (parts.join(sales, parts.p_partkey == sales.l_partkey, "left").drop("l_partkey")
                  .join(votes, parts.p_partkey == votes.movieId, "left").drop("movieId")
                  .withColumn("tmdb_id", key * 10).join(texts, "tmdb_id", "left"))
        date = F.concat((F.lit(1980) + key % 41).cast("string"), F.lit("-06-15"))
        return joined.select(
            "tmdb_id",
            F.array(genre_at(F.length("p_type")), genre_at(brand % 20)).alias("genre_ids"),
            F.when(key % 11 == 0, 0.0).otherwise(F.col("p_size").cast("double")).alias("runtime"),
            F.when(key % 29 == 0, "").otherwise(date).alias("release_date"),
            F.coalesce("lang", F.lit("")).alias("original_language"),
            F.coalesce("vote_average", F.lit(0.0)).alias("vote_average"),
            F.coalesce("vote_count", F.lit(0)).alias("vote_count"),
            F.when(key % 7 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("budget"),
            F.when(key % 5 == 0, 0.0).otherwise(F.coalesce("revenue", F.lit(0.0))).alias("revenue"),
            F.array().cast("array<long>").alias("keyword_ids"),
            F.coalesce(words, F.array().cast("array<string>")).alias("keyword_names"),
            F.coalesce(F.transform(F.slice("people", 1, 1), lambda p: p["id"]),
                       F.array().cast("array<long>")).alias("director_ids"),
            F.coalesce(F.transform("people", lambda p: F.struct(
                p["id"].alias("id"), p["order"].cast("int").alias("order"))),
                F.array().cast("array<struct<id:long,order:int>>")).alias("cast"))

    def keep_records(self) -> DataFrame:
        """Records on disk, also for what is derived from them: for queries that read them more than once."""
        self.kept_at = new_folder(self.spark, "all-records")
        self.records.write.option("compression", "zstd").parquet(self.kept_at)
        self.records = self.spark.read.parquet(self.kept_at)
        return self.records

    def drop_records(self) -> None:
        """Delete the kept records, when all that reads them is written."""
        drop(self.spark, self.kept_at)

    @cached_property
    def content(self):
        """Content store of all linked records."""
        return build_content_store(self.spark, self.records, self.links, new_folder(self.spark, "content"))

    @cached_property
    def linked(self) -> DataFrame:
        """Records with their item; its id is the last one linked to the catalog id."""
        return self.written(feat.linked_records(self.records, self.one_item), "records")

    @cached_property
    def responses(self) -> DataFrame:
        """Raw JSON answers, with gaps: unknown jobs, missing ids, missing fields."""
        words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
        size = lambda w: F.length(w).cast("long")
        person = lambda w: F.when(size(w) % 9 != 4, size(w))
        docs = self.table("documents").withColumn("w", words)
        crew = F.transform("w", lambda w: F.struct(
            person(w).alias("id"),
            F.when(size(w) % 3 == 0, "Director").otherwise("Writer").alias("job")))
        cast = F.transform("w", lambda w: F.struct(
            person(w).alias("id"),
            F.when(size(w) != 7, size(w).cast("int")).alias("order")))
        named = F.transform("w", lambda w: F.struct(size(w).alias("id"), w.alias("name")))
        key = F.col("doc_id")
        detail = F.to_json(F.struct(
            F.array(F.struct(F.col("n_chars").alias("id")),
                    F.struct(F.lit(None).cast("long").alias("id"))).alias("genres"),
            F.when(key % 11 != 0, F.col("n_chars").cast("double")).alias("runtime"),
            F.col("lang").alias("original_language"),
            F.when(key % 3 != 0, key.cast("double")).alias("budget")))
        return docs.select(
            (key * 10).alias("tmdb_id"), F.when(key % 17 != 3, detail).alias("detail"),
            F.when(key % 19 != 2, F.to_json(F.struct(named.alias("keywords")))).alias("keywords"),
            F.to_json(F.struct(crew.alias("crew"), cast.alias("cast"))).alias("credits"))

    def weights(self, vocab: DataFrame, size: int) -> DataFrame:
        """Feature weights from a formula, the same in every engine."""
        f = F.col("feature_id")
        vec = F.array(*[(((31 * f + 17 * d) % 101 - 50) / 500.0) for d in range(size)])
        return vocab.select("feature_id", vec.alias("vec"), ((f % 13 - 6) / 100.0).alias("bias"))
