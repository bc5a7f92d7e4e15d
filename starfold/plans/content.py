"""Build the content store of a corpus: vocabulary, statistics and item features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starfold.operators import features as feat
from starfold.session import drop
from starfold.sources import store, tables


def build_content_store(spark: SparkSession, records: DataFrame, links: DataFrame, path: str,
                        min_director_films: int = feat.MIN_DIRECTOR_FILMS,
                        min_cast_films: int = feat.MIN_CAST_FILMS) -> store.ContentStore:
    """Fit on all linked records, encode them, and write the store to ``path``.

    The linked records and their term counts are written first: fitting and encoding
    read them several times, by column. Encoding uses the stored vocabulary and statistics.
    Both go when the features are written.
    """
    feat.linked_records(records, tables.catalog_to_item(links)).write.mode("overwrite").option("compression", "zstd").parquet(
        f"{path}/records")
    linked = spark.read.parquet(f"{path}/records")
    feat.term_counts(linked).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/term_counts")
    counts = spark.read.parquet(f"{path}/term_counts")
    feat.fit_vocab(linked, min_director_films, min_cast_films, counts).write.mode("overwrite").parquet(f"{path}/vocab")
    feat.fit_numeric(linked).write.mode("overwrite").parquet(f"{path}/stats")
    vocab, stats = spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/stats")
    feat.transform(linked, vocab, stats, counts).write.mode("overwrite").parquet(f"{path}/features")
    for table in ("records", "term_counts"):
        drop(spark, f"{path}/{table}")
    return store.load_content_store(spark, path)
