"""Incremental jobs: exports and content records that arrive over time.

Each micro-batch writes its own ``batch_id`` folder, so a batch that runs twice after
a failure replaces its own output and nothing else. Every ``COMPACT_EVERY`` batches the earlier ones are merged.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from starfold.operators import features as feat
from starfold.operators.foldin import DEFAULT_ALPHA
from starfold.sources import tables

from .state import USERS, TasteState
from .store import BatchStore, newest

COMPACT_EVERY = 32
FEATURES = "movieId long, feature_id int, value double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stream(df: DataFrame, handle, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (df.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings that a query takes over when it starts; they are as before afterwards."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def fold_in_stream(arrivals: DataFrame, factors: DataFrame, mean: float, path: str,
                   alphas: Sequence[float] = (DEFAULT_ALPHA,), partitions: int | None = None,
                   compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Keep the taste vectors of users current while their ratings arrive.

    arrivals: a stream of ``userId, movieId, rating, line_no``. A batch changes the state of the users it touches
    and solves those again against the frozen factors; no stored row is read. Of a user's ratings of an item
    the one with the latest line counts, whenever it arrives. Ratings of unknown items add nothing.
    partitions: of the state (default: the session's); a stream keeps the number it began with.
    Reading the result: :func:`current_users`.
    """
    spark = arrivals.sparkSession
    users = BatchStore(spark, f"{path}/users")
    known = factors.select("movieId", F.col("vec").cast("array<double>").alias("vec"), F.col("bias").cast("double").alias("bias"))
    rows = arrivals.join(known, "movieId", "left").select(
        F.coalesce(F.col("userId").cast("long"), F.lit(0)).alias("userId"), F.col("userId").isNull().alias("nobody"), "movieId", F.col("rating").cast("double").alias("rating"), F.col("line_no").cast("long").alias("line_no"), "vec", "bias")
    # Keys without nulls: among null ids pandas turns the others to floats, and the state takes all of these for one user.
    solved = rows.groupBy("userId", "nobody").transformWithStateInPandas(TasteState(float(mean), alphas), USERS, "Update", "None")

    def handle(batch: DataFrame, batch_id: int) -> None:
        users.write(batch, batch_id)
        if batch_id and batch_id % compact_every == 0:
            users.compact(USERS, batch_id - 1, lambda r: newest(r, "userId", "alpha"))

    count = str(partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    with _settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKS, spark__sql__shuffle__partitions=count):
        return _stream(solved, handle, f"{path}/checkpoint", "update")


def current_users(spark: SparkSession, path: str) -> DataFrame:
    """Newest solution of every user."""
    return newest(BatchStore(spark, f"{path}/users").read(USERS), "userId", "alpha").drop("batch_id")


def record_stream(arrivals: DataFrame, key: str, order: str, path: str, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Append records whose key is not stored yet; in a batch the last of a key counts."""
    store, schema, names = BatchStore(arrivals.sparkSession, f"{path}/records", key), _ddl(arrivals), arrivals.columns

    def handle(batch: DataFrame, batch_id: int) -> None:
        new = tables.latest_records(batch, key, order)
        if batch_id > 0:
            stored = store.read(schema, batch_id, store.touched(batch))
            new = new.join(stored.select(key), key, "left_anti")
        store.write(new.select(*names), batch_id)
        if batch_id and batch_id % compact_every == 0:
            store.compact(schema, batch_id - 1)

    return _stream(arrivals, handle, f"{path}/checkpoint")


def stored_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return BatchStore(spark, f"{path}/records", "bucket").read(schema).drop("batch_id")


def encode_stream(arrivals: DataFrame, links: DataFrame, vocab: DataFrame, stats: DataFrame,
                  path: str, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Encode arriving content records with the saved vocabulary and statistics.

    A record that arrives again in the same batch counts once; one that arrives later is encoded
    again, and :func:`current_features` has the newest.
    """
    one_item = tables.catalog_to_item(links)
    store = BatchStore(arrivals.sparkSession, f"{path}/features")

    def handle(batch: DataFrame, batch_id: int) -> None:
        once = batch.dropDuplicates(["tmdb_id"])
        rows = feat.transform(feat.linked_records(once, one_item), vocab, stats)
        store.write(rows.select(F.col("movieId").cast("long").alias("movieId"), F.col("feature_id").cast("int").alias("feature_id"),
                                F.col("value").cast("double").alias("value")), batch_id)
        if batch_id and batch_id % compact_every == 0:
            store.compact(FEATURES, batch_id - 1, lambda r: newest(r, "movieId"))

    return _stream(arrivals, handle, f"{path}/checkpoint")


def current_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of every item, from the newest batch that held it."""
    return newest(BatchStore(spark, f"{path}/features").read(FEATURES), "movieId").drop("batch_id")
