"""Parquet and JSON sinks, and the model and content stores that live in them.

A model is a folder with ``tag=<tag>/epoch=<n>`` below each table, so a variant is a
partition filter and the newest complete epoch is always servable.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from starfold import schemas

DEFAULT_TAG = "default"


@dataclass(frozen=True)
class Model:
    """Item factors, content weights and the mean training rating of one variant."""

    items: DataFrame
    global_mean: float
    weights: DataFrame | None = None


@dataclass(frozen=True)
class ContentStore:
    """Item features with the vocabulary and statistics that produced them."""

    features: DataFrame
    vocab: DataFrame
    stats: DataFrame


def write_result(df: DataFrame, path: str, run_date: str, fmt: str = "parquet") -> None:
    """Result table of one run; running again on the same date replaces it."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(f"{path}/run_date={run_date}")


def append_records(records: DataFrame, path: str, run: str) -> None:
    """Lines of one run, compressed, in a folder of its own; running again under the same name replaces them."""
    records.write.mode("overwrite").option("compression", "gzip").json(f"{path}/{run}")


def write_content_store(store: ContentStore, path: str) -> None:
    """The parts of a store that are already stored tables elsewhere; vocabulary and statistics first."""
    store.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    store.stats.write.mode("overwrite").parquet(f"{path}/stats")
    store.features.write.mode("overwrite").parquet(f"{path}/features")


def load_content_store(spark: SparkSession, path: str) -> ContentStore:
    return ContentStore(spark.read.schema(schemas.ITEM_FEATURES).parquet(f"{path}/features"),
                        spark.read.schema(schemas.VOCAB).parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/stats"))


def epoch_path(path: str, table: str, tag: str, epoch: int) -> str:
    return f"{path}/{table}/tag={tag}/epoch={epoch}"


def complete_epoch(path: str, tag: str, epoch: int, config: DataFrame) -> None:
    """Write the config row of an epoch after its tables; readers ignore epochs without."""
    config.write.mode("overwrite").parquet(epoch_path(path, "config", tag, epoch))


def read_epoch(spark: SparkSession, path: str, table: str, tag: str, epoch: int) -> DataFrame:
    return spark.read.parquet(epoch_path(path, table, tag, epoch))


def _folder_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def last_config(spark: SparkSession, path: str, tag: str = DEFAULT_TAG):
    """Config row of the newest complete epoch of a variant, or ``None``."""
    if not _folder_exists(spark, f"{path}/config/tag={tag}"):
        return None
    configs = spark.read.option("basePath", f"{path}/config").parquet(f"{path}/config/tag={tag}")
    return configs.orderBy(F.col("epoch").desc()).first()


def available_tags(spark: SparkSession, path: str, wanted: list[str]) -> list[str]:
    """Of the wanted variants the trained ones; sweeps skip the others."""
    return [tag for tag in wanted if _folder_exists(spark, f"{path}/config/tag={tag}")]


def load_model(spark: SparkSession, path: str, tag: str | None = None) -> Model:
    tag = tag or DEFAULT_TAG
    config = last_config(spark, path, tag)
    if config is None:
        raise ValueError(f"no trained model with tag {tag!r} in {path}")
    weights = None
    if config["has_content"]:
        weights = spark.read.schema(schemas.FEATURE_WEIGHTS).parquet(epoch_path(path, "weights", tag, config["epoch"]))
    items = read_epoch(spark, path, "items", tag, config["epoch"])
    return Model(items.select("movieId", "vec", "bias"), config["global_mean"], weights)


def append_progress(spark: SparkSession, path: str, tag: str, row: dict) -> None:
    """The row of one epoch, in a folder of its own; a repeated epoch replaces its row."""
    names = [field.split()[0] for field in schemas.PROGRESS.split(", ")]
    spark.createDataFrame([tuple(row.get(name) for name in names)], schemas.PROGRESS).coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/progress/tag={tag}/at-{row['epoch']:06d}")


def read_progress(spark: SparkSession, path: str, tag: str = DEFAULT_TAG) -> DataFrame:
    return spark.read.schema(schemas.PROGRESS).option("recursiveFileLookup", True).parquet(f"{path}/progress/tag={tag}")


def forget(spark: SparkSession, path: str, tag: str) -> None:
    """Drop a variant's completion marks and progress, so that training starts over."""
    for table in ("config", "progress"):
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}/tag={tag}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
