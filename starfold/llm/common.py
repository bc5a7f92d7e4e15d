"""What the operators share: reading, intermediate tables, null-safe keys."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from starfold.session import drop, new_folder


#: Rows that travel to a Python worker at a time. Texts may be long, and a batch is in memory on both sides.
BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's batch size for Python workers to ``BATCH_ROWS`` if it is higher."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(spark: SparkSession, df: DataFrame, purpose: str, path: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut, safe from lost executors."""
    bounded_batches(spark)
    path = path or new_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def narrowed(spark: SparkSession, df: DataFrame, path: str, *without: str) -> DataFrame:
    """What is still read of a table at ``path``, without the columns that are done with; the table goes."""
    kept = written(spark, df.drop(*without), "narrowed")
    drop(spark, path)
    return kept


def id_and_text(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The two columns an operator reads; all others, whatever their names, stay outside."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def none_of(schema: StructType | str) -> pa.Table:
    """No rows, for a group that a task has nothing to return for."""
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema).empty_table()
