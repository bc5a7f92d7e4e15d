"""Batch folders of a stream's results, merged into larger files now and then.

A batch writes ``batch_id=<n>``, and writes it again if it runs again. ``compact`` merges all batches up to one
into a new folder and then sets a mark, a file that names the folder and the last batch in it. Readers take the
newest mark's folder and the batches after it. So a merge that fails half-way leaves a folder nobody
reads, and one that fails after its mark has only not tidied up. What a mark has made superfluous goes with
the mark after it, so readers that began before a mark still find their files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of a keyed store lie in folders by key, so that a batch reads only the folders it touches.
BUCKETS = 256


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class BatchStore:
    """Result batches below ``path``; with a ``key`` their rows lie in folders by key."""

    def __init__(self, spark: SparkSession, path: str, key: str | None = None):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    # ------------------------------------------------------------ files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place = self._path(folder)
        return [s.getPath().getName() for s in self._files().listStatus(place)] if self._files().exists(place) else []

    def batches(self) -> list[int]:
        """Numbers of the batch folders that are there."""
        return sorted(int(n.removeprefix("batch_id=")) for n in self._names("") if n.startswith("batch_id="))

    def marks(self) -> list[tuple[int, str]]:
        """``last batch, folder`` of all marks, newest last."""
        return sorted((int(last), folder) for last, _, folder in (n.partition(".") for n in self._names("_marks") if not n.startswith((".", "_"))))

    # ------------------------------------------------------------ rows

    def _put(self, df: DataFrame, folder: str) -> None:
        if self.key is None:
            df.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        else:
            df.withColumn("bucket", bucket_of(self.key)).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/{folder}")

    def write(self, df: DataFrame, batch_id: int) -> None:
        """Store a batch, in place of what an earlier run of it left."""
        self._put(df, f"batch_id={batch_id}")

    def read(self, schema: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Rows with their ``batch_id``: of all batches, or of those before one, and of some buckets."""
        last, merged = (self.marks() or [(-1, "")])[-1]
        later = [b for b in self.batches() if b > last and (before is None or b < before)]
        keyed = ", bucket int" if self.key else ""
        parts = []
        if merged and (before is None or last < before):
            parts.append(self.spark.read.schema(f"{schema}, batch_id long{keyed}").parquet(f"{self.path}/_merged/{merged}"))
        if later:
            parts.append(self.spark.read.schema(f"{schema}{keyed}, batch_id long").option("basePath", self.path)
                         .parquet(*[f"{self.path}/batch_id={b}" for b in later]))
        if not parts:
            return self.spark.createDataFrame([], f"{schema}, batch_id long")
        if buckets is not None:
            parts = [p.where(F.col("bucket").isin(buckets)) for p in parts]
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return rows.drop("bucket") if self.key else rows

    def touched(self, df: DataFrame) -> list[int]:
        """Buckets with a key of ``df``, at most ``BUCKETS``."""
        return [row[0] for row in df.select(bucket_of(self.key)).distinct().collect()]

    # ------------------------------------------------------------ merging

    def merge(self, schema: str, last: int, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> str:
        """Write all rows up to batch ``last`` that ``keep`` lets through to a folder that no reader sees yet."""
        folder = uuid.uuid4().hex
        self._put(keep(self.read(schema, last + 1)), f"_merged/{folder}")
        return folder

    def mark(self, last: int, folder: str) -> None:
        """Let readers use a merged folder, and remove what only readers before the last mark needed."""
        before = self.marks()
        files, draft = self._files(), self._path(f"_marks/.{folder}")
        files.create(draft, True).close()
        if not files.rename(draft, self._path(f"_marks/{last}.{folder}")):
            raise OSError(f"cannot set the mark of {folder}")
        if before:
            old, used = before[-1]
            for batch in self.batches():
                if batch <= old:
                    files.delete(self._path(f"batch_id={batch}"), True)
            for number, name in before[:-1]:
                files.delete(self._path(f"_marks/{number}.{name}"), False)
            for name in self._names("_merged"):
                if name not in (used, folder):
                    files.delete(self._path(f"_merged/{name}"), True)

    def compact(self, schema: str, last: int, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """Merge all batches up to ``last``; to be called by the writer only."""
        if any(b <= last for b in self.batches()) and last > max([-1, *(number for number, _ in self.marks())]):
            self.mark(last, self.merge(schema, last, keep))


def newest(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows with ``batch_id`` those of the newest batch that has their key."""
    last = rows.groupBy(*keys).agg(F.max("batch_id").alias("batch_id"))
    return rows.join(last, [*keys, "batch_id"], "left_semi")
