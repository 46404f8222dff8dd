"""A keyed Parquet table in buckets, of which a merge rewrites only those that its rows belong to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.operators.merge import dedup_last, merge
from pricewren.tables import hadoop_path

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    """Rows of ``schema`` in the folder ``path``, dealt by a hash of ``keys`` over ``buckets`` partitions.

    A merge is computed from the buckets that it touches and staged beside the table as a whole; then Spark's dynamic
    partition overwrite puts it in their place. A merge that was staged but not put in place - the driver was lost - is
    put in place by the next call, so that no bucket is left without its rows. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets
        self.staged = f"{self.path}.staged"

    def _there(self, path: str) -> bool:
        found, system = hadoop_path(self.spark, path)
        return system.exists(found)

    def _with_bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _files(self) -> DataFrame:
        whole = f"{self.schema}, bucket int"
        return self.spark.read.schema(whole).parquet(self.path) if self._there(self.path) else self.spark.createDataFrame([], whole)

    def recover(self) -> None:
        """Put a merge in place that was staged as a whole; remove one that wasn't."""
        if self._there(f"{self.staged}/_SUCCESS"):
            self._place()
        elif self._there(self.staged):
            self._remove_staged()

    def _place(self) -> None:
        staged = self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.staged)
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        self._remove_staged()

    def _remove_staged(self) -> None:
        found, system = hadoop_path(self.spark, self.staged)
        system.delete(found, True)

    def read(self) -> DataFrame:
        self.recover()
        return self._files().drop("bucket")

    def merge(self, rows: DataFrame, how: Merge | None = None) -> list[int]:
        """Merge rows in and return the buckets that were rewritten.

        how(current, rows) gives the new rows of the buckets that rows touch; without it, rows replace those with equal
        keys. It must not remove a bucket's last row. Merging the same rows twice must be the same as once.
        """
        self.recover()
        fresh = self._with_bucket(rows)
        touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())
        if not touched:
            return []
        current = self._files().where(F.col("bucket").isin(touched)).drop("bucket")
        merged = (how or (lambda a, b: merge(a, b, self.keys)))(current, rows)
        names = [f.name for f in self._files().drop("bucket").schema]
        self._with_bucket(merged.select(*names)).repartition("bucket").write.mode("overwrite").parquet(self.staged)
        self._place()
        return touched


def merging_into(table: KeyedTable, position: list[Column]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch handler that merges the last row of each key by position; a batch that runs again changes nothing."""

    def each(batch: DataFrame, number: int) -> None:
        table.merge(dedup_last(batch, table.keys, position))

    return each
