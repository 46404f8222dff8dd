"""Incremental merges: rows above a high-water mark, and files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.operators.merge import dedup_last, merge


def above_mark(df: DataFrame, column: str, mark) -> DataFrame:
    """Rows whose column is above mark; all where there is no mark. The filter reaches the scan."""
    return df if mark is None else df.where(F.col(column) > F.lit(mark))


def replay(spark: SparkSession, folder: str, schema: str, checkpoint: str, each: Callable[[DataFrame, int], None], files: int = 1) -> None:
    """Hand every batch of new Parquet files in folder to ``each`` and stop when all are done; restarts go on from checkpoint."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merging(spark: SparkSession, table: str, keys: list[str], position: list[Column]) -> Callable[[DataFrame, int], None]:
    """A batch handler that merges rows by keys into a versioned Parquet table.

    A version is a folder named after its batch; a batch that runs again writes its own version again, from the one
    before, so it is idempotent. latest() reads the last.
    """
    def each(batch: DataFrame, number: int) -> None:
        fresh = dedup_last(batch, keys, position)
        before = latest(spark, table, number - 1)
        whole = fresh if before is None else merge(before, fresh, keys)
        whole.write.mode("overwrite").parquet(f"{table}/version={number:012d}")

    return each


def latest(spark: SparkSession, table: str, number: int | None = None) -> DataFrame | None:
    """The table's version of a batch, or the last; None before the first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return None
    found = sorted(n for s in system.listStatus(path) if (n := s.getPath().getName()).startswith("version=") and (number is None or int(n[8:]) <= number))
    return spark.read.parquet(f"{table}/{found[-1]}") if found else None


def session_counts(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions by user with a watermark, for batch and stream alike (an extension)."""
    return events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
