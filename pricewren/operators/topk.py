"""Best rows by key. Spark limits groups within each task before the shuffle, so a hot key sends k rows a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key in an order that should end in a unique column; adds rank from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def first_of(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    return top_k(df, keys, order, 1, "_rank").drop("_rank")


def margin(df: DataFrame, key: str, score: str, tie: list[Column]) -> DataFrame:
    """The best row of each key with ``second`` (the next score, 0.0 where there is none) and ``margin``."""
    best_two = top_k(df, [key], [F.col(score).desc(), *tie], 2, "_rank")
    second = best_two.where("_rank = 2").select(key, F.col(score).alias("second"))
    out = best_two.where("_rank = 1").drop("_rank").join(second, key, "left")
    return out.withColumn("second", F.coalesce("second", F.lit(0.0))).withColumn("margin", F.col(score) - F.col("second"))
