"""Merging rows into a keyed table, and histories of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewren.operators.topk import first_of


def merge(target: DataFrame, source: DataFrame, keys: list[str], update: list[str] | None = None, when_matched: str = "update") -> DataFrame:
    """target after source is merged in by keys, as a table of target's columns.

    update: the columns that matched rows take from source (all others keep theirs); all if not given. With
    when_matched="ignore" matched rows stay. Keys must be unique in source (see dedup_last); null keys never match,
    so such rows of both sides stay. One full join, or one anti join where whole rows are replaced.
    """
    columns = target.columns
    source = source.select(*(F.col(c) if c in source.columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in columns))
    if when_matched == "ignore":
        return target.unionByName(source.join(target.select(*keys).distinct(), keys, "left_anti"))
    if update is None:
        return target.join(source.select(*keys).distinct(), keys, "left_anti").unionByName(source)
    t = target.select(*(F.col(c).alias(f"t_{c}") for c in columns), F.lit(True).alias("t_here"))
    s = source.select(*(F.col(c).alias(f"s_{c}") for c in columns), F.lit(True).alias("s_here"))
    on = [t[f"t_{k}"] == s[f"s_{k}"] for k in keys]
    both = t.join(s, on, "full_outer")

    def pick(c: str) -> Column:
        fresh = F.col("t_here").isNull() | F.lit(c in update) & F.col("s_here").isNotNull()
        return F.when(fresh, F.col(f"s_{c}")).otherwise(F.col(f"t_{c}")).alias(c)

    return both.select(*map(pick, columns))


def dedup_last(df: DataFrame, keys: list[str], position: list[Column]) -> DataFrame:
    """The last row of each key by position."""
    return first_of(df, keys, position)


def merge_sources(df: DataFrame, keys: list[str], position: list[Column], label: str, stamp: str) -> DataFrame:
    """The last row of each key, with ``labels`` (the sorted distinct labels of all, joined by commas) and the greatest stamp."""
    all_of = df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"), F.max(stamp).alias("latest"))
    return first_of(df, keys, position).join(all_of, keys)


def scd2(changes: DataFrame, key: list[str], start: str, values: list[str], tie: list[Column]) -> DataFrame:
    """A history from dated rows: a row where a value changes (or the key begins), open until the day before the next.

    Adds ``valid_to`` (null while open) and ``is_current``. Equal rows in succession are one period.
    """
    order = Window.partitionBy(*key).orderBy(F.col(start), *tie)
    marked = changes
    first = F.lag(F.lit(1)).over(order).isNull()
    differs = first
    for v in values:
        differs = differs | ~F.col(v).eqNullSafe(F.lag(v).over(order))
    kept = marked.withColumn("_new", differs).where("_new").drop("_new")
    after = F.lead(start).over(order)
    return kept.withColumn("valid_to", F.date_sub(after.cast("date"), 1)).withColumn("is_current", after.isNull())


def refresh(target: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """target with columns taken from source (one row a key) where it has a value, as an update with a join does."""
    new = source.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    fresh = [F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns]
    return target.join(new, key, "left").select(*fresh)


def backfill(target: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """JN-10: target with column filled from source where it was null; rows in which it stays null go."""
    new = source.select(key, F.col(column).alias("_new"))
    return target.join(new, key, "left").withColumn(column, F.coalesce(column, "_new")).drop("_new").where(F.col(column).isNotNull()).select(*target.columns)
