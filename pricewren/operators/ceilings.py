"""Regulated ceilings: the current one of each item and the history of all, brought up to date by one circular after another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewren.operators.merge import dedup_last
from pricewren.streaming.keyed import KeyedTable

#: Rows of kind current (valid_to null) and history in one table, so that both change together.
SCHEMA = "item string, kind string, price double, circular string, valid_from date, valid_to date"


def ceilings_table(spark, path: str, buckets: int = 64) -> KeyedTable:
    return KeyedTable(spark, path, SCHEMA, ["item"], buckets)


def apply_circular(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """stored (SCHEMA) after rows (item, price, circular, valid_from; an item once) are applied.

    Every row becomes its item's current ceiling. Where that has another price or circular than before, or the item is
    new, open rows of its history end the day before, and the row is added to it, open, unless its item, circular and
    first day are there already. What has not changed leaves the history alone, so a circular that is applied again
    changes nothing.
    """
    current, history = stored.where("kind = 'current'"), stored.where("kind = 'history'")
    before = current.select("item", F.lit(True).alias("known"), F.col("price").alias("old_price"), F.col("circular").alias("old_circular"))
    both = rows.select("item", "price", "circular", "valid_from").join(before, "item", "left")
    same = F.col("known").isNotNull() & F.col("price").eqNullSafe(F.col("old_price")) & (F.coalesce("circular", F.lit("")) == F.coalesce("old_circular", F.lit("")))
    changed = both.where(~same).select("item", "price", "circular", "valid_from")
    ends = changed.select("item", F.date_sub("valid_from", 1).alias("end"))
    closed = history.join(ends, "item", "left").withColumn("valid_to", F.coalesce("valid_to", "end")).drop("end")
    added = changed.join(history.select("item", "circular", "valid_from"), ["item", "circular", "valid_from"], "left_anti")
    as_kind = lambda df, kind: df.withColumn("kind", F.lit(kind)).withColumn("valid_to", F.lit(None).cast("date"))
    kept = current.join(rows.select("item"), "item", "left_anti")
    out = kept.unionByName(as_kind(rows.select("item", "price", "circular", "valid_from"), "current")).unionByName(closed)
    return out.unionByName(as_kind(added, "history"))


def load_circular(table: KeyedTable, rows: DataFrame) -> list[int]:
    """Apply a circular to a stored table; of rows that repeat an item the last by ``place`` counts (else the dearest). Returns the buckets rewritten."""
    order = [F.col("place").desc()] if "place" in rows.columns else []
    once = dedup_last(rows.where("item is not null"), ["item"], [*order, F.col("price").desc_nulls_last(), F.col("circular"), F.col("valid_from")])
    return table.merge(once.select("item", "price", "circular", "valid_from"), apply_circular)
