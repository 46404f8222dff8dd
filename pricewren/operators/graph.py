"""The catalog as a graph: items, makers and substances as vertex tables, edges by keys, merged by keys, and optional matches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.operators.merge import merge

ITEMS = "item string, product string, state string, active boolean"


@dataclass(frozen=True)
class Graph:
    items: DataFrame
    makers: DataFrame
    substances: DataFrame
    made_by: DataFrame
    contains: DataFrame


def empty_graph(spark: SparkSession) -> Graph:
    table = lambda schema: spark.createDataFrame([], schema)
    return Graph(table(ITEMS), table("maker string"), table("substance string"), table("maker string, item string"), table("substance string, item string"))


def substances_of(c: Column) -> Column:
    """Substances of a text in capitals, divided at +, / and the words Y and CON: distinct ones, in order."""
    text = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"\s+", " ")
    parts = F.split(F.regexp_replace(text, r"\s*(\+|/|\bY\b|\bCON\b)\s*", "|"), r"\|")
    return F.array_distinct(F.filter(F.transform(parts, F.trim), lambda x: x != ""))


def golden_rows(rows: DataFrame) -> DataFrame:
    """item, product, state, active, maker and substances of catalog rows: cum, producto, estado_origen, estadocum, titular, principio_activo_raw.

    A blank origin gives way to the row's state. Active is what says vigente or activo and neither vencid, inactiv nor
    cancelad. A blank maker is null.
    """
    trim = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    state = F.trim(F.coalesce(F.when(F.trim("estado_origen") != "", F.col("estado_origen")), F.col("estadocum")))
    said = F.lower(F.coalesce("estado_origen", "estadocum", F.lit("")))
    active = said.rlike("vigente|activo") & ~said.rlike("vencid|inactiv|cancelad")
    return rows.select(F.trim("cum").alias("item"), trim("producto").alias("product"), state.alias("state"), active.alias("active"), F.nullif(trim("titular"), F.lit("")).alias("maker"), substances_of(F.col("principio_activo_raw")).alias("substances"))


def merge_rows(graph: Graph, rows: DataFrame) -> Graph:
    """The graph after golden rows (an item once) are merged in: items take new properties, vertices and edges are added where they are missing, and none is removed."""
    add = lambda table, new, keys: merge(table, new.distinct(), keys, when_matched="ignore")
    made = rows.where("maker is not null").select("maker", "item")
    held = rows.select(F.explode("substances").alias("substance"), "item")
    return Graph(
        merge(graph.items, rows.select("item", "product", "state", "active"), ["item"]), add(graph.makers, made.select("maker"), ["maker"]), add(graph.substances, held.select("substance"), ["substance"]),
        add(graph.made_by, made, ["maker", "item"]), add(graph.contains, held, ["substance", "item"]),
    )


def neighbours(graph: Graph) -> DataFrame:
    """Every item with its makers and substances, one hop away, collected in order; empty where it has none."""
    gathered = lambda edges, name: edges.groupBy("item").agg(F.array_sort(F.collect_set(name)).alias(f"{name}s"))
    out = graph.items.join(gathered(graph.made_by, "maker"), "item", "left").join(gathered(graph.contains, "substance"), "item", "left")
    none = F.array().cast("array<string>")
    return out.withColumn("makers", F.coalesce("makers", none)).withColumn("substances", F.coalesce("substances", none))


def maker_substances(graph: Graph) -> DataFrame:
    """Every maker with the substances of its items, two hops away: in order, each with the number of items, counted before they are collected."""
    pairs = graph.made_by.join(graph.contains, "item").groupBy("maker", "substance").agg(F.count(F.lit(1)).alias("n"))
    lists = pairs.groupBy("maker").agg(F.array_sort(F.collect_list(F.struct("substance", "n"))).alias("held"))
    none = F.array().cast("array<struct<substance: string, n: bigint>>")
    return graph.makers.join(lists, "maker", "left").select("maker", F.coalesce("held", none).alias("held"))
