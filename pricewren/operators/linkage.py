"""Staged record linkage: dictionary, exact, word similarity and trigram stages, each for what is left by the ones before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewren.functions.text import dose_tokens, search_text
from pricewren.operators.fuzzy import nearest, similarity_join, word_similarity_join
from pricewren.operators.topk import first_of
from pricewren.tables import written

#: Least similarity of the word and the trigram stages.
WORD, TRIGRAM = 0.88, 0.85


def barrier(query_dose: Column, catalog_dose: Column) -> Column:
    """Doses must be equal as sets; a catalog text without a dose passes."""
    return (F.size(catalog_dose) == 0) | (F.array_sort(query_dose) == F.array_sort(catalog_dose))


def link(queries: DataFrame, catalog: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """One row for each row of queries (id, name): id, ``item``, ``stage``, ``confidence``, ``closest``, ``closest_similarity``
    and ``reason``.

    catalog: item, name. dictionary: name (as search_text makes it), item. Names are compared as search_text; ties go
    to the least item. Every stage only sees what earlier ones left, writes what it found as a table, and is an
    equi-join: on names or on shared rare trigrams. A row without a match has no item, but the catalog item whose name
    has the greatest trigram similarity of all that share any trigram with it, for review, and why it isn't a match:
    NO_CANDIDATES, CONCENTRATION_MISMATCH (the closest item's doses differ) or BELOW_THRESHOLD.
    """
    named = queries.select(F.col("id").alias("row_id"), search_text(F.col("name")).alias("name"), dose_tokens(F.col("name")).alias("dose"))
    # rows with the same name and dose are linked once
    q = written(named.select("name", "dose").distinct().withColumn("id", F.struct("name", "dose")), "names")
    c = written(catalog.select("item", search_text(F.col("name")).alias("c_name"), dose_tokens(F.col("name")).alias("c_dose")), "catalog")
    done = []

    def take(found: DataFrame, tag: str) -> None:
        nonlocal q
        best = first_of(found, ["id"], ["stage", F.col("confidence").desc(), F.col("item")])
        got = written(best.select("id", "item", "stage", "confidence"), tag)
        done.append(got)
        q = q.join(got.select("id"), "id", "left_anti")

    of = lambda df, stage, score: df.select("id", "item", F.lit(stage).alias("stage"), score.alias("confidence"))
    ok = barrier(F.col("dose"), F.col("c_dose"))
    same = of(q.join(c, q["name"] == c["c_name"]).where(ok), "exact", F.lit(1.0))
    # dictionary and exact come in this order by their names too
    take(same if dictionary is None else same.unionByName(of(q.join(dictionary, "name"), "dictionary", F.lit(1.0))), "exact")
    distinct = lambda df, name: df.select(F.col(name).alias("name")).distinct().withColumn("key", F.col("name"))
    near = word_similarity_join(distinct(q, "name"), distinct(c, "c_name"), "key", "name", WORD)
    near = near.select(F.col("left_key").alias("name"), F.col("right_key").alias("c_name"), "similarity").join(q, "name").join(c, "c_name").where(ok)
    take(of(near, "word", F.col("similarity")), "word")
    pairs = similarity_join(q.select(F.col("id").alias("key"), "name"), c.select(F.col("item").alias("key"), F.col("c_name").alias("name")), "key", "name", TRIGRAM)
    fuzzy = pairs.select(F.col("left_key").alias("id"), F.col("right_key").alias("item"), "similarity").join(q.select("id", "dose"), "id").join(c.select("item", "c_dose"), "item").where(ok)
    take(of(fuzzy, "trigram", F.col("similarity")), "trigram")
    # of catalog rows with one name the least item stands for all
    one = c.groupBy("c_name").agg(F.min(F.struct("item", "c_dose")).alias("key")).select("key", F.col("c_name").alias("name"))
    closest = nearest(distinct(q, "name"), one.withColumn("key", F.struct("key.item", "name", "key.c_dose")), "key", "name")
    near = closest.select(F.col("left_key").alias("name"), "similarity", F.col("right_key.item").alias("closest"), F.col("right_key.c_dose").alias("c_dose"))
    reason = F.when(F.col("closest").isNull(), "NO_CANDIDATES").when(~ok, "CONCENTRATION_MISMATCH").otherwise("BELOW_THRESHOLD")
    out = q.join(near, "name", "left").select("id", F.lit(None).cast(catalog.schema["item"].dataType).alias("item"), F.lit("none").alias("stage"), F.lit(0.0).alias("confidence"), "closest", F.col("similarity").alias("closest_similarity"), reason.alias("reason"))
    for part in done:
        out = out.unionByName(part, allowMissingColumns=True)
    rows = named.withColumn("id", F.struct("name", "dose"))
    return rows.join(out, "id").select(F.col("row_id").alias("id"), "item", "stage", "confidence", "closest", "closest_similarity", "reason")
