"""Names of medicines matched to a catalog by what is read in them: ingredients, form and concentration, with hard barriers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.functions import drugs
from pricewren.functions.similarity import similarity
from pricewren.functions.text import ascii_fold
from pricewren.operators.fuzzy import nearest, similarity_join, word_similarity_join
from pricewren.operators.topk import first_of
from pricewren.tables import hadoop_path, written

# Least similarities, and the scope of names that belong to no hospital.
WORD, TRIGRAM, EVERYWHERE = 0.88, 0.85, "GLOBAL"


def dictionary_key(name: Column) -> Column:
    """A name as resolutions are kept and looked up: folded, lower case, white space squeezed."""
    return F.trim(F.regexp_replace(F.trim(ascii_fold(F.coalesce(name, F.lit("")))), r"\s+", " "))


def latest_resolutions(resolutions: DataFrame) -> DataFrame:
    """hospital, key, item and confidence: of all resolutions of a hospital's text the last by resolved_at (then the greatest item).

    resolutions: hospital, name, item, resolved_at, and confidence (1 where it is missing or null).
    """
    confidence = F.coalesce("confidence", F.lit(1.0)) if "confidence" in resolutions.columns else F.lit(1.0)
    rows = resolutions.select(F.coalesce("hospital", F.lit(EVERYWHERE)).alias("hospital"), dictionary_key(F.col("name")).alias("key"), "item", confidence.cast("double").alias("confidence"), "resolved_at")
    return first_of(rows, ["hospital", "key"], [F.col("resolved_at").desc_nulls_last(), F.col("item").desc()]).select("hospital", "key", "item", "confidence")


def match_names(queries: DataFrame, catalog: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """One row for each row of queries: id, item, stage, confidence, closest, closest_similarity, reason and warnings.

    queries: id, name, and optionally hospital and ``error`` (what was wrong with the row). catalog: item, ingredient,
    form, concentration, and optionally active. resolutions: as latest_resolutions() reads them.

    Stages, each for what the ones before left; ties go to the least item:
    ERROR: the row has an error, which is its reason. NO_MATCH with INPUT_NOT_MATCHABLE: what was read can't be trusted.
    SYNONYM_DICT: a resolution of the hospital's own. EXACT: the same ingredients and form, or ingredients with a word
    similarity of WORD or more in the catalog's text, whose form contains the name's. FUZZY_INN_SAFE: a trigram similarity
    of TRIGRAM or a word similarity of WORD, where forms belong to one route. Concentrations have to be equal in EXACT and
    FUZZY_INN_SAFE: a name without one never passes, a catalog text that can't be read always does. NO_MATCH: the closest
    item by trigrams for review, and CONCENTRATION_MISMATCH; NO_CANDIDATES where there is none, as for combinations.
    """
    have = lambda df, name, default: F.col(name) if name in df.columns else default
    none = F.lit(None).cast("string")
    rows = queries.select("id", F.coalesce(F.col("name").cast("string"), F.lit("")).alias("name"), F.coalesce(have(queries, "hospital", none), F.lit(EVERYWHERE)).alias("hospital"), F.nullif(have(queries, "error", none), F.lit("")).alias("error"))
    read = drugs.parse_names(rows.where("error is null").select("name"), "name")
    # of a combination the first concentration counts, of a single substance the most precise one
    own = F.when(F.col("is_combo"), F.get("concentrations", F.lit(0))).otherwise(F.when(F.size("concentrations") > 0, F.col("concentration")))
    q = written(read.select("name", F.col("inn_query").alias("inn"), F.coalesce("form", F.lit("")).alias("form"), "form_group", "is_combo", "is_matchable", own.alias("conc"), "warnings"), "read-names")
    live = catalog.where(F.coalesce("active", F.lit(True))) if "active" in catalog.columns else catalog
    low = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
    c = written(live.select("item", low("ingredient").alias("substance"), low("form").alias("c_form"), F.col("form").alias("c_raw"), drugs.catalog_concentration(F.col("concentration")).alias("c_conc")), "read-catalog")
    item_type = catalog.schema["item"].dataType

    dose_ok = F.col("conc").isNotNull() & drugs.same_concentration(F.col("conc"), F.col("c_conc"))
    pairs = rows.where("error is null").select("hospital", "name").distinct()
    resolved = None
    if resolutions is not None:
        known = latest_resolutions(resolutions)
        keyed = pairs.withColumn("key", dictionary_key(F.col("name"))).join(q.where("is_matchable").select("name"), "name")
        resolved = written(keyed.join(known, ["hospital", "key"]).select("hospital", "name", F.col("item").cast(item_type).alias("item"), F.lit("SYNONYM_DICT").alias("stage"), "confidence"), "resolved")
        pairs = pairs.join(resolved.select("hospital", "name"), ["hospital", "name"], "left_anti")
    rest = written(q.where("is_matchable").join(pairs.select("name").distinct(), "name", "left_semi"), "open-names")
    done = []

    def take(found: DataFrame, stage: str) -> None:
        nonlocal rest
        got = written(first_of(found, ["name"], [F.col("score").desc(), F.col("item")]).select("name", "item", F.lit(stage).alias("stage"), (F.lit(1.0) if stage == "EXACT" else F.col("score")).alias("confidence")), stage.lower())
        done.append(got)
        rest = rest.join(got.select("name"), "name", "left_anti")

    same = rest.join(c, (rest["inn"] == c["substance"]) & (rest["form"] == c["c_form"])).where(dose_ok)
    take(same.withColumn("score", F.lit(1.0)), "EXACT")
    asked = rest.select(F.col("inn").alias("key")).distinct().withColumn("text", F.col("key"))
    texts = c.select(F.col("substance").alias("key")).distinct().withColumn("text", F.col("key"))
    by_word = written(word_similarity_join(asked, texts, "key", "text", WORD).select(F.col("left_key").alias("inn"), F.col("right_key").alias("substance"), F.col("similarity").alias("score")), "by-word")
    inside = (F.col("form") == "") | F.contains(F.col("c_form"), F.col("form"))
    take(rest.join(by_word, "inn").join(c, "substance").where(inside & dose_ok), "EXACT")
    by_trigram = similarity_join(asked, texts, "key", "text", TRIGRAM).select(F.col("left_key").alias("inn"), F.col("right_key").alias("substance"), F.col("similarity").alias("score"))
    # the greater of both similarities; where only the word's reaches its threshold the trigrams' may still be compared
    whole = by_word.withColumn("score", F.greatest("score", similarity(F.col("inn"), F.col("substance"))))
    either = by_trigram.unionByName(whole).groupBy("inn", "substance").agg(F.max("score").alias("score"))
    take(rest.join(either, "inn").join(c, "substance").where(drugs.form_barrier(F.col("form_group"), F.col("c_raw")) & dose_ok), "FUZZY_INN_SAFE")

    alone = rest.where(~F.contains("inn", F.lit(" / "))).select(F.col("inn").alias("key")).distinct().withColumn("text", F.col("key"))
    least = c.groupBy("substance").agg(F.min("item").alias("least")).select(F.struct("least", "substance").alias("key"), F.col("substance").alias("text"))
    close = nearest(alone, least, "key", "text").select(F.col("left_key").alias("inn"), F.col("right_key.least").alias("closest"), F.col("similarity").alias("closest_similarity"))
    reason = F.when(F.col("closest").isNull(), "NO_CANDIDATES").otherwise("CONCENTRATION_MISMATCH")
    nothing = F.lit(None).cast(item_type).alias("item")
    out = rest.join(close, "inn", "left").select("name", nothing, F.lit("NO_MATCH").alias("stage"), F.lit(0.0).alias("confidence"), "closest", "closest_similarity", reason.alias("reason"))
    refused = q.where("not is_matchable").select("name", nothing, F.lit("NO_MATCH").alias("stage"), F.lit(0.0).alias("confidence"), F.lit("INPUT_NOT_MATCHABLE").alias("reason"))
    for part in (refused, *done):
        out = out.unionByName(part, allowMissingColumns=True)
    scoped = rows.where("error is null")
    columns = ["id", "item", "stage", "confidence", "closest", "closest_similarity", "reason", "warnings"]
    failed = rows.where("error is not null").select("id", nothing, F.lit("ERROR").alias("stage"), F.lit(0.0).alias("confidence"), F.col("error").alias("reason"))
    if resolved is None:
        found = scoped.join(out, "name")
    else:
        first = resolved.select("hospital", "name", F.struct("item", "stage", "confidence").alias("own"))
        general = out.select("name", F.struct("item", "stage", "confidence", "closest", "closest_similarity", "reason").alias("any"))
        mine = F.col("own").isNotNull()
        picked = [F.when(mine, F.col(f"own.{x}")).otherwise(F.col(f"any.{x}")).alias(x) for x in ("item", "stage", "confidence")]
        picked += [F.when(~mine, F.col(f"any.{x}")).alias(x) for x in ("closest", "closest_similarity", "reason")]
        found = scoped.join(general, "name", "left").join(first, ["hospital", "name"], "left").select("id", "name", *picked)
    return found.join(q.select("name", "warnings"), "name", "left").select(*columns).unionByName(failed, allowMissingColumns=True)


RESOLUTIONS = "hospital string, name string, item string, confidence double, resolved_by string, resolved_at timestamp"


def record_resolutions(rows: DataFrame, path: str) -> None:
    """Append what people have resolved: hospital (null: everywhere), name and item, and optionally confidence, resolved_by and resolved_at (now)."""
    have = lambda name, kind, default: F.coalesce(F.col(name).cast(kind), default) if name in rows.columns else default
    kept = rows.select(
        F.coalesce("hospital", F.lit(EVERYWHERE)).alias("hospital"), "name", F.col("item").cast("string").alias("item"), have("confidence", "double", F.lit(1.0)).alias("confidence"),
        have("resolved_by", "string", F.lit("HUMAN")).alias("resolved_by"), have("resolved_at", "timestamp", F.current_timestamp()).alias("resolved_at"),
    )
    kept.write.mode("append").parquet(path)


def recorded_resolutions(spark: SparkSession, path: str) -> DataFrame:
    """All that record_resolutions() has appended; no rows before the first."""
    found, system = hadoop_path(spark, path)
    return spark.read.schema(RESOLUTIONS).parquet(path) if system.exists(found) else spark.createDataFrame([], RESOLUTIONS)
