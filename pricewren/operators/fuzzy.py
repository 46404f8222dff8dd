"""Similarity joins by trigrams: pairs meet on shared trigrams, rarest first, and are scored only where they can pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewren.functions.similarity import trigrams, word_similarity
from pricewren.operators.topk import first_of, top_k
from pricewren.tables import written

#: Thresholds that nearest() tries from the greatest down.
STEPS = (0.7, 0.5, 0.3, 0.15)
#: Right-hand texts with one trigram that are joined under one key; more are dealt over several.
HOT, MOST_DEALS = 20_000, 1024
#: nearest() tries no thresholds where there are no more pairs than this in all: it would save less than its rounds cost.
FEW_PAIRS = 250_000


def similarity_join(left: DataFrame, right: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """left_key, right_key and ``similarity`` (trigram Jaccard) of all pairs at threshold or above.

    A pair at threshold t shares a trigram among the first n - ceil(t n) + 1 of either side's n trigrams in any one
    order. The order is by how many right-hand texts have the trigram, so common ones rarely make pairs.
    """
    def sets(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(key).alias(name), trigrams(F.col(text)).alias("grams")).where(F.size("grams") > 0)

    a, b = sets(left, "left_key"), sets(right, "right_key")
    counts = b.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))

    def prefixes(df: DataFrame, name: str) -> DataFrame:
        ranked = df.select(name, F.size("grams").alias("size"), F.explode("grams").alias("g")).join(counts, "g", "left")
        sorted_ = ranked.groupBy(name).agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g"))).alias("grams"))
        length = (F.col("size") - F.ceil(F.col("size") * F.lit(threshold) - 1e-9) + 1).cast("int")
        return sorted_.select(name, "size", F.explode(F.slice("grams", F.lit(1), length)).alias("s")).select(name, "size", "s.g")

    x, y = prefixes(a, "left_key"), prefixes(b, "right_key").withColumnRenamed("size", "size2")
    fits = (F.col("size2") >= F.col("size") * F.lit(threshold) - 1e-9) & (F.col("size2") * F.lit(threshold) <= F.col("size") + 1e-9)
    pairs = x.join(y, "g").where(fits).select("left_key", "right_key").distinct()
    scored = pairs.join(a, "left_key").join(b.withColumnRenamed("grams", "grams2"), "right_key")
    both = F.size(F.array_intersect("grams", "grams2"))
    value = both / (F.size("grams") + F.size("grams2") - both)
    return scored.select("left_key", "right_key", value.alias("similarity")).where(F.col("similarity") >= threshold)


def word_similarity_join(left: DataFrame, right: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """left_key, right_key and ``similarity`` (word similarity of left in right) of all pairs at threshold or above.

    No stretch of a right-hand text holds more of the left-hand text's n trigrams than all of it does, so a pair at
    threshold t shares t n of them, and one of any n - ceil(t n) + 1: the rarest on the right are taken.
    """
    def sets(df: DataFrame, name: str, body: str, grams: str) -> DataFrame:
        return df.select(F.col(key).alias(name), F.col(text).alias(body), trigrams(F.col(text)).alias(grams)).where(F.size(grams) > 0)

    a, b = sets(left, "left_key", "left_text", "grams"), sets(right, "right_key", "right_text", "grams2")
    postings = b.select("right_key", F.explode("grams2").alias("g"))
    counts = postings.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    ranked = a.select("left_key", F.size("grams").alias("size"), F.explode("grams").alias("g")).join(counts, "g", "left")
    sorted_ = ranked.groupBy("left_key").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g"))).alias("s"))
    length = (F.col("size") - F.ceil(F.col("size") * F.lit(threshold) - 1e-9) + 1).cast("int")
    prefix = sorted_.select("left_key", F.explode(F.slice("s", F.lit(1), length)).alias("s")).select("left_key", "s.g")
    pairs = prefix.join(postings, "g").select("left_key", "right_key").distinct()
    both = pairs.join(a, "left_key").join(b, "right_key")
    held = both.where(F.size(F.array_intersect("grams", "grams2")) >= F.size("grams") * F.lit(threshold) - 1e-9)
    return held.select("left_key", "right_key", word_similarity(F.col("left_text"), F.col("right_text")).alias("similarity")).where(F.col("similarity") >= threshold)


def best_candidates(left: DataFrame, right: DataFrame, key: str, text: str, threshold: float, k: int) -> DataFrame:
    """The k most similar right-hand keys of each left-hand key, with their rank."""
    return top_k(similarity_join(left, right, key, text, threshold), ["left_key"], [F.col("similarity").desc(), F.col("right_key")], k)


def _numbered(counts: DataFrame) -> DataFrame:
    """g and r: a number that rises with how many texts have the trigram, and says in its remainder how often it is dealt."""
    deals = F.least(F.ceil(F.col("n") / HOT) - 1, F.lit(MOST_DEALS - 1))
    return counts.orderBy("n", "g").select("g", (F.monotonically_increasing_id() * MOST_DEALS + deals).alias("r"))


def _by_rarity(df: DataFrame, key: str, numbers: DataFrame) -> DataFrame:
    """key, size (all trigrams) and ``held``: the numbers of the trigrams that some right-hand text has, rarest first."""
    ranked = df.select(key, F.size("grams").alias("size"), F.explode("grams").alias("g")).join(numbers, "g")
    return ranked.groupBy(key).agg(F.max("size").alias("size"), F.array_sort(F.collect_list("r")).alias("held"))


def _meet(left: DataFrame, right: DataFrame, least: float, fits: Column) -> DataFrame:
    """left_key, right_key and similarity of the pairs that share a trigram among the ``look`` of either side (which begins at
    ``skip`` in held), may have a similarity of ``least`` and fit.

    A pair comes once: where its first shared trigram is. What it can share from there on is known from the places, and
    a pair for which that isn't enough isn't scored. A trigram of many right-hand texts has several keys, over which these
    are dealt; the left-hand texts go to each.
    """
    deals = (F.col("g") % MOST_DEALS + 1).cast("int")
    x = left.select("*", F.posexplode("look").alias("at", "g")).withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1)))
    y = right.select("right_key", F.col("size").alias("size2"), F.col("held").alias("held2"), F.col("look").alias("look2"), F.posexplode("look").alias("at2", "g"))
    y = y.withColumn("deal", F.pmod(F.xxhash64("right_key"), deals).cast("int"))
    shared = F.size(F.array_intersect("held", "held2"))
    rest = F.col("skip") + F.least(F.size("held") - F.col("skip") - F.col("at"), F.col("size2") - F.col("at2"))
    enough = rest >= (F.col("size") + F.col("size2")) * (least / (1 + least)) - 1e-9
    pairs = x.join(y, ["g", "deal"]).where(fits & enough & (F.get(F.array_intersect("look", "look2"), F.lit(0)) == F.col("g")))
    return pairs.select("left_key", "right_key", (shared / (F.col("size") + F.col("size2") - shared)).alias("similarity"))


def nearest(left: DataFrame, right: DataFrame, key: str, text: str, steps: tuple[float, ...] = STEPS) -> DataFrame:
    """left_key, right_key and similarity of the right-hand text with the greatest trigram similarity to each left-hand one.

    Ties go to the least right_key; texts that share no trigram with any have no row. Keys are unique on either side.

    It is exact without comparing all that share any trigram. Thresholds fall: what has a partner at a threshold has its
    best one among those, and leaves. At threshold t a pair shares t n of the n trigrams of either side, so it shares one
    of the rarest, and its sizes differ by a factor t at most. What no threshold settles first meets the texts that share
    one of the rarer half of its trigrams, which gives a least similarity s. Any other text shares some of the h
    commoner ones only, so that it has to be smaller than h / s + h - n to do better.
    """
    def sets(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(key).alias(name), trigrams(F.col(text)).alias("grams")).where(F.size("grams") > 0)

    a, b = sets(left, "left_key"), sets(right, "right_key")
    counts = written(_numbered(b.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))), "counts")
    rest, right_ = written(_by_rarity(a, "left_key", counts).withColumn("skip", F.lit(0)), "nearest-left"), written(_by_rarity(b, "right_key", counts), "nearest-right")
    best = lambda found: first_of(found, ["left_key"], [F.col("similarity").desc(), F.col("right_key")])
    none = F.slice("held", F.lit(1), F.lit(0))
    done, left_over = [], rest.count()
    for t in steps if left_over * right_.count() > FEW_PAIRS else ():
        # of n trigrams, of which h are held at all, one of the rarest h - t n + 1 is shared
        prefix = (F.size("held") - F.ceil(F.col("size") * F.lit(t) - 1e-9) + 1).cast("int")
        looked = lambda df, p=prefix: df.withColumn("look", F.when(p > 0, F.slice("held", F.lit(1), F.greatest(p, F.lit(0)))).otherwise(none))
        near = (F.col("size2") >= F.col("size") * t - 1e-9) & (F.col("size2") * t <= F.col("size") + 1e-9)
        found = written(best(_meet(looked(rest), looked(right_), t, near).where(F.col("similarity") >= t - 1e-9)), "nearest")
        done.append(found)
        rest = rest.join(found.select("left_key"), "left_key", "left_anti")
        left_over -= found.count()
        if not left_over:
            break
    else:
        half = F.ceil(F.size("held") / 2).cast("int")
        whole = right_.withColumn("look", F.col("held"))
        some = written(best(_meet(rest.withColumn("look", F.slice("held", F.lit(1), half)), whole, 0.0, F.lit(True))), "nearest")
        more = F.size("held") - half
        open_ = rest.join(some.select("left_key", F.col("similarity").alias("s")), "left_key").where(more >= F.col("s") * F.col("size") - 1e-9)
        commoner = open_.withColumn("look", F.slice("held", half + 1, F.greatest(more, F.lit(0)))).withColumn("skip", half)
        bound = F.size("look") / F.col("s") + F.size("look") - F.col("size") + 1e-6
        done += [some, best(_meet(commoner.withColumn("most", bound).drop("s"), whole, 0.0, F.col("size2") <= F.col("most")))]
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return best(out)
