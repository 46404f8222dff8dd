"""Full-text search by the tokens of each row: matches, BM25 and cover-density ranks, and a fallback by parts of words."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewren.functions.catalog import STOP_WORDS
from pricewren.functions.text import LETTERS, tokens
from pricewren.tables import written


def matches_all(text: Column, words: list[str]) -> Column:
    """Whether every word is among the text's tokens."""
    return F.forall(F.array(*map(F.lit, words)), lambda w: F.array_contains(tokens(text), w))


def safe_words(query: str, most: int = 18) -> list[str]:
    """FN-RNK-02: the first ``most`` words of a query of which only a-z, digits and spaces are left, in lower case."""
    return re.sub(r"[^a-zA-Z0-9 ]+", " ", query).lower().split()[:most]


def bm25(docs: DataFrame, key: str, text: str, words: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key and ``score`` of every document that has any of words, which are tokens: runs of letters and digits.

    One pass counts lengths and the words' frequencies inside each row, without lists of tokens, and writes these numbers
    alone; the only shuffles are of sums, so nothing grows with the collection but the result.
    """
    words = sorted(set(words))
    sign = r"[\p{L}\p{N}]"
    times = lambda w: F.regexp_count("low", F.lit(rf"(?<!{sign}){re.escape(w)}(?!{sign})"))
    low = docs.select(key, F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("low"))
    counted = written(low.select(key, F.regexp_count("low", F.lit(rf"{sign}+")).alias("length"), *(times(w).alias(f"tf{i}") for i, w in enumerate(words))), "bm25")
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words)))).first()
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = F.log(1 + (F.lit(float(stats["n"])) - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.lit(float(stats["mean"] or 1.0))))
    any_hit = F.greatest(F.lit(0), *(F.col(f"tf{i}") for i in range(len(words)))) > 0
    return counted.where(any_hit).select(key, score.alias("score"))


def contains_all(text: Column, parts: list[str]) -> Column:
    out = F.lit(True)
    for part in parts:
        out = out & F.contains(F.lower(text), F.lit(part.lower()))
    return out


def like_inside(text: Column, part: str) -> Column:
    """FLT-02: whether text holds part, letter case aside, where part's % and _ stand for any signs and any one sign."""
    return F.lower(F.coalesce(text, F.lit(""))).like(f"%{part.strip().lower()}%")


def best_hits(ranked: DataFrame, key: str, rank: str = "rank", distance: str = "distance", k: int = 10) -> DataFrame:
    """SRT-01: the k first rows by rank, the greatest first, then distance, the least first and none last, then key."""
    return ranked.orderBy(F.col(rank).desc(), F.col(distance).asc_nulls_last(), F.col(key).asc()).limit(k)


def fallback(query: str, text: Column, dose: Column) -> Column:
    """Whether text contains all words of query (stop words and words of one or two letters aside), and, if query has
    numbers, contains any of them or dose is within 0.51 of any. A null dose is near nothing."""
    spaced = re.sub(f"(?<=[0-9])(?=[{LETTERS}])|(?<=[{LETTERS}])(?=[0-9])", " ", query)
    parts = re.sub(f"[^0-9{LETTERS}]+", " ", spaced).lower().split()
    numbers = [p for p in parts if p.isdigit()]
    words = contains_all(text, [p for p in parts if not p.isdigit() and p not in STOP_WORDS and len(p) > 2])
    if not numbers:
        return words
    near = F.lit(False)
    for n in numbers:
        near = near | F.contains(F.lower(text), F.lit(n)) | F.coalesce(F.abs(dose - float(n)) <= 0.51, F.lit(False))
    return words & near


def cover_density(docs: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """key and ``rank`` of every document that has all of words: 0.1 / (1 + noise), summed over its covers.

    A cover is a stretch of tokens with all words that has no smaller one in it; its noise is how many other tokens it
    holds. One pass over the hits in order keeps the words' last places: where all words have come, the least of these
    places starts the shortest stretch that ends at the hit, and it is a cover if none before starts as late. The hits
    that it holds are those from its start on, of which each hit has its number.
    """
    words = sorted(set(words))
    own = docs.select(key, tokens(F.col(text)).alias("tokens")).where(F.forall(F.array(*map(F.lit, words)), lambda w: F.array_contains("tokens", w)))
    hits = F.filter(F.transform("tokens", lambda x, i: F.when(x.isin(*words), F.struct(i.alias("at"), x.alias("word")))), lambda x: x.isNotNull())
    at = own.select(key, hits.alias("hits"))
    none = F.lit(-1)
    place = lambda at, number: F.struct(at.alias("at"), number.alias("number"))
    start = F.struct(F.array(*(place(none, none) for _ in words)).alias("last"), none.alias("began"), none.alias("number"), F.lit(0.0).alias("sum"))

    def step(s: Column, hit: Column) -> Column:
        number = s["number"] + 1
        last = F.array(*(F.when(hit["word"] == w, place(hit["at"], number)).otherwise(F.get(s["last"], F.lit(i))) for i, w in enumerate(words)))
        first = F.array_min(last)
        cover = (first["at"] >= 0) & (first["at"] > s["began"])
        noise = hit["at"] - first["at"] - (number - first["number"])
        return F.struct(last.alias("last"), F.when(cover, first["at"]).otherwise(s["began"]).alias("began"), number.alias("number"), (s["sum"] + F.when(cover, F.lit(0.1) / (1 + noise)).otherwise(0.0)).alias("sum"))

    return at.select(key, F.aggregate("hits", start, step, lambda s: s["sum"]).alias("rank"))
