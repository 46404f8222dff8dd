"""Trigram similarity and vector distance as column expressions, sequence ratio as an Arrow function."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pricewren.functions.text import tokens


def ordered_trigrams(c: Column) -> Column:
    """Trigrams of each word with two spaces before and one after it, in order."""
    def of(word):
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substr(padded, i, F.lit(3)))

    return F.flatten(F.transform(tokens(c), of))


def trigrams(c: Column) -> Column:
    return F.array_distinct(ordered_trigrams(c))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays' distinct values; 0 where both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def _with(value: Column, of) -> Column:
    """of(value), with value computed once: lambdas would compute it anew for each element."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def word_similarity(a: Column, b: Column) -> Column:
    """The greatest share that a's trigrams have with those of any stretch of b's ordered trigrams.

    From each start, one pass over the ends keeps two counts: the stretch's distinct trigrams and those of a among them.
    A trigram counts where it first comes in the stretch, that is where the place before at which it came isn't in it.
    """
    state = lambda all_, held, best: F.struct(all_.alias("all"), held.alias("held"), best.alias("best"))

    def best(x):
        q, t = x["q"], x["t"]
        before = lambda g, j: j - F.array_position(F.reverse(F.slice(t, F.lit(1), j)), g)
        at = F.transform(t, lambda g, j: F.struct((before(g, j)).cast("int").alias("seen"), j.alias("at"), F.array_contains(q, g).alias("own")))

        def from_(places, i, n):
            def step(s, p):
                # seen is p's own place where the trigram hasn't come before
                new = (p["seen"] == p["at"]) | (p["seen"] < i)
                all_, held = s["all"] + new.cast("int"), s["held"] + (new & p["own"]).cast("int")
                return state(all_, held, F.greatest(s["best"], held / (n + all_ - held)))

            return F.aggregate(F.slice(places, i + 1, F.size(places)), state(F.lit(0), F.lit(0), F.lit(0.0)), step, lambda s: s["best"])

        starts = lambda y: F.filter(y["at"], lambda p: p["own"])
        return _with(F.struct(at.alias("at"), F.size(q).alias("n")), lambda y: F.array_max(F.transform(starts(y), lambda p: from_(y["at"], p["at"], y["n"]))))

    return F.coalesce(_with(F.struct(trigrams(a).alias("q"), ordered_trigrams(b).alias("t")), best), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Shared values over the larger array's size; 0 where both are empty."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most > 0, F.size(F.array_intersect(a, b)) / most).otherwise(0.0)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts; for candidate pairs only, never for all."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
