"""Data-quality rules: reasons by row, counts by rule, samples by rule, all in one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewren.operators.topk import top_k


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, joined by `; `; the empty text for a clean row."""
    return F.concat_ws("; ", *(F.when(rule, F.lit(name)) for name, rule in rules.items()))


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule and violations, a row a rule, from one aggregation."""
    counted = df.agg(*(F.count_if(rule).alias(name) for name, rule in rules.items()))
    pairs = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("violations")) for name in rules))
    return counted.select(F.inline(pairs))


def rule_samples(df: DataFrame, rules: dict[str, Column], order: list[Column], k: int = 10) -> DataFrame:
    """At most k rows of each rule, with the rule's name: a report."""
    hits = F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    return top_k(df.withColumn("rule", F.explode(hits)), ["rule"], order, k)


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and the others with ``reasons``."""
    marked = df.withColumn("reasons", reasons(rules))
    return marked.where("reasons = ''").drop("reasons"), marked.where("reasons <> ''")
