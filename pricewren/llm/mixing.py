"""Mixing sources to target weights by hierarchical budgeting (operator 4), in DataFrame functions only.

The budget starts at the root of a domain-language-source tree. At each level it is divided among siblings by weight;
a child that can't use its share (its subtree holds fewer tokens, even in ``max_epochs`` epochs) takes what it can,
and the rest goes to its siblings by weight. As a child's capacity is that of its whole subtree, a shortage is met
among a leaf's siblings first and reaches an ancestor's siblings only when the subtree is used up.

The division among siblings has a closed form: sorted by capacity / weight, the first child that isn't filled fixes
the level, tokens per unit of weight, that all children after it get. So one window per level does it, over the tree
alone, which has a row per source.

Each leaf then takes whole epochs of its documents and, for the rest of its budget, a token-prefix of one more epoch
in an order seeded by epoch. Only where the prefix ends has to be found: tokens are summed by 4096 slices of the order
first, and only the documents of the slice in which the budget ends are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewren.llm.common import cut

TOKENS = r"[^\x20\x09-\x0D]+"
DECIMAL = "decimal(38,0)"


def default_domain() -> Column:
    """A domain from the number at the end of the source's name, modulo 4; `other` where there is none."""
    digits = F.regexp_extract(F.coalesce("source", F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(digits == "", F.lit("other")).otherwise(F.concat(F.lit("d"), (digits.cast("long") % 4).cast("string")))


def _weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, weight in sorted(weights.items()):
        out = F.when(F.col(column) == name, F.lit(int(weight))).otherwise(out)
    return out.cast("long")


def divide(children: DataFrame, parents: list[str], key: str) -> DataFrame:
    """Budgets of children (columns parents, key, weight, capacity, parent_budget): adds ``budget``.

    Children of weight 0 get nothing. All is exact integer arithmetic, rounded down, so no budget is exceeded.
    """
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    # sorted by tokens per unit of weight, in millionths rounded down, then by name
    ratio = F.expr("(cast(capacity as decimal(20,0)) * 1000000) div weight")
    order = by.orderBy("ratio", key)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = children.where("weight > 0").withColumn("ratio", ratio)
    w = w.withColumn("left", (F.col("parent_budget") - F.sum("capacity").over(upto) + F.col("capacity")).cast("decimal(20,0)"))
    w = w.withColumn("weight_left", F.sum("weight").over(onward).cast("decimal(14,0)"))
    # the level that this child would set, left / weight_left, fills it
    w = w.withColumn("short", F.when(F.expr("left * weight >= cast(capacity as decimal(20,0)) * weight_left"), 0).otherwise(1))
    w = w.withColumn("shorts", F.sum("short").over(upto))
    is_first = (F.col("short") == 1) & (F.col("shorts") == 1)
    w = w.withColumn("num", F.max(F.when(is_first, F.col("left"))).over(by)).withColumn("den", F.max(F.when(is_first, F.col("weight_left"))).over(by))
    share = F.when(F.col("shorts") == 0, F.col("capacity")).otherwise(F.least("capacity", F.expr("(num * weight) div den")))
    return w.withColumn("budget", share.cast("long")).drop("ratio", "left", "weight_left", "short", "shorts", "num", "den")


def leaf_budgets(leaves: DataFrame, target_share: tuple[int, int], weights: dict[str, dict[str, int]], max_epochs: int) -> DataFrame:
    """Budgets in tokens of leaves (columns domain, lang, source, supply); weights: by level, then by name."""
    levels = ("domain", "lang", "source")
    t = leaves
    for level in levels:
        t = t.withColumn(f"{level}_w", _weight(level, weights.get(level, {})))
    # what has weight 0 can't take tokens, so it adds no capacity to the levels above
    t = t.withColumn("capacity", F.when(F.least(*(f"{level}_w" for level in levels)) > 0, F.col("supply") * max_epochs).otherwise(0))
    sums = t.agg(F.sum("supply").alias("supply"), F.sum("capacity").alias("capacity")).first()
    root = min((sums["supply"] or 0) * target_share[0] // target_share[1], sums["capacity"] or 0)
    budgets, above = None, []
    for k, level in enumerate(levels):
        at = [*above, level]
        children = t.groupBy(*at).agg(F.max(f"{level}_w").alias("weight"), F.sum("capacity").alias("capacity"), F.sum("supply").alias("supply"))
        given = children.withColumn("parent_budget", F.lit(root).cast("long")) if k == 0 else children.join(budgets.select(*above, F.col("budget").alias("parent_budget")), above)
        budgets, above = divide(given, above, level), at
    return budgets.select(*levels, "supply", "budget")


def order_key(seed: int, epoch: Column) -> Column:
    """A document's place in an epoch's order: md5 of seed, epoch and doc_id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def mix(
    docs: DataFrame,
    domain: Column | None = None,
    domain_weights: dict[str, int] | None = None,
    lang_weights: dict[str, int] | None = None,
    source_weights: dict[str, int] | None = None,
    target_share: tuple[int, int] = (1, 1),
    max_epochs: int = 4,
    seed: int = 17,
) -> DataFrame:
    """Every column of docs plus ``mix_domain`` and ``mix_epochs`` (which replace columns of these names), for the documents that are taken.

    mix_epochs is how often the document is taken. Tokens are words; a null or empty text has none and is taken with
    its leaf's whole epochs only (or where the prefix passes it). Null lang and source are leaves of their own, named
    as the empty text. The target is target_share (a fraction, as two integers) of all tokens. A prefix never exceeds its
    budget; rows with the same doc_id in a leaf have the same place in the order and are taken together. No weight
    given means 1. An empty table gives an empty result.
    """
    domain = default_domain() if domain is None else domain
    part = docs.select("doc_id", F.coalesce(domain, F.lit("")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.regexp_count("text", F.lit(TOKENS)), F.lit(0)).cast("long").alias("tokens"))
    part = cut(part, "mix-tokens")
    leaf = ["domain", "lang", "source"]
    supply = part.groupBy(*leaf).agg(F.sum("tokens").alias("supply"))
    weights = {"domain": domain_weights or {}, "lang": lang_weights or {}, "source": source_weights or {}}
    budgets = leaf_budgets(supply, target_share, weights, max_epochs)
    budgets = budgets.withColumn("epochs", F.when(F.col("supply") > 0, F.expr("budget div supply")).otherwise(0).cast("long")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("supply"))
    budgets = cut(budgets, "mix-budgets")
    keyed = part.join(budgets.where("rest > 0").select(*leaf, "epochs", "rest"), leaf).withColumn("key", order_key(seed, F.col("epochs"))).withColumn("slice", F.substring("key", 1, 3))
    slices = keyed.groupBy(*leaf, "slice").agg(F.sum("tokens").alias("slice_tokens"), F.max("rest").alias("rest"))
    through = F.sum("slice_tokens").over(Window.partitionBy(*leaf).orderBy("slice"))
    edge = slices.withColumn("through", through).where("through > rest").groupBy(*leaf).agg(F.min(F.struct("slice", (F.col("through") - F.col("slice_tokens")).alias("base"))).alias("edge")).select(*leaf, "edge.*")
    in_edge = keyed.join(edge, [*leaf, "slice"])
    taken = F.sum("tokens").over(Window.partitionBy(*leaf, "slice").orderBy("key"))  # a range: equal keys together
    last = in_edge.withColumn("taken", F.col("base") + taken).where("taken <= rest").groupBy(*leaf).agg(F.max("key").alias("last_key"))
    # all before the edge's slice, and within it up to last_key; no edge means that the whole rest fits
    cuts = budgets.join(edge.select(*leaf, "slice"), leaf, "left").join(last, leaf, "left").select(*leaf, "epochs", "rest", "slice", "last_key")
    # the caller's columns travel as one, so that their names can't meet those of this operator
    given = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(domain, F.lit("")).alias("domain"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), "doc_id")
    key = order_key(seed, F.col("epochs"))
    more = (F.col("rest") > 0) & (F.col("slice").isNull() | (F.substring(key, 1, 3) < F.col("slice")) | (key <= F.col("last_key")))
    out = given.join(cut(cuts, "mix-cuts"), leaf).withColumn("times", F.col("epochs") + F.when(more, 1).otherwise(0)).where("times > 0")
    names = [c for c in docs.columns if c.lower() not in ("mix_domain", "mix_epochs")]
    return out.select(*(F.col("row")[c].alias(c) for c in names), F.col("domain").alias("mix_domain"), F.col("times").alias("mix_epochs"))
