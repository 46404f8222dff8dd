"""Document fingerprints by consistent weighted sampling (operator 5), in DataFrame functions only.

A document is its words with their counts as weights. For each of ``SAMPLES`` samples and each term k of weight w,
with r and c from Gamma(2, 1) and b from U(0, 1), all three functions of k and the sample alone:

    t = floor(ln w / r + b),  ln a = ln c - r (t - b + 1)

The sample is the pair (k, t) of the least a. Two documents draw the same pair with the probability of their
generalised Jaccard similarity, the sum of the least over the sum of the greatest weights.

A sample is kept as one long: ln a in fixed point, then bits of a hash of (k, t), so it is found by a plain minimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewren.llm.common import bucket_count, range_buckets, text_bytes

SAMPLES = 64
#: A range of doc_id has about so much text, so that its terms fit a task's memory; beyond 512 GB, ranges grow instead of their number.
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 1 << 16
SPACES = r"[\x20\x09-\x0D]+"
#: Samples are computed from 21-bit parts of two hashes; ln a is kept to 2**-32 above -128.
PART = (1 << 21) - 1
LOW = (1 << 22) - 1


def _uniform(h: Column, part: int) -> Column:
    return (F.shiftrightunsigned(h, 21 * part).bitwiseAND(F.lit(PART)).cast("double") + 0.5) * (2.0**-21)


def draw(terms: DataFrame, part: str, samples: int = SAMPLES) -> DataFrame:
    """part, rows, known (the term isn't null) and ``drawn`` (the samples' longs) for terms with columns part, rows, term and log_weight.

    The steps are projections of their own, so that no part is computed twice. Each passes rows through a lambda,
    which keeps it out of whole-stage code: many small methods are compiled there where one would be too large to be.
    """
    each = range(samples)
    held = F.transform("rows", lambda x: x).alias("rows")
    t = terms.select(part, held, F.col("term").isNotNull().alias("known"), F.col("log_weight").alias("w"), F.array(*(F.xxhash64("term", F.lit(2 * k)) for k in each)).alias("h"), F.array(*(F.xxhash64("term", F.lit(2 * k + 1)) for k in each)).alias("g"))
    h, g = F.col("h"), F.col("g")
    r = F.array(*(-F.log(_uniform(h[k], 0) * _uniform(h[k], 1)) for k in each))
    log_c = F.array(*(F.log(-F.log(_uniform(g[k], 0) * _uniform(g[k], 1))) for k in each))
    t = t.select(part, held, "known", "w", "g", r.alias("r"), log_c.alias("c"), F.array(*(_uniform(h[k], 2) for k in each)).alias("b"))
    t = t.select(part, held, "known", "g", "r", "c", "b", F.array(*(F.floor(F.col("w") / F.col("r")[k] + F.col("b")[k]) for k in each)).alias("t"))

    def long(k: int) -> Column:
        log_a = F.col("c")[k] - F.col("r")[k] * (F.col("t")[k].cast("double") - F.col("b")[k] + 1.0)
        pair = g[k].bitwiseXOR(F.col("t")[k] * 2_654_435_761).bitwiseAND(F.lit(LOW))
        return F.shiftleft(((log_a + 128.0) * 2.0**32).cast("long"), 22).bitwiseOR(pair)

    return t.select(part, held, "known", F.array(*map(long, each)).alias("drawn"))


def signatures(rows: DataFrame, part: str, key: str, text: str, samples: int = SAMPLES) -> DataFrame:
    """part, key and ``signature`` (array of longs) of each row. Empty texts get -1 throughout.

    part is what rows are dealt out by, and (part, key) names a row; nothing is shuffled if rows are already
    partitioned by part. Within a part each pair of a term and a count is sampled once, whatever the number of rows
    that have it.
    """
    words = rows.select(part, key, F.explode(F.split(F.lower(text), SPACES)).alias("word"))
    terms = words.select(part, key, F.when(F.col("word") != "", F.xxhash64("word")).alias("term")).groupBy(part, key, "term").agg(F.count(F.lit(1)).alias("n"))
    # the term first: lists are gathered by a sort, which compares the first key alone where that differs
    shared = terms.groupBy("term", part, "n").agg(F.collect_list(key).alias("rows")).withColumn("log_weight", F.log(F.col("n").cast("double")))
    # a text without words has the null term alone, which draws nothing
    each = draw(shared, part, samples).select(part, F.explode("rows").alias(key), F.when(F.col("known"), F.col("drawn")).alias("drawn"))
    least = each.groupBy(part, key).agg(*(F.min(F.col("drawn")[k]).alias(f"s{k}") for k in range(samples)))
    return least.select(part, key, F.array(*(F.coalesce(f"s{k}", F.lit(-1)).bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(samples))).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """The share of samples that two signatures have in common: an estimate of generalised Jaccard similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def as_text(signature: Column) -> Column:
    """Eight hexadecimal digits a sample."""
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def edited_pairs(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they and the next document's are.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's, in descending order of doc_id; after the last comes the first. Null texts count as empty. Null ids
    come last; rows that share a doc_id follow each other by text, and each gets a row of its own.

    Rows are dealt out once, by ranges of doc_id; each range also gets a copy of the next range's first row, so
    neighbours always meet in one task, and all that follows stays there.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = min(max(8, -(-text_bytes(rows) // BUCKET_BYTES)), MOST_BUCKETS)
    rows = range_buckets(rows, "doc_id", n, "bucket")
    # the first row of each range: the greatest id, then the least text; it follows the last row of the range above
    tops = rows.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    # one number a range, so these windows stay small
    above = F.coalesce(F.lead("bucket").over(Window.orderBy("bucket")), F.min("bucket").over(Window.partitionBy()))
    tops = tops.withColumn("above", above)
    # one row a range, so texts stay where they are
    firsts = rows.join(F.broadcast(tops), "bucket").where(F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("bucket", "above").agg(F.min("text").alias("text"))
    extra = firsts.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("above").alias("bucket"), F.lit(1).alias("extra"))
    # a task for each range: hashed, several ranges would share a task and it would spill
    dealt = rows.withColumn("extra", F.lit(0)).unionByName(extra).repartitionById(bucket_count(n), "bucket")
    order = Window.partitionBy("bucket").orderBy("extra", F.col("doc_id").desc_nulls_last(), "text")
    paired = dealt.withColumn("row", F.row_number().over(order)).withColumn("next", F.coalesce(F.lead("text").over(order), F.lit("")))
    paired = paired.withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.expr("cast(n_chars div 2 as int)"))
    edited = F.concat(F.expr("left(text, cast(n_chars as int) - half)"), F.expr("left(next, half)"))
    both = paired.withColumn("edited", edited)
    keys = ["bucket", "row"]
    bodies = F.array(F.struct((F.col("row") * 2).alias("which"), F.col("text").alias("body")), F.struct((F.col("row") * 2 + 1).alias("which"), F.col("edited").alias("body")))
    flat = both.select("bucket", F.explode(bodies).alias("v")).select("bucket", F.col("v.which").cast("long").alias("which"), "v.body")
    signed = signatures(flat, "bucket", "which", "body", samples).withColumn("row", F.expr("cast(which div 2 as int)"))
    own, changed = (F.max(F.when(F.col("which") % 2 == k, F.col("signature"))) for k in (0, 1))
    by_row = signed.groupBy(*keys).agg(own.alias("own"), changed.alias("changed"))
    facts = both.select(*keys, "extra", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    following = by_row.withColumn("next_own", F.lead("own").over(Window.partitionBy("bucket").orderBy("row"))).join(facts, keys)
    out = following.where("extra = 0").select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
    return out
