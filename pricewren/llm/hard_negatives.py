"""Hard negatives by norm-bucketed search.

Vectors in descending order of their norms are packed into buckets. By Cauchy-Schwarz no vector of a bucket scores more
against an anchor than the product of the anchor's norm and the bucket's greatest one. A bucket in which this is below
what a search still looks for - its window's lower limit, or the k-th best score that it has so far - is left out; as
buckets come by falling norms, all later ones of the same stripe are left out with it. Anchors are searched in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewren.llm.common import cut, release
from pricewren.operators.topk import top_k

#: Vectors of a bucket, of a stripe (what one task reads for one block of anchors) and of a block, about.
BUCKET, STRIPE, BLOCK = 1024, 16384, 1024
#: Below this product of norms every sum of an inner product is exact in doubles.
EXACT = 2.0**52
#: Room for the rounding of norms, which are doubles, beside their product.
SLACK = 1e-9
LONG = 2**63
PACKS = "pack long, n long, top double, norms binary, ids binary, labels binary, width long, vectors binary"
HITS = "pack long, anchor long, mark long, anchor_id long, id long, score long"


def scaled(rows: DataFrame, vector: str = "embedding", every: int = 7, classes: int = 10) -> DataFrame:
    """vec_id, label, q (components floor(256 x)) and norm of q, of the rows that take part: distinct ones, named, labelled and finite.

    Where vec_id is divisible by ``every``, label is (label + 1) % classes.
    """
    whole = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    took = whole.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(fit)
    q = took.select("vec_id", label.alias("label"), F.transform("v", lambda x: F.floor(x * 256).cast("long")).alias("q")).distinct()
    return q.withColumn("norm", F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def _packed(held: list[pa.RecordBatch], pack: int) -> pa.RecordBatch:
    """Rows as one row of binaries; a width below 0 says that the vectors are 64 bits wide."""
    table = pa.Table.from_batches(held).combine_chunks()
    lists = table.column("q").combine_chunks()
    lengths = np.diff(np.asarray(lists.offsets))
    width, n = int(lengths.max(initial=0)), table.num_rows
    vectors = np.zeros((n, width), np.int64)
    vectors[np.arange(width)[None, :] < lengths[:, None]] = np.asarray(lists.flatten())
    small = np.int16 if not vectors.size or (vectors.min() > -(2**15) and vectors.max() < 2**15) else np.int64
    norms = np.asarray(table.column("norm"))
    blobs = [norms.tobytes(), np.asarray(table.column("vec_id")).tobytes(), np.asarray(table.column("label")).tobytes()]
    values = [pack, n, float(norms.max(initial=0.0)), *blobs, width if small is np.int16 else -width, vectors.astype(small).tobytes()]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["pack", "n", "top", "norms", "ids", "labels", "width", "vectors"])


def _stripes(rows: DataFrame, n: int) -> DataFrame:
    """All rows by falling norm, STRIPE of them in a row each."""
    order = [F.col("norm").desc(), F.col("vec_id"), F.xxhash64("label", "q")]
    dealt = rows.repartitionByRange(max(1, math.ceil(n / (4 * STRIPE))), *order).sortWithinPartitions(*order)

    def run(batches):
        part, made, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, STRIPE - sum(b.num_rows for b in held)))
                batch = batch.slice(held[-1].num_rows)
                if sum(b.num_rows for b in held) == STRIPE:
                    yield _packed(held, part << 32 | made)
                    made, held = made + 1, []
        if held:
            yield _packed(held, part << 32 | made)
        release()

    return dealt.mapInArrow(run, PACKS)


def _blocks(anchors: DataFrame, count: int) -> DataFrame:
    """Anchors in ``count`` blocks, numbered from 0, a row each."""
    numbered = anchors.withColumn("pack", F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(count)))
    dealt = numbered.repartition(max(1, min(count, math.ceil(count / 8))), "pack").sortWithinPartitions("pack", "vec_id", "label", "q")

    def run(batches):
        now, held = None, []
        for batch in batches:
            packs = np.asarray(batch.column("pack"))
            cuts = [0, *(np.flatnonzero(np.diff(packs)) + 1).tolist(), len(packs)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and packs[a] != now:
                    yield _packed(held, now)
                    held = []
                now = int(packs[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield _packed(held, now)
        release()

    return dealt.mapInArrow(run, PACKS)


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products as 64-bit integers. Vectors of unequal lengths count as filled with zeros; most: the product of the greatest norms.

    Where doubles couldn't be exact, Python's integers are used, and what a long can't hold ends at its limits.
    """
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if most < EXACT:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    whole = a.astype(object) @ b.astype(object).T if width else np.zeros((len(a), len(b)), object)
    return np.clip(whole, -LONG, LONG - 1).astype(np.int64)


class Search:
    """The k best hits of each search of a block, as buckets come by.

    A search belongs to an anchor and looks for scores from low to high, in rows of the anchor's own label (not the
    anchor's own row) or of others; higher scores come first, then smaller ids.
    """

    def __init__(self, block: dict, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.block, self.anchor, self.high, self.same, self.k = block, anchor, high, same, k
        #: what a search still has to reach
        self.least = low.copy()
        self.of, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.scored = 0

    def look(self, bucket: dict) -> bool:
        """Take a bucket in; False where no search can find anything in it or a later one. Its first row has its greatest norm."""
        block, top = self.block, float(bucket["norms"][0])
        open_ = np.flatnonzero((block["norms"][self.anchor] * top * (1 + SLACK) + 1 >= self.least) & (self.least <= self.high))
        if not len(open_):
            return False
        anchors, at = np.unique(self.anchor[open_], return_inverse=True)
        scores = products(block["vectors"][anchors], bucket["vectors"], float(block["norms"].max() * top))
        self.scored += scores.size
        alike = block["labels"][anchors][:, None] == bucket["labels"][None, :]
        if self.same:
            alike &= block["ids"][anchors][:, None] != bucket["ids"][None, :]
        allowed = alike if self.same else ~alike
        # of an anchor's searches the one with the least limit says which rows are looked at again
        floor, ceiling = np.full(len(anchors), LONG - 1), np.full(len(anchors), -LONG)
        np.minimum.at(floor, at, self.least[open_])
        np.maximum.at(ceiling, at, self.high[open_])
        row, col = np.nonzero(allowed & (scores >= floor[:, None]) & (scores <= ceiling[:, None]))
        if not len(row):
            return True
        by_anchor = np.argsort(at, kind="stable")
        starts, counts = np.searchsorted(at[by_anchor], np.arange(len(anchors))), np.bincount(at, minlength=len(anchors))
        times = counts[row]
        ends = np.cumsum(times)
        pick = open_[by_anchor[np.arange(ends[-1]) - np.repeat(ends - times, times) + np.repeat(starts[row], times)]]
        score, ident = np.repeat(scores[row, col], times), np.repeat(bucket["ids"][col], times)
        fits = (score >= self.least[pick]) & (score <= self.high[pick])
        self.of, self.score, self.id = (np.concatenate(x) for x in ((self.of, pick[fits]), (self.score, score[fits]), (self.id, ident[fits])))
        order = np.lexsort((self.id, -self.score, self.of))
        self.of, self.score, self.id = self.of[order], self.score[order], self.id[order]
        first = np.searchsorted(self.of, self.of)
        keep = np.arange(len(self.of)) - first < self.k
        self.of, self.score, self.id = self.of[keep], self.score[keep], self.id[keep]
        full = np.bincount(self.of, minlength=len(self.least)) == self.k
        last = np.searchsorted(self.of, np.flatnonzero(full), side="right") - 1
        self.least[full] = np.maximum(self.least[full], self.score[last])
        return True


def _search(blocks: DataFrame, stripes: DataFrame, searches: DataFrame, count: int, same: bool, k: int) -> DataFrame:
    """HITS: k at most of each search in each stripe. searches: pack, anchor (place in the block), mark, low, high."""
    lists = searches.where("low <= high").groupBy("pack").agg(F.min("low").alias("least"), F.collect_list(F.struct("anchor", "mark", "low", "high")).alias("searches"))
    asked = blocks.join(lists, "pack").select("pack", F.col("top").alias("norm"), "least", F.struct("n", "norms", "ids", "labels", "width", "vectors").alias("block"), "searches")
    # a stripe that none of a block's searches can reach isn't sent to it
    numbered = stripes.select("top", "pack").withColumnRenamed("pack", "stripe").withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    pairs = numbered.join(asked.select("pack", "norm", "least"), "pack").where(F.col("norm") * F.col("top") * (1 + SLACK) + 1 >= F.col("least")).select("pack", "stripe")
    rows = stripes.select(F.col("pack").alias("stripe"), F.struct("n", "norms", "ids", "labels", "width", "vectors").alias("rows"))
    both = pairs.join(asked.select("pack", "block", "searches"), "pack").join(rows, "stripe").select("pack", "block", "searches", "rows")

    def of(cell: dict) -> dict:
        n, width = cell["n"], cell["width"]
        vectors = np.frombuffer(cell["vectors"], np.int64 if width < 0 else np.int16).reshape(n, abs(width))
        return {"norms": np.frombuffer(cell["norms"], np.float64), "ids": np.frombuffer(cell["ids"], np.int64), "labels": np.frombuffer(cell["labels"], np.int64), "vectors": vectors}

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                pack, block, rows = (batch.column(c)[i].as_py() for c in ("pack", "block", "rows"))
                anchor, mark, low, high = (np.asarray(batch.column("searches")[i].values.field(c)).astype(np.int64) for c in ("anchor", "mark", "low", "high"))
                block, rows = of(block), of(rows)
                found = Search(block, anchor, low, high, same, k)
                for a in range(0, len(rows["ids"]), BUCKET):
                    if not found.look({name: x[a : a + BUCKET] for name, x in rows.items()}):
                        break
                who = anchor[found.of]
                columns = [np.full(len(who), pack), who, mark[found.of], block["ids"][who], found.id, found.score]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["pack", "anchor", "mark", "anchor_id", "id", "score"])
            release()

    return both.mapInArrow(run, HITS)


def _all(blocks: DataFrame, stripes: DataFrame, searches: DataFrame, count: int, same: bool, k: int) -> DataFrame:
    """The k best hits of each search, with their rank: first in the stripe of the greatest norms, then, from the k-th score on, in the others."""
    key = ["pack", "anchor", "mark"]
    order = [F.col("score").desc(), F.col("id")]
    first = stripes.agg(F.max(F.struct("top", "pack")).alias("x")).first()["x"]
    if first is None:
        return blocks.sparkSession.createDataFrame([], HITS + ", rank int")
    here = F.col("pack") == first["pack"]
    found = cut(top_k(_search(blocks, stripes.where(here), searches, count, same, k), key, order, k), "hits")
    least = found.where(F.col("rank") == k).select(*key, F.col("score").alias("least"))
    rest = searches.join(least, key, "left").withColumn("low", F.greatest("low", F.coalesce("least", "low"))).drop("least")
    more = _search(blocks, stripes.where(~here), rest, count, same, k)
    return top_k(found.drop("rank").unionByName(more), key, order, k)


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, lowest: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of each anchor's hard negatives.

    rows: vec_id, embedding, label; see scaled() for the rows that take part. Anchors are those whose vec_id is divisible
    by ``every``; positives their best rows of the same label but with another vec_id; negatives the best rows of other
    labels that score from ``lowest`` per cent of the positive's score up to all of it. Ties go to the smaller vec_id.

    Rows with a null vec_id have no name and take no part either; rows that are equal in all three columns count once, and
    rows that share only their vec_id are rows of their own, each an anchor of its own too. Shorter vectors count as
    filled with zeros. Scores that a long can't hold end at its limits. An empty table, an anchor without positives and
    a window without negatives give no rows. Other columns are left out.
    """
    took = cut(scaled(rows), "scaled")
    held = took.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("anchors")).first()
    count = max(1, math.ceil(held["anchors"] / BLOCK))
    stripes = cut(_stripes(took, held["n"]), "stripes")
    blocks = cut(_blocks(took.where(F.col("vec_id") % every == 0), count), "blocks")
    each = blocks.select("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("anchor"))
    alike = each.select("pack", "anchor", F.lit(0).cast("long").alias("mark"), F.lit(-LONG).cast("long").alias("low"), F.lit(LONG - 1).cast("long").alias("high"))
    near = cut(_all(blocks, stripes, alike, count, True, positives).select("pack", "anchor", F.col("rank").cast("long").alias("mark"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # the share rounded up is the least whole score in the window; below 0 it is above the positive's, and the window is empty
    windows = near.select("pack", "anchor", "mark", F.expr(f"cast(ceil(cast(positive_score as decimal(20,0)) * {lowest} / 100) as bigint)").alias("low"), F.col("positive_score").alias("high"))
    hits = _all(blocks, stripes, windows, count, False, negatives)
    return hits.join(near, ["pack", "anchor", "mark"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
