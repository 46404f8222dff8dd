"""Ranked lexical search: a hierarchical max tree over ranges of documents for each term, searched best first by branch and bound.

Documents in order of doc_id are cut into shards. A shard holds, for each term that it has, every document's share of
the score and, level by level, the greatest share in ranges of 8, 64, 512 and more documents; the root is the shard's
greatest share. No document of a range scores more than the sum of its terms' greatest shares, so ranges are opened by
descending sums until the sums are below the k-th best score. Ranges whose sum equals it are opened too, as they may
hold an equal score with a smaller doc_id. Shards themselves are the tree's top level: the two with the highest sums are
opened first, and what they give is the least score that the others have to reach.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewren.llm.common import cut, release, split_words, texts_of
from pricewren.operators.topk import top_k

#: What ends a term: ASCII but for digits and letters. Only A-Z is lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Documents of a shard at most, ranges of a range, bytes of terms that are sent to every task at once, items searched in one shard by one task.
SHARD, FANOUT, TERM_BYTES, ITEMS_A_TASK = 2048, 8, 16 << 20, 256
#: Postings for each range of documents that is sorted as one.
POSTINGS = 1_000_000
COUNTED = "doc_id long, n long, terms array<int>, tfs array<int>"
INDEX = "shard long, docs array<long>, terms array<int>, tops array<int>, dfs array<int>, keys array<binary>, shares array<binary>"


def terms_of(text: Column) -> Column:
    """All terms of a text, in order, with repeats; null has none."""
    lower = F.translate(text.cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(F.coalesce(lower, F.lit("")), F.lit(TERM), F.lit(0))


def _plain(texts: pa.Array) -> pa.Array:
    """Texts with a space for each sign that ends a term, A-Z in lower case."""
    buffers = texts.buffers()
    data = pa.py_buffer(buffers[2].to_pybytes().translate(_PLAIN)) if buffers[2] is not None else buffers[2]
    return pa.Array.from_buffers(texts.type, len(texts), [buffers[0], buffers[1], data], offset=texts.offset)


def count_terms(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n (its terms, with repeats), and the places in vocabulary and frequencies of the terms that it has."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = pa.array(shared.value, pa.large_string())
        for batch in (whole.slice(a, 1000) for whole in batches for a in range(0, whole.num_rows, 1000)):
            words, at, offsets = split_words(_plain(texts_of(batch)))
            place = np.asarray(pc.fill_null(pc.index_in(words, value_set=known), -1)).astype(np.int64) if len(words) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            term = place[at] if len(at) else at
            pair, times = np.unique((doc * (len(known) + 1) + term)[term >= 0], return_counts=True)
            ends = np.searchsorted(pair, np.arange(batch.num_rows + 1) * (len(known) + 1)).astype(np.int32)
            columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pair % (len(known) + 1), times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets)), *columns], ["doc_id", "n", "terms", "tfs"])
            release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COUNTED)


def tree(term: np.ndarray, doc: np.ndarray, share: np.ndarray, n_docs: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The distinct terms, and keys and greatest shares by level, documents first and roots last.

    A key is the term's place among them times the level's number of ranges, plus the range. Entries come sorted.
    """
    terms, place = np.unique(term, return_inverse=True)
    size, keys, shares = n_docs, [place.astype(np.int64) * n_docs + doc], [share.astype(np.int32)]
    while size > 1:
        size, before = -(-size // FANOUT), size
        above = keys[-1] // before * size + keys[-1] % before // FANOUT
        first = np.flatnonzero(np.diff(above, prepend=-1))
        keys.append(above[first])
        shares.append(np.maximum.reduceat(shares[-1], first))
    return terms, keys, shares


def build_index(counted: DataFrame, n_docs: int, n_terms: int, postings: int) -> DataFrame:
    """A row for each shard: its documents, terms, their greatest shares and document frequencies, and the levels of its trees."""
    by = [F.col("doc_id").asc_nulls_last(), F.xxhash64("n", "terms", "tfs")]
    dealt = counted.repartitionByRange(max(1, math.ceil(postings / POSTINGS)), *by).sortWithinPartitions(*by)

    def run(batches):
        part, number, held = TaskContext.get().partitionId(), 0, []

        def shard() -> pa.RecordBatch:
            nonlocal held, number
            rows = pa.Table.from_batches(held).combine_chunks()
            held, number = [], number + 1
            lists, tfs = rows.column("terms").combine_chunks(), rows.column("tfs").combine_chunks()
            term, tf = np.asarray(lists.flatten()).astype(np.int64), np.asarray(tfs.flatten()).astype(np.int64)
            doc = np.repeat(np.arange(rows.num_rows), np.asarray(pc.list_value_length(lists)))
            n = np.asarray(rows.column("n")).astype(np.int64)
            m = 100 - 90 + 90 * n * n_docs // n_terms
            order = np.lexsort((doc, term))
            share = (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))[order]
            terms, keys, shares = tree(term[order], doc[order], share, rows.num_rows)
            values = [part << 32 | number, rows.column("doc_id").to_pylist(), terms.astype(np.int32), shares[-1], np.bincount(np.searchsorted(terms, term)).astype(np.int32), [k.tobytes() for k in keys], [s.tobytes() for s in shares]]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["shard", "docs", "terms", "tops", "dfs", "keys", "shares"])

        for batch in batches:
            while batch.num_rows:
                room = SHARD - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == SHARD:
                    yield shard()
                    release()
        if held:
            yield shard()

    return dealt.mapInArrow(run, INDEX)


def search_tree(keys: list[np.ndarray], shares: list[np.ndarray], n_docs: int, at: np.ndarray, weights: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
    """(score, document) of the k best documents and all equal to the k-th, of those with a score of least or more and above 0.

    at: the places of the asked terms among the shard's. Ranges wait in a heap by their bounds. The best are opened
    together, a few at first and then twice as many, each time as long as their bounds reach the k-th best score.
    """
    sizes = [n_docs]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // FANOUT))

    def bounds(level: int, nodes: np.ndarray) -> np.ndarray:
        wanted = at[:, None] * sizes[level] + nodes[None, :]
        found = np.minimum(np.searchsorted(keys[level], wanted), len(keys[level]) - 1)
        return (np.where(keys[level][found] == wanted, shares[level][found], 0) * weights[:, None]).sum(axis=0)

    top = len(sizes) - 1
    best: list[int] = []  # a heap of the k best scores
    done: list[tuple[int, int]] = []
    waits = [(-int(bounds(top, np.zeros(1, np.int64))[0]), top, 0)]
    least, width = max(1, least), 4
    while waits and -waits[0][0] >= least:
        opened: dict[int, list[int]] = {}
        for _ in range(width):
            if not waits or -waits[0][0] < least:
                break
            _, level, node = heapq.heappop(waits)
            opened.setdefault(level, []).append(node)
        width = min(2 * width, 128)
        for level, nodes in opened.items():
            below, children = level, np.array(nodes)
            if level:
                below = level - 1
                children = (children[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                children = children[children < sizes[below]]
            value = bounds(below, children)
            good = value >= least
            for score, child in zip(value[good].tolist(), children[good].tolist(), strict=True):
                if below:
                    heapq.heappush(waits, (-score, below, child))
                    continue
                done.append((score, child))
                heapq.heappush(best, score) if len(best) < k else heapq.heappushpop(best, score)
        if len(best) == k:
            least = max(least, best[0])
    return [x for x in done if x[0] >= least]


def _open(index: DataFrame, pairs: DataFrame, items: int, k: int) -> DataFrame:
    """place, doc_id and score of the best documents in pairs of shards and items."""
    block = F.pmod(F.xxhash64("place"), F.lit(max(1, math.ceil(items / ITEMS_A_TASK))))
    asked = pairs.groupBy("shard", block.alias("block")).agg(F.collect_list(F.struct("place", "terms", "weights", "least")).alias("asked"))
    both = index.select("shard", "docs", F.col("terms").alias("own"), "keys", "shares").join(asked, "shard")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in ("docs", "own", "keys", "shares", "asked")}
                docs, own = row["docs"].as_py(), np.asarray(row["own"].values)
                keys = [np.frombuffer(x, np.int64) for x in row["keys"].as_py()]
                shares = [np.frombuffer(x, np.int32).astype(np.int64) for x in row["shares"].as_py()]
                places, ids, scores = [], [], []
                for item in row["asked"].as_py():
                    term, weight = np.array(item["terms"]), np.array(item["weights"])
                    at = np.minimum(np.searchsorted(own, term), len(own) - 1)
                    here = own[at] == term
                    for score, doc in search_tree(keys, shares, len(docs), at[here], weight[here], k, item["least"]):
                        places.append(item["place"])
                        ids.append(docs[doc])
                        scores.append(score)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (places, ids, scores)], ["place", "doc_id", "score"])
            release()

    return both.select("docs", "own", "keys", "shares", "asked").mapInArrow(run, "place long, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    return top_k(found, ["place"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k)


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best rows of docs (doc_id, text) with a score above 0; items: item_id, text.

    All columns but these are left out. Null and empty texts have no terms: such documents count nowhere, and such items
    have no rows. Rows that repeat a doc_id are documents of their own; a null doc_id comes last among equal scores. Items
    that repeat both columns are one item; two texts under one item_id are two items, each with ranks from 1. An empty
    table gives no rows.

    Items are searched in blocks whose terms have TERM_BYTES at most (or of one item): a block's terms are sent to all
    tasks, and each block reads the documents once. The index of a block is written to the shared folder.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id"), F.array_distinct(terms_of(F.col("text"))).alias("words")).where(F.size("words") > 0).distinct()
    asked = cut(asked.withColumn("place", F.monotonically_increasing_id()), "items")
    held = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w))).alias("bytes")).first()
    blocks = max(1, math.ceil((held["bytes"] or 0) / TERM_BYTES))
    out = []
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("place"), F.lit(blocks)) == block)
        words = sorted(r["w"] for r in own.select(F.explode("words").alias("w")).distinct().collect())
        counted = cut(count_terms(docs, words), "counted")
        all_ = counted.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")).first()
        index = cut(build_index(counted.where(F.size("terms") > 0), all_["docs"], all_["terms"], all_["postings"]), "index")
        df = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df"))
        weight = F.floor(1000 * F.log((2.0 * all_["docs"] + 2) / (2 * F.col("df") + 1))).cast("long")
        vocabulary = spark.createDataFrame(list(enumerate(words)), "term int, word string")
        weighed = cut(own.select("place", F.explode("words").alias("word")).join(vocabulary, "word").join(df, "term").select("place", "term", weight.alias("weight")), "weights")
        tops = index.select("shard", F.explode(F.arrays_zip("terms", "tops")).alias("x")).select("shard", F.col("x.terms").alias("term"), F.col("x.tops").cast("long").alias("top"))
        bounds = cut(tops.join(weighed, "term").groupBy("place", "shard").agg(F.sum(F.col("top") * F.col("weight")).alias("bound")).where("bound > 0"), "bounds")
        lists = weighed.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("x")).select("place", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights"))
        first = cut(top_k(bounds, ["place"], [F.col("bound").desc(), F.col("shard")], 2), "first")
        found = cut(_open(index, first.join(lists, "place").withColumn("least", F.lit(1).cast("long")), held["n"], k), "found")
        least = _best(found, k).where(F.col("rank") == k).select("place", F.col("score").alias("least"))
        rest = bounds.join(first.select("place", "shard"), ["place", "shard"], "left_anti").join(least, "place", "left").withColumn("least", F.coalesce("least", F.lit(1).cast("long")))
        more = _open(index, rest.where("bound >= least").join(lists, "place"), held["n"], k)
        out.append(_best(found.unionByName(more), k).join(own.select("place", "item_id"), "place"))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole.select("item_id", "rank", "doc_id", "score")
