"""N-gram Jaccard join in metric space (operator 6).

Documents are sets of 5-word shingles under Jaccard distance, and two link at a distance of 0.2 or less. The join is
exact and goes by regions:

1. Documents with equal sets become one point. A point's rarest shingles (a fifth of its set and one) must hit the
   rarest of any point that it links with, so every shared rare shingle is a first region, the points that have it.
   How rare a shingle is comes from counts over all documents. The place of the shared shingle in the order of rarity
   bounds what two points of a region can have in common, so many pairs are known not to link.
2. Every first region has a pivot, the point with the fewest rarer shingles: as others' edits are rare, it is the most
   central of near copies, and their regions have the same one. Each point goes to the pivot that most of its regions
   have, and its distance to it is computed. Regions whose points are all connected by then are done.
3. In a region with many open pairs several pivots are drawn, that one and one each from other connected parts, and all
   distances to them are computed. Each point goes to the cell of its nearest pivot (its Voronoi cell), and also to the cell of any pivot that
   is at most 0.4 further than its nearest: by the triangle inequality, two points that link then meet in a cell.
   Cells are regions of the next round.
4. Where cells come out nearly as large as the region, as with form letters that lie equally far from each other, the
   region stays for another round. If that didn't connect half of its pairs either, it is divided by the next shingle
   that two of its points have in common, again with the bound from its place.
5. In a region with few open pairs these are compared. A pair is open if its points aren't connected already, their
   sizes and the places of shared shingles allow a link, and so do their distances to the pivot of the cell.

Rounds go on until no region has open pairs. No more pairs than a small multiple of a region's points are compared in it
at once. Any connected points stay connected: only pairs that can't change a component or can't link are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewren.llm.common import cut, keep_rows, mix64, release, row_hash, split_words, text_bytes, texts_of
from pricewren.llm.graph import components

WORDS = 5
#: Links need 100 * intersection >= LINK * union.
LINK = 80
RADIUS = 1 - LINK / 100
#: Open pairs that a region may have for each of its points to be compared outright, and pivots that it draws otherwise.
PAIRS_A_POINT, PIVOTS = 32, 3
#: Bytes of text in a chunk, and shingles in a bucket of counts, about. Both numbers follow the input alone.
CHUNK_BYTES, BUCKET_NAMES = 4 << 20, 2 << 20


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All documents' sets, each sorted, as hashes of 64 bits, and where each ends.

    Words are lower-cased (A-Z). With fewer than five words the whole sequence is one shingle; without words, none.
    """
    words, picks, offsets = split_words(texts, lower=True)
    codes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.binary() if pa.types.is_string(words.type) else pa.large_binary()).to_pylist()), np.uint64, len(words))[picks]
    sizes = np.diff(offsets)
    counts = np.where(sizes == 0, 0, np.maximum(1, sizes - WORDS + 1))
    docs = np.repeat(np.arange(len(sizes)), counts)
    starts = np.repeat(offsets[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    ends = offsets[1:][docs]
    h = np.zeros(len(docs), np.uint64)
    for k in range(WORDS):
        at = starts + k
        inside = at < ends
        code = np.where(inside, codes[np.minimum(at, max(0, len(codes) - 1))] if len(codes) else np.uint64(0), np.uint64(0))
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + code + np.uint64(k + 1))
    order = np.lexsort((h, docs))
    h, docs = h[order], docs[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (docs[1:] != docs[:-1])
    return h[first], np.cumsum(np.bincount(docs[first], minlength=len(sizes)))


def _packed(ascending: np.ndarray) -> bytes:
    """Differences of ascending 32-bit numbers, all lowest bytes first, so that the many zero bytes stand together."""
    return np.diff(ascending, prepend=ascending.dtype.type(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1), dtype=np.uint32)


def rarity_levels(dealt: DataFrame, buckets_log2: int) -> DataFrame:
    """chunk, bucket and ``levels`` (bytes): for each distinct shingle of a chunk, ascending, how common it is.

    A level is 0 for a shingle of one document and about four times the logarithm to base 2 of its documents else
    (a chunk counts for 255 of them at most). A chunk sends each shingle once, as the 32 bits below those that name
    its bucket, so the bits in use follow the input. Two shingles that agree in these share a count, which only
    alters the order in which shingles are tried. A chunk sends no message to a bucket without shingles of its own.
    """

    def keys(table: pa.Table) -> pa.Table:
        h, n = np.unique(shingle_sets(texts_of(table))[0], return_counts=True)
        bucket = (h >> np.uint64(64 - buckets_log2)).astype(np.int64)
        edges = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=-1)), [len(h)]])
        low = ((h >> np.uint64(32 - buckets_log2)) & np.uint64(0xFFFFFFFF)).astype("<u4")
        n = np.minimum(n, 255).astype(np.uint8)
        spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        release()
        return pa.table({
            "chunk": pa.array(np.full(len(spans), table.column("chunk")[0].as_py(), np.int32)), "bucket": pa.array(bucket[edges[:-1]].astype(np.int32)),
            "keys": pa.array([_packed(low[a:b]) for a, b in spans], pa.binary()), "counts": pa.array([n[a:b].tobytes() for a, b in spans], pa.binary()),
        })

    def count(table: pa.Table) -> pa.Table:
        blobs = [_unpacked(k) for k in table.column("keys").to_pylist()]
        every = np.concatenate(blobs)
        weights = np.concatenate([np.frombuffer(c, np.uint8) for c in table.column("counts").to_pylist()])
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        group = np.cumsum(first) - 1
        sizes = np.bincount(group, weights=weights[order])
        level = np.minimum(255, np.ceil(4 * np.log2(sizes))).astype(np.uint8)
        out = np.empty(len(every), np.uint8)
        out[order] = level[group]
        ends = np.cumsum([len(b) for b in blobs])
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "levels": pa.array([out[e - len(b) : e].tobytes() for b, e in zip(blobs, ends, strict=True)], pa.binary())})

    asked = dealt.groupBy("chunk").applyInArrow(keys, "chunk int, bucket int, keys binary, counts binary")
    return asked.groupBy("bucket").applyInArrow(count, "chunk int, bucket int, levels binary")


def described(docs: DataFrame) -> DataFrame:
    """doc_id, t (a hash of the text), n (shingles), the set's key (high, low; null for an empty set), and for documents
    that share a rare shingle: ``rare`` (their rarest shingles that others have), ``at`` (these shingles' places in the
    order of rarity) and ``members`` (the whole set in that order, as bytes)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("t", row_hash())
    size = text_bytes(rows)
    n = max(4, -(-size // CHUNK_BYTES))
    log2 = max(2, min(24, (size // 6 // BUCKET_NAMES).bit_length()))
    dealt = rows.withColumn("chunk", F.pmod("t", F.lit(n)).cast("int")).repartition(n, "chunk")
    levels = rarity_levels(dealt, log2)

    def describe(texts: pa.Table, levels: pa.Table) -> pa.Table:
        h, ends = shingle_sets(texts_of(texts))
        blobs = sorted(zip(levels.column("bucket").to_pylist(), levels.column("levels").to_pylist(), strict=True))
        level = np.frombuffer(b"".join(x for _, x in blobs), np.uint8)[np.unique(h, return_inverse=True)[1]]
        out = {"high": [], "low": [], "rare": [], "at": [], "members": []}
        start = 0
        for end in ends.tolist():
            own, lv = h[start:end], level[start:end]
            start = end
            size = len(own)
            if not size:
                for column in out.values():
                    column.append(None)
                continue
            key = xxhash.xxh3_128_intdigest(own.tobytes())
            out["high"].append((key >> 64) - (1 << 63))
            out["low"].append((key & ((1 << 64) - 1)) - (1 << 63))
            order = np.lexsort((own, lv))
            prefix = order[: size - -(-LINK * size // 100) + 1]
            shared = np.flatnonzero(lv[prefix] > 0)
            out["rare"].append(own[prefix[shared]].view(np.int64) if len(shared) else None)
            out["at"].append(shared.astype(np.int32) if len(shared) else None)
            out["members"].append(own[order].tobytes() if len(shared) else None)
        release()
        return pa.table({
            "doc_id": texts.column("doc_id"), "t": texts.column("t"), "n": pa.array(np.diff(ends, prepend=0).astype(np.int32)),
            "high": pa.array(out["high"], pa.int64()), "low": pa.array(out["low"], pa.int64()),
            "rare": pa.array(out["rare"], pa.list_(pa.int64())), "at": pa.array(out["at"], pa.list_(pa.int32())), "members": pa.array(out["members"], pa.binary()),
        })

    return dealt.groupBy("chunk").cogroup(levels.groupBy("chunk")).applyInArrow(describe, "doc_id long, t long, n int, high long, low long, rare array<bigint>, at array<int>, members binary")


def measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b and ``links``, ``d`` (Jaccard distance) of pairs of points (columns a, b), from their sets (p, members)."""

    def compare(batches):
        last, two = None, None
        for batch in batches:
            links, far = [], []
            for x, b, y in zip(batch.column("x"), batch.column("b").to_pylist(), batch.column("y"), strict=True):
                if b != last:
                    last, two = b, np.sort(np.frombuffer(y.as_buffer(), np.uint64))
                one = np.frombuffer(x.as_buffer(), np.uint64)
                at = np.searchsorted(two, one)
                at[at == len(two)] = 0
                both = int((two[at] == one).sum())
                union = len(one) + len(two) - both
                links.append(100 * both >= LINK * union)
                far.append(1 - both / union)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(links, pa.bool_()), pa.array(far, pa.float64())], names=["a", "b", "links", "d"])

    x = pairs.join(sets.select(F.col("p").alias("a"), F.col("members").alias("x")), "a")
    both = x.join(sets.select(F.col("p").alias("b"), F.col("members").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, links boolean, d double")


def _ordered(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _fits() -> Column:
    """Whether rows (n, u, d) and (n2, u2, d2) of a region can link: u bounds what they have in common, d is the distance to the pivot."""
    common = F.least("u", "u2") * (100 + LINK) >= (F.col("n") + F.col("n2")) * LINK
    return common & (F.coalesce(F.abs(F.col("d") - F.col("d2")), F.lit(0.0)) <= RADIUS + 1e-9)


def _other(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select("region", *(F.col(c).alias(f"{c}2") for c in names))


def first_pivots(seeds: DataFrame) -> DataFrame:
    """Pairs a, b of each point of seeds (region, p, n, u) with the pivot that most of its regions have."""
    drawn = seeds.groupBy("region").agg(F.min(F.struct((F.col("n") - F.col("u")).alias("own"), F.xxhash64("p").alias("h"), "p", "n", "u")).alias("v"), F.count(F.lit(1)).alias("m")).where("m > 1")
    pivots = drawn.select("region", F.col("v.p").alias("pivot"), F.col("v.n").alias("n2"), F.col("v.u").alias("u2"), F.lit(None).cast("double").alias("d2"))
    met = seeds.withColumn("d", F.lit(None).cast("double")).join(pivots, "region").where((F.col("p") != F.col("pivot")) & _fits())
    often = met.groupBy("p", "pivot").agg(F.count(F.lit(1)).alias("m"))
    most = often.groupBy("p").agg(F.max(F.struct("m", "pivot")).alias("v")).select("p", F.col("v.pivot").alias("pivot"))
    return most.select(*_ordered("p", "pivot")).distinct()


def _refined(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Regions of the points of each region of rows (region, p, n, k, i) that share one more shingle, behind place i."""
    behind = F.expr(f"substring(members, 8 * (i + 1) + 1, greatest(0, 8 * (n - cast(ceil({LINK} * n / 100) as int) + k + 1 - i)))")

    def shared(batches):
        for batch in batches:
            more = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("more")]
            lengths = np.array([len(x) for x in more], np.int64)
            region, p, n, k, i = (np.repeat(np.asarray(batch.column(c)), lengths) for c in ("region", "p", "n", "k", "i"))
            step = np.arange(len(i)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            inner = mix64(np.concatenate([*more, np.zeros(0, np.uint64)]) + region.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            yield pa.RecordBatch.from_pydict({"region": inner, "p": p, "n": n, "k": (k + 1).astype(np.int32), "i": (i + 1 + step).astype(np.int32)})

    parts = rows.join(sets, "p").select("region", "p", "n", "k", "i", behind.alias("more"))
    out = parts.mapInArrow(shared, "region long, p long, n int, k int, i int")
    return out.withColumn("d", F.lit(None).cast("double")).withColumn("was", F.lit(None).cast("long"))


def link_points(points: DataFrame, sets: DataFrame, counts: dict[str, int] | None = None) -> DataFrame | None:
    """node and component of the points (p, n, rare, at) that have links, by their sets (p, members); None without any point.

    counts, if given, gets how many pairs the rounds measured and how many regions drew pivots.
    """
    counts = {} if counts is None else counts
    if points.isEmpty():
        return None
    nothing = F.lit(None)
    seeds = lambda of, *more: of.select("p", "n", *more, F.explode(F.arrays_zip("rare", "at")).alias("s")).select(F.col("s.rare").alias("region"), "p", "n", *more, F.lit(0).alias("k"), F.col("s.at").alias("i"))
    bound = F.col("k") + F.col("n") - F.col("i")
    measured = cut(measure(first_pivots(seeds(points).withColumn("u", bound)), sets), "measured")
    regions = None
    counts |= {"first": measured.count(), "pivots": 0, "refined": 0}
    while True:
        labels = components(measured.where("links"))
        labelled = (points if regions is None else regions).join(labels.select(F.col("node").alias("p"), F.col("component").alias("label")), "p", "left").withColumn("label", F.coalesce("label", "p"))
        if regions is None:
            labelled = seeds(labelled, "label").withColumn("d", nothing.cast("double")).withColumn("was", nothing.cast("long"))
        about = labelled.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least_n")).where("low <> high").select("region", "least_n")
        # what is too far back to link with even the smallest set of its region is done
        near = bound * (100 + LINK) >= (F.col("n") + F.col("least_n")) * LINK
        regions = cut(labelled.join(about, "region").where(near).drop("least_n"), "regions")
        by_label = regions.groupBy("region", "label").agg(F.count(F.lit(1)).alias("m"))
        size = by_label.groupBy("region").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("squares"), F.max(F.struct("m", "label")).alias("v"))
        size = size.select("region", F.col("m").alias("size"), F.expr("(m * m - squares) div 2").alias("open"), F.col("v.label").alias("major")).where("open > 0")
        known = cut(regions.withColumn("u", bound).join(size, "region"), "open")
        if known.isEmpty():
            return labels
        few = F.col("open") <= PAIRS_A_POINT * F.col("size")
        stuck = F.coalesce(F.col("open") * 2 > F.col("was"), F.lit(False))
        small, dense, large = known.where(few), known.where(~few & stuck), known.where(~few & ~stuck)
        # the points of all but the largest connected part against all
        apart = (F.col("label") != F.col("label2")) & ((F.col("label2") == F.col("major")) | (F.col("p") < F.col("p2")))
        pairs = small.where("label <> major").join(_other(small, "p", "n", "u", "d", "label"), "region").where(apart & _fits()).select(*_ordered("p", "p2"))
        own = (F.col("n") - F.col("u")).alias("own")
        drawn = [F.min(F.struct(F.xxhash64(F.lit(j), "label").alias("h") if j else own, own, F.xxhash64("p").alias("g"), "p")).alias(f"v{j}") for j in range(PIVOTS)]
        pivots = cut(large.groupBy("region").agg(*drawn).select("region", F.explode(F.array_distinct(F.array(*(F.col(f"v{j}.p") for j in range(PIVOTS))))).alias("pivot")), "pivots")
        to_pivot = large.join(pivots, "region")
        pairs = pairs.unionByName(to_pivot.where("p <> pivot").select(*_ordered("p", "pivot"))).distinct()
        new = cut(measure(pairs.join(measured, ["a", "b"], "left_anti"), sets), "measured")
        measured = measured.unionByName(new)
        refined = _refined(dense, sets)
        counts["refined"] += 0 if dense.isEmpty() else 1
        if pivots.isEmpty():
            regions = refined
            continue
        counts["pivots"] += pivots.select("region").distinct().count()
        far = to_pivot.select("region", "p", "n", "k", "i", "size", "open", "pivot", *_ordered("p", "pivot")).join(measured.select("a", "b", F.col("d")), ["a", "b"], "left")
        far = far.withColumn("d", F.when(F.col("p") == F.col("pivot"), 0.0).otherwise(F.col("d"))).withColumn("nearest", F.min("d").over(Window.partitionBy("region", "p")))
        # a pivot's own pairs are done
        no_pivot = pivots.select("region", F.col("pivot").alias("p"))
        in_cell = far.where(F.col("d") <= F.col("nearest") + 2 * RADIUS + 1e-9).join(no_pivot, ["region", "p"], "left_anti")
        in_cell = cut(in_cell.withColumn("cell", F.xxhash64("region", "pivot")), "cells")
        cells = in_cell.groupBy("region", "cell").agg(F.count(F.lit(1)).alias("m"), F.first("size").alias("size"))
        split = cells.groupBy("region").agg(F.sum(F.col("m") * F.col("m")).alias("after"), F.first("size").alias("size")).where("2 * after <= size * size").select("region")
        smaller = in_cell.join(split, "region", "left_semi").select(F.col("cell").alias("region"), "p", "n", "k", "i", "d", nothing.cast("long").alias("was"))
        stay = large.join(split, "region", "left_anti").join(no_pivot, ["region", "p"], "left_anti").select("region", "p", "n", "k", "i", "d", F.col("open").alias("was"))
        regions = smaller.unionByName(stay).unionByName(refined)


def _classes(docs: DataFrame, counts: dict[str, int] | None = None) -> DataFrame:
    """doc_id, t, row, n, component_id and ``first`` (the row of the least doc_id of its class) for every row of docs."""
    table = cut(described(docs).withColumn("row", F.monotonically_increasing_id()), "points")
    full = table.where("high is not null")
    copies = full.groupBy("high", "low").agg(F.min("row").alias("p"), F.count(F.lit(1)).alias("size"))
    copies = cut(copies, "copies")
    points = full.where("rare is not null").join(copies.select(F.col("p").alias("row")), "row", "left_semi").select(F.col("row").alias("p"), "n", "rare", "at", "members")
    labels = link_points(points.drop("members"), points.select("p", "members"), counts)
    nodes = table.join(copies, ["high", "low"], "left").select("doc_id", "t", "row", "n", F.coalesce("p", "row").alias("p"))
    if labels is None:
        nodes = nodes.withColumn("label", F.col("p"))
    else:
        nodes = nodes.join(labels.select(F.col("node").alias("p"), F.col("component").alias("label")), "p", "left").withColumn("label", F.coalesce("label", "p"))
    nodes = cut(nodes, "nodes")
    # rows that share an id are one document: its sets meet at that id
    ids = nodes.where("doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("doc_id")
    if not ids.isEmpty():
        shared = nodes.join(ids, "doc_id", "left_semi")
        least = shared.groupBy("doc_id").agg(F.min("label").alias("b"))
        met = components(shared.join(least, "doc_id").select(F.col("label").alias("a"), "b"))
        nodes = nodes.join(met.select(F.col("node").alias("label"), "component"), "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component")
    lowest = F.lit(-(1 << 63))
    place = F.struct(F.coalesce("doc_id", lowest).alias("id"), "row")
    least = nodes.groupBy("label").agg(F.min(place).alias("v"), F.max(F.col("doc_id").isNull()).alias("none"))
    out = nodes.join(least, "label")
    return out.select("doc_id", "t", "row", "n", F.when(~F.col("none"), F.col("v.id")).alias("component_id"), (F.col("row") == F.col("v.row")).alias("first"))


def join_classes(docs: DataFrame, counts: dict[str, int] | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) for every row of docs.

    Null, empty and blank texts have no shingles and link with nothing. A null doc_id comes before all others, so a
    class with one has a null component_id; rows with a null doc_id are documents of their own. Rows that share
    another doc_id are one document: each gets a row, in the component that any of them reaches. An empty table gives
    an empty result. Very long texts are one set like any other. Only doc_id and text are read, so other columns can
    have any name.
    """
    return _classes(docs, counts).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one_a_class(docs: DataFrame) -> DataFrame:
    """One row of docs for each class, with all its columns: the first by doc_id (null first); of repeated rows, one.

    Rows with null, empty or blank texts link with nothing and stay, but for repeats of one doc_id.
    """
    return keep_rows(docs, _classes(docs).where("first"))
