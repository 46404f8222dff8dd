"""Removal of repeated 100-byte strings, by a distributed difference-cover algorithm (operator 1).

Suffixes are sampled where their position in the document, modulo V, is in a difference cover: for any two positions
some shift below V takes both to samples. So two equal 100-byte strings hold a pair of samples at the same place, and
prefixes of WIDTH bytes at both are equal. Every round sorts names, merges them, and compares neighbours:

A. Samples are named by their WIDTH-byte prefixes, the names sorted, and neighbours compared: which names repeat, and
   which samples have an earlier sample of their name.
B. In place of a recursion on names, a sample whose name repeats is named anew by the names along LONG bytes (one hash of them). Where
   that name has an earlier place, all 100-byte strings that begin in the next V bytes have one too.
C. The suffixes that remain are those before a sample with an earlier one in A that B doesn't settle. The names of
   the samples that they reach are sorted once more, to find which other suffixes they must be merged with.
D. These remaining suffixes are sorted by their 100-byte prefixes, and neighbours compared.

Prefixes are sorted by hashes rather than letter by letter: equality of prefixes and order of places are all that is
asked. Names in A and C only choose what is looked at; what B and D settle has 96 bits, a rolling hash of 64 and 32 more
of an independent one: of 10^13 such names, two different ones agree with a probability of 0.0006. A chunk of documents sends each distinct name once, with its first place, so a name that a third of
all suffixes has is still one entry a chunk; answers come back as bits. Chunks are ranges of doc_id, so the number of
a chunk gives the order of places. Documents equal to an earlier one are settled by their hash alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewren.llm.common import cut, mix64, range_buckets, texts_of

LENGTH = 100
V = 57
#: A perfect difference set: fixed values.
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
WIDTH = LENGTH - V + 1
LONG = LENGTH + V - 1
#: Bytes of text in a chunk, and sampled names in a bucket, about. Both numbers follow the input alone.
CHUNK_BYTES, BUCKET_NAMES = 6 << 20, 2 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _letters() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Chunk:
    """The documents of a chunk that aren't copies, one after another in order of doc_id, with prefix hashes."""

    def __init__(self, texts: pa.Table, copies: set[tuple[int | None, bytes]]):
        ids, blobs = texts.column("doc_id").to_pylist(), texts_of(texts).cast(pa.large_binary()).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, blobs[i]))
        self.copies = [(ids[i], blobs[i]) for i in order if copies and (ids[i], xxhash.xxh3_128_digest(blobs[i])) in copies]
        kept = [i for i in order if not copies or (ids[i], xxhash.xxh3_128_digest(blobs[i])) not in copies]
        self.ids = [ids[i] for i in kept]
        self.data = np.frombuffer(b"".join(blobs[i] for i in kept), np.uint8)
        self.lengths = np.array([len(blobs[i]) for i in kept], dtype=np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        size = len(self.data)
        powers = np.full(size, BASE, np.uint64)
        powers[:1] = 1
        np.cumprod(powers, out=powers)
        powers *= _letters()[self.data]
        self.sums = np.zeros(size + 1, np.uint64)
        np.cumsum(powers, out=self.sums[1:])
        powers[:] = INVERSE
        powers[:1] = 1
        self.inverse = np.cumprod(powers, out=powers)
        local = np.arange(size, dtype=np.int64) - np.repeat(self.starts, self.lengths)
        self.left = np.repeat(self.lengths, self.lengths) - local  # bytes from here to the document's end
        in_cover = np.zeros(V, bool)
        in_cover[list(COVER)] = True
        self.samples = np.flatnonzero(in_cover[local % V] & (self.left >= WIDTH))
        self.local = local

    def names(self, at: np.ndarray, width: int) -> np.ndarray:
        """Hashes of the width bytes from each place in at."""
        return mix64((self.sums[at + width] - self.sums[at]) * self.inverse[at])

    def checks(self, at: np.ndarray, width: int) -> np.ndarray:
        """Further 32 bits of the width bytes from each place in at, made of the bytes themselves, eight at a time."""
        out = np.empty(len(at), np.uint32)
        eights = np.lib.stride_tricks.sliding_window_view(self.data, 8) if len(at) else None
        for a in range(0, len(at), 1 << 17):
            part = at[a : a + (1 << 17)]
            h = np.zeros(len(part), np.uint64)
            for k in (*range(0, width - 8, 8), width - 8):
                h = (h ^ eights[part + k].view("<u8").reshape(-1)) * np.uint64(BASE)
                h ^= h >> np.uint64(29)
            out[a : a + len(part)] = h >> np.uint64(32)
        return out

    def spread(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which places some range first..last (both included) covers."""
        edges = np.bincount(first, minlength=len(self.data) + 1) - np.bincount(last + 1, minlength=len(self.data) + 1)
        return np.cumsum(edges[:-1]) > 0

    def before(self, samples: np.ndarray) -> np.ndarray:
        """Which places begin a 100-byte string that can hold one of these samples below shift V."""
        first = samples - np.minimum(self.local[samples], V - 1)
        return self.spread(first, samples) & (self.left >= LENGTH)


def distinct(names: np.ndarray, checks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which entries are the first of their name, in order of names; each entry's place among them; which entries are a name's first.

    With checks, two entries have one name if these agree too.
    """
    order = np.argsort(names, kind="stable") if checks is None else np.lexsort((checks, names))
    ranked = names[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if checks is not None:
        ranked = checks[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    place = np.empty(len(names), np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.zeros(len(names), bool)
    first[order[new]] = True
    return order[new], place, first


class Replay:
    """A chunk's state after the rounds of which it has the answers: kind -> bits by distinct name."""

    def __init__(self, texts: pa.Table, info: pa.Table, log2: int):
        answers: dict[str, list[tuple[int, int, bytes, bytes]]] = {}
        copies: set[tuple[int | None, bytes]] = set()
        for kind, bucket, n, one, two in zip(*(info.column(c).to_pylist() for c in ("kind", "bucket", "n", "one", "two")), strict=True):
            if kind == "copy":
                copies.add((None if two else n, one))
            else:
                answers.setdefault(kind, []).append((bucket, n, one, two))
        self.log2, self.answers = log2, answers
        self.chunk = Chunk(texts, copies)

    def bits(self, kind: str) -> tuple[np.ndarray, np.ndarray]:
        rows = sorted(self.answers.get(kind, []))
        unpack = lambda k: np.concatenate([np.unpackbits(np.frombuffer(r[k], np.uint8), count=r[1]) for r in rows]).astype(bool) if rows else np.zeros(0, bool)
        return unpack(2), unpack(3)

    def short(self, names: np.ndarray) -> np.ndarray:
        return names >> np.uint64(32 - self.log2)

    def round(self, kind: str):
        """What round kind sends: distinct names in order (of 64 or, for A and C, fewer bits), their checks (B and D) and a flag for each (C)."""
        c = self.chunk
        names = self.short(c.names(c.samples, WIDTH))
        at, place, first = distinct(names)
        names = names[at]
        if kind == "A":
            return names, None, None
        shared, later = self.bits("A")
        shared = shared | (np.bincount(place, minlength=len(names)) > 1)
        is_shared, is_later = shared[place], later[place] | ~first
        long_at = c.samples[is_shared & (c.left[c.samples] >= LONG)]
        long_names, checks = c.names(long_at, LONG), c.checks(long_at, LONG)
        at, long_place, long_first = distinct(long_names, checks)
        if kind == "B":
            return long_names[at], checks[at], None
        settled_at = long_at[self.bits("B")[1][long_place] | ~long_first]
        settled = c.spread(settled_at, settled_at + V - 1)
        open_ = c.before(c.samples[is_shared & is_later]) & ~settled
        total = np.concatenate([[0], np.cumsum(open_)])
        reach = total[c.samples + 1] - total[c.samples - np.minimum(c.local[c.samples], V - 1)] > 0
        # only samples of shared names are sent; a name's flag says that an open suffix reaches it
        sent = np.flatnonzero(shared)
        flag = np.bincount(place[reach & is_shared & is_later], minlength=len(names))[sent] > 0
        if kind == "C":
            return names[sent], None, flag
        wanted = np.zeros(len(names), bool)
        wanted[sent] = self.bits("C")[0] | flag
        ask = open_ | (c.before(c.samples[wanted[place]]) & ~settled)
        ask_at = np.flatnonzero(ask)
        d_names, checks = c.names(ask_at, LENGTH), c.checks(ask_at, LENGTH)
        at, d_place, d_first = distinct(d_names, checks)
        if kind == "D":
            return d_names[at], checks[at], None
        repeats = self.bits("D")[1][d_place] | ~d_first
        return settled & (c.left >= LENGTH), ask_at[repeats]

    def result(self) -> tuple[list, list[int], list[int], list[int], list[bytes]]:
        """doc_id, n_bytes, n_removed, n_spans and the kept bytes of each document of the chunk."""
        c = self.chunk
        out = ([], [], [], [], [])

        def add(doc, blob, gone, spans, kept):
            for column, value in zip(out, (doc, blob, gone, spans, kept), strict=True):
                column.append(value)

        if len(c.data):
            settled, more = self.round("end")
            starts = np.flatnonzero(settled)
            starts = np.concatenate([starts, more])
            gone = c.spread(starts, starts + LENGTH - 1)
        else:
            gone = np.zeros(0, bool)
        for doc, a, b in zip(c.ids, c.starts.tolist(), c.ends.tolist(), strict=True):
            own = gone[a:b]
            n = int(own.sum())
            spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if n else 0
            add(doc, b - a, n, spans, (c.data[a:b][~own] if n else c.data[a:b]).tobytes())
        for doc, blob in c.copies:
            all_gone = len(blob) >= LENGTH
            add(doc, len(blob), len(blob) if all_gone else 0, int(all_gone), b"" if all_gone else blob)
        return out


INFO = "chunk int, kind string, bucket int, n long, one binary, two binary"


def _send(kind: str, log2: int):
    bits = 64 if kind in "BD" else 32 + log2

    def send(texts: pa.Table, info: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({"chunk": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "names": pa.array([], pa.binary()), "more": pa.array([], pa.binary())})
        names, checks, flags = Replay(texts, info, log2).round(kind)
        bucket = (names >> np.uint64(bits - log2)).astype(np.int64)
        edges = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=-1)), [len(names)]])
        low = names.astype("<u8") if bits == 64 else (names & np.uint64(0xFFFFFFFF)).astype("<u4")
        spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        more = {"A": lambda a, b: b"", "C": lambda a, b: np.packbits(flags[a:b]).tobytes()}.get(kind, lambda a, b: checks[a:b].astype("<u4").tobytes())
        return pa.table({
            "chunk": pa.array(np.full(len(spans), texts.column("chunk")[0].as_py(), np.int32)), "bucket": pa.array(bucket[edges[:-1]].astype(np.int32)),
            "names": pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()), "more": pa.array([more(a, b) for a, b in spans], pa.binary()),
        })

    return send


def _answer(kind: str):
    """For the names of a bucket from all chunks: whether others have them (C: whether a flag is up), and whether earlier ones do."""

    def answer(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("chunk").to_pylist(), table.column("names").to_pylist(), table.column("more").to_pylist(), strict=True))
        blobs = [np.frombuffer(n, "<u8" if kind in "BD" else "<u4") for _, n, _ in rows]
        checks = np.concatenate([np.frombuffer(m, "<u4") for *_, m in rows]) if kind in "BD" else None
        at, place, first = distinct(np.concatenate(blobs), checks)
        if kind == "C":
            flags = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=len(b)) for (_, _, f), b in zip(rows, blobs, strict=True)])
            one = np.bincount(place, weights=flags, minlength=len(at))[place] > 0
        else:
            one = np.bincount(place, minlength=len(at))[place] > 1
        ends = np.cumsum([len(b) for b in blobs])
        pack = lambda bits: pa.array([np.packbits(bits[e - len(b) : e]).tobytes() for b, e in zip(blobs, ends, strict=True)], pa.binary())
        return pa.table({"chunk": pa.array([c for c, _, _ in rows], pa.int32()), "kind": [kind] * len(rows), "bucket": pa.array([table.column("bucket")[0].as_py()] * len(rows), pa.int32()), "n": pa.array([len(b) for b in blobs], pa.int64()), "one": pack(one), "two": pack(~first)})

    return answer


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, ``kept`` (binary) for every row of docs.

    Removed is each byte covered by a 100-byte string that also starts earlier: in a document of smaller doc_id, or
    earlier in the same. Null texts count as empty; a null doc_id comes before all others; rows that share a doc_id
    follow each other by text. Strings are judged on the input. Only doc_id and text are read.
    """
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first()["n"] or 0
    n = max(4, -(-size // CHUNK_BYTES))
    log2 = max(2, min(24, (size * len(COVER) // V // BUCKET_NAMES).bit_length()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = range_buckets(rows, "doc_id", n, "chunk")

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("doc_id"), pa.array([xxhash.xxh3_128_digest(t) for t in texts_of(batch).cast(pa.large_binary()).to_pylist()], pa.binary())], names=["chunk", "doc_id", "h"])

    hashes = cut(rows.mapInArrow(hashed, "chunk int, doc_id long, h binary"), "hashes")
    rank = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    firsts = hashes.groupBy("h").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1").select("h", "first")
    copied = hashes.join(firsts, "h").where(rank > F.col("first")).select("chunk", F.lit("copy").alias("kind"), F.lit(0).alias("bucket"), F.col("doc_id").alias("n"), F.col("h").alias("one"), F.lit(None).cast("binary").alias("two"))
    info = cut(copied.distinct(), "copies")
    dealt = rows.repartition(n, "chunk")
    for kind in "ABCD":
        sent = dealt.groupBy("chunk").cogroup(info.groupBy("chunk")).applyInArrow(_send(kind, log2), "chunk int, bucket int, names binary, more binary")
        info = info.unionByName(cut(sent.groupBy("bucket").applyInArrow(_answer(kind), INFO), f"round-{kind}"))

    def finish(texts: pa.Table, answers: pa.Table) -> pa.Table:
        ids, n_bytes, removed, spans, kept = Replay(texts, answers, log2).result() if texts.num_rows else ([], [], [], [], [])
        out = {"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return dealt.groupBy("chunk").cogroup(info.groupBy("chunk")).applyInArrow(finish, schema)
