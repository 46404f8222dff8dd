"""Exact deduplication with counting quotient filters (operator 2).

Every partition builds a counting quotient filter of the 64-bit fingerprints of its normalised texts: the high bits
(the quotient) choose a slot run, the low bits (the remainder) are kept sorted in it with a count. Filters over
disjoint partitions merge without loss by merging sorted remainders. Fingerprints whose count is above one are routed
to byte verification, where rows are grouped by the normalised text itself; the rest are settled by the filter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewren.llm.common import cut, keep_rows, release, row_hash, texts_of

SPACE = b" \t\n\x0b\x0c\r"
#: A fingerprint is hot when it has more than this part of all rows, so there are at most HOT of them; its rows are
#: dealt over SALTS keys before copies are put together.
HOT, SALTS = 10_000, 32


def normalise(text: str) -> bytes:
    """UTF-8 of the text without `[\\x20\\x09-\\x0D]`."""
    return text.encode("utf-8", "surrogatepass").translate(None, SPACE)


class CountingQuotientFilter:
    """Sorted remainders with counts, in one run per quotient.

    run_ends[q] is where the run of quotient q ends among the remainders.
    """

    def __init__(self, quotient_bits: int, run_ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotient_bits, self.run_ends, self.remainders, self.counts = quotient_bits, run_ends, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, quotient_bits: int, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """Of unsigned 64-bit fingerprints; counts: how often each is there (once if not given)."""
        order = np.argsort(fingerprints, kind="stable")
        return cls.sorted(fingerprints[order], quotient_bits, np.ones(len(order), np.int64) if counts is None else counts[order])

    @classmethod
    def sorted(cls, values: np.ndarray, quotient_bits: int, each: np.ndarray) -> CountingQuotientFilter:
        """Of ascending fingerprints with their counts; equal ones are put together."""
        first = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
        at = np.flatnonzero(first)
        distinct = values[at]
        low = np.uint64(64 - quotient_bits)
        ends = np.searchsorted(distinct >> low, np.arange(1 << quotient_bits, dtype=np.uint64), side="right")
        return cls(quotient_bits, ends, distinct & np.uint64((1 << int(low)) - 1), np.add.reduceat(each, at) if len(at) else each)

    def fingerprints(self) -> np.ndarray:
        quotients = np.repeat(np.arange(len(self.run_ends), dtype=np.uint64), np.diff(self.run_ends, prepend=0))
        return (quotients << np.uint64(64 - self.quotient_bits)) | self.remainders

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """The filter of both inputs' fingerprints: the sorted remainders of each run of other go in between those of self."""
        a, b = self.fingerprints(), other.fingerprints()
        at = np.searchsorted(a, b)
        values, counts = np.insert(a, at, b), np.insert(self.counts, at, other.counts)
        return self.sorted(values, max(self.quotient_bits, other.quotient_bits), counts)

    def repeated(self) -> np.ndarray:
        return self.fingerprints()[self.counts > 1]


def digest(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, t (row_hash), n_chars (code points of the original), fp (64 bits), text_sha256 and, if asked, the normalised text."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), row_hash().alias("t"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow.compute as pc

        for batch in batches:
            texts = texts_of(batch)
            normal = [normalise(t) for t in texts.to_pylist()]
            columns = {
                "doc_id": batch.column("doc_id"),
                "t": batch.column("t"),
                "n_chars": pc.utf8_length(texts).cast(pa.int64()),
                "fp": pa.array(np.array([xxhash.xxh3_64_intdigest(t) for t in normal], dtype=np.uint64).view(np.int64)),
                "text_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in normal]),
            }
            if with_text:
                columns["normal"] = pa.array(normal, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)
        release()

    return rows.mapInArrow(run, f"doc_id {id_type}, t long, n_chars long, fp long, text_sha256 string" + ", normal binary" * with_text)


def repeated_fingerprints(digests: DataFrame, rows: int, block_rows: int = 200_000) -> DataFrame:
    """Fingerprints (column fp) that more than one of the rows has, and how many (n), by merging the partitions' filters block by block.

    A block is a range of quotients; their number follows the rows, so a merge always handles about block_rows
    distinct fingerprints. Equal ones are already one entry in each partition's filter. A partition sends nothing to
    a block that it has no fingerprint of, and a filter's run ends are no more than its fingerprints.
    """
    block_bits = max(1, min(32, (max(1, rows) // block_rows).bit_length()))

    def build(batches):
        held = [np.asarray(b.column("fp").drop_null()).view(np.uint64) for b in batches]
        fps = np.concatenate(held) if held else np.zeros(0, np.uint64)
        if not len(fps):
            return
        fps = np.sort(fps)
        blocks = fps >> np.uint64(64 - block_bits)
        edges = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1], [True]]))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            f = CountingQuotientFilter.of(fps[a:b] << np.uint64(block_bits), max(1, min(8, int(b - a).bit_length() - 1)))
            yield pa.RecordBatch.from_pydict({"block": [int(blocks[a])], "bits": pa.array([f.quotient_bits], pa.int32()), "run_ends": [f.run_ends.astype("<u4").tobytes()], "remainders": [f.remainders.astype("<u8").tobytes()], "counts": [f.counts.astype("<i8").tobytes()]})

    def merged(table: pa.Table) -> pa.Table:
        filters = [
            CountingQuotientFilter(q, np.frombuffer(e, "<u4").astype(np.int64), np.frombuffer(r, "<u8"), np.frombuffer(c, "<i8"))
            for q, e, r, c in zip(*(table.column(n).to_pylist() for n in ("bits", "run_ends", "remainders", "counts")), strict=True)
        ]
        while len(filters) > 1:
            filters = [filters[i].merge(filters[i + 1]) if i + 1 < len(filters) else filters[i] for i in range(0, len(filters), 2)]
        block = np.uint64(table.column("block")[0].as_py())
        found = (filters[0].repeated() >> np.uint64(block_bits)) | (block << np.uint64(64 - block_bits))
        return pa.table({"fp": pa.array(found.view(np.int64)), "n": pa.array(filters[0].counts[filters[0].counts > 1])})

    built = digests.select("fp").mapInArrow(build, "block long, bits int, run_ends binary, remainders binary, counts binary")
    return built.groupBy("block").applyInArrow(merged, "fp long, n long")


def _groups(docs: DataFrame) -> DataFrame:
    """The digests of docs with ``first_id``, ``first_t`` and ``size`` of each row's group; null where the row is alone."""
    digests = cut(digest(docs), "digests")
    rows = digests.count()
    repeated = cut(repeated_fingerprints(digests, rows), "repeated")
    hot = repeated.where(F.col("n") * HOT > rows).select("fp", F.lit(SALTS).alias("salts"))  # fewer than HOT rows
    own = F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod("t", F.lit(SALTS))).cast("int")
    dealt = digest(docs, with_text=True).join(F.broadcast(hot), "fp", "left").withColumn("salt", own)
    salts = repeated.select("fp", F.explode(F.sequence(F.lit(0), F.when(F.col("n") * HOT > rows, SALTS - 1).otherwise(0))).alias("salt"))
    suspects = dealt.join(salts, ["fp", "salt"], "left_semi")
    # rows are put together by the bytes themselves, first within each task
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("t").alias("t")))
    verified = suspects.groupBy("fp", "normal").agg(best.alias("best"), F.count(F.lit(1)).alias("size"), F.first("text_sha256").alias("text_sha256"))
    groups = cut(verified.where("size > 1").select("fp", "text_sha256", F.col("best.doc_id").alias("first_id"), F.col("best.t").alias("first_t"), "size"), "groups")
    return digests.join(groups, ["fp", "text_sha256"], "left")


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs.

    Texts are equal when identical after deleting `[\\x20\\x09-\\x0D]`; null counts as empty, so null, empty and blank
    texts are one group. Of a group, the row with the most code points stays, then the smallest doc_id; a null id
    comes last. Rows that repeat a doc_id stand or fall together here. Only doc_id and text are read.
    """
    keep_id = F.when(F.col("size").isNotNull(), F.col("first_id")).otherwise(F.col("doc_id"))
    return _groups(docs).select("doc_id", keep_id.alias("keep_id"), F.coalesce("size", F.lit(1)).alias("group_size"), keep_id.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """One row of docs for each text, with all its columns: the row that duplicate_groups keeps, and of repeats of it, one."""
    first = F.col("size").isNull() | (F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("t") == F.col("first_t")))
    return keep_rows(docs, _groups(docs).where(first))
