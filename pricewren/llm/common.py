"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a session whose executors run in the driver's own process (local, as in tests) gets a temporary
    folder; any other has to name one, as parts written to the executors' own disks would be missed later.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("pricewren.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        folder = tempfile.mkdtemp(prefix="pricewren-")
        spark.conf.set("pricewren.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: it ends the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash_mod(column: str | Column, mod: int) -> Column:
    """crc32 of a value written as text, modulo mod; null values count as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def text_bytes(rows: DataFrame) -> int:
    """Bytes of UTF-8 in the text column."""
    return rows.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first()["n"] or 0


def row_hash() -> Column:
    """64 bits that tell rows with one doc_id apart by their text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that kept names by doc_id and t (row_hash); of rows that repeat both, one."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"), F.col("doc_id").isNull().alias("none"), row_hash().alias("t"), F.xxhash64(*plain).alias("tie"))
    names = kept.select(key.alias("key"), F.col("doc_id").isNull().alias("none"), "t")
    stay = rows.join(names, ["key", "none", "t"], "left_semi")
    first = F.row_number().over(Window.partitionBy("key", "none", "t").orderBy("tie"))
    return stay.withColumn("place", first).where("place = 1").select("row.*")


def release() -> None:
    """Give the memory that Arrow and the C library keep for reuse back, as a worker lives on in other stages."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def texts_of(batch: pa.RecordBatch | pa.Table, name: str = "text") -> pa.Array:
    """The text column as one large_string array, null as the empty text."""
    column = batch.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: the distinct words, each word's place among them, and offsets by text.

    Only A-Z is lower-cased. Arrow does the splitting and the dictionary, so Python sees each distinct word once a batch.
    """
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    words, offsets = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.not_equal(pc.binary_length(words), 0)) if len(words) else np.zeros(0, bool)
    if not full.all():
        words = words.filter(pa.array(full))
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
    coded = words.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices).astype(np.int64), offsets


def ragged_take(starts: np.ndarray, lengths: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the concatenated runs starts[i]:starts[i]+lengths[i] for i in picks, and each pick's end in the result."""
    size = lengths[picks]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    places = np.arange(total, dtype=np.int64) + np.repeat(starts[picks] - (ends - size), size)
    return places, ends


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on an array of unsigned 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def bucket_count(buckets: int, most: int = 256) -> int:
    """How many numbers range_buckets gives at most for so many buckets: whole parts of each quantile range."""
    n = max(1, min(buckets, most))
    return n * -(-buckets // n)


def range_buckets(df: DataFrame, column: str, buckets: int, name: str, most: int = 256) -> DataFrame:
    """df with ``name``, a bucket number that rises with column, for about as many rows in each bucket; null is in bucket 0.

    Up to ``most`` limits are quantiles of the column, found by a binary search in the expression. Where more buckets
    are asked for, each of these ranges is divided at its own quantiles, which are eight bytes a bucket to broadcast.
    """
    n = max(1, min(buckets, most))
    cuts = df.agg(F.percentile_approx(column, [k / n for k in range(n + 1)], 10_000).alias("q")).first()["q"] or [0]
    cuts = sorted(set(cuts[1:-1]))
    parts = -(-buckets // n)

    def search(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        mid = (a + b) // 2
        return F.when(F.col(column) < cuts[mid], search(a, mid)).otherwise(search(mid + 1, b))

    out = df.withColumn(name, F.when(F.col(column).isNull(), F.lit(0)).otherwise(search(0, len(cuts))).cast("int"))
    if parts == 1:
        return out
    inner = out.groupBy(name).agg(F.percentile_approx(column, [k / parts for k in range(1, parts)], 10_000).alias("_cuts"))
    below = F.when(F.col(column).isNull(), F.lit(0)).otherwise(F.size(F.filter("_cuts", lambda x: x <= F.col(column))))
    return out.join(F.broadcast(inner), name).withColumn(name, (F.col(name) * parts + below).cast("int")).drop("_cuts")
