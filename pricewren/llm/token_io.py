"""Token ids in a binary file format of fixed-width bit packing (operator 3).

A file holds the ids of some documents, each id in the minimum number of bits for the vocabulary:

    offset  what
    0       magic ``PWTOKEN1``, then bits, documents, ids, block size (little-endian unsigned 64-bit each)
    40      document ids (signed 64-bit), then one byte per document that is 1 where the document id is null
            document ends (unsigned 64-bit, in ids)
            block starts (unsigned 64-bit, in bytes from the payload's start), one more than there are blocks
            payload

Ids are packed low bits first. A block holds ``BLOCK`` ids (a multiple of 8, so it starts at a byte), so any
document can be read from its block starts alone, and a block unpacks in a few vectorised steps: eight ids fill
exactly ``bits`` bytes, whatever the width.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.llm import bpe
from pricewren.llm.common import fresh_path, texts_of

MAGIC = b"PWTOKEN1"
BLOCK = 4096


def bits_for(vocabulary_size: int) -> int:
    """The least width that holds every id below vocabulary_size."""
    return max(1, int(vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids, bits each, padded with zeros to a multiple of eight."""
    eights = np.zeros((-(-len(ids) // 8), 8), dtype=np.uint64)
    eights.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(eights), bits), dtype=np.uint8)
    for lane in range(8):
        first, shift = divmod(lane * bits, 8)
        moved = eights[:, lane] << np.uint64(shift)
        for k in range(-(-(bits + shift) // 8)):
            out[:, first + k] |= (moved >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()


def unpack(data: bytes | memoryview, bits: int, count: int) -> np.ndarray:
    """The first count ids of packed data that starts at a byte."""
    rows = -(-count // 8)
    packed = np.frombuffer(data, dtype=np.uint8, count=rows * bits).reshape(rows, bits)
    out = np.empty((rows, 8), dtype=np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for lane in range(8):
        first, shift = divmod(lane * bits, 8)
        wide = np.zeros(rows, dtype=np.uint64)
        for k in range(-(-(bits + shift) // 8)):
            wide |= packed[:, first + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, lane] = (wide >> np.uint64(shift)) & mask
    return out.reshape(-1)[:count]


def to_file(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """One file's bytes; ends: where each document's ids end."""
    packed = [pack(ids[a : a + BLOCK], bits) for a in range(0, len(ids), BLOCK)]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in packed])]).astype("<u8")
    head = np.array([bits, len(doc_ids), len(ids), BLOCK], dtype="<u8")
    names = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    return b"".join([MAGIC, head.tobytes(), names.tobytes(), nulls.tobytes(), ends.astype("<u8").tobytes(), starts.tobytes(), *packed])


class TokenFile:
    """Random access to the documents of one file's bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.bits, docs, self.n_ids, self.block = (int(x) for x in np.frombuffer(data, "<u8", 4, 8))
        at = 40
        names = np.frombuffer(data, "<i8", docs, at)
        nulls = np.frombuffer(data, np.uint8, docs, at := at + 8 * docs)
        self.doc_ids = [None if n else int(d) for d, n in zip(names, nulls, strict=True)]
        self.ends = np.frombuffer(data, "<u8", docs, at := at + docs).astype(np.int64)
        blocks = -(-self.n_ids // self.block)
        self.starts = np.frombuffer(data, "<u8", blocks + 1, at := at + 8 * docs).astype(np.int64)
        self.payload = memoryview(data)[at + 8 * (blocks + 1) :]

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end; only the blocks that hold them are unpacked."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        parts = [unpack(self.payload[self.starts[b] : self.starts[b + 1]], self.bits, min(self.block, self.n_ids - b * self.block)) for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Each document's id, start in the file and ids, with every block unpacked once."""
        done, held, at = 0, np.zeros(0, np.uint32), 0
        for k, doc in enumerate(self.doc_ids):
            start, end = int(self.ends[k - 1]) if k else 0, int(self.ends[k])
            while done < end:
                stop = min(self.n_ids, (done // self.block + 64) * self.block)
                held, at = np.concatenate([held[start - at :], self.ids(done, stop)]), start
                done = stop
            yield doc, start, held[start - at : end - at]


def _store(path: str, data: bytes) -> None:
    """Write under another name and rename, so that a task that runs again replaces the whole file or nothing."""
    import os
    import uuid

    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(name), recursive=True)
    with system.open_output_stream(part := f"{os.path.dirname(name)}/.{uuid.uuid4().hex}.part") as out:
        out.write(data)
    system.move(part, name)


def _qualified(spark: SparkSession, folder: str) -> str:
    """folder with the scheme of the file system that Spark resolves it to, which tasks and readers then share."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole if "://" in whole else whole.replace("file:", "file://", 1)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, partitions: int | None = None, file_bytes: int = 64 << 20) -> DataFrame:
    """Encode documents and write their ids, ascending by doc_id, as token files in folder; return the manifest.

    One row a file: file, first_key (its place in the order), n_docs, n_ids. Null texts count as empty (end_id
    alone, if given); null ids come first; rows that share a doc_id are ordered by their text. Only doc_id and text are
    read, so other columns can have any name; a text of any length is one document of one file. A partition of the
    range exchange writes its own files of at most about file_bytes, so no task holds more than one file.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folder = _qualified(docs.sparkSession, folder)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def store(batches):
        from pyspark import TaskContext

        pid, coder = TaskContext.get().partitionId(), bpe.load(tokenizer)
        bits = bits_for(coder.vocabulary_size)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = number = 0

        def flush():
            doc_ids = [d for part in held for d in part[0]]
            lengths = np.concatenate([part[1] for part in held])
            ids = np.concatenate([part[2] for part in held])
            name = f"tokens-{pid:06d}-{number:04d}.pwtok"
            _store(f"{folder}/{name}", to_file(doc_ids, np.cumsum(lengths), ids, bits))
            return pa.RecordBatch.from_pydict({"file": [name], "part": [pid], "number": [number], "n_docs": [len(doc_ids)], "n_ids": [len(ids)]})

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, ends = coder.encode_batch(texts_of(batch))
            lengths = np.diff(ends, prepend=0)
            if end_id is not None:
                ids = np.insert(ids, ends, end_id)
                lengths = lengths + 1
            held.append((batch.column("doc_id").to_pylist(), lengths, ids))
            size += len(ids) * bits // 8
            if size >= file_bytes:
                yield flush()
                held, size, number = [], 0, number + 1
        if held:
            yield flush()

    return ordered.mapInArrow(store, "file string, part long, number long, n_docs long, n_ids long")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Documents of the files in manifest: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The files are read by Spark's own reader, each task unpacking block by block. The running total is over files,
    of which there is one for every 64 MB of ids.
    """
    from pyspark.sql import Window

    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("file_start"))

    def unpacked(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                docs, at, count, crc = [], [], [], []
                for doc, start, ids in TokenFile(data.as_py()):
                    docs.append(doc)
                    at.append(start)
                    count.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_pydict({"file": [path.rsplit("/", 1)[-1]] * len(docs), "doc_id": pa.array(docs, pa.int64()), "at": at, "n_tokens": count, "ids_crc32": crc})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pwtok").load(folder)
    rows = files.select("path", "content").mapInArrow(unpacked, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, "file").select("doc_id", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int | None = None) -> DataFrame:
    """Write documents as token files into a new folder of the shared place and read them back."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    manifest_path = f"{folder}-manifest"
    write(docs, folder, tokenizer, end_id).write.parquet(manifest_path)
    manifest = spark.read.parquet(manifest_path)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(spark, folder, manifest)
