"""Token-id files: patched frame-of-reference blocks with an index of block starts.

A file holds, each followed by one line feed (the sink's record end, counted in all offsets):

* header: magic, number of the file (u64)
* blocks of up to 4096 ids: smallest id (u32), number of ids (u16), width in bits (u8), number of
  exceptions (u16), ids less the smallest at ``width`` bits each, positions (u16) and values (u32) of
  the exceptions, whose packed bits are zero
* block starts (u64 each)
* documents: doc_id (i64), null flag (u8), number of ids (u64), each as one run of all documents
* footer: offsets of block starts and of documents, numbers of blocks, documents and ids (u64 each), magic

All numbers are little-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import land, shared_path
from .tokens import encoder, in_portions

MAGIC = b"PFORTOK1"
BLOCK = 4096
#: Share of a block's ids that the packed width must hold; the rest are exceptions.
PERCENTILE = 0.98
#: Characters of texts that a task encodes at once.
PORTION = 1_000_000
#: Bytes of text behind one file; a reader takes a file whole.
BYTES_PER_FILE = 1 << 28
END_ID = 2

#: Layouts of header, block and footer.
_HEAD, _BLOCK, _FOOT = "<8sQ", "<IHBH", "<QQQQQ8s"

#: Widths whose packed bits are plain numbers.
_ALIGNED = {8: "<u1", 16: "<u2", 32: "<u4"}


def pack_block(ids: np.ndarray) -> bytes:
    """One block of up to 4096 ids."""
    least = int(ids.min())
    rest = ids.astype(np.uint32) - np.uint32(least)
    width = int(np.partition(rest, k := min(len(rest) - 1, int(PERCENTILE * len(rest))))[k]).bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    values = rest[odd]
    rest[odd] = 0
    if width in _ALIGNED:
        packed = rest.astype(_ALIGNED[width]).tobytes()
    else:
        packed = np.packbits(np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little") if width else np.empty(0, np.uint8), bitorder="little").tobytes()
    return struct.pack(_BLOCK, least, len(ids), width, len(odd)) + packed + odd.astype("<u2").tobytes() + values.astype("<u4").tobytes()


def unpack_block(data: memoryview) -> np.ndarray:
    """The ids of the block that ``data`` begins with."""
    least, n, width, odd = struct.unpack_from(_BLOCK, data)
    at, size = struct.calcsize(_BLOCK), (n * width + 7) // 8
    if width in _ALIGNED:
        ids = np.frombuffer(data, _ALIGNED[width], n, at).astype("<u4")
    else:
        bits = np.zeros((n, 32), np.uint8)
        bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
        ids = np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()
    where = np.frombuffer(data, "<u2", odd, at + size)
    ids[where] = np.frombuffer(data, "<u4", odd, at + size + 2 * odd)
    return ids + np.uint32(least)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", bytes_per_file: int = BYTES_PER_FILE) -> None:
    """Encode every whole text, append ``end_id``, and write the ids in ascending order of the id.

    Documents are range-partitioned by id on sampled splitters and sorted; each partition streams its
    blocks into one file through Spark's text sink, so files appear only when their task commits, in
    any file system that Spark writes. A task holds one portion of texts and its documents' counts.
    The texts' bytes are added up first, so that there are enough partitions for files of about ``bytes_per_file`` of
    text; rows of one id (a null id may be a third of all) are ranged by a hash of their text, too.

    Defined cases: a null or empty text has the end id alone; null ids come first; rows that repeat an
    id are written each; an empty table writes no ids; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = 0, []

        def put(data: bytes) -> None:
            nonlocal at
            rows.append(data)
            at += len(data) + 1

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])
            rows.clear()
            return batch

        left, starts, ids, counts = np.empty(0, "<u4"), [], [], []
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids.append(batch.column(0))
            for part in in_portions(texts, PORTION):
                if not at:
                    put(struct.pack(_HEAD, MAGIC, TaskContext.get().partitionId()))
                coded, n = encoder(tokenizer).encode_ended(texts[part], end_id)
                counts.append(n.astype("<u8"))
                left = np.concatenate((left, coded))
                whole = len(left) // BLOCK
                for block in left[: whole * BLOCK].reshape(whole, BLOCK):
                    starts.append(at)
                    put(pack_block(block))
                left = left[whole * BLOCK :].copy()
                yield flushed()
        if at:
            if len(left):
                starts.append(at)
                put(pack_block(left))
            index = at
            put(np.array(starts, "<u8").tobytes())
            table = at
            all_ids, all_counts = pa.concat_arrays(ids), np.concatenate(counts)
            put(all_ids.fill_null(0).to_numpy().astype("<i8").tobytes() + all_ids.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes() + all_counts.tobytes())
            put(struct.pack(_FOOT, index, table, len(starts), len(all_ids), int(all_counts.sum()), MAGIC))
            yield flushed()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    files = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bytes_per_file)
    # With few bytes the session's number of partitions is enough, which adaptive plans may still lower.
    enough = files <= int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(*order) if enough else rows.repartitionByRange(files, *order)
    ranged.sortWithinPartitions(*order).mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.text(path)


def _footer(content: memoryview) -> tuple[int, ...]:
    *numbers, magic = struct.unpack_from(_FOOT, content, len(content) - struct.calcsize(_FOOT) - 1)
    head, file_no = struct.unpack_from(_HEAD, content)
    if magic != MAGIC or head != MAGIC:
        raise ValueError("not a token-id file")
    return file_no, *numbers


def decode_files(spark: SparkSession, path: str) -> DataFrame:
    """``file_no, doc_id, start, n_tokens, ids`` from the files in ``path``, each decoded on its own: ``start`` counts within the file, ``ids`` is binary, little-endian unsigned 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _documents(memoryview(content.as_buffer()))

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(run, "file_no long, doc_id long, start long, n_tokens long, ids binary")


def global_starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` with ``start`` counted over all files. ``files`` (``file_no, ids``) has one row for each file; these few are added up and broadcast."""
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("file_no", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(base), "file_no").withColumn("start", F.col("before") + F.col("start")).drop("file_no", "before")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files in ``path``: ``start`` counts the ids of all documents before. Files' footers tell how many ids each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_footer(memoryview(c.as_buffer())) for c in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[5] for f in found], pa.int64())], ["file_no", "ids"])

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInArrow(run, "file_no long, ids long")
    return global_starts(decode_files(spark, path), files)


def _documents(content: memoryview, portion: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of the documents of one file, about ``portion`` ids at a time."""
    file_no, index, table, n_blocks, n_docs, _ = _footer(content)
    starts = np.frombuffer(content, "<u8", n_blocks, index)
    doc_ids = pa.array(np.frombuffer(content, "<i8", n_docs, table), mask=np.frombuffer(content, "u1", n_docs, table + 8 * n_docs).astype(bool))
    counts = np.frombuffer(content, "<u8", n_docs, table + 9 * n_docs).astype(np.int64)
    ends = np.cumsum(counts)
    first = 0
    while first < n_docs:
        begin = int(ends[first] - counts[first])
        last = max(first + 1, int(np.searchsorted(ends, begin + portion, side="right")))
        stop = int(ends[last - 1])
        blocks = range(begin // BLOCK, -(-stop // BLOCK))
        ids = np.concatenate([unpack_block(content[starts[b] :]) for b in blocks])[begin - blocks.start * BLOCK : stop - blocks.start * BLOCK]
        offsets = np.concatenate(([begin], ends[first:last])) - begin
        blobs = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer((4 * offsets).astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
        n = last - first
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, file_no, np.int64)), doc_ids.slice(first, n), pa.array(ends[first:last] - counts[first:last]), pa.array(counts[first:last]), blobs],
            ["file_no", "doc_id", "start", "n_tokens", "ids"],
        )
        first = last


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    rows = land(decode_files(spark, path).select("file_no", "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")), "decoded")
    return global_starts(rows, rows.groupBy("file_no").agg(F.sum("n_tokens").alias("ids")))
