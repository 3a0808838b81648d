"""Best-fit packing of token sequences, by exact-complement hashing."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import land
from .tokens import encoder, in_portions

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that one task ranks at most, about.
RANKED_AT_ONCE = 2_000

Pattern = tuple[tuple[int, ...], int]


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids``: every text's ids with the end id, cut at ``capacity`` only where longer.

    ``ids`` is binary, little-endian unsigned 32-bit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in in_portions(texts):
                ids, counts = encoder(tokenizer).encode_ended(texts[part], end_id)
                pieces = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, counts[doc] - start)
                # Pieces lie one after the other as the texts do.
                offsets = np.append(0, 4 * np.cumsum(length)).astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, len(counts)).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), blobs],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


class _Available:
    """Counts by length, with a bit for each length that is left, and the same bits mirrored: lengths that add up to a gap are one AND away."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.counts, self.capacity, self.bits, self.mirror = dict(counts), capacity, 0, 0
        for n in self.counts:
            self.bits |= 1 << n
            self.mirror |= 1 << (capacity - n)

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for n in lengths:
            self.counts[n] -= times
            if not self.counts[n]:
                self.bits &= ~(1 << n)
                self.mirror &= ~(1 << (self.capacity - n))

    def largest(self, limit: int) -> int:
        """The largest length left that is at most ``limit``, or 0."""
        return max(0, (self.bits & ((1 << (limit + 1)) - 1)).bit_length() - 1)

    def times(self, lengths: tuple[int, ...]) -> int:
        need: dict[int, int] = defaultdict(int)
        for n in lengths:
            need[n] += 1
        return min(self.counts.get(n, 0) // k for n, k in need.items())

    def pair(self, gap: int, limit: int, held: tuple[int, ...]) -> tuple[int, int] | None:
        """Two lengths that add up to ``gap``, the larger as large as ``limit`` allows."""
        found = self.bits & (self.mirror >> (self.capacity - gap)) & ((1 << (min(limit, gap - 1) + 1)) - 1)
        while found:
            a = found.bit_length() - 1
            if 2 * a < gap:
                return None
            if self.times((*held, a, gap - a)):
                return a, gap - a
            found &= ~(1 << a)
        return None

    def exact(self, first: int, others: int) -> tuple[int, ...] | None:
        """``first`` with one, two or three others that fill the capacity exactly."""
        gap = self.capacity - first
        if others == 1:
            return (first, gap) if self.times((first, gap)) else None
        if others == 2:
            two = self.pair(gap, first, (first,))
            return (first, *two) if two else None
        a = self.largest(min(first, gap - 2))
        while 3 * a >= gap and a > 0:
            if self.times((first, a)) and (two := self.pair(gap - a, a, (first, a))):
                return first, a, *two
            a = self.largest(a - 1)
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns of lengths and how many sequences follow each, for ``counts`` pieces of each length.

    Works on the histogram, which has ``capacity`` entries however many pieces there are. Exact fills
    with two or three others can use up the short pieces that many long ones need; so plans with fills
    of up to three, two and one others are made, and the one with the fewest sequences is taken.
    """
    return min((_plan(counts, capacity, most) for most in (3, 2, 1)), key=lambda p: sum(times for _, times in p))


def _plan(counts: dict[int, int], capacity: int, most: int) -> list[Pattern]:
    """From the longest length down, combinations of one, then two, then three others that fill the
    gap exactly are consumed as often as the counts allow; what is left goes, longest first, into the
    sequence with the smallest gap that takes it.
    """
    left = _Available({n: c for n, c in counts.items() if c and n < capacity}, capacity)
    patterns: list[Pattern] = [((capacity,), counts[capacity])] if counts.get(capacity) else []
    for others in range(1, most + 1):
        for first in sorted((n for n, c in left.counts.items() if c), reverse=True):
            while left.counts[first] and (found := left.exact(first, others)):
                times = left.times(found)
                left.take(found, times)
                patterns.append((found, times))

    open_at: dict[int, list[Pattern]] = defaultdict(list)
    gaps = 0
    for n in sorted((n for n, c in left.counts.items() if c), reverse=True):
        c = left.counts[n]
        while c:
            fit = gaps >> n
            if not fit:
                # None fits: the rest of this length fills sequences of its own.
                full, rest = divmod(c, capacity // n)
                for own, times in (((n,) * (capacity // n), full), ((n,) * rest, 1 if rest else 0)):
                    if times:
                        open_at[capacity - n * len(own)].append((own, times))
                        gaps |= 1 << (capacity - n * len(own))
                break
            gap = n + (fit & -fit).bit_length() - 1
            lengths, times = open_at[gap].pop()
            each = gap // n
            used = min(times, -(-c // each))
            more = min(each, c // used)
            used = min(used, c // more)
            if times > used:
                open_at[gap].append((lengths, times - used))
            if not open_at[gap]:
                gaps &= ~(1 << gap)
            rest = gap - n * more
            open_at[rest].append(((*lengths, *(n,) * more), used))
            gaps |= 1 << rest
            c -= used * more
    return patterns + [p for at in open_at.values() for p in at]


def _places(patterns: list[Pattern], offset: int = 0) -> dict[str, np.ndarray]:
    """For each length of each pattern: the ranks it takes (of all pieces of that length), and where they go. Sorted by length and rank."""
    rows, used, sequence = [], defaultdict(int), offset
    for lengths, times in patterns:
        at = 0
        for n in dict.fromkeys(lengths):
            k = lengths.count(n)
            rows.append((n, used[n], k, sequence, at))
            used[n] += k * times
            at += k * n
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {name: table[:, i] for i, name in enumerate(("length", "rank", "each", "sequence", "offset"))}


def ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Add ``rank``: gapless from 0 among the pieces of one length.

    A frequent length is split into buckets by hash; ranks within a bucket and the buckets' totals
    added up give the rank, so no task sees all pieces of a length.
    """
    spark = pieces.sparkSession
    buckets = spark.createDataFrame([(n, -(-c // RANKED_AT_ONCE)) for n, c in counts.items()], "length long, buckets long")
    dealt = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.col("buckets"))).drop("buckets")
    totals = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    return dealt.withColumn("own", own).join(totals, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "bucket")


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (``doc_id, piece, length``, and more columns).

    Pieces of one length are interchangeable, so the plan is made from their histogram, on the driver
    (at most ``capacity`` counts, at any size of input); each piece then finds its place from its
    length and its rank by arithmetic. ``pieces`` must be a stored table: it is read twice.
    """
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(plan(counts, capacity))
    shift = max(1, math.ceil(math.log2(max([1, *counts.values()]) + 1)))
    if shift + capacity.bit_length() > 62:
        raise ValueError("more pieces of one length than a long can rank")
    keys = (places["length"] << shift) + places["rank"]
    shared = pieces.sparkSession.sparkContext.broadcast((keys, places))
    schema = pieces.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, places = shared.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            i = np.searchsorted(keys, (length << shift) + rank, side="right") - 1
            within, each = rank - places["rank"][i], places["each"][i]
            sequence, offset = places["sequence"][i] + within // each, places["offset"][i] + within % each * length
            own = [batch.column(batch.schema.get_field_index(c)) for c in schema.names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(offset)], [*schema.names, "sequence_id", "offset"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return ranked(pieces, counts).select(*schema.names, "rank").mapInArrow(run, f"{out}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents' ids into few sequences of at most ``capacity`` ids.

    Returns a row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    :func:`sequences` gives the packed ids themselves.

    Defined cases: a null or empty text is one piece of the end id; a null id passes through; rows that
    repeat an id are packed each; an empty table gives no rows; other columns are ignored.
    """
    pieces = token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col)
    return assign(land(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces"), capacity)


def sequences(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences: ``sequence_id, length, ids`` (binary, little-endian unsigned 32-bit) and ``pieces`` (what lies where).

    A sequence gathers at most ``capacity`` ids.
    """
    placed = assign(land(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces"), capacity)
    row = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    gathered = placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(row)).alias("p"))
    return gathered.select("sequence_id", "length", F.expr("aggregate(p, cast('' as binary), (all, x) -> concat(all, x.ids))").alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("pieces"))


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
