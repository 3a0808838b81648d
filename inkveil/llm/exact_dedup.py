"""Exact dedup by content sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, keep_rows, land

#: Characters of the normalised text that lead the sort key; the digest that follows tells longer texts apart.
PREFIX = 32

_ROW = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("first_id", pa.int64()), ("first_rank", pa.int64()), ("rows_here", pa.int64()), ("edge", pa.bool_())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare neighbours of one sorted partition in full; a row for each document, with its run's first and size.

    Holds ids of the open run only. ``edge`` marks the first and the last run, which may go on in
    the partitions beside this one.
    """
    held: list[np.ndarray] = []
    first: tuple[int | None, int, str] | None = None
    last = None
    opening = True

    def closed(edge: bool) -> pa.RecordBatch:
        ids = pa.concat_arrays(held)
        n = len(ids)
        columns = [ids, pa.repeat(first[2], n), pa.repeat(pa.scalar(first[0], pa.int64()), n), pa.repeat(pa.scalar(first[1], pa.int64()), n), pa.repeat(pa.scalar(n, pa.int64()), n), pa.repeat(edge, n)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _ROW)], schema=_ROW)

    for batch in batches:
        if not batch.num_rows:
            continue
        norm, ids = batch.column("norm"), batch.column("doc_id")
        ranks, digests = batch.column("rank"), batch.column("text_sha256")
        new = np.ones(batch.num_rows, bool)
        new[1:] = pc.invert(pc.equal(norm.slice(1), norm.slice(0, len(norm) - 1))).to_numpy(zero_copy_only=False)
        new[0] = last is None or last != norm[0].as_py()
        last = norm[-1].as_py()
        starts = np.flatnonzero(new)
        if first is not None:
            held.append(ids.slice(0, starts[0] if len(starts) else len(ids)))
            if len(starts):
                yield closed(opening)
                opening = False
        if len(starts):
            if len(starts) > 1:
                sizes = np.diff(starts)
                run = np.repeat(starts[:-1], sizes)
                at, span = pa.array(run), slice(starts[0], starts[-1])
                n = span.stop - span.start
                edge = np.zeros(n, bool)
                if opening:
                    edge[: sizes[0]] = True
                    opening = False
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(span.start, n), digests.slice(span.start, n), ids.take(at), ranks.take(at), pa.array(np.repeat(sizes, sizes)), pa.array(edge)], schema=_ROW
                )
            k = int(starts[-1])
            first, held = (ids[k].as_py(), ranks[k].as_py(), digests[k].as_py()), [ids.slice(k)]
    if first is not None:
        yield closed(True)


def _normalised(text_col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"{SPACE}+", "")


def _rank(rank: str | None) -> Column:
    return F.coalesce(F.expr(rank or "0L").cast("long"), F.lit(1 - 2**63))


def groups_of_equals(docs: DataFrame, rank: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose texts are equal once ASCII white space is deleted.

    Sampled splitters range-partition the rows by the head of the normalised text, its digest and the
    id, so a group of any size is spread over as many partitions as it needs, and splitters stay
    short however long the texts are. Spark's external sort places equals side by side; neighbours
    are compared in full. Runs that touch a partition's edge are added up across partitions: at most
    two for each partition, so what is broadcast is bounded by the number of partitions.

    Of a group the row with the greatest ``rank`` (SQL, a long; none: all alike), then the smallest
    id, stays. Returns ``doc_id, keep_id, group_size, kept, text_sha256``.

    Defined cases: a null text is empty; empty texts form one group; a null rank is the smallest, a
    null id comes first among equals; rows that repeat an id count each for the group's size and share
    the id's verdict; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        _rank(rank).alias("rank"),
        _normalised(text_col).alias("norm"),
    ).withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
    key = [F.substring("norm", 1, PREFIX), F.col("text_sha256")]
    ordered = rows.repartitionByRange(*key, F.col("doc_id")).sortWithinPartitions(*key, F.col("norm"), F.desc("rank"), F.col("doc_id"))
    runs = land(ordered.mapInArrow(_runs, "doc_id long, text_sha256 string, first_id long, first_rank long, rows_here long, edge boolean"), "runs")
    ends = (
        runs.where("edge")
        .groupBy("text_sha256", "first_id", "first_rank", "rows_here")
        .agg((F.count("*") / F.col("rows_here")).cast("long").alias("runs"))
        .groupBy(F.col("text_sha256").alias("digest"))
        .agg(F.min(F.struct((-F.col("first_rank")).alias("r"), F.col("first_id").alias("id"))).alias("best"), F.sum(F.col("rows_here") * F.col("runs")).alias("rows_all"))
    )
    joined = runs.join(F.broadcast(ends), F.col("edge") & (F.col("text_sha256") == F.col("digest")), "left")
    keep = F.when(F.col("rows_all").isNotNull(), F.col("best.id")).otherwise(F.col("first_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("rows_all", "rows_here").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, rank: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of :func:`groups_of_equals`, with all its columns.

    Defined cases: as there; rows are told by id and text, so of rows that repeat an id each text keeps
    one; rows alike in both leave one, of the greatest rank; null ids are ids like others; any further
    columns are kept.
    """
    verdicts = groups_of_equals(docs, rank, id_col, text_col).select("doc_id", F.col("text_sha256").alias("digest"), "kept")
    return keep_rows(docs, verdicts, id_col, F.sha2(_normalised(text_col).cast("binary"), 256), _rank(rank))


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return groups_of_equals(docs, rank="length(coalesce(text, ''))")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
k AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
