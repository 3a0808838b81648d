"""Approximate nearest neighbours by cross-polytope hashing: multiprobe tables collect candidates for exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import land, salted_left_join
from .vectors import matrix, usable

TABLES = 8
#: Rows that a bucket has on average: the number of buckets follows the number of rows.
ROWS_PER_BUCKET = 256
#: Rows, and queries, of a bucket that meet in one call. A bucket with more is dealt over as many calls as it takes.
ROWS_AT_ONCE, QUERIES_AT_ONCE = 4096, 4096
#: Queries of the sample on which the number of probes is fitted, and the recall that it must show there.
FIT_QUERIES, FIT_RECALL = 128, 0.95
#: Probes of a table for one query at most; where they would not reach the recall, buckets are made larger.
MOST_PROBES = 1024
#: Rows hashed or probed at once, so that memory does not follow a batch's size.
SLICE = 1024
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, whose length is a power of two."""
    rows, size = x.shape
    half = 1
    while half < size:
        pairs = x.reshape(rows, size // (2 * half), 2, half)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(rows, size)
        half *= 2
    return x / np.sqrt(size)


@dataclass(frozen=True)
class Polytopes:
    """The hash functions: ``tables`` tables, each of one cross-polytope or several whose axes are put together into a code."""

    length: int
    #: Axes of each polytope of a table; a polytope of p axes tells 2 p directions apart.
    axes: tuple[int, ...]
    tables: int = TABLES

    @property
    def buckets(self) -> int:
        return int(np.prod([2 * p for p in self.axes]))

    @property
    def size(self) -> int:
        return turned_size(self.length)

    def turned(self, x: np.ndarray, table: int, k: int) -> np.ndarray:
        """Rows turned by the pseudo-rotation of polytope ``k``: three rounds of random signs and Hadamard transforms; then both directions of each axis."""
        y = np.zeros((len(x), self.size))
        y[:, : x.shape[1]] = x
        signs = np.random.default_rng((SEED, table, k)).choice((-1.0, 1.0), (3, self.size))
        for s in signs:
            y = hadamard(y * s)
        y = y[:, : self.axes[k]]
        return np.concatenate((y, -y), axis=1)

    def codes(self, x: np.ndarray, table: int) -> np.ndarray:
        """The bucket of each row: the nearest signed axis of each polytope."""
        code = np.zeros(len(x), np.int64)
        for k, p in enumerate(self.axes):
            code = code * (2 * p) + self.turned(x, table, k).argmax(axis=1)
        return code

    def probes(self, x: np.ndarray, table: int, count: int) -> np.ndarray:
        """The ``count`` best buckets of each row, best first: by the squares of what their axes fall short of the nearest ones."""
        count, codes, costs = min(count, self.buckets), np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for k, p in enumerate(self.axes):
            near = self.turned(x, table, k)
            short = (near.max(axis=1, keepdims=True) - near) ** 2
            axes = np.argsort(short, axis=1, kind="stable")[:, :count]
            short = np.take_along_axis(short, axes, 1)
            costs = (costs[:, :, None] + short[:, None, :]).reshape(len(x), -1)
            codes = (codes[:, :, None] * (2 * p) + axes[:, None, :]).reshape(len(x), -1)
            best = np.argsort(costs, axis=1, kind="stable")[:, :count]
            costs, codes = np.take_along_axis(costs, best, 1), np.take_along_axis(codes, best, 1)
        return codes


def turned_size(length: int) -> int:
    """The power of two that holds a vector and its further component."""
    return 1 << length.bit_length()


def axes_for(buckets: float, length: int) -> tuple[int, ...]:
    """Axes of the polytopes that make about as many buckets, at least two."""
    axes = []
    while not axes or buckets >= 2:
        axes.append(min(turned_size(length), 1 << max(0, int(np.log2(max(buckets, 2) / 2)))))
        buckets /= 2 * axes[-1]
    return tuple(axes)


def raised(x: np.ndarray, greatest: float) -> np.ndarray:
    """Rows with a further component that gives all of them the norm ``greatest``: a larger inner product is then a smaller angle."""
    rest = np.maximum(greatest**2 - (x * x).sum(axis=1), 0)
    return np.concatenate((x, np.sqrt(rest)[:, None]), axis=1)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, one by one, added in one order wherever the pair turns up."""
    return (queries * rows).sum(axis=1)


def nearest(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query, positions and exact scores of its ``k`` nearest of ``x``: falling score, then id, then row.

    ``own`` are the queries' rows, which do not count. A matrix product finds those within rounding of the k-th.
    """
    rough = queries @ x.T
    rough[own[:, None] == rows[None, :]] = -np.inf
    slack = 1e-9 * np.linalg.norm(queries, axis=1) * np.linalg.norm(x, axis=1).max(initial=0)
    kth = np.partition(rough, max(0, len(x) - k), axis=1)[:, max(0, len(x) - k)] if len(x) else np.empty(len(queries))
    out = []
    for i, q in enumerate(queries):
        found = np.flatnonzero((rough[i] >= kth[i] - slack[i]) & (rough[i] > -np.inf))
        scores = products(q[None, :], x[found])
        order = np.lexsort((rows[found], ids[found], -scores))[:k]
        out.append((found[order], scores[order]))
    return out


def _unpacked(column: pa.ChunkedArray | pa.Array, length: int) -> np.ndarray:
    """Vectors from their bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, length)


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in x], pa.binary())


def _index(rows: DataFrame, hashes: Polytopes, greatest: float) -> DataFrame:
    """``key, row, vec_id, vector``: every row in a bucket of each table; the key counts the buckets of all tables through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                x = matrix(part.column(2), hashes.length)
                up, packed = raised(x, greatest), _packed(x)
                for t in range(hashes.tables):
                    yield pa.RecordBatch.from_arrays([pa.array(t * hashes.buckets + hashes.codes(up, t)), part.column(0), part.column(1), packed], ["key", "row", "vec_id", "vector"])

    return rows.select("row", "vec_id", "vector").mapInArrow(run, "key long, row long, vec_id long, vector binary")


def _probes(queries: DataFrame, hashes: Polytopes, count: int) -> DataFrame:
    """``key, row, query_id, vector``: the buckets that each query looks into."""
    step = max(1, 8 * SLICE // count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = matrix(part.column(2), hashes.length)
                packed = _packed(x)
                for t in range(hashes.tables):
                    keys = t * hashes.buckets + hashes.probes(x, t, count)
                    of = pa.array(np.repeat(np.arange(len(x)), keys.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), part.column(0).take(of), part.column(1).take(of), packed.take(of)], ["key", "row", "query_id", "vector"])

    return queries.select("row", "vec_id", "vector").mapInArrow(run, "key long, row long, query_id long, vector binary")


def _sample(rows: DataFrame, queries: DataFrame, length: int, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A bounded sample of the queries (:data:`FIT_QUERIES`, by hash), and the vectors of each one's true nearest, from all rows."""
    drawn = queries.orderBy(F.xxhash64("row"), "row").limit(FIT_QUERIES).select("row", "vector").collect()
    own, q = np.array([r["row"] for r in drawn], np.int64), np.array([r["vector"] for r in drawn], np.float64).reshape(-1, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what a task has found so far, k for each query at most, competes with each further batch
        best = [(np.empty(0, np.int64), np.empty((0, length)))] * len(q)
        for batch in batches:
            row, x = batch.column(0).to_numpy(), matrix(batch.column(1), length)
            for i, (found, _) in enumerate(nearest(q, own, row, row, x, k)):
                r, v = np.concatenate((best[i][0], row[found])), np.concatenate((best[i][1], x[found]))
                kept = np.argsort(-products(q[i][None, :], v), kind="stable")[:k]
                best[i] = (r[kept], v[kept])
        of = np.repeat(np.arange(len(q)), [len(r) for r, _ in best])
        v = np.concatenate([v for _, v in best]) if len(q) else np.empty((0, length))
        scores = products(q[of], v) if len(of) else np.empty(0)
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(scores, pa.float64()), _packed(v)], ["query", "score", "vector"])

    found = rows.select("row", "vector").mapInArrow(run, "query long, score double, vector binary")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    top = found.withColumn("place", place).where(F.col("place") <= k).select("query", "vector").collect()
    return q, [np.array([np.frombuffer(r["vector"]) for r in top if r["query"] == i]).reshape(-1, length) for i in range(len(q))]


def fitted(rows: DataFrame, queries: DataFrame, length: int, n: int, greatest: float, k: int) -> tuple[Polytopes, int]:
    """The hash functions for ``n`` rows, and the fewest probes of each table that find :data:`FIT_RECALL` of the sample's true nearest."""
    q, theirs = _sample(rows, queries, length, k)
    of = np.repeat(np.arange(len(q)), [len(v) for v in theirs])
    x = raised(np.concatenate([*theirs, np.empty((0, length))]), greatest)
    buckets = max(2.0, n / ROWS_PER_BUCKET)
    while True:
        hashes = Polytopes(length, axes_for(buckets, length))
        first = np.full(len(of), MOST_PROBES)
        for t in range(hashes.tables):
            at = hashes.codes(x, t)[:, None] == hashes.probes(q, t, MOST_PROBES)[of]
            first = np.minimum(first, np.where(at.any(axis=1), at.argmax(axis=1), MOST_PROBES))
        enough = int(np.sort(first)[int(np.ceil(FIT_RECALL * len(first))) - 1]) + 1 if len(first) else 1
        if enough <= MOST_PROBES:
            return hashes, enough
        buckets /= 4


def _met(index: DataFrame, probes: DataFrame, length: int, k: int) -> DataFrame:
    """``query, query_id, row, vec_id, score`` as lists: for each query and part of a bucket, the ``k`` nearest there.

    A bucket whose rows or queries are more than one call should hold is dealt into a grid of parts, every row
    meeting every query once; no bucket has a cap.
    """
    sizes = index.groupBy("key").agg(F.count("*").alias("rows")).join(probes.groupBy("key").agg(F.count("*").alias("queries")), "key")
    parts = sizes.select("key", F.ceil(F.col("rows") / ROWS_AT_ONCE).cast("int").alias("blocks"), F.ceil(F.col("queries") / QUERIES_AT_ONCE).cast("int").alias("portions"))
    grid = land(parts.where("blocks > 1 OR portions > 1"), "grid")

    def dealt(side: DataFrame, own: str, others: str) -> DataFrame:
        known = salted_left_join(side, grid, "key", ["row"]).withColumns({c: F.coalesce(F.col(c), F.lit(1)) for c in ("blocks", "portions")})
        copies = F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        return known.withColumn(own, F.pmod(F.xxhash64("row"), F.col(own)).cast("int")).withColumn(others, copies)

    def run(of_rows: pa.Table, of_queries: pa.Table) -> pa.Table:
        x, q = _unpacked(of_rows["vector"], length), _unpacked(of_queries["vector"], length)
        ids, rows, own = (c.to_numpy() for c in (of_rows["vec_id"], of_rows["row"], of_queries["row"]))
        best = []
        for at in range(0, len(q) if len(x) else 0, SLICE):
            best += nearest(q[at : at + SLICE], own[at : at + SLICE], ids, rows, x, k)
        found = np.concatenate([b[0] for b in best]) if best else np.empty(0, np.int64)
        ends = pa.array(np.cumsum([0] + [len(b[0]) for b in best]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in (rows[found], ids[found], np.concatenate([b[1] for b in best]) if best else np.empty(0))]
        named = [of_queries[c].combine_chunks() for c in ("row", "query_id")] if best else [pa.array([], pa.int64())] * 2
        return pa.Table.from_arrays([*named, *lists], ["query", "query_id", "row", "vec_id", "score"])

    keys = ["key", "blocks", "portions"]
    left, right = dealt(index, "blocks", "portions"), dealt(probes, "portions", "blocks")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query long, query_id long, row array<long>, vec_id array<long>, score array<double>")


def _merged(met: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: of all lists of a query the ``k`` nearest rows, each once.

    Lists come sorted by query, and only the best so far are held, so a query may have any number of lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, name, best = None, None, None

        def ended() -> pa.RecordBatch:
            score, ids, _ = best
            return pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.int64()), pa.array(np.arange(1, len(ids) + 1), pa.int32()), pa.array(ids), pa.array(score)], ["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            queries = batch.column(0).to_numpy()
            for part in np.split(np.arange(len(queries)), np.flatnonzero(np.diff(queries)) + 1):
                if not len(part):
                    continue
                own = batch.slice(part[0], len(part))
                if queries[part[0]] != query:
                    if query is not None:
                        yield ended()
                    query, name, best = queries[part[0]], own.column(1)[0].as_py(), (np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))
                row, ids, score = (np.concatenate((b, own.column(c).flatten().to_numpy())) for b, c in ((best[2], 2), (best[1], 3), (best[0], 4)))
                once = np.unique(row, return_index=True)[1]
                row, ids, score = row[once], ids[once], score[once]
                order = np.lexsort((row, ids, -score))[:k]
                best = (score[order], ids[order], row[order])
        if query is not None:
            yield ended()

    return met.repartition("query").sortWithinPartitions("query").mapInArrow(run, "query_id long, rank int, vec_id long, score double")


def search(table: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``queries`` holds for, the ``k`` rows found with the largest inner products.

    Every row is indexed in :data:`TABLES` tables. The number of probes is fitted on a sample of
    :data:`FIT_QUERIES` queries, whose nearest are searched among all rows. Candidates are scored in double precision
    on the vectors as they are.

    Defined cases: vectors that are null, zero or hold null or non-finite components, those of another length than
    most, and rows without an id take no part; a row is not its own candidate, but a repeated row is one; ties go to the
    smaller id; a query that finds fewer rows than ``k`` returns those; an empty table gives no rows; ``queries``
    is asked of the table, whose other columns are ignored.
    """
    asked = F.coalesce(queries.cast("boolean"), F.lit(False))
    usual, length = usable(table, vector_col, vec_id=F.col(f"`{id_col}`").cast("long"), asked=asked)
    some = usual.where(F.col("vec_id").isNotNull() & F.exists("vector", lambda v: v != 0))
    rows = land(some.withColumn("row", F.monotonically_increasing_id()), "vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v)
    n, greatest = rows.agg(F.count("*"), F.sqrt(F.max(square))).first()
    asking = rows.where("asked")
    if not n:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hashes, count = fitted(rows, asking, length, n, greatest, k)
    index = land(_index(rows, hashes, greatest), "index")
    return _merged(_met(index, land(_probes(asking, hashes, count), "probes"), length, k), k)


def op12_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
