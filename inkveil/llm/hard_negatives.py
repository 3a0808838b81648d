"""Hard-negative mining by a cover tree over norm-augmented candidates.

A further component gives all candidates one norm, so that they lie on a sphere and a node's covering radius is an
angle; the inner products of an anchor with all that a node covers then lie between two cosines. The tree has two
parts. Its upper levels stand on centres from a bounded sample, and every row belongs to one of their cells. A cell's
rows are dealt into blocks of bounded size, and each block has lower levels of its own. Radii are measured over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import land
from .vectors import floored, listed, matrix, usable

#: Rows of a cell on average, cells at most, and rows of the sample that their centres come from.
ROWS_PER_CELL, MOST_CELLS, SAMPLE = 1024, 2048, 8192
#: Rows of a block on average, where a cell has more; rows of a leaf in a block on average.
BLOCK, LEAF = 2048, 64
#: Anchors that meet a block in one call, and cells that an anchor visits before all others, for a first threshold.
PORTION, FIRST = 1024, 3


@dataclass(frozen=True)
class CoverTree:
    """Centres by levels, each level holding those before it; all centres are on the last level and are the leaves."""

    centres: np.ndarray
    #: Of each level: how many of the centres it has, and for each of these its parent's position on the level before.
    levels: list[tuple[int, np.ndarray]]
    #: The norm of all that the tree covers.
    norm: float

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        return (x @ self.centres.T).argmax(axis=1)

    def paths(self) -> np.ndarray:
        """For each leaf, the position of its ancestor on each level, the leaf itself last."""
        at = [np.arange(len(self.centres))]
        for _, parents in reversed(self.levels[1:]):
            at.append(parents[at[-1]])
        return np.array(at[::-1]).T

    def distances(self, x: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """The angle between each row and its ancestor on each level."""
        return np.stack([self.angles((x * self.centres[at]).sum(axis=1), self.norm) for at in self.paths()[leaves].T], axis=1)

    def angles(self, products: np.ndarray, norm: float | np.ndarray) -> np.ndarray:
        size = np.broadcast_to(np.asarray(norm * self.norm, float), products.shape)
        return np.arccos(np.clip(np.divide(products, size, out=np.ones_like(products), where=size > 0), -1, 1))

    def bounds(self, q: np.ndarray, radii: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Upper and lower bounds of the inner products of each of ``q`` with what each leaf covers, and the products with the leaves' centres.

        Level by level: a node's bounds hold for its children, which narrow them. A slack covers rounding.
        """
        norms = np.linalg.norm(q, axis=1)[:, None]
        products = q @ self.centres.T
        angles, size, slack = self.angles(products, norms), norms * self.norm, 1e-7 * (1 + norms * self.norm)
        high, low = np.full((len(q), 1), np.inf), np.full((len(q), 1), -np.inf)
        for (count, parents), radius in zip(self.levels, radii):
            angle = angles[:, :count]
            high = np.minimum(high[:, parents], size * np.cos(np.maximum(angle - radius, 0)) + slack)
            low = np.maximum(low[:, parents], size * np.cos(np.minimum(angle + radius, np.pi)) - slack)
        return high, low, products


def grown(x: np.ndarray, most: int, norm: float) -> CoverTree:
    """A cover tree on at most ``most`` of the rows of ``x``, all of the given norm.

    The next centre is always the row farthest from those before it. Its distance then is the radius at which it must
    enter: level l has the centres that are more than pi / 2**l from those before them, so a level's centres are that
    far apart and cover all rows within it. A centre's parent is the nearest one of the level before.
    """
    chosen, entered = [0], [np.pi]
    nearest = x @ x[0]
    while len(chosen) < min(most, len(x)):
        at = int(nearest.argmin())
        angle = float(np.arccos(np.clip(nearest[at] / norm**2, -1, 1))) if norm else 0.0
        if at in chosen or angle < 1e-6:
            break
        chosen.append(at)
        entered.append(min(angle, entered[-1]))
        nearest = np.maximum(nearest, x @ x[at])
    centres, entered = x[chosen], np.array(entered)
    levels, count = [(1, np.zeros(1, np.int64))], 1
    while count < len(centres):
        reach = np.pi / 2 ** len(levels)
        wider = max(count, int((entered > reach).sum()))
        if wider > count:
            parents = np.concatenate((np.arange(count), (centres[count:wider] @ centres[:count].T).argmax(axis=1)))
            levels.append((wider, parents))
            count = wider
        else:
            levels.append((count, np.arange(count)))
    return CoverTree(centres, levels, norm)


def covering(tree: CoverTree, distances: np.ndarray, leaves: np.ndarray) -> list[np.ndarray]:
    """The covering radius of each node of each level; ``distances`` are those of rows, or the greatest of each leaf's."""
    radii = []
    for level, at in enumerate(tree.paths()[leaves].T):
        radius = np.zeros(tree.levels[level][0])
        np.maximum.at(radius, at, distances[:, level])
        radii.append(radius)
    return radii


def raised(x: np.ndarray, square: float) -> np.ndarray:
    """Rows with a further component that makes their squared norm ``square``."""
    return np.concatenate((x, np.sqrt(np.maximum(square - (x * x).sum(axis=1), 0))[:, None]), axis=1)


def _flat(q: np.ndarray) -> np.ndarray:
    """Anchors with a further component of zero, so that their products with raised rows are those with the rows."""
    return np.concatenate((q, np.zeros((len(q), 1))), axis=1)


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in x.astype(np.int32)], pa.binary())


def _unpacked(column: pa.ChunkedArray | pa.Array, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, length).astype(np.float64)


def _integers(rows: DataFrame, length: int, scale: float) -> DataFrame:
    """``row, vec_id, label, asked, square, vector``: vectors of whole numbers, as bytes, and their squared norms."""
    limit = int(2.0**26 / np.sqrt(max(1, length)))  # sums of products stay below 2**52, exact in doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = floored(matrix(batch.column(4), length), scale, limit)
            columns = [batch.column(c) for c in range(4)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array((x * x).sum(axis=1), pa.int64()), _packed(x)], ["row", "vec_id", "label", "asked", "square", "vector"])

    return rows.select("row", "vec_id", "label", "asked", "vector").mapInArrow(run, "row long, vec_id long, label long, asked boolean, square long, vector binary")


def _placed(rows: DataFrame, tree: CoverTree, length: int, square: int) -> DataFrame:
    """Adds ``cell`` and ``angles``, to the cell's ancestors on each level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = raised(_unpacked(batch.column(3), length), square)
            cells = tree.nearest(x) if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(cells, pa.int32()), listed(tree.distances(x, cells))], ["row", "vec_id", "label", "vector", "cell", "angles"])

    return rows.select("row", "vec_id", "label", "vector").mapInArrow(run, "row long, vec_id long, label long, vector binary, cell int, angles array<double>")


def _blocks(placed: DataFrame, sizes: DataFrame, length: int, square: int) -> DataFrame:
    """A row for each block of a cell: its rows in the order of the leaves of its own tree, and that tree."""

    def run(table: pa.Table) -> pa.Table:
        x = _unpacked(table["vector"], length)
        up, norm = raised(x, square), float(np.sqrt(square))
        tree = grown(up, max(1, len(x) // LEAF), norm)
        leaves = tree.nearest(up)
        radii = covering(tree, tree.distances(up, leaves), leaves)
        order = np.argsort(leaves, kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(leaves, minlength=len(tree.centres)))))
        parts = {
            "cell": table["cell"][0].as_py(), "block": table["block"][0].as_py(), "vectors": x[order].astype(np.int32).tobytes(), "centres": tree.centres.tobytes(),
            "rows": table["row"].to_numpy()[order], "ids": table["vec_id"].to_numpy()[order], "labels": table["label"].to_numpy()[order], "ends": ends,
            "counts": [c for c, _ in tree.levels], "parents": np.concatenate([p for _, p in tree.levels]), "radii": np.concatenate(radii),
        }
        return pa.Table.from_pylist([parts], schema=_BLOCK)

    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    named = ", ".join(f"{f.name} {_SQL[f.type]}" for f in _BLOCK)
    return dealt.select("cell", "block", "row", "vec_id", "label", "vector").groupBy("cell", "block").applyInArrow(run, named)


_LONGS = pa.list_(pa.int64())
_BLOCK = pa.schema([
    ("cell", pa.int32()), ("block", pa.int32()), ("vectors", pa.binary()), ("centres", pa.binary()), ("rows", _LONGS), ("ids", _LONGS),
    ("labels", _LONGS), ("ends", _LONGS), ("counts", _LONGS), ("parents", _LONGS), ("radii", pa.list_(pa.float64())),
])
_SQL = {pa.int32(): "int", pa.binary(): "binary", _LONGS: "array<long>", pa.list_(pa.float64()): "array<double>"}


@dataclass(frozen=True)
class Block:
    """A block's rows, by leaves, with its tree."""

    x: np.ndarray
    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    ends: np.ndarray
    tree: CoverTree
    radii: list[np.ndarray]

    @staticmethod
    def read(row: dict, length: int, square: int) -> Block:
        of = lambda name: np.array(row[name], np.int64)
        centres = np.frombuffer(row["centres"], np.float64).reshape(-1, length + 1)
        cuts = np.cumsum(of("counts"))[:-1]
        tree = CoverTree(centres, list(zip(row["counts"], np.split(of("parents"), cuts))), float(np.sqrt(square)))
        x = np.frombuffer(row["vectors"], np.int32).reshape(-1, length).astype(np.float64)
        return Block(x, of("rows"), of("ids"), of("labels"), of("ends"), tree, np.split(np.array(row["radii"]), cuts))

    def best(self, q: np.ndarray, of: np.ndarray, own: np.ndarray, label: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (-1: none) and scores of each window's ``k`` best rows: falling score, then id, then row.

        A window is an anchor ``q[of]`` with its row, its label, whether rows must share that, and its bounds. Each window
        goes through the leaves best first, by the upper bound that its high end cuts off, and stops where no leaf left
        can reach its k-th best; leaves whose bounds lie outside the window are not opened. Windows that open the same
        leaf in a round are verified by one matrix product of whole numbers.
        """
        upper, lower, _ = (b[of] for b in self.tree.bounds(_flat(q), self.radii))
        reach = np.minimum(upper, high[:, None])
        reach[(upper < low[:, None]) | (lower > high[:, None])] = -np.inf
        order = np.argsort(-reach, axis=1, kind="stable")
        score, at = np.full((len(of), k), -np.inf), np.full((len(of), k), -1)
        left = np.arange(len(of))
        for turn in range(order.shape[1]):
            leaf = order[left, turn]
            going = reach[left, leaf] >= np.maximum(score[left, -1], low[left])
            left, leaf = left[going], leaf[going]
            if not len(left):
                break
            for one in np.unique(leaf):
                some, part = left[leaf == one], slice(self.ends[one], self.ends[one + 1])
                s = q[of[some]] @ self.x[part].T
                fits = (s >= np.maximum(score[some, -1], low[some])[:, None]) & (s <= high[some][:, None]) & (self.rows[part] != own[some][:, None])
                fits &= (self.labels[part] == label[some][:, None]) == same
                hit = np.flatnonzero(fits.any(axis=1))
                if len(hit):
                    new = np.broadcast_to(np.arange(part.start, part.stop), fits.shape)[hit]
                    all_at = np.concatenate((at[some[hit]], np.where(fits[hit], new, -1)), axis=1)
                    all_score = np.concatenate((score[some[hit]], np.where(fits[hit], s[hit], -np.inf)), axis=1)
                    first = np.lexsort((self.rows[all_at], self.ids[all_at], -all_score), axis=1)[:, :k]
                    at[some[hit]], score[some[hit]] = np.take_along_axis(all_at, first, 1), np.take_along_axis(all_score, first, 1)
        return at, score


def _visits(anchors: DataFrame, tree: CoverTree, radii: list[np.ndarray], length: int, most: int | None = None) -> DataFrame:
    """``cell, anchor, label, vector, windows``: the cells that can hold rows within an anchor's ``windows`` (``key, low, high``).

    ``most``: of these only so many, whose centres come nearest to the windows' high ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                upper, lower, products = tree.bounds(_flat(_unpacked(part.column(2), length)), radii)
                picked = []
                for i, windows in enumerate(part.column(3).to_pylist()):
                    low, high = (np.array([w[c] for w in windows], float)[:, None] for c in ("low", "high"))
                    cells = np.flatnonzero(((upper[i] >= low) & (lower[i] <= high)).any(axis=0))
                    far = np.abs(np.minimum(high.max(), upper[i].max()) - products[i][cells])
                    picked.append(cells[np.argsort(far, kind="stable")[:most]])
                of = pa.array(np.repeat(np.arange(part.num_rows), [len(p) for p in picked]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(picked), pa.int32()), *(part.column(c).take(of) for c in range(4))], ["cell", "anchor", "label", "vector", "windows"])

    return anchors.select("anchor", "label", "vector", "windows").mapInArrow(run, f"cell int, anchor long, label long, vector binary, windows {_WINDOWS}")


_WINDOWS = "array<struct<key:long,low:double,high:double>>"


def _searched(visits: DataFrame, blocks: DataFrame, sizes: DataFrame, length: int, square: int, same: bool, k: int) -> DataFrame:
    """``anchor, key, row, vec_id, score``: the ``k`` best of each block for each window that visits it.

    Visits of a cell go to all its blocks; those of one block are dealt into portions, each with a copy of the block.
    """

    def run(of_block: pa.Table, of_visits: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        if of_block.num_rows and of_visits.num_rows:
            block = Block.read(of_block.to_pylist()[0], length, square)
            q, anchor = _unpacked(of_visits["vector"], length), of_visits["anchor"].to_numpy()
            windows = of_visits["windows"].combine_chunks()
            each = windows.flatten()
            of = np.repeat(np.arange(len(q)), np.diff(windows.offsets.to_numpy()))
            of_window = lambda c: each.field(c).to_numpy()
            at, score = block.best(q, of, anchor[of], of_visits["label"].to_numpy()[of], same, of_window("low"), of_window("high"), k)
            window, place = np.nonzero(at >= 0)
            found = at[window, place]
            out = [anchor[of[window]], of_window("key")[window], block.rows[found], block.ids[found], score[window, place].astype(np.int64)]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in out], ["anchor", "key", "row", "vec_id", "score"])

    asked = visits.groupBy("cell").agg(F.ceil(F.count("*") / PORTION).cast("int").alias("portions"))
    cells = land(asked.join(F.broadcast(sizes), "cell"), "cells")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = blocks.join(F.broadcast(cells.select("cell", F.col("portions").alias("copies"))), "cell").withColumn("portion", each("copies")).drop("copies")
    portion = F.pmod(F.xxhash64("anchor"), F.col("portions")).cast("int")
    right = visits.join(F.broadcast(cells), "cell").withColumn("portion", portion).withColumn("block", each("blocks")).drop("portions", "blocks")
    keys = ["cell", "block", "portion"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "anchor long, key long, row long, vec_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "key").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Index:
    """All candidates, by cells and blocks, and the upper levels of the tree."""

    blocks: DataFrame
    #: ``cell, blocks``, a row for each cell: :data:`MOST_CELLS` at most.
    sizes: DataFrame
    tree: CoverTree
    radii: list[np.ndarray]
    length: int
    square: int

    def best(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """``anchor, key, row, vec_id, score, rank``: the ``k`` best rows in each window of ``anchors`` (``anchor, label, vector, windows``).

        Best first: an anchor visits the most promising cells, then all others that its thresholds leave.
        """
        visits = lambda a, most: _visits(a, self.tree, self.radii, self.length, most)
        search = lambda v: _searched(v, self.blocks, self.sizes, self.length, self.square, same, k)
        first = land(visits(anchors, FIRST), "first")
        early = land(_top(search(first), k), "early")
        reached = early.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("key", "score"))).alias("reached"))
        risen = F.transform("windows", lambda w: F.struct(w.key.alias("key"), F.greatest(w.low, F.try_element_at("reached", w.key).cast("double")).alias("low"), w.high.alias("high")))
        rest = visits(anchors.join(reached, "anchor", "left").withColumn("windows", risen), None)
        rest = land(rest.join(first.select("anchor", "cell"), ["anchor", "cell"], "left_anti"), "rest")
        return _top(early.drop("rank").unionByName(search(rest)), k)


def index(rows: DataFrame, length: int) -> Index:
    """Index every row of ``rows`` (``row, vec_id, label, square, vector``); the centres come from a sample of :data:`SAMPLE` rows, by hash."""
    n, square = rows.agg(F.count("*"), F.max("square")).first()
    drawn = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("vector").toArrow()
    tree = grown(raised(_unpacked(drawn["vector"], length), square), min(MOST_CELLS, max(1, n // ROWS_PER_CELL)), float(np.sqrt(square)))
    placed = land(_placed(rows, tree, length, square), "placed")
    greatest = [F.max(F.col("angles")[level]).alias(f"angle{level}") for level in range(len(tree.levels))]
    cells = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), *greatest).collect()
    distances = np.array([r[2:] for r in cells], float).reshape(len(cells), len(tree.levels))
    radii = covering(tree, distances, np.array([r["cell"] for r in cells], np.int64))
    sizes = rows.sparkSession.createDataFrame([(r["cell"], r["blocks"]) for r in cells], "cell int, blocks int")
    return Index(land(_blocks(placed, sizes, length, square), "blocks"), sizes, tree, radii, length, square)


def mine(
    table: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: hard negatives for each anchor and positive.

    Vectors are made whole numbers, floor(scale * x); a score is their inner product, higher first, ties to the smaller id. An
    anchor's positives are its first rows of the same label; a positive's negatives the first rows of another label
    whose scores are ``low`` to ``high`` percent of the positive's. The search is exact.

    Defined cases: rows with a null label or id, and vectors that are null, hold null or non-finite components or are of another
    length than most, take no part; a row is not its own positive, but a repeated row is one; of equal ids the rows
    count each; a positive of negative score has an empty window; anchors without positives, positives without
    negatives and an empty table give no rows; components whose sums of products could pass 2**52 are an error;
    ``anchors`` and ``label`` are asked of the table, whose other columns are ignored.
    """
    asked = F.coalesce(anchors.cast("boolean"), F.lit(False))
    usual, length = usable(table, vector_col, vec_id=F.col(f"`{id_col}`").cast("long"), label=label.cast("long"), asked=asked)
    some = usual.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()).withColumn("row", F.monotonically_increasing_id())
    rows = land(_integers(land(some, "vectors"), length, scale), "integers")
    if rows.isEmpty():
        return table.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    of = index(rows, length)
    asking = rows.where("asked").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "vector")
    anywhere = F.array(F.struct(F.lit(0).cast("long").alias("key"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")))
    near = land(of.best(asking.withColumn("windows", anywhere), True, positives).select("anchor", "row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # low * p <= 100 * s <= high * p, in whole numbers; both ends are exact as doubles
    ends = near.withColumn("low", F.expr(f"-floor(-{low} * positive_score / 100D)").cast("double")).withColumn("high", F.expr(f"floor({high} * positive_score / 100D)").cast("double"))
    window = F.struct(F.col("row").alias("key"), "low", "high")
    windows = ends.where("low <= high").groupBy("anchor").agg(F.collect_list(window).alias("windows"))
    found = of.best(asking.join(windows, "anchor"), False, negatives).select("anchor", F.col("key").alias("row"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.join(near, ["anchor", "row"]).join(asking.select("anchor", "anchor_id"), "anchor")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, label)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS u
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.u, b.u) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0
),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, p.other AS positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, p.other ORDER BY n.score DESC, n.other) AS INTEGER) AS rank,
  n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n USING (anchor_id)
WHERE NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY anchor_id, p.other ORDER BY n.score DESC, n.other) <= 3
"""
