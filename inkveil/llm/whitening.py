"""Embedding whitening: float32 eigenvectors of the distributed covariance, refined in higher precision."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import land
from .vectors import floored, listed, matrix, usable

#: Magnitude that scaled components must stay below, so that doubles hold them exactly.
LIMIT = 1 << 50
#: Bits of a limb and rows of a block: products of limbs, summed over a block, stay below 2**53 and are exact in doubles.
LIMB_BITS, BLOCK = 18, 1 << 14
#: Eigenvalues below this part of the trace are rounding; their components are left out.
SMALLEST = 1e-13
#: Refinement rounds at most; each squares the error, so four or five are usual.
ROUNDS = 30


def _partials(table: DataFrame, length: int, of_batch, accumulate) -> dict[int, int]:
    """Exact integer sums over all rows, by position: each task sends one row for each position, Spark adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = accumulate(of_batch(matrix(batch.column(0), length)))
                total = part if total is None else total + part
        if total is not None:
            values = pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), values], ["at", "value"])

    sums = table.select("vector").mapInArrow(run, "at int, value decimal(38,0)").groupBy("at").agg(F.sum("value").alias("value"))
    return {r["at"]: int(r["value"]) for r in sums.collect()}


def column_sums(x: np.ndarray) -> np.ndarray:
    """Row count and column sums of a matrix of longs, as Python integers that can't overflow."""
    high, low = x >> 31, x & ((1 << 31) - 1)
    return np.concatenate(([len(x)], high.sum(axis=0).astype(object) * (1 << 31) + low.sum(axis=0).astype(object))).astype(object)


def gram(d: np.ndarray) -> np.ndarray:
    """The upper triangle of ``d.T @ d`` for longs, exact, as Python integers: matrix products of limbs in doubles."""
    upper = np.triu_indices(d.shape[1])
    total = np.zeros(len(upper[0]), object)
    for at in range(0, len(d), BLOCK):
        rest, limbs = d[at : at + BLOCK], []
        while np.abs(rest).max(initial=0) >= 1 << (LIMB_BITS - 1):
            low = ((rest + (1 << (LIMB_BITS - 1))) & ((1 << LIMB_BITS) - 1)) - (1 << (LIMB_BITS - 1))
            limbs.append(low.astype(np.float64))
            rest = (rest - low) >> LIMB_BITS
        limbs.append(rest.astype(np.float64))
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total = total + (a.T @ b)[upper].astype(np.int64).astype(object) * (1 << (LIMB_BITS * (i + j)))
    return total


def _extended(value: int) -> np.longdouble:
    """An integer in extended precision, rounded once."""
    size = abs(value)
    shift = max(0, size.bit_length() - 64)
    return np.longdouble(np.uint64(size >> shift)) * np.longdouble(2) ** shift * (-1 if value < 0 else 1)


def _norm(a: np.ndarray) -> np.longdouble:
    return np.longdouble(np.linalg.norm(a.astype(np.float64), 2)) if a.size else np.longdouble(0)


def _clusters(values: np.ndarray, apart: np.longdouble) -> Iterable[np.ndarray]:
    """Positions of eigenvalues whose neighbours in order are ``apart`` or less, by two or more."""
    order = np.argsort(values)
    breaks = np.flatnonzero(np.diff(values[order]) > apart) + 1
    return [c for c in np.split(order, breaks) if len(c) > 1]


def refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix, from approximate ones ``x``, in the precision of ``a``.

    Each round (Ogita and Aishima) takes the defect of orthogonality R = I - X'X and S = X'AX, and corrects X by
    X E with E from S, R and the gaps of eigenvalues; that squares the error. Where a gap is too small against the
    present error, only orthogonality is corrected, and the cluster's own small problem, shifted by its mean so that
    its differences keep their digits, is solved and rotates its vectors; the next rounds refine them further.
    """
    eye, size = np.eye(len(a), dtype=a.dtype), _norm(a)
    done, before, were_close = np.finfo(a.dtype).eps * len(a), np.inf, None
    for _ in range(ROUNDS):
        r, s = eye - x.T @ x, x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        apart = 2 * (_norm(s - np.diag(values)) + size * _norm(r))
        gaps = values[None, :] - values[:, None]
        close = np.abs(gaps) <= apart
        e = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gaps))
        x = x + x @ e
        for c in _clusters(values, apart):
            own = x[:, c]
            small = own.T @ (a @ own - values[c].mean() * own)
            scale = np.abs(small).max()
            if scale > 0:
                x[:, c] = own @ np.linalg.eigh(((small + small.T) / (2 * scale)).astype(np.float64))[1].astype(a.dtype)
        change = np.abs(e).max()
        # rounding ends the gain once the same pairs are close and the correction has stopped falling
        if change <= done or change >= before / 2 and np.array_equal(close, were_close):
            break
        before, were_close = change, close
    for _ in range(2):
        x = x @ (1.5 * eye - 0.5 * (x.T @ x))
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of a symmetric matrix in extended precision, refined from float32 ones."""
    scale = np.abs(a).max(initial=0)
    if scale == 0:
        return np.zeros(len(a), a.dtype), np.eye(len(a), dtype=a.dtype)
    values, x = refined(a / scale, np.linalg.eigh((a / scale).astype(np.float32))[1].astype(a.dtype))
    return values * scale, x


@dataclass(frozen=True)
class Whitening:
    """What is learned from the fit list: exact sums, and the leading components."""

    n: int
    #: Each dimension's sum is ``n * centre + rest`` with 0 <= rest < n.
    centre: list[int]
    rest: list[int]
    #: Unit eigenvectors as columns, their eigenvalues, and these over the trace.
    basis: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def fit(table: DataFrame, length: int, components: int, scale: float, shift: int) -> Whitening | None:
    """Learn from all rows of ``table`` (``vector``), whose entries c become floor(scale * c) + shift; None without rows.

    The covariance is exact: entries are centred by their mean's whole part before multiplying, sums are integers,
    and the fraction left over is taken out of them by integer arithmetic.
    """
    ints = lambda c: floored(c, scale, LIMIT) + shift
    sums = _partials(table, length, ints, column_sums)
    if not sums or not length:
        return None
    n = sums[0]
    centre, rest = zip(*(divmod(sums[k + 1], n) for k in range(length)))
    whole = np.array(centre, np.int64)
    products = _partials(table, length, lambda c: ints(c) - whole, gram)
    v = np.zeros((length, length), np.longdouble)
    for at, (i, j) in enumerate(zip(*np.triu_indices(length))):
        # the covariance is (n * products - rest rest') / n**2; its first 80 bits below one are kept
        v[i, j] = v[j, i] = _extended(((n * products[at] - rest[i] * rest[j]) << 80) // (n * n)) / np.longdouble(2) ** 80
    values, basis = eigen(v)
    trace = np.diag(v).sum()
    kept = min(components, int((values > SMALLEST * trace).sum()))
    basis, values = basis[:, :kept], values[:kept]
    basis = basis * np.sign(np.take_along_axis(basis, np.abs(basis).argmax(axis=0)[None, :], 0)) if kept else basis
    return Whitening(n, list(centre), list(rest), basis.astype(np.float64), values.astype(np.float64), (values / trace).astype(np.float64) if kept else np.empty(0))


def project(table: DataFrame, length: int, model: Whitening, scale: float, shift: int) -> DataFrame:
    """``vec_id, deviation, whitened`` of each row: the exact squared distance from the mean, times n squared, and its whitened components."""
    centre, rest = np.array(model.centre, np.int64), np.array(model.rest, np.int64)
    onto, n = model.basis / np.sqrt(model.values), model.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = floored(matrix(batch.column(1), length), scale, LIMIT) + shift - centre
            if d.size and length * (n * (np.abs(d).max() + 1.0)) ** 2 >= 2.0**63:
                deviation = [sum((n * int(v) - r) ** 2 for v, r in zip(row, model.rest)) for row in d]
            else:
                deviation = ((n * d - rest) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), listed((d - rest / n) @ onto)], ["vec_id", "deviation", "whitened"])

    return table.select("vec_id", "vector").mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def identity_error(projected: DataFrame, kept: int) -> float:
    """The largest absolute entry of the covariance of ``whitened`` minus the identity; each component is centred before multiplying."""
    at = lambda k: F.col("whitened")[k]
    means = projected.agg(*(F.avg(at(k)) for k in range(kept))).first()
    entry = lambda i, j: F.abs(F.avg((at(i) - means[i]) * (at(j) - means[j])) - float(i == j))
    return max(projected.agg(*(entry(i, j) for i in range(kept) for j in range(i, kept))).first())


def whiten(table: DataFrame, components: int = 8, scale: float = 1024, shift: int = 100000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    All vectors that take part are the fit list. Entries become integers first. Sums and the covariance are exact and
    made by Spark, tasks send a row for each entry; the driver holds one matrix of the vectors' length. Its float32
    eigenvectors are refined in extended precision, then every row is projected.

    Defined cases: vectors that are null or hold null or non-finite entries, and those of another length than most,
    take no part; a null id is returned as null; repeated rows count, and come back, each for itself; components
    without variance are left out, so that equal vectors, a single vector or an empty table give no rows; entries of
    2**50 or more after scaling, and deviations beyond a long, are errors; other columns are ignored.
    """
    rows, length = usable(table, vector_col, vec_id=F.col(f"`{id_col}`").cast("long"))
    columns = lambda d: d.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
    model = fit(rows, length, components, scale, shift)
    if model is None or not len(model.values):
        return columns(table.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"))
    projected = land(project(rows, length, model, scale, shift), "whitened")
    error = identity_error(projected, len(model.values))
    parts = F.array(*(F.struct(F.lit(k + 1).alias("component"), F.col("whitened")[k].alias("whitened"), F.lit(float(e)).alias("explained")) for k, e in enumerate(model.explained)))
    long = projected.select("vec_id", "deviation", F.explode(parts).alias("p")).select("vec_id", "deviation", "p.*")
    return columns(long.withColumns({"n": F.lit(model.n).cast("long"), "identity_error": F.lit(error)}))


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
