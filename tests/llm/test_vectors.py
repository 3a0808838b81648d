"""Hard negatives, neighbours and whitening against brute force, with the rows that take no part."""

import os

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from inkveil.llm import hard_negatives, neighbours, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, row string, vector string, cell int, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", None, 3, "y") for r in rows], SCHEMA)


def odd_rows(length):
    """Rows that take no part."""
    nan, inf = float("nan"), float("inf")
    return [(1001, None, 1), (1050, [nan] * length, 1), (1003, [inf] + [1.0] * (length - 1), 2), (1100, [None] + [1.0] * (length - 1), 1), (1004, [1.0], 1), (1005, [], 1)]


def cluster(rng, n, length):
    """Vectors of all norms, a third of them around one, some repeated."""
    x = rng.normal(size=(n, length)) * rng.uniform(0.2, 1, (n, 1))
    x[: n // 3] = x[0] + 0.05 * rng.normal(size=(n // 3, length))
    x[5:12] = x[4]
    return x.astype(np.float32)


def brute_negatives(ids, x, labels, positives=5, negatives=3):
    u, out = np.floor(256 * x.astype(np.float64)).astype(np.int64), []
    for a in np.flatnonzero(ids % 50 == 0):
        s = u @ u[a]
        order = [i for i in np.lexsort((ids, -s)) if i != a]
        for p in [i for i in order if labels[i] == labels[a]][:positives]:
            fit = [i for i in order if labels[i] != labels[a] and 50 * s[p] <= 100 * s[i] <= 95 * s[p]]
            out += [(ids[a], ids[p], r + 1, ids[i], s[p], s[i]) for r, i in enumerate(fit[:negatives])]
    return sorted(tuple(map(int, r)) for r in out)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, small):
    if small:  # many cells, blocks, leaves and portions
        for name, value in (("ROWS_PER_CELL", 60), ("BLOCK", 25), ("LEAF", 4), ("PORTION", 5), ("FIRST", 1)):
            monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(3)
    x, ids = cluster(rng, 400, 12), np.arange(400)
    labels = rng.integers(0, 3, 400)
    rows = [(int(i), v.tolist(), int(c)) for i, v, c in zip(ids, x, labels)]
    more = [(1200, x[0].tolist(), None), (None, x[0].tolist(), 1), *odd_rows(12)]
    got = hard_negatives.mine(frame(spark, rows + more), F.col("vec_id") % 50 == 0, F.col("label"))
    assert sorted(map(tuple, got.collect())) == brute_negatives(ids, x, labels)


def test_hard_negatives_of_repeated_empty_and_huge_rows(spark):
    same = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.9, 0.1], 2), (1, [0.9, 0.1], 2), (2, [0.0, 0.0], 1)]
    got = sorted(map(tuple, hard_negatives.mine(frame(spark, same), F.col("vec_id") == 0, F.col("label")).collect()))
    # both rows of id 0 are anchors, and each is the other's positive; the zero vector's window holds scores of zero only
    assert got == [(0, 0, 1, 1, 65536, 58880)] * 2 + [(0, 0, 2, 1, 65536, 58880)] * 2
    assert hard_negatives.mine(frame(spark, []), F.col("vec_id") == 0, F.col("label")).collect() == []
    assert hard_negatives.mine(frame(spark, [(0, [0.0, 0.0], 1), (50, [0.0, 0.0], 2)]), F.col("vec_id") == 0, F.col("label")).collect() == []
    with pytest.raises(Exception, match="beyond exact"):
        hard_negatives.mine(frame(spark, [(0, [1e30, 0.0], 1)]), F.col("vec_id") == 0, F.col("label"))


def test_a_block_meets_windows_of_any_ends():
    rng = np.random.default_rng(5)
    x = np.floor(256 * cluster(rng, 300, 6).astype(float))
    square = float((x * x).sum(axis=1).max())
    up = hard_negatives.raised(x, square)
    tree = hard_negatives.grown(up, 40, np.sqrt(square))
    assert all(np.isin(np.arange(c), np.arange(n)).all() and (p < c).all() for (c, _), (n, p) in zip(tree.levels, tree.levels[1:]))
    leaves = tree.nearest(up)
    radii = hard_negatives.covering(tree, tree.distances(up, leaves), leaves)
    q = np.floor(256 * rng.normal(size=(30, 6)))
    high, low, _ = tree.bounds(hard_negatives._flat(q), radii)
    s = q @ x.T
    assert (s <= high[:, leaves]).all() and (s >= low[:, leaves]).all()
    assert (high < high.max(axis=1, keepdims=True) / 2).any()  # the bounds tell leaves apart


def brute_neighbours(ids, x, asked, k):
    x, out = x.astype(np.float64), {}
    for a in np.flatnonzero(asked):
        s = (x[a] * x).sum(axis=1)
        order = [i for i in np.lexsort((ids, -s)) if i != a][:k]
        out[int(ids[a])] = [(int(ids[i]), s[i]) for i in order]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_neighbours_are_found_ranked_and_scored(spark, monkeypatch, small):
    if small:  # several polytopes in a table, and buckets dealt into grids
        for name, value in (("ROWS_PER_BUCKET", 2), ("ROWS_AT_ONCE", 40), ("QUERIES_AT_ONCE", 7), ("FIT_QUERIES", 10)):
            monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(4)
    x, ids = cluster(rng, 600, 16), rng.permutation(600)
    rows = [(int(i), v.tolist(), 0) for i, v in zip(ids, x)]
    more = [(2000, [0.0] * 16, 0), (None, x[0].tolist(), 0), *odd_rows(16)]
    got = neighbours.search(frame(spark, rows + more), F.col("vec_id") % 20 == 0, k=10).toPandas()
    want = brute_neighbours(ids, x, ids % 20 == 0, 10)
    hits, scores = 0, {int(i): v.astype(np.float64) for i, v in zip(ids, x)}
    assert set(got["query_id"]) == set(want)
    for query, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        assert list(own["rank"]) == list(range(1, len(own) + 1)) and query not in set(own["vec_id"]) and own["vec_id"].is_unique
        assert list(zip(-own["score"], own["vec_id"])) == sorted(zip(-own["score"], own["vec_id"]))
        assert all(s == (scores[query] * scores[v]).sum() for v, s in zip(own["vec_id"], own["score"]))
        hits += len(set(own["vec_id"]) & {v for v, _ in want[query]})
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_neighbours_of_repeated_rows_and_few_rows(spark):
    got = neighbours.search(frame(spark, [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (3, [0.5, 0.0], 0)]), F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 0, 1.0)] * 2 + [(0, 2, 3, 0.5)] * 2
    assert neighbours.search(frame(spark, []), F.col("vec_id") == 0).collect() == []
    assert neighbours.search(frame(spark, [(0, [1.0], 0)]), F.col("vec_id") == 0).collect() == []


def test_probes_are_in_order_and_reach_every_bucket():
    hashes = neighbours.Polytopes(7, (4, 2), tables=1)
    x = np.random.default_rng(1).normal(size=(50, 7))
    probes = hashes.probes(x, 0, hashes.buckets)
    assert (np.sort(probes, axis=1) == np.arange(hashes.buckets)).all()
    assert (probes[:, 0] == hashes.codes(x, 0)).all()
    assert (hashes.probes(x, 0, 5) == probes[:, :5]).all()


def test_recall_on_the_given_vectors(spark, sf_dir):
    table = pq.read_table(f"{sf_dir}/embeddings.parquet")
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), np.float32)
    want = brute_neighbours(ids, x, ids % 20 == 0, 20)
    got = neighbours.op12_neighbours(spark, sf_dir).groupBy("query_id").agg(F.collect_set("vec_id")).collect()
    assert sum(len(set(v) & {i for i, _ in want[q]}) for q, v in got) >= 0.9 * sum(map(len, want.values()))


def test_hard_negatives_equal_sql(spark, sf_dir):
    path = f"{sf_dir}/embeddings.parquet"
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
        want = db.execute(hard_negatives.ORACLE_SQL).fetchall()
    assert sorted(map(tuple, hard_negatives.op11_hard_negatives(spark, sf_dir).collect())) == sorted(want)


def test_whitening_equals_a_plain_decomposition(spark):
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(300, 9)) * np.linspace(1, 3, 9)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = whitening.whiten(frame(spark, [*rows, *odd_rows(9)])).toPandas()
    u = (np.floor(1024 * x.astype(np.float64)) + 100000).astype(np.int64)
    n, sums = len(u), u.sum(axis=0)
    c = u - sums / n
    e, v = (a[..., ::-1] for a in np.linalg.eigh(c.T @ c / n))
    assert set(got["n"]) == {n} and set(got["component"]) == set(range(1, 9)) and len(got) == 8 * n
    assert got["identity_error"].max() < 1e-12 and got["identity_error"].nunique() == 1
    for k, own in got.groupby("component"):
        own = own.sort_values("vec_id")
        assert (own["deviation"].to_numpy() == ((n * u - sums) ** 2).sum(axis=1)).all()
        plain = c @ v[:, k - 1] / np.sqrt(e[k - 1])
        assert min(np.abs(own["whitened"] - plain).max(), np.abs(own["whitened"] + plain).max()) < 1e-9
        assert np.allclose(own["explained"], e[k - 1] / e.sum(), rtol=1e-12)


def test_whitening_leaves_out_what_has_no_variance(spark):
    flat = [(i, [float(i % 4), 2.0, 1.0 * (i % 4)], 0) for i in range(40)]
    got = whitening.whiten(frame(spark, [*flat, (None, [1.0, 2.0, 1.0], 0)]))
    assert [r[0] for r in got.select("component").distinct().collect()] == [1]
    assert got.where("vec_id IS NULL").count() == 1 and got.first()["explained"] == pytest.approx(1)
    for rows in ([], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0)] * 3, odd_rows(1)[:4]):
        assert whitening.whiten(frame(spark, rows)).collect() == []


def test_sums_of_products_are_exact():
    d = np.random.default_rng(2).integers(-(1 << 50), 1 << 50, (37, 4))
    want = [sum(int(r[i]) * int(r[j]) for r in d) for i, j in zip(*np.triu_indices(4))]
    assert list(whitening.gram(d)) == want
    assert list(whitening.column_sums(d)) == [37, *(sum(map(int, d[:, k])) for k in range(4))]


@pytest.mark.parametrize("gap", [1e-3, 1e-8, 1e-12, 0])
def test_clustered_eigenvalues_are_refined(gap):
    rng, eye = np.random.default_rng(7), np.eye(30, dtype=np.longdouble)
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * eye - 0.5 * (q.T @ q))
    values = np.concatenate((1 + np.arange(6) * gap, np.linspace(2, 5, 24))).astype(np.longdouble)
    a = (q * values) @ q.T
    found, x = whitening.eigen((a + a.T) / 2)
    assert np.abs(x.T @ x - eye).max() < 1e-17 and np.abs(a @ x - x * found).max() < 1e-16
    assert np.abs(found[::-1] - values).max() < 1e-16
    if gap:  # single vectors come out as far as the matrix itself settles them
        assert np.abs(np.abs((q.T @ x)[:6, ::-1][:, :6]) - np.eye(6)).max() < 1e-16 / gap + 1e-14
