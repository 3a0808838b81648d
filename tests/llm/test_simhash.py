import numpy as np
import pytest
import xxhash

from inkveil.llm.simhash import components, links, near_groups, op2_simhash


def brute_fingerprint(text, words=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps: dict[int, int], radius=2) -> dict[int, int]:
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array([fps[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[:k] ^ values[k]) <= radius):
            a, b = find(i), find(ids[j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query_matches_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    fps = {i: brute_fingerprint(t) for i, t in docs.items()}
    expected = {(i, f"{fps[i]:016x}", c) for i, c in brute_components(fps).items()}
    assert {tuple(r) for r in op2_simhash(spark, sf_dir).collect()} == expected


def test_edge_cases(spark):
    rows = [(5, None, 1), (7, "", 1), (2, "one", 1), (2, "one", 1), (9, "ONE", 2), (4, "a b c d " * 3000, 3), (3, " \t", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id, r.component_id) for r in near_groups(df).collect())
    assert got == [(2, 2), (2, 2), (3, 3), (4, 4), (5, 3), (7, 3), (9, 2)]
    assert near_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [2, 3])
def test_links_join_what_is_near(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 30)
    fps = {int(b) ^ sum(1 << int(k) for k in rng.choice(63, n, replace=False)) for b in base for n in (0, 1, 2, 3, 4)}
    edges = links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius)
    got = {r.node: r.root for r in components(edges).collect()}
    brute = brute_components({f: f for f in fps}, radius)
    groups = lambda of: {frozenset(f for f in fps if of.get(f, f) == r) for r in {of.get(f, f) for f in fps}}
    assert groups(got) == groups(brute)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.root for r in components(edges).collect()} == {0}
