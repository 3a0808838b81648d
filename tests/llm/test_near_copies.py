import random

from pyspark.sql import functions as F

from inkveil.llm import near_copies
from inkveil.llm.near_copies import one_of_each_group, similar_groups


def shingles(text, words=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute_groups(texts: dict, similarity=0.8) -> dict:
    """The smallest id that each id reaches, by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root, having = {i: i for i in texts}, {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        shared = {}
        for s in sets[i] or [()]:
            for j in having.setdefault(s, []):
                shared[j] = shared.get(j, 0) + 1
            having[s].append(i)
        for j, n in shared.items():
            if not sets[i] and not sets[j] or n >= similarity * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def test_groups_of_documents_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = brute_groups({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.best.doc_id for r in similar_groups(docs).collect()} == expected
    assert {r.doc_id for r in one_of_each_group(docs).collect()} == set(expected.values())


def test_large_group_of_edits_and_shared_passages(spark):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, passage = [word() for _ in range(200)], [word() for _ in range(60)]
    texts = {0: " ".join(base)}
    for i in range(1, 400):
        edited = list(base)
        for at in rng.sample(range(200), 3):
            edited[at] = word()
        texts[i] = " ".join(edited)
    for i in range(400, 700):
        texts[i] = " ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.best.doc_id for r in similar_groups(docs).collect()}
    assert got == brute_groups(texts)
    assert sum(got[i] == i for i in range(400, 700)) == 300


def test_chains_of_copies_hold_together(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"

    def edited(words, k):
        out = list(words)
        for at in rng.sample(range(len(out)), k):
            out[at] = word()
        return out

    base = [word() for _ in range(200)]
    children = [edited(base, 1) for _ in range(150)]
    texts = dict(enumerate(" ".join(w) for w in [base, *children, *(edited(c, 4) for c in children)]))
    # a chain of ten links, each of whose ends is unlike all but its neighbours
    chain = [[word() for _ in range(200)]]
    for _ in range(10):
        chain.append(edited(chain[-1], 3))
    texts |= {1000 - i: " ".join(w) for i, w in enumerate(chain)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.best.doc_id for r in similar_groups(docs).collect()}
    assert got == brute_groups(texts)
    assert len(set(got.values())) <= 3


def test_a_passage_of_many_unlike_texts_makes_no_pairs(spark):
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(90)]
    texts = [(i, " ".join([f"w{rng.randrange(10**7)}" for _ in range(30)] + passage)) for i in range(1500)]
    marked = near_copies._marks(spark.createDataFrame(texts, "doc_id long, text string"), 5, "doc_id", "text", F.lit(""))
    shingles = marked.select(F.col("doc_id").alias("node"), "shingles")
    first = near_copies._prefixes(marked.select(F.col("doc_id").alias("node"), "n"), shingles, 0.8)
    parts = marked.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("part"))
    assert near_copies._across(first, parts, 0.8).count() == 0


def test_edge_cases(spark):
    long = "a b c d e f g " * 3000
    rows = [(5, None), (7, ""), (2, "one two"), (2, "one two"), (9, "ONE\ttwo"), (4, long), (3, " \t"), (None, long + "h"), (None, "x y"), (2, "other text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("row", F.lit(2))
    got = sorted((r.doc_id or 0, r.best.doc_id or 0) for r in similar_groups(df).collect())
    assert got == [(0, 0), (0, 4), (2, 2), (2, 2), (2, 2), (3, 3), (4, 4), (5, 3), (7, 3), (9, 2)]
    kept = one_of_each_group(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text[:7]) for r in kept.collect()) == [(0, "x y"), (2, "one two"), (2, "other t"), (3, " \t"), (4, long[:7])]
    assert similar_groups(df.limit(0)).count() == 0 and one_of_each_group(df.limit(0)).count() == 0
