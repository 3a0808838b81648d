import hashlib
import re
from collections import defaultdict

from inkveil.llm.exact_dedup import drop_copies, groups_of_equals, op1_exact_dedup


def brute(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    out = []
    for norm, members in groups.items():
        keep = min(members)[1]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for _, i in members]
    return sorted(out)


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, op1_exact_dedup(spark, sf_dir).collect())) == brute(docs)


def test_group_over_many_partitions(spark):
    docs = [(i, "one  hot text" if i % 3 else f"text {i}") for i in range(3000)] + [(9000, "one hot  text  \n\n"), (9001, "x" * 300_000), (9002, "x" * 300_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = groups_of_equals(df.repartition(7), rank="length(text)")
        assert sorted(map(tuple, got.collect())) == brute(docs)
        kept = drop_copies(df, rank="length(text)")
        assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute(docs) if r[3])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_edge_cases(spark):
    rows = [(4, None, "k"), (3, "", "k"), (3, "", "k"), (5, " \n", "k"), (None, "a b", "k"), (7, "ab", None), (8, "ab", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, norm string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in groups_of_equals(df).collect()}
    assert got == {(3, 3, 4, True), (4, 3, 4, False), (5, 3, 4, False), (None, None, 3, True), (7, None, 3, False), (8, None, 3, False)}
    assert drop_copies(df).columns == df.columns
    assert groups_of_equals(df.limit(0)).count() == 0
