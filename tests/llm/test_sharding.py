import zlib

from inkveil.llm.sharding import balanced_shards, op5_sharding


def check(rows, docs, shards=8):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    sizes = [0] * shards
    for r in rows:
        sizes[r.shard] += r.size
    most = max((r.size for r in rows), default=0)
    assert all(abs(s - sum(sizes) / shards) <= most for s in sizes)
    for s in range(shards):
        mine = sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        assert [r.doc_id for r in mine] == sorted(r.doc_id for r in mine)
    last = [r.shard for r in sorted(rows, key=lambda r: r.doc_id)]
    assert last == sorted(last)


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = op5_sharding(spark, sf_dir).collect()
    check(rows, docs)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_edge_cases(spark):
    rows = [(1, None, 1), (2, "", 2), (2, "", 2), (2, "é", 2), (3, "x" * 100_000, 3), (4, "y" * 10, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int")
    check(balanced_shards(df, 3).collect(), [r[:2] for r in rows], 3)
    assert balanced_shards(df.limit(0)).count() == 0
    one = balanced_shards(spark.createDataFrame([(None, "a")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.slot) for r in one] == [(None, 0)]
