from pyspark.sql import functions as F

import corpus_pipeline
from inkveil.llm.quality import judge

from .test_near_copies import brute_groups
from .test_packing import check_places


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = {r.doc_id: r.text for r in judge(docs).where("kept").collect()}
    best = {}
    for i, t in sorted(good.items(), key=lambda x: (-len(x[1]), x[0])):
        best.setdefault("".join(t.translate({c: None for c in (9, 10, 11, 12, 13, 32)})), i)
    expected = set(brute_groups({i: good[i] for i in best.values()}).values())
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == expected
    assert check_places(rows, 4096) * 4096 < 1.1 * sum(r.length for r in rows) + 4096


def test_stages_keep_columns_and_take_anything(spark, sf_dir):
    rows = [(1, None, "en", "a", None), (2, "", None, "a", 0), (None, "word " * 60, "en", None, 1), (3, "the and of to " * 30, "en", "a", 9), (3, "the and of to " * 30, "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, some, sf_dir).columns == docs.columns
            stage(spark, some, sf_dir).count()
        corpus_pipeline.STAGES[-1][1](spark, some, sf_dir).count()


def test_a_long_clean_text_stays(spark, sf_dir):
    text = " ".join(f"the cat{i} of house{i * 7}" for i in range(260_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert judge(docs).first().kept
    assert corpus_pipeline.keep_quality(spark, docs, sf_dir).count() == 1


def test_quality_keeps_columns_of_its_measures_names(spark, sf_dir):
    rows = [(1, "the cat of house " * 5 + " ".join(f"and w{i} to" for i in range(60)), "mine", 7, "x", None, 3.5)] * 2 + [(2, "short", "mine", 7, "x", None, 3.5), (3, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int, broken string, Word_Chars string, _kept double")
    got = corpus_pipeline.keep_quality(spark, docs, sf_dir)
    assert got.schema == docs.schema and got.collect() == docs.where("doc_id = 1").collect()


def test_dedup_stages_tell_rows_by_id_and_text(spark, sf_dir):
    rows = [(3, "a", 1), (5, "a", 2), (5, "b c", 3), (5, "bc", 9), (7, "d", 4), (7, "d", 4), (None, "a", 5), (None, "e", 6), (None, "e", 7), (None, "f", 8), (8, None, 0), (9, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int").select("doc_id", "text", "_id", "_id", F.lit(1).alias("kept")).toDF("doc_id", "text", "_id", "digest", "kept")
    exact = corpus_pipeline.drop_exact_copies(spark, docs, sf_dir)
    assert exact.columns == docs.columns
    got = sorted(((r.doc_id or 0), r.text or "") for r in exact.collect())
    assert got == [(0, "a"), (0, "e"), (0, "f"), (5, "b c"), (7, "d"), (8, "")]
    near = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert near.columns == docs.columns
    got = sorted(((r.doc_id or 0), r.text or "") for r in near.collect())
    assert got == [(0, "e"), (0, "f"), (3, "a"), (5, "b c"), (5, "bc"), (7, "d"), (8, "")]
