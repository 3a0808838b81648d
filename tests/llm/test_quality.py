import re
from collections import Counter

from inkveil.llm.quality import Rule, judge, op10_quality_rules

SPACE = r"[\x20\x09-\x0D]"


def brute(text):
    text = text or ""
    words = [w for w in re.split(f"{SPACE}+", text) if w]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def test_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op10_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.base_failed and r.kept)


def test_clean_texts_stay(spark, sf_dir):
    rows = [r for r in op10_quality_rules(spark, sf_dir).collect() if not r.base_failed]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1]
    assert sum(good) >= 0.98 * len(good)


def test_edge_cases(spark):
    rows = [(1, None, 7, "x"), (2, "", 7, "x"), (3, " \t\n", 7, "x"), (4, "a b c a b c a b c", 7, "x"), (4, "a b c a b c a b c", 7, "x"), (5, "the of é😀 " * 40_000, 7, "x"), (6, "x\nx\n\nx \nx", 7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, ws string")
    out = judge(df)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns[:3] == ["doc_id", "text", "ws"] and out.count() == len(rows)
    for i, t, *_ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t)
    assert "min_words" in got[1].broken and not got[3].kept
    assert judge(df.limit(0)).count() == 0
    assert judge(df, (Rule("few", "n_words", high=5),)).where("kept").count() == 4
