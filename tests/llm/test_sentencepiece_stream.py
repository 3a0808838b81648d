import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from inkveil.llm.sentencepiece_stream import Model, encode, op7_sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def numbers(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def test_query_against_the_library(spark, sf_dir, lib):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op7_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = lib.encode(docs[r.doc_id])
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.text_crc32 == zlib.crc32(lib.decode(ids).encode())


def test_drawn_texts(lib):
    m, draw = Model(PATH), random.Random(0)
    texts = ["".join(draw.choices("abcthe  \n\t한é😀ing_.▁", k=draw.randrange(200))) for _ in range(800)]
    texts += ["", " ", "   a", "a" * 3000, "the" * 700, "日本語" * 300, "￿", " " * 100, "re" * 500]
    assert [numbers(m.encode(t)) for t in texts] == lib.encode(texts)
    for ids in lib.encode(texts):
        assert m.decode(np.array(ids, "<u4").tobytes()) == lib.decode(ids)


def test_search_commits_early(lib):
    m = Model(PATH)
    text = m.library.normalize("there" * 4000)
    parts = list(m.search(text))
    assert max(map(len, parts)) < 10 * m.longest and len(parts) > 100
    assert numbers(m.ids_of(p for part in parts for p in part)) == lib.encode("there" * 4000)


def test_window_stays_small_on_a_text_of_ten_million_characters(lib, monkeypatch):
    m, draw, widest = Model(PATH), random.Random(2), [0, 0]
    shared, normalize = m.shared, m.library.normalize
    monkeypatch.setattr(m, "shared", lambda back, end: widest.__setitem__(0, max(widest[0], len(back))) or shared(back, end))
    words = ["".join(draw.choices("abcdefgh", k=draw.randrange(1, 90))) for _ in range(2000)]
    text = "x" * 70_000 + " " + " ".join(draw.choices(words, k=215_000))
    assert len(text) > 9_500_000
    monkeypatch.setattr(m, "library", type("Library", (), {"normalize": lambda self, t: widest.__setitem__(1, max(widest[1], len(t))) or normalize(t)})())
    assert numbers(m.encode(text)) == lib.encode(text)
    assert 0 < widest[0] < 20 * m.longest and widest[1] < 150_000


def test_blocks_are_normalised_as_the_whole(lib):
    m, draw = Model(PATH), random.Random(3)
    for k in (0, 1, 70_000, 200_000):
        text = "".join(draw.choices("ab c  \t́é", k=k))
        assert "".join(m.normal(text)) == lib.normalize(text)


def test_unigram_path_has_the_best_score():
    m = Model(PATH)
    m.merges, draw = False, random.Random(1)
    alphabet = ["a", "b", "ab", "ba", "aab", "bbb", "abab"]
    m.scores = {p: -draw.random() * 3 for p in alphabet}
    m.longest, m.worst = 4, -20.0
    for _ in range(50):
        text = "".join(draw.choices("ab", k=60))
        best = [0.0] + [float("-inf")] * len(text)
        for i in range(1, len(text) + 1):
            best[i] = max(best[i - len(p)] + s for p, s in m.scores.items() if text[:i].endswith(p))
        m.ids = {p: i for i, p in enumerate(alphabet)}
        pieces = [alphabet[i] for part in m.search(text) for i in part]
        assert "".join(pieces) == text and sum(m.scores[p] for p in pieces) == pytest.approx(best[-1])


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "two words", "x"), (3, "two words", "x"), (None, "a" * 100_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode(df, PATH).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in got) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert encode(df.limit(0), PATH).count() == 0
