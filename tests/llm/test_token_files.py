import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkveil.llm.token_files import op4_token_files, pack_block, read_tokens, unpack_block, write_tokens

BYTES = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=300))
def test_blocks_round_trip(ids):
    a = np.array(ids, np.uint32)
    assert unpack_block(memoryview(pack_block(a) + b"more")).tolist() == ids


@pytest.mark.parametrize("ids", [[7], [5] * 4096, [0, 2**32 - 1], list(range(4096)), [3] * 4000 + [50_000] * 5])
def test_fixed_blocks(ids):
    a = np.array(ids, np.uint32)
    assert unpack_block(memoryview(pack_block(a))).tolist() == ids


def expected(docs):
    tokenizer, at, rows = Tokenizer.from_file(BYTES), 0, []
    for d in sorted(docs, key=lambda d: (d.doc_id is not None, d.doc_id)):
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        rows.append((d.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return rows


def test_query_against_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, op4_token_files(spark, sf_dir).collect())) == expected(docs)


def test_edge_cases(spark, tmp_path):
    rows = [(3, None, 1), (None, "no id", 1), (1, "", 1), (7, "long text\nof many words. " * 20_000, 1), (9, "same", 2), (9, "same", 2), (4, "한글 émoji 😀", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, value int")
    write_tokens(df, f"file://{tmp_path}/t", BYTES)
    got = read_tokens(spark, f"file://{tmp_path}/t").collect()
    key = lambda r: (r[1], r[0] or 0)
    assert sorted([(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got], key=key) == sorted(expected(df.collect()), key=key)
    write_tokens(df.limit(0), f"file://{tmp_path}/none", BYTES)
    assert read_tokens(spark, f"file://{tmp_path}/none").count() == 0


def test_files_are_bounded(spark, tmp_path):
    """Files hold few texts where asked to, also of one id; starts run on over all of them."""
    rows = [(None if i % 2 else i, f"text {i} " * 20) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    write_tokens(df, f"file://{tmp_path}/t", BYTES, bytes_per_file=4000)
    files = [f.stat().st_size for f in (tmp_path / "t").iterdir() if f.suffix == ".txt" and f.stat().st_size]
    assert len(files) > 8 and max(files) < sum(files) / 4
    got = sorted(read_tokens(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(BYTES)
    assert sorted(bytes(r.ids) for r in got) == sorted(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for _, t in rows)
    assert [r.doc_id for r in got] == [None] * 200 + list(range(0, 400, 2))
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))
