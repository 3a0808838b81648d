import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkveil.llm.packing import op3_packing, pack, plan, sequences
from inkveil.llm.tokens import Encoder

WORDS = public_tokenizers.path("word_bpe_49k.json")


def check_places(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query_against_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    tokenizer = Tokenizer.from_file(WORDS)
    expected, total = set(), 0
    for d in docs:
        ids = [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for k, s in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[s : s + 4096], "<u4")
            expected.add((d.doc_id, k, s, len(part), zlib.crc32(part.tobytes())))
    rows = op3_packing(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == expected
    assert len(rows) == len(expected)
    assert check_places(rows, 4096) <= 1.05 * -(-total // 4096) + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_uses_every_piece_once(counts):
    used, n = Counter(), 0
    for lengths, times in plan(counts, 64):
        assert sum(lengths) <= 64 and times > 0
        n += times
        for k in lengths:
            used[k] += times
    assert dict(used) == counts
    # First fit, longest first, as the bound.
    gaps = []
    for k in sorted(counts, reverse=True):
        for _ in range(counts[k]):
            i = next((i for i, g in enumerate(gaps) if g >= k), None)
            if i is None:
                gaps.append(64 - k)
            else:
                gaps[i] -= k
    assert n <= len(gaps) * 1.02 + 1


def test_exact_complements_fill_all():
    assert sum(t for _, t in plan({40: 5, 24: 5, 20: 10, 4: 10, 8: 5}, 64)) == -(-(40 * 5 + 24 * 5 + 200 + 40 + 40) // 64)


def test_edge_cases_and_sequences(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "hello world", "x"), (4, "word " * 9000, "x"), (5, "a, b " * 11, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    out = pack(df, WORDS, capacity=16).collect()
    check_places(out, 16)
    assert Counter(r.doc_id for r in out if r.doc_id != 4) == {1: 1, 2: 2, None: 1, 5: 3}
    assert pack(df.limit(0), WORDS).count() == 0
    packed = sequences(df, WORDS, capacity=16).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    got = defaultdict(dict)
    for s in packed:
        ids = np.frombuffer(bytes(s.ids), "<u4")
        assert len(ids) == s.length <= 16
        for p in s.pieces:
            if p.doc_id == 5:
                got[5][p.piece] = ids[p.offset : p.offset + p.length].tolist()
    assert sum((got[5][k] for k in sorted(got[5])), []) == [*tokenizer.encode("a, b " * 11, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_agrees_with_the_library(name):
    own, lib = Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    chars = [chr(c) for c in range(0x250)] + list("中文한글😀́ﬁ 　")
    fixed = [t for c in chars for t in (f"a{c}b", f" {c} {c}{c}1", f"x \n{c}  {c}'s{c}\n\n", f"'{c}S", f"{c}  {c}   {c} ", f"\n {c}\n \n{c}")]
    rng = np.random.default_rng(0)
    drawn = ["".join(rng.choice(list(" \n\t  aB'st12.,é"), 40)) for _ in range(3000)]
    texts = [*fixed, *drawn, "<|endoftext|> a", "a<|startoftext|>b"]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    ids, counts = own.encode([*texts, None])
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got.pop() == []
    assert [t for t, a, b in zip(texts, got, want) if a != b] == []
