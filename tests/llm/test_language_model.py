import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from inkveil.llm import language_model as lm


def tokens(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    return [x for x in w.split(" ") if x] + [" end"]


def fold(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10


def counts_of(texts):
    """Words, bigrams, and contexts of some token lists."""
    c = Counter(w for t in texts for w in t)
    return c, Counter(p for t in texts for p in zip([" begin", *t[:-1]], t)), {**c, " begin": len(texts)}


def bucket(count):
    return 1 + int(math.floor(math.log2(count))) if count else 0


def brute(docs, weights):
    """Plain Python version of score(), with the mixture's weights given."""
    c, pairs, context = counts_of([tokens(t) for i, t in docs if fold(i)])
    n, v = sum(c.values()), len(c)

    def chance(a, b):
        one, seen = c[b] / max(1, n), context.get(a, 0)
        two = pairs[a, b] / seen if seen else one
        w = weights[min(bucket(seen), len(weights) - 1)]
        return w[0] * two + w[1] * one + w[2] / (v + 1)

    out = []
    for i, t in docs:
        t = tokens(t)
        base = sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        full = sum(np.log10(chance(a, b)) for a, b in zip([" begin", *t[:-1]], t))
        out.append((i, fold(i) == 0, len(t), sum(c[w] > 0 for w in t), n, base, full))
    return out


def brute_weights(docs, n_buckets, near=lambda x: x, rounds=60):
    """Expectation-maximisation bigram by bigram; ``near`` rounds an estimate's ratio to 1 / (V + 1)."""
    c, pairs, context = counts_of([tokens(t) for i, t in docs if fold(i) > 1])
    n, v = sum(c.values()), len(c)
    held = defaultdict(list)
    for i, t in docs:
        if fold(i) == 1:
            t = tokens(t)
            for a, b in zip([" begin", *t[:-1]], t):
                one, seen = c[b] / max(1, n), context.get(a, 0)
                two = pairs[a, b] / seen if seen else one
                held[bucket(seen)].append((near(two * (v + 1)), near(one * (v + 1)), 1.0))

    def learn(estimates):
        w = [0.4, 0.5, 0.1]
        for _ in range(rounds):
            total = [0.5, 0.5, 0.5]
            for e in estimates:
                mix = sum(x * y for x, y in zip(w, e))
                for k in range(3):
                    total[k] += w[k] * e[k] / mix
            w = [x / sum(total) for x in total]
        return w

    every = learn([e for some in held.values() for e in some]) if held else [0.4, 0.5, 0.1]
    return np.array([learn(held[b]) if held.get(b) else every for b in range(n_buckets)])


def rows_of(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return frame, [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def same(got, expected):
    expected = {r[0]: r for r in expected}
    assert {r[0] for r in got} == set(expected) and len(got) == len(expected)
    for r in map(tuple, got):
        assert r[:5] == expected[r[0]][:5]
        assert np.allclose(r[5:], expected[r[0]][5:], rtol=1e-9)


@pytest.mark.parametrize("portion, share", [(lm.PORTION, lm.SHARE_TOKENS), (20_000, 3_000)])
def test_against_brute_force(spark, sf_dir, monkeypatch, portion, share):
    monkeypatch.setattr(lm, "PORTION", portion)
    monkeypatch.setattr(lm, "SHARE_TOKENS", share)
    frame, docs = rows_of(spark, sf_dir)
    model = lm.fit(frame)
    assert np.allclose(model.weights.sum(axis=1), 1) and (model.weights > 0).all()
    expected = brute(docs, model.weights)
    same(lm.score(frame, model).collect(), expected)
    same(lm.fit_and_score(frame).collect(), expected)


def test_weights_against_brute_force(spark, sf_dir):
    frame, docs = rows_of(spark, sf_dir)
    docs = docs[:150]
    weights = lm.fit(spark.createDataFrame(docs, "doc_id long, text string")).weights
    near = lambda x: 2 ** (round(lm.CELLS * math.log2(x)) / lm.CELLS) if x else 0.0
    assert np.allclose(weights, brute_weights(docs, len(weights), near), atol=1e-6)
    # The grid of estimates moves the weights but little.
    assert np.abs(weights - brute_weights(docs, len(weights))).max() < 0.03


def test_model_beats_the_base_on_held_out_texts(spark, sf_dir):
    rows = [r for r in lm.op8_language_model(spark, sf_dir).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_edge_cases(spark):
    rows = [(None, "a b", 1), (1, None, 2), (2, "", 3), (2, "", 3), (3, "word " * 50_000, 4), (4, "A\x0bb\tunseen\x0c", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, word int")
    out = lm.fit_and_score(frame).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in out) == [(-1, 3), (1, 1), (2, 1), (2, 1), (3, 50_001), (4, 4)]
    assert all(np.isfinite(r.score) for r in out)
    empty = frame.limit(0)
    model = lm.fit(empty)
    assert lm.score(empty, model).count() == 0 and lm.fit_and_score(empty).count() == 0
    assert all(np.isfinite(r.score) for r in lm.score(frame, model).collect())
