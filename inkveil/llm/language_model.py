"""Language-model scoring by deleted interpolation of n-gram estimates.

The probability of a word v after u mixes three estimates, with weights by the bucket (power of two)
of u's frequency: the bigram estimate c(u, v) / c(u), the unigram estimate c(v) / N, and 1 / (V + 1) for
any word, known or not. The weights are learned by expectation-maximisation on held-out counts: bigrams
are counted on the fitting documents, and weighted by how often they occur in a held-out tenth.

All words and bigrams are counted and used; none is pruned, and no table of counts is broadcast. Texts are
cut into words once and stored as portions of word numbers. A portion asks for the counts of its distinct
words and bigrams: keys are dealt to shares by hash, a share adds up what all portions bring and answers
each in the order in which it asked, so answers are plain columns of numbers. A bigram comes once from a
portion, however frequent it is, so no share is hot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import land

FOLDS = 10
#: Documents of fold 0 are not learned from; those of fold 1 weight the mixture, the others are fitted on.
TEST, HELD = 0, 1
#: Characters of text in a portion, about.
PORTION = 4_000_000
#: Tokens for which there is one share of the keys, about; bounds a task's memory, not what is counted.
SHARE_TOKENS = 1_000_000
#: Stored rows are large: row groups end after some 16 MB, so that a reader holds few rows at once.
ROWS_APART = {"compression": "zstd", "parquet.block.size": str(1 << 24), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
#: Cells of held-out counts per power of two of a ratio of estimates, and the cell of a ratio of zero.
CELLS = 4
ZERO = -(10**6)
ROUNDS = 60
#: Stands for the end of a text; no word has a space.
END = b" end"
#: Stands for the context of a text's first token.
BEGIN = np.uint64(xxhash.xxh64_intdigest(b" begin"))

_PORTION = "p long, ids binary, known binary, folds binary, sizes binary, tokens binary, words binary, tokens_fit long, tokens_held long, texts_fit long, texts_held long, tokens_all long"
_ASK = "share int, p long, words binary, words_fit binary, words_held binary, pairs binary, pairs_fit binary, pairs_held binary"
_ANSWER = "share int, p long, words binary, words_fit binary, pairs binary, pairs_fit binary, distinct long, distinct_fit long"
_COUNTED = "ids binary, known binary, folds binary, sizes binary, tokens binary, words binary, pairs binary, cells array<struct<b:int,two:int,one:int,n:long>>"


def _rows(schema: str, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 by as many planes of bytes as the largest has, after a byte that tells how many."""
    if not len(numbers):
        return b""
    planes = max(1, -(-int(numbers.max()).bit_length() // 8))
    return bytes([planes]) + np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.int64)
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    numbers = np.zeros((planes.shape[1], 8), np.uint8)
    numbers[:, : data[0]] = planes.T
    return numbers.view("<i8").ravel()


def _each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one: a portion is large, so a batch's are not unpacked together."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
            pa.default_memory_pool().release_unused()


def fold_of(doc_id: int | None) -> int:
    """crc32 of the id as text, by ``FOLDS``; a null id is in fold 0."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


@dataclass
class Portion:
    """Some documents' tokens: ``words`` (hashes of distinct tokens), ``tokens`` (places in ``words``), ``sizes`` (tokens of each document)."""

    ids: pa.Array
    folds: np.ndarray
    sizes: np.ndarray
    tokens: np.ndarray
    words: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def contexts(self) -> np.ndarray:
        """Place of the word before each token; the number of words at a text's beginning."""
        u = np.empty_like(self.tokens)
        u[1:] = self.tokens[:-1]
        u[np.cumsum(self.sizes) - self.sizes] = len(self.words)
        return u

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct bigrams (context * words + word, as places, sorted), and that of each token."""
        found, at = np.unique(self.contexts() * max(1, len(self.words)) + self.tokens, return_inverse=True)
        return found, at.ravel()

    def pair_keys(self, pairs: np.ndarray) -> np.ndarray:
        """64-bit hashes of bigrams, from those of their words."""
        u, v = np.divmod(pairs, max(1, len(self.words)))
        mixed = np.append(self.words, BEGIN)[u] * np.uint64(0x9E3779B97F4A7C15) + self.words[v]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return mixed ^ (mixed >> np.uint64(29))

    @classmethod
    def of(cls, row: dict) -> Portion:
        ids = pa.array(np.frombuffer(row["ids"], "<i8"), mask=np.frombuffer(row["known"], np.uint8) == 0)
        words = np.frombuffer(row["words"], "<u8") if "pairs" not in row else np.empty(0, np.uint64)
        return cls(ids, np.frombuffer(row["folds"], np.uint8), unpacked(row["sizes"]), unpacked(row["tokens"]), words)


def _portion(ids: pa.Array, texts: pa.Array) -> Portion:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    some = pc.not_equal(pc.list_flatten(lists), "")
    coded = pc.list_flatten(lists).filter(some).dictionary_encode()
    n = np.bincount(pc.list_parent_indices(lists).filter(some).to_numpy(), minlength=len(texts))
    words = np.array([*map(xxhash.xxh64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()), xxhash.xxh64_intdigest(END)], np.uint64)
    tokens = np.empty(int(n.sum()) + len(texts), np.int64)
    is_end = np.zeros(len(tokens), bool)
    is_end[np.cumsum(n + 1) - 1] = True
    tokens[is_end], tokens[~is_end] = len(words) - 1, coded.indices.to_numpy()
    # Frequent words first, so that most places are small.
    order = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    folds = np.fromiter(map(fold_of, ids.to_pylist()), np.uint8, len(ids))
    return Portion(ids, folds, n + 1, place[tokens], words[order])


def portions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored portions of the texts' tokens (A-Z lower-cased, cut at ASCII white space, then one end for each text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
            cuts = np.unique(np.searchsorted(sizes, np.arange(PORTION, sizes[-1] + PORTION if len(sizes) else 0, PORTION), side="right"))
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                x = _portion(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a))
                known = x.ids.is_valid().to_numpy(zero_copy_only=False)
                sums = [int(part[x.folds > HELD].sum() if fit else part[x.folds == HELD].sum()) for part in (x.sizes, np.ones(len(x.sizes), np.int64)) for fit in (True, False)]
                sums.append(len(x.tokens))
                blobs = [x.ids.fill_null(0).to_numpy().astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), x.folds.tobytes(), packed(x.sizes), packed(x.tokens), x.words.astype("<u8").tobytes()]
                yield _rows(_PORTION, [pa.array([p]), *(pa.array([y], pa.binary()) for y in blobs), *(pa.array([y], pa.int64()) for y in sums)])
                p += 1
                pa.default_memory_pool().release_unused()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return land(texts.mapInArrow(run, _PORTION), "portions", **ROWS_APART)


def _dealt(keys: np.ndarray, shares: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts keys of one share side by side, and where each share begins."""
    share = (keys % np.uint64(shares)).astype(np.int64)
    return np.argsort(share, kind="stable"), np.append(0, np.cumsum(np.bincount(share, minlength=shares)))


def asked(stored: DataFrame, shares: int) -> DataFrame:
    """For each portion and share of the keys: distinct words and bigrams with how often they occur in fitting and in held-out texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each_row(batches):
            x = Portion.of(row)
            fold = x.folds[x.doc]
            pairs, at = x.pairs()
            blobs = []
            for keys, place in ((x.words, x.tokens), (x.pair_keys(pairs), at)):
                order, cuts = _dealt(keys, shares)
                columns = [keys.astype("<u8")[order]] + [np.bincount(place[some], minlength=len(keys))[order] for some in (fold > HELD, fold == HELD)]
                blobs += [[(packed(c[a:b]) if k else c[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])] for k, c in enumerate(columns)]
            # Only shares with a key, so rows never outnumber a portion's keys.
            some = [k for k in range(shares) if blobs[0][k] or blobs[3][k]]
            yield _rows(_ASK, [pa.array(some, pa.int32()), pa.array([row["p"]] * len(some), pa.int64()), *(pa.array([b[k] for k in some], pa.binary()) for b in blobs)])

    return stored.mapInArrow(run, _ASK)


def _added(table: pa.Table, what: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of one share, their counts in training and in fitting texts, and the place of each key that came."""
    keys = np.frombuffer(b"".join(table.column(what).to_pylist()), "<u8")
    fit, held = (np.concatenate([np.empty(0, np.int64), *map(unpacked, table.column(f"{what}_{k}").to_pylist())]) for k in ("fit", "held"))
    found, at = np.unique(keys, return_inverse=True)
    fit, held = (np.bincount(at.ravel(), x, len(found)).astype(np.int64) for x in (fit, held))
    return found, fit + held, fit, at.ravel()


def _answers(counted: pa.Table, asking: pa.Table | None) -> pa.Table:
    """Answer each row of a share with the counts of its keys, in its order. ``asking`` is None if those ask who were counted."""
    rows = counted if asking is None else asking
    columns, distinct = [], (0, 0)
    for what in ("words", "pairs"):
        found, n, fit, at = _added(counted, what)
        sizes = np.fromiter((len(b) // 8 for b in rows.column(what).to_pylist()), np.int64, rows.num_rows)
        if asking is not None:
            keys = np.frombuffer(b"".join(rows.column(what).to_pylist()), "<u8")
            at = np.minimum(np.searchsorted(found, keys), max(0, len(found) - 1))
            known = found[at] == keys if len(found) else np.zeros(len(keys), bool)
            n, fit, at = np.append(n, 0), np.append(fit, 0), np.where(known, at, len(found))
        cuts = np.append(0, np.cumsum(sizes))
        columns += [pa.array([packed(x[at[a:b]]) for a, b in zip(cuts, cuts[1:])], pa.binary()) for x in (n, fit)]
        if what == "words":
            distinct = int((n > 0).sum()), int((fit > 0).sum())
    # A share tells its numbers of distinct words once.
    once = [pa.array([x if i == 0 else 0 for i in range(rows.num_rows)], pa.int64()) for x in distinct]
    return pa.table([rows.column("share"), rows.column("p"), *columns, *once], [c.split()[0] for c in _ANSWER.split(", ")])


@dataclass
class Model:
    """What the corpus taught: numbers of tokens, distinct words and texts, in training and in fitting documents, the weights by bucket, and the counts as the portions bring them."""

    n: int
    n_fit: int
    texts: int
    texts_fit: int
    shares: int
    counts: DataFrame
    v: int = 0
    v_fit: int = 0
    weights: np.ndarray | None = None


def buckets(count: np.ndarray) -> np.ndarray:
    """Bucket of each context by its frequency: powers of two from 1 on; 0 for one never seen."""
    return np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))).astype(np.int64), 0)


def _cells(x: Portion, answer: dict, pairs: np.ndarray, at: np.ndarray, model: Model) -> list[dict]:
    """Held-out bigrams of a portion, by bucket and by their estimates' ratios to 1 / (V + 1)."""
    held = (x.folds == HELD)[x.doc]
    n = np.bincount(at[held], minlength=len(pairs))
    some = np.flatnonzero(n)
    u, v = np.divmod(pairs[some], len(x.words))
    cu, cv = np.append(answer["words_fit"], model.texts_fit)[u], answer["words_fit"][v]
    one = cv / max(1, model.n_fit)
    two = np.where(cu > 0, answer["pairs_fit"][some] / np.maximum(cu, 1), one)
    fine = lambda y: np.where(y > 0, np.round(CELLS * np.log2(np.maximum(y, 1e-300) * (model.v_fit + 1))), ZERO).astype(np.int64)
    cell, place = np.unique(np.stack([buckets(cu), fine(two), fine(one)], 1), axis=0, return_inverse=True)
    return [{"b": int(b), "two": int(t), "one": int(o), "n": int(k)} for (b, t, o), k in zip(cell, np.bincount(place.ravel(), n[some]))]


def counted(stored: DataFrame, answers: DataFrame, model: Model) -> DataFrame:
    """Stored portions with the counts of each word, and of each token's bigram, and their held-out cells."""
    told = Model(model.n, model.n_fit, model.texts, model.texts_fit, model.shares, None, model.v, model.v_fit)

    def run(portion: pa.Table, answer: pa.Table) -> pa.Table:
        out = []
        for row in portion.to_pylist():
            x = Portion.of(row)
            pairs, at = x.pairs()
            found = {}
            parts = answer.sort_by("share")
            for what, keys in (("words", x.words), ("pairs", x.pair_keys(pairs))):
                order, _ = _dealt(keys, told.shares)
                for name in (what, f"{what}_fit"):
                    found[name] = np.empty(len(keys), np.int64)
                    found[name][order] = np.concatenate([np.empty(0, np.int64), *map(unpacked, parts.column(name).to_pylist())])
            out.append({k: row[k] for k in ("ids", "known", "folds", "sizes", "tokens")} | {"words": packed(found["words"]), "pairs": packed(found["pairs"][at]), "cells": _cells(x, found, pairs, at, told)})
        cell = pa.struct([("b", pa.int32()), ("two", pa.int32()), ("one", pa.int32()), ("n", pa.int64())])
        return pa.Table.from_pylist(out, pa.schema([(c.split()[0], pa.list_(cell) if c.startswith("cells") else pa.binary()) for c in _COUNTED.split(", ")]))

    return stored.groupBy("p").cogroup(answers.groupBy("p")).applyInArrow(run, _COUNTED)


def learn_weights(cells: np.ndarray, n_buckets: int, rounds: int = ROUNDS) -> np.ndarray:
    """Expectation-maximisation per bucket. ``cells``: bucket, three estimates' ratios, held-out count. A bucket without counts takes the weights of all."""
    start = np.array([0.4, 0.5, 0.1])

    def one(some: np.ndarray) -> np.ndarray:
        w = start
        for _ in range(rounds):
            share = w * some[:, 1:4]
            share *= (some[:, 4] / np.maximum(share.sum(axis=1), 1e-300))[:, None]
            # Half a count for each keeps every weight above zero, so any text has a probability.
            w = (share.sum(axis=0) + 0.5) / (share.sum() + 1.5)
        return w

    every = one(cells) if len(cells) else start
    return np.array([one(x) if len(x := cells[cells[:, 0] == b]) else every for b in range(n_buckets)])


def _learned(counts: DataFrame, model: Model) -> np.ndarray:
    """Weights from the cells of all portions: a grid of bounded size, whatever the corpus."""
    grid = counts.select(F.explode("cells").alias("c")).groupBy("c.b", "c.two", "c.one").agg(F.sum("c.n").alias("n")).collect()
    ratio = lambda x: 0.0 if x == ZERO else 2.0 ** (x / CELLS)
    cells = np.array([(r.b, ratio(r.two), ratio(r.one), 1.0, r.n) for r in grid], float).reshape(-1, 5)
    return learn_weights(cells, int(max(model.n, model.texts, 1)).bit_length() + 1)


def _fitted(docs: DataFrame, id_col: str, text_col: str) -> tuple[Model, DataFrame]:
    """The model, and the counted portions of its own texts."""
    stored = portions(docs, id_col, text_col)
    sums = stored.agg(*(F.sum(f"{what}_{k}") for what in ("tokens", "texts") for k in ("fit", "held")), F.sum("tokens_all")).first()
    n_fit, n_held, t_fit, t_held, tokens = (int(x or 0) for x in sums)
    shares = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tokens // SHARE_TOKENS))
    asks = asked(stored, shares)
    model = Model(n_fit + n_held, n_fit, t_fit + t_held, t_fit, shares, asks)
    answers = land(asks.groupBy("share").applyInArrow(lambda t: _answers(t, None), _ANSWER), "answers", **ROWS_APART)
    model.v, model.v_fit = (x or 0 for x in answers.agg(F.sum("distinct"), F.sum("distinct_fit")).first())
    counts = land(counted(stored, answers, model), "counted", **ROWS_APART)
    model.weights = _learned(counts, model)
    return model, counts


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from all documents but those of fold 0. The driver gets sums, and a grid of held-out counts of bounded size."""
    return _fitted(docs, id_col, text_col)[0]


def _scores(counts: DataFrame, model: Model) -> DataFrame:
    weights, n, v, texts = model.weights, model.n, model.v, model.texts
    norm = float(np.log10(n + 0.1 * (v + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each_row(batches):
            x = Portion.of(row)
            words = unpacked(row["words"])
            # Portion.contexts with the counts in the words' place.
            x.words = words
            d, doc, c = len(x.sizes), x.doc, words[x.tokens]
            cu = np.append(words, texts)[x.contexts()]
            w = weights[np.minimum(buckets(cu), len(weights) - 1)]
            one = c / max(1, n)
            two = np.where(cu > 0, unpacked(row["pairs"]) / np.maximum(cu, 1), one)
            chance = w[:, 0] * two + w[:, 1] * one + w[:, 2] / (v + 1)
            add = lambda y: pa.array(np.bincount(doc, y, d))
            known = np.bincount(doc, c > 0, d).astype(np.int64)
            base = np.bincount(doc, np.log10(c + 0.1), d) - x.sizes * norm
            yield pa.RecordBatch.from_arrays(
                [x.ids, pa.array(x.folds == TEST), pa.array(x.sizes), pa.array(known), pa.array(np.full(d, n)), pa.array(base), add(np.log10(chance))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return counts.select("ids", "known", "folds", "sizes", "tokens", "words", "pairs").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Defined cases: a null or empty text is one end; a null id is in fold 0; rows that repeat an id are
    scored each; an empty table gives no rows; other columns are ignored.
    """
    stored = portions(docs, id_col, text_col)
    answers = model.counts.groupBy("share").cogroup(asked(stored, model.shares).groupBy("share")).applyInArrow(_answers, _ANSWER)
    return _scores(counted(stored, answers, model), model)


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`fit`, and :func:`score` of the same documents, with each key asked for once. Rows that repeat an id are learned from each."""
    model, counts = _fitted(docs, id_col, text_col)
    return _scores(counts, model)


def op8_language_model(spark, sf_dir: str) -> DataFrame:
    return fit_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
