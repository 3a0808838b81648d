"""SimHash near-dedup by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep_rows, land, salted_left_join

BITS = 64
SEED = 42
#: Shingles whose bits are counted at once, so memory does not follow a text's length.
BLOCK = 1 << 16


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of one text, repeats included, in blocks; nothing for a text without words.

    Words are runs without ASCII white space, A-Z lower-cased. Shingles of ``words`` words are joined
    by a space; a text of fewer words is one shingle.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in tokens), np.int64, len(tokens)))
    n = max(1, len(tokens) - words + 1)
    last = min(words, len(tokens)) - 1
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[last:] - 1).tolist()
    for at in range(0, n, BLOCK):
        yield np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])], np.uint64)


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The bits set in over half of all hashes, unsigned; 0 if there are none."""
    counts, n = np.zeros(BITS, np.int64), 0
    for hashes in blocks:
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(text: str | None, words: int) -> int:
    """The SimHash of one text's shingles of ``words`` words, unsigned; 0 for a text without words."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None) -> DataFrame:
    """``doc_id, fp, digest``: the fingerprint of every whole text, as a signed long of the same bits, and what the caller tells rows by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], ["doc_id", "fp", "digest"])

    told = F.lit(None).cast("string") if digest is None else digest
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), told.alias("digest")).mapInArrow(run, "doc_id long, fp long, digest string")


def _signed(bits: tuple[int, ...]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def links(fps: DataFrame, radius: int) -> DataFrame:
    """``a, b``: links that join all fingerprints (one row each, column ``fp``) at ``radius`` or fewer differing bits.

    Every fingerprint emits its ball: all variants within half the radius. Two fingerprints within
    the radius meet in a variant. As fingerprints are distinct, a variant gathers at most as many as
    its own ball holds (65 for radius 2), however many documents there are. Under an even radius all
    who meet lie within the radius of each other, so links between neighbours in sorted order lose no
    connection; under an odd radius every pair of the small meeting is tried. All links are
    deduplicated and verified.
    """
    half = (radius + 1) // 2
    masks = [_signed(bits) for k in range(half + 1) for bits in combinations(range(BITS), k)]
    balls = fps.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask")).select("fp", F.col("mask").bitwiseXOR(F.col("fp")).alias("variant"))
    if radius % 2:
        met = balls.groupBy("variant").agg(F.sort_array(F.collect_list("fp")).alias("met")).where(F.size("met") > 1)
        pairs = met.select(F.explode(F.expr("flatten(transform(met, (x, i) -> transform(slice(met, i + 2, size(met)), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
    else:
        pairs = balls.select(F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")).alias("a"), F.col("fp").alias("b")).where(F.col("a").isNotNull())
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root``: the smallest node that each node of ``edges`` (``a, b``) reaches.

    Alternating large-star and small-star rounds: each links neighbours to their smallest common
    neighbour until only stars around the smallest nodes remain. Work is a few joins-free
    aggregations over edge rows, cut by a table in the shared folder every round.
    """
    edges = edges.where(F.col("a") != F.col("b"))
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, larger=True)
        small = _star(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), larger=False)
        edges = land(small, "star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link each node's neighbours (the larger ones, or all of the given smaller ones and itself) to the smallest of them and itself."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    joined = edges.join(least, edges.a == least.n)
    if larger:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def near_groups(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose fingerprints link, directly or through others.

    Documents of one fingerprint are one node, so copies cost nothing further on and a group of any
    size is never gathered: only fingerprints travel. Returns ``doc_id, fp, fingerprint`` (16 hex
    digits) and ``component_id`` (smallest id of the group).

    Defined cases: null and empty texts have fingerprint 0, which links like any other; texts of fewer
    words than a shingle are one shingle; null ids are never a group's smallest unless it has no
    other; repeated rows each come back; an empty table gives no rows; other columns are ignored.
    """
    return _grouped(docs, words, radius, id_col, text_col).select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("best.doc_id").alias("component_id"))


def _grouped(docs: DataFrame, words: int, radius: int, id_col: str, text_col: str, digest: Column | None = None) -> DataFrame:
    """``doc_id, fp, digest, best`` for each row; ``best``: its group's smallest ``doc_id``, null last, and of its rows the smallest ``digest``."""
    marked = land(fingerprints(docs, words, id_col, text_col, digest), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    firsts = land(marked.groupBy("fp").agg(F.min(row).alias("first")), "distinct")
    roots = components(land(links(firsts.select("fp"), radius), "links"))
    linked = land(roots.join(firsts, roots.node == firsts.fp).select("fp", "root", "first"), "roots")
    smallest = linked.groupBy("root").agg(F.min("first").alias("smallest"))
    named = linked.join(smallest, "root").select("fp", "smallest")
    best = firsts.join(named, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("best"))
    # A hot fingerprint may hold a third of the documents: salted on the document.
    return salted_left_join(marked, best, "fp", ["doc_id", "digest"])


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")
