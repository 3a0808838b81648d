"""The near-dedup stage: SimHash balls and MinHash bands gather candidates, shared shingles decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keep_rows, land, salted_left_join
from .simhash import components, links, majority, shingle_hashes

#: Bands of minima and minima in a band. Texts of similarity 0.8 share a band with probability 1 - (1 - 0.8**6)**24 = 0.9993.
BANDS, ROWS = 24, 6
#: Shingles whose minima are taken at once.
BLOCK = 1 << 11
#: Bytes of shingles in one batch.
PORTION = 8_000_000
#: A shingle in no more than so many of the texts that are left is tried first.
RARE = 16
#: Pairs of one pivot that one task verifies; more are spread over copies of the pivot.
PAIRS_AT_ONCE = 1000

_ODD, _SHIFT = (np.random.default_rng(1).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64))
_ODD |= np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of the minima of ``hashes``; equal sets have equal keys."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), BLOCK):
        mixed = (hashes[None, at : at + BLOCK] ^ _SHIFT) * _ODD
        np.minimum(least, mixed.min(axis=1), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _marks(docs: DataFrame, words: int, id_col: str, text_col: str, digest: Column) -> DataFrame:
    """``doc_id, digest, row`` of each row, and of its text: ``same`` (equal for equal sets of shingles), ``n``, ``fp``, ``bands``, ``shingles``.

    Shingles are stored by 32 bits of their hashes: among two texts of 20,000 words a tenth of a shingle is taken
    for another.
    """

    def made(rows: list, out: list) -> pa.RecordBatch:
        same, n, fps, bands, sets = zip(*out)
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(np.concatenate(sets).view(np.int32)))
        keyed = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(np.concatenate(bands)))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string()))]
        fp = pa.array(np.array(fps, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([*columns, pa.array(same), pa.array(n, pa.int64()), fp, keyed, listed], ["doc_id", "digest", "same", "n", "fp", "bands", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out, size = [], [], 0
            for i, text, told in zip(*(batch.column(c) for c in range(3))):
                blocks = list(shingle_hashes(text.as_py(), words))
                own = np.unique(np.concatenate([*blocks, np.empty(0, np.uint64)]))
                short = np.unique(own.astype(np.uint32))
                rows.append((i.as_py(), told.as_py()))
                out.append((hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest(), len(short), majority(blocks), band_keys(own), short))
                size += short.nbytes
                if size >= PORTION:
                    yield made(rows, out)
                    rows, out, size = [], [], 0
            if rows:
                yield made(rows, out)

    schema = "doc_id long, digest string, same string, n long, fp long, bands array<long>, shingles array<int>"
    told = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), digest.alias("digest"))
    return told.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def _verified(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``node, pivot`` whose sets of ``shingles`` (``node, shingles``) have the similarity, in full comparison.

    A node has a few pivots; a pivot may have any number of nodes, so copies of a pivot are made, one for each
    ``PAIRS_AT_ONCE`` of its pairs.
    """
    copies = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / PAIRS_AT_ONCE).cast("int").alias("copies"))
    dealt = salted_left_join(pairs, copies, "pivot", ["node"]).withColumn("copy", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int"))
    own = dealt.select("node", "pivot", "copy").join(shingles, "node")
    theirs = shingles.select(F.col("node").alias("pivot"), F.col("shingles").alias("theirs")).join(copies, "pivot")
    theirs = theirs.select("pivot", "theirs", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    shared = F.size(F.array_intersect("shingles", "theirs"))
    alike = shared >= similarity * (F.size("shingles") + F.size("theirs") - shared)
    return own.join(theirs, ["pivot", "copy"]).where(alike).select("node", "pivot")


def _prefixes(nodes: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """``s, node, n, at, texts``: the first shingles of each of ``nodes`` (``node, n``) that others of them have, too.

    Shingles are put in one order, those in the fewest of these texts first; ``at`` is a shingle's place in its text's
    order, from 1. Two sets of the similarity share a shingle among the first n - similarity * n + 1 of each. A
    passage that many unlike texts share stands behind what they have of their own.
    """
    listed = nodes.join(shingles, "node").select("node", "n", F.explode("shingles").alias("s"))
    common = listed.groupBy("s").agg(F.count("*").alias("texts")).where("texts > 1")
    ranked = listed.join(common, "s", "left").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("texts", F.lit(1)).alias("texts"), "s"))).alias("order"))
    length = (F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1).cast("int")
    first = ranked.select("node", "n", F.posexplode(F.slice("order", F.lit(1), length)).alias("at", "o")).where("o.texts > 1")
    return first.select(F.col("o.s").alias("s"), "node", "n", (F.col("at") + 1).alias("at"), F.col("o.texts").alias("texts"))


def _across(first: DataFrame, parts: DataFrame, similarity: float) -> DataFrame:
    """``node, pivot``: every pair of different parts (``parts``: ``node, part``) that meets in ``first`` (:func:`_prefixes`) and can have the similarity.

    Of the texts with a shingle, those of the part that has most of them meet only the others, never each other. The
    first shingle that two texts share leaves room for as many more as stand behind it in both: where that is too few for
    the similarity, they are no pair.
    """
    placed = land(first.join(parts, "node"), "placed")
    counts = placed.groupBy("s", "part").agg(F.count("*").alias("texts"))
    most = counts.groupBy("s").agg(F.max_by("part", F.struct("texts", "part")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    shared = land(placed.drop("texts").join(most.drop("parts"), "s"), "shared")
    few = shared.where("part <> most").select("s", *(F.col(c).alias(f"pivot{u}") for c, u in (("node", ""), ("n", "_n"), ("at", "_at"), ("part", "_part"))))
    room = 1 + F.least(F.col("n") - F.col("at"), F.col("pivot_n") - F.col("pivot_at"))
    fits = room >= similarity / (1 + similarity) * (F.col("n") + F.col("pivot_n")) - 1e-6
    once = (F.col("part") == F.col("most")) | (F.col("node") < F.col("pivot"))  # two of the few meet twice
    met = shared.join(few, (shared.s == few.s) & (F.col("part") != F.col("pivot_part")) & once & fits)
    return met.select("node", "pivot").distinct()


def similar_links(nodes: DataFrame, shingles: DataFrame, similarity: float, radius: int) -> DataFrame:
    """``a, b``: verified links that join all of ``nodes`` (``node, n, fp, bands``) which share a bucket or a ball and have the similarity.

    A node is in a bucket for each band of its minima and one for its fingerprint. First every member of a bucket is
    compared with its pivot, the member with most company in all its buckets, which is the text that others derive
    from; so a large group of copies costs a comparison for each copy, not for each pair. Fingerprints within ``radius``
    bits meet in balls (:func:`simhash.links`) and are verified alike. Where a bucket's members then are in more than one
    part, every pair of different parts that can be similar is found through rare shingles and verified, so
    no link between parts is lost, and nothing is compared within a part.
    """
    keyed = nodes.select("node", "n", F.explode(F.array_append("bands", F.xxhash64(F.lit("fp"), "fp"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    crowded = land(salted_left_join(keyed, sizes, "key", ["node"]).where(F.col("size").isNotNull()), "crowded")
    weights = crowded.groupBy("node").agg(F.sum("size").alias("weight"))
    members = land(crowded.drop("size").join(weights, "node").select("key", "node", "n", "weight"), "members")

    firsts = nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first"))
    near = links(firsts.select("fp"), radius)
    side = lambda fp, node, n: firsts.select(F.col("fp").alias(fp), F.col("first.node").alias(node), F.col("first.n").alias(n))
    balls = near.join(side("a", "node", "n"), "a").join(side("b", "pivot", "pivot_n"), "b").select("node", "n", "pivot", "pivot_n")

    best = F.max_by(F.struct("node", "n"), F.struct("weight", -F.col("node")))
    pivots = members.groupBy("key").agg(best.alias("best")).select("key", F.col("best.node").alias("pivot"), F.col("best.n").alias("pivot_n"))
    met = salted_left_join(members, pivots, "key", ["node"]).where(F.col("node") != F.col("pivot")).select("node", "n", "pivot", "pivot_n")
    fit = F.least("n", "pivot_n") >= similarity * F.greatest("n", "pivot_n")
    pairs = land(met.unionByName(balls).where(fit).select("node", "pivot").distinct(), "pairs")
    linked = land(_verified(pairs, shingles, similarity), "linked")

    roots = components(linked.select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    placed = land(members.drop("weight").join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("part")), "placed")
    open_keys = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key", F.lit(True).alias("open"))
    left = land(salted_left_join(placed, open_keys, "key", ["node"]).where("open").select("node", "n", "part").distinct(), "open")
    first, parts = land(_prefixes(left.select("node", "n"), shingles, similarity), "prefixes"), left.select("node", "part")
    # What few texts share joins most parts, so that what many share has few pairs left to try.
    for some in (first.where(F.col("texts") <= RARE), first.where(F.col("texts") > RARE)):
        new = land(_verified(land(_across(some, parts, similarity), "across"), shingles, similarity), "linked")
        linked = linked.unionByName(new)
        named = lambda node, part: parts.select(F.col("node").alias(node), F.col("part").alias(part))
        joined = components(new.join(named("node", "a"), "node").join(named("pivot", "b"), "pivot").select("a", "b").distinct())
        parts = land(parts.join(joined.select(F.col("node").alias("part"), "root"), "part", "left").select("node", F.coalesce("root", "part").alias("part")), "parts")
    return linked.select(F.col("node").alias("a"), F.col("pivot").alias("b"))


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, best`` for each row: the SHA-256 of its text, and its group's row with the smallest id, null last, then the smallest digest.

    Texts link when their sets of ``words``-word shingles have a Jaccard similarity of ``similarity`` or more; groups
    are what links reach. Texts of equal sets are one node, so copies cost nothing further on.

    Defined cases: texts of fewer words are one shingle; null texts and texts without words are alike; null ids are
    never a group's smallest unless it has no other; repeated rows each come back; an empty table gives no rows;
    other columns are ignored.
    """
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    marked = land(_marks(docs, words, id_col, text_col, digest), "shingles")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest", "row")
    of_text = [F.any_value(c).alias(c) for c in ("n", "fp", "bands")]
    nodes = land(marked.groupBy("same").agg(F.min(row).alias("first"), *of_text).withColumn("node", F.col("first.row")), "nodes")
    shingles = marked.select(F.col("row").alias("node"), "shingles")
    roots = components(land(similar_links(nodes, shingles, similarity, radius), "links"))
    linked = land(roots.join(nodes.select("node", "same", "first"), "node").select("root", "same", "first"), "roots")
    named = linked.join(linked.groupBy("root").agg(F.min("first").alias("smallest")), "root").select("same", "smallest")
    best = nodes.select("same", "first").join(named, "same", "left").select("same", F.coalesce("smallest", "first").alias("best"))
    return salted_left_join(marked.select("doc_id", "digest", "same", "row"), best, "same", ["row"]).select("doc_id", "digest", "best")


def one_of_each_group(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of :func:`similar_groups`, that with the smallest id, with all its columns.

    Defined cases: as there; rows are told by id and text, so rows that repeat an id with texts of other groups stay;
    of rows of a group that share its smallest id one stays; a null id stays only if its group has no other; any
    further columns are kept.
    """
    marked = similar_groups(docs, words, similarity, radius, id_col, text_col)
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    return keep_rows(docs, marked.select("doc_id", "digest", kept.alias("kept")), id_col, digest, F.lit(0))
