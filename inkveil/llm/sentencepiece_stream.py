"""SentencePiece encoding and decoding by a streaming Viterbi search over the model's pieces.

The search goes through a text character by character. For each place it keeps a back-pointer to a
place at most one longest piece before; when the paths to all places that a later piece can start from
run through one boundary, the ids up to it are final and are given out, so memory is bounded by a
window, not by the text.

A unigram model's best path has the greatest sum of scores. A byte-pair model's result is a path of
the same lattice: the only one on which every two neighbouring pieces are what merging gives for the
two alone. Each prefix of a text has one such path, so there too one back-pointer for each place is enough.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import in_portions

SPACE = "▁"
#: Stretches between space marks, and pairs of pieces, that a worker remembers, 100 to 200 bytes each; beyond it starts anew.
CACHE = 700_000
#: Characters that are normalised at once, up to the next place that allows a cut.
NORMAL = 1 << 16
UNREACHED = float("-inf")


class Model:
    """Pieces and scores of a model file, and the search over them. The library reads the file and normalises texts."""

    def __init__(self, path: str):
        self.library = p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        self.names = [p.id_to_piece(i) for i in range(n)]
        plain = [not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)) for i in range(n)]
        self.ids = {name: i for i, name in enumerate(self.names) if plain[i]}
        self.unknown = p.unk_id()
        self.scores = {name: p.get_score(i) for name, i in self.ids.items()}
        self.byte_ids = {int(self.names[i][3:5], 16): i for i in range(n) if p.is_byte(i)}
        self.bytes = {i: b for b, i in self.byte_ids.items()}
        self.silent = {i for i in range(n) if p.is_control(i)}
        self.longest = max(map(len, self.ids))
        self.worst = min(self.scores.values()) - 10.0
        # Byte-pair scores are ranks: whole numbers from 0 down.
        self.merges = all(s == int(s) and s <= 0 for s in self.scores.values())
        # A text may be cut before a space mark, unless a piece has one after another character.
        self.cuts = not any(SPACE in name.lstrip(SPACE) for name in self.ids)
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if self.cuts else r"(?s).+")
        self.apart = re.compile("(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
        # The mark that the library puts in front, where it does not merge with a space that is there.
        self.extra = len(p.normalize(" a")) - len(SPACE + "a")
        self.stretches: dict[str, bytes] = {}
        self.root: tuple = ({}, (), "")
        self.nodes = {"": self.root}
        self.pairs: dict[int, bool] = {}
        # From this id on there are plain pieces only.
        self.first_plain = max((i for i in range(n) if not plain[i]), default=-1) + 1
        if self.merges:
            # Single characters come before any merge.
            self.rank = {name: -s if len(name) > 1 else -1.0 - i for i, (name, s) in enumerate(self.scores.items())}
            self.halves: dict[str, tuple[str, str]] = {}
            for name in sorted(self.ids, key=self.rank.__getitem__):
                found = self.merged(name)
                if len(name) > 1 and len(found) == 2:
                    self.halves[name] = (found[0], found[1])
            self.whole = {name: i for name, i in self.ids.items() if len(name) == 1 or name in self.halves}
            self.beginnings = {name[:i] for name in self.whole for i in range(1, len(name) + 1)}

    def merged(self, piece: str) -> list[str]:
        """The parts of a piece before its last merge: neighbours merge by rank, then from the left, but not into the piece itself."""
        parts = list(piece)
        while len(parts) > 2:
            ranks = [self.rank.get(a + b, np.inf) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == np.inf:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def agree(self, a: str, b: str) -> bool:
        """Does merging the text of two pieces give the two: no merge across their border comes before those within them.

        Goes back through the merges of both, the latest first, and looks for a merge across the border
        that would have come earlier.
        """
        if a not in self.rank or b not in self.rank:
            return True
        key = self.ids[a] * len(self.names) + self.ids[b]
        known = self.pairs.get(key)
        if known is not None:
            return known
        rank, halves = self.rank, self.halves
        limit = np.inf
        while True:
            if rank.get(a + b, np.inf) < limit:
                answer = False
                break
            ra, rb = rank[a] if a in halves else -np.inf, rank[b] if b in halves else -np.inf
            if ra == rb == -np.inf:
                answer = True
                break
            if ra > rb:
                # Undo the later one: up to then, merges across the border must rank behind it. On a tie the left goes first.
                limit, a = ra, halves[a][1]
            else:
                limit, b = rb + 0.5, halves[b][0]
        if len(self.pairs) > CACHE:
            self.pairs.clear()
        self.pairs[key] = answer
        return answer

    def search(self, text: str) -> Iterator[list[int | str]]:
        """Ids of a text (a character without a piece as itself), in lists that are final when they are given out.

        Every ``4 * longest`` characters the search looks for the boundary that all paths still open share, gives out
        what is before it and forgets it.
        """
        base, size, span = 0, len(text), 4 * self.longest
        back, kept, node = [0], [-1] if self.merges else [0.0], self.root
        step = self._merge if self.merges else self._gain
        for start in range(0, size, span):
            stop = start + span
            if stop >= size:
                step(text, base, start, size, back, kept, node)
                yield self.path(text, base, back, kept, size - base)
                return
            node = step(text, base, start, stop, back, kept, node)
            if common := self.shared(back, stop - base):
                yield self.path(text, base, back, kept, common)
                base, back, kept = base + common, [0, *back[common + 1 :]], kept[common:]

    def _move(self, node: tuple, c: str) -> tuple:
        """The automaton's state after one more character: moves that are known, pieces that end here (length, id), the longest beginning of a piece that does."""
        name = node[2] + c
        while name and name not in self.beginnings:
            name = name[1:]
        after = self.nodes.get(name)
        if after is None:
            ending = tuple((i, self.whole[name[-i:]]) for i in range(1, len(name) + 1) if name[-i:] in self.whole)
            after = self.nodes[name] = ({}, ending, name)
        if c in self.beginnings:
            node[0][c] = after
        return after

    def _merge(self, text: str, base: int, start: int, stop: int, back: list[int], ends: list[int], node: tuple) -> tuple:
        """Append the back-pointers of the places from ``start`` to ``stop``, and ``ends``, the pieces that end there (-1: none), of a byte-pair model.

        An automaton over all pieces gives those that end at a place, short ones, which are the likely ones, first; only one can fit.
        """
        known, n, agree, names = self.pairs.get, len(self.names), self.agree, self.names
        at = start - base
        for c in text[start:stop]:
            at += 1
            node = node[0].get(c) or self._move(node, c)
            for size, k in node[1]:
                if size > at:
                    ends.append(-1)
                    back.append(1)
                    break
                t = ends[at - size]
                if t < 0:
                    ends.append(k)
                    back.append(size)
                    break
                ok = known(t * n + k)
                if ok or ok is None and agree(names[t], names[k]):
                    ends.append(k)
                    back.append(size)
                    break
            else:
                ends.append(-1)
                back.append(1)
        return node

    def _gain(self, text: str, base: int, start: int, stop: int, back: list[int], score: list[float], node: tuple) -> tuple:
        """Append the back-pointers of the places from ``start`` to ``stop``, and the best ``score`` up to each, of a unigram model."""
        for at in range(start + 1, stop + 1):
            best, n = UNREACHED, 1
            for s in range(max(base, at - self.longest), at):
                gain = self.scores.get(text[s:at], self.worst if s == at - 1 else None)
                if gain is not None and score[s - base] + gain > best:
                    best, n = score[s - base] + gain, at - s
            back.append(n)
            score.append(best)
        return node

    def shared(self, back: list[int], end: int) -> int:
        """The last boundary on the paths to all places that a later piece can start from."""
        ends = set(range(max(0, end - self.longest + 1), end + 1))
        while len(ends) > 1:
            at = max(ends)
            ends.remove(at)
            ends.add(at - back[at])
        return ends.pop()

    def path(self, text: str, base: int, back: list[int], kept: list, at: int) -> list[int | str]:
        """The ids on the path to a place, counted from ``base``."""
        out = []
        while at:
            n = back[at]
            piece = kept[at] if self.merges else self.ids.get(text[base + at - n : base + at], -1)
            out.append(text[base + at - n : base + at] if piece < 0 else piece)
            at -= n
        out.reverse()
        return out

    def ids_of(self, found: Iterable[int | str]) -> bytes:
        """Little-endian unsigned 32-bit ids; a character without a piece is given by its bytes, or is unknown."""
        out = array("I")
        for i in found:
            if isinstance(i, int):
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in i.encode())
            else:
                out.append(self.unknown)
        return out.tobytes()

    def normal(self, text: str) -> Iterator[str]:
        """The normalised text, block by block; blocks end before a space between ASCII letters or digits, where nothing is composed."""
        at = 0
        while at < len(text):
            cut = self.apart.search(text, at + NORMAL) if self.cuts and len(text) - at > NORMAL else None
            end = cut.start() if cut else len(text)
            block = self.library.normalize(text[at:end])
            yield block[self.extra :] if at else block
            at = end

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; null counts as empty.

        A space mark is a boundary of every path, so the search commits there, and what it committed from one to the
        next at once is remembered.
        """
        out = []
        for block in self.normal(text or ""):
            for stretch in self.cut.findall(block):
                ids = self.stretches.get(stretch)
                if ids is None:
                    parts = [self.ids_of(part) for part in self.search(stretch)]
                    ids = b"".join(parts)
                    if len(parts) == 1:
                        self.stretches[stretch] = ids
                out.append(ids)
            if len(self.stretches) > CACHE:
                self.stretches.clear()
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids: bytes are put together, space marks become spaces, and the one in front goes."""
        numbers = np.frombuffer(ids, "<u4")
        if len(numbers) and numbers.min() >= self.first_plain:
            return "".join(map(self.names.__getitem__, numbers.tolist())).removeprefix(SPACE).replace(SPACE, " ")
        out: list[str] = []
        held = bytearray()
        for i in numbers.tolist():
            if i in self.bytes:
                held.append(self.bytes[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.silent:
                out.append(self.names[i])
        out.append(held.decode("utf-8", "replace"))
        return "".join(out).removeprefix(SPACE).replace(SPACE, " ")


@functools.cache
def model(path: str) -> Model:
    """One model for each Python worker."""
    return Model(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded``: ids of every whole text (binary, little-endian unsigned 32-bit), and the text that they decode to.

    Row by row, no shuffle. Defined cases: a null or empty text has no ids and decodes to an empty one; null
    ids pass through; repeated rows are encoded each; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in in_portions(texts):
                ids = [m.encode(t) for t in texts[part]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, len(ids)), pa.array(ids, pa.binary()), pa.array([m.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    coded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.crc32(F.col("decoded").cast("binary")).alias("text_crc32"))
