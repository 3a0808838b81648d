"""Token ids of whole texts, exactly as the tokenizers library gives them, by word."""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Words whose ids a worker keeps, some 200 bytes each. Half of them are those of the last texts; the other half were before.
CACHE_WORDS = 400_000

#: Texts of these characters alone are cut into words here; the cuts are tested to agree with the
#: library. A text with any other character, or with a special token's string, goes to it whole.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]*")
#: White space three long, or two at the end: there the library's cut may lie elsewhere.
LONG_SPACE = re.compile(r"[\t\n\r ][\t\n\r ](?:[\t\n\r ]|\Z)")
#: Letters and marks among the plain characters; all others are digits and white space.
LETTERS, MARKS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", r"!-/:-@\[-`{-~¡-©«¬®-±´¶-¸»¿×÷"
#: A word of letters is one piece. NUL in front: it follows no space.
STEM = re.compile(f"\0?[{LETTERS}]+")
#: Marks after letters at a word's end are a piece of their own.
ENDING = f"([{LETTERS}])([{MARKS}]+)([\t\n\r ]|$)"


class Encoder:
    """Encode texts to little-endian unsigned 32-bit ids.

    Both public vocabularies merge within words only, so a word has the same ids in every text: each
    distinct word is encoded once, and a text is put together from its words' ids. A vocabulary that
    lower-cases and drops white space is cut at white space; a byte-level one before each space and
    around each line feed. The letters of all words that are new to a portion of texts go to the
    library in one call, whose ids are cut where a word begins or ends.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = t = Tokenizer.from_file(path)
        self.specials = [t.content for t in t.get_added_tokens_decoder().values()]
        self.lower = "Lowercase" in str(t.normalizer)
        names = t.get_vocab()
        self.begins, self.closes = (np.zeros(max(names.values()) + 1, bool) for _ in range(2))
        for name, i in names.items():
            # Byte-level vocabularies write a space as the 256th character beyond it.
            self.begins[i], self.closes[i] = name.startswith("Ġ"), name.endswith("</w>")
        self.line = names.get("Ċ")
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def plain(self, text: str | None) -> bool:
        """May the text be cut here?"""
        text = text or ""
        return bool(PLAIN.fullmatch(text)) and not any(s in text for s in self.specials) and (self.lower or not LONG_SPACE.search(text))

    def cut(self, texts: list[str]) -> pa.Array:
        """The words of plain texts, cut at spaces."""
        if self.lower:
            texts = [t.lower().replace("\n", " ").replace("\t", " ").replace("\r", " ") for t in texts]
            return pc.split_pattern(pc.replace_substring_regex(pa.array(texts, pa.large_string()), ENDING, r"\1 \2\3"), " ")
        apart = pc.replace_substring_regex(pa.array(["\0" + t for t in texts], pa.large_string()), ENDING, "\\1 \0\\2\\3")
        return pc.split_pattern(pc.replace_substring(apart, "\n", " \0\n \0"), " ")

    def _joined(self, stems: list[str], glue: str, front: str) -> tuple[np.ndarray, bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([front + glue.join(stems)], add_special_tokens=False)[0].ids, "<u4")
        return ids, ids.tobytes()

    def _stems(self, stems: list[str]) -> None:
        """Ids of words of letters."""
        bare = [s for s in stems if s[0] == "\0"]
        spaced = [s for s in stems if s[0] != "\0"]
        if spaced:
            ids, data = self._joined(spaced, " ", "" if self.lower else " ")
            ends = np.flatnonzero(self.closes[ids]) + 1 if self.lower else np.append(np.flatnonzero(self.begins[ids])[1:], len(ids))
            self._put(spaced, data, np.append(0, ends[:-1]), ends)
        if bare:
            ids, data = self._joined([s[1:] for s in bare], "\n", "")
            lines = np.flatnonzero(ids == self.line)
            self._put(bare, data, np.append(0, lines + 1), np.append(lines, len(ids)))

    def _put(self, words: list[str], data: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        if len(words) != len(ends):
            raise ValueError("the library's ids do not fall into the words that were given")
        self.words.update(zip(words, (data[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist()))))

    def learn(self, words: Iterable[str]) -> None:
        """Make sure that the ids of ``words`` are in ``self.words``."""
        own, before = self.words, self.before
        stems = []
        for word in words:
            if word in own:
                continue
            ids = before.get(word)
            if ids is not None:
                own[word] = ids
            elif STEM.fullmatch(word):
                stems.append(word)
            elif self.lower:
                own[word] = self._whole(word) if word else b""
            else:
                own[word] = self._whole(word[1:] if word[:1] == "\0" else " " + word)
        self._stems(stems)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has; null counts as empty."""
        plain = list(map(self.plain, texts))
        lists = self.cut([t or "" if own else "" for t, own in zip(texts, plain)])
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self.learn(words)
        ids = list(map(self.words.__getitem__, words))
        at = coded.indices.to_numpy()
        n_words = pc.list_value_length(lists).to_numpy()
        if not all(plain):
            # The empty text in such a text's place is one word.
            firsts = np.cumsum(n_words) - n_words
            at = at.copy()
            for i in np.flatnonzero(~np.array(plain)):
                at[firsts[i]] = len(ids)
                ids.append(self._whole(texts[i]))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        taken = sizes[at]
        ends = np.cumsum(taken)
        flat = flat[np.repeat(starts[at] - ends + taken, taken) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.cumsum(n_words) - 1
        counts = np.diff(ends[last], prepend=0) if len(last) else np.zeros(0, np.int64)
        if len(self.words) > CACHE_WORDS // 2:
            self.words, self.before = {}, self.words
        return flat, counts

    def encode_ended(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode`, with ``end_id`` after each text."""
        flat, counts = self.encode(texts)
        return np.insert(flat, np.cumsum(counts), np.uint32(end_id)), counts + 1


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def in_portions(texts: list[str | None], chars: int = 4_000_000):
    """Slices of ``texts`` of about so many characters, so that memory does not follow the batch."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= chars:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
