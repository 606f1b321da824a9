"""Byte-level BPE: vocabulary, pre-splitting, exact counts by automaton and exact ids by corpus-level merge replay.

Both encoders work on word types. A text is cut at single spaces into chunks, the split pattern is applied once per
distinct chunk, and all blocks of texts (Arrow batches) of a worker share one table of chunks and words, so the cost of the
merges follows the vocabulary and not the text.
"""

from __future__ import annotations

import heapq
import json
import os
from collections import defaultdict
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import regex

#: Where the vocabulary files lie unless a caller says otherwise.
TOKENIZER_DIR = os.environ.get("STRATAVEC_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"

# The split pattern that the byte-level vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


KEPT = 2_000_000  #: words or token pairs that a worker remembers; beyond it, it starts anew


def _byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files write bytes: printable Latin-1 stands for itself, the rest follows from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Tokens as latin-1 text (one character a byte) by id, and each merge (left id, right id) with rank and result."""

    tokens: list[str]
    merges: list[tuple[int, int, int]]
    pairs: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)
    ids: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.ids = {t: i for i, t in enumerate(self.tokens) if t}
        self.pairs = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(self.merges)}
        self.made = {c: (rank, a, b) for rank, (a, b, c) in reversed([*enumerate(self.merges)])}
        self.byte = [self.ids[chr(b)] for b in range(256)]

    @classmethod
    def load(cls, path: str | None = None) -> Vocabulary:
        """Read a tokenizer file of the JSON kind. Special tokens get no text: their strings in a text are plain text."""
        with open(path or os.path.join(TOKENIZER_DIR, VOCABULARY), encoding="utf-8") as f:
            model = json.load(f)
        special = {t["id"] for t in model.get("added_tokens", []) if t.get("special")}
        letters, vocab = _byte_letters(), model["model"]["vocab"]
        tokens = [""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            if i not in special:
                tokens[i] = "".join(chr(letters[c]) for c in t)
        merges = []
        for m in model["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            merges.append((vocab[a], vocab[b], vocab[a + b]))
        return cls(tokens, merges)


class Splitter:
    """Chunks of a text: maximal stretches between single spaces, each with its leading space; else the pattern itself.

    A chunk that neither starts nor ends in white space and stands between single spaces is split alike in any context,
    so its words can be kept. Texts with other white space at a chunk's edge are split by the pattern as a whole.
    """

    def __init__(self):
        self.words = regex.compile(PATTERN).findall

    def chunks(self, text: str) -> list[str]:
        parts = text.split(" ")
        if all(parts) and not any(p[0].isspace() or p[-1].isspace() for p in parts):
            parts[1:] = [" " + p for p in parts[1:]]
            return parts
        out: list[str] = []
        run: list[str] = []
        # stretches with unusual white space are joined again up to the next clean edge and split as one piece
        clean = [bool(p) and not p[0].isspace() and not p[-1].isspace() for p in parts]
        last = len(parts) - 1
        for k, p in enumerate(parts):
            run.append(p)
            if k == last or (clean[k] and clean[k + 1]):
                piece = " ".join(run)
                out.append(piece if k - len(run) < 0 else " " + piece)
                run = []
        return out


def _utf8(word: str) -> str:
    """UTF-8 as latin-1 text; what UTF-8 can't hold (lone surrogates) is replaced as in any stored text."""
    return word.encode("utf-8", "replace").decode("latin-1")


class Counter:
    """Exact numbers of tokens by an automaton over the vocabulary, in linear time and without making ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.auto = ahocorasick.Automaton()
        for token, i in vocabulary.ids.items():
            self.auto.add_word(token, (len(token), i))
        self.auto.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.split = Splitter()
        self.known: dict[str, int] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the bytes of a and b is just a, b: no merge across the seam comes before its sides' own."""
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > KEPT:
                self.fits.clear()
            got = self.fits[(a, b)] = self._compatible(a, b)
        return got

    def _compatible(self, a: int, b: int) -> bool:
        v = self.v
        # ra, rb: rank at which the piece at the seam came to be merged into its parent (none yet: never)
        end_a = end_b = len(v.merges)
        while True:
            merge = v.pairs.get((a, b))
            # the seam merge happens if both pieces still stand by themselves; at equal ranks the place to the left is first
            if merge and merge[0] < end_a and merge[0] <= end_b:
                return False
            made_a, made_b = v.made.get(a, (-1, 0, 0)), v.made.get(b, (-1, 0, 0))
            if made_a[0] < 0 and made_b[0] < 0:
                return True
            if made_a[0] > made_b[0]:
                end_a, a = made_a[0], made_a[2]
            else:
                end_b, b = made_b[0], made_b[1]

    def word(self, word: str) -> int:
        """Tokens of one word: the last token of every prefix is the longest that fits the last token before it."""
        s = _utf8(word)
        if s in self.v.ids:
            return 1
        n = len(s)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for end, (size, token) in self.auto.iter(s):
            end += 1
            start = end - size
            if last[end] < 0 and (start == 0 or last[start] >= 0 and self.compatible(last[start], token)):
                last[end], count[end] = token, count[start] + 1
        return count[n]

    def chunk(self, chunk: str) -> int:
        n = self.known.get(chunk)
        if n is None:
            n = sum(map(self.word, self.split.words(chunk)))
            if len(self.known) > KEPT:
                self.known.clear()
            if len(chunk) < 200:
                self.known[chunk] = n
        return n

    def text(self, text: str | None) -> int:
        return sum(map(self.chunk, self.split.chunks(text))) if text else 0


def replay(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words by replaying the merges in rank order over the words at once: (ids, offsets).

    An inverted index leads from a token pair to the places where it stands; a merge visits only these places and enters
    the pairs that arise beside them. Ranks that no place holds cost nothing.
    """
    parts = [_utf8(w).encode("latin-1") for w in words]
    byte = np.array(v.byte, np.int32)
    sizes = np.array([len(p) for p in parts], np.int64)
    total = int(sizes.sum())
    ids = byte[np.frombuffer(b"".join(parts), np.uint8)].tolist()
    word_of = np.repeat(np.arange(len(parts)), sizes)
    same = np.zeros(total, bool)
    same[:-1] = word_of[1:] == word_of[:-1]
    nxt = np.where(same, np.arange(1, total + 1), -1).tolist()
    prv = np.full(total, -1, np.int64)
    prv[1:][same[:-1]] = np.arange(total - 1)[same[:-1]]
    prv = prv.tolist()
    pairs, merges = v.pairs, v.merges
    places: dict[int, list[int]] = defaultdict(list)
    found: dict[tuple[int, int], int] = {}
    for i, j in enumerate(nxt):
        if j >= 0:
            key = (ids[i], ids[j])
            rank = found.get(key)
            if rank is None:
                rank = found[key] = pairs.get(key, (-1, 0))[0]
            if rank >= 0:
                places[rank].append(i)
    queue = [*places]
    heapq.heapify(queue)
    while queue:
        rank = heapq.heappop(queue)
        a, b, c = merges[rank]
        at = places.pop(rank)
        if a == b:
            at.sort()
        for i in at:
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = c, -1
            k = nxt[i] = nxt[j]
            if k >= 0:
                prv[k] = i
                new = pairs.get((c, ids[k]))
                if new:
                    if new[0] not in places:
                        heapq.heappush(queue, new[0])
                    places[new[0]].append(i)
            h = prv[i]
            if h >= 0:
                new = pairs.get((ids[h], c))
                if new:
                    if new[0] not in places:
                        heapq.heappush(queue, new[0])
                    places[new[0]].append(h)
    out = np.array(ids, np.int32)
    keep = out >= 0
    counts = np.bincount(word_of[keep], minlength=len(parts)) if total else np.zeros(len(parts), np.int64)
    return out[keep], np.concatenate([[0], np.cumsum(counts)])


def take_lists(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The concatenation of lists ``which`` out of ragged (values, offsets)."""
    sizes = offsets[which + 1] - offsets[which]
    ends = np.cumsum(sizes)
    return values[np.repeat(offsets[which] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Ids of blocks of texts; texts may be null. Words stay known from block to block, so each is merged once."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.split = vocabulary, Splitter()
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.chunks: dict[str, list[int]] = {}
        self.ids, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, new: list[str]) -> None:
        """Replay the merges over words met for the first time and add their ids to those known."""
        if new:
            ids, offsets = replay(new, self.v)
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
            self.ids = np.concatenate([self.ids, ids])

    def block(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts: distinct chunks, their distinct words, one replay of the new ones, then look-ups only."""
        if len(self.words) > KEPT or len(self.chunks) > KEPT:
            self._forget()
        numbers: dict[str, int] = {}
        number = numbers.setdefault
        sequences = [[number(c, len(numbers)) for c in self.split.chunks(t)] if t else [] for t in texts]
        words, chunks, new, parts = self.words, self.chunks, [], []
        for c in numbers:
            slots = chunks.get(c)
            if slots is None:
                slots = []
                for w in self.split.words(c):
                    slot = words.get(w)
                    if slot is None:
                        slot = words[w] = len(words)
                        new.append(w)
                    slots.append(slot)
                if len(c) < 200:
                    chunks[c] = slots
            parts.append(slots)
        self._learn(new)
        flat = np.fromiter(chain.from_iterable(parts), np.int64)
        per_chunk = np.concatenate([[0], np.cumsum([len(w) for w in parts])]).astype(np.int64)
        chunk_values = take_lists(self.ids, self.offsets, flat)
        sizes = self.offsets[flat + 1] - self.offsets[flat]
        chunk_offsets = np.concatenate([[0], np.cumsum(sizes)])[per_chunk]
        which = np.fromiter(chain.from_iterable(sequences), np.int64)
        per_text = np.concatenate([[0], np.cumsum([len(s) for s in sequences])]).astype(np.int64)
        values = take_lists(chunk_values, chunk_offsets, which)
        return values, np.concatenate([[0], np.cumsum(chunk_offsets[which + 1] - chunk_offsets[which])])[per_text]
