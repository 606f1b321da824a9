"""Items above a size limit, cut at natural boundaries with an overlap between consecutive pieces.

A sparse-table index over the boundaries of a text answers, for any window, which cut in it is the strongest, the
rightmost among equals. Every piece asks once, so a text of n characters with b boundaries costs O(n + b log limit).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strengths of the cuts; 0 is a cut inside a word, END the end of the text.
WORD, SENTENCE, LINE, PARAGRAPH, END = 1, 2, 3, 4, 5

_BREAKS = (
    (WORD, re.compile(r"\s+")),
    (SENTENCE, re.compile(r"[.!?…]+[\"'’”»)\]]*\s+|[。！？]+[”」』）]*\s*")),
    (LINE, re.compile(r"\r\n|[\n\r\u2028\x0b\x0c\x85]")),
    (PARAGRAPH, re.compile(r"(?:\r\n|\n|\r)(?:[ \t]*(?:\r\n|\n|\r))+|\u2029")),
)


class Boundaries:
    """Range-maximum index over the cuts of a text: levels[k][i] is the best of the 2^k cuts from the i-th on."""

    def __init__(self, text: str, reach: int):
        strength: dict[int, int] = {}
        for s, pattern in _BREAKS:
            for m in pattern.finditer(text):
                strength[m.end()] = s
        strength.pop(len(text), None)
        strength.pop(0, None)
        self.at = np.array(sorted(strength), np.int64)
        self.base = len(text) + 1
        level = np.array([strength[p] for p in self.at.tolist()], np.int64) * self.base + self.at
        self.levels = [level]
        while (width := 1 << len(self.levels)) <= min(len(self.at), reach):
            half = width >> 1
            level = np.maximum(level[: len(level) - half], level[half:])
            self.levels.append(level)

    def strongest(self, low: int, high: int) -> tuple[int, int] | None:
        """(position, strength) of the best cut in [low, high]; None if there is none."""
        i, j = int(np.searchsorted(self.at, low)), int(np.searchsorted(self.at, high, "right"))
        if i >= j:
            return None
        k = (j - i).bit_length() - 1
        best = max(int(self.levels[k][i]), int(self.levels[k][j - (1 << k)]))
        return best % self.base, best // self.base

    def first(self, low: int, high: int) -> int | None:
        """The first cut in [low, high)."""
        i = int(np.searchsorted(self.at, low))
        return int(self.at[i]) if i < len(self.at) and self.at[i] < high else None


def _between(text: str, at: int, low: int) -> int:
    """The last place at or before ``at`` that parts no line end and no letter from its marks; ``at`` itself if none is near."""
    p = at
    while p > low and (text[p - 1 : p + 1] == "\r\n" or unicodedata.combining(text[p]) or text[p] in "\u200d\ufe0f" or text[p - 1] == "\u200d"):
        p -= 1
    return p if p > low else at


def cut_text(text: str, limit: int = 4000, overlap: int = 200) -> list[tuple[int, int, int]]:
    """Pieces of a text as (start, end, strength of the cut at the end).

    A piece ends at the strongest cut among the lengths from half the limit to the limit, if there is none at the last cut
    before that, else at the limit. The next piece starts ``overlap`` before it, or at the first cut after that place.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be under half the limit")
    out, start, n = [], 0, len(text)
    index = Boundaries(text, limit + 1) if n > limit else None
    while n - start > limit:
        low = start + max(limit // 2, overlap + 1)
        best = index.strongest(low, start + limit)
        if not best and (i := int(np.searchsorted(index.at, low))) and index.at[i - 1] > start + overlap:
            best = int(index.at[i - 1]), int(index.levels[0][i - 1] // index.base)
        end, strength = best or (_between(text, start + limit, low), 0)
        out.append((start, end, strength))
        back = index.first(end - overlap, end) if overlap else end
        start = back if back is not None else _between(text, end - overlap, start)
    out.append((start, n, END))
    return out


_OUT = "piece int, start int, end int, strength int, text string"


def split_texts(df: DataFrame, key: str = "seq", text: str = "string", limit: int = 4000, overlap: int = 200) -> DataFrame:
    """``(key, piece, start, end, strength, text)`` of every text of more than ``limit`` characters (code points).

    Pieces hold at most ``limit`` characters, number from 0 and together cover the text; ``end`` is exclusive. Texts that
    are null or within the limit have no rows. A repeated row (same key and text) is cut once; further columns are left
    out, so clashing names don't matter. Each text is cut by itself, whole, where it is read.
    """
    k = F.col(f"`{key}`")
    long = df.select(k.alias("_sv_key"), F.col(f"`{text}`").alias("_sv_text")).filter(F.char_length("_sv_text") > limit).dropDuplicates(["_sv_key", "_sv_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, of = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for p, (start, end, strength) in enumerate(cut_text(t, limit, overlap)):
                    rows.append((p, start, end, strength, t[start:end]))
                    of.append(i)
            cols = [pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else ((),) * 5, (*(pa.int32(),) * 4, pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *cols], names=["_sv_key", "piece", "start", "end", "strength", "text"])

    return long.mapInArrow(run, f"_sv_key {df.schema[key].dataType.simpleString()}, {_OUT}").withColumnRenamed("_sv_key", key)
